"""License scans against a scanner that tries every span, and patience alignment on its own."""

import random
from collections import Counter
from functools import cache

import pytest

from loopsight.llm import license


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def aligned(a, b):
    """Words aligned by patience, from its definition."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + aligned(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + aligned(a[:-1], b[:-1])
    once = [w for w in a if a.count(w) == b.count(w) == 1]
    if not once:
        return common(a, b)
    at = [b.index(w) for w in once]
    best: list[list[int]] = []  # the longest increasing subsequence that ends at each anchor, ties to the latest anchors
    for k in range(len(at)):
        best.append(max((best[i] for i in reversed(range(k)) if at[i] < at[k]), key=len, default=[]) + [k])
    chain = max(reversed(best), key=len)
    total, i, j = len(chain), 0, 0
    for k in [*chain, None]:
        i2, j2 = (a.index(once[k]), at[k]) if k is not None else (len(a), len(b))
        total += aligned(a[i:i2], b[j:j2])
        i, j = i2 + 1, j2 + 1
    return total


def every_span(words, template, coverage):
    """(aligned words, -words of text, spans) of the best choice among all spans that hold no shorter one with as many common words."""
    n = len(template)
    size = {}
    for a in range(len(words)):
        for b in range(a, min(len(words), a + 2 * n)):
            size[a, b] = common(words[a : b + 1], template)
    least = {s: c for s, c in size.items() if c >= coverage * n and size.get((s[0] + 1, s[1]), 0) < c and size.get((s[0], s[1] - 1), 0) < c}
    worth = {s: aligned(words[s[0] : s[1] + 1], template) for s in least}

    @cache
    def best(k):
        if k == len(words):
            return 0, 0, ()
        options = [best(k + 1)]
        for (a, b), w in worth.items():
            if a == k and w >= coverage * n:
                rest = best(b + 1)
                options.append((w + rest[0], rest[1] - (b - a + 1), ((a, b), *rest[2])))
        return max(options, key=lambda x: x[:2])

    return best(0)


@pytest.mark.parametrize("seed", range(12))
def test_finds_as_a_scanner_of_every_span(seed):
    r = random.Random(seed)
    for _ in range(40):
        template = [r.choice("abcdefghijkl"[: r.randint(2, 12)]) for _ in range(r.randint(1, 10))]
        words = []
        for _ in range(r.randint(0, 4)):
            copy = list(template)
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(copy) + 1)
                copy[k : k + r.randint(0, 2)] = r.choices("abcdexyz", k=r.randint(0, 2))
            if r.random() < 0.2:
                k = r.randrange(len(copy) + 1)
                copy = copy[k:] + copy[:k]
            words += copy + r.choices("abxyz", k=r.choice([0, 0, 1, 3, 8]))
        words = words[:36]
        coverage = r.choice([0.5, 0.7, 0.8, 1.0])
        found = license.scan(" ".join(words), license.prepare({"t": " ".join(template)}), coverage)
        matched, length, spans = every_span(words, template, coverage)
        assert sum(f["matched"] for f in found) == matched
        assert sum(f["last_word"] - f["first_word"] + 1 for f in found) == -length, (words, template, spans, found)
        for f in found:
            assert f["matched"] == aligned(words[f["first_word"] : f["last_word"] + 1], template) == round(f["coverage"] * len(template))
        for f, g in zip(found, found[1:]):
            assert f["last_word"] < g["first_word"]


def test_patience_pairs_are_an_alignment():
    r = random.Random(3)
    for _ in range(2000):
        a, b = (r.choices("abcdefgh", k=r.randint(0, 14)) for _ in range(2))
        pairs = license.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == aligned(a, b) <= common(a, b)
        rest = license._common(a, b)
        assert len(rest) == common(a, b) and all(a[i] == b[j] for i, j in rest) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(rest, rest[1:]))


def test_patience_decides():
    # All six words stand in the text, but the anchors' order cuts the alignment to the moved block's other part.
    template = "one two three four five six"
    prepared = license.prepare({"t": template})
    assert license.scan("four five six one two three", prepared, 0.6) == []
    moved = license.scan("five six one two three four", prepared, 0.6)
    assert [(f["first_word"], f["last_word"], f["matched"]) for f in moved] == [(2, 5, 4)]


def test_templates_of_common_words_none_and_empty():
    prepared = license.prepare({"plain": "you can use it as it is and so on", "none": "...", "empty": ""})
    found = license.scan("well, you can use it as it is and so on. You can use it as it is, and so on", prepared)
    assert [(f["license"], f["coverage"], f["first_word"]) for f in found] == [("plain", 1.0, 1), ("plain", 1.0, 11)]
    assert license.scan("you can use it", license.prepare({})) == []


def test_no_templates_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 7), (2, None, 8)], "doc_id long, text string, licenses long")
    assert [len(r["licenses"]) for r in license.scan_licenses(docs, {}).orderBy("doc_id").collect()] == [0, 0]
    assert [len(r["licenses"]) for r in license.scan_licenses(docs).orderBy("doc_id").collect()] == [1, 0]


@pytest.mark.parametrize("name", ["MIT-terms", "BSD-3-Clause-terms", "ISC", "Zlib"])
def test_whole_license_texts_with_edits(name):
    r = random.Random(len(name))
    words = license.words_of(license.TEMPLATES[name])
    prepared = license.prepare({name: license.TEMPLATES[name]})
    copies = []
    for _ in range(3):
        copy = list(words)
        for k in sorted(r.sample(range(len(copy)), len(copy) // 20), reverse=True):
            copy[k : k + 1] = r.choice([[], ["acme"], [copy[k], "inc"]])
        copies.append(copy)
    text = " ".join(" ".join(c) for c in copies) + " and then something else entirely"
    found = license.scan(text, prepared)
    assert len(found) == 3 and all(0.9 < f["coverage"] <= 1 for f in found)
    half = license.scan(" ".join(words[: len(words) // 2]), prepared)
    assert half == [] and max(Counter(words).values()) > 3
