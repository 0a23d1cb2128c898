import random
import re

import numpy as np
import pytest

from loopsight.llm import jaccard


def brute(rows):
    """Components of documents by direct comparison of all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def made(seed, n=120):
    """Random texts, copies with edits of every strength, chains of small edits and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = list(r.choice(out[-20:])[1])
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                k = r.randrange(len(w) + 1)
                w[k : k + r.choice([0, 1, 3])] = [word() for _ in range(r.choice([0, 1, 2]))]
        else:
            w = [word() for _ in range(r.choice([1, 3, 5, 8, 40, 150, 400]))]
            if r.random() < 0.5:
                w += passage
        out.append((i, w))
    return [(i, " ".join(w)) for i, w in out] + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "ONE two"), (n + 4, "one TWO")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = made(seed)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute(rows)


def test_hot_tiles_and_shuffled_ids_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "MOST_BITS", 128)
    monkeypatch.setattr(jaccard, "SMALL", 0)
    rows = made(3, 60)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute(rows)


def test_links_across_size_bands(spark):
    """A text and copies that lost 4 to 20 per cent of their words: no near size is missed at a band's edge."""
    rows = []
    for k, n in enumerate(range(40, 400, 7)):
        words = [f"t{k}w{j}" for j in range(n)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[: n - n // 25])), (10 * k + 2, " ".join(words[: n - n // 6])), (10 * k + 3, " ".join(words[: n - n // 5]))]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute(rows)


def test_one_of_each_group_stays(spark, odd, empty):
    rows = made(4, 60)
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute(rows).values()})
    kept = jaccard.keep_one(odd)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5] and kept.columns == odd.columns
    assert jaccard.keep_one(empty).count() == 0


def test_components_of_long_chains_and_stars(spark):
    links = [(f"{k:03}", f"{k + 1:03}") for k in range(60)] + [("500", f"6{k:02}") for k in range(50)]
    found = {r["node"]: r["label"] for r in jaccard.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {found[f"{k:03}"] for k in range(1, 61)} == {"000"} and {found[f"6{k:02}"] for k in range(50)} == {"500"}


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(0)
    for _ in range(60):
        a = np.unique(r.integers(0, 1 << 63, r.integers(20, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], r.integers(0, 1 << 63, r.integers(1, len(a) // 3 + 2)).astype(np.uint64)]))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        least, differ = min(len(x), len(y)), len(np.setxor1d(a, b))
        assert (jaccard._folded(x, least) ^ jaccard._folded(y, least)).bit_count() <= differ
        may = jaccard.possible(len(a), len(b), x, y)
        assert may or 9 * differ > len(a) + len(b)
        n, label, home = np.array([len(a), len(b)]), np.array([0, 1]), np.array([True, False])
        for left in (None, np.array([True, False])):
            assert [p.tolist() for p in jaccard._meeting(n, label, home, left, [x, y])] == ([[0], [1]] if may else [[], []])
        assert not len(jaccard._meeting(n, label * 0, home, None, [x, y])[0]) and not len(jaccard._meeting(n, label, ~home & False, None, [x, y])[0])


def test_shingles_are_equal_however_texts_are_cut(monkeypatch):
    texts = ["One two\tthree four five six " * 9, None, "", "x" * 700 + " y", "x" * 699 + " xy", "\n a b c", "ONE TWO THREE FOUR FIVE SIX " * 9]
    whole = [s.tolist() for s in jaccard.shingles(texts)]
    for piece in (1, 7, 64, 100):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        assert [s.tolist() for s in jaccard.shingles(texts)] == whole
    assert whole[0] == whole[6] and len(whole[0]) == 6 and whole[1] == whole[2] == [] and whole[3] != whole[4]


def test_texts_of_a_repeated_id_stay_unless_linked(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (3, c), (3, c + " end"), (4, ""), (4, None), (5, ""), (None, a), (None, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], (r["text"] or "").removesuffix(" end")) for r in kept if r["doc_id"])
    assert found == [(1, a), (1, b), (3, c), (4, ""), (5, "")] and sum(r["doc_id"] is None for r in kept) == 2
