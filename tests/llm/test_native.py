"""Quality rules and mixing: exact counts against plain Python, fixed points of the estimates, no Python in the plans."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loopsight.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_python(spark, odd):
    r = random.Random(2)
    texts = [" ".join(r.choice("a b c dd ee | $x 😀 é".split()) + r.choice(["", "\n", "\t"]) for _ in range(r.randrange(60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for x in quality.with_counts(rows).collect():
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == counts(x["text"])


def test_estimates_find_the_good_rules():
    r = random.Random(7)
    true = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.6]
    votes = Counter()
    for _ in range(20_000):
        good = 1 if r.random() < 0.7 else -1
        votes[tuple(0 if r.random() < 0.2 else good if r.random() < a else -good for a in true)] += 1
    m = quality.expectation_maximisation(list(votes.items()))
    assert abs(m.prior - 0.7) < 0.03 and all(abs(m.accuracy[k] - a) < 0.03 for k, a in zip(quality.RULES, true))


def test_posterior_is_that_of_the_fitted_model(spark):
    """Votes restated in plain Python, scored by the model's odds; a vote never speaks against itself."""
    r = random.Random(5)
    good = lambda: " ".join(r.choice("the of and to in a house river seven walked green window letter".split()) for _ in range(r.randrange(15, 90)))
    bad = lambda: r.choice([lambda: " ".join(f"$%&{r.randrange(99)}#" for _ in range(30)), lambda: "BUY NOW " * r.randrange(3, 40), lambda: " ".join(f"x{r.randrange(9999)}" for _ in range(40)), lambda: "ok!! " * r.randrange(2, 9), lambda: ""])()
    rows = [(k, good() if r.random() < 0.8 else bad(), "mine", 7, True) for k in range(400)]
    counted = quality.with_counts(spark.createDataFrame(rows, "doc_id long, text string, quality string, n_words int, kept boolean"))
    m = quality.fit(counted)
    assert all(o[-1] <= 0 <= o[0] and o[1] >= 0 for o in m.odds.values())
    kept = {True: 0, False: 0}
    for x in quality.judge(counted, m).collect():
        n, c = x["n_words"], x["word_chars"]
        vote = {
            "length": -(n < 20), "symbols": -(10 * x["n_symbols"] > c), "capitals": -(10 * x["n_upper"] > 4 * c), "exclaims": -(5 * x["n_exclaims"] > n), "lines": -(10 * x["n_dup_lines"] > 3 * x["n_lines"]), "repeats": -(20 * x["n_repeat_words"] > n),
            "word_length": -1 if 2 * c < 5 * n or c > 14 * n else int(3 * n <= c <= 10 * n), "function_words": -1 if not x["n_common"] and n >= 20 else int(20 * x["n_common"] >= n),
        }
        score = math.log(m.prior / (1 - m.prior)) + sum(m.odds[k][int(v)] for k, v in vote.items())
        want = 1 / (1 + math.exp(-score))
        failed = n < 10 or 100 * x["n_repeat_words"] > 20 * n
        assert abs(x["quality"] - want) < 1e-9 and x["base_failed"] == failed and x["kept"] == (not failed and want >= 0.5)
        kept[x["kept"]] += 1
    assert min(kept.values()) > 40


def test_verdicts(odd, empty, spark):
    counted = quality.with_counts(odd)
    out = quality.judge(counted, quality.fit(counted)).collect()
    assert len(out) == odd.count() and not any(r["kept"] for r in out if r["base_failed"])
    assert all(r["base_failed"] for r in out if r["doc_id"] in (1, 2, 4))
    assert quality.judge(quality.with_counts(empty), quality.fit(quality.with_counts(empty))).count() == 0
    plan = quality.judge(counted, quality.fit(counted))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_of_copies_equal_the_inverse(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 100 == 1, None).otherwise("small").alias("source"), F.lit("t").alias("text"))
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), 17).alias("u")).collect()}
    found = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    for r in docs.collect():
        assert found[r["doc_id"]] == poisson(u[r["doc_id"]], rates[r["source"]])


def test_steps_are_the_distribution(spark):
    rates = {"none": 0.0, "few": 0.3, None: 5.0, "many": 900.0, "most": 30_000.0}
    found = {r["source"]: r["steps"] for r in mixing.poisson_steps(spark.createDataFrame(list(rates.items()), "source string, rate double")).collect()}
    assert set(found) == {*rates} - {"none"}
    for source, steps in found.items():
        assert steps == sorted(steps) and abs(steps[-1] - 1) < 1e-7
        assert abs(sum(1 - s for s in steps) - rates[source]) < 1e-6 * max(1, rates[source])


def test_mix_without_broadcast_and_with_clashing_columns(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, None).otherwise("b").alias("source"), F.lit("x").alias("copy"), F.lit(1).alias("shuffle_key"))
    rows = lambda: sorted((r["doc_id"], r["copy"], r["shuffle_key"]) for r in mixing.mix(docs).collect())
    want = rows()
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert rows() == want and len({k for _, _, k in want}) == len(want) and {type(c) for _, c, _ in want} == {int}


def test_weights_and_edges(odd, empty, spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, "a").otherwise("b").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(docs, weights={"b": 3.0, "a": 1.0}).groupBy("source").count().collect()}
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.03 and abs(sum(n.values()) - 9000) < 500
    assert mixing.mix(docs, weights={"b": 1.0}).filter("source = 'a'").count() == 0
    out = mixing.mix(odd, weights={None: 1.0}, total=50.0)
    assert {r["source"] for r in out.collect()} == {None} and set(out.columns) == {*odd.columns, "copy", "shuffle_key"}
    assert mixing.mix(empty).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
