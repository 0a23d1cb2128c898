"""Ranked search against scoring every document, and what the pairs' bounds save."""

import math
import random
import re
from collections import Counter

import compare
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from loopsight.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, score double, rank string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=20):
    """(item_id, rank, doc_id, score) by the definition."""
    bags = [(i, Counter(w)) for i, t in docs if (w := terms(t))]
    n_docs, n_terms = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in bags:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, n, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["Ärger", "ärger", "ÀB", "x9", "İ", "\U0001f600", "the", "The", "THE"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(r.choices(words, weights, k=r.randrange(1, 40))) + r.choice(["", ".", "\n", "\x00", " !?"])) for k in range(300)]
    docs += docs[:40] + [(1000 + k, docs[5][1]) for k in range(30)] + [(None, docs[5][1]), (None, None), (2000, None), (2001, ""), (2002, " .,- "), (2003, " ".join(r.choices(words, k=30_000)))]
    items = [(k, " ".join(r.choices(words, k=r.randrange(1, 30)))) for k in range(25)] + [(None, "w1 w2"), (30, None), (31, ""), (32, "nowhere at all"), (33, docs[5][1]), (33, docs[5][1]), (33, "w3"), (34, "w0 " * 50)]
    return docs, items


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("segment, block", [(4096, 2000), (16, 2000), (50, 4)])
def test_ranking_equals_scoring_all(spark, tables, segment, block):
    docs, items = tables
    d = spark.createDataFrame([(*x, 0.5, "r") for x in docs], SCHEMA).repartition(4)
    q = spark.createDataFrame([(*x, 0.5) for x in items], "item_id long, text string, score double")
    assert rows(lexical.rank(d, q, segment=segment, block=block)) == ranked(docs, items)


def test_sql_on_odd_rows(spark, tables, tmp_path):
    docs, items = tables
    con = duckdb.connect()
    for name, c, data in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        pq.write_table(spark.createDataFrame(data, f"{c} long, text string").toArrow(), tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    d, q = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "benchmark"))
    assert not compare.differences(lexical.rank(d, q), con, queries.oracle_sql()["op11_ranked_lexical_search"])


def test_pairs_skip_more_than_single_maxima(spark):
    """Rare words of one topic seldom meet in a document, so their pair is bounded by far less than the sum."""
    r = random.Random(9)
    docs = [(k, " ".join([*(f"t{k % 40}" for _ in range(1 + k % 3)), *r.choices([f"c{j}" for j in range(30)], k=20)])) for k in range(4000)]
    items = [(k, " ".join([f"t{k}", f"t{k + 1}", f"t{k + 2}", f"t{k + 3}", *r.choices([f"c{j}" for j in range(30)], k=8)])) for k in range(0, 36, 3)]
    own = lexical.Items([(i, t.encode()) for i, t in items])
    raw = lexical.segments(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), own.vocabulary, 200)
    n_docs, n_terms, df = lexical.statistics(raw)
    own.weigh(n_docs, df)
    segments = [lexical.Segment(row.asDict()) for row in lexical.with_bounds(raw, own, n_docs, n_terms).collect()]
    read = {}
    found = {}
    for paired in (True, False):
        best = [lexical.Best(20) for _ in own.items]
        read[paired] = sum(s.search(i, b, paired) for s in segments for i, b in zip(own.items, best))
        found[paired] = [(b.scores.tolist(), b.ids.tolist()) for b in best]
    everything = sum(len(s.lists[t][0]) for s in segments for i in own.items for t, _ in i.terms if t in s.lists)
    assert found[True] == found[False] and read[True] < 0.95 * read[False] < read[False] < everything
    for s in segments:  # no document gains more of a unit than its bound
        for i in own.items:
            for bound, unit in s.bounded(i):
                gain = np.zeros(len(s.ids), np.int64)
                for t, qw in unit:
                    gain[s.lists[t][0]] += qw * s.lists[t][1]
                assert gain.max() == bound


def test_long_texts_are_cut_between_terms():
    text = ("word" * 5000 + " a-b ") * 100
    assert {t.decode(): n for t, n in lexical.counted(text.encode()).items()} == Counter(terms(text))


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank(d, q).collect() == lexical.rank(d, some).collect() == lexical.rank(some.withColumnRenamed("item_id", "doc_id"), q).collect() == []
