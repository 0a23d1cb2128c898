import heapq

import numpy as np
import pyarrow as pa
import pytest

from loopsight.llm import ann


def brute(x, ids, q, k):
    s = (x * x[q]).sum(axis=1)
    own = [j for j in range(len(x)) if ids[j] != ids[q]]
    return [(ids[j], s[j]) for j in heapq.nsmallest(k, own, key=lambda j: (-s[j], ids[j]))]


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 8))
    x[100:300] = x[100]  # one very common vector: ties
    return x, spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_recall_order_and_ties(vectors, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    x, df = vectors
    x = x.astype(np.float32).astype(float)
    found = {}
    for r in ann.search(df, every=20, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 800, 20))
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [n for n, _, _ in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1])) and all(abs(s - float((x[v] * x[q]).sum())) < 1e-12 for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in brute(x, range(800), q, 20)})
    assert hits >= 0.9 * 20 * len(found)
    tied = [v for _, v, _ in found[100]]
    assert tied[:19] == list(range(101, 120))


def test_all_candidates_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.filter("vec_id = 4")).count() == 0


def looked_at(df, n, dim):
    rows = ann.usable(df, dim)
    model = ann.fit(rows, n, dim)
    index = ann.assigned(rows, model, dim)
    counts = np.zeros(len(model.first) * len(model.second), np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    return ann.needed(index, model, counts, 20)


def recall(spark, x, every):
    n, dim = x.shape
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float64()))})
    df = spark.createDataFrame(table)
    least, found = looked_at(df, n, dim), {}
    for row in ann.search(df, every=every, k=20, least=least).collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    assert sorted(found) == list(range(0, n, every)) and all(len(f) == 20 for f in found.values())
    hits = 0
    for q in found:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    return hits / (20 * len(found)), least


def test_recall_where_a_part_of_the_vectors_is_looked_at(spark):
    """Clustered vectors, more than any least number: entries looked at grow far slower than the table, recall stays."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 24))
    looked = {}
    for n in (3000, 12_000):
        share, looked[n] = recall(spark, (centres[r.integers(0, 60, n)] + 0.25 * r.normal(size=(n, 24))), 60)
        assert share >= 0.9
    assert looked[3000] < 1000 and looked[12_000] < 3000


@pytest.mark.parametrize("n", [50_000, 200_000])
def test_recall_beyond_the_sample(spark, n):
    """Random directions, the hardest case, in 2.5 and 10 times as many rows as the centroids are learned from."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    share, least = recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True), n // 150)
    print(f"{n} rows: {least} looked at, recall {share:.3f}")
    assert share >= 0.9 and least < 0.6 * n


def test_a_query_whose_id_fills_its_cells_still_finds_others(spark):
    r = np.random.default_rng(5)
    rows = [(0, (np.ones(4) + 1e-3 * r.normal(size=4)).tolist()) for _ in range(300)] + [(k, r.normal(size=4).tolist()) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, every=1000, k=20, least=21).collect()
    assert {x["query_id"] for x in found} == {0} and len({x["vec_id"] for x in found}) == len(found) == 20 and 0 not in {x["vec_id"] for x in found}


@pytest.mark.parametrize("dim", [1, 3, 7])
def test_odd_dimensions_repeated_ids_and_blocks(spark, monkeypatch, dim):
    """Small tables are searched whole: results equal brute force, whatever the blocks."""
    monkeypatch.setattr(ann, "BLOCK", 8)
    r = np.random.default_rng(dim)
    x = r.integers(1, 4, (60, dim)).astype(float)
    ids = [k // 2 if k < 20 else k for k in range(60)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found = {}
    for row in ann.search(df, every=20, k=5).collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    for q, rows in found.items():
        own = min((j for j in range(60) if ids[j] == q), key=lambda j: x[j].tolist())  # a repeated id asks with its least vector
        want = [(k + 1, i, s) for k, (i, s) in enumerate(brute(x, ids, own, 5))]
        assert sorted(rows) == want
    assert set(found) == {0, 20, 40}


def test_traversal_is_by_decreasing_sum():
    r = np.random.default_rng(2)
    a, b, counts = r.normal(size=9), r.normal(size=7), r.integers(0, 3, (9, 7))
    cells = ann.traverse(a, b, counts.tolist(), int(counts.sum()))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums, reverse=True) and len(cells) == (counts > 0).sum()
