"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into halves, each quantised by its own centroids (k-means on a bounded sample); a vector's cell
is its pair of centroids. The centroids of a half grow with the root of the number of vectors up to a bound (beyond it cells hold
more), so that the table of cells can go to all tasks. A query walks the pairs by decreasing sum of inner products with a heap,
until the cells reached hold as many entries as the wanted recall needs, and these are reranked by their exact inner product.
How many that are is measured on the whole table: a bounded number of queries is searched exactly among all vectors, and
the entries that lie before their true neighbours are counted with the real cells. For vectors without structure that is a
large share of the table, for clustered ones a small one.

The index is cut into blocks of bounded size, so that no task holds a hot cell whole; the queries of a block are streamed past it.

Edge cases: vectors of one dimension have an empty first half; vectors that are null, of another length than most, zero, or hold null or non-finite
components take no part; rows of null id take no part; ties go to the smaller id; repeated ids are entries of their own; such an
id asks once, with the least of its vectors, and looks at so many more entries as it has rows; with fewer candidates than asked for all are given; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Vectors of the training sample at most (those with the least hash of their id), and their bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Centroids of a half at most (its square bounds the table of cells); otherwise half the root of the number of vectors.
MOST = 1024
#: Share of true neighbours that the measured queries must find, and the number of these queries.
RECALL, QUERIES = 0.95, 300
#: Vectors of a block, and rows of results that a task holds.
BLOCK, HELD = 2048, 2_000_000


@dataclass
class MultiIndex:
    """Centroids of both halves."""

    first: np.ndarray
    second: np.ndarray


def _k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(1).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        order = np.argsort(own, kind="stable")
        held, begin = np.unique(own[order], return_index=True)
        c[held] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.append(begin, len(x)))[:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") == dim) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of the vectors (0 if there are none)."""
    row = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def traverse(first: np.ndarray, second: np.ndarray, counts: list[list[int]], least: int) -> list[tuple[int, int]]:
    """Cells by decreasing first[i] + second[j], with a heap, until they hold ``least`` entries."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    f, s = first[a].tolist(), second[b].tolist()
    heap, out, held = [(-f[0] - s[0], 0, 0)], [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        n = counts[a[i]][b[j]]
        if n:
            out.append((a[i], b[j]))
            held += n
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-f[i + 1] - s[0], i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (-f[i] - s[j + 1], i, j + 1))
    return out


def fit(rows: DataFrame, total: int, dim: int) -> MultiIndex:
    """Centroids from the sample."""
    size = max(200, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = rows.withColumn("h", F.xxhash64("vec_id", F.lit(3))).orderBy("h", "vec_id").limit(size).select("v").toArrow().column(0).combine_chunks()
    x = sample.flatten().to_numpy().reshape(-1, dim)
    half, k_means = dim // 2, min(MOST, max(1, round(total**0.5 / 2)))
    return MultiIndex(_k_means(x[:, :half], k_means), _k_means(x[:, half:], k_means))


def assigned(rows: DataFrame, model: MultiIndex, dim: int) -> DataFrame:
    """vec_id, v and cell of each vector."""
    shared, half = rows.sparkSession.sparkContext.broadcast(model), dim // 2  # MOST pairs of half vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).values.to_numpy()).reshape(-1, dim)
                cells = _nearest(x[:, :half], m.first) * len(m.second) + _nearest(x[:, half:], m.second)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int32())], names=["vec_id", "v", "cell"])

    return rows.mapInArrow(assign, "vec_id long, v array<double>, cell int")


def needed(index: DataFrame, model: MultiIndex, counts: np.ndarray, k: int, recall: float = RECALL, queries: int = QUERIES) -> int:
    """Entries to look at so that queries find that share of their true neighbours, from an exact search of some among all vectors.

    counts: entries of each cell. ``queries`` vectors (those with the least hash) go to the driver and all tasks.
    """
    asked = index.withColumn("h", F.xxhash64("vec_id", F.lit(7))).orderBy("h", "vec_id").limit(queries).select("vec_id", "v").collect()
    ids, q = np.array([r[0] for r in asked]), np.array([r[1] for r in asked])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cells = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        for batch in batches:
            if batch.num_rows:
                new, x = batch.column(0).to_numpy(), np.array(batch.column(1).values.to_numpy()).reshape(-1, q.shape[1])
                s = q @ x.T
                s[ids[:, None] == new[None, :]] = -np.inf
                s, c = np.hstack([best, s]), np.hstack([cells, np.broadcast_to(batch.column(2).to_numpy(), (len(q), len(new)))])
                order = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                best, cells = np.take_along_axis(s, order, 1), np.take_along_axis(c, order, 1)
        at, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(best[np.isfinite(best)], pa.float64()), pa.array(cells[np.isfinite(best)], pa.int32())], names=["q", "s", "cell"])

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "cell"))
    near = index.mapInArrow(exact, "q int, s double, cell int").withColumn("n", place).filter(F.col("n") <= k).groupBy("q").agg(F.collect_list("cell").alias("cells")).collect()
    half, found = model.first.shape[1], []
    for r in near:
        v = q[r["q"]]
        order = np.argsort(-((model.first @ v[:half])[:, None] + (model.second @ v[half:])[None, :]).ravel(), kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(counts[order])
        found += before[r["cells"]].tolist()
    return int(np.ceil(np.quantile(found, recall))) if found else 0


def search(vectors: DataFrame, every: int = 20, k: int = 20, least: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by ``every``.

    least: entries that a query looks at; measured if it isn't given.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    dim = dimension(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialise(usable(vectors, dim), "vectors") if dim else None
    total = rows.count() if dim else 0
    if not total:
        return spark.createDataFrame([], schema)
    model = fit(rows, total, dim)
    half, columns = dim // 2, len(model.second)
    index = materialise(assigned(rows, model, dim), "index")
    counts = np.zeros(len(model.first) * columns, np.int64)
    for r in index.groupBy("cell").count().collect():  # MOST squared rows at most
        counts[r["cell"]] = r["count"]
    # Cells lie in a row that is cut into blocks of about BLOCK entries; a large cell spans several.
    ends = np.cumsum(counts)
    low = (ends - counts) // BLOCK
    high = np.maximum(low, (ends - 1) // BLOCK)
    least = min(total, needed(index, model, counts, k) if least is None else least)
    placed = spark.sparkContext.broadcast((model, counts.reshape(len(model.first), columns), low, high))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table, low, high = placed.value
        table = table.tolist()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32())]
        for batch in batches:
            out: list[tuple] = []
            for q, v, own in zip(*(c.to_pylist() for c in batch.columns)):
                x, by_block = np.array(v), {}
                for i, j in traverse(m.first @ x[:half], m.second @ x[half:], table, max(least, k + own)):
                    cell = i * columns + j
                    for b in range(low[cell], high[cell] + 1):
                        by_block.setdefault(b, []).append(cell)
                out += [(b, q, v, cells) for b, cells in by_block.items()]
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["block", "id", "v", "cells"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["block", "id", "v", "cells"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, low, high = placed.value
        for batch in batches:
            cells, spread = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            block = low[cells] + spread % (high[cells] - low[cells] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *batch.columns[:3]], names=["block", "id", "v", "cell"])

    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # With a number and a key of its own, so that small vectors, which ask for much work, don't end in one task.
    queries = queries.repartition(parts, F.xxhash64("vec_id")).mapInArrow(route, "block long, id long, v array<double>, cells array<int>")
    # A cell's entries are dealt to its blocks in turn, whatever their ids.
    entries = index.withColumn("spread", F.monotonically_increasing_id()).mapInArrow(deal, "block long, id long, v array<double>, cell int")
    both = entries.select("block", F.lit(0).alias("asks"), "id", "v", F.array("cell").alias("cells")).unionByName(queries.withColumn("asks", F.lit(1)))
    both = both.repartition("block").sortWithinPartitions("block", "asks")
    near = both.mapInArrow(_reranked(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first(rows: list[tuple], k: int) -> list[np.ndarray]:
    """The k best of each query among (query, vec_id, score) arrays."""
    q, i, s = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return [c[place < k] for c in (q, i, s)]


def _reranked(k: int):
    """A block's entries come first and are held; its queries are streamed past them, and keep k of them each.

    What a query keeps of the task's blocks is brought down to k, as long as that fits in ``HELD`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held, out, size = None, [], None, [], 0

        def given(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in rows], names=["query_id", "vec_id", "score"])

        for batch in batches:
            blocks, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, parts, held = blocks[a], [], None
                x = np.array(some.column(3).flatten().to_numpy()).reshape(b - a, -1)
                if not asks[a]:
                    parts.append((some.column(2).to_numpy(), x, some.column(4).flatten().to_numpy()))
                    continue
                if held is None and parts:
                    held = [np.concatenate(p) for p in zip(*parts)]
                if held:
                    found = list(_best_of(some.column(2).to_numpy(), x, some.column(4).to_pylist(), *held, k))
                    out, size = out + found, size + sum(len(f[0]) for f in found)
                if size > HELD:
                    out = [_first(out, k)]
                    size = len(out[0][0])
                    if size > HELD // 2:
                        yield from given(out[0])
                        out, size = [], 0
        if out:
            yield from given(_first(out, k))

    return run


def _best_of(queries: np.ndarray, q: np.ndarray, cells: list[list[int]], ids: np.ndarray, x: np.ndarray, cell: np.ndarray, k: int) -> Iterator[tuple]:
    own, local = np.unique(cell, return_inverse=True)
    for a in range(0, len(q), 256):
        sums, out = q[a : a + 256] @ x.T, []
        for r in range(len(sums)):
            at = np.flatnonzero(np.isin(own, cells[a + r])[local] & (ids != queries[a + r]))
            if len(at) > k:
                # Ties are within rounding: all of them stay until the sums are taken in one fixed order.
                edge = np.partition(sums[r, at], len(at) - k)[len(at) - k] - 1e-9 * (1 + abs(sums[r, at]).max())
                at = at[sums[r, at] >= edge]
            exact = (x[at] * q[a + r]).sum(axis=1)
            best = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(best), queries[a + r]), ids[at][best], exact[best]))
        yield tuple(np.concatenate(c) for c in zip(*out))
