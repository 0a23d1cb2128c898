"""Semantic confirmation of hits: triples behind a hit, their embeddings and pairwise cosines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import DEFAULTS, Thresholds
from ..functions.measures import cosine


def hit_triples(hits: DataFrame, actions: DataFrame, keep_empty: bool = True) -> DataFrame:
    """hit_id, pos, uuid, tool, arg_key, result_class of the actions a hit refers to, in order.

    References that are no known action are dropped; a hit left without any keeps one row of nulls, unless told not to.
    """
    refs = hits.select("hit_id", F.posexplode_outer("window_refs").alias("pos", "uuid"))
    found = refs.join(actions.select("uuid", "tool", "arg_key", "result_class"), "uuid").select("hit_id", "pos", "uuid", "tool", "arg_key", "result_class")
    return hits.select("hit_id").join(found, "hit_id", "left") if keep_empty else found


def rendered(triples: DataFrame) -> DataFrame:
    return triples.withColumn("text", F.concat_ws(" ", "tool", "arg_key"))


def cache_key(text: Column, model: str) -> Column:
    return F.concat(F.sha2(text, 256), F.lit(f":{model}"))


def look_up(rows: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Add vector of the row's text and missing. Each distinct text is looked up once."""
    keyed = rows.withColumn("cache_key", cache_key(F.col("text"), model))
    wanted = keyed.select("cache_key").distinct().join(embeddings.select("cache_key", "vector"), "cache_key", "left")
    return keyed.join(wanted, "cache_key", "left").withColumn("missing", F.col("vector").isNull())


def pairs(rows: DataFrame, group: str, order: str, vector: str = "vector") -> DataFrame:
    """group, a, b, cos of all pairs a < b (by order) in a group; groups are hits, whose size the window bounds."""
    left = rows.select(group, F.col(order).alias("a"), F.col(vector).alias("va"))
    right = rows.select(group, F.col(order).alias("b"), F.col(vector).alias("vb"))
    return left.join(right, group).filter("a < b").select(group, "a", "b", cosine(F.col("va"), F.col("vb")).alias("cos"))


def max_cosine(groups: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """group, max_cosine (0 without pairs), pairs of every group."""
    best = found.groupBy(group).agg(F.max("cos").alias("best"), F.array_sort(F.collect_list(F.struct("a", "b", "cos"))).alias("pairs"))
    return groups.select(group).distinct().join(best, group, "left").select(group, F.coalesce("best", F.lit(0.0)).alias("max_cosine"), F.coalesce("pairs", F.array().cast("array<struct<a:int,b:int,cos:double>>")).alias("pairs"))


def signals(found: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Add strong: whether the greatest cosine reaches the threshold."""
    return found.withColumn("strong", F.col("max_cosine") >= t.similar)


#: Queries that are held by a task at once.
QUERIES = 5_000


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, cos: the k most similar vectors of the same model for each stated query.

    Each task goes through its vectors in blocks and keeps the k best of each query, so k rows a query and task are
    shuffled. Queries go to the tasks in blocks. Ties go to the smaller vec_id; a zero vector has cosine 0, as in ``cosine``;
    vectors of another length than the query's, or null, take no part.
    """
    wanted = queries.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("model").cast("string").alias("model"))
    blocks = max(1, -(-wanted.count() // block))
    rows = vectors.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("model").cast("string").alias("model"))
    out = None
    for b in range(blocks):
        own = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("vec_id", "model"), F.lit(blocks)) == b)
        found = rows.mapInArrow(_nearest(own.collect(), k), "query_id long, model string, vec_id long, cos double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id", "model").orderBy(F.desc("cos"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cos")


def _nearest(asked: list, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    groups: dict[tuple, list] = {}
    for q in asked:
        groups.setdefault((q["model"], len(q["embedding"])), []).append((q["vec_id"], q["embedding"]))

    def unit(rows: list) -> np.ndarray:
        x = np.array(rows, np.float64)
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {g: (np.array([i for i, _ in q]), unit([v for _, v in q]), np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)) for g, q in groups.items()}
        for batch in batches:
            own: dict[tuple, list] = {}
            for i, v, m in zip(*(c.to_pylist() for c in batch.columns)):
                if (m, len(v)) in held:
                    own.setdefault((m, len(v)), []).append((i, v))
            for g, found in own.items():
                names, q, best, ids = held[g]
                new = np.array([i for i, _ in found])
                cos = np.clip(q @ unit([v for _, v in found]).T, -1, 1)
                cos[names[:, None] == new[None, :]] = -np.inf  # not the query itself
                cos, new = np.hstack([best, cos]), np.hstack([ids, np.broadcast_to(new, (len(q), len(new)))])
                order = np.lexsort((new, -cos), axis=1)[:, :k]
                held[g] = (names, q, np.take_along_axis(cos, order, 1), np.take_along_axis(new, order, 1))
        for (model, _), (names, _, best, ids) in held.items():
            real = np.isfinite(best)
            at = np.nonzero(real)[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array([model] * len(at), pa.string()), pa.array(ids[real]), pa.array(best[real])], names=["query_id", "model", "vec_id", "cos"])

    return run
