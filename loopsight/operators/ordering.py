"""Order and thread structure of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .prefix import numbered

SCOPE = ["session_id", "agent_scope"]


def depths(events: DataFrame, same_ts: bool = False) -> DataFrame:
    """uuid, session_id, depth (ancestors within the session), cyclic, by pointer doubling.

    same_ts: count only consecutive ancestors with the event's own ts. An event on or below a cycle has a
    null depth. Each round doubles the distance looked back, so a thread of n records takes log2(n) rounds.
    """
    e = events.select("session_id", "uuid", "parent_uuid", "ts")
    parent = e.select("session_id", F.col("uuid").alias("parent_uuid"), F.col("ts").alias("parent_ts"))
    rows = e.join(parent, ["session_id", "parent_uuid"], "left")
    linked = F.col("parent_ts").isNotNull() & ((F.col("parent_ts") == F.col("ts")) if same_ts else F.lit(True))
    rows = rows.select("session_id", "uuid", F.when(linked, F.col("parent_uuid")).alias("up"), F.when(linked, 1).otherwise(0).cast("long").alias("dist"))
    longest = events.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest).bit_length() + 1):
        if not rows.filter("up is not null").limit(1).count():
            break
        above = rows.select("session_id", F.col("uuid").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"))
        rows = rows.join(above, ["session_id", "up"], "left").select("session_id", "uuid", F.col("next").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"))
        rows = stored(rows, "depths")  # else the plan would double each round
    return rows.select("session_id", "uuid", F.when(F.col("up").isNull(), F.col("dist")).alias("depth"), F.col("up").isNotNull().alias("cyclic"))


def causal_order(events: DataFrame) -> DataFrame:
    """Add seq (from 1): by ts, a parent before its child among equal ts, then by offset and uuid."""
    found = events.join(depths(events, same_ts=True).withColumnsRenamed({"depth": "ts_depth"}).drop("cyclic"), ["session_id", "uuid"], "left")
    order = Window.partitionBy(*SCOPE).orderBy("ts", F.col("ts_depth").asc_nulls_last(), "byte_offset", "uuid")
    return found.withColumn("seq", F.row_number().over(order).cast("long")).drop("ts_depth")


#: Events of a session that one task sorts; larger sessions are ordered by rank refinement.
SORTED = 1_000_000


def topological_order(events: DataFrame, in_task: int = SORTED) -> DataFrame:
    """session_id, uuid, position (from 0): level by level from the roots, siblings by their parents' order, then offset.

    Events on or below a cycle come last, by offset. A session is sorted by one task if it has up to in_task events, else it
    is spread over all (``by_refinement``), with the same result.
    """
    e = events.select("session_id", "uuid", "parent_uuid", "byte_offset")
    large = stored(e.groupBy(F.col("session_id").alias("__large")).count().filter(F.col("count") > in_task).select("__large"), "large-sessions")
    if large.isEmpty():
        return _sorted_in_tasks(e)
    mine = F.col("session_id") == F.col("__large")
    return _sorted_in_tasks(e.join(large, mine, "left_anti")).unionByName(by_refinement(e.join(large, mine, "left_semi")))


def by_refinement(events: DataFrame) -> DataFrame:
    """``topological_order`` without a session in one task.

    An event's place among those of its depth is that of the path of offsets from its root. Ranks begin with an event's own
    offset and are refined by doubling: an event's path of twice the length is the pair of the rank of its ancestor and its
    own one, and pairs are numbered anew by sorted ranges. There are as many rounds as the logarithm of the depth.
    """
    e = stored(events, "events")
    found = depths(e.withColumn("ts", F.lit(0)))
    rows = numbered(e, "rank", ["byte_offset", "uuid"], ["session_id"]).join(found, ["session_id", "uuid"])
    last = stored(rows.filter("cyclic").select("session_id", "uuid", "rank"), "cyclic")
    known = e.select("session_id", F.col("uuid").alias("parent_uuid"), F.lit(True).alias("known"))
    rows = rows.filter("not cyclic").join(known, ["session_id", "parent_uuid"], "left").select("session_id", "uuid", "depth", "rank", F.when(F.col("known"), F.col("parent_uuid")).alias("up"))
    rows = stored(rows, "ranks")
    while not rows.filter("up is not null").isEmpty():
        above = rows.select("session_id", F.col("uuid").alias("up"), F.col("rank").alias("before"), F.col("up").alias("next"))
        pairs = rows.join(above, ["session_id", "up"], "left").select("session_id", "uuid", "depth", F.coalesce("before", F.lit(0)).alias("before"), F.col("rank").alias("own"), F.col("next").alias("up"))
        rows = stored(numbered(pairs, "rank", ["depth", "before", "own"], ["session_id"]).select("session_id", "uuid", "depth", "rank", "up"), "ranks")
    both = rows.select("session_id", "uuid", F.lit(False).alias("cyclic"), "depth", "rank").unionByName(last.select("session_id", "uuid", F.lit(True).alias("cyclic"), F.lit(0).cast("long").alias("depth"), "rank"))
    return numbered(both, "n", ["cyclic", "depth", "rank"], ["session_id"]).select("session_id", "uuid", (F.col("n") - 1).alias("position"))


def _sorted_in_tasks(events: DataFrame) -> DataFrame:
    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["byte_offset", "uuid"])
        known = set(pdf["uuid"])
        children: dict = {}
        queue = []
        for u, p in zip(pdf["uuid"], pdf["parent_uuid"]):
            if p is None or pd.isna(p) or p not in known:
                queue.append(u)
            else:
                children.setdefault(p, []).append(u)
        for u in queue:
            queue += children.get(u, [])
        done = set(queue)
        queue += [u for u in pdf["uuid"] if u not in done]
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "uuid": queue, "position": range(len(queue))})

    return events.select("session_id", "uuid", "parent_uuid", "byte_offset").groupBy("session_id").applyInPandas(sort, "session_id string, uuid string, position long")


def orphans(events: DataFrame) -> DataFrame:
    """Add is_orphan: the event names a parent that its session doesn't have."""
    parents = events.select("session_id", F.col("uuid").alias("parent_uuid")).distinct().withColumn("__found", F.lit(True))
    found = events.join(parents, ["session_id", "parent_uuid"], "left")
    return found.withColumn("is_orphan", F.col("parent_uuid").isNotNull() & F.col("__found").isNull()).drop("__found")


def offset_sort(events: DataFrame) -> DataFrame:
    return events.orderBy("byte_offset")
