"""Signals beyond the gate: unsupported claims, self-approval, contradictions, streaks, operating points and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import ratio
from .prefix import numbered, running

SCOPE = ["session_id", "agent_scope"]


def recent(rows: int) -> Window:
    return Window.partitionBy(*SCOPE).orderBy("seq").rowsBetween(-rows, -1)


def unsupported_claims(events: DataFrame, window: int = 8) -> DataFrame:
    """Claims (claim) without a verifying action (verified) that went well among the events before."""
    n = F.count(F.when(F.col("verified"), 1)).over(recent(window))
    return events.withColumn("checks", n).filter(F.col("claim") & (F.col("checks") == 0))


def self_approvals(writes: DataFrame, checks: DataFrame, within_ms: int = 15_000, critical_ms: int = 1_000) -> DataFrame:
    """session_id, write_uuid, check_uuid, gap_ms, severity of checks so soon after a write of evidence.

    Buckets of the interval's length make the range an equality join.
    """
    bucket = lambda ts: F.floor(ts / (within_ms + 1))
    w = writes.select("session_id", F.col("uuid").alias("write_uuid"), F.col("ts").alias("w")).withColumn("b", F.explode(F.array(bucket(F.col("w")), bucket(F.col("w")) + 1)))
    c = checks.select("session_id", F.col("uuid").alias("check_uuid"), F.col("ts").alias("c")).withColumn("b", bucket(F.col("c")))
    rows = w.join(c, ["session_id", "b"]).withColumn("gap_ms", F.col("c") - F.col("w")).filter(F.col("gap_ms").between(0, within_ms) & (F.col("write_uuid") != F.col("check_uuid")))
    return rows.select("session_id", "write_uuid", "check_uuid", "gap_ms", F.when(F.col("gap_ms") <= critical_ms, "critical").otherwise("warning").alias("severity"))


def contradictions(events: DataFrame, window: int = 5) -> DataFrame:
    """Claims with an error among the events before."""
    return events.withColumn("errors", F.count(F.when(F.col("result_class") == "error", 1)).over(recent(window))).filter(F.col("claim") & (F.col("errors") > 0))


def claim_ratio(events: DataFrame) -> DataFrame:
    """session_id, claims, checks, claims per check (null without checks)."""
    rows = events.groupBy("session_id").agg(F.count_if("claim").alias("claims"), F.count_if("verified").alias("checks"))
    return rows.withColumn("ratio", F.when(F.col("checks") > 0, F.col("claims") / F.col("checks")))


def streaks(events: DataFrame, same: Column) -> DataFrame:
    """session_id, first_seq, length of maximal runs of consecutive events for which ``same`` holds."""
    w = Window.partitionBy(*SCOPE).orderBy("seq")
    rows = events.withColumns({"n": F.row_number().over(w), "hit": same}).filter("hit")
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(w))
    return rows.groupBy(*SCOPE, "island").agg(F.min("seq").alias("first_seq"), F.count("*").alias("length")).drop("island", "agent_scope")


def region_streaks(edits: DataFrame) -> DataFrame:
    """Add streak: how many edits in a row, up to this one, were of the same path in the scope."""
    w = Window.partitionBy(*SCOPE).orderBy("seq")
    rows = edits.withColumn("new", F.coalesce((F.lag("file_path").over(w) != F.col("file_path")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return rows.withColumn("streak", F.row_number().over(Window.partitionBy(*SCOPE, "run").orderBy("seq"))).drop("new", "run")


def robust_vote(samples: DataFrame) -> DataFrame:
    """hit_id, kind, divergence (median), agreement, confidence (mean times agreement), subtype (mode), circular (any)."""
    best = samples.groupBy("hit_id", "kind").agg(F.count("*").alias("votes"), F.avg("confidence").alias("mean"))
    rank = F.when(F.col("kind") == "thrashing", 0).when(F.col("kind") == "false_success", 1).otherwise(2)
    won = best.withColumn("n", F.row_number().over(Window.partitionBy("hit_id").orderBy(F.desc("votes"), rank))).filter("n = 1")
    mode = samples.groupBy("hit_id", "subtype").count().withColumn("n", F.row_number().over(Window.partitionBy("hit_id").orderBy(F.desc("count"), "subtype"))).filter("n = 1").select("hit_id", "subtype")
    every = samples.groupBy("hit_id").agg(F.median("divergence").alias("divergence"), F.bool_or("circular").alias("circular"), F.count("*").alias("total"))
    rows = won.join(every, "hit_id").join(mode, "hit_id").withColumn("agreement", F.col("votes") / F.col("total"))
    return rows.select("hit_id", "kind", "divergence", "agreement", (F.col("mean") * F.col("agreement")).alias("confidence"), "subtype", "circular")


def roc(scores: DataFrame) -> DataFrame:
    """threshold, tpr, fpr, youden for each distinct score (predicted positive from it on).

    Scores are first counted by value; their running sums go by ranges.
    """
    by = scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    rows = running(by, {"tp": F.col("p"), "fp": F.col("q")}, [F.desc("score")])
    rows = rows.crossJoin(F.broadcast(by.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))))  # one row
    rows = rows.select(F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("all_p"), 0.0).alias("tpr"), ratio(F.col("fp"), F.col("all_q"), 0.0).alias("fpr"))
    return rows.withColumn("youden", F.col("tpr") - F.col("fpr"))


def auc(points: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids, from (0, 0), and the threshold with the greatest Youden index."""
    rows = numbered(points, "n", [F.desc("threshold")])
    before = rows.select((F.col("n") + 1).alias("n"), F.col("fpr").alias("x0"), F.col("tpr").alias("y0"))
    rows = rows.join(before, "n", "left").withColumn("area", (F.col("fpr") - F.coalesce("x0", F.lit(0.0))) * (F.col("tpr") + F.coalesce("y0", F.lit(0.0))) / 2)
    return rows.agg(F.sum("area").alias("auc"), F.max_by("threshold", F.struct("youden", "threshold")).alias("best_threshold"), F.max("youden").alias("best_youden"))


def intra_rater(labels: DataFrame) -> DataFrame:
    """gold (round 1) and pred (round 2) of targets that one labeler labelled twice."""
    key = ["labeler_id", "target"]
    one = labels.filter("label_round = 1").select(*key, F.col("expected_signal").alias("gold"))
    return one.join(labels.filter("label_round = 2").select(*key, F.col("expected_signal").alias("pred")), key)


def snapshots(events: DataFrame, anchors: DataFrame, n: int = 5) -> DataFrame:
    """session_id, uuid, context (the n texts before and the anchor's), first_user (the session's first user text)."""
    w = Window.partitionBy(*SCOPE).orderBy("seq")
    first = events.filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "seq").alias("first_user"))
    rows = events.withColumn("context", F.collect_list("text").over(w.rowsBetween(-n, 0)))
    return rows.join(anchors.select("session_id", "uuid"), ["session_id", "uuid"]).join(first, "session_id", "left").select("session_id", "uuid", "context", "first_user")


def within_budget(requests: DataFrame, calls: int = 50, cost: float | None = None) -> DataFrame:
    """Add deferred: requests beyond so many calls, or so much cost, of a session and day."""
    w = Window.partitionBy("session_id", "day").orderBy("ts", "id")
    over = F.row_number().over(w) > calls
    if cost is not None:
        over = over | (F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)) > cost)
    return requests.withColumn("deferred", over)


def redacted(text: Column, most: int = 500) -> Column:
    """Home folders are replaced by ~ and the text is cut for export."""
    return F.substring(F.regexp_replace(text, r"(/Users|/home)/[^/\s]+|[A-Za-z]:\\Users\\[^\\\s]+", "~"), 1, most)
