"""One verdict for each hit, from the stages that looked at it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import DEFAULTS, Thresholds


def merge_stages(hits: DataFrame, embedded: DataFrame, judged: DataFrame, t: Thresholds = DEFAULTS, strong_only: bool = False) -> DataFrame:
    """A record for each hit: its gate fields, max_cosine and embed_error, and the judge's fields (j_*), where there are any."""
    e = embedded.select("hit_id", "max_cosine", "embed_error")
    if strong_only:
        e = e.filter((F.col("max_cosine") >= t.similar) | F.col("embed_error"))
    j = judged.select("hit_id", F.col("kind").alias("j_kind"), F.col("subtype").alias("j_subtype"), F.col("confidence").alias("j_confidence"), F.col("reason").alias("j_reason"), "judge_error")
    return hits.join(e, "hit_id", "left").join(j, "hit_id", "left").withColumns({"embed_error": F.coalesce("embed_error", F.lit(False)), "judge_error": F.coalesce("judge_error", F.lit(False))})


def degraded(severity: Column) -> Column:
    """Confidence of a structural verdict whose embeddings are lost."""
    return F.when(severity == "critical", 0.9).otherwise(0.75)


def resolve(records: DataFrame) -> DataFrame:
    """Add final (pipeline: a failed judge leaves the gate's kind) and final_strict (a failed judge makes it none).

    Records without embeddings keep a structural verdict only if they are of type thrashing.
    """
    rows = records.filter(~F.col("embed_error") | (F.col("type") == "thrashing"))
    judged = F.col("j_kind").isNotNull() & ~F.col("judge_error")
    verdict = lambda kind, subtype, confidence, stage: F.struct(kind.alias("kind"), subtype.alias("subtype"), confidence.cast("double").alias("confidence"), F.lit(stage).alias("stage"))
    by_judge = verdict(F.col("j_kind"), F.col("j_subtype"), F.col("j_confidence"), "judge")
    by_cosine = verdict(F.col("type"), F.col("subtype"), F.col("max_cosine"), "embed")
    by_gate = verdict(F.col("type"), F.col("subtype"), F.lit(0.0), "gate")
    final = F.when(F.col("embed_error"), verdict(F.col("type"), F.col("subtype"), degraded(F.col("severity")), "degraded")).when(judged, by_judge).when(F.col("max_cosine").isNotNull(), by_cosine).otherwise(by_gate)
    strict = F.when(F.col("judge_error"), verdict(F.lit("none"), F.lit("inconclusive"), F.lit(0.0), "judge")).when(judged, by_judge).when(F.col("max_cosine").isNotNull(), by_cosine).otherwise(by_gate)
    return rows.withColumns({"final": final, "final_strict": strict})


def evidence(records: DataFrame, actions: DataFrame) -> DataFrame:
    """hit_id, structural_n (counts of the metrics), structural_n_compat (sum of all metrics), items (label, idx, uuid, ts)."""
    counts = F.map_filter("metrics", lambda k, _: k != "maxJaccard")
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    refs = records.select("hit_id", F.size("window_refs").alias("n"), F.posexplode("window_refs").alias("idx", "uuid"))
    rows = refs.join(actions.select("uuid", "ts"), "uuid", "left")
    items = rows.groupBy("hit_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws("/", (F.col("idx") + 1).cast("string"), F.col("n").cast("string")).alias("label"), "uuid", "ts"))).alias("items"))
    return records.select("hit_id", total(counts).alias("structural_n"), total(F.col("metrics")).alias("structural_n_compat")).join(items, "hit_id", "left")
