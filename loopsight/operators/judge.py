"""Judge data jobs: which hits are judged, the request table, and the vote over returned samples.

The remote call is not made here: requests leave as a table, and samples come back as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The rubric's points, in order.
RUBRIC = ["F1 same action repeated without a new result", "F2 same error met again without a change of approach", "F3 same region of a file edited back and forth", "F4 completion claimed without a verifying action", "F5 own statement taken as its proof"]


def to_judge(hits: DataFrame) -> DataFrame:
    """Hits that passed the gate and whose similarity is strong; no other is worth a call."""
    return hits.filter(F.col("gate_passed") & F.col("strong"))


def requests(hits: DataFrame, model: str) -> DataFrame:
    """hit_id, system, prompt, cache_key."""
    system = F.lit("Judge whether the session below is stuck.\n" + "\n".join(f"- {r}" for r in RUBRIC))
    prompt = F.format_string("type: %s\nsubtype: %s\nseverity: %s\nmax cosine: %.3f\ncandidate: %s", "type", "subtype", "severity", "max_cosine", "text")
    return hits.select("hit_id", system.alias("system"), prompt.alias("prompt")).withColumn("cache_key", F.concat(F.sha2(F.concat("system", F.lit("\n"), "prompt"), 256), F.lit(f":{model}")))


def swapped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("position", F.explode(F.array(F.lit("orig"), F.lit("swap"))))


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """Each request n times, with sample_no from 1; none for n below 1."""
    return rows.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.lit(n)) if n >= 1 else F.array().cast("array<int>")))


def look_up(rows: DataFrame, samples: DataFrame) -> DataFrame:
    keys = ["cache_key", *[c for c in ("position", "sample_no") if c in rows.columns and c in samples.columns]]
    return rows.join(samples.select(*keys, "raw"), keys, "left").withColumn("missing", F.col("raw").isNull())


def validated(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Add kind, subtype, confidence, reason and error_tag (empty_input, invalid_json, schema_mismatch or null)."""
    body = F.trim(F.regexp_replace(F.trim(F.col(raw)), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    j = lambda name: F.get_json_object(body, f"$.{name}")
    unit = lambda c: c.try_cast("double").between(0, 1)
    optional = lambda name: j(name).isNull() | F.coalesce(unit(j(name)), F.lit(False))
    ok = j("kind").isin("thrashing", "false_success", "none") & F.coalesce(unit(j("confidence")), F.lit(False)) & j("reason").isNotNull() & optional("topicDivergence") & optional("circularReference")
    tag = F.when(F.col(raw).isNull() | (F.trim(F.col(raw)) == ""), "empty_input").when(F.try_parse_json(body).isNull(), "invalid_json").when(~F.coalesce(ok, F.lit(False)), "schema_mismatch")
    good = tag.isNull()
    return rows.withColumns({"error_tag": tag, "kind": F.when(good, j("kind")), "subtype": F.when(good, F.coalesce(j("subtype"), F.lit(""))), "confidence": F.when(good, j("confidence").try_cast("double")), "reason": F.when(good, j("reason"))})


def priority(kind: Column) -> Column:
    return F.when(kind == "thrashing", 0).when(kind == "false_success", 1).otherwise(2)


def majority(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """hit_id, kind, votes, confidence, subtype, reason; a hit without valid samples is none with confidence 0."""
    by_kind = samples.filter(F.col("kind").isNotNull()).groupBy("hit_id", "kind").agg(F.count("*").alias("votes"), F.avg("confidence").alias("confidence"), F.min_by("subtype", "sample_no").alias("subtype"), F.min_by("reason", "sample_no").alias("reason"))
    best = F.row_number().over(Window.partitionBy("hit_id").orderBy(F.desc("votes"), priority(F.col("kind"))))
    won = by_kind.withColumn("n", best).filter("n = 1").drop("n")
    rows = hits.select("hit_id").join(won, "hit_id", "left")
    return rows.select("hit_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("subtype", F.lit("")).alias("subtype"), F.coalesce("reason", F.lit("")).alias("reason"))


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k + 1, r) for k, r in enumerate(RUBRIC)], "point int, text string")
