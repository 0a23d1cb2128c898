"""Sinks and maintenance of the engine's tables: idempotent appends, ledgers, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored


def new_rows(rows: DataFrame, target: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """The rows to append so that each key stays unique: the first of each key, without keys the target has."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
    return first if target is None else first.join(target.select(*key).distinct(), key, "left_anti")


def append_events(events: DataFrame, target: DataFrame | None, path: str | None = None) -> DataFrame:
    """Events that aren't stored yet; with a path they are appended there, by day of ingestion."""
    fresh = new_rows(events, target, ["uuid"], ["ingested_at", "byte_offset"])
    if path:
        fresh.withColumn("ingested_on", F.timestamp_millis("ingested_at").cast("date")).write.mode("append").partitionBy("ingested_on").parquet(path)
    return fresh


#: Parts of an event store, by hash of the uuid.
BUCKETS = 256


def append_to_store(events: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Append the events that a store (a folder of Parquet files by bucket) doesn't hold yet; gives those that were new.

    Only the buckets that new ids fall into are read, of these only the ids that may be among the new ones (Spark pushes a
    Bloom filter of them into a large scan), so a small batch costs little however large the store is. Spark's commit makes an
    append whole or absent, and a repeated one adds nothing. Give each store the same number of buckets each time.
    """
    spark = events.sparkSession
    fresh = new_rows(events, None, ["uuid"], ["ingested_at", "byte_offset"]).withColumn("bucket", F.pmod(F.xxhash64("uuid"), F.lit(buckets)).cast("int"))
    fresh = stored(fresh, "batch")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        wanted = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most the buckets
        held = held_ids(spark.read.schema(fresh.schema).parquet(path), wanted).join(fresh.select("bucket", "uuid"), ["bucket", "uuid"], "left_semi")
        fresh = stored(fresh.join(held, ["bucket", "uuid"], "left_anti").select(*fresh.columns), "new-events")
    fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return fresh.drop("bucket")


def held_ids(store: DataFrame, buckets: list[int]) -> DataFrame:
    return store.filter(F.col("bucket").isin(buckets)).select("bucket", "uuid")


def session_events(events: DataFrame, session_id: str) -> DataFrame:
    return events.filter(F.col("session_id") == session_id).orderBy("ts", "ingested_at")


def status(events: DataFrame, detections: DataFrame) -> DataFrame:
    """sessions, events, detections."""
    return events.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("events")).crossJoin(detections.agg(F.count("*").alias("detections")))  # one row each


def recent(detections: DataFrame, n: int = 5) -> DataFrame:
    """The n latest detections (a report)."""
    return detections.orderBy(F.desc("ts"), "session_id", "trigger_uuid").limit(n)


def label_key() -> Column:
    """What may be labelled once by a labeler in a round: the anchor, the span or the window."""
    kind = F.col("label_kind")
    return F.when(kind == "point", F.concat(F.lit("p:"), "anchor_uuid")).when(kind == "span", F.concat_ws(":", F.lit("s"), "start_uuid", "end_uuid")).otherwise(F.concat(F.lit("w:"), "window_id"))


def valid_label() -> Column:
    kind = F.col("label_kind")
    return F.when(kind == "point", F.col("anchor_uuid").isNotNull()).when(kind == "span", F.col("start_uuid").isNotNull() & F.col("end_uuid").isNotNull()).when(kind == "window", F.col("window_id").isNotNull()).otherwise(False)


def append_labels(labels: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Valid labels whose id and whose key by labeler and round are new."""
    rows = labels.filter(valid_label()).withColumn("label_key", label_key())
    rows = new_rows(rows, None, ["label_id"], ["labeled_at"])
    rows = new_rows(rows, None, ["labeler_id", "label_round", "label_key"], ["labeled_at", "label_id"])
    if target is not None:
        kept = target.withColumn("label_key", label_key())
        rows = rows.join(kept.select("label_id"), "label_id", "left_anti").join(kept.select("labeler_id", "label_round", "label_key"), ["labeler_id", "label_round", "label_key"], "left_anti")
    return rows.drop("label_key")


def read_labels(labels: DataFrame, session_id: str | None = None) -> DataFrame:
    return labels.orderBy("session_id", "labeled_at", "label_id") if session_id is None else labels.filter(F.col("session_id") == session_id).orderBy("labeled_at", "label_id")


def seed_labels(spark: SparkSession) -> DataFrame:
    """Five span labels that a new gold set starts from."""
    rows = [(f"seed-{k}", f"seed-session-{k}", "seed", "span", None, f"seed-{k}-a", f"seed-{k}-b", None, "false_success", "adapted", 1, k) for k in range(1, 6)]
    return spark.createDataFrame(rows, "label_id string, session_id string, labeler_id string, label_kind string, anchor_uuid string, start_uuid string, end_uuid string, window_id string, expected_signal string, source string, label_round int, labeled_at long")


def upsert_ledger(ledger: DataFrame, sent: DataFrame, window_ms: int) -> DataFrame:
    """The notification ledger after messages were sent: dedupe_key, last_sent_ts, send_count, cooldown_until."""
    new = sent.groupBy("dedupe_key").agg(F.max("ts").alias("new_ts"), F.count("*").alias("new_n"))
    both = ledger.select("dedupe_key", "last_sent_ts", "send_count").join(new, "dedupe_key", "full_outer")
    last = F.greatest("last_sent_ts", "new_ts")
    return both.select("dedupe_key", last.alias("last_sent_ts"), (F.coalesce("send_count", F.lit(0)) + F.coalesce("new_n", F.lit(0))).cast("long").alias("send_count"), (last + window_ms).alias("cooldown_until"))


def write_detections(detections: DataFrame, path: str) -> None:
    """Append detections, by kind."""
    detections.write.mode("append").partitionBy("kind").parquet(path)


def write_metrics(metrics: DataFrame, path: str, run_id: str, created_at: int) -> None:
    """Append the metrics of an evaluation run in the report's long form (section, row, metric, value), by run."""
    metrics.withColumns({"run_id": F.lit(run_id), "created_at": F.lit(created_at).cast("long")}).write.mode("append").partitionBy("run_id").parquet(path)


def active_configs(configs: DataFrame) -> DataFrame:
    """Versioned configurations; the latest is the active one."""
    latest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("version")))
    return configs.withColumn("is_active", latest == 1)


#: Sections of a report in their order.
SECTIONS = ["overall", "class", "calibration", "error"]


def report(sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One long table (place, section, row, metric, value to three decimals) of tables given with their name columns.

    place orders the sections: those of ``SECTIONS`` first, others after them as given. Sort by place, row and metric to print.
    """
    out = None
    places = [*SECTIONS, *[s for s in sections if s not in SECTIONS]]
    for name, (df, names) in sections.items():
        metrics = [c for c in df.columns if c not in names]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 3).alias("value")) for c in metrics])).alias("m")
        rows = df.select(F.lit(places.index(name)).alias("place"), F.lit(name).alias("section"), F.concat_ws("/", *names).alias("row"), pairs).select("place", "section", "row", "m.*")
        out = rows if out is None else out.unionByName(rows)
    return out
