"""Routing of verdicts to notifications: thresholds, debounce, payloads and channels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.config import DEFAULTS, Thresholds
from ..sources.scratch import stored
from .prefix import numbered, running


def passes(kind: Column, confidence: Column, t: Thresholds = DEFAULTS) -> Column:
    return (kind != "none") & (confidence >= t.decide)


def dedupe_key(kind: Column | None = None) -> Column:
    return F.concat(F.col("session_id"), F.lit("␟"), F.col("kind") if kind is None else kind)


#: Messages of a key that one task streams; keys of more are resolved by doubling.
STREAMED = 1_000_000


def debounced(rows: DataFrame, t: Thresholds = DEFAULTS, key: str = "dedupe_key", window_ms: int | None = None, streamed: int = STREAMED) -> DataFrame:
    """Add sent: a message passes if its key's last *sent* one is at least the window ago; a window of 0 or less lets all pass.

    Ties of one time are decided by id. The messages of a key are streamed in order with the time last sent; a key of more
    than ``streamed`` messages is spread over all tasks instead (``by_doubling``), with the same result.
    """
    window_ms = t.debounce_ms if window_ms is None else window_ms
    if window_ms <= 0:
        return rows.withColumn("sent", F.lit(True))
    hot = rows.groupBy(F.col(key).alias("__hot")).count().filter(F.col("count") > streamed).select("__hot")
    hot = stored(hot, "hot-keys")
    if hot.isEmpty():
        return _streamed(rows, key, window_ms)
    mine = F.col(key).eqNullSafe(F.col("__hot"))
    return _streamed(rows.join(hot, mine, "left_anti"), key, window_ms).unionByName(by_doubling(rows.join(hot, mine, "left_semi"), key, window_ms))


def _streamed(rows: DataFrame, key: str, window_ms: int) -> DataFrame:
    cut = rows.withColumn("__key", F.col(key)).repartition("__key").sortWithinPartitions("__key", "ts", "id")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            sent = []
            for k, ts in zip(*(batch.column(batch.schema.get_field_index(c)).cast(kind).to_pylist() for c, kind in (("__key", pa.string()), ("ts", pa.int64())))):
                if (k,) != current:
                    current, last = (k,), None
                sent.append(last is None or ts - last >= window_ms)
                last = ts if sent[-1] else last
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sent, pa.bool_())], names=[*names, "sent"])

    return cut.mapInArrow(run, T.StructType([*[f for f in cut.schema.fields if f.name in names], T.StructField("sent", T.BooleanType())]))


def by_doubling(rows: DataFrame, key: str, window_ms: int) -> DataFrame:
    """``debounced`` without any key in one task.

    A sent message is followed by the first one at least the window later. Its number is one more than that of the messages
    before ts + window, a running count over sorted ranges. Sent are the messages that this link reaches from a key's
    first one, or from one that comes at least the window after the one before it, which is sent in any case. Links are doubled
    each round, so there are as many rounds as the logarithm of the longest chain between such messages.
    """
    base = stored(numbered(rows, "__pos", ["ts", "id"], [key]), "numbered")
    at = base.select(F.col(key).alias("k"), F.col("__pos").alias("pos"), "ts")
    both = at.select("k", "pos", "ts", F.lit(1).cast("long").alias("is_message")).unionByName(at.select("k", "pos", (F.col("ts") + window_ms).alias("ts"), F.lit(0).cast("long").alias("is_message")))
    links = running(both, {"before": F.col("is_message")}, ["ts", "is_message", "pos"], ["k"]).filter("is_message = 0").select("k", "pos", (F.col("before") + 1).alias("next"))
    links = stored(links, "links")
    marked = stored(links.filter("pos = 1").select("k", "pos").unionByName(links.filter("next = pos + 1").select("k", F.col("next").alias("pos"))).distinct(), "sent")
    same = lambda a, b, x, y: a["k"].eqNullSafe(b["k"]) & (a[x] == b[y])
    while True:
        found = marked.alias("m").join(links, same(marked, links, "pos", "pos")).select(links["k"], links["next"].alias("pos")).distinct()
        new = stored(found.join(marked, same(found, marked, "pos", "pos"), "left_anti"), "reached")
        if new.isEmpty():
            break
        marked = stored(marked.unionByName(new), "sent")
        far = links.select(F.col("k").alias("k2"), F.col("pos").alias("via"), F.col("next").alias("far"))
        links = stored(links.join(far, links["k"].eqNullSafe(far["k2"]) & (links["next"] == far["via"])).select("k", "pos", F.col("far").alias("next")), "links")
    marked = marked.select(F.col("k").alias("__k"), F.col("pos").alias("__p"), F.lit(True).alias("sent"))
    out = base.join(marked, base[key].eqNullSafe(marked["__k"]) & (base["__pos"] == marked["__p"]), "left")
    return out.select(*rows.columns, F.coalesce("sent", F.lit(False)).alias("sent"))


def severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "critical").when(confidence >= 0.5, "warning").otherwise("low_confidence")


def routed(verdicts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Add suppressed: kind_none, below_threshold, debounced, or null for a verdict that is sent."""
    rows = verdicts.withColumn("dedupe_key", dedupe_key())
    why = F.when(F.col("kind") == "none", "kind_none").when(F.col("confidence") < t.decide, "below_threshold")
    rows = rows.withColumn("why", why)
    sent = debounced(rows.filter("why is null"), t).withColumn("suppressed", F.when(~F.col("sent"), "debounced")).drop("sent", "why")
    return sent.unionByName(rows.filter("why is not null").withColumn("suppressed", F.col("why")).drop("why"))


def payloads(sent: DataFrame) -> DataFrame:
    """Payload fields and valid: non-empty keys, a known severity and a confidence between 0 and 1."""
    rows = sent.withColumn("severity", severity(F.col("confidence")))
    ok = (F.col("session_id") != "") & (F.col("dedupe_key") != "") & F.col("confidence").between(0, 1) & F.col("severity").isin("critical", "warning", "low_confidence", "meta")
    return rows.select("id", "session_id", "kind", "subtype", "confidence", "severity", "dedupe_key", "ts", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce(ok, F.lit(False)).alias("valid"))


def low_confidence(verdicts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Verdicts of failed or deferred judgements, if these are wanted at all; debounced by a key of their own."""
    rows = verdicts.filter((F.col("judge_error") | F.col("deferred")) & F.lit(t.low_confidence)).withColumn("dedupe_key", dedupe_key(F.lit("low_confidence")))
    return debounced(rows, t).withColumn("severity", F.lit("low_confidence"))


def meta_events(events: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The first of each (session, event key), as debounced messages of kind meta with confidence 1."""
    once = events.groupBy("session_id", "event_key").agg(F.min_by("id", F.struct("ts", "id")).alias("id"), F.min("ts").alias("ts"))
    rows = once.withColumns({"kind": F.lit("meta"), "confidence": F.lit(1.0), "severity": F.lit("meta")})
    return debounced(rows.withColumn("dedupe_key", dedupe_key()), t)


def fan_out(valid: DataFrame, channels: DataFrame) -> DataFrame:
    """Each payload for each channel; channels are a handful of configured names."""
    return valid.crossJoin(F.broadcast(channels.select("channel")))


def outcomes(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channel, succeeded, failed), and per message whether its cooldown counts: at least one channel succeeded."""
    by_channel = attempts.groupBy("channel").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    by_message = attempts.groupBy("id", "dedupe_key", "ts").agg(F.bool_or("ok").alias("recorded"))
    return by_channel, by_message
