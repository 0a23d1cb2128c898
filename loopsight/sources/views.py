"""Domain tables over the analytics tables: actions, edits, threads and labels for jobs that need session data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fp16, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000
    return day + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action per event: a session per user, in time order."""
    e = table(spark, sf_dir, "events").withColumn("session_id", F.col("user_id").cast("string"))
    # By the session and not by the user, so that what is partitioned by session finds its rows dealt already.
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")).cast("long")
    return e.select(
        "session_id", F.lit("root").alias("agent_scope"), seq.alias("seq"), F.col("event_id").cast("string").alias("uuid"), millis(F.col("ts")).alias("ts"),
        F.col("event_type").alias("tool"), F.col("event_type").alias("arg_key"), F.concat("event_type", F.lit(":"), fp16(F.col("props"))).alias("fine_key"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("result_class"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("file_path"), tokens(F.concat_ws(" ", "event_type", "props")).alias("edit_tokens"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of conversations; each turn's parent is the turn before."""
    c = table(spark, sf_dir, "conversations")
    uuid = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.lit("root").alias("agent_scope"), uuid(F.col("turn")).alias("uuid"), F.when(before.isNotNull(), uuid(before)).alias("parent_uuid"), F.col("turn").alias("seq"), (F.col("turn") * 1000).alias("ts"), (F.col("turn") * 100).alias("byte_offset"), F.col("role"), F.col("text"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of forty sessions whose threads branch, with equal times along a branch and offsets in no order of time."""
    c = table(spark, sf_dir, "conversations")
    g = F.row_number().over(Window.partitionBy(F.col("conv_id") % 40).orderBy("conv_id", "turn")).cast("long")
    c = c.select((F.col("conv_id") % 40).cast("string").alias("session_id"), F.lit("root").alias("agent_scope"), g.alias("g"))
    uuid = lambda n: F.concat_ws("-", "session_id", n.cast("string"))
    up = F.when((F.col("g") % 11 != 0) & (F.col("g") > 1), F.when((F.col("g") % 4).isin(1, 2), F.col("g") - 1).otherwise(F.floor(F.col("g") / 2)))
    return c.select("session_id", "agent_scope", uuid(F.col("g")).alias("uuid"), F.when(up.isNotNull(), uuid(up)).alias("parent_uuid"), (F.floor(F.col("g") / 4) * 1000).alias("ts"), (F.col("g") * 7919 % 100003).alias("byte_offset"))


def _file(name: str) -> Column:
    return F.concat(F.lit(f"/src/{name}"), (F.col("seq") % 5).cast("string"), F.lit(".ts"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw session-log lines (JSON text) built from conversations: path, line_no, value.

    An assistant turn calls one of four tools by its number; the next user turn holds the result, whose class goes round
    seven cases, with the turn's whole text.
    """
    t, seq = threads(spark, sf_dir), F.col("seq")
    number = lambda word: F.concat(F.lit(f"{word} "), seq.cast("string"))
    iso = F.date_format(F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kind = F.when(F.col("role") == "system", "system").when(F.col("role") == "user", "user").otherwise("assistant")
    call = {0: ("Bash", {"command": number("run")}), 1: ("Edit", {"file_path": _file("e"), "old_string": number("old"), "new_string": F.concat(number("new"), F.lit(" more"))}), 2: ("Write", {"file_path": _file("w"), "content": number("text")}), 3: ("Read", {"file_path": F.concat(F.lit("/src/./a/../r"), (seq % 5).cast("string"))})}
    of_call = lambda name: F.coalesce(*[F.when(seq % 4 == k, fields[name]) for k, (_, fields) in call.items() if name in fields])
    tool = F.element_at(F.array(*[F.lit(name) for name, _ in call.values()]), (seq % 4 + 1).cast("int"))
    case = seq % 7
    said = F.when(case == 1, F.concat(F.lit("Blocked by a rule. "), "text")).when(case == 2, F.concat(F.lit("The user rejected it. "), "text")).when(case == 3, "").when(case == 4, F.concat(F.lit("Found 0 results. "), "text")).otherwise(F.col("text"))
    failed = F.when(case <= 2, True).when(case == 5, False)
    empty = {"text": "string", "id": "string", "name": "string", "input": "struct<command:string,file_path:string,old_string:string,new_string:string,content:string>", "tool_use_id": "string", "content": "string", "is_error": "boolean"}
    block = lambda kind, **given: F.struct(F.lit(kind).alias("type"), *[given.get(k, F.lit(None)).cast(v).alias(k) for k, v in empty.items()])
    text = block("text", text=F.col("text"))
    use = block("tool_use", id=F.concat(F.lit("t-"), "uuid"), name=tool, input=F.struct(*[of_call(c).alias(c) for c in ("command", "file_path", "old_string", "new_string", "content")]))
    result = block("tool_result", tool_use_id=F.concat(F.lit("t-"), "parent_uuid"), content=said, is_error=failed)
    blocks = F.when(kind == "assistant", F.array(text, use)).when((kind == "user") & F.col("parent_uuid").isNotNull(), F.array(text, result)).otherwise(F.array(text))
    record = F.struct(kind.alias("type"), F.col("uuid"), F.col("parent_uuid").alias("parentUuid"), F.col("session_id").alias("sessionId"), iso.alias("timestamp"), F.struct(F.col("role"), blocks.alias("content")).alias("message"))
    return t.select(F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("path"), seq.alias("line_no"), F.to_json(record).alias("value"))
