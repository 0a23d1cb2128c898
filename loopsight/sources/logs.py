"""Session logs: scan, line offsets, bad-line quarantine and normalization of records to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The log's own fields; unknown ones are ignored, the raw line is kept beside.
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>"
RECORD = f"type string, uuid string, parentUuid string, timestamp string, sessionId string, cwd string, gitBranch string, version string, isSidechain boolean, subtype string, message struct<role:string,content:string,stop_reason:string>"
# Kinds of an event.
KINDS = ["user", "assistant", "tool_use", "tool_result", "system", "attachment", "other"]


#: Lines of a file that are summed together; the sums of such stretches, a row each, are summed in order.
STRETCH = 100_000


def scan(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, line_no, value of all files under a folder whose name fits; lines end with \\n, \\r or \\r\\n.

    Blank lines are dropped by ``with_offsets``, after numbering. A tail without a line end is a line like any other: cut
    short, it is no JSON object and so is kept as bad. Lines are numbered within the parts that Spark reads of a
    file, so that a large file stays in several tasks.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("path", "block").orderBy("k")))
    return _after(lines, "block", F.lit(1), "start").select("path", (F.col("start") + F.col("n") - 1).alias("line_no"), "value")


def _after(lines: DataFrame, part: str, size: Column, name: str) -> DataFrame:
    """Add the sum of ``size`` over all earlier parts of the line's file."""
    before = Window.partitionBy("path").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = lines.groupBy("path", part).agg(F.sum(size).alias("__size"))
    return lines.join(totals.select("path", part, F.coalesce(F.sum("__size").over(before), F.lit(0)).cast("long").alias(name)), ["path", part])


def with_offsets(lines: DataFrame) -> DataFrame:
    """Add byte_offset: UTF-8 bytes of the file's earlier lines with their line ends; then drop blank lines."""
    size = F.octet_length("value") + 1
    lines = lines.withColumn("__part", F.floor(F.col("line_no") / STRETCH))
    before = Window.partitionBy("path", "__part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    found = _after(lines.withColumn("__own", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")), "__part", size, "__start")
    return found.select(*[c for c in lines.columns if c != "__part"], (F.col("__start") + F.col("__own")).alias("byte_offset")).filter(F.trim("value") != "")


def quarantine(lines: DataFrame) -> DataFrame:
    """Add parse_ok and parse_error: a line that isn't a JSON object is kept, with the reason."""
    ok = F.coalesce(F.expr("schema_of_variant(try_parse_json(value)) like 'OBJECT%'"), F.lit(False))
    return lines.withColumns({"parse_ok": ok, "parse_error": F.when(~ok, F.lit("invalid_json"))})


def agent_scope(path: Column, sidechain: Column) -> Column:
    agent = F.regexp_extract(path, r"subagents/([^/]+)/agent-[^/]*\.jsonl$", 1)
    return F.when(agent != "", agent).when(sidechain, F.concat(F.lit("sidechain:"), path)).otherwise("root")


def result_class(text: Column, is_error: Column, api_error: Column | None = None, has_block: Column | None = None) -> Column:
    """blocked > rejected > error > empty > ok > unknown; an explicit is_error = false with text is unknown."""
    text = F.coalesce(text, F.lit(""))
    failed = F.coalesce(is_error, F.lit(False)) | text.contains("<tool_use_error>")
    out = F.when(failed & text.rlike(r"\bBlocked\b"), "blocked").when(failed & text.rlike(r"(?i)\brejected\b"), "rejected").when(failed, "error")
    if api_error is not None:
        said = F.coalesce(api_error, F.lit(False))
        out = out.when(said & text.rlike(r"(?i)\brejected\b"), "rejected").when(said, "error")
    if has_block is not None:
        out = out.when(~has_block, "unknown")
    return out.when(F.trim(text) == "", "empty").when(text.rlike(r"\b0\s+(results|matches)\b"), "empty").when(is_error.isNull(), "ok").otherwise("unknown")


def content_text(content: Column) -> Column:
    """Text of a content field: a string, or the joined text parts of an array of blocks."""
    parts = F.from_json(content, "array<struct<text:string>>")
    return F.when(content.startswith("["), F.array_join(F.transform(parts, lambda b: F.coalesce(b["text"], F.lit(""))), "")).otherwise(F.coalesce(content, F.lit("")))


def records(lines: DataFrame) -> DataFrame:
    """Add parse_ok, parse_error, and the record r with its content blocks."""
    found = quarantine(lines).withColumn("r", F.from_json("value", RECORD))
    content = F.col("r.message.content")
    blocks = F.when(content.startswith("["), F.from_json(content, f"array<{BLOCK}>")).otherwise(F.array().cast(f"array<{BLOCK}>"))
    return found.withColumn("blocks", F.coalesce(F.filter(blocks, lambda b: b.isNotNull()), F.array().cast(f"array<{BLOCK}>")))


def file_name(path: str = "path") -> Column:
    """A file's name without its ending: the session of a file that names none."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?$", 1)


def parse(lines: DataFrame, ingested_at: int = 0) -> DataFrame:
    """Normalized events, one row for each tool_use block (else one a record), in the shape of the events table.

    lines: path, line_no, value, byte_offset, as ``with_offsets`` gives them. A timestamp that can't be read becomes
    ingested_at; a missing uuid is derived from offset and line. A file's session is the first that a record names.
    """
    found = records(lines)
    named = found.filter(F.col("r.sessionId") != "").groupBy("path").agg(F.min_by("r.sessionId", "line_no").alias("named"))
    return normalized(found.join(named, "path", "left"), F.coalesce("named", file_name()), F.lit(ingested_at).cast("long")).drop("path")


def normalized(found: DataFrame, session: Column, ingested_at: Column) -> DataFrame:
    """Events of records, with what stands for their session; ingested_at also stands for unreadable times."""
    r = lambda name: F.col(f"r.{name}")
    content = r("message.content")
    of = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    uses, results = of("tool_use"), F.get(F.reverse(of("tool_result")), 0)
    plain = F.when(content.startswith("["), F.array_join(F.transform(of("text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")).otherwise(content)
    kind = (
        F.when(~F.col("parse_ok"), "other").when(r("type") == "system", "system").when(r("type") == "attachment", "attachment").when(F.size(uses) > 0, "tool_use").when(F.size(of("tool_result")) > 0, "tool_result")
        .when(r("type").isin("user", "assistant"), r("type")).when(r("message.role").isin("user", "assistant"), r("message.role")).otherwise("other")
    )
    synthetic = F.concat(F.lit("synth-"), F.substring(F.sha2(F.concat(F.col("byte_offset").cast("string"), F.lit(":"), F.col("value")), 256), 1, 16))
    sidechain = F.coalesce(r("isSidechain"), F.lit(False))
    rows = found.select(
        F.coalesce(F.nullif(r("uuid"), F.lit("")), synthetic).alias("record_uuid"), r("parentUuid").alias("parent_uuid"), session.alias("session_id"), F.coalesce(r("cwd"), F.lit("")).alias("cwd"),
        agent_scope(F.col("path"), sidechain).alias("agent_scope"), sidechain.alias("is_sidechain"), F.coalesce(F.unix_millis(F.try_to_timestamp(r("timestamp"))), ingested_at).alias("ts"), F.col("byte_offset"), kind.alias("kind"),
        F.explode_outer(F.when(F.size(uses) > 0, uses)).alias("use"), results["tool_use_id"].alias("result_id"),
        F.when(results.isNotNull(), result_class(content_text(results["content"]), results["is_error"])).alias("result_class"), F.coalesce(plain, F.lit("")).alias("text"), F.get(F.reverse(of("thinking")), 0)["thinking"].alias("reasoning"),
        F.when(r("type") == "system", r("subtype")).alias("system_subtype"), F.when(r("message.stop_reason") == "interrupted", r("uuid")).alias("interrupted_message_id"), r("version").alias("version"), "parse_ok", "parse_error", ingested_at.alias("ingested_at"), F.col("value").alias("raw_json"), "path",
    )
    rows = rows.withColumns({"tool": F.col("use.name"), "input_json": F.col("use.input"), "tool_use_id": F.coalesce("use.id", "result_id"), "uuid": F.when(F.col("use.id").isNotNull() & (F.col("use.id") != ""), F.concat_ws("#", "record_uuid", "use.id")).otherwise(F.col("record_uuid"))})
    return rows.drop("use", "result_id")


def relabel_tools(events: DataFrame) -> DataFrame:
    """Events with a tool and an input are tool uses."""
    return events.withColumn("kind", F.when(F.col("tool").isNotNull() & F.col("input_json").isNotNull(), "tool_use").otherwise(F.col("kind")))


def pair_results(events: DataFrame) -> DataFrame:
    """Give each tool use the class of the result with its id in the session (the last one), else none."""
    results = events.filter("kind = 'tool_result' and tool_use_id is not null").groupBy("session_id", "tool_use_id").agg(F.max_by("result_class", F.struct("ts", "byte_offset")).alias("paired"))
    return events.join(results, ["session_id", "tool_use_id"], "left").withColumn("result_class", F.when(F.col("kind") == "tool_use", F.col("paired")).otherwise(F.col("result_class"))).drop("paired")


def version_warnings(events: DataFrame) -> DataFrame:
    """version, n, warned: versions that don't begin with a number are only warned about."""
    return events.groupBy("version").agg(F.count("*").alias("n")).withColumn("warned", F.coalesce(~F.col("version").rlike(r"^\d+(\.\d+)*"), F.lit(False)))
