"""Queries of ordering, fingerprints, window detectors and text patterns over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fingerprint, gate, ordering, prefix
from ..sources import views
from .registry import HITS, query


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a prefix that holds something for every mask."""
    extra = F.format_string(" at 2024-05-%02d and 2024-05-%02dT10:00:%02dZ 1700000%06d --port=%d -p %d -p 90 host:%d /tmp/x%d /var/tmp/y sleep %d %s", F.pmod("doc_id", F.lit(28)) + 1, F.pmod("doc_id", F.lit(28)) + 1, F.pmod("doc_id", F.lit(60)), "doc_id", F.col("doc_id") * 7, F.col("doc_id") * 11 + 60000, F.col("doc_id") * 3, "doc_id", F.pmod("doc_id", F.lit(9)), F.md5(F.col("doc_id").cast("string")))
    return views.table(spark, d, "documents").select("doc_id", F.concat("text", extra).alias("t"))


_DOCS = "(SELECT doc_id, text || printf(' at 2024-05-%02d and 2024-05-%02dT10:00:%02dZ 1700000%06d --port=%d -p %d -p 90 host:%d /tmp/x%d /var/tmp/y sleep %d %s', doc_id % 28 + 1, doc_id % 28 + 1, doc_id % 60, doc_id, doc_id * 7, doc_id * 11 + 60000, doc_id * 3, doc_id, doc_id % 9, md5(CAST(doc_id AS VARCHAR))) AS t FROM documents)"


# The masks in SQL, written apart from the library's patterns. A guard that takes the next character may hide a neighbour
# from the same pass, so those are applied twice.
_RANGE = "0*(?:[1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
_SHORT = "(?:0{0,4}[1-9]|0{0,3}[1-9][0-9]|0{0,2}[1-9][0-9]{2}|0?[1-9][0-9]{3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
_HEX = "[0-9A-Fa-f]"
_UUID = f"{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}"
_DASH_P = [("(^|[^0-9A-Za-z_])-p[= ]([0-9]+)", "\\1-p \\2")] * 2 + [(f"(^|[^0-9A-Za-z_])-p {_RANGE}([^0-9]|$)", "\\1-p <PORT>\\2")] * 2
_TIMESTAMPS_SQL = [("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}(?::[0-9]{2}){2}(?:[.][0-9]+)?(?:Z|[-+][0-9]{2}:?[0-9]{2})?", "<TIMESTAMP>"), (r"\b[0-9]{4}(?:-[0-9]{2}){2}\b", "<TIMESTAMP>"), (r"\b(?:[0-9]{13}|[0-9]{10})\b", "<TIMESTAMP>")]
_PORTS_SQL = [("--port[= ]([0-9]+)", "--port \\1"), *[(f"--port {_RANGE}([^0-9]|$)", "--port <PORT>\\1")] * 2, *_DASH_P, (rf":{_SHORT}\b", ":<PORT>")]
_PATHS_SQL = [(r"/var/(?:folders|tmp)/[^\s]*", "<TMP_PATH>"), (r"/tmp/[^\s]*", "<TMP_PATH>"), (r"[A-Za-z]:\\[^\s]*\\AppData\\Local\\Temp\\[^\s]*", "<TMP_PATH>"), (r"[A-Za-z]:/[^\s]*/AppData/Local/Temp/[^\s]*", "<TMP_PATH>")]
_HASHES_SQL = [(_UUID, "<HASH>"), (rf"\b(?:{_HEX}{{64}}|{_HEX}{{40}}|{_HEX}{{32}})\b", "<HASH>")]
_VOLATILE_SQL = [(_UUID, "<HASH>"), (rf"\b{_HEX}{{32,}}\b", "<HASH>"), (r"/tmp/[^\s]*", "<TMP>"), (r":[0-9]{4,5}\b", ":<PORT>"), (r"\b[0-9]{10,}\b", "<N>"), (r"\bsleep\s+[0-9]+\b", "sleep <N>")]


def _sql(rules: list[tuple[str, str]], column: str = "t") -> str:
    for pattern, to in rules:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


def _masked(spark, d, mask):
    out = mask(F.col("t"))
    return _documents(spark, d).select("doc_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("n"))


def _mask_sql(rules) -> str:
    return f"SELECT doc_id, md5(m) AS digest, length(m) AS n FROM (SELECT doc_id, {_sql(rules)} AS m FROM {_DOCS})"


@query(_mask_sql(_TIMESTAMPS_SQL))
def d1_mask_timestamps(spark, d):
    return _masked(spark, d, tx.mask_timestamps)


@query(_mask_sql(_PORTS_SQL))
def d2_mask_ports(spark, d):
    return _masked(spark, d, tx.mask_ports)


@query(_mask_sql(_PATHS_SQL))
def d3_mask_tmp_paths(spark, d):
    return _masked(spark, d, tx.mask_tmp_paths)


@query(_mask_sql(_HASHES_SQL))
def d4_mask_hashes(spark, d):
    return _masked(spark, d, tx.mask_hashes)


@query(_mask_sql([*_TIMESTAMPS_SQL, *_PORTS_SQL, *_PATHS_SQL, *_HASHES_SQL]))
def d5_mask_pipeline(spark, d):
    return _masked(spark, d, tx.mask_all)


@query(_mask_sql(_VOLATILE_SQL))
def d6_mask_volatile(spark, d):
    return _masked(spark, d, tx.mask_volatile)


@query("SELECT page_id, coalesce(nullif(list_reduce(list_prepend('', string_split(regexp_extract(url, '://[^/]*(/[^?#]*)', 1) || '/./a//../b/', '/')), lambda done, step: CASE WHEN step IN ('', '.') THEN done WHEN step = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || step END), ''), '/') AS path FROM pages")
def d7_normalize_path(spark, d):
    """Paths of urls, with steps to fold."""
    path = F.concat(F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1), F.lit("/./a//../b/"))
    return views.table(spark, d, "pages").select("page_id", tx.normalize_path(path).alias("path"))


_SPACE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5(c) AS digest FROM (SELECT doc_id, {_SPACE.format('t')} AS c FROM (SELECT doc_id, regexp_replace(regexp_replace('/* a ' || doc_id || ' */ ' || text || ' // end', '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g') AS t FROM documents))")
def d8_collapse_and_strip(spark, d):
    t = F.concat(F.lit("/* a "), F.col("doc_id").cast("string"), F.lit(" */ "), "text", F.lit(" // end"))
    return views.table(spark, d, "documents").select("doc_id", F.md5(tx.collapse_space(tx.strip_comments(t))).alias("digest"))


_PAIR = "(SELECT a.uuid, a.edit_tokens AS old, lag(a.edit_tokens) OVER (PARTITION BY session_id ORDER BY seq) AS new FROM actions a)"


@query(f"""SELECT uuid, coalesce((SELECT string_agg(x, chr(31) ORDER BY x) FROM (
      SELECT unnest(list_concat(
        flatten([['-(' || t || ')' for k in range(greatest(0, len([y for y in old if y = t]) - len([y for y in new if y = t])))] for t in list_distinct(old)]),
        flatten([['+(' || t || ')' for k in range(greatest(0, len([y for y in new if y = t]) - len([y for y in old if y = t])))] for t in list_distinct(new)]))) AS x)), '') AS delta
      FROM {_PAIR} WHERE new IS NOT NULL""", "actions")
def d9_edit_delta(spark, d):
    from pyspark.sql import Window

    rows = views.actions(spark, d).withColumn("new", F.lag("edit_tokens").over(Window.partitionBy("session_id").orderBy("seq"))).filter("new is not null")
    return rows.select("uuid", tx.edit_delta(F.col("edit_tokens"), F.col("new")).alias("delta"))


_FETCH = """'{"args":[{"a":' || doc_id || ',"b":null},"x"],"q":{"text":' || CAST(to_json(t) AS VARCHAR) || ',"z":true}}'"""


@query(f"SELECT doc_id, 'Bash:' || substr(sha256({_SPACE.format(_sql(_VOLATILE_SQL))}), 1, 16) AS bash_key, 'Write:/src/' || doc_id || ':' || substr(sha256({_SPACE.format('t')}), 1, 16) AS write_key, 'Read:' || substr(sha256('/src/' || doc_id), 1, 16) AS read_key, 'Fetch:' || substr(sha256(CASE WHEN length(c) > 256 THEN 'sha256:' || sha256(c) ELSE c END), 1, 16) AS other_key FROM (SELECT *, {_SPACE.format(_FETCH)} AS c FROM {_DOCS})")
def d10_arg_keys(spark, d):
    """Keys of commands, writes, reads, and of a tool without a rule of its own, whose input comes in another order than the sorted one."""
    rows = _documents(spark, d)
    path = F.concat(F.lit("/src/./"), F.col("doc_id").cast("string"))
    of = lambda **f: F.struct(*[v.alias(k) for k, v in f.items()])
    call = lambda tool, **f: fingerprint.arg_key(F.lit(tool), F.to_json(of(**f)))
    other = F.concat(F.lit('{"q": {"z" : true, "text":'), F.to_json(F.to_variant_object(F.array("t"))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array("t")))) - 2), F.lit('}, "args": [{"b":null, "a": '), F.col("doc_id").cast("string"), F.lit('}, "x"]}'))
    return rows.select("doc_id", call("Bash", command=F.col("t")).alias("bash_key"), call("Write", file_path=path, content=F.col("t")).alias("write_key"), call("Read", file_path=path).alias("read_key"), fingerprint.arg_key(F.lit("Fetch"), other).alias("other_key"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"a":{"x":' || k || ',"y":' || event_id || '},"t":"' || event_type || '"}' WHEN 1 THEN '{"k":"' || k || '"}' WHEN 2 THEN '{"k":' || k || '}' WHEN 3 THEN '{"l":[{"a":' || k || ',"b":[{"c":1,"d":null}]},true,"' || event_type || '"]}'
    WHEN 4 THEN '{"a":"x\\",\\"b\\":\\"' || k || '"}' ELSE '{"k":' || k || ' no' END AS canonical FROM (SELECT *, CAST(props::JSON->>'k' AS VARCHAR) AS k FROM events)""")
def d11_canonical_json(spark, d):
    """Nested objects, objects in arrays, texts and numbers alike, quotes within texts, and what is no JSON."""
    rows = views.table(spark, d, "events")
    put = lambda form: F.format_string(form, F.get_json_object("props", "$.k"), F.col("event_id"), F.col("event_type"))
    forms = ['{"t":"%3$s", "a": {"y":%2$d, "x": %1$s}}', '{ "k" :"%1$s"}', '{"k" : %1$s}', '{"l":[{"b":[{"d":null,"c":1}], "a":%1$s},true, "%3$s"]}', '{"a":"x\\",\\"b\\":\\"%1$s"}', '{"k":%1$s no']
    raw = F.coalesce(*[F.when(F.col("event_id") % 6 == n, put(f)) for n, f in enumerate(forms)])
    return rows.select("event_id", tx.canonical_json(raw).alias("canonical"))


@query("SELECT doc_id, CASE WHEN length(text) > 256 THEN 'sha256:' || sha256(text) ELSE text END AS digest FROM documents")
def d12_large_payload_digest(spark, d):
    return views.table(spark, d, "documents").select("doc_id", tx.digest_large(F.col("text")).alias("digest"))


@query("SELECT session_id, file_path AS path, string_agg(uuid, ',' ORDER BY seq) AS uuids FROM actions WHERE file_path IS NOT NULL GROUP BY ALL", "actions")
def d14_edits_by_file(spark, d):
    return fingerprint.edits_by_file(views.actions(spark, d)).select("session_id", "path", F.array_join("uuids", ",").alias("uuids"))


@query("SELECT tool AS path, substr(fine_key, length(fine_key) - 15) AS variant, count(*) AS n FROM actions GROUP BY ALL", "actions")
def d15_variant_counts(spark, d):
    return fingerprint.variant_counts(views.actions(spark, d).withColumn("arg_key", F.col("fine_key")))


@query("SELECT path, max(n) >= 25 AS genuine_repeat FROM (SELECT tool AS path, fine_key, count(*) AS n FROM actions GROUP BY ALL) GROUP BY path", "actions")
def d16_dominant_variants(spark, d):
    return fingerprint.dominant_variants(fingerprint.variant_counts(views.actions(spark, d).withColumn("arg_key", F.col("fine_key"))), 25)


@query(f"SELECT doc_id, substr(lower({_SPACE.format('text')}), 1, 500) AS content FROM documents")
def d17_content_normalization(spark, d):
    return views.table(spark, d, "documents").select("doc_id", tx.normalize_content(F.col("text")).alias("content"))


@query("SELECT session_id, uuid, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS seq FROM threads", "threads")
def c1_causal_order(spark, d):
    return ordering.causal_order(views.threads(spark, d).drop("seq")).select("session_id", "uuid", "seq")


@query("SELECT session_id, uuid, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS position FROM threads", "threads")
def c2_topological_order(spark, d):
    return ordering.topological_order(views.threads(spark, d))


@query(""", d AS (SELECT b.session_id, b.uuid, b.ts, b.byte_offset, 0 AS n FROM branches b LEFT JOIN branches p ON p.uuid = b.parent_uuid WHERE p.ts IS DISTINCT FROM b.ts UNION ALL SELECT b.session_id, b.uuid, b.ts, b.byte_offset, d.n + 1 FROM d JOIN branches b ON b.parent_uuid = d.uuid AND b.ts = d.ts)
    SELECT session_id, uuid, row_number() OVER (PARTITION BY session_id ORDER BY ts, n, byte_offset, uuid) AS seq FROM d""", "branches")
def c1_equal_times(spark, d):
    """Records of equal times, of which some are parents of others."""
    return ordering.causal_order(views.branches(spark, d)).select("session_id", "uuid", "seq")


# A record's path of offsets from its root tells its place among those of its depth.
_PATHS = """, p AS (SELECT session_id, uuid, [byte_offset] AS path FROM branches WHERE parent_uuid IS NULL UNION ALL SELECT b.session_id, b.uuid, list_append(p.path, b.byte_offset) FROM p JOIN branches b ON b.parent_uuid = p.uuid)
    SELECT session_id, uuid, row_number() OVER (PARTITION BY session_id ORDER BY len(path), path) - 1 AS position FROM p"""


@query(_PATHS, "branches")
def c2_branching_order(spark, d):
    return ordering.topological_order(views.branches(spark, d))


@query(_PATHS, "branches")
def c2_order_by_refinement(spark, d):
    """As large sessions are ordered: ranks refined by doubling, no session in one task."""
    return ordering.by_refinement(views.branches(spark, d).select("session_id", "uuid", "parent_uuid", "byte_offset"))


@query("SELECT session_id, uuid, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS depth, false AS cyclic FROM threads", "threads")
def c2_thread_depth(spark, d):
    return ordering.depths(views.threads(spark, d))


@query("SELECT uuid, false AS is_orphan FROM threads UNION ALL SELECT uuid || '-lost', seq % 3 <> 0 FROM threads", "threads")
def c3_orphans(spark, d):
    """All records, and for each one a further record, of which one in three names it as its parent and the others one that never came."""
    t = views.threads(spark, d)
    more = t.withColumns({"uuid": F.concat("uuid", F.lit("-lost")), "parent_uuid": F.when(F.col("seq") % 3 == 0, F.col("uuid")).otherwise(F.concat("uuid", F.lit("-gone")))})
    return ordering.orphans(t.unionByName(more)).select("uuid", "is_orphan")


@query("SELECT uuid, byte_offset FROM threads", "threads")
def c5_offset_sort(spark, d):
    return ordering.offset_sort(views.threads(spark, d)).select("uuid", "byte_offset")


@query("SELECT session_id, uuid, row_number() OVER (PARTITION BY session_id ORDER BY ts, uuid) AS seq FROM actions", "actions")
def e1_window_rows(spark, d):
    return gate.number_actions(views.actions(spark, d).drop("seq")).select("session_id", "uuid", "seq")


@query("SELECT uuid, repeat_n FROM rep", "actions rep")
def e2_repeat_count(spark, d):
    return gate.repeat_counts(views.actions(spark, d)).select("uuid", "repeat_n")


@query("SELECT uuid, error_n FROM rep", "actions rep")
def e3_error_loop(spark, d):
    return gate.repeat_counts(views.actions(spark, d)).select("uuid", "error_n")


@query("SELECT uuid, severity, subtype, array_to_string(window_refs, ',') AS refs FROM repv WHERE severity IS NOT NULL", "actions rep repv")
def e4_repeat_verdict(spark, d):
    return gate.repeat_verdicts(views.actions(spark, d)).filter("severity is not null").select("uuid", "severity", "subtype", F.array_join("window_refs", ",").alias("refs"))


@query("SELECT uuid, edit_n FROM ed", "actions ed")
def e5_edit_count(spark, d):
    return gate.edit_counts(views.actions(spark, d)).select("uuid", "edit_n")


@query("SELECT uuid, round(len(list_intersect(old, new)) / len(list_distinct(list_concat(old, new))), 6) AS similarity FROM (SELECT uuid, edit_tokens AS old, lag(edit_tokens) OVER (PARTITION BY session_id ORDER BY seq) AS new FROM actions) WHERE new IS NOT NULL", "actions")
def e6_token_jaccard(spark, d):
    from pyspark.sql import Window

    from ..functions.measures import jaccard

    rows = views.actions(spark, d).withColumn("new", F.lag("edit_tokens").over(Window.partitionBy("session_id").orderBy("seq"))).filter("new is not null")
    return rows.select("uuid", F.round(jaccard(F.col("edit_tokens"), F.col("new")), 6).alias("similarity"))


@query("SELECT uuid, round(max_jaccard, 6) AS max_jaccard FROM edm", "actions ed edp edm")
def e7_max_pairwise_jaccard(spark, d):
    return gate.edit_verdicts(views.actions(spark, d)).filter("edit_n >= 5").select("uuid", F.round("max_jaccard", 6).alias("max_jaccard"))


@query("SELECT uuid, severity, array_to_string(refs, ',') AS refs FROM edv WHERE severity IS NOT NULL", "actions ed edp edm edv")
def e8_edit_verdict(spark, d):
    return gate.edit_verdicts(views.actions(spark, d)).filter("severity is not null").select("uuid", "severity", F.array_join("window_refs", ",").alias("refs"))


@query("SELECT trigger_uuid, severity, subtype FROM hits", HITS)
def e9_severity_pick(spark, d):
    return gate.hits(views.actions(spark, d)).select("trigger_uuid", "severity", "subtype")


@query("SELECT session_id, trigger_uuid, ts, type, subtype, severity, array_to_string(window_refs, ',') AS refs, m1 AS n FROM hits", HITS)
def e10_hits(spark, d):
    n = F.coalesce(F.col("metrics.repeatN"), F.col("metrics.fileEditN")).cast("long")
    return gate.hits(views.actions(spark, d)).select("session_id", "trigger_uuid", "ts", "type", "subtype", "severity", F.array_join("window_refs", ",").alias("refs"), n.alias("n"))


_COUNTERS = "SELECT uuid, count(*) OVER w AS n, min(ts) OVER w AS first_ts, max(ts) OVER w AS last_ts, array_to_string(list(uuid) OVER w, ',') AS uuids FROM actions WINDOW w AS (PARTITION BY session_id, agent_scope, arg_key{} ORDER BY seq RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query(_COUNTERS.format(", result_class"), "actions")
def e11_keyed_counters(spark, d):
    return gate.keyed_counters(views.actions(spark, d), by_class=True).select("uuid", "n", "first_ts", "last_ts", F.array_join("uuids", ",").alias("uuids"))


@query("SELECT session_id, count(*) AS n, max(repeat_n) AS most FROM rep GROUP BY session_id", "actions rep")
def e12_partition_isolation(spark, d):
    return gate.repeat_counts(views.actions(spark, d)).groupBy("session_id").agg(F.count("*").alias("n"), F.max("repeat_n").alias("most"))


@query("SELECT uuid FROM rep WHERE repeat_n >= 10", "actions rep")
def e13_gate_filter(spark, d):
    return gate.gate_passed(gate.repeat_counts(views.actions(spark, d)).withColumn("gate_passed", F.col("repeat_n") >= 10)).select("uuid")


@query("SELECT a.session_id, a.events, coalesce(h.hits, 0) AS hits, h.hits IS NOT NULL AS thrashing, coalesce(h.severity, 'none') AS max_severity FROM (SELECT session_id, count(*) AS events FROM actions GROUP BY 1) a LEFT JOIN (SELECT session_id, count(*) AS hits, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity FROM hits GROUP BY 1) h ON a.session_id = h.session_id", HITS)
def e14_self_check(spark, d):
    a = views.actions(spark, d)
    return gate.self_check(a, gate.hits(a))


#: Phrases for every rule, one for each document, so that all rules meet whole texts.
PHRASES = ["작업이 완료 되었습니다", "Task is done", "successfully finished", "제가 확인한 결과 문제없습니다", "as I verified", "I checked and it works", "in my previous response", "as i mentioned earlier", "nothing", "모두 완료"]


def _phrased(spark, d):
    pick = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod("doc_id", F.lit(10)) + 1).cast("int"))
    return views.table(spark, d, "documents").select("doc_id", "source", F.concat("text", F.lit(" "), pick).alias("t"))


# What each phrase means, by hand; the documents' own texts hold none.
_CLAIMS = "doc_id % 10 IN (0, 1, 2, 9)"
_CHECKS = "doc_id % 10 IN (3, 4, 5)"
_REFERS = "doc_id % 10 IN (3, 4, 5, 6, 7)"


@query(f"SELECT doc_id, CASE WHEN {_CLAIMS} THEN 'UNSUBSTANTIATED_COMPLETION' WHEN {_CHECKS} THEN 'SELF_REFERENTIAL_VERIFICATION' ELSE '' END AS kinds FROM documents")
def h1_false_success_patterns(spark, d):
    return _phrased(spark, d).select("doc_id", F.array_join(tx.pattern_kinds(F.col("t")), ",").alias("kinds"))


@query(f"SELECT doc_id, {_CLAIMS} OR {_CHECKS} AS matched FROM documents")
def h2_false_success(spark, d):
    return _phrased(spark, d).select("doc_id", tx.false_success(F.col("t")).alias("matched"))


@query(f"SELECT doc_id, {_REFERS} AS matched FROM documents")
def h3_self_referential(spark, d):
    return _phrased(spark, d).select("doc_id", tx.self_referential(F.col("t")).alias("matched"))


@query(f"SELECT doc_id, round(avg(CAST({_CLAIMS} OR {_CHECKS} AS INT)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS density FROM documents")
def h4_pattern_density(spark, d):
    from pyspark.sql import Window

    rows = prefix.numbered(_phrased(spark, d).select("doc_id", "source", tx.false_success(F.col("t")).cast("int").alias("m")), "n", ["doc_id"], ["source"])
    w = Window.partitionBy("source", "block").orderBy("n").rowsBetween(-5, 5)
    near = prefix.neighbourhood(rows, "n", 5)
    return near.withColumn("density", F.round(F.avg("m").over(w), 6)).filter("home").select("doc_id", "density")
