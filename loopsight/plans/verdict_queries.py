"""Queries of semantic confirmation, judge jobs, verdicts and routing over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Thresholds
from ..functions.measures import cosine
from ..operators import gate, judge, routing, semantic, verdict
from ..sources import views
from .registry import HITS, TABLES, query

DAYS_20 = 20 * 86_400_000


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return gate.hits(views.actions(spark, d)).withColumn("hit_id", F.col("trigger_uuid"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Hit groups of up to eight vectors."""
    return views.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("hit_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))


_COS = "SELECT a.vec_id // 8 AS hit_id, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id // 8 = b.vec_id // 8 AND a.vec_id < b.vec_id"


@query("SELECT trigger_uuid AS hit_id, a.uuid, a.tool, a.result_class FROM (SELECT trigger_uuid, unnest(window_refs) AS uuid FROM hits) h JOIN actions a ON a.uuid = h.uuid", HITS)
def f1_hit_triples(spark, d):
    return semantic.hit_triples(_hits(spark, d), views.actions(spark, d)).select("hit_id", "uuid", "tool", "result_class")


@query("SELECT uuid, tool || ' ' || fine_key AS text FROM actions", "actions")
def f2_rendered_text(spark, d):
    return semantic.rendered(views.actions(spark, d).withColumn("arg_key", F.col("fine_key"))).select("uuid", "text")


@query("SELECT event_id, v.vec_id IS NULL AS missing, round(CAST(v.embedding[1] AS DOUBLE), 6) AS x FROM events e LEFT JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) + count(*) // 5 FROM embeddings)")
def f3_embedding_lookup(spark, d):
    """Texts go round all vectors, and a sixth more that have none."""
    vectors = views.table(spark, d, "embeddings")
    n = vectors.count()
    rows = views.table(spark, d, "events").select("event_id", F.concat(F.lit("v"), F.pmod("event_id", F.lit(n + n // 5)).cast("string")).alias("text"))
    cache = vectors.select(semantic.cache_key(F.concat(F.lit("v"), F.col("vec_id").cast("string")), "m").alias("cache_key"), F.col("embedding").alias("vector"))
    return semantic.look_up(rows, cache, "m").select("event_id", "missing", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f4_cosine(spark, d):
    a = views.table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


@query(f"SELECT hit_id, a, b, round(cos, 6) AS cos FROM ({_COS})")
def f5_group_pairs(spark, d):
    return semantic.pairs(_groups(spark, d), "hit_id", "pos").withColumn("cos", F.round("cos", 6))


@query(f"SELECT g.hit_id, round(coalesce(max(cos), 0), 6) AS max_cosine, count(cos) AS n FROM (SELECT DISTINCT vec_id // 8 AS hit_id FROM embeddings) g LEFT JOIN ({_COS}) p ON g.hit_id = p.hit_id GROUP BY ALL")
def f6_max_cosine(spark, d):
    g = _groups(spark, d).withColumn("pos", F.col("pos").cast("int"))
    return semantic.max_cosine(g, semantic.pairs(g, "hit_id", "pos"), "hit_id").select("hit_id", F.round("max_cosine", 6).alias("max_cosine"), F.size("pairs").cast("long").alias("n"))


@query(f"SELECT g.hit_id, coalesce(max(cos), 0) >= 0.3 AS strong FROM (SELECT DISTINCT vec_id // 8 AS hit_id FROM embeddings) g LEFT JOIN ({_COS}) p ON g.hit_id = p.hit_id GROUP BY g.hit_id")
def f7_strong_signal(spark, d):
    g = _groups(spark, d).withColumn("pos", F.col("pos").cast("int"))
    return semantic.signals(semantic.max_cosine(g, semantic.pairs(g, "hit_id", "pos"), "hit_id"), Thresholds(similar=0.3)).select("hit_id", "strong")


@query("SELECT session_id, count(*) * (count(*) - 1) // 2 AS pairs, count(*) >= 2 AS triggered FROM (SELECT DISTINCT session_id, subtype FROM hits) GROUP BY 1", HITS)
def f8_hit_level_similarity(spark, d):
    """Pairs of a session's distinct kinds of hits; fewer than two trigger nothing."""
    kinds = _hits(spark, d).select("session_id", "subtype").distinct()
    text = kinds.withColumn("vector", F.array(F.length("subtype").cast("double"), F.ascii("subtype").cast("double")))
    found = semantic.pairs(text, "session_id", "subtype").groupBy("session_id").agg(F.count("*").alias("pairs"))
    return kinds.select("session_id").distinct().join(found, "session_id", "left").select("session_id", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.col("pairs") > 0, F.lit(False)).alias("triggered"))


@query("SELECT query_id, rank, vec_id FROM (SELECT q.vec_id AS query_id, v.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS INT) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label) WHERE rank <= 10")
def f9_similarity_top_k(spark, d):
    v = views.table(spark, d, "embeddings").withColumn("model", F.col("label"))
    return semantic.top_k(v, v.filter("vec_id % 50 = 0")).select("query_id", "rank", "vec_id")


def _scored(spark, d):
    """Hits with a stand-in similarity and rendered text."""
    h = _hits(spark, d)
    return h.withColumns({"gate_passed": F.col("severity") == "critical", "max_cosine": F.pmod(F.col("hit_id").cast("long"), F.lit(100)) / 100, "text": F.concat_ws(" ", "subtype", "severity")}).withColumn("strong", F.col("max_cosine") >= 0.9)


_JUDGED = "severity = 'critical' AND CAST(trigger_uuid AS BIGINT) % 100 >= 90"


@query(f"SELECT trigger_uuid AS hit_id FROM hits WHERE {_JUDGED}", HITS)
def g1_judge_gating(spark, d):
    return judge.to_judge(_scored(spark, d)).select("hit_id")


@query(f"SELECT trigger_uuid AS hit_id, printf('type: thrashing\nsubtype: %s\nseverity: %s\nmax cosine: %.3f\ncandidate: %s', subtype, severity, (CAST(trigger_uuid AS BIGINT) % 100) / 100.0, subtype || ' ' || severity) AS prompt FROM hits WHERE {_JUDGED}", HITS)
def g2_request_table(spark, d):
    return judge.requests(judge.to_judge(_scored(spark, d)), "m").select("hit_id", "prompt")


@query(f"SELECT trigger_uuid AS hit_id, p AS position FROM hits, (VALUES ('orig'), ('swap')) v(p) WHERE {_JUDGED}", HITS)
def g3_position_swap(spark, d):
    return judge.swapped(judge.to_judge(_scored(spark, d))).select("hit_id", "position")


@query(f"SELECT trigger_uuid AS hit_id, p AS position, CAST(n AS INT) AS sample_no FROM hits, (VALUES ('orig'), ('swap')) v(p), range(1, 4) r(n) WHERE {_JUDGED}", HITS)
def g4_sample_expansion(spark, d):
    return judge.sampled(judge.swapped(judge.to_judge(_scored(spark, d))), 3).select("hit_id", "position", "sample_no")


def _samples(spark, d):
    """Raw judge replies, five for each hit: plain, fenced, out of range, not JSON and empty ones."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ["thrashing", "false_success", "none"])), (F.pmod(i, F.lit(3)) + 1).cast("int"))
    body = F.format_string('{"kind": "%s", "subtype": "s%d", "confidence": %d.%d, "reason": "r%d"}', kind, F.pmod(i, F.lit(4)), F.when(F.pmod(i, F.lit(11)) == 0, 1).otherwise(0), F.pmod(i, F.lit(10)), i)
    raw = F.when(F.pmod(i, F.lit(7)) == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.pmod(i, F.lit(13)) == 0, "oops").when(F.pmod(i, F.lit(17)) == 0, "").otherwise(body)
    return views.table(spark, d, "documents").select(F.floor(i / 5).alias("hit_id"), F.pmod(i, F.lit(5)).alias("sample_no"), raw.alias("raw"))


_VALID = """(SELECT doc_id // 5 AS hit_id, doc_id % 5 AS sample_no, CASE WHEN doc_id % 7 <> 0 AND doc_id % 13 = 0 THEN 'invalid_json' WHEN doc_id % 7 <> 0 AND doc_id % 17 = 0 THEN 'empty_input' WHEN doc_id % 11 = 0 AND doc_id % 10 <> 0 THEN 'schema_mismatch' END AS error_tag,
    (['thrashing', 'false_success', 'none'])[doc_id % 3 + 1] AS kind, 's' || (doc_id % 4) AS subtype, (CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) + (doc_id % 10) / 10.0 AS confidence, 'r' || doc_id AS reason FROM documents)"""


@query("SELECT doc_id, r.vec_id IS NULL AS missing FROM documents d LEFT JOIN (SELECT vec_id FROM embeddings) r ON r.vec_id = d.doc_id")
def g5_sample_lookup(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.concat(F.sha2(F.concat(F.lit("p"), F.col("doc_id").cast("string")), 256), F.lit(":m")).alias("cache_key"))
    samples = views.table(spark, d, "embeddings").select(F.concat(F.sha2(F.concat(F.lit("p"), F.col("vec_id").cast("string")), 256), F.lit(":m")).alias("cache_key"), F.lit("{}").alias("raw"))
    return judge.look_up(docs, samples).select("doc_id", "missing")


@query(f"SELECT hit_id, sample_no, error_tag, CASE WHEN error_tag IS NULL THEN kind END AS kind, CASE WHEN error_tag IS NULL THEN round(confidence, 6) END AS confidence FROM {_VALID}")
def g6_response_validation(spark, d):
    return judge.validated(_samples(spark, d)).select("hit_id", "sample_no", "error_tag", "kind", F.round("confidence", 6).alias("confidence"))


@query(f"""SELECT h.hit_id, coalesce(kind, 'none') AS kind, coalesce(votes, 0) AS votes, round(coalesce(confidence, 0), 6) AS confidence, coalesce(reason, '') AS reason FROM (SELECT DISTINCT doc_id // 5 AS hit_id FROM documents) h LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY votes DESC, CASE kind WHEN 'thrashing' THEN 0 WHEN 'false_success' THEN 1 ELSE 2 END) AS n FROM
    (SELECT hit_id, kind, count(*) AS votes, avg(confidence) AS confidence, arg_min(reason, sample_no) AS reason FROM {_VALID} WHERE error_tag IS NULL GROUP BY ALL)) v ON v.hit_id = h.hit_id AND n = 1""")
def g7_majority_vote(spark, d):
    s = judge.validated(_samples(spark, d))
    return judge.majority(s.select("hit_id").distinct(), s).select("hit_id", "kind", "votes", F.round("confidence", 6).alias("confidence"), "reason")


def _records(spark, d):
    """Hits whose embeddings are missing for every 7th, and judged for every 3rd (of which every 5th failed)."""
    h, k = _hits(spark, d), F.col("hit_id").cast("long")
    embedded = h.filter(k % 4 != 0).select("hit_id", F.when(k % 7 != 0, k % 100 / 100).alias("max_cosine"), (k % 7 == 0).alias("embed_error"))
    judged = h.filter(k % 3 == 0).select("hit_id", F.when(k % 2 == 0, "false_success").otherwise("thrashing").alias("kind"), F.lit("j").alias("subtype"), (k % 10 / 10).alias("confidence"), F.lit("r").alias("reason"), (k % 5 == 0).alias("judge_error"))
    return verdict.merge_stages(h, embedded, judged)


TABLES["records"] = """SELECT h.*, CAST(trigger_uuid AS BIGINT) AS k, CASE WHEN CAST(trigger_uuid AS BIGINT) % 4 <> 0 AND CAST(trigger_uuid AS BIGINT) % 7 <> 0 THEN CAST(trigger_uuid AS BIGINT) % 100 / 100.0 END AS max_cosine,
    CAST(trigger_uuid AS BIGINT) % 4 <> 0 AND CAST(trigger_uuid AS BIGINT) % 7 = 0 AS embed_error, CAST(trigger_uuid AS BIGINT) % 3 = 0 AND CAST(trigger_uuid AS BIGINT) % 5 = 0 AS judge_error, CASE WHEN CAST(trigger_uuid AS BIGINT) % 3 = 0 THEN CASE WHEN CAST(trigger_uuid AS BIGINT) % 2 = 0 THEN 'false_success' ELSE 'thrashing' END END AS j_kind FROM hits h"""


@query("SELECT trigger_uuid AS hit_id, round(max_cosine, 6) AS max_cosine, embed_error, judge_error, j_kind FROM records", HITS + " records")
def i1_stage_merge(spark, d):
    return _records(spark, d).select("hit_id", F.round("max_cosine", 6).alias("max_cosine"), "embed_error", "judge_error", "j_kind")


@query("""SELECT trigger_uuid AS hit_id, CASE WHEN embed_error THEN 'degraded' WHEN j_kind IS NOT NULL AND NOT judge_error THEN 'judge' WHEN max_cosine IS NOT NULL THEN 'embed' ELSE 'gate' END AS stage, CASE WHEN NOT embed_error AND j_kind IS NOT NULL AND NOT judge_error THEN j_kind ELSE type END AS kind,
    round(CASE WHEN embed_error THEN CASE severity WHEN 'critical' THEN 0.9 ELSE 0.75 END WHEN j_kind IS NOT NULL AND NOT judge_error THEN k % 10 / 10.0 WHEN max_cosine IS NOT NULL THEN max_cosine ELSE 0 END, 6) AS confidence FROM records""", HITS + " records")
def i2_verdict_synthesis(spark, d):
    return verdict.resolve(_records(spark, d)).select("hit_id", "final.stage", "final.kind", F.round("final.confidence", 6).alias("confidence"))


@query("""SELECT trigger_uuid AS hit_id, CASE WHEN judge_error THEN 'none' WHEN j_kind IS NOT NULL THEN j_kind ELSE type END AS kind, CASE WHEN judge_error THEN 'inconclusive' WHEN j_kind IS NOT NULL THEN 'j' ELSE subtype END AS subtype,
    round(CASE WHEN judge_error THEN 0 WHEN j_kind IS NOT NULL THEN k % 10 / 10.0 WHEN max_cosine IS NOT NULL THEN max_cosine ELSE 0 END, 6) AS confidence FROM records""", HITS + " records")
def i3_verdict_resolver(spark, d):
    return verdict.resolve(_records(spark, d)).select("hit_id", "final_strict.kind", "final_strict.subtype", F.round("final_strict.confidence", 6).alias("confidence"))


@query("SELECT trigger_uuid AS hit_id, CAST(CASE severity WHEN 'critical' THEN 0.9 ELSE 0.75 END AS DOUBLE) AS confidence FROM records WHERE embed_error", HITS + " records")
def i4_embedding_loss(spark, d):
    return verdict.resolve(_records(spark, d)).filter("embed_error").select("hit_id", "final.confidence")


@query("SELECT trigger_uuid AS hit_id, round(CASE WHEN rnk = 0 THEN m1 + m2 ELSE m1 END, 6) AS structural_n, round(m1 + m2, 6) AS structural_n_compat, len(window_refs) AS items, '1/' || len(window_refs) AS first_label FROM hits", HITS)
def i5_evidence(spark, d):
    e = verdict.evidence(_hits(spark, d), views.actions(spark, d))
    return e.select("hit_id", F.round("structural_n", 6).alias("structural_n"), F.round("structural_n_compat", 6).alias("structural_n_compat"), F.size("items").cast("long").alias("items"), F.get("items", F.lit(0))["label"].alias("first_label"))


def _verdicts(spark, d):
    """A verdict for each event: its kind by type, its confidence by id."""
    a, k = views.actions(spark, d), F.col("uuid").cast("long")
    kind = F.when(F.col("tool") == "error", "thrashing").when(F.col("tool") == "purchase", "false_success").otherwise("none")
    return a.select("session_id", k.alias("id"), kind.alias("kind"), F.lit("s").alias("subtype"), (k % 100 / 100).alias("confidence"), F.lit("r").alias("reason"), "ts", (k % 9 == 0).alias("judge_error"), (k % 8 == 0).alias("deferred"))


TABLES["verdicts"] = """SELECT session_id, CAST(uuid AS BIGINT) AS id, CASE tool WHEN 'error' THEN 'thrashing' WHEN 'purchase' THEN 'false_success' ELSE 'none' END AS kind, CAST(uuid AS BIGINT) % 100 / 100.0 AS confidence, ts,
    CAST(uuid AS BIGINT) % 9 = 0 AS judge_error, CAST(uuid AS BIGINT) % 8 = 0 AS deferred FROM actions"""
# The greedy fold: from each message the next one at least the window later, followed from the first of each key.
_SENT = """RECURSIVE actions AS ({actions}), verdicts AS ({verdicts}), v AS (SELECT id, ts, {key} AS key FROM verdicts WHERE {where}), f AS (SELECT key, ts, min(id) AS id FROM v GROUP BY ALL),
    nxt AS (SELECT a.key, a.ts, min(b.ts) AS next_ts FROM f a JOIN f b ON a.key = b.key AND b.ts >= a.ts + {window} GROUP BY ALL), sent AS (SELECT key, min(ts) AS ts FROM f GROUP BY key UNION ALL SELECT s.key, n.next_ts FROM sent s JOIN nxt n ON n.key = s.key AND n.ts = s.ts),
    out AS (SELECT f.id FROM sent s JOIN f ON f.key = s.key AND f.ts = s.ts)"""


def _sent(where: str, key: str = "session_id || '␟' || kind", window: int = DAYS_20) -> str:
    return "WITH " + _SENT.format(actions=TABLES["actions"], verdicts=TABLES["verdicts"], where=where, key=key, window=window)


_OK = "kind <> 'none' AND confidence >= 0.7"


@query(f"SELECT id FROM verdicts WHERE {_OK}", "actions verdicts")
def j1_threshold(spark, d):
    return _verdicts(spark, d).filter(routing.passes(F.col("kind"), F.col("confidence"))).select("id")


@query(f"{_sent(_OK)} SELECT id, CASE WHEN kind = 'none' THEN 'kind_none' WHEN confidence < 0.7 THEN 'below_threshold' WHEN id NOT IN (SELECT id FROM out) THEN 'debounced' END AS suppressed FROM verdicts")
def j2_suppression_reason(spark, d):
    return routing.routed(_verdicts(spark, d), Thresholds(debounce_ms=DAYS_20)).select("id", "suppressed")


@query(f"{_sent('true')} SELECT id, id IN (SELECT id FROM out) AS sent FROM verdicts")
def j3_debounce(spark, d):
    return routing.debounced(_verdicts(spark, d).withColumn("dedupe_key", routing.dedupe_key()), window_ms=DAYS_20).select("id", "sent")


@query("SELECT id, CASE WHEN confidence >= 0.85 THEN 'critical' WHEN confidence >= 0.5 THEN 'warning' ELSE 'low_confidence' END AS severity FROM verdicts", "actions verdicts")
def j4_severity(spark, d):
    return _verdicts(spark, d).select("id", routing.severity(F.col("confidence")).alias("severity"))


@query("SELECT id, session_id || '␟' || kind AS dedupe_key, CASE WHEN confidence >= 0.85 THEN 'critical' WHEN confidence >= 0.5 THEN 'warning' ELSE 'low_confidence' END AS severity, id % 50 <> 0 AND id % 51 <> 0 AS valid FROM (SELECT * REPLACE (CASE WHEN id % 50 = 0 THEN 1.5 ELSE confidence END AS confidence, CASE WHEN id % 51 = 0 THEN '' ELSE session_id END AS session_id) FROM verdicts)", "actions verdicts")
def j5_payloads(spark, d):
    """Some payloads have a confidence above 1 or no session, and are invalid."""
    v = _verdicts(spark, d).withColumns({"confidence": F.when(F.col("id") % 50 == 0, 1.5).otherwise(F.col("confidence")), "session_id": F.when(F.col("id") % 51 == 0, "").otherwise(F.col("session_id"))})
    return routing.payloads(v.withColumn("dedupe_key", routing.dedupe_key())).select("id", "dedupe_key", "severity", "valid")


@query(_sent("judge_error OR deferred", "session_id || '␟low_confidence'") + " SELECT id, id IN (SELECT id FROM out) AS sent FROM verdicts WHERE judge_error OR deferred")
def j6_low_confidence(spark, d):
    return routing.low_confidence(_verdicts(spark, d), Thresholds(low_confidence=True, debounce_ms=DAYS_20)).select("id", "sent")


@query("SELECT session_id, tool AS event_key, arg_min(CAST(uuid AS BIGINT), seq) AS id FROM actions GROUP BY ALL", "actions")
def j7_meta_once(spark, d):
    a = views.actions(spark, d).select("session_id", F.col("tool").alias("event_key"), F.col("uuid").cast("long").alias("id"), "ts")
    return routing.meta_events(a, Thresholds(debounce_ms=0)).select("session_id", "event_key", "id")


@query(f"SELECT channel, count(*) FILTER (WHERE (id + length(channel)) % 3 <> 0) AS succeeded, count(*) FILTER (WHERE (id + length(channel)) % 3 = 0) AS failed FROM verdicts, (VALUES ('cli'), ('webhook'), ('desktop')) c(channel) WHERE {_OK} GROUP BY channel", "actions verdicts")
def j8_channel_outcomes(spark, d):
    rows = _verdicts(spark, d).filter(routing.passes(F.col("kind"), F.col("confidence"))).withColumn("dedupe_key", routing.dedupe_key())
    channels = spark.createDataFrame([("cli",), ("webhook",), ("desktop",)], "channel string")
    return routing.outcomes(routing.fan_out(rows, channels).withColumn("ok", (F.col("id") + F.length("channel")) % 3 != 0))[0]


@query(f"SELECT id, id % 4 = 1 AS recorded FROM verdicts WHERE {_OK}", "actions verdicts")
def j8_message_outcomes(spark, d):
    """A message counts as sent if one of its channels succeeded."""
    rows = _verdicts(spark, d).filter(routing.passes(F.col("kind"), F.col("confidence"))).withColumn("dedupe_key", routing.dedupe_key())
    channels = spark.createDataFrame([("cli",), ("webhook",), ("desktop",)], "channel string")
    return routing.outcomes(routing.fan_out(rows, channels).withColumn("ok", (F.col("id") + F.length("channel")) % 4 == 0))[1].select("id", "recorded")
