"""Registered queries of this subpackage: thin wrappers that derive the contracted columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, html, jaccard, lexical, license, mixing, quality, rans, repair, toxicity, warc
from .common import materialise, scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = materialise(quality.with_counts(docs).drop("text"), "counts")
    out = quality.judge(counted, quality.fit(counted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    rans.write_ids(table(spark, sf_dir, "documents"), TOKENIZER, path)
    return rans.read_ids(spark, path, with_ids=False)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_round_trip(docs, TOKENIZER).drop("text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = license.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return docs.select("doc_id", F.size("licenses").alias("n_found"), F.explode_outer("licenses").alias("l")).select("doc_id", "n_found", "l.*")


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "copy", "source", "shuffle_key", "text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.digest(chat.format_chats(rows.unionByName(trap)), in_order=True)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    index = materialise(warc.index(spark, path), "warc-index")
    return warc.resolved(warc.read(index))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damage(rows), rows.select("conv_id"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


# The mixture in SQL: rates by source, the distribution function at 0, 1, 2, ..., and how many of its values u reaches.
_MIX = """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
steps AS (SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM rates, range(0, 200) t(k)),
docs AS (SELECT *, CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u) AS n FROM docs d)
SELECT doc_id, CAST(k AS INT) AS copy, source, md5('17 order:' || doc_id || ':' || k) AS shuffle_key, text FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM counted)"""

_CHATS = r"""WITH rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[SEP\]')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""

# All pairs by their common shingles, and what links reach.
_JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), shared AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1), t AS (SELECT s.* FROM s JOIN shared USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) r ON r.doc_id = d.doc_id"""


# Every document scored for every item from the definition; a row of documents is told apart by its number.
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_TERMS = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_TERM})) AS t"
_RANKED = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), words AS (SELECT r, {_TERMS} FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM words GROUP BY ALL), n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM n), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
q AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, {_TERMS} FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
m AS (SELECT r, 100 - 25 + (25 * n * nd) // nt AS m FROM n, total),
s AS (SELECT i, item_id, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0) WHERE rank <= 20"""

_WARC = """SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to
FROM (SELECT *, strlen(h) >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top AS again FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages))"""

# crc32 byte by byte; then each conversation's rows from the last to the first, with the best (cost, audit, text) of each grammar
# state: 1 start, 2 after s, 3 after u, 4 after a. Costs over 9999 mean that there is no way.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen({k}) + 1), lambda i: CAST(ord(substr({k}, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_EDIT = "{{'c': {c} + {n}.c, 'a': '{e}' || {n}.a, 't': {t} || {n}.t}}"
_NO = "{'c': 99999, 'a': '', 't': ''}"


def _state(s: int, n: str) -> str:
    """The best edit other than Insert at a row, from a state; n: the states' results after the row."""
    to, role = {1: (3, "user"), 2: (3, "user"), 3: (4, "assistant"), 4: (3, "user")}[s]
    kept = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}[s]
    line = "chr(10) || {r} || ':' || text"
    keeps = " ".join(f"WHEN initial = '{i}' THEN {_EDIT.format(c='late', n=f'{n}{k}', e='K', t=line.format(r='role'))}" for i, k in kept.items())
    reroled = _EDIT.format(c="2 + late", n=f"{n}{to}", e="R", t=line.format(r=f"'{role}'"))
    deleted = _EDIT.format(c="3", n=f"{n}{s}", e="D", t="''")
    return f"list_min([{deleted}, CASE WHEN must THEN {_NO} ELSE {reroled} END, CASE WHEN must THEN {_NO} {keeps} ELSE {_NO} END])"


def _inserted(to: str, role: str) -> str:
    return _EDIT.format(c="2", n=to, e="I", t=f"chr(10) || '{role}:'")


def _best(rows: str) -> str:
    """The states' best results with Insert: after s or at the start a user row, after u an assistant row, after a a user row."""
    return f"""SELECT conv, pos, list_min([p1, {_inserted('u', 'user')}]) AS b1, list_min([p2, {_inserted('u', 'user')}]) AS b2, u AS b3, a AS b4
    FROM (SELECT *, list_min([p3, {_inserted('p4', 'assistant')}]) AS u, list_min([p4, {_inserted('p3', 'user')}]) AS a FROM ({rows}))"""


_END = f"SELECT conv, last + 1 AS pos, {{'c': 0, 'a': '', 't': ''}} AS p1, {_NO} AS p2, {_NO} AS p3, {{'c': 0, 'a': '', 't': ''}} AS p4 FROM counts"
_STEP = f"SELECT r.conv, r.pos, {', '.join(f'{_state(s, chr(98))} AS p{s}' for s in (1, 2, 3, 4))} FROM best JOIN flagged r ON r.conv = best.conv AND r.pos = best.pos - 1"
_KEY = "(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))"
_FIELDS = r"'[^\x20\x09-\x0D]'"
_REPAIR = rf"""WITH RECURSIVE damaged AS (SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS conv, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
    FROM (SELECT *, {_CRC.format(k=_KEY)} % 20 AS k FROM conversations)),
numbered AS (SELECT conv, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
flagged AS (SELECT *, blank OR seen AS must, CASE WHEN cut THEN 1 ELSE 0 END AS late FROM (SELECT *, NOT regexp_matches(text, {_FIELDS}) AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS cut, coalesce(lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS wrong FROM numbered)),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE seen AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut AND NOT seen AND NOT blank) AS truncated, count(*) FILTER (WHERE wrong) AS illegal, max(pos) AS last FROM flagged GROUP BY conv),
best AS ({_best(_END)} UNION ALL {_best(_STEP)}),
found AS (SELECT conv, b1 FROM best WHERE pos = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b1.c, 0) AS BIGINT) AS cost, coalesce(b1.a, '') AS audit,
    sha256(coalesce(substr(b1.t, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv = coalesce(CAST(o.conv_id AS VARCHAR), '') LEFT JOIN found ON found.conv = c.conv"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can state a result: fitted, approximate and tokenizer jobs are tested against brute force instead."""
    return {"op6_poisson_mixing": _MIX, "op9_chat_formatting": _CHATS, "op10_ngram_jaccard_join": _JACCARD, "op11_ranked_lexical_search": _RANKED, "op12_warc": _WARC, "op13_conversation_repair": _REPAIR}
