"""Registered queries: name, Spark job over a folder of tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Domain tables in SQL, as ``sources.views`` and the gate make them; a query names those it needs, in order.
TABLES = {
    "actions": r"""SELECT CAST(user_id AS VARCHAR) AS session_id, 'root' AS agent_scope, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
        CAST(event_id AS VARCHAR) AS uuid, epoch_us(ts) // 1000 AS ts, event_type AS tool, event_type AS arg_key, event_type || ':' || substr(sha256(props), 1, 16) AS fine_key,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS result_class, CASE WHEN event_type <> 'signup' THEN event_type END AS file_path,
        [x for x in string_split_regex(event_type || ' ' || props, '\s+') if x <> ''] AS edit_tokens FROM events""",
    "rep": """SELECT *, count(*) OVER w AS repeat_n, count(*) FILTER (WHERE result_class = 'error') OVER w AS error_n, list(uuid) OVER w AS repeat_refs, list(uuid) FILTER (WHERE result_class = 'error') OVER w AS error_refs
        FROM actions WINDOW w AS (PARTITION BY session_id, agent_scope, tool, arg_key ORDER BY seq RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "repv": """SELECT *, CASE WHEN error_n >= 5 THEN 'critical' WHEN error_n >= 3 THEN 'warning' WHEN repeat_n >= 20 THEN 'critical' WHEN repeat_n >= 10 THEN 'warning' END AS severity,
        CASE WHEN error_n >= 3 THEN 'repeat_error' WHEN repeat_n >= 10 THEN 'repeat_action' END AS subtype, CASE WHEN error_n >= 3 THEN error_refs WHEN repeat_n >= 10 THEN repeat_refs END AS window_refs FROM rep""",
    "ed": """SELECT *, list_distinct(edit_tokens) AS tk, count(*) OVER w AS edit_n, list(uuid) OVER w AS refs FROM actions WHERE file_path IS NOT NULL
        WINDOW w AS (PARTITION BY session_id, agent_scope, file_path ORDER BY seq RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "edp": """SELECT b.session_id, b.file_path, b.seq AS s1, c.seq AS s2, len(list_intersect(b.tk, c.tk)) / len(list_distinct(list_concat(b.tk, c.tk))) AS j
        FROM ed b JOIN ed c ON b.session_id = c.session_id AND b.file_path = c.file_path AND c.seq > b.seq AND c.seq - b.seq <= 29""",
    "edm": """SELECT a.uuid, max(p.j) AS max_jaccard FROM ed a JOIN edp p ON p.session_id = a.session_id AND p.file_path = a.file_path AND p.s2 <= a.seq AND p.s1 >= a.seq - 29 WHERE a.edit_n >= 5 GROUP BY a.uuid""",
    "edv": """SELECT ed.*, max_jaccard, CASE WHEN edit_n >= 8 AND max_jaccard >= 0.3 THEN 'critical' WHEN edit_n >= 5 AND max_jaccard >= 0.3 THEN 'warning' END AS severity FROM ed LEFT JOIN edm ON ed.uuid = edm.uuid""",
    "cand": """SELECT session_id, seq, uuid, ts, subtype, severity, window_refs, error_n + repeat_n AS structural, 0 AS rnk, repeat_n AS m1, CAST(error_n AS DOUBLE) AS m2 FROM repv WHERE severity IS NOT NULL
        UNION ALL SELECT session_id, seq, uuid, ts, 'file_edit_loop', severity, refs, edit_n, 1, edit_n, max_jaccard FROM edv WHERE severity IS NOT NULL""",
    "hits": """SELECT session_id, seq, uuid AS trigger_uuid, ts, 'thrashing' AS type, subtype, severity, window_refs, structural, m1, m2, rnk
        FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, rnk) AS n FROM cand) WHERE n = 1""",
    "threads": """SELECT CAST(conv_id AS VARCHAR) AS session_id, 'root' AS agent_scope, conv_id || '-' || turn AS uuid, CASE WHEN lag(turn) OVER w IS NOT NULL THEN conv_id || '-' || lag(turn) OVER w END AS parent_uuid, turn AS seq, turn * 1000 AS ts, turn * 100 AS byte_offset, role, text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "branches": """SELECT session_id, session_id || '-' || g AS uuid, CASE WHEN up IS NOT NULL THEN session_id || '-' || up END AS parent_uuid, g // 4 * 1000 AS ts, g * 7919 % 100003 AS byte_offset
        FROM (SELECT *, CASE WHEN g % 11 <> 0 AND g > 1 THEN CASE WHEN g % 4 IN (1, 2) THEN g - 1 ELSE g // 2 END END AS up FROM (SELECT CAST(conv_id % 40 AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id, turn) AS g FROM conversations))""",
    "gold": """SELECT 'L' || doc_id AS label_id, doc_id, CASE WHEN quality = 0 THEN 'thrashing' WHEN doc_id % 3 = 0 THEN 'false_success' ELSE 'none' END AS gold, CASE WHEN toxic = 1 THEN 'thrashing' WHEN doc_id % 3 = 0 AND quality = 1 AND doc_id % 2 = 0 THEN 'false_success' WHEN quality = 0 AND doc_id % 5 <> 0 THEN 'thrashing' ELSE 'none' END AS pred FROM labels""",
    "cells": """SELECT k.kind, count(*) FILTER (WHERE gold = k.kind AND pred = k.kind) AS tp, count(*) FILTER (WHERE gold <> k.kind AND pred = k.kind) AS fp, count(*) FILTER (WHERE gold = k.kind AND pred <> k.kind) AS fn, count(*) FILTER (WHERE gold <> k.kind AND pred <> k.kind) AS tn
        FROM gold CROSS JOIN (VALUES ('thrashing'), ('false_success'), ('none')) k(kind) GROUP BY k.kind""",
}


def with_tables(names: str, select: str) -> str:
    """A statement over the named domain tables; one that begins with a comma adds (recursive) tables of its own."""
    return ("WITH RECURSIVE " if select.startswith(",") else "WITH ") + ", ".join(f"{n} AS ({TABLES[n]})" for n in names.split()) + " " + select


HITS = "actions rep repv ed edp edm edv cand hits"


def query(sql: str | None = None, tables: str = "") -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(tables, sql) if tables else sql
        return f

    return add
