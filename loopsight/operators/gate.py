"""Structural gate: count-based sliding windows over the last actions of a (session, agent).

A range frame on an action's number, partitioned by what must be equal, counts the equal ones among the
last H actions without a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.config import DEFAULTS, Thresholds
from ..functions.measures import jaccard

SCOPE = ["session_id", "agent_scope"]


def window(*keys: str, history: int = DEFAULTS.history) -> WindowSpec:
    """The rows of equal keys among the last ``history`` actions of the scope."""
    return Window.partitionBy(*SCOPE, *keys).orderBy("seq").rangeBetween(-(history - 1), 0)


def number_actions(actions: DataFrame) -> DataFrame:
    """seq from 1 in each scope, by ts and uuid; only actions are numbered, so nothing else moves the window."""
    return actions.withColumn("seq", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("ts", "uuid")).cast("long"))


def repeat_counts(actions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Add repeat_n and error_n, and the uuids behind them."""
    w, failed = window("tool", "arg_key", history=t.history), F.col("result_class") == "error"
    return actions.withColumns({
        "repeat_n": F.count("*").over(w), "error_n": F.count(F.when(failed, 1)).over(w),
        "repeat_refs": F.collect_list("uuid").over(w), "error_refs": F.collect_list(F.when(failed, F.col("uuid"))).over(w),
    })


def repeat_verdicts(actions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Add subtype, severity and window_refs of the repetition detector (null where it doesn't fire)."""
    rows = repeat_counts(actions, t)
    error, repeat = F.col("error_n") >= t.error_warning, F.col("repeat_n") >= t.warning
    severity = F.when(F.col("error_n") >= t.error_critical, "critical").when(error, "warning").when(F.col("repeat_n") >= t.critical, "critical").when(repeat, "warning")
    return rows.withColumns({"subtype": F.when(error, "repeat_error").when(repeat, "repeat_action"), "severity": severity, "window_refs": F.when(error, F.col("error_refs")).when(repeat, F.col("repeat_refs"))}).drop("error_refs", "repeat_refs")


def edit_counts(actions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Actions with a path, with edit_n: edits of the same raw path in the window."""
    return actions.filter(F.col("file_path").isNotNull()).withColumn("edit_n", F.count("*").over(window("file_path", history=t.history)))


def max_pairwise_jaccard(sets: Column) -> Column:
    """Greatest similarity of two of the sets; 1 for fewer than two."""
    pairs = F.flatten(F.transform(sets, lambda a, i: F.transform(F.slice(sets, i + 2, F.size(sets)), lambda b: jaccard(a, b))))
    return F.when(F.size(sets) < 2, 1.0).otherwise(F.array_max(pairs))


def _with_similarity(counted: DataFrame, history: int, least: int) -> DataFrame:
    """Add max_jaccard where edit_n reaches ``least``: the greatest similarity of two edits of the path in the window.

    A pair is compared once, at its later edit, and only where some window that reaches the count holds it; a window then takes
    the greatest of the pairs whose earlier edit it still holds.
    """
    w, path = window("file_path", history=history), Window.partitionBy(*SCOPE, "file_path").orderBy("seq")
    first = F.col("seq") - (history - 1)
    tokens = F.array_distinct(F.coalesce("edit_tokens", F.array().cast("array<string>")))
    rows = counted.withColumn("__tokens", tokens)
    rows = rows.withColumns({"__hot": F.max("edit_n").over(path.rangeBetween(0, history - 1)) >= least, "__before": F.collect_list(F.struct("seq", F.col("__tokens").alias("set"))).over(path.rowsBetween(-(history - 1), -1))})
    near = F.transform(F.filter("__before", lambda e: e["seq"] >= first), lambda e: F.struct(e["seq"].alias("seq"), jaccard(e["set"], F.col("__tokens")).alias("j")))
    rows = rows.withColumn("__near", F.when(F.col("__hot"), near)).drop("__hot", "__before", "__tokens")
    rows = rows.withColumn("__pairs", F.collect_list("__near").over(w))
    best = F.array_max(F.transform(F.filter(F.flatten("__pairs"), lambda p: p["seq"] >= first), lambda p: p["j"]))
    return rows.withColumn("max_jaccard", F.when(F.col("edit_n") >= least, F.when(F.col("edit_n") < 2, 1.0).otherwise(best))).drop("__near", "__pairs")


def edit_verdicts(actions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Edits in loops: edit_n, max_jaccard, subtype, severity, window_refs (null where the detector doesn't fire).

    Only paths that reach the count at all have rows.
    """
    rows = edit_counts(actions, t).withColumn("__most", F.max("edit_n").over(Window.partitionBy(*SCOPE, "file_path"))).filter(F.col("__most") >= t.edit_warning).drop("__most")
    rows = _with_similarity(rows.withColumn("refs", F.collect_list("uuid").over(window("file_path", history=t.history))), t.history, t.edit_warning)
    fires = (F.col("edit_n") >= t.edit_warning) & (F.col("max_jaccard") >= t.same_region)
    return rows.withColumns({"subtype": F.when(fires, "file_edit_loop"), "severity": F.when(fires & (F.col("edit_n") >= t.edit_critical), "critical").when(fires, "warning"), "window_refs": F.when(fires, F.col("refs"))}).drop("refs")


def hits(actions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row for each action at which the gate fires: the severer detector's finding, repetition before edits on ties."""
    repeats = F.create_map(F.lit("repeatN"), F.col("repeat_n").cast("double"), F.lit("errLoopN"), F.col("error_n").cast("double"))
    edits = F.create_map(F.lit("fileEditN"), F.col("edit_n").cast("double"), F.lit("maxJaccard"), F.col("max_jaccard"))
    rows = resolved(profile(actions, [t]), {0: t}, {"metrics": (repeats, edits)}).withColumn("__rank", (F.col("subtype") == "file_edit_loop").cast("int"))
    best = F.row_number().over(Window.partitionBy(*SCOPE, "trigger_uuid").orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "__rank"))
    return rows.withColumn("n", best).filter("n = 1").select(*SCOPE, "seq", "trigger_uuid", "ts", "type", "subtype", "severity", "window_refs", "metrics")


def profile(actions: DataFrame, settings: list[Thresholds]) -> DataFrame:
    """Counts and references of each action at which any of the settings fires, whatever its thresholds; one pass for all.

    repeat_n, error_n, edit_n, max_jaccard (both null without a path or below the least count), and the uuids (refs) and
    numbers (at) of the actions behind them. The settings must have one history. Both detectors' windows are within a scope, so rows are dealt once.
    """
    t = settings[0]
    if len({s.history for s in settings}) > 1:
        raise ValueError("settings of different history need a profile each")
    least = lambda name: min(getattr(s, name) for s in settings)
    w, path = window("file_path", history=t.history), F.col("file_path").isNotNull()
    rows = actions.select(*SCOPE, "seq", "uuid", "ts", "tool", "arg_key", "result_class", "file_path", "edit_tokens").withColumn("edit_n", F.when(path, F.count(F.when(path, 1)).over(w)))
    edits = F.col("edit_n") >= least("edit_warning")
    rows = _with_similarity(rows.withColumns({"edit_refs": F.collect_list(F.when(path, F.col("uuid"))).over(w), "edit_at": F.collect_list(F.when(path, F.col("seq"))).over(w)}), t.history, least("edit_warning"))
    edits = edits & (F.col("max_jaccard") >= least("same_region"))
    rows = rows.withColumns({c: F.when(edits, F.col(c)) for c in ("edit_n", "max_jaccard", "edit_refs", "edit_at")}).drop("edit_tokens", "file_path")
    same = window("tool", "arg_key", history=t.history)
    rows = rows.withColumns({"repeat_at": F.collect_list("seq").over(same), "error_at": F.collect_list(F.when(F.col("result_class") == "error", F.col("seq"))).over(same)})
    repeats, errors = F.col("repeat_n") >= least("warning"), F.col("error_n") >= least("error_warning")
    rows = repeat_counts(rows, t).filter(repeats | errors | F.col("edit_n").isNotNull())
    kept = {f"{name}_{c}": F.when(fires, F.col(f"{name}_{c}")) for name, fires in (("repeat", repeats), ("error", errors)) for c in ("refs", "at")}
    return rows.withColumns(kept).drop("tool", "arg_key", "result_class")


def resolved(profiled: DataFrame, candidates: dict[int, Thresholds], more: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Hits of each candidate (candidate and window_at beside the columns of ``hits``, without metrics), by comparing the profile with its thresholds.

    Candidates are a short list; a row is made only where one fires. more: further columns, for findings of repetition and of edits.
    """
    names = ["warning", "critical", "error_warning", "error_critical", "edit_warning", "edit_critical", "same_region"]
    listed = F.array(*[F.struct(F.lit(n).cast("long").alias("candidate"), *[F.lit(getattr(t, c)).alias(c) for c in names]) for n, t in candidates.items()])
    col = F.col
    edits = lambda c: F.coalesce((col("edit_n") >= c["edit_warning"]) & (col("max_jaccard") >= c["same_region"]), F.lit(False))
    fires = lambda c: (col("error_n") >= c["error_warning"]) | (col("repeat_n") >= c["warning"]) | edits(c)
    c = col("c")
    error = col("error_n") >= c["error_warning"]
    first = F.when(col("error_n") >= c["error_critical"], "critical").when(error, "warning").when(col("repeat_n") >= c["critical"], "critical").when(col("repeat_n") >= c["warning"], "warning")
    second = F.when(edits(c), F.when(col("edit_n") >= c["edit_critical"], "critical").otherwise("warning"))
    rows = profiled.withColumn("c", F.explode(F.filter(listed, fires))).withColumns({"__r": first, "__e": second})
    by_edit = col("__r").isNull() | ((col("__e") == "critical") & (col("__r") != "critical"))
    by_edit = F.coalesce(by_edit, F.lit(False))
    return rows.select(
        col("c.candidate").alias("candidate"), *SCOPE, "seq", col("uuid").alias("trigger_uuid"), "ts", F.lit("thrashing").alias("type"), F.when(by_edit, "file_edit_loop").when(error, "repeat_error").otherwise("repeat_action").alias("subtype"),
        F.when(by_edit, col("__e")).otherwise(col("__r")).alias("severity"), F.when(by_edit, col("edit_refs")).when(error, col("error_refs")).otherwise(col("repeat_refs")).alias("window_refs"),
        F.when(by_edit, col("edit_at")).when(error, col("error_at")).otherwise(col("repeat_at")).alias("window_at"),
        *[F.when(by_edit, b).otherwise(a).alias(name) for name, (a, b) in (more or {}).items()],
    )


def keyed_counters(actions: DataFrame, t: Thresholds = DEFAULTS, by_class: bool = False) -> DataFrame:
    """Add n, first_ts, last_ts and uuids of the window's actions of equal key (and result class)."""
    w = window("arg_key", *(["result_class"] if by_class else []), history=t.history)
    return actions.withColumns({"n": F.count("*").over(w), "first_ts": F.min("ts").over(w), "last_ts": F.max("ts").over(w), "uuids": F.collect_list("uuid").over(w)})


def gate_passed(candidates: DataFrame) -> DataFrame:
    return candidates.filter("gate_passed")


def self_check(events: DataFrame, found: DataFrame) -> DataFrame:
    """session_id, events, hits, thrashing, max_severity of every session."""
    rank = F.max(F.when(F.col("severity") == "critical", 2).otherwise(1))
    h = found.groupBy("session_id").agg(F.count("*").alias("hits"), rank.alias("rank"))
    rows = events.groupBy("session_id").agg(F.count("*").alias("events")).join(h, "session_id", "left")
    return rows.select("session_id", "events", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.col("hits").isNotNull().alias("thrashing"), F.when(F.col("rank") == 2, "critical").when(F.col("rank") == 1, "warning").otherwise("none").alias("max_severity"))
