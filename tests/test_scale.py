"""Work that must grow with the input and no faster: rows that are made and stored, reads and shuffles of a plan."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loopsight.functions.config import Thresholds
from loopsight.operators import evaluate, gate, prefix
from loopsight.plans import evaluate_queries
from loopsight.sources import views
from loopsight.sources.scratch import shared_folder

SF = "/root/testdata/sf0.001"
LABELS = "label_id string, session_id string, fold int, start_uuid string, end_uuid string"
PREDS = "candidate long, pred_id string, session_id string, agent_scope string, window_refs array<string>, window_at array<long>, seq long"


def _stored_rows(spark) -> int:
    return sum(pq.ParquetFile(os.path.join(top, f)).metadata.num_rows for top, _, files in os.walk(shared_folder(spark)) for f in files if f.endswith(".parquet"))


def test_hits_read_and_deal_the_actions_once(spark):
    plan = gate.hits(views.actions(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_similarity_of_pairs_is_that_of_whole_windows(spark):
    """Pairs compared once give each window's greatest similarity, as a comparison of all its sets does."""
    r = random.Random(4)
    rows = [("s", "root", k, f"u{k:03}", k, "Edit", "k", "ok", r.choice([None, "f", "g"]), r.sample("abcdefgh", r.randrange(4)) or None) for k in range(1, 150)]
    a = spark.createDataFrame(rows, "session_id string, agent_scope string, seq long, uuid string, ts long, tool string, arg_key string, result_class string, file_path string, edit_tokens array<string>")
    for least in (1, 4):
        found = {x["uuid"]: x["max_jaccard"] for x in gate.edit_verdicts(a, Thresholds(history=9, edit_warning=least)).filter("max_jaccard is not null").collect()}
        want = {}
        for n, x in enumerate(rows):
            sets = [set(y[9] or []) for y in rows[: n + 1] if y[8] == x[8] and x[2] - y[2] < 9]
            if x[8] and len(sets) >= least:
                want[x[3]] = max((len(p & q) / len(p | q) if p | q else 1.0 for i, p in enumerate(sets) for q in sets[i + 1 :]), default=1.0)
        assert found == pytest.approx(want)


def test_overlapping_spans_store_no_row_for_each_action(spark):
    actions = spark.createDataFrame([("s", "root", k, f"u{k}") for k in range(60)], "session_id string, agent_scope string, seq long, uuid string")
    labels = spark.createDataFrame([(f"g{k}", "s", 0, "u0", f"u{59 - k % 2}") for k in range(40)], LABELS)
    preds = spark.createDataFrame([(0, f"p{k}", "s", "root", [f"u{x}" for x in range(k, k + 20)], list(range(k, k + 20)), k + 19) for k in range(40)], PREDS)
    before = _stored_rows(spark)
    assert evaluate.span_matches(labels, actions, preds).count() == 0
    assert _stored_rows(spark) - before <= 2 * 40


def test_matches_of_folds_candidates_and_scopes_like_a_plain_loop(spark):
    """With the numbers of references and without them."""
    r, actions, labels, preds = random.Random(9), [], [], []
    for s in ("x", "y"):
        for scope in ("root", "sub"):
            actions += [(s, scope, k, f"{s}-{scope}-{k}") for k in range(-40, 160)]
        of = {u: k for t, _, k, u in actions if t == s}
        for n in range(30):
            a = r.randrange(-40, 120)
            ends = [f"{s}-{r.choice(['root', 'sub'])}-{x}" for x in (a, a + r.randrange(-1, 25))]
            labels.append((f"g{s}{n}", s, n % 2, *(e if e in of else "gone" for e in ends)))
        for n in range(60):
            scope, at = r.choice(["root", "sub"]), r.randrange(-20, 150)
            refs = sorted(r.sample(range(at - 19, at + 1), r.randrange(3, 14)))
            preds.append((n % 3, f"p{s}{n}", s, scope, [f"{s}-{scope}-{x}" for x in refs], refs, at))
    want = {}
    at = {u: (s, k) for s, _, k, u in actions}
    for g, s, fold, first, last in labels:
        tips = {u for _, t, f, *ends in labels if (t, f) == (s, fold) for u in ends if u in at}
        for c, p, t, _, refs, _, _ in preds:
            if t == s and first in at and last in at:
                structural = tips | {u for d, _, v, _, x, _, _ in preds if (d, v) == (c, s) for u in x}
                span = {u for u in structural if at[first][1] <= at[u][1] <= at[last][1]}
                score = len(span & set(refs)) / max(1, len(span | set(refs)))
                if score >= 0.3:
                    want[g, p] = round(score, 9)
    a = spark.createDataFrame(actions, "session_id string, agent_scope string, seq long, uuid string")
    g, p = spark.createDataFrame(labels, LABELS), spark.createDataFrame(preds, PREDS)
    for given in (p, p.drop("window_at")):
        found = evaluate.span_matches(g, a, given, Thresholds(iou=0.3), ("fold",), ("candidate",)).collect()
        assert {(x["label_id"], x["pred_id"]): round(x["iou"], 9) for x in found} == want and len(want) > 20 and len(found) == len(want)


def test_best_overlaps_are_the_scores_of_whole_sets(spark):
    a = views.actions(spark, SF)
    found = gate.resolved(gate.profile(a, [Thresholds()]), {0: Thresholds()})
    preds = found.select(F.col("trigger_uuid").alias("pred_id"), "session_id", "agent_scope", "window_refs", "window_at", "seq")
    labels = found.filter("severity = 'critical'").select("trigger_uuid", "session_id", F.element_at("window_refs", 1).alias("start_uuid"), F.element_at("window_refs", -1).alias("end_uuid")).withColumnRenamed("trigger_uuid", "label_id")
    rows = lambda df: sorted((x["label_id"], round(x["score"], 9)) for x in df.collect())
    assert rows(evaluate.best_overlaps(labels, a, preds)) == rows(evaluate.span_scores(evaluate.span_uuids(labels, a), preds))


class _Handle:
    """Counts messages to a key's timers and states, which hold what they were given."""

    def __init__(self):
        self.timers, self.calls, self.states = [], 0, {}

    def listTimers(self):
        self.calls += 1
        return iter(list(self.timers))

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)

    def registerTimer(self, t):
        self.calls += 1
        self.timers.append(t)

    def _state(self, name, *_):
        handle, held = self, self.states.setdefault(name, [])

        class State:
            def __getattr__(self, call):
                handle.calls += 1
                return {"exists": lambda: bool(held), "get": lambda: (held[0] if held else None) if name == "last" else iter(list(held)), "clear": held.clear, "appendList": held.extend, "put": lambda x: held.__setitem__(slice(None), x), "update": lambda x: held.__setitem__(slice(None), [x])}[call]

        return State()

    getValueState = getListState = _state


def test_a_key_with_waiting_messages_costs_few_state_calls():
    import pandas as pd

    from loopsight.streaming.ledger import Debounce

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    handle, times, debounce, sent = _Handle(), Times(), Debounce(50), []
    debounce.init(handle)
    for n, (ts, now) in enumerate([(10, 0), (30, 0), (5, 0), (70, 20), (75, 40)]):
        times.now = now
        for t in [t for t in handle.timers if t <= now]:
            sent += [r for part in debounce.handleExpiredTimer(("k",), times, None) for r in part["ts"]]
            handle.timers.remove(t)
        before = handle.calls
        assert list(debounce.handleInputRows(("k",), iter([pd.DataFrame({"ts": [ts], "id": [n]})]), times)) == []
        assert handle.calls - before <= 4 and len(handle.timers) == 1
    while handle.timers:
        times.now = handle.timers[0]
        sent += [r for part in debounce.handleExpiredTimer(("k",), times, None) for r in part["ts"]]
        handle.timers.pop(0)
    assert sent == [5, 70] and not handle.states["pending"] and not handle.states["last"]


def test_numbers_make_their_rows_once(spark):
    """The ranges' sample must not run what the rows are made by a second time."""
    made = spark.sparkContext.accumulator(0)

    def value(x):
        made.add(1)
        return x % 7

    rows = spark.range(5000, numPartitions=4).withColumn("v", F.udf(value, "long")("id"))
    found = prefix.numbered(rows, "n", ["id"], ["v"])
    assert found.filter(F.col("n") != F.floor(F.col("id") / 7) + 1).count() == 0 and made.value == 5000


def test_set_iou_deals_actions_once(spark):
    """Spans and predictions come from one pass over the actions, and store nothing."""
    before = _stored_rows(spark)
    plan = evaluate_queries.k2_set_iou(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan and _stored_rows(spark) == before
