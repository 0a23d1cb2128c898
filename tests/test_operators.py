"""Small cases with results worked out by hand: thresholds, ties, empty input, order of rows."""

import random

import pytest
from pyspark.sql import functions as F

from loopsight.functions import text as tx
from loopsight.functions.config import Thresholds
from loopsight.functions.measures import checked_cosine, cosine, iou, jaccard, wilson
from loopsight.operators import evaluate, fingerprint, gate, judge, ordering, routing, semantic, verdict
from loopsight.sources import logs, tables

ACTION = "session_id string, agent_scope string, seq long, uuid string, ts long, tool string, arg_key string, result_class string, file_path string, edit_tokens array<string>"


def actions(spark, n, key="k", result="ok", path=None, tokens=None, session="s", scope="root"):
    return spark.createDataFrame([(session, scope, i + 1, f"{session}-{scope}-{i}", i * 1000, "Bash", key, result, path, tokens) for i in range(n)], ACTION)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "severity"), [(9, None), (10, "warning"), (19, "warning"), (20, "critical")])
def test_repeats_at_the_thresholds(spark, n, severity):
    last = gate.repeat_verdicts(actions(spark, n)).filter(F.col("seq") == n).first()
    assert last["severity"] == severity


@pytest.mark.parametrize(("n", "severity"), [(2, None), (3, "warning"), (4, "warning"), (5, "critical")])
def test_error_loops_at_the_thresholds(spark, n, severity):
    last = gate.repeat_verdicts(actions(spark, n, result="error")).filter(F.col("seq") == n).first()
    assert last["severity"] == severity


def test_the_window_forgets(spark):
    rows = gate.repeat_counts(actions(spark, 40))
    assert rows.agg(F.max("repeat_n")).first()[0] == 30


def test_sessions_and_scopes_count_apart(spark):
    rows = actions(spark, 6, session="a").unionByName(actions(spark, 6, session="b")).unionByName(actions(spark, 6, session="a", scope="x"))
    assert gate.hits(rows).count() == 0


def test_edits_of_one_region_fire_and_unrelated_ones_do_not(spark):
    t = Thresholds(edit_warning=3, edit_critical=5)
    same = actions(spark, 3, path="f", tokens=["a", "b", "c"])
    assert [r["severity"] for r in gate.hits(same, t).collect()] == ["warning"]
    assert [r["severity"] for r in gate.hits(actions(spark, 5, path="f", tokens=["a"]), t).orderBy("seq").collect()] == ["warning", "warning", "critical"]
    other = spark.createDataFrame([("s", "root", i, f"u{i}", i, "Edit", f"k{i}", "ok", "f", [f"x{i}", f"y{i}"]) for i in range(1, 4)], ACTION)
    assert gate.hits(other, t).count() == 0
    assert gate.hits(actions(spark, 2, path="f", tokens=["a"]), t).count() == 0
    assert gate.hits(actions(spark, 0), t).count() == 0


def test_hits_do_not_depend_on_row_order(spark):
    rows = actions(spark, 25, result="error").collect()
    want = sorted(map(str, gate.hits(spark.createDataFrame(rows, ACTION)).collect()))
    random.Random(1).shuffle(rows)
    assert sorted(map(str, gate.hits(spark.createDataFrame(rows, ACTION)).collect())) == want


@pytest.mark.parametrize(("text", "want"), [("--port=8080 x", "--port <PORT> x"), ("--port 70000", "--port 70000"), ("-p 0", "-p 0"), ("a -p=22", "a -p <PORT>"), ("x-p 22", "x-p 22"), ("h:65535", "h:<PORT>"), ("h:65536", "h:65536"), ("h:00080", "h:<PORT>")])
def test_ports(spark, text, want):
    assert one(spark, tx.mask_ports(F.lit(text))) == want


@pytest.mark.parametrize(("path", "want"), [("/a/./b//c/", "/a/b/c"), ("/a/../../b", "/b"), ("a/../..", ".."), ("./", "."), ("", tx.NO_PATH), (None, tx.NO_PATH), ("../x", "../x")])
def test_paths(spark, path, want):
    assert one(spark, tx.normalize_path(F.lit(path).cast("string"))) == want


def test_paths_of_pages_fold_like_a_plain_loop(spark):
    import posixpath

    from loopsight.plans import catalog
    from loopsight.sources import views

    sf = "/root/testdata/sf0.001"
    raw = views.table(spark, sf, "pages").select("page_id", F.concat(F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1), F.lit("/./a//../b/")).alias("p"))
    want = {r["page_id"]: posixpath.normpath(r["p"]) for r in raw.collect()}
    assert {r["page_id"]: r["path"] for r in catalog.detect_queries.d7_normalize_path(spark, sf).collect()} == want


def test_canonical_json_at_any_depth(spark):
    c = lambda text: one(spark, tx.canonical_json(F.lit(text)))
    assert c('{"a":{"y":2,"x":1}}') == c('{ "a" : {"x":1, "y":2} }') == '{"a":{"x":1,"y":2}}'
    assert c('{"k":1}') != c('{"k":"1"}') and c('{"a":"x\\",\\"b\\":\\"y"}') != c('{"a":"x","b":"y"}')
    assert c('[{"b":[{"d":1,"c":2}],"a":null}]') == '[{"a":null,"b":[{"c":2,"d":1}]}]'
    assert c('{"n":1.50}') == c('{"n":1.5}') and c("no json") == "no json" and c('{"a":1,"a":2}') == '{"a":1,"a":2}'
    key = lambda text: one(spark, fingerprint.arg_key(F.lit("mcp__x"), F.lit(text)))
    assert key('{"q":{"b":1,"a":[2]}}') == key('{"q":{"a":[2],"b":1}}') != key('{"q":{"a":["2"],"b":1}}')


def test_similarities(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")
    assert one(spark, cosine(a(1, 0), a(0, 0))) == 0
    assert one(spark, cosine(a(1, 0), a(1, 0, 0))) is None
    assert one(spark, cosine(a(3, 4), a(6, 8))) == pytest.approx(1) == one(spark, checked_cosine(a(3, 4), a(6, 8)))
    with pytest.raises(Exception, match="vectors of 2 and 3"):
        one(spark, checked_cosine(a(1, 0), a(1, 0, 0)))
    assert one(spark, jaccard(a(), a())) == 1
    assert one(spark, iou(a(), a(1))) == 0


def test_top_k_over_partitions_and_blocks(spark):
    r = random.Random(6)
    rows = [(k, [float(r.randrange(-3, 4)) for _ in range(3)], r.choice(["m", "n"])) for k in range(90)] + [(90, [0.0, 0.0, 0.0], "m"), (91, [1.0, 2.0], "m"), (92, None, "m")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, model string").repartition(5)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5 or 1)
    for block in (1000, 3):
        found = {}
        for x in semantic.top_k(v, v.filter("vec_id % 10 = 0 or vec_id > 89"), 7, block).collect():
            found.setdefault(x["query_id"], []).append((x["rank"], round(x["cos"], 9)))
        for i, e, m in rows:
            if e and (i % 10 == 0 or i > 89):
                want = sorted((round(cos(e, w), 9) for j, w, n in rows if j != i and n == m and w and len(w) == len(e)), reverse=True)[:7]
                assert [c for _, c in sorted(found.get(i, []))] == pytest.approx(want)


def test_wilson(spark):
    assert [one(spark, c) for c in wilson(F.lit(0), F.lit(0))] == [0, 0, 1]
    with pytest.raises(Exception, match="hits"):
        one(spark, wilson(F.lit(3), F.lit(2))[0])


def test_strong_at_the_threshold_and_single_triples(spark):
    g = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0])], "hit_id long, pos int, vector array<double>")
    found = {r["hit_id"]: r for r in semantic.signals(semantic.max_cosine(g, semantic.pairs(g, "hit_id", "pos"), "hit_id"), Thresholds(similar=1.0)).collect()}
    assert found[1]["strong"] and found[2]["max_cosine"] == 0 and not found[2]["strong"]


@pytest.mark.parametrize(("raw", "tag", "kind"), [("", "empty_input", None), ("nope", "invalid_json", None), ('{"kind":"thrashing","confidence":1.2,"reason":"r"}', "schema_mismatch", None), ('```json\n{"kind":"none","confidence":1,"reason":"r","subtype":null}\n```', None, "none")])
def test_replies(spark, raw, tag, kind):
    r = judge.validated(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r["error_tag"], r["kind"]) == (tag, kind)
    if kind:
        assert r["subtype"] == ""


def test_vote_ties_and_empty_votes(spark):
    hits = spark.createDataFrame([("a",), ("b",)], "hit_id string")
    s = spark.createDataFrame([("a", k, n, 0.5, "s", "r") for n, k in enumerate(["none", "false_success", "thrashing"])], "hit_id string, kind string, sample_no int, confidence double, subtype string, reason string")
    found = {r["hit_id"]: r for r in judge.majority(hits, s).collect()}
    assert found["a"]["kind"] == "thrashing" and (found["b"]["kind"], found["b"]["confidence"]) == ("none", 0)


def test_lost_embeddings_and_failed_judges(spark):
    h = spark.createDataFrame([("a", "thrashing", "x", "critical"), ("b", "false_success", "x", "warning"), ("c", "thrashing", "x", "warning")], "hit_id string, type string, subtype string, severity string")
    e = spark.createDataFrame([("a", None, True), ("b", None, True), ("c", 0.95, False)], "hit_id string, max_cosine double, embed_error boolean")
    j = spark.createDataFrame([("c", "none", "", 0.1, "r", True)], "hit_id string, kind string, subtype string, confidence double, reason string, judge_error boolean")
    found = {r["hit_id"]: r for r in verdict.resolve(verdict.merge_stages(h, e, j)).collect()}
    assert set(found) == {"a", "c"} and found["a"]["final"]["confidence"] == 0.9
    assert (found["c"]["final"]["kind"], found["c"]["final_strict"]["subtype"]) == ("thrashing", "inconclusive")


def test_debounce_counts_from_the_last_sent(spark):
    m = spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 40, 80, 120, 140])], "dedupe_key string, id long, ts long")
    assert [r["ts"] for r in routing.debounced(m, window_ms=60).filter("sent").orderBy("ts").collect()] == [0, 80, 140]
    assert routing.debounced(m, window_ms=0).filter("sent").count() == 5


def test_greedy_pairs_like_a_plain_loop(spark):
    r = random.Random(3)
    rows = sorted({(f"g{r.randrange(8)}", "s", f"p{r.randrange(8)}") for _ in range(40)})
    matches = [(*x, r.randrange(6)) for x in rows]
    used, taken, want = set(), set(), set()
    for g, _, p, _ in sorted(matches, key=lambda x: (int(x[0][1:]), x[3], x[2])):
        if g not in taken and p not in used:
            taken.add(g), used.add(p), want.add((g, p))
    order = spark.createDataFrame([(f"g{k}", k) for k in range(8)], "label_id string, gold_n long")
    rows = [(*x, 0, 0, 9) for x in matches]
    found = evaluate.greedy_pairs(spark.createDataFrame(rows, "label_id string, session_id string, pred_id string, delta long, p long, lo long, hi long"), order, F.col("delta"))
    assert {(x["label_id"], x["pred_id"]) for x in found.collect()} == want


def test_spans_and_anchors_at_the_thresholds(spark):
    a = actions(spark, 20)
    labels = spark.createDataFrame([("L", "s", "s-root-0", "s-root-3", "s-root-0"), ("M", "s", "s-root-3", "s-root-0", "s-root-0")], "label_id string, session_id string, start_uuid string, end_uuid string, anchor_uuid string")
    preds = spark.createDataFrame([("p", "s", "s-root-5", ["s-root-0", "s-root-1"], 5), ("q", "s", "s-root-6", ["s-root-0"], 6)], "pred_id string, session_id string, anchor_uuid string, window_refs array<string>, seq long")
    assert [(r["label_id"], r["pred_id"]) for r in evaluate.span_matches(labels, a, preds).collect()] == [("L", "p")]
    assert {r["pred_id"] for r in evaluate.anchor_matches(labels, preds, a).collect()} == {"p"}


def _paired_by_loop(order, golds, preds, k=5):
    """Labels in order: loops take the free prediction of greatest overlap over structural actions, others the nearest free one."""
    used, out, structural = set(), set(), {u for p in preds if p["kind"] == "thrashing" for u in p["window_refs"]} | {u for g in golds if g["gold"] == "thrashing" for u in (g["start_uuid"], g["end_uuid"])}
    for g in sorted(golds, key=lambda g: (g["gold_n"], g["label_id"])):
        best = None
        for n, p in enumerate(preds):
            if n in used or p["kind"] != g["gold"]:
                continue
            if g["gold"] == "thrashing":
                a, b = order[g["start_uuid"]], order[g["end_uuid"]]
                span, refs = {u for u, at in order.items() if a <= at <= b and u in structural}, set(p["window_refs"])
                score = -len(span & refs) / max(1, len(span | refs))
                if score > -0.5:
                    continue
            else:
                score = abs(order[p["anchor_uuid"]] - order[g["anchor_uuid"]])
                if score > k:
                    continue
            best = min(best or (score, n), (score, n))
        if best:
            used.add(best[1])
            out.add((g["label_id"], preds[best[1]]["pred_id"]))
    return out


def test_both_kinds_are_paired_like_a_plain_loop(spark):
    r, golds, preds, actions_, want = random.Random(11), [], [], [], set()
    for s in ("x", "y"):
        order = {f"{s}{k}": k for k in range(120)}
        actions_ += [(s, u, k) for u, k in order.items()]
        own_g, own_p = [], []
        for n in range(25):
            a = r.randrange(100)
            b, kind = a + r.randrange(12), r.choice(["thrashing", "false_success"])
            own_g.append({"label_id": f"g{s}{n:02}", "session_id": s, "gold": kind, "gold_n": b, "start_uuid": f"{s}{a}", "end_uuid": f"{s}{b}", "anchor_uuid": f"{s}{b}"})
        for n, at in enumerate(sorted(r.randrange(15, 120) for _ in range(40))):
            own_p.append({"pred_id": f"p{s}{n:02}", "session_id": s, "kind": r.choice(["thrashing", "false_success"]), "anchor_uuid": f"{s}{at}", "window_refs": sorted(f"{s}{x}" for x in r.sample(range(at - 14, at + 1), r.randrange(2, 9))), "seq": at})
        want |= _paired_by_loop(order, own_g, own_p)
        golds, preds = golds + own_g, preds + own_p
    rows = lambda data, schema: spark.createDataFrame([tuple(x.values()) for x in data], schema).repartition(3)
    g = rows(golds, "label_id string, session_id string, gold string, gold_n long, start_uuid string, end_uuid string, anchor_uuid string")
    p = rows(preds, "pred_id string, session_id string, kind string, anchor_uuid string, window_refs array<string>, seq long")
    found = evaluate.mixed_pairs(g, p, spark.createDataFrame(actions_, "session_id string, uuid string, seq long"))
    assert {(x["label_id"], x["pred_id"]) for x in found.collect()} == want and len(want) > 15


def test_other_actions_within_a_span_do_not_count(spark):
    """A loop on every fourth action matches its span of 17, whose other twelve actions are no part of any finding."""
    a, refs = actions(spark, 20), [f"s-root-{k}" for k in range(0, 17, 4)]
    labels = spark.createDataFrame([("L", "s", refs[0], refs[-1])], "label_id string, session_id string, start_uuid string, end_uuid string")
    preds = spark.createDataFrame([("p", "s", refs, 16)], "pred_id string, session_id string, window_refs array<string>, seq long")
    assert [r["iou"] for r in evaluate.span_matches(labels, a, preds).collect()] == [1.0]


def test_runs_share_no_label_and_no_prediction(spark):
    r = random.Random(5)
    rows = [(f"s{r.randrange(2)}", f"g{k}", f"p{k}", lo, lo + r.randrange(9)) for k, lo in enumerate(r.choices(range(400), k=120))]
    found = evaluate.with_runs(spark.createDataFrame(rows, "session_id string, label_id string, pred_id string, lo long, hi long").repartition(5), ["session_id"]).collect()
    for s in ("s0", "s1"):
        own = sorted((x["lo"], x["hi"], x["run"]) for x in found if x["session_id"] == s)
        run, reach = 0, -1
        for lo, hi, got in own:
            run += lo > reach
            reach = max(reach, hi)
            assert got == run
        assert run > 10


def test_one_profile_gives_the_hits_of_each_setting(spark):
    r = random.Random(8)
    rows = [("s", "root", k, f"u{k:03}", k, r.choice("ab"), r.choice("xy"), r.choice(["ok", "error"]), r.choice([None, "f", "g"]), r.sample(["a", "b", "c", "d", "e", "f"], 3)) for k in range(1, 120)]
    df = spark.createDataFrame(rows, "session_id string, agent_scope string, seq long, uuid string, ts long, tool string, arg_key string, result_class string, file_path string, edit_tokens array<string>")
    pick = lambda lo, hi: sorted(r.sample(range(lo, hi), 2))
    settings = {}
    for n in range(100):
        (w, c), (ew, ec), (fw, fc) = pick(3, 14), pick(2, 9), pick(2, 14)
        settings[n] = Thresholds(warning=w, critical=c, error_warning=ew, error_critical=ec, edit_warning=fw, edit_critical=fc, same_region=r.choice([0.2, 0.5, 1.0]))
    profiled = gate.profile(df, list(settings.values()))
    found = gate.resolved(profiled, settings)
    names = ["seq", "trigger_uuid", "subtype", "severity", "window_refs"]
    got = {}
    for x in found.select("candidate", *names).collect():
        got.setdefault(x["candidate"], set()).add((*x[1:5], tuple(x["window_refs"])))
    for n in r.sample(sorted(settings), 8):
        assert got.get(n, set()) == {(*x[:4], tuple(x["window_refs"])) for x in gate.hits(df, settings[n]).select(*names).collect()}, settings[n]
    # As many settings as there may be, the plan reads the actions as often as for one.
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert plan(found) == plan(gate.resolved(gate.profile(df, [Thresholds()]), {0: Thresholds()}))


def test_kappa_of_one_class_is_zero(spark):
    m = evaluate.confusion(spark.createDataFrame([("none", "none")] * 3, "gold string, pred string"))
    assert evaluate.kappa(m).first()["kappa"] == 0
    assert evaluate.kappa(evaluate.confusion(spark.createDataFrame([], "gold string, pred string"))).count() == 1


def test_few_labels_leave_three_candidates(spark):
    c = spark.createDataFrame([(k,) for k in range(5)], "candidate long")
    few = spark.createDataFrame([(k, "none") for k in range(29)], "label_id long, gold string")
    assert evaluate.usable_candidates(c, few).count() == 3
    many = spark.createDataFrame([(k, kind) for k in range(30) for kind in ("none", "thrashing", "false_success")], "label_id long, gold string")
    assert evaluate.usable_candidates(c, many).count() == 5


def test_threads_with_cycles_and_orphans(spark):
    rows = [("a", None, 0), ("b", "a", 1), ("c", "a", 2), ("d", "b", 3), ("x", "y", 4), ("y", "x", 5), ("o", "gone", 6)]
    e = spark.createDataFrame([("s", "root", u, p, n, n) for u, p, n in rows], "session_id string, agent_scope string, uuid string, parent_uuid string, ts long, byte_offset long")
    assert [r["uuid"] for r in ordering.topological_order(e).orderBy("position").collect()] == ["a", "o", "b", "c", "d", "x", "y"]
    d = {r["uuid"]: r["depth"] for r in ordering.depths(e).collect()}
    assert d == {"a": 0, "b": 1, "c": 1, "d": 2, "x": None, "y": None, "o": 0}
    assert [r["uuid"] for r in ordering.orphans(e).filter("is_orphan").collect()] == ["o"]


def test_refined_order_equals_kahn(spark):
    """Random forests with cycles and lost parents, by one task and by rank refinement."""
    r = random.Random(7)
    rows = []
    for s in range(4):
        n = 60
        for k in range(n):
            parent = None if r.random() < 0.1 else f"u{r.randrange(k)}" if k and r.random() < 0.8 else r.choice(["gone", f"u{min(n - 1, k + 1)}", f"u{k}"])
            rows.append((f"s{s}", f"u{k}", parent, r.randrange(30)))
        rows += [(f"s{s}", f"c{k}", f"c{k - 1}" if k else None, 100 - k) for k in range(40)]  # one long chain
    e = spark.createDataFrame(rows, "session_id string, uuid string, parent_uuid string, byte_offset long").repartition(3)
    got = [sorted(map(tuple, df.collect())) for df in (ordering.topological_order(e), ordering.topological_order(e, in_task=0), ordering.topological_order(e, in_task=99))]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_equal_times_keep_parents_first(spark):
    e = spark.createDataFrame([("s", "root", "z", None, 5, 9), ("s", "root", "a", "z", 5, 1), ("s", "root", "m", None, 4, 99)], "session_id string, agent_scope string, uuid string, parent_uuid string, ts long, byte_offset long")
    assert [r["uuid"] for r in ordering.causal_order(e).orderBy("seq").collect()] == ["m", "z", "a"]


def test_result_classes(spark):
    c = lambda text, error: one(spark, logs.result_class(F.lit(text).cast("string"), F.lit(error).cast("boolean")))
    assert [c("Blocked by hook", True), c("rejected", True), c("x", True), c("<tool_use_error>x", None), c(" ", None), c("0 results", None), c("x", None), c("x", False)] == ["blocked", "rejected", "error", "error", "empty", "empty", "ok", "unknown"]


def test_logs_from_files(spark, tmp_path):
    (tmp_path / "subagents" / "a1").mkdir(parents=True)
    lines = [
        '{"type":"user","uuid":"u1","sessionId":"S","timestamp":"2024-01-01T00:00:00.000Z","message":{"role":"user","content":"hi"}}', "",
        '{"type":"assistant","uuid":"u2","parentUuid":"u1","message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool_use","id":"t1","name":"Read","input":{"file_path":"/x"}},{"type":"tool_use","id":"t2","name":"Bash","input":{"command":"ls"}}]}}',
        '{"type":"user","uuid":"u3","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t1","content":""}]}}', '{"broken',
    ]
    (tmp_path / "subagents" / "a1" / "agent-1.jsonl").write_text("\n".join(lines))
    e = logs.pair_results(logs.parse(logs.with_offsets(logs.scan(spark, str(tmp_path))), ingested_at=7)).orderBy("byte_offset", "tool_use_id").collect()
    assert [r["kind"] for r in e] == ["user", "tool_use", "tool_use", "tool_result", "other"]
    assert {r["session_id"] for r in e} == {"S"} and {r["agent_scope"] for r in e} == {"a1"}
    assert [r["result_class"] for r in e] == [None, "empty", None, "empty", None]
    assert [r["parse_ok"] for r in e] == [True] * 4 + [False] and e[4]["uuid"].startswith("synth-") and e[1]["ts"] == 7


def test_ledger_and_labels(spark):
    empty = spark.createDataFrame([], "dedupe_key string, last_sent_ts long, send_count long")
    sent = spark.createDataFrame([("k", 5), ("k", 9)], "dedupe_key string, ts long")
    r = tables.upsert_ledger(tables.upsert_ledger(empty, sent, 10), sent.limit(1), 10).first()
    assert (r["last_sent_ts"], r["send_count"], r["cooldown_until"]) == (9, 3, 19)
    seeds = tables.seed_labels(spark)
    assert tables.append_labels(seeds.unionByName(seeds)).count() == 5 and tables.append_labels(seeds, seeds).count() == 0


def test_store_reads_the_buckets_of_new_ids_only(spark, tmp_path):
    row = lambda u, at=1: (u, at, 0)
    df = lambda *rows: spark.createDataFrame([row(*r) for r in rows], "uuid string, ingested_at long, byte_offset long")
    path = str(tmp_path / "store")
    assert tables.append_to_store(df(*[(f"u{k}",) for k in range(300)]), path, 64).count() == 300
    assert [r["uuid"] for r in tables.append_to_store(df(("u7", 2), ("new", 3), ("new", 2)), path, 64).collect()] == ["new"]
    assert tables.append_to_store(df(("u7", 2), ("new", 3)), path, 64).count() == 0
    store = spark.read.parquet(path)
    assert store.count() == 301 and store.filter("uuid = 'new'").first()["ingested_at"] == 2
    found = tables.held_ids(store, [3, 5])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert {r["bucket"] for r in found.collect()} == {3, 5}
