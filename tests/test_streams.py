"""Streams over several micro-batches: order across batches, restart from the checkpoint, timeouts and state that goes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loopsight.functions.config import Thresholds
from loopsight.operators import gate, routing
from loopsight.streaming import ledger, sessions, source, stateful

END = 4_000_000_000_000


class Landing:
    """A folder of chunks that a stream takes one by one, with a checkpoint."""

    def __init__(self, spark, tmp_path, schema, build, delay="10 seconds"):
        self.spark, self.top, self.n = spark, tmp_path, 0
        (tmp_path / "in").mkdir()
        self.schema, self.build, self.delay = schema, build, delay

    def add(self, rows):
        self.n += 1
        path = self.top / "in" / f"{self.n:03}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (1_700_000_000 + self.n,) * 2)  # files are taken in the order of their times

    def run(self):
        """Drain what is there; the next call goes on from the checkpoint. Gives all rows so far, and the batches of this run."""
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.top / "in"))
        s = self.build(rows.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", self.delay))
        q = s.writeStream.format("parquet").option("path", str(self.top / "out")).option("checkpointLocation", str(self.top / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.schema(s.schema).parquet(str(self.top / "out")).collect(), [p["batchId"] for p in q.recentProgress]


def test_gate_keeps_its_window_over_batches_and_a_restart(spark, tmp_path):
    """Rows arrive out of order within the watermark's delay, chunk by chunk, with a restart: as the batch gate on all rows."""
    actions = [{"session_id": "s", "agent_scope": "root", "seq": k, "uuid": f"u{k:02}", "ts": 1000 * k, "tool": "Bash", "arg_key": "same", "result_class": "error" if k % 2 else "ok", "file_path": None, "edit_tokens": None} for k in range(1, 25)]
    land = Landing(spark, tmp_path, source.ACTIONS, sessions.gate_stream)
    order = sorted(actions, key=lambda a: (a["seq"] + 3 * (a["seq"] % 3)))  # up to six seconds late
    for k in range(0, 12, 4):
        land.add(order[k : k + 4])
    first, batches = land.run()
    assert len(batches) >= 3
    for k in range(12, 24, 4):
        land.add(order[k : k + 4])
    land.add([{**actions[0], "session_id": "~", "uuid": "~", "ts": END}])
    rows, more = land.run()
    assert len(more) >= 3 and min(more) > max(b for b in batches if b < min(more)) - 1 and len(first) < len(rows)
    held = spark.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "state"))
    assert "s" not in {r["key"]["session_id"] for r in held.collect()}  # idle for longer than a scope's state is kept
    want = gate.hits(spark.createDataFrame([tuple(a.values()) for a in actions], source.ACTIONS)).collect()
    assert sorted((r["trigger_uuid"], r["subtype"], r["severity"]) for r in rows) == sorted((r["trigger_uuid"], r["subtype"], r["severity"]) for r in want)


def test_scopes_of_a_bucket_are_as_the_batch_gate(spark, tmp_path):
    """Many scopes in three states, replayed rows, rows out of order, names that are null or alike, and a scope that goes on after its state went."""
    import random

    r, rows, day = random.Random(3), [], sessions.DAY
    for n, (s, a) in enumerate([(f"s{k}", x) for k in range(70) for x in ("root", "sub")] + [(None, "root"), ("null", "root"), ('["s1"', 'root"]')]):
        for k in range(1, 16 + n % 20):
            path = r.choice([None, "f", "g"])
            rows.append({"session_id": s, "agent_scope": a, "seq": k, "uuid": f"{n}-{k}", "ts": 100_000 + 1000 * k, "tool": r.choice("AB"), "arg_key": "k", "result_class": r.choice(["ok", "ok", "error", None]), "file_path": path, "edit_tokens": path and r.sample("abcdefgh", 3)})
    later = [{**x, "uuid": f"{x['uuid']}'", "ts": x["ts"] + 3 * day, "agent_scope": "root"} for x in rows if x["session_id"] == "s3" and x["agent_scope"] == "root"]
    land = Landing(spark, tmp_path, source.ACTIONS, lambda s: sessions.gate_stream(s.dropDuplicatesWithinWatermark(["uuid"]), keep_ms=day, buckets=3))
    late = {x["uuid"]: x["ts"] + r.randrange(8000) for x in rows}
    order = sorted(rows, key=lambda x: late[x["uuid"]])
    for part in (order[: len(order) // 3], order[len(order) // 4 : -500], order[-700:], *([{**rows[0], "uuid": f"day{k}", "session_id": "day", "ts": 2 * day + k}] for k in range(2)), later, [{**rows[0], "session_id": "~", "uuid": "~", "ts": END}]):
        land.add(part)
    got, batches = land.run()
    assert len(batches) >= 7
    state = lambda name: spark.read.format("statestore").option("operatorId", 0).option("stateVarName", name).load(str(tmp_path / "state")).count()
    assert state("window") == 0 and state("pending") == 1  # all scopes are idle, the last record waits
    batch = lambda part: gate.hits(spark.createDataFrame([tuple(x.values()) for x in part], source.ACTIONS).withColumn("session_id", F.coalesce("session_id", F.lit("none")))).collect()
    want = [(x["session_id"], x["trigger_uuid"], x["subtype"], x["severity"]) for x in batch(rows) + batch(later)]
    assert sorted((x["session_id"] or "none", x["trigger_uuid"], x["subtype"], x["severity"]) for x in got) == sorted(want) and len(want) > 500


def test_chunks_make_their_rows_once(spark):
    """And all tasks write them; each row comes as often as asked for, and chunks follow each other in time."""
    from loopsight.plans.stream_queries import _chunks

    made = spark.sparkContext.accumulator(0)

    def value(x):
        made.add(1)
        return f"u{x}"

    rows = spark.range(4000, numPartitions=4).select(F.udf(value, "string")("id").alias("uuid"), F.col("id").alias("ts"))
    seen = []
    for path in _chunks(rows, "once", {"uuid": "~"}, 3, copies=2):
        seen.append({(r["uuid"], r["ts"]): r["count"] for r in spark.read.schema("uuid string, ts long").json(path).groupBy("uuid", "ts").count().collect()})
    assert made.value == 4000 and len(seen) == 3 and len([f for f in os.listdir(path) if f.startswith("part")]) > 3 * 2
    assert seen[-1] == {(f"u{k}", k): 2 for k in range(4000)} | {("~", END): 1}
    assert all(len(a) < len(b) and max(ts for _, ts in a) < min(ts for _, ts in b.keys() - a.keys()) for a, b in zip(seen, seen[1:]))


def test_debounce_over_batches(spark, tmp_path):
    """Window 60: of 0, 40, 80, 120, 145, 200 those at 0, 80, 145 go (40 and 120 are too close to the last sent); the order of arrival doesn't matter."""
    land = Landing(spark, tmp_path, "dedupe_key string, id long, ts long", lambda s: ledger.debounce_stream(s, Thresholds(debounce_ms=60)), "1 second")
    base = 1_700_000_000_000
    for chunk in ([40, 0], [120, 80], [200, 145]):
        land.add([{"dedupe_key": "k", "id": t, "ts": base + t} for t in chunk])
    land.add([{"dedupe_key": "~", "id": -1, "ts": END}])
    rows, batches = land.run()
    assert len(batches) >= 4 and sorted(r["id"] for r in rows if r["id"] >= 0) == [0, 80, 145]


@pytest.mark.parametrize("buckets", [0, 1, 5])
def test_debounced_keys_in_buckets_are_as_a_loop(spark, tmp_path, buckets):
    """One state a key or for many keys, with a ledger to start from, equal times, a null key and a state that goes."""
    import random

    r, base, window = random.Random(5), 1_700_000_000_000, 60
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    book.record(spark.createDataFrame([(f"k{k}", base - k % 80) for k in range(0, 3000, 2)], "dedupe_key string, ts long"), "before", 0, window)
    rows = [(r.choice([None, *[f"k{k}" for k in range(60)], "k2999"]), n, r.randrange(600)) for n in range(1500)]
    land = Landing(spark, tmp_path, "dedupe_key string, id long, ts long", lambda s: ledger.debounce_stream(s, Thresholds(debounce_ms=window), book, buckets), "0 milliseconds")
    for a in range(0, 600, 150):
        land.add([{"dedupe_key": k, "id": n, "ts": base + ts} for k, n, ts in rows if a <= ts < a + 150])
    land.add([{"dedupe_key": "~", "id": -1, "ts": END}])
    got, _ = land.run()
    last, want = {f"k{k}": -(k % 80) for k in range(0, 3000, 2)}, []
    for k, n, ts in sorted(rows, key=lambda x: (x[2], x[1])):
        if k not in last or ts - last[k] >= window:
            last[k] = ts
            want.append((str(k), n))
    assert sorted((str(x["dedupe_key"]), x["id"]) for x in got if x["id"] >= 0) == sorted(want) and len(want) > 300


def test_a_bucket_costs_messages_by_state_and_not_by_key():
    """Ten thousand keys with messages in one bucket: reads and writes of state are by part."""
    import pandas as pd

    class State(dict):
        calls = 0

        def getValue(self, k):
            State.calls += 1
            return self[k]

        def updateValue(self, k, v):
            State.calls += 1
            self[k] = v

        def removeKey(self, k):
            State.calls += 1
            del self[k]

    class Value:
        held = None

        def get(self):
            State.calls += 1
            return self.held

        def update(self, v):
            State.calls += 1
            self.held = v

        def clear(self):
            State.calls += 1
            self.held = None

    class List(Value):
        def get(self):
            State.calls += 1
            return iter(self.held or [])

        def appendValue(self, v):
            State.calls += 1
            self.held = [*(self.held or []), v]

        put = Value.update

    class Handle:
        timers = []

        def getMapState(self, *_):
            self.map = State()
            return self.map

        def getListState(self, *_):
            self.list = List()
            return self.list

        def getValueState(self, *_):
            self.value = Value()
            return self.value

        def registerTimer(self, t):
            State.calls += 1
            self.timers.append(t)

        def deleteTimer(self, t):
            State.calls += 1
            self.timers.remove(t)

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    handle, times, debounces = Handle(), Times(), ledger.Debounces(50)
    debounces.init(handle)
    rows = [(f"k{k % 10_000}", k, 10 * (k // 10_000)) for k in range(30_000)]  # at 0, 10 and 20
    body = [json.dumps({"dedupe_key": k, "ts": ts, "id": n}) for k, n, ts in rows]
    assert list(debounces.handleInputRows((0,), iter([pd.DataFrame({"ts": [r[2] for r in rows], "body": body})]), times)) == []
    times.now = handle.timers.pop()
    sent = pd.concat(debounces.handleExpiredTimer((0,), times, None))
    assert len(sent) == 10_000 and set(sent["ts"]) == {0} and State.calls < 100
    while handle.timers:
        times.now = handle.timers.pop()
        assert list(debounces.handleExpiredTimer((0,), times, None)) == []
    assert not handle.map and not handle.list.held and handle.value.held is None and State.calls < 200


def test_orphans_wait_five_seconds_and_state_goes(spark, tmp_path):
    land = Landing(spark, tmp_path, "session_id string, uuid string, parent_uuid string, ts long", stateful.orphan_stream, "0 seconds")
    e = lambda u, p, ts: {"session_id": "s", "uuid": u, "parent_uuid": p, "ts": 1_700_000_000_000 + ts}
    land.add([e("child", "root", 10), e("lost", "gone", 20), e("kid", "lost", 30)])
    land.add([e("root", None, 4000)])
    rows, _ = land.run()
    assert {r["uuid"]: r["orphan"] for r in rows} == {"root": False, "child": False}
    land.add([e("later", "child", 5019)])
    rows, _ = land.run()
    assert {r["uuid"] for r in rows} == {"root", "child", "later"}
    land.add([e("other", None, 5022)])
    rows, _ = land.run()
    assert {r["uuid"]: r["orphan"] for r in rows} == {"root": False, "child": False, "later": False, "other": False, "lost": True, "kid": False}
    land.add([{**e("~", None, 0), "session_id": "~", "ts": END}])
    land.run()
    held = spark.read.format("statestore").load(str(tmp_path / "state")).select("key.session_id").distinct().collect()
    assert "s" not in {r["session_id"] for r in held}


@pytest.mark.parametrize(("window", "streamed"), [(0, 9), (60, 10**6), (60, 0), (60, 60), (1, 0)])
def test_debounce_batch_equals_a_loop(spark, window, streamed):
    """In a task and by doubling: equal times, a null key, a key that never pauses."""
    import random

    r = random.Random(4)
    rows = [(r.choice(["k0", "k1", None]), k, r.randrange(600)) for k in range(200)] + [("busy", 1000 + k, 7 * k) for k in range(400)] + [("busy", 2000 + k, 7 * k) for k in range(40)]
    got = {x["id"] for x in routing.debounced(spark.createDataFrame(rows, "dedupe_key string, id long, ts long").repartition(4), window_ms=window, streamed=streamed).filter("sent").collect()}
    last, want = {}, set()
    for key, i, ts in sorted(rows, key=lambda x: (x[2], x[1])):
        if window <= 0 or key not in last or ts - last[key] >= window:
            last[key] = ts
            want.add(i)
    assert got == want


class Killed(Exception):
    pass


@pytest.mark.parametrize("after", ["messages", "ledger"])
def test_a_batch_that_dies_is_counted_once(spark, tmp_path, after):
    """Killed between the sink and the ledger, or between the ledger and the commit: no message twice, counts right."""
    base, t = 1_700_000_000_000, Thresholds(debounce_ms=60)
    book, out = ledger.Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "sent")
    book.record(spark.createDataFrame([("k", base - 30), ("old", base - 500)], "dedupe_key string, ts long"), "before", 0, 60)
    die = [True]

    class Dying(ledger.Ledger):
        def record(self, sent, *rest):
            if after == "ledger":
                super().record(sent, *rest)
            if sent.filter("dedupe_key = 'k'").count() and die and die.pop():
                raise Killed
            super().record(sent, *rest)

    def run():
        rows = spark.readStream.schema("dedupe_key string, id long, ts long").json(str(tmp_path / "in")).withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", "0 seconds")
        write = ledger.sink(Dying(spark, str(tmp_path / "ledger")), out, "s", 60)
        ledger.debounce_stream(rows, t, book).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    (tmp_path / "in").mkdir()
    messages = [{"dedupe_key": k, "id": n, "ts": base + ts} for n, (k, ts) in enumerate([("k", 0), ("k", 40), ("k", 90), ("k", 100), ("old", 5), ("new", 7)])]
    (tmp_path / "in" / "1.json").write_text("".join(json.dumps(m) + "\n" for m in [*messages, {"dedupe_key": "~", "id": -1, "ts": END}]))
    with pytest.raises(Exception, match="Killed"):
        run()
    run()
    sent = sorted((r["dedupe_key"], r["id"]) for r in spark.read.schema(ledger.SENT).parquet(f"{out}/*/*").collect() if r["id"] >= 0)
    assert sent == [("k", 1), ("k", 3), ("new", 5), ("old", 4)]  # 0 is within 60 of what the ledger had, 90 within 60 of 40
    assert {r["dedupe_key"]: (r["last_sent_ts"] - base, r["send_count"]) for r in book.read().collect() if r["dedupe_key"] != "~"} == {"k": (100, 3), "old": (5, 2), "new": (7, 1)}


def test_readers_see_committed_snapshots_only(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"), keep=2)
    assert book.read().count() == 0
    for n in range(5):
        book.record(spark.createDataFrame([("k", n)], "dedupe_key string, ts long"), "s", n, 60)
    assert [s[0] for s in book.snapshots()][-2:] == [3, 4] and len(book.snapshots()) <= 3
    (tmp_path / "ledger" / "v000000000009-s-9").mkdir()  # a write that was never committed
    assert book.read().collect()[0]["send_count"] == 5
    book.record(spark.createDataFrame([("k", 9)], "dedupe_key string, ts long"), "s", 4, 60)
    assert book.read().collect()[0]["send_count"] == 5
