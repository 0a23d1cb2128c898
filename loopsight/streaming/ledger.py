"""Debounced messages with a ledger that survives restarts: who was sent what last, and how often.

The ledger is a folder of snapshots, a Parquet table each, named by number, stream and micro-batch. A snapshot counts when its
write has been committed (``_SUCCESS``), which is the one step that swaps it in; readers take the greatest such number. A
micro-batch that runs again after a failure finds its own snapshot, or none, and so counts once. Its messages go to a
folder named by stream and batch, which a second run replaces. A new stream starts from the ledger as its initial state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import DEFAULTS, Thresholds
from ..sources.tables import upsert_ledger
from .sessions import BUCKETS, Bucket, Timed, bucket, typed_state
from .stateful import due

SCHEMA = "dedupe_key string, last_sent_ts long, send_count long, cooldown_until long"
SENT = "dedupe_key string, id long, ts long"


class Ledger:
    def __init__(self, spark: SparkSession, path: str, keep: int = 10) -> None:
        """keep: snapshots that stay, for readers that began before the last swap."""
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def snapshots(self) -> list[tuple[int, str, int]]:
        """(number, stream, batch) of the committed snapshots, in order."""
        fs, top = self._folder(self.path)
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        done = [n for n in names if n.startswith("v") and fs.exists(self._folder(f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted((int(v[1:]), stream, int(batch)) for v, stream, batch in (n.split("-", 2) for n in done))

    def read(self) -> DataFrame:
        """The ledger as it is now; empty before the first snapshot."""
        found = self.snapshots()
        return self._read(found[-1]) if found else self.spark.createDataFrame([], SCHEMA)

    def _read(self, snapshot: tuple[int, str, int]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{self._name(*snapshot)}")

    @staticmethod
    def _name(number: int, stream: str, batch: int) -> str:
        return f"v{number:012}-{stream}-{batch}"

    def record(self, sent: DataFrame, stream: str, batch: int, window_ms: int) -> None:
        """Add a batch's messages (dedupe_key, ts), unless a snapshot has them already."""
        found = self.snapshots()
        if any(s[1:] == (stream, batch) for s in found):
            return
        number = found[-1][0] + 1 if found else 0
        new = upsert_ledger(self.read(), sent, window_ms)
        new.write.mode("overwrite").parquet(f"{self.path}/{self._name(number, stream, batch)}")
        for old in found[: -self.keep]:
            fs, p = self._folder(f"{self.path}/{self._name(*old)}")
            fs.delete(p, True)


class Debounce(Timed):
    """A message passes if its key's last sent one is at least the window ago; order is that of (ts, id).

    The state of a key is the time last sent and the messages that wait for the watermark; it goes when the window has passed.
    """

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts long")
        self.pending = handle.getListState("pending", "ts long, id long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        last = int(initialState["last_sent_ts"].max())
        self.last.update((last,))
        self.wake(last + self.window_ms, timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ts), int(i)) for part in rows for ts, i in zip(part["ts"], part["id"])]
        self.pending.appendList(new)
        self.wake_by(min(new)[0], timerValues.getCurrentWatermarkInMs())  # the timer is never later than what waits
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        found = self.last.get()
        last = found[0] if found else None
        ready, left = due([list(x) for x in self.pending.get()], now)
        out = []
        for ts, i in ready:
            if last is None or self.window_ms <= 0 or ts - last >= self.window_ms:
                last = ts
                out.append((key[0], i, ts))
        self.pending.put([tuple(x) for x in left]) if left else self.pending.clear()
        if last is not None and last + self.window_ms > now:
            if out:
                self.last.update((last,))
            self.rearm(left[0][0] if left else last + self.window_ms, now)
        else:
            self.last.clear()
            if left:
                self.rearm(left[0][0], now)
        if out:
            yield pd.DataFrame(out, columns=["dedupe_key", "id", "ts"])


class Debounces(Bucket):
    """``Debounce`` for the keys of a bucket, in one state."""

    KEYS, COLUMNS, SPARED, PART = ("dedupe_key",), ("dedupe_key", "id", "ts"), False, 1024

    def handleInitialState(self, key, initialState, timerValues) -> None:
        first, timer, known = self._state()
        sent = {json.dumps([k]): int(ts) for k, ts in zip(initialState["dedupe_key"], initialState["last_sent_ts"])}
        for name in known.in_order(sent):
            known.put(name, [sent[name]])
        self._saved(first, timer, known, timerValues.getCurrentWatermarkInMs())

    def taken(self, key: tuple, rows: list[dict], known: list | None) -> tuple[list[tuple], list | None]:
        last, out = known[0] if known else None, []
        for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            if last is None or self.keep_ms <= 0 or r["ts"] - last >= self.keep_ms:
                last = r["ts"]
                out.append((*key, r["id"], last))
        return out, [last] if out else None


def debounce_stream(messages: DataFrame, t: Thresholds = DEFAULTS, ledger: Ledger | None = None, buckets: int = BUCKETS) -> DataFrame:
    """dedupe_key, id, ts of messages (dedupe_key, id, ts, with a watermark on event_time) that pass.

    ledger: what a stream without a checkpoint starts from; one that goes on from its checkpoint has its own state.
    buckets: keys are dealt to so many states, so that a micro-batch costs by state and not by key; 0 gives each key its own, for streams
    in which few keys are active at a time. It is fixed for a checkpoint.
    """
    typed_state(messages.sparkSession)
    begun = ledger.read().select("dedupe_key", "last_sent_ts") if ledger else None
    if not buckets:
        return messages.groupBy("dedupe_key").transformWithStateInPandas(Debounce(t.debounce_ms), SENT, "Append", "EventTime", initialState=begun.groupBy("dedupe_key") if ledger else None)
    at = bucket("dedupe_key", n=buckets)
    rows = messages.select(at, "ts", F.to_json(F.struct("dedupe_key", "ts", "id"), {"ignoreNullFields": "false"}).alias("body"), "event_time")
    return rows.groupBy("bucket").transformWithStateInPandas(Debounces(t.debounce_ms), SENT, "Append", "EventTime", initialState=begun.select(at, "*").groupBy("bucket") if ledger else None)


def sink(ledger: Ledger, messages: str, stream: str, window_ms: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: write the batch's messages, then the ledger with what was written."""

    def write(sent: DataFrame, batch: int) -> None:
        path = f"{messages}/stream={stream}/batch={batch}"
        sent.write.mode("overwrite").parquet(path)
        ledger.record(ledger.spark.read.schema(SENT).parquet(path), stream, batch, window_ms)

    return write
