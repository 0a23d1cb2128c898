"""Token ids in a binary file format coded by a static range asymmetric numeral system.

Documents are dealt out by ranges of doc_id and sorted; the tokenizers library encodes each whole text, by the file's coarse form (see coarse.py)
where that gives the file's ids at less cost; a task cuts its documents into segments of about SEGMENT ids. All blocks of a segment share
one frequency table. A block's ids are dealt to LANES interleaved states with one word stream; every CHECKPOINT steps the states and the stream position are
noted, so that decoding can start there, and each block has a checksum. Segments are rows of a Parquet
table (Spark's committed writes survive lost executors); each can be decoded without any other.

Edge cases: a null text counts as empty and gives just the end id; rows of equal doc_id each get
their ids, in any order among themselves; null doc_ids come first; extra columns are ignored; an
empty table gives no segments and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .coarse import as_bytes, coarse_form, suits
from .common import materialise, small_batches

SEGMENT = 2_000_000
#: Characters of text that are given to the library at once, unless one text has more.
TOGETHER = 1 << 18
LANES = 64
BLOCK_STEPS = 2048
CHECKPOINT = 512
SCALE = 18
MAGIC = b"RANS0001"
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<8sQIIIIII")


class ChecksumError(ValueError):
    """A block's ids don't have the checksum that was written."""


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, frequencies (at least 1, in sum a power of two) and that power."""
    if ids.max() < 1 << 22:  # counting beats sorting for ids of any usual vocabulary
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    scale = max(SCALE, int(len(symbols)).bit_length() + 2)
    total = 1 << scale
    freq = np.maximum(1, counts * (total - len(symbols)) // counts.sum())
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    for k in order:  # at most one round: floors and the ones added are within the slack kept above
        if not over:
            break
        change = min(over, int(freq[k]) - 1) if over > 0 else over
        freq[k] -= change
        over -= change
    return symbols.astype(np.uint32), freq.astype(np.uint64), scale


def encode(ids: np.ndarray) -> bytes:
    """One segment: header, table, block directory, checkpoints, words."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    if not n:
        return _HEAD.pack(MAGIC, 0, 0, 0, 0, 0, 0, 0)
    symbols, freq, scale = table_of(ids)
    cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
    blocks = -(-n // (LANES * BLOCK_STEPS))
    steps = -(-n // (LANES * blocks))
    rank = np.full(blocks * steps * LANES, int(freq.argmax()), np.int64)
    if symbols[-1] < 1 << 22:
        place = np.zeros(int(symbols[-1]) + 1, np.int64)
        place[symbols] = np.arange(len(symbols))
        rank[:n] = place[ids]
    else:
        rank[:n] = np.searchsorted(symbols, ids)
    rank = np.ascontiguousarray(rank.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    x = np.full(blocks * LANES, LOW, np.uint64)
    words, used = np.empty(rank.shape, np.uint32), np.empty(rank.shape, bool)
    marks = range(0, steps, CHECKPOINT)
    states = np.zeros((len(marks), blocks, LANES), np.uint64)
    limit, gap = freq << np.uint64(63 - scale), np.uint64(1 << scale) - freq
    for t in range(steps - 1, -1, -1):
        r = rank[t]
        full = np.greater_equal(x, limit.take(r), out=used[t])
        words[t] = x  # the low 32 bits
        x = np.where(full, x >> np.uint64(32), x)
        q = x // freq.take(r)
        q *= gap.take(r)
        x += q
        x += cum.take(r)
        if t % CHECKPOINT == 0:
            states[t // CHECKPOINT] = x.reshape(blocks, LANES)
    words, used = (np.ascontiguousarray(a.reshape(steps, blocks, LANES).transpose(1, 0, 2)) for a in (words, used))
    before = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(used.sum(axis=2).T, axis=0)])
    streams = [words[b][used[b]] for b in range(blocks)]
    start = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    offsets = (before[list(marks)] + start[None, :-1]).astype("<u8")
    sums = np.array([zlib.crc32(ids[k : k + steps * LANES].astype("<u4").tobytes()) for k in range(0, blocks * steps * LANES, steps * LANES)], "<u4")
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    head = _HEAD.pack(MAGIC, n, blocks, steps, LANES, scale, len(symbols), len(table))
    return b"".join([head, table, sums.tobytes(), offsets.tobytes(), states.astype("<u8").tobytes(), *[s.astype("<u4").tobytes() for s in streams]])


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment, all stretches between checkpoints side by side; checks every block."""
    magic, n, blocks, steps, lanes, scale, distinct, size = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    if not n:
        return np.empty(0, np.uint32)
    at = _HEAD.size
    table = np.frombuffer(zlib.decompress(data[at : at + size]), "<u4")
    symbols, freq = np.cumsum(table[:distinct], dtype=np.uint32), table[distinct:].astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
    rank_of = np.repeat(np.arange(distinct), freq.astype(np.int64))
    at += size
    marks = -(-steps // CHECKPOINT)
    sums = np.frombuffer(data, "<u4", blocks, at)
    at += 4 * blocks
    pointer = np.frombuffer(data, "<u8", marks * blocks, at).astype(np.int64)
    at += 8 * marks * blocks
    x = np.frombuffer(data, "<u8", marks * blocks * lanes, at).reshape(-1, lanes).astype(np.uint64)
    at += 8 * marks * blocks * lanes
    words = np.append(np.frombuffer(data[at:], "<u4"), np.uint32(0)).astype(np.uint64)
    out = np.zeros((marks, CHECKPOINT, blocks, lanes), np.uint32)
    last = steps - (marks - 1) * CHECKPOINT
    mask, bits = np.uint64((1 << scale) - 1), np.uint64(scale)
    for k in range(min(CHECKPOINT, steps)):
        if k == last:  # the last stretch of each block ends here
            x, pointer = x[: (marks - 1) * blocks], pointer[: (marks - 1) * blocks]
        slot = x & mask
        r = rank_of[slot.astype(np.int64)]
        out[: len(x) // blocks, k] = symbols[r].reshape(-1, blocks, lanes)
        x = freq[r] * (x >> bits) + slot - cum[r]
        short = x < LOW
        order = np.cumsum(short, axis=1)
        x = np.where(short, (x << np.uint64(32)) | words[np.minimum(pointer[:, None] + order - 1, len(words) - 1)], x)
        pointer = pointer + order[:, -1]
    ids = out.reshape(marks * CHECKPOINT, blocks, lanes)[:steps].transpose(1, 0, 2).reshape(-1)[:n]
    for b in range(blocks):
        if zlib.crc32(ids[b * steps * lanes : (b + 1) * steps * lanes].astype("<u4").tobytes()) != int(sums[b]):
            raise ChecksumError(f"block {b}")
    return ids


def whole_texts(forms: tuple, texts: list[str]) -> Iterator[bytes]:
    """Packed ids of each whole text by the tokenizers library, which takes a few texts at a time.

    forms are the file as it is and its coarse form, if it has one; a text goes whole to one of them.
    """
    own, coarse = forms
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= TOGETHER or k + 1 == len(texts):
            plain = [coarse is not None and suits(x) for x in held]
            some = iter(coarse.encode_batch_fast([as_bytes(x) for x, p in zip(held, plain) if p], add_special_tokens=False) if any(plain) else ())
            rest = iter(own.encode_batch_fast([x for x, p in zip(held, plain) if not p], add_special_tokens=False) if not all(plain) else ())
            for p in plain:
                yield array("I", next(some if p else rest).ids).tobytes()
            held, size = [], 0


_forms: dict[tuple, tuple] = {}


def _tokenizers(sources: tuple[str, str | None]) -> tuple:
    """The worker's tokenizers for a file's content and its coarse form (or None), without truncation and padding."""
    if sources not in _forms:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _forms.clear()
        found = _forms[sources] = tuple(source and Tokenizer.from_str(source) for source in sources)
        for tokenizer in filter(None, found):
            tokenizer.no_truncation()
            tokenizer.no_padding()
    return _forms[sources]


def write_ids(docs: DataFrame, tokenizer: str, path: str, text: str = "text", end_id: int = 0, segment: int = SEGMENT) -> None:
    """Encode every text, append end_id, and write the ids in ascending doc_id order as segments under path."""
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((source, coarse_form(source)))
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _tokenizers(shared.value)
        part, seq, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held, size
            payload = encode(np.frombuffer(b"".join(p for _, p in held), "<u4"))
            row = [[part], [seq], [start], [size], [[i for i, _ in held]], [[len(p) // 4 for _, p in held]], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            seq, start, held, size = seq + 1, start + size, [], 0
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds)], names=["part", "seq", "start", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, packed in zip(ids, whole_texts(forms, [t or "" for t in texts])):
                held.append((i, packed + end))
                size += len(packed) // 4 + 1
                if size >= segment:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]  # the second spreads the rows of a repeated or null id
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, "part int, seq int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in all), n_tokens, ids_crc32 and, if asked, token_ids, decoded from the files."""
    small_batches(spark)
    segments = spark.read.parquet(path)
    ends = segments.groupBy("part").agg(F.max(F.col("start") + F.col("n_ids")).alias("size"))
    # A row for each written partition: few enough to be summed up in one window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(ends.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                ids = decode(row["payload"]).astype("<u4")
                at = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + row["base"] + row["start"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"][: len(columns)])

    rows = segments.join(base, "part").select("base", "start", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids)
