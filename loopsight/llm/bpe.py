"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Text is cut into pre-tokens as it streams in. Inside a pre-token a token is emitted as soon as no
further input can change it: ``sufficient_lookahead`` derives from the merge list how many bytes
behind a token's end can still matter, so a run of any length is encoded in constant memory.
Decoding feeds token bytes to an incremental UTF-8 state machine.

Edge cases: a null text counts as empty (no ids, empty decoded text); rows and repeated rows are
independent of each other; columns of the input are kept, and those named like an output column
are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, small_batches, without

#: Characters of text that the transducer takes at once.
CHUNK = 1 << 16
#: Pre-tokens remembered by one worker (about 80 MB) before it starts anew, and their characters at most.
REMEMBERED, LONGEST = 400_000, 256

# The pre-token pattern of byte-level BPE; the second form spells out its classes up to U+00FF.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
NARROW = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WIDE = regex.compile(PATTERN)
RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\p{White_Space}\p{L}\p{N}]+", r"\p{White_Space}+")]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def sufficient_lookahead(pieces: list[tuple[bytes, bytes]]) -> int:
    """Bytes beyond a token's end that can decide whether it stays, for merges in rank order.

    A merge is undone only by a merge of lower rank that crosses its right end, which in turn needs
    the bytes that decide *that* one. Going through ranks upwards, ``reach`` of a merge is the bytes
    from its start that fix it; the largest reach, less the one byte that overlaps, is enough.
    """
    tokens = {a + b for a, b in pieces}
    by_prefix: dict[bytes, int] = {}
    inside: dict[bytes, int] = {}
    most = 1
    for a, b in pieces:
        t = a + b
        ahead = max(0, inside.get(t, 0))
        for k in range(1, len(t) + 1):
            if (far := by_prefix.get(t[-k:])) is not None:
                ahead = max(ahead, far - k)
        reach = len(t) + ahead
        for k in range(1, len(t)):
            if by_prefix.get(t[:k], 0) < reach:
                by_prefix[t[:k]] = reach
        for e in range(2, len(t)):
            for s in range(1, e):
                if t[s:e] in tokens:
                    inside[t[s:e]] = max(inside.get(t[s:e], 0), reach - e)
        most = max(most, reach - 1)
    return most


class Vocabulary:
    """Ids, merges and lookahead of a byte-level BPE file in the tokenizers library's format."""

    def __init__(self, source: str, lookahead: int | None = None) -> None:
        file = json.loads(source)
        model, self.special = file["model"], {x["content"]: x["id"] for x in file["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda s: bytes(back[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in model["vocab"].items()}
        self.bytes_of.update((i, s.encode()) for s, i in self.special.items())
        self.single = [0] * 256
        for i, t in self.bytes_of.items():
            if len(t) == 1:
                self.single[t[0]] = i
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.lookahead = lookahead if lookahead is not None else sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked adjacent pair first, leftmost first among equals."""
        ids = [self.single[b] for b in data]
        if len(ids) > 48:
            return self._merged_long(ids)
        get, new, none = self.rank.get, self.made, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = [new[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, find = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k) for k in range(n - 1) if (r := find((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or find((ids[k], ids[j])) != rank:
                continue
            new = self.made[rank]
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
                if (r := find((new, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := find((ids[before[k]], new))) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [i for i in ids if i >= 0]


class Run:
    """The transducer of one pre-token: takes its bytes piece by piece and yields ids that can't change any more."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.held, self.step = vocabulary, b"", max(4096, 2 * vocabulary.lookahead)

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        return self._stable(self.v.lookahead) if len(self.held) >= self.step + self.v.lookahead else []

    def finish(self) -> list[int]:
        out, self.held = self.v.merged(self.held), b""
        return out

    def _stable(self, ahead: int) -> list[int]:
        out, end, most = self.v.merged(self.held), 0, len(self.held) - ahead
        for k, i in enumerate(out):
            if end + len(self.v.bytes_of[i]) > most:
                out = out[:k]
                break
            end += len(self.v.bytes_of[i])
        self.held = self.held[end:]
        return out


class Encoder(dict):
    """Maps a pre-token to its packed ids (unsigned 32-bit, little-endian) by the transducer, remembering short ones."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary

    def __missing__(self, word: str) -> bytes:
        data, run = word.encode("utf-8", "replace"), Run(self.v)
        ids = [i for k in range(0, len(data), 4096) for i in run.feed(data[k : k + 4096])] + run.finish()
        out = b"".join(map(self.v.packed.__getitem__, ids))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, piece by piece. The strings of special tokens are those tokens."""
        parts = self.v.splitter.split(text) if self.v.splitter else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.v.packed[self.v.special[part]]
            elif part:
                yield from self._ordinary(part)

    def _ordinary(self, text: str) -> Iterator[bytes]:
        words = pre_tokens if len(text) <= CHUNK else NARROW.findall if _narrow(text) else WIDE.findall
        if len(text) <= CHUNK:
            yield b"".join(map(self.__getitem__, words(text)))
            return
        held, at = "", 0
        while at < len(text):
            held += text[at : at + CHUNK]
            at += CHUNK
            if at >= len(text):
                break
            found = words(held)
            # The last two pre-tokens may still change: a run may go on, and ' with a letter may become a contraction.
            if len(found) > 2:
                yield b"".join(map(self.__getitem__, found[:-2]))
                held = found[-2] + found[-1]
            if len(held) > CHUNK // 2:
                out, at = self._long(held, text, at)
                yield out[0]
                held = out[1]
        yield b"".join(map(self.__getitem__, words(held)))

    def _long(self, held: str, text: str, at: int) -> tuple[tuple[bytes, str], int]:
        """A pre-token longer than half a chunk has begun in what is held: stream it to its end."""
        first, second = (WIDE.findall(held) + [""])[:2]
        if len(first) < len(second):
            out, held = [self[first]], second
        else:
            out, held = [], held
        lead = held[:1] == " " and len(held) > 1 and not held[1].isspace()
        kind = next(r for r in RUNS if r.match(held, 1 if lead else 0))
        run, pack = Run(self.v), self.v.packed.__getitem__
        space = kind is RUNS[3]
        while True:
            end = m.end() if (m := kind.match(held, 1 if lead else 0)) else 0
            over = end == len(held) and at < len(text)
            stop = end - 1 if space and (over or end < len(held)) else end
            out.append(b"".join(map(pack, run.feed(held[:stop].encode("utf-8", "replace")))))
            held, lead = held[stop:], False
            if not over:
                out.append(b"".join(map(pack, run.finish())))
                return (b"".join(out), held), at
            held += text[at : at + CHUNK]
            at += CHUNK


def _narrow(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pre_tokens(text: str) -> list[str]:
    return NARROW.findall(text) if _narrow(text) else WIDE.findall(text)


class Decoder:
    """Incremental byte-to-text state machine: holds at most the bytes of one unfinished character."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.table = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist())))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


_loaded: dict[str, Encoder] = {}


def encoder(source: str, lookahead: int) -> Encoder:
    """The worker's encoder for a vocabulary file's content."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Vocabulary(source, lookahead))
    return _loaded[key]


def _shipped(df: DataFrame, tokenizer: str):
    """The file's content (about 1.5 MB, the vocabulary's size) and its lookahead, for the executors."""
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast((source, Vocabulary(source).lookahead))


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the ids of each text as array<int>; no special tokens are added."""
    shipped = _shipped(df, tokenizer)

    def make(texts):
        e = encoder(*shipped.value)
        packed = [b"".join(e.encode(x)) if x else b"" for x in texts]
        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]

    return add_columns(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null ids give null, bytes that aren't UTF-8 give U+FFFD."""
    shipped = _shipped(df, tokenizer)
    df = without(df, text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(*shipped.value).v
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index(ids)).to_pylist():
                d = Decoder(v)
                out.append(None if x is None else d.feed(np.array(x, "<u4").tobytes()) + d.finish())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Encode and decode each text in one stream; add n_tokens and the digests of ids and decoded text.

    Neither the ids nor the decoded text of a document are held whole.
    """
    shipped = _shipped(df, tokenizer)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(texts):
        e = encoder(*shipped.value)
        counts, ids, decoded = [], [], []
        for x in texts:
            n, a, b, d = 0, hashlib.sha256(), hashlib.sha256(), Decoder(e.v)
            for packed in e.encode(x or ""):
                n += len(packed) // 4
                a.update(packed)
                b.update(d.feed(packed).encode("utf-8"))
            b.update(d.finish().encode("utf-8"))
            counts.append(n)
            ids.append(a.hexdigest())
            decoded.append(b.hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return add_columns(df, text, added, make)
