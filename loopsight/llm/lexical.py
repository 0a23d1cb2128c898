"""Ranked lexical search by MaxScore with bounds of term pairs.

A set of items (queries) is ranked against all documents. Documents are read once and written as segments: for the terms that
the items ask for, the documents that hold them and how often. Counts over all segments give the weights. A second job turns
frequencies into impacts and stores, for each segment and each pair of terms that an item pairs, the greatest joint impact
in the intersection of their lists; each term's own maximum stands beside it. The search reads a segment at a time. A document
can gain from a pair no more than the largest of the joint maximum and the two single ones, which is less than the
sum of the single ones wherever the two peak in different documents. An item's pairs are sorted by that bound; those that
together stay below the score to beat are only looked up for documents that the others bring up, and a segment whose pairs all
stay below it is skipped. Scores equal to the one to beat are never skipped, as the smaller id wins a tie.

A task keeps the k best of each item over its segments, and these meet in one job for each item. Items are taken in blocks of
``ITEMS``, each of which passes over the documents, so what tasks hold of the items is bounded.

Edge cases: null or termless texts don't count as documents and match nothing; an item without terms or whose terms no document
holds has no rows. Repeated rows of documents each count and rank; repeated items count once; different texts of one item_id are
ranked apart. A null doc_id comes last among equal scores. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Items taken at once; documents and postings of a segment; bytes of a text that are cut into terms at once.
ITEMS, DOCS, POSTINGS, PIECE = 2000, 4096, 2_000_000, 1 << 20
#: Every byte below 128 that isn't a letter or digit becomes a space; A-Z becomes a-z.
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def counted(text: bytes | None) -> Counter:
    """Terms of a text (UTF-8) and how often each occurs."""
    clean, out, at = (text or b"").translate(_CLEAN), Counter(), 0
    while at < len(clean):
        cut = clean.find(b" ", at + PIECE)
        stop = len(clean) if cut < 0 else cut
        out.update(clean[at:stop].split())
        at = stop
    return out


@dataclass
class Item:
    item_id: int | None
    terms: list[tuple[int, int]]  # term, weight times repeats
    units: list[tuple[int, list[tuple[int, int]]]]  # number of the pair (-1: a term alone), its terms


class Items:
    """A block of items: their vocabulary, and with the weights their terms and pairs."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]) -> None:
        self.asked = [(i, c) for i, c in ((i, counted(t)) for i, t in rows) if c]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, c in self.asked for t in c}))}

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        self.pairs: dict[tuple, int] = {}
        self.items = []
        for i, counts in self.asked:
            terms = sorted(((q * weight[t], t) for t, q in ((self.vocabulary[x], q) for x, q in counts.items()) if weight.get(t, 0) > 0), reverse=True)
            terms = [(t, qw) for qw, t in terms]
            units = []
            for k in range(0, len(terms), 2):  # terms of like weight are paired: rare ones seldom peak in one document
                two = sorted(terms[k : k + 2])
                units.append((self.pairs.setdefault(tuple(two), len(self.pairs)) if len(two) == 2 else -1, two))
            self.items.append(Item(i, terms, units))


RAW = "doc_ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, members binary, counts binary"
SEGMENT = "doc_ids array<long>, terms array<int>, sizes array<int>, members binary, impacts binary, tops array<int>, joint array<long>"


def segments(docs: DataFrame, vocabulary: dict[bytes, int], most: int = DOCS) -> DataFrame:
    """Documents with terms, some thousands a row, with the postings of the vocabulary."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, term, member, count = [], [], array("i"), array("i"), array("q")

        def segment() -> pa.RecordBatch:
            t = np.frombuffer(term, np.int32)
            order = np.argsort(t, kind="stable")
            found, sizes = np.unique(t, return_counts=True)
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([found.tolist()], pa.list_(pa.int32())), pa.array([sizes.tolist()], pa.list_(pa.int32()))]
            columns += [pa.array([np.frombuffer(x, kind)[order].tobytes()], pa.binary()) for x, kind in ((member, np.int32), (count, np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RAW.split(", ")])

        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = counted(text)
                if not counts:
                    continue
                for x, n in counts.items():
                    if (t := vocabulary.get(x)) is not None:
                        term.append(t)
                        member.append(len(ids))
                        count.append(n)
                ids.append(i)
                lengths.append(sum(counts.values()))
                if len(ids) >= most or len(term) >= POSTINGS:
                    yield segment()
                    ids, lengths, term, member, count = [], [], array("i"), array("i"), array("q")
        if ids:
            yield segment()

    return rows.mapInArrow(run, RAW)


def statistics(raw: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L, and the documents of each term of the vocabulary (a row for each term goes to the driver)."""
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    n, length = raw.agg(F.sum(F.size("doc_ids")), F.sum(total)).first()
    df = raw.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes"))
    return n or 0, length or 0, {r[0]: r[1] for r in df.collect()}


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 75 + (25 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def with_bounds(raw: DataFrame, items: Items, n_docs: int, n_terms: int) -> DataFrame:
    """Segments with impacts, each term's greatest one, and the joint maxima of the items' pairs."""
    pairs = items.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                members, counts, lengths = np.frombuffer(r["members"], np.int32), np.frombuffer(r["counts"], np.int64), np.array(r["lengths"], np.int64)
                found = impacts(counts, lengths[members], n_docs, n_terms)
                ends = np.cumsum(r["sizes"], dtype=np.int64)
                at = {t: slice(int(e) - s, int(e)) for t, s, e in zip(r["terms"], r["sizes"], ends)}
                joint, held = np.zeros(len(pairs), np.int64), np.zeros(len(lengths), np.int64)
                for ((a, qa), (b, qb)), k in pairs.items():
                    if a in at and b in at:
                        held[members[at[a]]] = qa * found[at[a]]
                        first = held[members[at[b]]]
                        both = first > 0
                        if both.any():
                            joint[k] = (first + qb * found[at[b]])[both].max()
                        held[members[at[a]]] = 0
                tops = np.maximum.reduceat(found, ends - r["sizes"]) if len(found) else found
                columns = [pa.array([v], pa.list_(t)) for v, t in ((r["doc_ids"], pa.int64()), (r["terms"], pa.int32()), (r["sizes"], pa.int32()))]
                columns += [pa.array([r["members"]], pa.binary()), pa.array([found.astype(np.int32).tobytes()], pa.binary()), pa.array([tops.tolist()], pa.list_(pa.int32())), pa.array([joint.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SEGMENT.split(", ")])

    return raw.mapInArrow(run, SEGMENT)


class Best:
    """The k best documents so far: scores, whether the id is null, ids, in order of rank."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.nulls, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a further document must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        s, n, i = (np.concatenate(x) for x in ((self.scores, scores), (self.nulls, nulls), (self.ids, ids)))
        order = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.nulls, self.ids = s[order], n[order], i[order]


class Segment:
    def __init__(self, row: dict) -> None:
        ids = row["doc_ids"]
        self.nulls, self.ids = np.array([i is None for i in ids], bool), np.array([i or 0 for i in ids], np.int64)
        members, found = np.frombuffer(row["members"], np.int32), np.frombuffer(row["impacts"], np.int32).astype(np.int64)
        ends = np.cumsum(row["sizes"], dtype=np.int64)
        self.lists = {t: (members[e - s : e], found[e - s : e], top) for t, s, e, top in zip(row["terms"], row["sizes"], ends.tolist(), row["tops"])}
        self.joint = row["joint"]

    def bounded(self, item: Item, paired: bool = True) -> list[tuple[int, list[tuple[int, int]]]]:
        """The item's units that occur here by their bound, least first. paired: else each term is bounded by itself."""
        out = []
        for pair, terms in item.units:
            here = [(t, qw) for t, qw in terms if t in self.lists]
            single = [qw * self.lists[t][2] for t, qw in here]
            if len(here) == 2 and paired:
                out.append((max(self.joint[pair], *single), here))
            else:
                out += [(b, [x]) for b, x in zip(single, here)]
        return sorted(out)

    def search(self, item: Item, best: Best, paired: bool = True) -> int:
        """Add the item's documents of this segment to the best; gives the postings that were read."""
        units, to_beat, looked = self.bounded(item, paired), best.least(), 0
        below = np.cumsum([0, *(b for b, _ in units)], dtype=np.int64)
        if below[-1] < to_beat:
            return 0
        first = int(np.searchsorted(below, to_beat)) - 1  # units before this one can't reach the score together
        scores = np.zeros(len(self.ids), np.int64)
        for _, terms in units[first:]:
            for t, qw in terms:
                members, found, _ = self.lists[t]
                scores[members] += qw * found
                looked += len(members)
        left = np.flatnonzero(scores)
        for k in range(first - 1, -1, -1):
            left = left[scores[left] + below[k + 1] >= to_beat]
            if not len(left):
                return looked
            for t, qw in units[k][1]:
                members, found, _ = self.lists[t]
                at = np.minimum(np.searchsorted(members, left), len(members) - 1)
                hit = members[at] == left
                scores[left[hit]] += qw * found[at[hit]]
                looked += int(hit.sum())
        left = left[scores[left] >= to_beat]
        if len(left):
            best.add(scores[left], self.nulls[left], self.ids[left])
        return looked


def search(bounded: DataFrame, items: Items, k: int) -> DataFrame:
    """item (its number in the block), item_id, doc_id, score: each task's k best of each item."""
    asked = items.items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                for item, b in zip(asked, best):
                    segment.search(item, b)
        for n, (item, b) in enumerate(zip(asked, best)):
            if size := len(b.scores):
                columns = [pa.array([n] * size, pa.int32()), pa.array([item.item_id] * size, pa.int64()), pa.array(b.ids, pa.int64(), mask=b.nulls), pa.array(b.scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return bounded.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def rank(docs: DataFrame, asked: DataFrame, k: int = 20, block: int = ITEMS, segment: int = DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item.

    docs: doc_id, text; asked: item_id, text. The items of a block go to the driver and all tasks, up to about ``block`` rows; ``segment`` documents
    are searched at a time.
    """
    asked = asked.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).distinct()
    blocks = max(1, -(-asked.count() // block))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = Items([(r[0], None if r[1] is None else bytes(r[1])) for r in own.orderBy("item_id", "text").collect()])
        raw = materialise(segments(docs, items.vocabulary, segment), "segments")
        n_docs, n_terms, df = statistics(raw)
        items.weigh(n_docs, df)
        bounded = materialise(with_bounds(raw, items, n_docs, n_terms), "bounded-segments")
        found = search(bounded, items, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        out = out.unionByName(found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return out
