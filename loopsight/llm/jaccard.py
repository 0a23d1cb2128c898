"""N-gram Jaccard join: documents whose word-shingle sets have a Jaccard similarity of at least 0.8.

1. Each text becomes a sorted array of 64-bit shingle hashes; equal sets form one class. With its size a class has
   a signature: a parity bitmap of its hashes.
2. A sketch with a fixed number of counters, filled from all documents, orders shingles from rare
   to frequent. Of the first quarter in that order linked sets share a twentieth of their size (prefix
   filter), which leaves out sets that share a passage only.
3. Tiles: classes with a common prefix shingle meet by size band, each with its own band and the next smaller one. A
   first round compares each class with one pivot of its tile; after that only classes still in different
   components meet. Sets differ in at least as many shingles as their bitmaps differ in bits, which bounds the
   overlap from above.
4. Pairs that pass are decided by exact intersection of the sorted arrays; components follow by
   alternating star contraction.

No link between different texts is lost, and no group is capped: rows of hot shingles are counted before they are
joined, and hot tiles are split into blocks. Signatures travel with the rows of the tiles.

Edge cases: null and empty texts have no shingles, stay alone and link with nothing; texts of one to
four words have their whole word sequence as one shingle; rows with equal doc_id count as rows of
that id; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

SHINGLE = 5
#: Counters of the frequency sketch (a power of two); 8 MB on the driver and each worker at any input size.
SKETCH = 1 << 21
PARTS = 64
#: Rows of a tile above which it is split.
TILE = 2048
#: Bits of a signature at least and at most; in between one to two times the size of the set.
LEAST_BITS, MOST_BITS = 64, 4096
#: Rows of a tile up to which its pairs are compared one by one rather than as arrays.
SMALL = 12
#: Ids of candidate documents that are broadcast at most (8 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text that are hashed at once.
PIECE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A scrambled value for each byte at each of the first positions of a word.
_TABLE = _mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: the scrambled values of its bytes by position, in sum, with its length."""
    sums, lengths, starts, inside = [], [], [], False
    for at in range(0, len(raw), PIECE):
        part = raw[at : at + PIECE]
        letter = ~_SPACE[part]
        edge = np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            length = last - first
            begin = np.cumsum(length) - length
            place = (np.arange(int(length.sum())) - np.repeat(begin, length)) * 256
            goes_on = inside and bool(letter[0])
            if goes_on:
                place[: length[0]] += 256 * int(lengths[-1][-1])
            place += _LOWER[part[letter]]
            values = _TABLE.take(place, mode="clip")
            far = np.flatnonzero(place >= len(_TABLE))
            values[far] = _mixed(place[far].astype(np.uint64) + np.uint64(1))
            total = np.add.reduceat(values, begin)
            if goes_on:
                sums[-1][-1:] += total[:1]
                lengths[-1][-1:] += length[:1]
                total, length, first = total[1:], length[1:], first[1:]
            if len(total):
                sums.append(total)
                lengths.append(length)
                starts.append(first + at)
        inside = bool(letter[-1])
    if not sums:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return _mixed(np.concatenate(sums) + np.concatenate(lengths).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.concatenate(starts)


_SEEDS = _mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def _grams(data: list[bytes]) -> Iterator[np.ndarray]:
    words, first = _word_hashes(np.frombuffer(b" ".join(data) + b" ", np.uint8))
    grams = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(grams) else 0):
        grams += words[k : len(words) - SHINGLE + 1 + k] * _SEEDS[k]
    grams = _mixed(grams)
    ends = np.searchsorted(first, np.cumsum([len(d) + 1 for d in data])).tolist()
    for a, b in zip([0, *ends], ends):
        n = b - a
        if n >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif n:
            yield _mixed(np.array([(words[a:b] * _SEEDS[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def shingles(texts: list[bytes | str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased, words cut at ASCII white space)."""
    held, size = [], 0
    for t in texts:
        data = t.encode("utf-8", "replace") if isinstance(t, str) else t or b""
        if held and size + len(data) > PIECE:
            yield from _grams(held)
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield from _grams(held)


def prefix_length(n: int) -> int:
    """Shingles of a set of n that are looked at: enough to hold 1 + n // 20 of those shared with any linked set."""
    return n - (4 * n + 4) // 5 + 1 + n // 20 if n else 0


def bitmap(items: np.ndarray) -> bytes:
    """Parity bitmap: a bit for each residue, set if an odd number of the shingles has it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(len(items) - 1).bit_length()))
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _texts(docs: DataFrame, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _counter(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def frequency_classes(docs: DataFrame, text: str = "text") -> bytes:
    """For each counter of the sketch the binary logarithm of its count, as a byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for s in shingles(_bytes_of(batch.column(0))):
                np.add.at(total, _counter(s), 1)
        if total.any():
            packed = [p.astype(np.min_scalar_type(p.max())).tobytes() for p in np.split(total, PARTS)]  # most counts of a task fit one byte or two
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, f"u{len(c) * PARTS // SKETCH}").astype(np.int64)
        if sums:
            packed = [np.log2(np.maximum(c, 1)).astype(np.uint8).tobytes() for c in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(packed, pa.binary())], names=["part", "classes"])

    counts = _texts(docs, text).select("text").mapInArrow(count, "part int, counts binary")
    found = counts.repartition(PARTS, "part").mapInArrow(add, "part int, classes binary").collect()  # PARTS rows, SKETCH bytes in all
    parts = {r["part"]: bytes(r["classes"]) for r in found}
    return b"".join(parts.get(k, bytes(SKETCH // PARTS)) for k in range(PARTS))


def shingle_sets(docs: DataFrame, classes: bytes, text: str = "text") -> DataFrame:
    """doc_id, set_id, key (its first half), n, and once in a task for each set prefix (rarest shingles) and bits (signature)."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.frombuffer(shared.value, np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            ids, sizes, prefixes, signatures = [], [], [], []
            for s in shingles(_bytes_of(batch.column(1))):
                key = _set_id(s)
                ids.append(key)
                sizes.append(len(s))
                first = len(s) > 0 and key not in seen
                if first and len(seen) < 200_000:
                    seen.add(key)
                order = np.argsort(of[_counter(s)], kind="stable") if first else None
                prefixes.append(s[order[: prefix_length(len(s))]].view(np.int64) if first else None)
                signatures.append(bitmap(s) if first else None)
            keys = [int.from_bytes(k[:8], "little", signed=True) for k in ids]
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set_id", "key", "n", "prefix", "bits"])

    return _texts(docs, text).mapInArrow(run, "doc_id long, set_id binary, key long, n long, prefix array<long>, bits binary")


def _set_id(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _items_of(docs: DataFrame, wanted: DataFrame, sets: DataFrame, text: str) -> DataFrame:
    """set_id and items (sorted shingles) of the wanted sets, from one document of each."""
    chosen = sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).join(wanted, "set_id").select(F.col("doc_id").alias("chosen")).distinct()
    chosen = materialise(chosen, "chosen")
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    rows = _texts(docs, text)
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(F.col("chosen")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for s in shingles(_bytes_of(batch.column(0))) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["set_id", "items"])

    return materialise(rows.select("text").mapInArrow(run, "set_id binary, items array<long>"), "items")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text: str) -> DataFrame:
    """Pairs (a, b) whose exact intersection reaches 0.8 of the union."""
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    arrays = _items_of(docs, wanted, sets, text)
    left = arrays.select(F.col("set_id").alias("a"), F.col("items").alias("a_items"))
    right = arrays.select(F.col("set_id").alias("b"), F.col("items").alias("b_items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_items", "b_items").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label (least node that links lead to), by alternating large and small stars until only stars are left."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # Done when each node has one edge, to a node without any.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and in = 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)) + F.lit(1e-9)).cast("int")


def _enough(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of sets that have as many of them (rows) as any link needs (the smallest linked set has 0.8 of n)."""
    return rows.withColumn("rows", F.count("*").over(Window.partitionBy(*by))).filter(F.col("rows") > F.floor(F.col("n") / 25))


def _candidates(sets: DataFrame) -> DataFrame:
    """shingle, set_id, n, rows, band: prefix shingles that several sets have, of the sets that have enough of them."""
    first = sets.filter("prefix is not null")
    rows = first.select("key", F.explode("prefix").alias("shingle"))
    # Counted first, so that a hot shingle's rows are summed in each task; the join can then split them.
    shared = rows.groupBy("shingle").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo != hi").select("shingle")
    rows = materialise(rows.join(materialise(shared, "shared"), "shingle", "left_semi"), "rows")
    owners = first.select("key", "set_id", "n").repartition("key").distinct()
    rows = rows.repartition("key").distinct().join(owners, "key")
    return materialise(_enough(rows, "key", "set_id").select("shingle", "set_id", "n", "rows", _band(F.col("n")).alias("band")), "live")


def _signed(sets: DataFrame, live: DataFrame) -> DataFrame:
    """set_id, n, bits of the sets in live."""
    wanted = materialise(live.select("set_id").distinct(), "wanted")
    return materialise(sets.filter("bits is not null").select("set_id", "n", "bits").join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "signed")


def possible(a_n: int, b_n: int, a: bytes, b: bytes) -> bool:
    """Whether sizes and bitmaps allow a similarity of 0.8: nine times the difference is at most the sum of sizes."""
    if 5 * a_n < 4 * b_n or 5 * b_n < 4 * a_n:
        return False
    least = min(len(a), len(b))
    x, y = (_folded(v, least) for v in (a, b))
    return 9 * (x ^ y).bit_count() <= a_n + b_n


def _folded(bits: bytes, size: int) -> int:
    """A parity bitmap of fewer residues: its parts one on the other."""
    out = 0
    for k in range(0, len(bits), size):
        out ^= int.from_bytes(bits[k : k + size], "little")
    return out


def _star_pairs(live: DataFrame, signed: DataFrame) -> DataFrame:
    """Each class with the pivot of every tile it is in, where they may be similar.

    The pivot is the class that shares most of its shingles: an original rather than one of its edited copies.
    """
    central = F.struct((-F.col("rows") / F.col("n")).alias("s"), "set_id")
    pivots = materialise(live.groupBy("shingle", "band").agg(F.min(central)["set_id"].alias("a")), "pivots")
    pairs = materialise(live.select("shingle", "band", F.col("set_id").alias("b")).join(pivots, ["shingle", "band"]).filter("a != b").select("a", "b").distinct(), "star")
    pairs = pairs.join(signed.toDF("a", "a_n", "a_bits"), "a").join(signed.toDF("b", "b_n", "b_bits"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [possible(*x) for x in zip(*(batch.column(c).to_pylist() for c in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(run, "a binary, b binary")


def _mixed_tiles(rows: DataFrame) -> DataFrame:
    """Rows (with size, the rows of their tile) of the tiles in which different components meet."""
    sizes = rows.groupBy("shingle", "tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.max("home").alias("any")).filter("lo != hi and any").select("shingle", "tile", "size")
    return rows.join(materialise(sizes, "sizes"), ["shingle", "tile"])


def tiles(live: DataFrame, labels: DataFrame) -> DataFrame:
    """shingle, tile (size band), set_id, n, label, home, size: classes by shingle in the tiles of their own band (home) and of the next larger one."""
    rows = live.select("shingle", "band", "set_id", "n").join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left")
    rows = rows.select("shingle", "set_id", "n", F.xxhash64(F.coalesce("label", "set_id")).alias("label"), F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("tile"), F.lit(False).alias("home")))).alias("t"))
    rows = materialise(rows.select("shingle", "set_id", "n", "label", "t.*"), "tiles")
    rows = materialise(_enough(_mixed_tiles(rows).drop("size"), "set_id", "tile").drop("rows"), "tiles")
    return _mixed_tiles(rows)


def _meeting(n: np.ndarray, label: np.ndarray, home: np.ndarray, left: np.ndarray | None, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's rows that sizes, labels and bitmaps allow; of one from each side where left is given."""
    least = min(map(len, bits))
    x = np.zeros((len(bits), least // 8), np.uint64)
    for k, b in enumerate(bits):
        for p in range(0, len(b), least):
            x[k] ^= np.frombuffer(b, np.uint64, least // 8, p)
    found = []
    for a in range(0, len(bits), 256):
        own = slice(a, a + 256)
        may = (label[own, None] != label) & (home[own, None] | home) & (5 * n[own, None] >= 4 * n) & (5 * n >= 4 * n[own, None])
        may &= left[own, None] & ~left if left is not None else np.arange(len(bits)) > np.arange(a, min(a + 256, len(bits)))[:, None]
        i, j = np.nonzero(may)
        for k in range(0, len(i), 8192):
            p, q = i[k : k + 8192] + a, j[k : k + 8192]
            near = 9 * np.bitwise_count(x[p] ^ x[q]).sum(axis=1, dtype=np.int64) <= n[p] + n[q]
            found.append((p[near], q[near]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.empty(0, int), np.empty(0, int))


def _tile_pairs(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of classes of different components in a tile that may be similar. Tiles of over TILE rows are cut into blocks, which meet two by two."""
    rows = rows.join(signed.select("set_id", "bits"), "set_id").withColumn("blocks", (F.col("size") / TILE).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks") + 1).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
    rows = rows.select("shingle", "tile", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "home", "set_id", "n", "label", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # pairs that were looked at
        key, held = None, []

        def meet() -> list[tuple[bytes, bytes]]:
            if len(held) < 2:
                return []
            if len(held) <= SMALL:
                out = [(x[2], y[2]) for x, y in combinations(held, 2) if x[4] != y[4] and (x[1] or y[1]) and (key[2] == key[3] or x[0] != y[0]) and new(x[2], y[2]) and possible(x[3], y[3], x[5], y[5])]
            else:
                block, home, ids, n, label, bits = zip(*held)
                left = np.array(block) == key[2] if key[2] != key[3] else None
                met = _meeting(np.array(n, np.int64), np.array(label, np.int64), np.array(home), left, bits)
                out = [(ids[i], ids[j]) for i, j in zip(*(x.tolist() for x in met)) if new(ids[i], ids[j])]
            return [(min(p), max(p)) for p in out]

        def new(a: bytes, b: bytes) -> bool:
            p = a + b if a < b else b + a
            if p in seen:
                return False
            if len(seen) >= 200_000:
                seen.clear()
            seen.add(p)
            return True

        def packed(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != key:
                    found += meet()
                    key, held = row[:4], []
                held.append(row[4:])
            yield packed(found)
        yield packed(meet())

    # Work grows faster than bytes, so small parts are not merged.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(parts, "shingle", "tile", "lo", "hi").sortWithinPartitions("shingle", "tile", "lo", "hi")
    return met.mapInArrow(run, "a binary, b binary").distinct()


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) of every document."""
    sets = materialise(shingle_sets(docs, frequency_classes(docs, text), text), "sets")
    live = _candidates(sets)
    signed = _signed(sets, live)

    links = materialise(_verified(_star_pairs(live, signed), docs, sets, text), "links")
    more = materialise(_verified(_tile_pairs(tiles(live, components(links)), signed), docs, sets, text), "links")
    labels = components(links.unionByName(more))

    own = sets.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least")).join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    own = materialise(own, "own")
    of_label = materialise(own.groupBy("label").agg(F.min("least").alias("component")), "of-label")
    of_set = own.join(of_label, "label").select("set_id", "component")
    out = sets.select("doc_id", "set_id", F.col("n").alias("n_shingles")).join(of_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without those that another of smaller doc_id stands for; rows of equal doc_id whose texts are linked, or both empty, count as one."""
    found = jaccard_components(docs, text).groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("rows"))
    found = materialise(found, "decisions")
    if found.filter("rows > 1 and doc_id is not null").limit(1).count():
        return _keep_one_row(docs, text)
    drop = found.filter("not stays").select("doc_id")
    if drop.count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def _keep_one_row(docs: DataFrame, text: str) -> DataFrame:
    """keep_one where ids repeat: rows are numbered, and the least doc_id of a component's rows stays."""
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col("__row").alias("doc_id"), F.col(f"`{text}`"))
    of_row = jaccard_components(numbered, text).select(F.col("doc_id").alias("__row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    known = rows.filter("doc_id is not null").select("__row", F.col("doc_id").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("of_text")).join(of_row, "__row")
    # Rows without shingles are linked with none but those of their own id.
    first = known.groupBy("component", F.when(F.col("component").isNull(), F.col("id")).alias("alone")).agg(F.min(F.struct("id", "of_text", "__row")).getField("__row").alias("__row"))
    kept = materialise(first.select("__row").unionByName(rows.filter("doc_id is null").select("__row")), "kept")
    return rows.join(kept, "__row", "left_semi").select(docs.columns)
