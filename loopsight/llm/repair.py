"""Repair of conversation structure with an automaton that shares suffixes.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles. Each row is kept (cost 0), reroled to user or assistant
(2) or deleted (3, required of blank and repeated rows), and empty user or assistant rows are inserted anywhere (2); a
truncated row that stays adds 1. The audit is the initials of the cheapest edits (Keep, Rerole, Delete, Insert) in order;
of equal costs the least in ASCII.

What the cheapest edits are depends on a conversation's signature alone, a symbol a row for its role and fault. Cost-to-go
depends on the rest of a signature, so equal suffixes share one node: the different signatures are sorted by their
reversed form, and a task walks them with the path of nodes from the end at hand. A suffix is thus met in one stretch of the
order, and its four grammar states (start, after s, after u, after a) are resolved once for all conversations. A node holds the
first edit of each state, from which the audit is read off along the path; four different edits never begin with the same
initial, so the least audit is chosen by its first letter. Nodes of equal symbol and equal relative costs share their
edits.

Rows are dealt out by conversation and sorted there (Spark spills); a task holds one conversation's signature or audit, a byte
or so a row, as the result's own row does. The digest of a conversation is sequential, so one task reads it, as a stream.

Edge cases: null role, text, conv_id or turn count as one space in ``damage``; elsewhere null role and text count as empty. A null
conv_id is a conversation of its own. Rows come by turn, nulls first, then role and text. A role that begins with none of
s, u and a can't be kept. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialise, small_batches

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Grammar states: at the start, after s, after u, after a. What u or a may follow, and where it leads.
TURN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Where a kept row of an initial leads from a state.
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Rows of a conversation whose symbols are joined first.
STRETCH = 1024


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fault for about a quarter of the rows, by crc32 of conv_id:turn."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", F.when(case == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), F.array_repeat(F.lit(1), copies).alias("__copies"))
    return rows.withColumn("__copy", F.explode("__copies")).drop("__copies", "__copy")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos (from 1), fault (blank, duplicate, truncated or null), illegal (against the row before), new_turn."""
    w = Window.partitionBy("conv_id").orderBy(*_order())
    initial = lambda c: F.substring(c, 1, 1)
    pair = F.concat(initial(F.lag("role").over(w)), initial(F.col("role")))
    rows = _plain(rows).withColumns({"pos": F.row_number().over(w), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "new_turn": F.col("turn").isNotNull() & ~F.lag("turn").over(w).eqNullSafe(F.col("turn"))})
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(seen, "duplicate").when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated")
    return rows.withColumn("fault", fault)


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and signature: a symbol a row.

    d: must go; s, u, a, o: its role's initial (o: another one), upper case if the row is truncated.
    """
    found = faults(rows)
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    n = lambda c: F.count(F.when(c, 1))
    counts = {k: n(F.col("fault") == k) for k in ("blank", "duplicate", "truncated")} | {"illegal": n(F.col("illegal")), "turns": n(F.col("new_turn")), "first": F.min("turn"), "last": F.max("turn")}
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda e: e["s"]), "")
    parts = found.withColumn("part", F.floor((F.col("pos") - 1) / STRETCH)).groupBy("conv_id", "part").agg(*[v.alias(k) for k, v in counts.items()], joined(F.struct("pos", symbol.alias("s"))).alias("s"))
    sums = [F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal", "turns")]
    whole = parts.groupBy("conv_id").agg(*sums, F.min("first").alias("first"), F.max("last").alias("last"), joined(F.struct("part", "s")).alias("signature"))
    gaps = F.coalesce(F.col("last") - F.col("first") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "signature")


Node = tuple[tuple, tuple, int]


def _resolved(options: list[list[tuple]]) -> Node:
    """Costs and first edits of the four states from their edits other than Insert (cost, letter, next state)."""
    best = [min(o, default=(10**9, "~", -1)) for o in options]
    after_u = min(best[2], (INSERT + best[3][0], "I", 3))
    after_a = min(best[3], (INSERT + best[2][0], "I", 2))
    into_u = (INSERT + after_u[0], "I", 2)
    found = [min(best[0], into_u), min(best[1], into_u), after_u, after_a]
    least = min(x[0] for x in found)
    return tuple(x[0] - least for x in found), tuple(x[1:] for x in found), least


class Automaton:
    """Nodes of suffixes: (costs relative to the node's least, first edit and next state of each state, least cost)."""

    def __init__(self) -> None:
        self.steps: dict[tuple, Node] = {}
        self.end = _resolved([[(0, "", 0)], [], [], [(0, "", 3)]])
        self.path, self.symbols, self.made = [self.end], "", 0

    def node(self, symbol: str, after: Node) -> Node:
        """The node of a suffix that begins with the symbol."""
        costs, _, base = after
        found = self.steps.get((symbol, costs))
        if not found:
            options = [[(DELETE + c, "D", s)] for s, c in enumerate(costs)]
            if symbol != "d":
                extra, role = TRUNCATED * symbol.isupper(), symbol.lower()
                for s in range(4):
                    if (role, s) in KEPT:
                        options[s].append((costs[KEPT[role, s]] + extra, "K", KEPT[role, s]))
                    to = TURN[s][1]
                    options[s].append((REROLE + costs[to] + extra, "R", to))
            found = self.steps[symbol, costs] = _resolved(options)
        return found[0], found[1], found[2] + base

    def solve(self, reverse: str) -> tuple[int, str]:
        """Cost and audit of a signature given from its end; what it shares with the one before is kept."""
        same, most = 0, min(len(reverse), len(self.symbols))
        while same < most and reverse[same] == self.symbols[same]:
            same += 1
        del self.path[same + 1 :]
        for symbol in reverse[same:]:
            self.path.append(self.node(symbol, self.path[-1]))
            self.made += 1
        self.symbols = reverse
        state, audit, at = 0, [], len(reverse)
        while True:
            letter, to = self.path[at][1][state]
            if not letter:
                return self.path[-1][0][0] + self.path[-1][2], "".join(audit)
            audit.append(letter)
            state, at = to, at - (letter != "I")


def solve(signed: DataFrame) -> DataFrame:
    """signature, cost, audit of the different signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            found = [automaton.solve(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["reverse", "cost", "audit"])

    small_batches(signed.sparkSession)
    different = signed.select(F.reverse("signature").alias("reverse")).distinct()
    solved = different.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(run, "reverse string, cost long, audit string")
    return solved.select(F.reverse("reverse").alias("signature"), "cost", "audit")


def plan(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    signed = materialise(signatures(rows), "signatures")
    return signed.join(materialise(solve(signed), "audits"), "signature").drop("signature")


def edits(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, n (from 0), edit (K, R, D or I), role, text of each edit, as the audits say; the repaired conversation is all but D.

    Rows and a head with the audit are sorted together and streamed; the result is in order within a partition.
    """
    small_batches(rows.sparkSession)
    head = plans.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = head.unionByName(_plain(rows).withColumn("head", F.lit(1)))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "head", *_order()).select("conv_id", "head", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, out = None, "", 0, 0, []

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                role, state = TURN[state]
                out.append((conv, at, "I", role.encode(), b""))
                at += 1

        def batch_of() -> pa.RecordBatch:
            made = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["conv_id", "n", "edit", "role", "text"])

        for batch in batches:
            for i, head, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not head:
                    insert()
                    conv, audit, at, state = i, text.decode(), 0, 0
                    continue
                insert()
                edit = audit[at]
                if edit == "K":
                    state = KEPT[role[:1].decode(), state]
                elif edit == "R":
                    role, state = TURN[state][0].encode(), TURN[state][1]
                out.append((conv, at, edit, role, text))
                at += 1
            yield batch_of()
        insert()
        yield batch_of()

    made = both.mapInArrow(run, "conv_id long, n long, edit string, role binary, text binary")
    return made.select("conv_id", "n", "edit", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def digest(made: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id, repaired_sha256 of role:text of all but deleted rows, joined by newlines. in_order: straight from ``edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, out = None, None, []

        def batch_of() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])

        first = True
        for batch in batches:
            for conv, edit, row in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != current:
                    if current:
                        out.append((current[0], sha.hexdigest()))
                    current, sha, first = (conv,), hashlib.sha256(), True
                if edit != "D":
                    sha.update(row if first else b"\n" + row)
                    first = False
            yield batch_of()
        if current:
            out.append((current[0], sha.hexdigest()))
        yield batch_of()

    rows = made if in_order else made.repartition("conv_id").sortWithinPartitions("conv_id", "n")
    rows = rows.select("conv_id", "edit", F.concat("role", F.lit(":"), "text").cast("binary").alias("row"))
    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The plan and the repaired text's digest of each of the given conversations, zeros and empty texts where no row is left."""
    plans = materialise(plan(rows), "repair-plans")
    done = plans.join(digest(edits(rows, plans), in_order=True).withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    asked = ids.select(F.col("conv_id").cast("long").alias("__asked")).distinct()
    out = asked.join(done, F.col("__asked").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("__asked", "conv_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
