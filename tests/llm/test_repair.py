"""Conversation repair against all edit sequences (short conversations), a plain loop, and its SQL on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import compare
import duckdb
import pyarrow.parquet as pq
import pytest

from loopsight.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def every_way(signature):
    """Least (cost, audit) over all ways to keep, rerole, delete and insert up to two rows anywhere."""
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    rows = []
    for x in signature:
        rows.append([(3, "D", "")])
        if x != "d":
            rows[-1] += [(x.isupper(), "K", x.lower()), (2 + x.isupper(), "R", "u"), (2 + x.isupper(), "R", "a")]
    best = None
    for chosen in itertools.product(*rows):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            roles = "".join(added[0]) + "".join(r + "".join(g) for (_, _, r), g in zip(chosen, added[1:]))
            if GRAMMAR.fullmatch(roles):
                found = (sum(c for c, _, _ in chosen) + 2 * sum(map(len, added)), "I" * len(added[0]) + "".join(e + "I" * len(g) for (_, e, _), g in zip(chosen, added[1:])))
                best = min(best or found, found)
    return best


def test_least_edits_of_short_signatures():
    r = random.Random(2)
    short = ["".join(x) for n in range(3) for x in itertools.product("suaoSUAOd", repeat=n)] + ["".join(r.choices("suaoSUAOd", k=3)) for _ in range(10)]
    a = repair.Automaton()
    for s in sorted(x[::-1] for x in short):
        assert a.solve(s) == every_way(s[::-1]), s[::-1]


def by_loop(signature):
    """As the automaton, with whole audits compared, from the last row to the first."""
    after = {"": 0, "s": 1, "u": 2, "a": 3}
    allowed = {0: "su", 1: "u", 2: "a", 3: "u"}
    best = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    for x in reversed(signature):
        own = {}
        for s in range(4):
            ways = [(3 + best[s][0], "D" + best[s][1])]
            if x != "d":
                ways += [(x.isupper() + best[after[r]][0], "K" + best[after[r]][1]) for r in allowed[s] if r == x.lower()]
                ways += [(2 + x.isupper() + best[after[r]][0], "R" + best[after[r]][1]) for r in allowed[s] if r != "s"]
            own[s] = min(ways)
        for _ in range(4):
            own = {s: min([own[s], *((2 + own[after[r]][0], "I" + own[after[r]][1]) for r in allowed[s] if r != "s")]) for s in range(4)}
        best = own
    return best[0]


def test_suffixes_are_met_once_and_long_signatures_work():
    r = random.Random(3)
    tails = ["".join(r.choices("suaoSUAOd", k=9)) for _ in range(5)]
    signatures = {"".join(r.choices("suaod", k=r.randrange(12))) + r.choice(tails) for _ in range(300)}
    a = repair.Automaton()
    for x in sorted(s[::-1] for s in signatures):
        assert a.solve(x) == by_loop(x[::-1])
    assert a.made == len({s[k:] for s in signatures for k in range(len(s))})
    long = "".join(r.choices("suaoSUAOd", k=20_000))
    assert repair.Automaton().solve(long[::-1]) == by_loop(long)


def repaired(rows):
    """What the query returns for one conversation's rows (turn, role, text), in plain Python."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, signature, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        stripped = text.strip(" \t\n\v\f\r")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else None if stripped[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        i = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signature += "d" if fault in ("blank", "duplicate") else i.upper() if fault else i
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = by_loop(signature)
    out, left, last = [], iter(rows), ""
    for e in audit:
        role, text = ("", "") if e == "I" else next(left)[1:]
        if e in "IR":
            role = "assistant" if last == "u" else "user"
        if e != "D":
            out.append(f"{role}:{text}")
            last = role[0]
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, pos long, audit string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "superuser"], ["Yes.", "No", "", " \t", None, "Why?\n ", "Ünd.", "a.b", "!"]
    out = [(r.choice([*range(40), None]), r.choice([None, *range(9)]), r.choice(roles), r.choice(texts), 1, "x") for _ in range(400)]
    return out + out[:20] + [(77, k, ("user", "assistant")[k % 2], f"turn {k % 900}.", 1, "x") for k in range(3000)] + [(78, None, "user", None, None, None)]


def test_repair_equals_a_plain_loop_and_its_sql(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in repair.repair(repair.damage(df), df).collect()}
    want = {}
    for c, t, role, text, *_ in rows:
        own = want.setdefault(c, [])
        role, text, case = " " if role is None else role, " " if text is None else text, zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [(t, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    assert got == {c: repaired(x) for c, x in want.items()}
    short = df.filter("conv_id is null or conv_id != 77")  # the recursion in SQL carries whole texts
    pq.write_table(short.toArrow(), tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet')")
    assert not compare.differences(repair.repair(repair.damage(short), short), con, queries.oracle_sql()["op13_conversation_repair"])


def test_edits_keep_all_texts(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Again."), (1, 2, "user", " "), (2, 0, "system", "Be kind.")], "conv_id long, turn long, role string, text string")
    found = repair.edits(rows, repair.plan(rows)).orderBy("conv_id", "n").collect()
    assert [tuple(r)[2:] for r in found if r["conv_id"] == 1] == [("R", "user", "Hi."), ("K", "assistant", "Again."), ("D", "user", " ")]
    assert [tuple(r)[2:] for r in found if r["conv_id"] == 2] == [("D", "system", "Be kind.")]
    again = {r["conv_id"]: r["repaired_sha256"] for r in repair.digest(repair.edits(rows, repair.plan(rows)).repartition(5)).collect()}
    assert again == {1: hashlib.sha256(b"user:Hi.\nassistant:Again.").hexdigest(), 2: hashlib.sha256().hexdigest()}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none, none).collect() == []
