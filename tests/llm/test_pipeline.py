"""Stages of the corpus pipeline: what each keeps, and the queries of the subpackage on the small tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from test_jaccard import brute
from test_native import WORD, counts, poisson
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from loopsight.llm import quality, queries

SF = "/root/testdata/sf0.001"


def kept_by_rules(rows):
    """Ids kept by the quality rules: counts, votes, estimates and posterior in plain Python."""
    patterns, votes = Counter(), {}
    for i, t in rows:
        n, c, symbols, dup, repeat = counts(t)
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        common, upper, exclaims = sum(w in quality.COMMON for w in WORD.findall(t or "")), len(re.findall("[A-Z]", t or "")), (t or "").count("!")
        v = (-(n < 20), -(10 * symbols > c), -(10 * upper > 4 * c), -(5 * exclaims > n), -(10 * dup > 3 * lines), -(20 * repeat > n), -1 if 2 * c < 5 * n or c > 14 * n else int(3 * n <= c <= 10 * n), -1 if not common and n >= 20 else int(20 * common >= n))
        votes[i] = (v, n < 10 or 100 * repeat > 20 * n)
        patterns[v] += 1
    good = {p: 1 / (1 + 4.0 ** -(1 + sum(p))) for p in patterns}
    for _ in range(50):
        prior = (sum(n * good[p] for p, n in patterns.items()) + 1) / (len(rows) + 2)
        odds = []
        for k in range(8):
            seen = lambda v, y: 1 + sum(n * (good[p] if y else 1 - good[p]) for p, n in patterns.items() if p[k] == v)  # noqa: B023, E731
            total = [sum(seen(v, y) for v in (-1, 0, 1)) for y in (0, 1)]
            o = {v: math.log(seen(v, 1) / total[1] / (seen(v, 0) / total[0])) for v in (-1, 0, 1)}
            odds.append({-1: min(0, o[-1]), 0: max(0, o[0]), 1: max(0, o[1])})
        score = {p: math.log(prior / (1 - prior)) + sum(o[v] for o, v in zip(odds, p)) for p in patterns}
        good = {p: 1 / (1 + math.exp(-x)) for p, x in score.items()}
    return {i for i, (v, failed) in votes.items() if not failed and good[v] >= 0.5}


def copies(rows):
    """Copies of each document by its source's rate, inverting the Poisson distribution at the hash of its id."""
    n = Counter(source for _, source in rows)
    all_w = sum(math.sqrt(x) for x in n.values())
    u = lambda i: int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return Counter({i: k for i, source in rows if (k := poisson(u(i), math.sqrt(n[source]) / all_w * len(rows) / n[source]))})


def test_each_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages, outs = dict(corpus_pipeline.STAGES), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, SF), f"brute-{k}")
        assert k == 4 or out.columns == docs.columns
        docs = out
        outs.append(docs.collect())
    rows = lambda k: [(r["doc_id"], r["text"]) for r in outs[k]]
    assert rows(0) and {i for i, _ in rows(0)} < set(texts)
    assert all(t == texts[i] for k in range(4) for i, t in rows(k))
    assert {i for i, _ in rows(1)} == kept_by_rules(rows(0)) and len(rows(1)) < len(rows(0))
    assert sorted(i for i, _ in rows(2)) == sorted({c for _, c in brute(rows(1)).values()})
    assert Counter(i for i, _ in rows(3)) == copies([(r["doc_id"], r["source"]) for r in outs[2]])
    library = Tokenizer.from_file(queries.TOKENIZER)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows(3)}
    want = sorted((i, len(ids[i]), hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest()) for i, _ in rows(3))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in outs[4]) == want
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, outs[4]))
    assert list(stages) == ["toxicity", "quality rules", "n-gram Jaccard join", "mixing sources", "BPE encoding and decoding"]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    clean = [i for i, t in toxic.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean) and sum(i not in kept for i, t in toxic.items() if t == 1) >= 0.8 * sum(toxic.values())


def test_stages_with_nulls_clashing_names_and_empty_tables(spark):
    """Every column null somewhere, columns named like each stage's own results, repeated rows, and no rows at all."""
    text = " ".join(f"the house{k} of river{k} walked{k}" for k in range(30))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, quality string, kept string, n_words string, copy string, shuffle_key string, base_failed string"
    own = ("s", "p", "q", "k", "w", "c", "key", "b")
    rows = [(k, f"{text} {k} {' '.join(f'x{k}y{j}' for j in range(60))}", None, ("a", None)[k % 2], None, *own) for k in range(12)]
    rows += [rows[3], (None, text, "en", "a", 1, *own), (50, None, None, None, None, *[None] * 8), (51, "", "en", "a", 0, *own), (52, "a\tb " * 30_000, "en", "a", 0, *own)]
    docs = spark.createDataFrame(rows, schema)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = corpus_pipeline.materialise(stage(spark, now, SF), f"odd-{k}")
            if k < 4:
                assert out.columns == docs.columns, name
                assert all((r["score"], r["copy"], r["n_words"]) in (("s", "c", "w"), (None, None, None)) for r in out.collect()), name
            now = out
        assert (now.count() == 0) == empty
        assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(now.columns)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_on_whole_tables(spark, name):
    assert name in entry.queries()
    table = {"op2": "embeddings", "op8": "pages", "op9": "conversations"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    found = queries.queries()[name](spark, SF).count()
    if name.split("_")[0] in ("op1", "op3", "op4", "op7", "op8", "op10"):
        assert found == n
    else:
        assert found > 0
