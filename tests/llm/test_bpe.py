import json
import os
import random

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loopsight.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
ENCODER = bpe.Encoder(VOCABULARY)


def ids(text):
    return np.frombuffer(b"".join(ENCODER.encode(text)), "<u4").tolist()


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text_as_the_library(text):
    assert ids(text) == library(text)


def test_chunks_and_runs_as_the_library(monkeypatch):
    r = random.Random(5)
    parts = ["a", "the", "'s", "'r", "e", "'", "  ", "\n", " ", "1", "...", "é", "日本", "<|endoftext|>", "<|endof", "²", "　", "😀", "\x1c", "\x85"]
    monkeypatch.setattr(bpe, "CHUNK", 64)
    for _ in range(500):
        text = "".join(r.choice(parts) * r.choice([1, 1, 2, 50, 300]) for _ in range(r.randint(0, 12)))
        assert ids(text) == library(text)


def test_long_runs_are_streamed():
    for text in ("ab" * 60_000, " " * 80_001, "\n" * 70_000 + "x", "!?" * 40_000):
        assert ids(text) == library(text)
    run = bpe.Run(VOCABULARY)
    held = 0
    for _ in range(100):
        run.feed(b"abcdefgh" * 512)
        held = max(held, len(run.held))
    assert held < 2 * (run.step + VOCABULARY.lookahead)


def test_lookahead_covers_every_token():
    assert max(map(len, VOCABULARY.bytes_of.values())) <= VOCABULARY.lookahead + 1
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) >= 2


def made_up_vocabulary(r):
    """Bytes a, b, c and so on, and random merges of what is there."""
    known = [chr(97 + k) for k in range(r.randint(2, 4))]
    merges = []
    for _ in range(r.randint(1, 14)):
        a, b = r.choice(known), r.choice(known)
        if a + b not in known and len(a + b) <= 12:
            known.append(a + b)
            merges.append([a, b])
    model = {"vocab": {t: k for k, t in enumerate(known)}, "merges": merges}
    return bpe.Vocabulary(json.dumps({"model": model, "added_tokens": []})), known


@pytest.mark.parametrize("seed", range(20))
def test_emitted_tokens_are_stable_for_random_merge_lists(seed):
    r = random.Random(seed)
    for _ in range(25):
        v, known = made_up_vocabulary(r)
        for _ in range(15):
            data = "".join(r.choice(known) * r.choice([1, 1, 2, 5]) for _ in range(r.randint(0, 30))).encode()
            run, out = bpe.Run(v), []
            run.step = 1
            for k in range(len(data)):
                out += run.feed(data[k : k + 1])
                assert len(run.held) <= v.lookahead + max(map(len, v.bytes_of.values()))
            assert out + run.finish() == v.merged(data)


def test_decoder_state_machine():
    d = bpe.Decoder(VOCABULARY)
    packed = np.array(library("日本😀"), "<u4")
    assert "".join(d.feed(packed[k : k + 1].tobytes()) for k in range(len(packed))) + d.finish() == "日本😀"
    broken = [VOCABULARY.single[0xF0], VOCABULARY.single[0x41], VOCABULARY.single[0xE6]]
    d = bpe.Decoder(VOCABULARY)
    assert d.feed(np.array(broken, "<u4").tobytes()) + d.finish() == LIBRARY.decode(broken, skip_special_tokens=False)


def test_tables(odd, empty):
    rows = bpe.bpe_decode(bpe.bpe_encode(odd, PATH), PATH).collect()
    assert len(rows) == odd.count() and all(r["decoded"] == (r["text"] or "") and r["token_ids"] == library(r["text"] or "") for r in rows)
    found = bpe.bpe_round_trip(odd, PATH).collect()
    assert sorted(r["n_tokens"] for r in found) == sorted(len(r["token_ids"]) for r in rows)
    assert bpe.bpe_round_trip(empty, PATH).count() == 0


@pytest.mark.parametrize("name", ["ids"])
def test_a_clashing_column_is_replaced(odd, name):
    out = bpe.bpe_encode(odd.select("doc_id", "text", name), PATH, ids=name)
    assert out.columns.count(name) == 1 and dict(out.dtypes)[name] == "array<int>"
