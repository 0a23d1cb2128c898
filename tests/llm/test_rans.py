import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loopsight.llm import coarse, rans

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 32_769, 131_072, 131_073, 300_000])
@pytest.mark.parametrize("kinds", [1, 3, 50_000])
def test_segments_round_trip(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.3, n) % kinds).astype(np.uint32)
    assert (rans.decode(rans.encode(ids)) == ids).all()


def test_large_ids_round_trip():
    ids = np.array([0, 1 << 31, (1 << 32) - 1, 7] * 50, np.uint32)
    assert (rans.decode(rans.encode(ids)) == ids).all()


def test_damage_is_found():
    data = bytearray(rans.encode(np.arange(200_000, dtype=np.uint32) % 5000))
    data[len(data) // 2] ^= 1
    with pytest.raises(rans.ChecksumError):
        rans.decode(bytes(data))


def test_files(spark, odd, empty, tmp_path):
    rans.write_ids(odd, PATH, str(tmp_path / "a"), segment=5000)
    rows = rans.read_ids(spark, str(tmp_path / "a")).orderBy("start").collect()
    library, start = Tokenizer.from_file(PATH), 0
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 4, 5, 6]
    for r in rows:
        want = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], list(r["token_ids"]), r["ids_crc32"]) == (start, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    rans.write_ids(empty, PATH, str(tmp_path / "b"))
    assert rans.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_coarse_form_gives_the_files_ids():
    with open(PATH, encoding="utf-8") as f:
        source = f.read()
    own, form = rans._tokenizers((source, coarse.coarse_form(source)))
    some = [" ", "  ", "\n", "\n\n", "\t", "\x0b", "'", "''", "'s", "'ll", "'re", "l", "s", "tate", "é", "É", "”", "«", "¿", "ɏ", "7", ".", "--", "(", "<|endoftext|>", "\x00", "\x1c", " and", "ing", "The"]
    odd = ["\xa0", "\x85", "ª", "²", "×", "中", "日本の", "龍喚士", "😀", "Д", " ", "​"]
    rng = random.Random(3)
    texts = ["", *("".join(rng.choices(some + odd * (k % 3 == 0), k=rng.randint(1, 14))) for k in range(30_000))]
    plain = [t for t in texts if coarse.is_plain(t)]
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in rans.whole_texts((own, form), texts)] == want
    assert len(texts) / 3 < len(plain) < len(texts)
    # Where a text isn't plain, the coarse form alone wouldn't do.
    others = [k for k, t in enumerate(texts) if not coarse.is_plain(t)]
    assert any(form.encode(coarse.as_bytes(texts[k])).ids != want[k] for k in others[:200])


def test_white_space_tokens_of_a_file_decide_its_cuts():
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    for a, b in [("Ġ", "Ġ"), ("ĠĠ", "ĠĠ"), ("Ċ", "Ġ"), ("ĉ", "Ċ"), ("Ġ", "Ċ")]:
        file["model"]["merges"].append([a, b])
        file["model"]["vocab"].setdefault(a + b, len(file["model"]["vocab"]) + 1)
    source = json.dumps(file)
    own, form = rans._tokenizers((source, coarse.coarse_form(source)))
    rng = random.Random(5)
    texts = ["".join(rng.choices([" ", "\n", "\t", "\r", "x", "The", ".", "'s"], k=rng.randint(1, 12))) for _ in range(20_000)]
    assert all(form.encode(coarse.as_bytes(t)).ids == own.encode(t).ids for t in texts if coarse.is_plain(t))


def test_plain_texts_are_cut_in_few_places():
    """The library's cost grows with its pieces: one for each word before, one for each line now."""
    with open(PATH, encoding="utf-8") as f:
        source = f.read()
    line = "Le café n'était pas cher, il y avait 12 tables. " * 4
    text = "\n".join([line.strip()] * 50)
    assert coarse.is_plain(text)
    own, form = rans._tokenizers((source, coarse.coarse_form(source)))
    pieces = form.pre_tokenizer.pre_tokenize_str(coarse.as_bytes(text))
    assert len(pieces) == 50 < len(own.pre_tokenizer.pre_tokenize_str(text)) / 20


def test_texts_with_a_very_long_line_go_to_the_file_as_it_is():
    assert coarse.suits("many words\n" * 60_000)
    assert not coarse.suits("few words\n" + "many words " * 60_000)
    assert not coarse.suits("so 'tis")


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
        {"pre_tokenizer": None},
        {"merge": ["e", ","]},
        {"merge": ["Â", "e"]},
        {"merge": ["©", "e"]},
        {"merge": ["Ċ", "a"]},
    ],
)
def test_other_files_have_no_coarse_form(change):
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    assert coarse.coarse_form(json.dumps(file)) is not None
    if pair := change.pop("merge", None):
        file["model"]["merges"].append(pair)
        file["model"]["vocab"]["".join(pair)] = len(file["model"]["vocab"]) + 1
    assert coarse.coarse_form(json.dumps(file | change)) is None
