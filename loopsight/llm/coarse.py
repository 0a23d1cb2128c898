"""A byte-level BPE file in a form in which the tokenizers library cuts a whole text only where the cut can change ids.

The library spends most of its time on the pre-tokens of a text: a string with alignments, a remembered word and its
copy for each. Merges of byte-level BPE are found inside pre-tokens, so hardly any cut between them matters: a cut can
change ids only if some merged token could lie across it. ``coarse_form`` checks every merge of the file. If none lies across
another boundary than those below, the library gets a form of the file whose bytes are the characters U+0000 to U+00FF
(instead of the file's printable ones) and which cuts at these alone:

* before the last character of a run of white space, if a character before it begins a merged token of white space, and
  behind line ends, which keeps pieces short;
* behind contractions (``'s``) that follow a letter, a digit or white space other than a blank.

No merge of a piece then lies across a boundary, so that the lowest-ranked merges inside each pre-token are made in the file's
order and the ids are the file's. ``is_plain`` tells for which texts this holds; all others, and all texts if the
check fails, need the file as it is.
"""

from __future__ import annotations

import json
import re

from .bpe import byte_characters

#: Characters of a line from which on the merges of one long piece cost more than its cuts would (measured: 128,000 cost less, 1,000,000 more).
LINE = 200_000

_TAIL = "\x80-\xbf"
#: UTF-8 bytes, as characters, of letters and of what is no letter, number or white space, in texts that are plain.
_LETTER = f"(?:[A-Za-z]|[\xc3-\xc9][{_TAIL}])"
_OTHER = f"(?:[\\x00-\\x08\\x0e-\\x1f!-/:-@\\[-`{{-\\x7f]|\xc2[{_TAIL}]|\xe2[{_TAIL}]{{2}})"
_CONTRACTION = "'(?:[stmd]|re|ve|ll)"
#: Cuts of the coarse form, beside those in white space: a piece ends with a match.
_CUTS = f"\n|(?:(?<=[0-9A-Za-z\\t-\\r])|(?<=[\xc3-\xc9][{_TAIL}])){_CONTRACTION}"
#: Tokens that can't lie across another boundary: those of one kind, parts of one character, and those with bytes that plain texts haven't.
_INSIDE = re.compile(
    f".*(?:[\xc0\xc1\xca-\xe1\xe3-\xff]|\xc2[\x80-\xa0]).*| ?{_LETTER}+| ?[0-9]+| ?{_OTHER}+|[\\t-\\r ]+|{_CONTRACTION}|[{_TAIL}]{{1,3}}| ?[\xc2-\xc9\xe2][{_TAIL}]?", re.S
)

#: Latin letters up to U+024F; with them signs that are no letter, number or white space.
_LATIN = "\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_STRANGE = re.compile(f"[^\\x00-\\x7f{_LATIN}\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf‐-‧‰-‾€™]")
#: An apostrophe before a letter that begins a contraction, but is none or belongs to signs or a blank before it.
_QUOTE = re.compile(f"'(?=[stmdrvl])(?!(?<=[0-9A-Za-z\\t-\\r{_LATIN}]')(?:[stmd]|re|ve|ll))")


def is_plain(text: str) -> bool:
    """Whether the coarse form gives this text the file's ids."""
    return not _QUOTE.search(text) and (text.isascii() or not _STRANGE.search(text))


def suits(text: str) -> bool:
    """Whether the coarse form gives this text the file's ids at less cost."""
    return (len(text) <= LINE or max(map(len, text.split("\n"))) <= LINE) and is_plain(text)


def as_bytes(text: str) -> str:
    """The text's UTF-8 bytes as characters, which is how the coarse form takes it."""
    return text.encode().decode("latin-1")


def coarse_form(source: str) -> str | None:
    """The coarse form of a tokenizer file's content, or None if the file isn't one of which it is known to give equal ids."""
    file = json.loads(source)
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(k) not in (None, False) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if file.get("normalizer") or file.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or not re.fullmatch("[!-~]+", x["content"]) for x in file["added_tokens"]):
        return None
    characters = byte_characters()
    known, to_byte = set(characters), str.maketrans({c: chr(b) for b, c in enumerate(characters)})
    if not known.issubset(model["vocab"]) or not all(known.issuperset(v) for v in model["vocab"]):
        return None
    merges = [[p.translate(to_byte) for p in (m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if not all(_INSIDE.fullmatch(a + b) for a, b in merges):
        return None
    model |= {"vocab": {v.translate(to_byte): i for v, i in model["vocab"].items()}, "merges": merges}
    # Those white space characters that are followed by another one in some token.
    first = "".join(sorted({c for a, b in merges if not (a + b).strip("\t\n\v\f\r ") for c in (a + b)[:-1]}))
    cuts = (f"[{first}][\\t-\\r ]*(?![^\\t-\\r ])|" if first else "") + _CUTS
    cut = {"type": "Split", "pattern": {"Regex": cuts}, "behavior": "MergedWithPrevious", "invert": False}
    return json.dumps(file | {"model": model, "pre_tokenizer": cut, "decoder": None, "truncation": None, "padding": None})
