"""Chat formatting with any template, which is treated as a black box from turns to a string.

Prefixes of a conversation are rendered one turn longer each time; where an output continues the one
before, the added part is that turn's span. A second rendering with a marker in place of the text shows where the
text lies in the span. An output that doesn't continue the one before means that the template rewrites
history; the turn is flagged, and its span is what differs. The whole history is rendered for each turn, unless the
caller declares the template local (a turn's output doesn't depend on turns before the last, and no turn changes
them): then only the last turns are rendered past ``WINDOW`` turns, if that gave equal spans for the turns before.

Rows of a conversation are sorted by turn and streamed; a row is written for each turn, so with a local template no
conversation is held whole. Any other template takes all turns at once, so they are held for it.

Edge cases: null text counts as empty, null role as the empty role; rows of equal turn are ordered by role
and text and each is a turn; a null conv_id is a conversation of its own; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
WINDOW = 32
#: Characters of private use, of which one that the output doesn't hold marks the text's place.
MARKERS = range(0xE000, 0xF900)

# The control strings of the default template.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[SEP]", "[/ROLE]"]
_FORMS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string, so none is left."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def instruct_template(turns: list[Turn]) -> str:
    """Marks each turn by its role and escapes control strings in texts and roles."""
    out = []
    for role, text in turns:
        if role in _FORMS:
            out.append(_FORMS[role][0] + escape(text) + _FORMS[role][1])
        else:
            out.append(f"[ROLE]{escape(role)}[SEP]{escape(text)}[/ROLE]")
    return "".join(out)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a string that instruct_template made."""
    of_start = {a: (r, b) for r, (a, b) in _FORMS.items()}
    out, at = [], 0
    while at < len(formatted):
        m = _CONTROL.match(formatted, at)
        if m and m[0] in of_start:
            role, end = of_start[m[0]]
            stop = formatted.index(end, m.end())
            out.append((role, unescape(formatted[m.end() : stop])))
        elif m and m[0] == "[ROLE]":
            end, mid = "[/ROLE]", formatted.index("[SEP]", m.end())
            stop = formatted.index(end, mid)
            out.append((unescape(formatted[m.end() : mid]), unescape(formatted[mid + 5 : stop])))
        else:
            raise ValueError(f"no turn begins at {at}")
        at = stop + len(end)
    return out


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


class Spans:
    """Locates the spans of one conversation's turns, one turn after the other."""

    def __init__(self, template: Template, local: bool = False) -> None:
        self.template, self.turns, self.last, self.local = template, [], template([]), local

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """The turn's piece of output, where the text lies in it, and whether the output before was rewritten."""
        if len(self.turns) >= WINDOW and self.local:
            self.turns = self.turns[-1:]
            self.last = self.template(self.turns)
        before, prefix = self.turns, self.last
        now = self.template([*before, (role, text)])
        piece, start, end, rewritten = self._piece(before, prefix, now, role, text)
        if len(before) > 1 and self.local:
            try:
                short = self.template(before[-1:])
                near = self._piece(before[-1:], short, self.template([before[-1], (role, text)]), role, text)
            except Exception:  # a template may refuse a conversation that begins with this role
                near = None
            self.local = near == (piece, start, end, False)
        self.turns, self.last = [*before, (role, text)], now
        return piece, start, end, rewritten

    def _piece(self, before: list[Turn], prefix: str, now: str, role: str, text: str) -> tuple[str, int, int, bool]:
        same = _common(prefix, now)
        rewritten = same < len(prefix)
        piece = now[same:]
        marker = next(c for c in map(chr, MARKERS) if c not in now)
        marked = self.template([*before, (role, marker)])[same:]
        at = marked.find(marker)
        if at < 0:  # the template doesn't show the text
            return piece, 0, 0, rewritten
        return piece, at, len(piece) - (len(marked) - at - 1), rewritten


def _conversations(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(rows: DataFrame, template: Template = instruct_template, learn: tuple[str, ...] = ("assistant",), local: bool | None = None) -> DataFrame:
    """conv_id, n (turn number from 0), piece, start (in the conversation's output), loss_start, loss_end, rewritten.

    The pieces of a conversation in order make its formatted text; loss_start and loss_end (null for
    roles not in learn) are positions in it. Declare the template local where it is; None stands for instruct_template.
    """
    near = template is instruct_template if local is None else local

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = ()
        spans, n, at = None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if (conv,) != current:
                    current, spans, n, at = (conv,), Spans(template, near), 0, 0
                piece, a, b, rewritten = spans.add(role, text)
                loss = role in learn
                out.append((conv, n, piece, at, at + a if loss else None, at + b if loss else None, rewritten))
                n, at = n + 1, at + len(piece)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv_id", "n", "piece", "start", "loss_start", "loss_end", "rewritten"])

    return _conversations(rows).mapInArrow(run, "conv_id long, n long, piece string, start long, loss_start long, loss_end long, rewritten boolean")


def digest(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Read back what format_chats gave with instruct_template: digests of the turns and of the text under the loss mask.

    in_order: the rows come straight from format_chats in the same job, so they are dealt out and sorted already; a stored
    table is sorted first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns, loss, counts = None, None, None, [0, 0, 0]
        out: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def done():
            out.append((current[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def flush():
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for conv, piece, start, a, b in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (conv,) != current:
                    if current:
                        done()
                    current, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, text in read_turns(piece):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    counts[0] += 1
                if a is not None:
                    text = unescape(piece[a - start : b - start])
                    loss.update(text.encode("utf-8", "replace"))
                    counts[1] += len(text)
                counts[2] += len(piece)
            yield flush()
        if current:
            done()
            yield flush()

    rows = formatted if in_order else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "n")
    rows = rows.select("conv_id", "piece", "start", "loss_start", "loss_end")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
