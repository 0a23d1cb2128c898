"""Main text of web pages by union-free wrappers inferred for each host.

A page becomes a stream of tags and text slots in which adjacent equal groups are folded to one repeated group.
Streams of the same host are aligned one by one: text against text is a slot, a group against one or more of
its occurrences is a repeated group, and what only one side has becomes an optional group. The result is the host's
wrapper, a regular expression without unions.

Each page is then matched against its host's wrapper: its folded stream is aligned with the wrapper's tokens, and a block of
text belongs to the slot that its first text falls into. What a page says in a slot, over all repetitions of the slot's group, is
one content. A slot outside of articles whose content is the same on all pages that have it is the template's; so is,
beside an article, a slot of a repeated group of records (two or more slots each, as comments and teasers are). All other blocks are
text, but for those in elements that name themselves as navigation, adverts, forms, comments and the like. Names only decide
where the element doesn't hold most of the page's text.

Edge cases: null and empty html give an empty text; an element that holds most of a page's text outside links, or of
the text of its articles where it has any, is no boilerplate; pages of a null or unreadable url share one host; a slot is constant by
three rows and two different pages at least, so a host with one page, or with copies of it only, has no template; what the
template says within article or main elements stays; repeated rows give equal texts; extra columns are kept, and those named
like a result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as characters
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_batches, without

#: Earlier occurrences of an item, the nearest first, that are tried as the end of a group that repeats.
TRIED = 256
#: Streams of a host merged in one group; more are merged in rounds.
FAN = 32
#: Cells of an alignment's table at most; beyond, the streams are halved first.
CELLS = 4096
#: Buckets that the pages of a host are dealt to where templates aren't broadcast.
BUCKETS = 16
#: Bytes of all templates' blocks up to which they are broadcast; beyond, pages are joined by host and bucket.
BROADCAST_BYTES = 16 << 20
#: Share of a wrapper's text that the main region holds at least.
SHARE = 0.8
#: Rows that have a template's slot at least (of two different pages).
LEAST_ROWS = 3

# Elements by kind, and names that mark boilerplate.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object"}
DROPPED = RAW | {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "audio", "video", "canvas", "map", "datalist"}
UNSEEN = RAW | {"head", "button", "select", "menu", "audio", "video", "canvas", "map", "datalist"}
STORY = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FRAME = {"html", "body", "div", "main", "article", "section", "center", "table", "tbody", "tr", "td", "ul", "ol", "dl", "header", "footer", "nav", "aside", "form"} | DROPPED
_THING = r"(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|popups?|modal|overlay|sidebars?|side-?nav|menus?|nav|navbar|navigation|breadcrumbs?|comments?|disqus|respond|replies|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|signup|login|search|footer|header|masthead|topbar|toolbar|widgets?|pagination|pager|tags|disclaimer|copyright|skip-link)"
#: A whole class or id; two-word names only of known pairs, as others name layouts, sections and titles.
MARKS = re.compile(rf"{_THING}|notice|notification|alert|(?:site|page|main|global|top|left|right|primary|secondary)[_-](?:nav|navbar|navigation|menu|header|footer|sidebar)|ads?[_-](?:slot|unit|box|banner|container|wrapper)|(?:cookie|consent|gdpr)s?[_-](?:banner|notice|bar|popup|consent|overlay)|(?:share|sharing|social)[_-](?:buttons|links|bar|icons|media)|comments?[_-](?:list|section|form|area)|(?:related|recommended)[_-](?:posts|articles|links|stories)|(?:newsletter|subscribe|signup|login|search)[_-](?:form|box|bar|signup|popup)|(?:nav|navigation)[_-](?:bar|menu|links)", re.I)
#: Words of a class or id that mark it wherever they stand, unless a word before them says that it has none or is around them.
_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "comment", "comments", "commenter", "notice", "notices", "cookie", "cookies", "consent", "newsletter", "disqus", "breadcrumb", "breadcrumbs", "sidebar"}
_AROUND = {"no", "of", "has", "have", "with", "without", "is", "not", "hide", "show", "after", "before", "layout", "page", "wrap", "wrapper", "container", "content", "main", "body-with", "count"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Most tags: values in double quotes without angle brackets; others are read step by step.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=\"']++|=\s*+\"[^\"<>]*+\")*+)>")
_STOP = re.compile(r"[>=]")
_QUOTE = re.compile(r"\s*([\"'])")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def marked(label: str) -> bool:
    """Whether a class or id names boilerplate: as a whole, or by one of its words."""
    if MARKS.fullmatch(label):
        return True
    words = [w.lower() for w in _WORD.findall(label)]
    return len(words) > 1 and not _WORDS.isdisjoint(words) and _AROUND.isdisjoint(words)


def events(page: str) -> list[tuple[str, str, str, bool]]:
    """Those of _events, where no element that holds most of the page's text, or of that of its articles, is dropped."""
    found = list(_events(page))
    names: list[str] = []
    opened: list[tuple[int, int, int]] = []  # event, characters of text and of articles' text before it
    held: list[tuple[int, int, int]] = []
    text = story = inside = links = 0

    def end(k: int) -> None:
        nonlocal inside
        for name, (e, t, u) in zip(names[k:], opened[k:]):
            inside -= name in STORY
            if found[e][3]:
                held.append((e, text - t, story - u))
        del names[k:], opened[k:]

    for e, (kind, name, value, dropped) in enumerate(found):
        if kind == "text":
            if not links and not (names and names[-1] in UNSEEN):
                n = len(value) if not value.isspace() else 0
                text += n
                story += n if inside else 0
        elif name == "a":
            links = kind == "open"
        elif kind == "close":
            if name in names:
                end(len(names) - 1 - names[::-1].index(name))
        elif name not in VOID and (name in FRAME or dropped):
            names.append(name)
            opened.append((e, text, story))
            inside += name in STORY
    end(0)
    for e, t, u in held:
        if found[e][1] not in UNSEEN and (2 * u > story if story else 2 * t > text):
            found[e] = (*found[e][:3], False)
    return found


class _Tags:
    """Ends of a page's tags. A quote counts only after an equals sign, and only if it is closed; each kind that isn't is looked for once."""

    def __init__(self, page: str) -> None:
        self.page, self.open = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.open:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.open.add(what)
        return k

    def end(self, at: int) -> int:
        """Position of the > that ends a tag, or -1."""
        if ">" in self.open:
            return -1
        while m := _STOP.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            if (q := _QUOTE.match(self.page, at)) and (k := self.find(q[1], q.end())) >= 0:
                at = k + 1
        self.open.add(">")
        return -1


def _events(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, name, value, dropped): kind is open, close or text; dropped marks an element as boilerplate by itself."""
    at, end, tags = 0, len(page), _Tags(page)
    while at < end:
        start = page.find("<", at)
        if start != at:
            start = end if start < 0 else start
            yield "text", "", page[at:start], False
            at = start
            continue
        if page.startswith("<!--", at):
            k = tags.find("-->", at + 4)
            at = end if k < 0 else k + 3
            continue
        if page.startswith(("<!", "<?"), at):
            k = tags.find(">", at)
            at = end if k < 0 else k + 1
            continue
        m = _PLAIN.match(page, at) or _NAME.match(page, at)
        stop = -1 if not m else m.end() - 1 if m.re is _PLAIN else tags.end(m.end())
        if stop < 0:  # no tag, or one that the page's end cuts off
            yield "text", "", "<" if not m else "", False
            at = at + 1 if not m else end
            continue
        name, own_text, at = m[2].lower(), page[m.end(2) : stop], stop + 1
        if m[1]:
            yield "close", name, "", False
            continue
        own = {a[0].lower(): next((v for v in a[1:] if v), "") for a in _ATTRIBUTE.findall(own_text)} if "=" in own_text or "hidden" in own_text else {}
        label = f"{own.get('class', '')} {own.get('id', '')}".split()
        dropped = name in DROPPED or own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or (name not in ("html", "body", "main", "article") and any(map(marked, label)))
        yield "open", name, own.get("class", "").strip().lower(), dropped
        if name in RAW and not own_text.endswith("/"):
            closing = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            yield "close", name, "", False
        elif own_text.endswith("/") and name not in VOID:
            yield "close", name, "", False


def _step(name: str, label: str) -> str:
    return f"{name}.{label.replace('/', '')}" if label else name


class Walk:
    """Follows the open framing elements of a page; unclosed ones end with the element around them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.path: list[str] = []
        self.dropped: list[bool] = []
        self.links = 0

    def open(self, name: str, label: str, dropped: bool) -> None:
        if name == "a":
            self.links = 1
        if name in VOID or not (name in FRAME or dropped):
            return
        self.names.append(name)
        self.path.append(_step(name, label))
        self.dropped.append(dropped or bool(self.dropped and self.dropped[-1]))

    def close(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name in self.names:
            k = len(self.names) - 1 - self.names[::-1].index(name)
            del self.names[k:], self.path[k:], self.dropped[k:]

    @property
    def out(self) -> bool:
        return bool(self.dropped and self.dropped[-1])


def stream(found: list[tuple[str, str, str, bool]]) -> tuple[list[str], dict[int, int], dict[str, int]]:
    """The tags and slots (#) of a page's events, the slot of each event of text, and the characters of text outside boilerplate and links by path."""
    walk, items, slots, mass = Walk(), [], {}, {}
    for e, (kind, name, value, dropped) in enumerate(found):
        if kind == "text":
            if not value.strip():
                continue
            if not items or items[-1] != "#":
                items.append("#")
            slots[e] = len(items) - 1
            if not walk.out and not walk.links:
                key = "/".join(walk.path)
                mass[key] = mass.get(key, 0) + len(value)
        elif kind == "open":
            walk.open(name, value, dropped)
            items.append(f"<{_step(name, value)}>")
        else:
            walk.close(name)
            items.append(f"</{name}>")
    return items, slots, mass


def fold(items: list) -> tuple[list, list]:
    """Adjacent equal groups become one repeated group ["+", ...]; inner groups are folded first.

    Beside the folded items stands which items each one is made of: numbers for an item, a list of such for a group.
    """
    out: list = []
    made: list = []
    at: dict[str, list[int]] = {}  # where an item stands in out

    def push(x: str | list, of: list) -> None:
        at.setdefault(_code(x), []).append(len(out))
        out.append(x)
        made.append(of)

    def pop(k: int) -> tuple[list, list]:
        gone = out[-k:], made[-k:]
        for x in reversed(gone[0]):
            at[_code(x)].pop()
        del out[-k:], made[-k:]
        return gone

    def join(a: list, b: list) -> list:
        return [*a, *b] if a and isinstance(a[0], int) else [join(x, y) for x, y in zip(a, b)]

    groups: list[int] = []  # where groups stand
    for n, x in enumerate(items):
        push(x, [n])
        again = True
        while again:
            again, last = False, len(out) - 1
            while groups and (groups[-1] > last or not isinstance(out[groups[-1]], list)):
                groups.pop()
            ends = [last - p for p in at[_code(out[-1])][-2 : -TRIED - 2 : -1]]
            whole = [last - g for g in reversed(groups[-TRIED:]) if g < last and len(out[g]) - 1 == last - g]
            for k in sorted({*ends, *whole}):
                if len(out) > k and isinstance(out[-k - 1], list) and out[-k - 1][1:] == out[-k:]:
                    _, own = pop(k)
                    made[-1] = [join(a, b) for a, b in zip(made[-1], own)]
                    again = True
                    break
                if len(out) >= 2 * k and out[-k:] == out[-2 * k : -k] and out[-k:] != ["#"]:
                    body, own = pop(k)
                    if k == 1 and isinstance(body[0], list):
                        made[-1] = join(made[-1], own[0])
                    else:
                        _, before = pop(k)
                        groups = [g for g in groups if g < len(out)]
                        push(["+", *body], [join(a, b) for a, b in zip(before, own)])
                        groups.append(len(out) - 1)
                    again = True
                    break
    return out, made


def shape(items: list[str]) -> str:
    return json.dumps(fold(items)[0], separators=(",", ":"))


def flat(folded: list, record: bool = False) -> list[tuple[str, bool]]:
    """The items of a folded stream or wrapper in order, and whether each is in a repeated group of two slots or more."""
    out: list[tuple[str, bool]] = []
    for x in folded:
        if isinstance(x, str):
            out.append((x, record))
        else:
            inner = flat(x[1:])
            many = x[0] == "+" and sum(y == "#" for y, _ in inner) > 1
            out += [(y, r or many or record) for y, r in inner]
    return out


def _leaves(made: list) -> list[list[int]]:
    return [y for x in made for y in ([x] if x and isinstance(x[0], int) else _leaves(x))]


class Wrapper:
    """A host's wrapper, ready to be matched against pages."""

    def __init__(self, folded: list) -> None:
        both = flat(folded)
        self.items, self.records = [x for x, _ in both], [r for _, r in both]
        self.known: dict[str, list[int]] = {}

    def match(self, items: list[str]) -> dict[int, int]:
        """The wrapper's slot of each slot of a page's stream. Streams of one shape are aligned once."""
        folded, made = fold(items)
        key = json.dumps(folded, separators=(",", ":"))
        if key not in self.known:
            own = [x for x, _ in flat(folded)]
            self.known[key] = [-1] * len(own)
            for i, j in common_items(own, self.items):
                self.known[key][i] = j
        return {n: slot for slot, numbers in zip(self.known[key], _leaves(made)) for n in numbers}


def _code(x: str | list) -> str:
    return x if isinstance(x, str) else json.dumps(x)


def _fold_by(items: list, groups: list[list]) -> list:
    """Occurrences of the other side's repeated groups become such groups."""
    there = Counter(map(_code, items))
    for g in {_code(g): g for g in groups}.values():
        if not there[_code(g[1])] and there[_code(g)] < 2:
            continue
        body, out, k = g[1:], [], 0
        while k < len(items):
            if items[k] == body[0] and items[k : k + len(body)] == body:
                if not (out and out[-1] == g):
                    out.append(g)
                k += len(body)
            else:
                if not (items[k] == g and out and out[-1] == g):
                    out.append(items[k])
                k += 1
        if len(out) != len(items) or out != items:
            there = Counter(map(_code, out))
        items = out
    return items


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of a with each prefix of b, a bit for each item of b."""
    at: dict[str, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        if x in at:
            u = v & at[x]
            v = ((v + u) | (v - u)) & full
    return [0, *accumulate(c == "0" for c in reversed(bin(v | 1 << len(b))[3:]))]


def common_items(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, in linear memory (Hirschberg)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if n == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0, b1)))
        elif n * m <= CELLS:
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n - 1, -1, -1):
                for j in range(m - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if a[a0 + i] == b[b0 + j] else max(best[i + 1][j], best[i][j + 1])
            i = j = 0
            while i < n and j < m:
                if a[a0 + i] == b[b0 + j]:
                    out.append((a0 + i, b0 + j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
        else:
            mid = (a0 + a1) // 2
            head, tail = _lengths(a[a0:mid], b[b0:b1]), _lengths(a[mid:a1][::-1], b[b0:b1][::-1])
            j = max(range(m + 1), key=lambda j: head[j] + tail[m - j])
            todo += [(a0, mid, b0, b0 + j), (mid, a1, b0 + j, b1)]
    return sorted(out)


def align(a: list, b: list) -> list:
    """The wrapper of two streams: what only one side has becomes an optional group ["?", ...]."""
    groups = lambda x: [y for y in x if isinstance(y, list) and y[0] == "+"]
    plain = lambda x: [z for y in x for z in (y[1:] if isinstance(y, list) and y[0] == "?" else [y])]
    may = {_code(z) for y in (*a, *b) if isinstance(y, list) and y[0] == "?" for z in y[1:]}
    a, b = plain(a), plain(b)
    a, b = _fold_by(a, groups(b)), _fold_by(b, groups(a))
    both, i, j = [], 0, 0
    for x, y in [*common_items([*map(_code, a)], [*map(_code, b)]), (len(a), len(b))]:
        both += [(z, False) for z in (*a[i:x], *b[j:y])] + [(z, True) for z in a[x : x + 1]]
        i, j = x + 1, y + 1
    out: list = []
    for x, common in both:
        if common and _code(x) not in may:
            out.append(x)
        elif out and isinstance(out[-1], list) and out[-1][0] == "?":
            out[-1].append(x)
        else:
            out.append(["?", x])
    return out


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tags and slots."""
    part = lambda x: f"({expression(x[1:])}){x[0]}" if isinstance(x, list) else x
    return "".join(map(part, wrapper))


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def blocks(found: list[tuple[str, str, str, bool]]) -> Iterator[tuple[int, bool, str]]:
    """(first event of text, whether in an article, text) of each block outside boilerplate, from a page's events."""
    walk, first, story, now = Walk(), -1, False, []

    def done() -> Iterator[tuple[int, bool, str]]:
        clean = " ".join(characters.unescape("".join(now)).split())
        now.clear()
        if clean:
            yield first, story, clean

    for e, (kind, name, value, dropped) in enumerate(found):
        if kind == "text":
            if not walk.out:
                if not now or first < 0:
                    first, story = -1, not STORY.isdisjoint(walk.names)
                if first < 0 and value.strip():
                    first = e
                now.append(value)
            continue
        if name not in INLINE and now:
            yield from done()
            first = -1
        if kind == "open":
            walk.open(name, value, dropped)
        else:
            walk.close(name)
    yield from done()


def placed(page: str, wrapper: Wrapper | None) -> list[tuple[int, bool, bool, str]]:
    """(slot of the wrapper or -1, in an article, in a group of records, text) of a page's blocks outside boilerplate."""
    found = events(page)
    items, slots, _ = stream(found)
    at = wrapper.match(items) if wrapper else {}
    out = []
    for e, story, text in blocks(found):
        slot = at.get(slots.get(e, -1), -1)
        out.append((slot, story, slot >= 0 and wrapper.records[slot], text))
    return out


def main_text(page: str, wrapper: Wrapper | None = None, template: frozenset[int] = frozenset()) -> str:
    """One page's text, given its host's wrapper and the slots that are the template's."""
    found = placed(page, wrapper)
    beside = any(story for _, story, _, _ in found)
    return " ".join(text for slot, story, record, text in found if story or not (slot in template or record and beside))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper (folded, as JSON), expression (the wrapper as a regular expression), region (the deepest element that holds most of a host's text)."""
    small_batches(pages.sparkSession)
    rows = pages.select(host(F.col(f"`{url}`").cast("string")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items, _, mass = stream(events(page or ""))
                sums[h, "shape", shape(items)] += 1
                for p, n in mass.items():
                    sums[h, "mass", p] += n
            yield pa.RecordBatch.from_arrays([*[pa.array([k[j] for k in sums], pa.string()) for j in range(3)], pa.array(list(sums.values()), pa.int64())], names=["host", "kind", "value", "n"])

    found = materialise(rows.mapInArrow(shapes, "host string, kind string, value string, n long").groupBy("host", "kind", "value").agg(F.sum("n").alias("n")), "shapes")

    # Paths up to each element above hold its text; the deepest with most of the host's text is the region.
    mass = found.filter("kind = 'mass'").select("host", "n", F.split("value", "/").alias("steps"))
    held = mass.select("host", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.struct(k.alias("size"), F.array_join(F.slice("steps", 1, k), "/").alias("top")))).alias("at")).groupBy("host", "at").agg(F.sum("n").alias("n"))
    total = mass.groupBy("host").agg(F.sum("n").alias("total"))
    regions = held.join(total, "host").filter(F.col("n") >= SHARE * F.col("total")).groupBy("host").agg(F.max("at").getField("top").alias("region"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [expression(json.loads(w)) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["host", "wrapper", "expression"])

    wrappers = merge(found.filter("kind = 'shape'").select("host", F.col("value").alias("wrapper"))).mapInArrow(written, "host string, wrapper string, expression string")
    return wrappers.join(regions, "host", "left").select("host", "wrapper", "expression", F.coalesce("region", F.lit("")).alias("region"))


def merge(streams: DataFrame) -> DataFrame:
    """One wrapper a host: groups of FAN streams are aligned, then groups of FAN results, and so on."""

    def of_group(pdf):
        import pandas as pd

        wrapper = None
        for v in sorted(set(pdf["wrapper"])):
            wrapper = json.loads(v) if wrapper is None else align(wrapper, json.loads(v))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(wrapper, separators=(",", ":"))]})

    while True:
        counts = materialise(streams.groupBy("host").agg(F.count("*").alias("n")), "counts")
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return streams
        group = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN)).alias("group")
        streams = materialise(streams.join(counts, "host").groupBy("host", group).applyInPandas(of_group, "host string, wrapper string"), "wrappers")
        if most <= FAN:
            return streams


BLOCKS = "array<struct<slot:int,story:boolean,record:boolean,text:string>>"


def matched(pages: DataFrame, wrappers: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The pages' columns (those of keep) but text and n_chars, with __host and __blocks: blocks outside boilerplate with the slots they fall into."""
    small_batches(pages.sparkSession)
    rows = without(pages.withColumn("__html", F.col(f"`{html}`").cast("string")).withColumn("__host", host(F.col(f"`{url}`").cast("string"))), "text", "n_chars")
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    shared = None
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in wrappers.select("host", "wrapper").collect()})
    else:  # hot hosts are dealt to buckets
        dealt = wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"), F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("__bucket"))
        rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__html"), F.lit(BUCKETS)).cast("int")).join(dealt, ["__host", "__bucket"], "left").drop("__bucket")
    kept = [f for f in rows.schema.fields if f.name == "__host" or f.name not in ("__html", "__wrapper") and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, T.StructField("__key", T.LongType()), T.StructField("__blocks", T._parse_datatype_string(BLOCKS))])
    block = pa.list_(pa.struct([("slot", pa.int32()), ("story", pa.bool_()), ("record", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple[str, Wrapper]] = {}
        for batch in batches:
            names, out, keys = batch.schema.names, [], []
            hosts, htmls = (batch.column(names.index(c)).to_pylist() for c in ("__host", "__html"))
            given = [shared.value.get(h) for h in hosts] if shared else batch.column(names.index("__wrapper")).to_pylist()
            for h, page, text in zip(hosts, htmls, given):
                if text is not None and (h not in ready or len(ready[h][1].known) > 10_000):
                    if len(ready) > 1000:
                        ready.clear()
                    ready[h] = (text, Wrapper(json.loads(text)))
                found = placed(page or "", ready[h][1] if text is not None else None)
                out.append([{"slot": s, "story": a, "record": r, "text": t} for s, a, r, t in found])
                keys.append(_key(page or ""))
            own = [batch.column(names.index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.int64()), pa.array(out, block)], names=[*[f.name for f in kept], "__key", "__blocks"])

    return rows.mapInArrow(run, schema)


def templates(found: DataFrame) -> DataFrame:
    """__host, __template: the slots outside of articles whose content is the same on all pages that have them."""
    # A page's content of a slot: its texts there in order, as one hash; rows of one page have one key.
    said = found.select("__host", "__key", F.expr("transform(array_distinct(transform(filter(__blocks, b -> b.slot >= 0 and not b.story), b -> b.slot)), s -> struct(s as slot, xxhash64(transform(filter(__blocks, b -> b.slot = s and not b.story), b -> b.text)) as content))").alias("s"))
    said = said.select("__host", "__key", F.explode("s").alias("s")).select("__host", "__key", "s.*")
    same = said.groupBy("__host", "slot").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b"), F.min("__key").alias("x"), F.max("__key").alias("y"))
    return same.filter((F.col("n") >= LEAST_ROWS) & (F.col("a") == F.col("b")) & (F.col("x") != F.col("y"))).groupBy("__host").agg(F.collect_list("slot").alias("__template"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add text (main text) and n_chars (its code points) to the pages' columns, or to those of keep (all are stored in between)."""
    wrappers = materialise(infer_wrappers(pages, url, html), "wrappers")
    found = materialise(matched(pages, wrappers, url, html, keep), "blocks")
    template = materialise(templates(found), "templates")
    rows = found.join(template, "__host", "left").drop("__host", "__key")
    beside = "exists(__blocks, b -> b.story)"
    kept = F.expr(f"filter(__blocks, b -> b.story or not (coalesce(array_contains(__template, b.slot), false) or (b.record and {beside})))")
    rows = rows.withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), " ")).drop("__blocks", "__template")
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
