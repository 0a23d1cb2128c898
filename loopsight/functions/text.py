"""Column functions on command and edit texts: masks, normal forms, fingerprints and phrase rules.

Patterns use the ASCII meaning of \\s, \\d and \\b, so that they agree between engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement) of each mask, in the order they are applied.
TIMESTAMPS = [
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TIMESTAMP>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<TIMESTAMP>"),
    (r"\b\d{13}\b", "<TIMESTAMP>"),
    (r"\b\d{10}\b", "<TIMESTAMP>"),
]
_PORT = r"0*(?:6553[0-5]|655[0-2]\d|65[0-4]\d{2}|6[0-4]\d{3}|[1-5]\d{4}|[1-9]\d{0,3})"
PORTS = [
    (r"--port[= ](\d+)", r"--port $1"),
    (rf"--port {_PORT}(?!\d)", r"--port <PORT>"),
    (r"(?<!\w)-p[= ](\d+)", r"-p $1"),
    (rf"(?<!\w)-p {_PORT}(?!\d)", r"-p <PORT>"),
    (rf":(?:(?:0{{0,4}}[1-9]|0{{0,3}}[1-9]\d|0{{0,2}}[1-9]\d{{2}}|0?[1-9]\d{{3}})|6553[0-5]|655[0-2]\d|65[0-4]\d{{2}}|6[0-4]\d{{3}}|[1-5]\d{{4}})\b", r":<PORT>"),
]
TMP_PATHS = [
    (r"/var/folders/\S*", "<TMP_PATH>"),
    (r"/var/tmp/\S*", "<TMP_PATH>"),
    (r"/tmp/\S*", "<TMP_PATH>"),
    (r"[A-Za-z]:\\[^\s]*\\AppData\\Local\\Temp\\\S*", "<TMP_PATH>"),
    (r"[A-Za-z]:/[^\s]*/AppData/Local/Temp/\S*", "<TMP_PATH>"),
]
_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HASHES = [(_UUID, "<HASH>"), (r"\b[0-9a-fA-F]{64}\b", "<HASH>"), (r"\b[0-9a-fA-F]{40}\b", "<HASH>"), (r"\b[0-9a-fA-F]{32}\b", "<HASH>")]
VOLATILE = [(_UUID, "<HASH>"), (r"\b[0-9a-fA-F]{32,}\b", "<HASH>"), (r"/tmp/\S*", "<TMP>"), (r":\d{4,5}\b", ":<PORT>"), (r"\b\d{10,}\b", "<N>"), (r"\bsleep\s+\d+\b", "sleep <N>")]

# Phrases that claim completion, and phrases that verify one's own work (Korean and English).
COMPLETION = [
    r"완료\s*했\s*습니다|완료\s*하였\s*습니다|완료\s*됩니다", r"완료\s*되었\s*습니다|완료\s*됐\s*습니다", r"성공적\s*으로\s*(처리|완료|수행|작동|실행)",
    r"(작업|처리|수행|실행|설정|구현|수정|업데이트)\s*(이|가|은|는)?\s*완료", r"정상\s*(적\s*으로)?\s*완료", r"(모두|이미|전부|다)\s*완료", r"(마쳤|끝냈|끝마쳤)\s*습니다",
    r"successfully\s+(completed|processed|executed|finished|done)", r"task\s+(is\s+)?(completed|done|finished)", r"수정\s*(이|가)?\s*완료",
]
SELF_VERIFICATION = [
    r"(내|제)\s*가\s*(확인|검토|검사|점검)\s*(한|해\s*본)?\s*결과\s*(정상|문제\s*없|이상\s*없)", r"(저\s*는|나\s*는)\s*(확인|검토|검사)\s*(한|해)?\s*결과\s*(정상|문제\s*없|이상\s*없)",
    r"확인\s*(한|해\s*본)?\s*결과\s*정상\s*(적\s*으로)?\s*(작동|동작|실행|처리)", r"직접\s*(확인|검토|검사)\s*(했|하였)\s*(으니|으므로|했으니|했으므로)\s*(문제|이상)\s*없",
    r"(검증|확인)\s*(결과|했으며|하였으며)\s*(이상|문제)\s*없", r"(내|제)\s*가\s*(테스트|실행|확인)\s*(한|해\s*본)\s*결과\s*(정상|통과|문제\s*없|이상\s*없)",
    r"i\s+(verified|confirmed|checked)\s+(and\s+)?(it\s+)?(works|is\s+(fine|ok|correct|working|normal))", r"as\s+i\s+(confirmed|verified|checked|tested)",
]
SELF_REFERENCE = [
    r"이전\s*(응답|답변|출력|메시지|내용)\s*(에서|을|를|에|참조|참고)", r"(앞서|방금|이미)\s*(확인|언급|기술|작성)\s*(한|했던)?\s*(바|대로|바와\s*같이|것처럼)",
    r"(제|내)\s*가\s*(작성|생성|구현|작업)\s*(한|했던)\s*(코드|내용|결과|것)\s*(이니|이므로|이라서|이기\s*때문에|여서)", r"(제|내)\s*가\s*만든\s*(코드|내용|결과|것|출력)\s*(이니|이므로|이라서|이기\s*때문에|여서)",
    r"as\s+i\s+(mentioned|stated|said|noted|wrote)\s*(before|earlier|previously|above)?", r"(in\s+my\s+(previous|last|prior|earlier)\s+(response|answer|message|output))", r"(내|제)\s*가\s*(확인|검토|검증|점검)\s*(했|하였)\s*(으니|으므로|니까|니|므로)",
]
# Words of which each phrase above holds one at least, in capitals; a text without them needs no closer look.
COMPLETION_WORDS = ["완료", "성공적", "마쳤", "끝냈", "SUCCESSFULLY", "TASK"]
VERIFICATION_WORDS = ["확인", "검토", "검사", "점검", "검증", "테스트", "실행", "VERIFIED", "CONFIRMED", "CHECKED", "TESTED"]
REFERENCE_WORDS = ["이전", "앞서", "방금", "이미", "작성", "생성", "구현", "작업", "만든", "확인", "검토", "검증", "점검", "MENTIONED", "STATED", "SAID", "NOTED", "WROTE", "RESPONSE", "ANSWER", "MESSAGE", "OUTPUT"]
NO_PATH = "<unknown_path>"


def masked(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def mask_timestamps(text: Column) -> Column:
    return masked(text, TIMESTAMPS)


def mask_ports(text: Column) -> Column:
    return masked(text, PORTS)


def mask_tmp_paths(text: Column) -> Column:
    return masked(text, TMP_PATHS)


def mask_hashes(text: Column) -> Column:
    return masked(text, HASHES)


def mask_all(text: Column) -> Column:
    return mask_hashes(mask_tmp_paths(mask_ports(mask_timestamps(text))))


def mask_volatile(text: Column) -> Column:
    """Masks of shell commands; its tokens differ from those of mask_all."""
    return masked(text, VOLATILE)


def normalize_path(path: Column) -> Column:
    """Lexical normal form: no '.', '..' or empty steps, no trailing slash; a missing path has a name of its own."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    absolute = path.startswith("/")

    def push(done: Column, s: Column) -> Column:
        top = F.element_at(done, -1)
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(top, F.lit("")) != "..")
        lost = (s == "..") & absolute & (F.size(done) == 0)
        return F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).when(lost, done).otherwise(F.concat(done, F.array(s)))

    top = F.aggregate(steps, F.array().cast("array<string>"), lambda d, s: F.when(F.size(d) == 0, F.when((s == "..") & absolute, d).otherwise(F.array(s))).otherwise(push(d, s)))
    joined = F.array_join(top, "/")
    out = F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))
    return F.when(path.isNull() | (path == ""), NO_PATH).otherwise(out)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def edit_delta(old: Column, new: Column) -> Column:
    """Multiset difference of tokens: sorted -(token) and +(token), each as often as it was removed or added."""

    def gone(a: Column, b: Column, sign: str) -> Column:
        times = lambda x, t: F.size(F.filter(x, lambda y: y == t))
        return F.flatten(F.transform(F.array_distinct(a), lambda t: F.array_repeat(F.concat(F.lit(f"{sign}("), t, F.lit(")")), F.greatest(F.lit(0), times(a, t) - times(b, t)))))

    return F.array_join(F.array_sort(F.concat(gone(old, new, "-"), gone(new, old, "+"))), "\x1f")


def fp16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def digest_large(text: Column, most: int = 256) -> Column:
    return F.when(F.length(text) > most, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def canonical_json(text: Column) -> Column:
    """JSON with the keys of all objects sorted (by code units), at any depth and within arrays, and without spaces.

    Values keep their types and escapes, so different inputs stay different; numbers lose trailing zeros. What is no JSON, or
    names a key twice, stays as it is. Goes by way of VARIANT, which holds an object's fields in the order of their names.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def normalize_content(text: Column) -> Column:
    """Collapsed, lower-case, first 500 characters (the comparison form of a judged snippet)."""
    return F.substring(F.lower(collapse_space(text)), 1, 500)


def _begins(pattern: str) -> set[str]:
    """The characters that a phrase's first part, a literal or a group of alternatives, may begin with."""
    if not pattern.startswith("("):
        return {pattern[0]}
    depth, out = 0, {pattern[1]}
    for c, after in zip(pattern, pattern[1:]):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            break
        if c == "|" and depth == 1:
            out.add(after)
    return out


def says(text: Column, patterns: list[str], words: list[str]) -> Column:
    """Whether any pattern matches; the patterns are tried only on texts that hold one of the words, and where one can begin."""
    large = F.upper(text)
    begins = "".join(sorted(set().union(*map(_begins, patterns))))
    return reduce(lambda a, w: a | large.contains(w), words[1:], large.contains(words[0])) & text.rlike(f"(?iu)(?=[{begins}])(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def pattern_kinds(text: Column) -> Column:
    """Kinds of false-success phrases in a text, in fixed order; none for blank texts."""
    found = F.array(F.when(says(text, COMPLETION, COMPLETION_WORDS), "UNSUBSTANTIATED_COMPLETION"), F.when(says(text, SELF_VERIFICATION, VERIFICATION_WORDS), "SELF_REFERENTIAL_VERIFICATION"))
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).otherwise(F.array_compact(found))


def false_success(text: Column) -> Column:
    """Whether ``pattern_kinds`` finds any; the second kind is looked for where the first isn't found."""
    return F.coalesce(says(text, COMPLETION, COMPLETION_WORDS) | says(text, SELF_VERIFICATION, VERIFICATION_WORDS), F.lit(False))


def self_referential(text: Column) -> Column:
    return F.coalesce(says(text, [*SELF_VERIFICATION, *SELF_REFERENCE], [*VERIFICATION_WORDS, *REFERENCE_WORDS]), F.lit(False))
