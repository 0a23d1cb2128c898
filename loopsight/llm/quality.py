"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), votes bad (-1) or abstains (0). Rows are counted by their pattern of votes
(3 to the power of the rules at most); expectation-maximisation over those counts estimates, without
labels, how each rule votes on good and on bad documents and the share of good ones, and a document is
judged by its posterior probability of being good, not by all rules passing. The log odds of votes are
restricted (a vote never speaks against itself, and abstaining is not held against a document) within the
estimation, so the posterior that is given is that of the model that was fitted.

Edge cases: a null or empty text has no words and fails the base rules; an empty table gives an
empty table; rows are independent, so repeated rows get equal results; input columns named like a
result column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, without

# Frequent function words of English, French, German and Spanish.
COMMON = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "with", "de", "la", "le", "et", "les", "un", "une", "que", "der", "die", "und", "den", "mit", "ein", "zu", "el", "los", "en", "y", "del", "se"]
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_common"]
RULES = ["length", "symbols", "capitals", "exclaims", "lines", "repeats", "word_length", "function_words"]


def _let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash is found twice or more."""

    def among(pairs: Column) -> Column:
        same = lambda k, e: F.coalesce(F.get(pairs, k)["h"] == e["h"], F.lit(False))
        twice = F.filter(pairs, lambda e, k: same(k - 1, e) | same(k + 1, e))
        at = F.array_sort(F.transform(twice, lambda e: e["k"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        step = lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(5), x - s["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda s: s["n"])

    pairs = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(pairs, among))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules use, all as long."""
    docs = without(docs.withColumn("__t", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), *COUNTS)
    t = F.col("__t")
    words = F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda k: F.xxhash64(F.slice(w, k, 5)))
        return F.struct(
            F.size(w).alias("n_words"),
            F.when(F.size(w) < 6, 0).otherwise(_let(windows, _covered)).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(COMMON))).alias("n_common"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    found = docs.withColumns({"__w": _let(words, of_words), "__l": _let(lines, of_lines)})
    values = {
        "n_words": F.col("__w.n_words"), "word_chars": F.length(t) - _removed(t, " \t\n\x0b\f\r"), "n_symbols": _removed(t, SYMBOLS), "n_dup_lines": F.col("__l.n_dup_lines"), "n_repeat_words": F.col("__w.n_repeat_words"),
        "n_lines": F.col("__l.n_lines"), "n_upper": _removed(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_exclaims": _removed(t, "!"), "n_common": F.col("__w.n_common"),
    }
    return found.withColumns({k: v.cast("long") for k, v in values.items()}).drop("__t", "__w", "__l")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """A vote of each rule, from the counts: (bad where, good where), else it abstains.

    Not showing one defect is no evidence of quality, so most rules vote bad or abstain.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    # The thresholds of the rules, as ratios of the counts.
    cases = {
        "length": (n < 20, None),
        "symbols": (10 * F.col("n_symbols") > chars, None),
        "capitals": (10 * F.col("n_upper") > 4 * chars, None),
        "exclaims": (5 * F.col("n_exclaims") > n, None),
        "lines": (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), None),
        "repeats": (20 * F.col("n_repeat_words") > n, None),
        "word_length": ((2 * chars < 5 * n) | (chars > 14 * n), (chars >= 3 * n) & (chars <= 10 * n)),
        "function_words": ((F.col("n_common") == 0) & (n >= 20), 20 * F.col("n_common") >= n),
    }
    return {k: (F.when(bad, -1) if good is None else F.when(bad, -1).when(good, 1)).otherwise(0) for k, (bad, good) in cases.items()}


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents; by rule its accuracy where it votes, and the log odds of good that each vote adds."""

    prior: float
    accuracy: dict[str, float]
    odds: dict[str, dict[int, float]]

    def posterior(self) -> Column:
        score = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, v in votes().items():
            o = self.odds[k]
            score = score + F.when(v < 0, o[-1]).when(v > 0, o[1]).otherwise(o[0])
        return 1 / (1 + F.exp(-score))


def fit(counted: DataFrame, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns of all rows."""
    named = [v.alias(k) for k, v in votes().items()]
    rows = counted.select(*named).groupBy(*RULES).count().collect()  # 3 ** len(RULES) rows at most
    return expectation_maximisation([(tuple(r[k] for k in RULES), r["count"]) for r in rows], rounds)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> LabelModel:
    """How often each rule votes bad, abstains and votes good on good and on bad documents, without labels.

    It starts from rules that are right four times in five. Counts begin at 1, so no log is infinite.
    """
    patterns = sorted(patterns)
    values = (-1, 0, 1)
    good = [_share(math.log(4) * (1 + sum(p))) for p, _ in patterns]
    for _ in range(rounds):
        n_good = sum(n * g for (_, n), g in zip(patterns, good))
        prior = (n_good + 1) / (sum(n for _, n in patterns) + 2)
        tables = []
        for k in range(len(RULES)):
            seen = {(y, v): 1.0 for y in (0, 1) for v in values}
            for (p, n), g in zip(patterns, good):
                seen[1, p[k]] += n * g
                seen[0, p[k]] += n * (1 - g)
            tables.append({(y, v): c / sum(seen[y, w] for w in values) for (y, v), c in seen.items()})
        free = [{v: math.log(t[1, v] / t[0, v]) for v in values} for t in tables]
        odds = [{-1: min(0.0, o[-1]), 0: max(0.0, o[0]), 1: max(0.0, o[1])} for o in free]
        start = math.log(prior / (1 - prior))
        good = [_share(start + sum(o[v] for o, v in zip(odds, p))) for p, _ in patterns]
    accuracy = []
    for t in tables:
        right, wrong = prior * t[1, 1] + (1 - prior) * t[0, -1], prior * t[1, -1] + (1 - prior) * t[0, 1]
        accuracy.append(right / (right + wrong))
    return LabelModel(prior, dict(zip(RULES, accuracy)), dict(zip(RULES, odds)))


def _share(log_odds: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds))))


def judge(counted: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, quality (posterior probability of being good) and kept."""
    out = without(counted, "base_failed", "quality", "kept").withColumns({"base_failed": base_failed(), "quality": model.posterior()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
