"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings, with log odds of toxic against other texts, is learned from a
bounded sample of labelled rows. The features of a text are the density, number and strength of its
lexicon words, their nearness to a second-person word, and the rates of capitals, punctuation and
obfuscated words. So that a row's own label does not shape its features, the lexicon for training
is learned from the other half of the sample; the final lexicon is learned from all of it.

Edge cases: null and empty texts have no words and are scored like any text; labels that are null or
of unknown documents are not used; a null doc_id counts as held out, as its label is not used; without labels of both kinds the score is the share of toxic
labels (0 if there are none); repeated rows get equal scores; input columns named like a result
column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialise, without

#: Labelled rows used for training at most: those with the least hash of their id.
SAMPLE = 30_000
#: Lexicon entries at most (those with the strongest log odds).
LEXICON = 20_000
#: Entries of toxic texts of the sample, those of most texts, whose odds are taken.
CANDIDATES = 10 * LEXICON
#: Words that a worker remembers before it starts anew.
REMEMBERED = 50_000
#: Toxic training texts that hold an entry at least, and its log odds at least.
SUPPORT, ODDS = 4, 3.0
THRESHOLD = 0.7

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros"}
# Insults of English, German, French and Spanish that a lexicon starts from.
SEED = ["idiot", "moron", "stupid", "scum", "trash", "clown", "loser", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "jerk", "idioten", "dumm", "trottel", "abschaum", "versager", "dreck", "ekelhaft", "imbécile", "abruti", "crétin", "ordure", "minable", "imbécil", "estúpido", "escoria", "basura", "patético"]
#: Log odds of a seed word, until so many texts of the sample hold it.
SEED_ODDS, SEED_SEEN = 6.0, 20
# Signs that stand for a letter in obfuscated words.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})
FEATURES = ["log_words", "strong_density", "strong_count", "weak_density", "top_odds", "top_three_odds", "nearness", "capitals", "exclaims", "punctuation", "obfuscated", "obfuscated_odds"]
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"\S+")
_MIXED = re.compile(r"[^\W\d_][\d@$!|*._-]+[^\W\d_]")


def entries(word: str) -> list[str]:
    """The lexicon entries that a lower-case word can match: itself, and its beginnings of 3 to 8 letters."""
    return [f"={word}", *(word[:k] for k in range(3, min(9, len(word))))]


class Odds(dict):
    """Greatest log odds of a word's lexicon entries (0 if none), remembered by word."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0)
        return out


def features(text: str | None, odds: Odds) -> list[float]:
    text = text or ""
    words = _LETTERS.findall(text.lower())
    n = max(1, len(words))
    found = list(map(odds.__getitem__, words))
    hits = [k for k, o in enumerate(found) if o]
    strong = sum(found[k] >= 5 for k in hits)
    top = sorted((found[k] for k in hits), reverse=True)[:3]
    near = 0.0
    if hits:
        at = [k for k, w in enumerate(words) if w in SECOND_PERSON]
        j = 0
        for k in hits:
            while j + 1 < len(at) and abs(at[j + 1] - k) <= abs(at[j] - k):
                j += 1
            if at:
                near = max(near, 1 / (1 + abs(at[j] - k)))
    mixed, hidden = 0, 0.0
    if _MIXED.search(text):
        for w in _TOKENS.findall(text):
            if _MIXED.search(w):
                mixed += 1
                for plain in _LETTERS.findall(w.lower().translate(SIGNS)):
                    hidden = max(hidden, odds[plain])
    chars = max(1, len(text))
    capitals = sum(map(str.isupper, _TOKENS.findall(text)))
    return [
        math.log1p(len(words)), strong / n, float(strong), (len(hits) - strong) / n, top[0] if top else 0.0, sum(top), near,
        capitals / n, (text.count("!") + text.count("?")) / chars, sum(map(text.count, ".,;:#$%&*|")) / chars, mixed / n, hidden,
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, label, half, part of at most ``size`` labelled documents that aren't held out (of a repeated doc_id, one text)."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    usable = usable.withColumn("h", F.xxhash64("doc_id", F.lit(7))).orderBy("h", "doc_id").limit(size)
    usable = usable.withColumns({"half": F.pmod("h", F.lit(2)), "part": F.pmod(F.floor(F.col("h") / 2), F.lit(3))}).drop("h")
    # The sample is bounded, so it can be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").groupBy("doc_id", "label", "half", "part").agg(F.min("text").alias("text"))
    return materialise(rows.select("text", "label", "half", "part"), "toxic-sample")


def _entry_counts(rows: DataFrame, among: set[str] | None) -> DataFrame:
    """entry, half, n: texts of each half that hold an entry."""
    shared = rows.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: set[str] = set()
                for w in set(_LETTERS.findall((text or "").lower())):
                    if (e := known.get(w)) is None:
                        if len(known) >= REMEMBERED // 2:
                            known.clear()
                        e = known[w] = [x for x in entries(w) if shared.value is None or x in shared.value]
                    own.update(e)
                counts[half].update(own)
        for half, c in counts.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([half] * len(c), pa.int64()), pa.array(c.values(), pa.int64())], names=["entry", "half", "n"])

    return rows.select("text", "half").mapInArrow(run, "entry string, half long, n long").groupBy("entry", "half").agg(F.sum("n").alias("n"))


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Log odds by entry, learned from half 0, from half 1 and from both; each is bounded by LEXICON."""
    sizes = {(r["label"], r["half"]): r["count"] for r in sample.groupBy("label", "half").count().collect()}
    toxic = _entry_counts(sample.filter("label = 1"), None)
    toxic = toxic.groupBy("entry").pivot("half", [0, 1]).agg(F.first("n")).na.fill(0).filter(F.col("0") + F.col("1") >= SUPPORT)
    toxic = toxic.orderBy((F.col("0") + F.col("1")).desc(), "entry").limit(CANDIDATES)
    bad = {r["entry"]: (r["0"], r["1"]) for r in toxic.collect()}
    other = {e: [0, 0] for e in bad}
    for r in _entry_counts(sample.filter("label = 0"), set(bad)).collect():
        other[r["entry"]][r["half"]] = r["n"]
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n1, n0 = (sum(sizes.get((k, h), 0) for h in halves) for k in (1, 0))
        found = {}
        for e, n in bad.items():
            a, b = sum(n[h] for h in halves), sum(other[e][h] for h in halves)
            if a >= SUPPORT * len(halves) / 2:
                odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
                if odds >= ODDS:
                    found[e] = odds
        for w in SEED:
            if sum(bad.get(f"={w}", (0, 0))) + sum(other.get(f"={w}", (0, 0))) < SEED_SEEN:
                found[f"={w}"] = SEED_ODDS
        out.append(dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]))
    return out


_odds: dict[bytes, Odds] = {}  # the lexicon of a worker's task, by its digest


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """Add the dense features as double columns."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    key = hashlib.blake2b(repr(sorted(lexicon.items())).encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def make(texts):
        if key not in _odds:
            _odds.clear()
            _odds[key] = Odds(shared.value)
        rows = [features(x, _odds[key]) for x in texts]
        return [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]

    return add_columns(docs, text, [T.StructField(f"_f_{k}", T.DoubleType()) for k in FEATURES], make)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None
    constant: float = 0.0

    def score(self, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """Add score (0 to 1) and predicted (1 from the threshold on)."""
        docs = without(docs, "score", "predicted")
        if self.trees is None:
            out = docs.withColumn("score", F.lit(self.constant))
        else:
            out = self.curve.transform(_margin(self.trees, with_features(docs, self.lexicon, text)))
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score")))
            out = out.withColumn("score", score).drop("_features", "_raw", "_p", "_y", "_margin", "_score", *[f"_f_{k}" for k in FEATURES])
        return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _margin(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    rows = VectorAssembler(inputCols=[f"_f_{k}" for k in FEATURES], outputCol="_features").transform(rows)
    return trees.transform(rows).withColumn("_margin", vector_to_array("_raw")[1])


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> ToxicityModel:
    """Lexicon, trees (two thirds of the sample) and isotonic curve (the other third)."""
    sample = training_sample(docs, labels, size)
    shares = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not shares["toxic"] or shares["toxic"] == shares["n"]:
        return ToxicityModel(constant=float(shares["toxic"] or 0) / max(1, shares["n"]))
    of_half_0, of_half_1, lexicon = learn_lexicons(sample)
    rows = with_features(sample.filter("half = 0"), of_half_1).unionByName(with_features(sample.filter("half = 1"), of_half_0))
    rows = materialise(rows.drop("text").withColumn("label", F.col("label").cast("double")), "toxic-features")
    train, check = rows.filter("part < 2"), rows.filter("part = 2")
    if train.select("label").distinct().count() < 2 or check.select("label").distinct().count() < 2:
        train = check = rows
    train = VectorAssembler(inputCols=[f"_f_{k}" for k in FEATURES], outputCol="_features").transform(train).select("label", "_features").coalesce(1).cache()
    trees = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_y", maxIter=20, maxDepth=3, stepSize=0.3, seed=1)
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_p").fit(train)
    train.unpersist()
    curve = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_score").fit(_margin(trees, check).select("label", "_margin"))
    return ToxicityModel(lexicon, trees, curve)
