"""A corpus pipeline: from raw documents to the digest of their token ids, each stage on what its predecessor kept.

Part of subpackage ``loopsight.llm``. Edge cases are those of the operators: null and empty texts fail the base rules
and go in the second stage; repeated rows are near duplicates, of which one stays; every stage of an empty table gives an
empty table. Every stage but the last returns the columns of its input with their values, whatever their names;
the last replaces columns named like its results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loopsight.llm import bpe, jaccard, mixing, quality, toxicity
from loopsight.llm.common import materialise

#: Columns that the stages' operators add; input columns of these names are set aside meanwhile.
ADDED = {"score", "predicted", "base_failed", "quality", "kept", "copy", "shuffle_key", *quality.COUNTS}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: SQL can't express the fitted and iterative stages; the tests compare them with brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with clashing columns renamed, and the names to give back."""
    taken = {c: f"__input_{c}" for c in docs.columns if c.lower() in ADDED}
    return docs.withColumnsRenamed(taken), {v: k for k, v in taken.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays under the threshold."""
    rows, names = _aside(docs)
    model = toxicity.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(rows).filter("predicted = 0").select(rows.columns).withColumnsRenamed(names)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior quality is at least a half."""
    rows, names = _aside(docs)
    counted = materialise(quality.with_counts(rows), "counts")  # texts are counted once, for the fit and the verdict
    return quality.judge(counted, quality.fit(counted)).filter("kept").select(rows.columns).withColumnsRenamed(names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a shingle similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to shares in proportion to the square root of each source's size, shuffled."""
    rows, names = _aside(docs)
    return mixing.mix(rows).select(rows.columns).withColumnsRenamed(names)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, beside the other columns."""
    return bpe.bpe_round_trip(docs, TOKENIZER).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs
