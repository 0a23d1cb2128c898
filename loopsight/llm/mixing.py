"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its target share of the output rows over the rows it has. Each document
gets a uniform number from a seeded hash of its id; inverting the Poisson distribution with the
source's rate at that number gives its count of copies, which are exploded and dealt out at random
over all partitions.

Edge cases: a null source is a source of its own; a source without a given weight gets none; rows
of equal doc_id get equal counts; the text is not looked at; an empty table gives an empty table;
input columns named ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, without

#: Bytes of the sources' steps up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(table: DataFrame) -> DataFrame:
    """source and steps, the distribution function at 0, 1, 2, ... as far as doubles tell it from 1, of sources with a rate above 0."""
    rate, k = F.col("rate"), F.col("k")
    most = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("long")
    rows = table.filter("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("k"))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("log_p", k * F.log(rate) - rate - F.sum(F.log(F.greatest(k, F.lit(1)).cast("double"))).over(up_to))
    rows = rows.withColumn("step", F.sum(F.exp("log_p")).over(up_to))
    return rows.groupBy("source").agg(F.sort_array(F.collect_list("step")).alias("steps"))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, total: float | None = None) -> DataFrame:
    """source, n, rate. weights: target share by source; without them, row counts to the given power.

    total: expected rows of the mixture; without it, as many as there are.
    """
    n = docs.groupBy(F.col("source")).agg(F.count("*").alias("n"))
    if weights is None:
        w = F.sqrt("n") if power == 0.5 else F.pow("n", F.lit(power))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").isNull() if name is None else F.col("source") == name, float(value)).otherwise(w)
    n = n.withColumn("w", w)
    sums = n.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    n = n.crossJoin(F.broadcast(sums))  # one row
    out = F.lit(float(total)) if total is not None else F.col("all_n")
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    return n.select("source", "n", (share * out / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """Each document as often as its count says, with copy (from 1) and shuffle_key, in random order."""
    docs = without(docs, "copy", "shuffle_key", "__rate_source", "__steps", "__u")
    table = materialise(poisson_steps(rates(docs, weights, power, total)), "steps").toDF("__rate_source", "__steps")
    if (table.agg(F.sum(8 * F.size("__steps") + F.length(F.coalesce("__rate_source", F.lit(""))) + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    found = docs.join(table, F.col("source").eqNullSafe(F.col("__rate_source"))).withColumn("__u", uniform(F.col("doc_id"), seed))
    count = F.size(F.filter("__steps", lambda c: c <= F.col("__u")))
    copies = found.withColumn("copy", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)))).drop("__rate_source", "__steps", "__u")
    key = F.md5(F.concat_ws(":", F.lit(f"{seed} order"), F.col("doc_id").cast("string"), F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
