"""Numbers and running sums in a total order, where a group may hold a large share of all rows.

Rows are sorted into ranges, summed within each range, and the ranges' totals (a row for each range and group) are summed
in order, so that no task holds a group whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def running(rows: DataFrame, sums: dict[str, Column], order: list[Column | str], by: list[str] | None = None, greatest: bool = False) -> DataFrame:
    """Add to each row the sums of the columns over its group's rows up to itself. ``order`` must tell all rows of a group apart.

    greatest: the greatest values over the rows before itself instead (null for the first).
    """
    by = by or []
    fold, empty, both = (F.max, F.lit(None), F.greatest) if greatest else (F.sum, F.lit(0), lambda a, b: a + b)
    given = stored(rows.withColumns({f"__{k}": v for k, v in sums.items()}), "rows")  # ranges are sampled first, which would make the rows twice
    ranged = given.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    within = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if greatest else 0)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range", *by).agg(*[fold(f"__{k}").alias(f"__total_{k}") for k in sums])
    totals = totals.select("__range", *by, *[F.coalesce(fold(f"__total_{k}").over(before), empty).alias(f"__before_{k}") for k in sums])
    totals = totals.toDF("__at", *[f"__by_{c}" for c in by], *[f"__before_{k}" for k in sums])
    same = F.col("__range") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = ranged.withColumns({k: fold(f"__{k}").over(within) for k in sums}).join(totals, same)
    return out.select(*rows.columns, *[both(F.col(k), F.col(f"__before_{k}")).alias(k) for k in sums])


def numbered(rows: DataFrame, name: str, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """Add the row's number in its group, from 1."""
    return running(rows, {name: F.lit(1).cast("long")}, order, by)


def neighbourhood(rows: DataFrame, number: str, reach: int, block: int = 10_000) -> DataFrame:
    """Rows by blocks of their number, each with the rows up to ``reach`` beside its block (home is false there).

    Windows of that reach over the number's group and block are right for the block's own rows.
    """
    n = F.col(number)
    own = F.floor(n / block)
    near = F.array_distinct(F.array(own, F.floor((n - reach) / block), F.floor((n + reach) / block)))
    return rows.withColumn("__own", own).withColumn("block", F.explode(near)).withColumn("home", F.col("block") == F.col("__own")).drop("__own")
