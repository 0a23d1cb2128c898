"""Numbers, sums and neighbourhoods in order, whatever the ranges."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopsight.operators import prefix


def test_numbers_and_sums_equal_windows(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(k, r.choice(["hot", "hot", "hot", "b", None]), r.randrange(9)) for k in range(500)], "id long, g string, v long").repartition(7)
    w = Window.partitionBy("g").orderBy("id")
    want = {x["id"]: (x["n"], x["s"]) for x in rows.select("id", F.row_number().over(w).alias("n"), F.sum("v").over(w).alias("s")).collect()}
    got = prefix.running(rows, {"n": F.lit(1), "s": F.col("v")}, ["id"], ["g"]).collect()
    assert {x["id"]: (x["n"], x["s"]) for x in got} == want and len(got) == 500
    down = {x["id"]: x["n"] for x in prefix.numbered(rows, "n", [F.desc("id")]).collect()}
    assert down == {k: 500 - k for k in range(500)}
    assert prefix.numbered(rows.limit(0), "n", ["id"]).count() == 0


def test_neighbourhoods_hold_what_windows_need(spark):
    rows = spark.range(1, 101).select(F.col("id").alias("n"), F.lit("a").alias("g"))
    near = prefix.neighbourhood(rows, "n", 3, block=10)
    w = Window.partitionBy("g", "block").orderBy("n").rowsBetween(-3, 3)
    got = {x["n"]: x["c"] for x in near.withColumn("c", F.count("*").over(w)).filter("home").collect()}
    assert got == {n: min(100, n + 3) - max(1, n - 3) + 1 for n in range(1, 101)}
