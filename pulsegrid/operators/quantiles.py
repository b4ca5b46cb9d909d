"""Exact medians of few groups with very many rows each, in bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Half width of the bracket in shares of a group, and the sketch that finds it; its error is a tenth of the width.
WIDTH, ACCURACY = 0.001, 10_000


def exact_medians(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """``by`` and the median of each column (doubles), of the two middle values their mean; nulls are left out.

    A sketch brackets the middle of each group; values below the bracket are counted and
    those inside are counted one by one, so that no task ever holds a group. A group without
    values has a null. Groups are few: their brackets go to every machine.
    """
    rows = df.select(by, *values).where(F.col(by).isNotNull())
    ends = F.array(F.lit(0.5 - WIDTH), F.lit(0.5 + WIDTH))
    brackets = rows.groupBy(by).agg(*[F.percentile_approx(v, ends, F.lit(ACCURACY)).alias(f"b_{v}") for v in values])
    # One row for each group.
    held = rows.join(F.broadcast(brackets), by)
    below = held.groupBy(by).agg(*[F.struct(F.count(v).alias("n"), F.count_if(F.col(v) < F.col(f"b_{v}")[0]).alias("below")).alias(v) for v in values])
    inside = F.filter(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).alias("x"), F.col(f"b_{v}").alias("b")) for v in values]), lambda s: (s["x"] >= s["b"][0]) & (s["x"] <= s["b"][1]))
    counts = held.select(by, F.explode(inside).alias("s")).groupBy(by, F.col("s.name").alias("name"), F.col("s.x").alias("x")).count()
    known = below.select(by, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).alias("k")) for v in values])).alias("s")).select(by, "s.name", "s.k.n", "s.k.below")
    upto = Window.partitionBy(by, "name").orderBy("x")
    placed = counts.withColumn("upto", F.sum("count").over(upto)).join(known, [by, "name"]).withColumn("upto", F.col("upto") + F.col("below"))
    low, high = F.floor((F.col("n") - 1) / 2) + 1, F.floor(F.col("n") / 2) + 1
    middle = placed.groupBy(by, "name").agg(((F.min(F.when(F.col("upto") >= low, F.col("x"))) + F.min(F.when(F.col("upto") >= high, F.col("x")))) / 2).alias("m"))
    wide = middle.groupBy(by).agg(*[F.max(F.when(F.col("name") == v, F.col("m"))).alias(v) for v in values])
    return rows.select(by).distinct().join(wide, by, "left")
