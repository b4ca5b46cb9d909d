"""Running numbers over large groups, worked out by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, groups: list[str], buckets: list[str | Column], order: list[str], out: str = "row_index") -> DataFrame:
    """Adds ``out``: the place of a row in its group, from 0, by ``buckets`` and then ``order``.

    Rows are sorted inside their bucket alone (a file, a day) and the buckets' counts are
    summed up, so a group of any size is dealt to many tasks. Without ``groups`` all rows are
    one group. Nulls sort first, as in any ascending order.
    """
    named = df.withColumns({f"__b{k}": F.col(b) if isinstance(b, str) else b for k, b in enumerate(buckets)})
    keys = [*groups, *[f"__b{k}" for k in range(len(buckets))]]
    inside = named.withColumn("__in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*groups).orderBy(*keys[len(groups) :]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    on = [F.col(k).eqNullSafe(F.col(f"__o{i}")) for i, k in enumerate(keys)]
    placed = inside.join(offsets, on).withColumn(out, (F.col("__offset") + F.col("__in")).cast("long"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
