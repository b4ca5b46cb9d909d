"""Ranks and quantiles over groups of any size, and over all rows but those of one unit.

Running sums are worked out inside ranges of a distributed sort plus the ranges' totals. For
studies, cells of about equally many rows, cut by a sketch, say how many values of a unit lie
where. What a unit leaves behind when it is left out follows by subtraction: the cells tell
which few of them hold the quantile, and only their rows are looked at. So a study leaves out
every unit in turn and sorts none of the other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import materialise, sized

#: Rows of a cell at least, and cells of a value's name at most: so the table of cells is bounded.
CELL_ROWS, CELLS = 256, 4_096
#: Of the sketch that cuts the cells; it decides on speed alone.
ACCURACY = 5_000
#: Values of more rows than this are joined by broadcast, so that no task gets all of them.
FREQUENT = 100_000
#: Groups of at most this many rows are worked through by windows, each in a task.
GROUP_ROWS = 200_000


def short_groups(df: DataFrame, groups: list[str]) -> bool:
    """Whether each group may be worked through in a task; one count by group."""
    most = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= GROUP_ROWS


def window_rank(groups: list[str], value: str) -> Column:
    """The average rank of a value in its short group; nulls have none."""
    order = Window.partitionBy(*groups).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def _ranged(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``df`` written in ranges of a distributed sort, with ``__range``; equal rows share a range."""
    return materialise(df.repartitionByRange(*groups, *order).withColumn("__range", F.spark_partition_id()))


def _beside(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """``df`` to be joined by ``_same``: its keys are renamed."""
    return df.select(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(keys)], *values)


def _same(keys: list[str]) -> list:
    return [F.col(c).eqNullSafe(F.col(f"__o{k}")) for k, c in enumerate(keys)]


def running_sum(df: DataFrame, groups: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over a row's predecessors in its group by ``order``.

    A group is dealt to many ranges, so it may be of any size; its rows must differ in
    ``order``. The sorted table is written once.
    """
    ranged = _ranged(df, groups, order)
    place = [*groups, "__range"]
    before = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range and group in it.
    totals = ranged.groupBy(*place).agg(F.sum(weight).alias("__total"))
    ahead = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _beside(totals.withColumn("__offset", F.coalesce(F.sum("__total").over(ahead), F.lit(0))), place, "__offset")
    summed = ranged.withColumn("__in", F.coalesce(F.sum(weight).over(before), F.lit(0))).join(offsets, _same(place))
    return summed.withColumn(out, F.col("__offset") + F.col("__in")).select(*[F.col(f"`{c}`") for c in df.columns], out)


def places(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: a row's place in its group, from 0; rows equal in ``order`` follow one another in any order."""
    return running_sum(df.withColumn("__one", F.lit(1)), groups, order, "__one", out).drop("__one")


def previous(df: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the value of the row before in the group, null for the first; groups of any size."""
    ranged = _ranged(df, groups, order)
    place = [*groups, "__range"]
    inside = Window.partitionBy(*place).orderBy(*order)
    # A row for each range and group in it: its last value goes on to the next.
    ends = ranged.groupBy(*place).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__end"))
    carried = ends.withColumn("__carried", F.lag("__end.v").over(Window.partitionBy(*groups).orderBy("__range")))
    found = ranged.withColumn("__n", F.row_number().over(inside)).withColumn("__before", F.lag(value).over(inside)).join(_beside(carried, place, "__carried"), _same(place))
    return found.withColumn(out, F.when(F.col("__n") == 1, F.col("__carried")).otherwise(F.col("__before"))).select(*[F.col(f"`{c}`") for c in df.columns], out)


def _blocks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The distinct known values of each group with their rows ``__c`` and the rows of lower values ``__below``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c"))
    return running_sum(counts, groups, [value], "__c", "__below")


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the average rank of a value in its group; nulls have none.

    Groups and ties may be of any size: values are counted before they are sorted, and those
    of over ``FREQUENT`` rows get their rank without a shuffle.
    """
    keys = [*groups, value]
    ranks = materialise(_blocks(df, groups, value).withColumn("__rank", F.col("__below") + (F.col("__c") + 1) / 2))
    often = _beside(ranks.where(F.col("__c") > FREQUENT).withColumn("__often", F.col("__rank")), keys, "__often")
    rest = _beside(ranks.where(F.col("__c") <= FREQUENT).withColumn("__at", F.lit(0)), keys, "__rank", "__at")
    held = df.join(sized(often), _same(keys), "left").drop(*[f"__o{k}" for k in range(len(keys))])
    # Rows that need no partner are dealt out.
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 16)) + 1
    held = held.withColumn("__salt", F.when(F.col("__often").isNotNull() | F.col(value).isNull(), spread).otherwise(F.lit(0)))
    joined = held.join(rest, [*_same(keys), F.col("__salt") == F.col("__at")], "left")
    return joined.withColumn(out, F.coalesce("__often", "__rank")).select(*[F.col(f"`{c}`") for c in df.columns], out)


def quantiles(df: DataFrame, groups: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``groups, <name>...``: exact quantiles of the known values of each group, interpolated between ranks.

    Groups may be of any size; one without a known value has no row.
    """
    blocks = materialise(_blocks(df, groups, value))
    totals = _beside(blocks.groupBy(*groups).agg(F.sum("__c").alias("__n")), groups, "__n")
    rows = blocks.join(sized(materialise(totals)), _same(groups))

    def at(q: float):
        spot = F.lit(q) * (F.col("__n") - 1)
        value_at = lambda k: F.min(F.when(F.col("__below") + F.col("__c") > k, F.col(value)))
        low, high, share = value_at(F.floor(spot)), value_at(F.ceil(spot)), F.max(spot - F.floor(spot))
        return F.when(low == high, low.cast("double")).otherwise(low * (1 - share) + high * share)

    return rows.groupBy(*groups).agg(*[at(q).alias(name) for name, q in wanted.items()])


class SortedCells:
    """Values ``name, unit, v``, dealt to cells of neighbouring values; nulls are left out.

    A sketch gives the ends of the cells, so nothing is sorted. ``rows`` is read a few times,
    so it should be stored or follow cheaply from what is. With ``names`` it has ``unit`` and
    a column for each name instead, and goes by name only when the cells are known.
    """

    def __init__(self, rows: DataFrame, names: list[str] | None = None) -> None:
        long = rows
        ship(long.sparkSession)
        marks = F.lit(np.arange(1, CELLS) / CELLS)
        if names is None:
            known = long.where("v IS NOT NULL AND unit IS NOT NULL")
            # One row for each name.
            told = known.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", marks, ACCURACY).alias("ends")).collect()
        else:
            known = rows.where("unit IS NOT NULL")
            each = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.percentile_approx(c, marks, ACCURACY).alias("ends")) for c in names]
            told = [x for x in known.agg(F.array(*each).alias("x")).first()["x"] if x["n"]]
        self.sizes = {r["name"]: r["n"] for r in told}
        ends = {r["name"]: r["ends"][(step := -(-CELLS // max(1, r["n"] // CELL_ROWS))) - 1 :: step] for r in told}
        self.rows = _in_cells(known, ends) if names is None else _columns_in_cells(known, ends)
        self.own = materialise(self.rows.groupBy("name", "unit", "cell").agg(F.count(F.lit(1)).alias("own"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        cells = self.own.groupBy("name", "cell").agg(F.sum("own").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow().to_pandas()
        found = {name: g.sort_values("cell") for name, g in cells.groupby("name")}
        self.cells = long.sparkSession.sparkContext.broadcast({name: tuple(g[c].to_numpy() for c in ("cell", "n", "lo", "hi")) for name, g in found.items()})

    def quantiles_without(self, units: DataFrame, q: float = 0.5, around: DataFrame | None = None) -> DataFrame:
        """``name, unit, value``: the quantile of all values but the unit's own, for each of ``units``.

        Between ranks it interpolates. With ``around`` (``name, unit, m``) it is the quantile
        of the values' distances from ``m``. A unit without which no value is left has no row.
        """
        spark = self.rows.sparkSession
        names = spark.createDataFrame([(n,) for n in self.sizes], "name string")
        # A row for each unit and name: those that have no value of that name are left out of nothing.
        every = units.select("unit").where("unit IS NOT NULL").distinct().crossJoin(F.broadcast(names))
        asked = self.own.select("name", "unit", "cell", "own").unionByName(every.select("name", "unit", F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("own")))
        asked = asked.join(units.select(F.col("unit").alias("u")).distinct(), F.col("unit") == F.col("u"), "left_semi")
        if around is None:
            asked = asked.withColumn("m", F.lit(None).cast("double"))
        else:
            asked = asked.join(around.select("name", "unit", F.col("m").cast("double").alias("m")), ["name", "unit"])
        kind = units.schema["unit"].dataType.simpleString()
        searched = asked.groupBy("unit").applyInPandas(_search(self.cells, q, around is not None), f"name string, unit {kind}, m double, first long, second long, share double, cell long")
        searched = materialise(searched)
        rows = self.rows.select("name", "cell", F.col("unit").alias("other"), "v")
        value = F.col("v") if around is None else F.abs(F.col("v") - F.col("m"))
        near = rows.join(sized(searched), ["name", "cell"]).where("other <> unit").withColumn("d", value)
        counts = near.groupBy("name", "unit", "first", "second", "share", "d").agg(F.count(F.lit(1)).alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("name", "unit").orderBy("d")))
        low, high = F.min(F.when(F.col("upto") >= F.col("first"), F.col("d"))), F.min(F.when(F.col("upto") >= F.col("second"), F.col("d")))
        return upto.groupBy("name", "unit").agg((low + (high - low) * F.max("share")).alias("value"))


def _splits(ends: dict[str, list[float]]) -> list[list[float]]:
    return [[-np.inf, *(sorted({e for e in found if np.isfinite(e)}) or [0.0]), np.inf] for found in ends.values()]


def _columns_in_cells(wide: DataFrame, ends: dict[str, list[float]]) -> DataFrame:
    """``name, unit, v, cell`` of the known values of the columns ``ends`` names; a row is dealt once for each of them."""
    cells = {n: f"__c{k}" for k, n in enumerate(ends)}
    placed = Bucketizer(splitsArray=_splits(ends), inputCols=list(cells), outputCols=list(cells.values()), handleInvalid="keep").transform(wide) if ends else wide
    each = [F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v"), F.col(c).cast("long").alias("cell")) for n, c in cells.items()]
    none = F.array().cast("array<struct<name:string,v:double,cell:bigint>>")
    long = placed.select("unit", F.explode(F.array(*each) if each else none).alias("x"))
    return long.select("x.name", "unit", "x.v", "x.cell").where("v IS NOT NULL")


def _in_cells(known: DataFrame, ends: dict[str, list[float]]) -> DataFrame:
    """Adds ``cell``: the place of a value between the ends of its name."""
    if not ends:
        return known.withColumn("cell", F.lit(0).cast("long"))
    splits = _splits(ends)
    names = [(n, f"__v{k}", f"__c{k}") for k, n in enumerate(ends)]
    parted = known.withColumns({v: F.when(F.col("name") == n, F.col("v")) for n, v, _ in names})
    placed = Bucketizer(splitsArray=splits, inputCols=[v for _, v, _ in names], outputCols=[c for *_, c in names], handleInvalid="keep").transform(parted)
    return placed.select("name", "unit", "v", F.coalesce(*[F.when(F.col("name") == n, F.col(c)) for n, _, c in names]).cast("long").alias("cell"))


def _search(cells, q: float, distances: bool):
    """The cells that may hold the quantile, and which of their values in order it is."""

    columns = ["name", "unit", "m", "first", "second", "share", "cell"]

    def search(own: pd.DataFrame) -> pd.DataFrame:
        names, cell, count, middle = (own[c].to_numpy() for c in ("name", "cell", "own", "m"))
        unit, found = own["unit"].iloc[0], []
        for name in sorted(set(names)):
            here = names == name
            found.append(one(name, unit, middle[here][0], cell[here & (count > 0)], count[here & (count > 0)]))
        return pd.concat(found)

    def one(name: str, unit, m: float, cell: np.ndarray, count: np.ndarray) -> pd.DataFrame:
        number, n, lo, hi = cells.value[name]
        left = n.astype(np.int64)
        left[np.searchsorted(number, cell)] -= count
        total = int(left.sum())
        if not total or (distances and np.isnan(m)):
            return pd.DataFrame(columns=columns)
        nearest, farthest = (lo, hi) if not distances else (np.maximum(np.maximum(lo - m, m - hi), 0), np.maximum(np.abs(lo - m), np.abs(hi - m)))
        at = q * (total - 1)
        first, second = int(np.floor(at)) + 1, int(np.ceil(at)) + 1
        by = np.argsort(nearest, kind="stable")
        least = nearest[by][np.searchsorted(np.cumsum(left[by]), first)]
        by = np.argsort(farthest, kind="stable")
        most = farthest[by][np.searchsorted(np.cumsum(left[by]), second)]
        sure = int(left[farthest < least].sum())
        maybe = number[(farthest >= least) & (nearest <= most) & (left > 0)]
        return pd.DataFrame({"name": name, "unit": unit, "m": m, "first": first - sure, "second": second - sure, "share": at - np.floor(at), "cell": maybe})[columns]

    return search


def moments_without(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``name, unit, sd``: the population standard deviation of all values but the unit's own, by subtraction.

    ``rows`` and ``names`` as those of ``SortedCells``.
    """
    told = lambda v: (F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))
    if names is None:
        own = rows.where("v IS NOT NULL AND unit IS NOT NULL").groupBy("name", "unit").agg(*told("v"))
    else:
        each = F.array(*[F.struct(F.lit(c).alias("name"), *told(c)) for c in names])
        own = rows.where("unit IS NOT NULL").groupBy("unit").agg(each.alias("x")).select("unit", F.explode("x").alias("x")).select("x.name", "unit", "x.n", "x.mean", "x.m2").where("n > 0")
    pooled = own.groupBy("name").agg(F.sum("n").alias("a_n"), F.sum(F.col("n") * F.col("mean")).alias("a_sum"))
    mean = pooled.select("name", "a_n", (F.col("a_sum") / F.col("a_n")).alias("a_mean"))
    # A row for each name.
    spread = own.join(F.broadcast(mean), "name").groupBy("name", "a_n", "a_mean").agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("a_mean"), 2)).alias("a_m2"))
    each = own.join(F.broadcast(spread), "name")
    rest = F.col("a_n") - F.col("n")
    off = F.col("mean") - (F.col("a_n") * F.col("a_mean") - F.col("n") * F.col("mean")) / rest
    m2 = F.col("a_m2") - F.col("m2") - off * off * F.col("n") * rest / F.col("a_n")
    # What is next to nothing beside the whole is what subtraction leaves of nothing.
    return each.where(rest > 0).select("name", "unit", F.when(m2 > 1e-12 * F.col("a_m2"), F.sqrt(m2 / rest)).otherwise(0.0).alias("sd"))


def score_windows(pos: np.ndarray, fused: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """Median of the known values of the last ``width`` places, for the wanted rows: rows by columns."""
    take = wanted[:, None] - np.arange(width)[None, :]
    inside = (take >= 0) & (pos[np.maximum(take, 0)] > (pos[wanted] - width)[:, None])
    return _median(np.where(inside[:, :, None], fused[np.maximum(take, 0)], np.nan))


def _median(x: np.ndarray) -> np.ndarray:
    """Median along the second axis without what is not a number; such where nothing is left."""
    x = np.sort(x, axis=1)
    n = (~np.isnan(x)).sum(axis=1, keepdims=True)
    low, high = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, x.shape[1] - 1)
    out = (np.take_along_axis(x, low, 1) + np.take_along_axis(x, high, 1)) / 2
    return np.where(n > 0, out, np.nan)[:, 0]


def scores_by_fold(folds: list, scales: np.ndarray, columns: list[str], skip: int, n_ref: int, width: int, end_rows):
    """For each unit of rows of one group: its early scores and its median score at the end of life, under the scales of every fold.

    ``scales`` has a row for each fold. Folds are worked through in blocks, so that memory
    goes with the unit's rows alone.
    """
    names = np.empty(len(folds), dtype=object)
    names[:] = folds

    def of_unit(key: tuple, pos: np.ndarray, n: int, x: np.ndarray) -> Iterator[tuple]:
        known = (~np.isnan(x)).sum(axis=1, keepdims=True).astype(float)
        known[known == 0] = np.nan
        x = np.nan_to_num(x)
        early = np.flatnonzero((pos >= skip) & (pos < skip + n_ref))
        late = np.flatnonzero(pos >= n - end_rows(n))
        others = np.flatnonzero(names != key[0])
        step = max(1, (1 << 21) // (width * max(len(early), len(late), 1)))
        for k in range(0, len(others), step):
            some = others[k : k + step]
            fused = (x @ (1 / scales[some]).T) / known
            first = score_windows(pos, fused, early, width) if len(early) else np.empty((0, len(some)))
            last = _median(score_windows(pos, fused, late, width)[None])[0]
            yield from zip(names[some], [None if np.isnan(v) else v for v in last], [c[~np.isnan(c)] for c in first.T], strict=True)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__u", "pos"])
        unit, pos, n, x = rows["__u"].factorize()[0], rows["pos"].to_numpy(), rows["n_unit"].to_numpy(), rows[columns].to_numpy(dtype=float)
        begins = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.zeros(0, int)
        found = [r for a, b in zip(begins, np.append(begins[1:], len(unit)), strict=True) for r in of_unit(key, pos[a:b], int(n[a]), x[a:b])]
        return pd.DataFrame(found, columns=["fold", "end", "early"])

    return run
