"""Sliding windows that count rows, and the features of each window.

A window covers a whole number of panes, the rows between two window edges. Rows are reduced
to pane moments once; windows then combine a few panes each. Samples are shuffled as partial
aggregates, never once for every window they lie in.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from .numbering import number_rows

STATS = ("mean", "abs_mean", "rms", "std", "var", "min", "max", "peak_to_peak", "crest_factor", "shape_factor", "impulse_factor", "clearance_factor", "kurtosis", "skewness")


def step_of(size: int, overlap: float) -> int:
    step = int(size * (1 - overlap))
    if step <= 0:
        raise ValueError(f"overlap {overlap} leaves no step between windows of {size}")
    return step


def windows_of(row: Column, size: int, step: int) -> Column:
    """Numbers of the windows that hold a row: window w covers rows w*step to w*step+size-1."""
    first = F.greatest(F.lit(0), F.floor((row - size) / step) + 1)
    return F.sequence(first.cast("long"), F.floor(row / step).cast("long"))


def explode_windows(df: DataFrame, keys: list[str], size: int, step: int, row: str = "row_index") -> DataFrame:
    """Each row once for every complete window of its keys that holds it, with column ``w``.

    For operators that need the samples of a window themselves; incomplete tails are dropped.
    """
    last = F.max(row).over(Window.partitionBy(*keys))
    return df.withColumn("last_row", last).withColumn("w", F.explode(windows_of(F.col(row), size, step))).where(F.col("w") * step + size - 1 <= F.col("last_row")).drop("last_row")


def _pane_stats(c: str) -> list[Column]:
    x = F.col(c)
    return [
        F.count(x).alias(f"{c}_n"), F.avg(x).alias(f"{c}_m"), F.var_pop(x).alias(f"{c}_v"), F.skewness(x).alias(f"{c}_s"), F.kurtosis(x).alias(f"{c}_k"),
        F.sum(F.abs(x)).alias(f"{c}_a"), F.sum(F.sqrt(F.abs(x))).alias(f"{c}_r"), F.min(x).alias(f"{c}_lo"), F.max(x).alias(f"{c}_hi"),
    ]


def _combined(c: str, panes: Column) -> dict[str, Column]:
    """Statistics of a window from the moments of its panes about their own means."""

    def total(f) -> Column:
        return F.aggregate(panes, F.lit(0.0), lambda acc, p: acc + F.coalesce(f(p), F.lit(0.0)))

    def centred(p: Column, k: int) -> Column:
        n, v = p[f"{c}_n"].cast("double"), p[f"{c}_v"]
        return {2: n * v, 3: n * F.coalesce(p[f"{c}_s"], F.lit(0.0)) * F.pow(v, 1.5), 4: n * (F.coalesce(p[f"{c}_k"], F.lit(-3.0)) + 3) * v * v}[k]

    n = total(lambda p: p[f"{c}_n"].cast("double"))
    mean = safe_divide(total(lambda p: p[f"{c}_n"] * p[f"{c}_m"]), n)
    d = F.col("__mean")
    var = safe_divide(total(lambda p: centred(p, 2) + p[f"{c}_n"] * F.pow(p[f"{c}_m"] - d, 2)), n)
    m3 = safe_divide(total(lambda p: centred(p, 3) + 3 * (p[f"{c}_m"] - d) * centred(p, 2) + p[f"{c}_n"] * F.pow(p[f"{c}_m"] - d, 3)), n)
    m4 = safe_divide(total(lambda p: centred(p, 4) + 4 * (p[f"{c}_m"] - d) * centred(p, 3) + 6 * F.pow(p[f"{c}_m"] - d, 2) * centred(p, 2) + p[f"{c}_n"] * F.pow(p[f"{c}_m"] - d, 4)), n)
    return {
        "n": n, "mean": mean, "var": var, "m3": m3, "m4": m4,
        "abs_mean": safe_divide(total(lambda p: p[f"{c}_a"]), n), "root_mean": safe_divide(total(lambda p: p[f"{c}_r"]), n),
        "min": F.array_min(F.transform(panes, lambda p: p[f"{c}_lo"])), "max": F.array_max(F.transform(panes, lambda p: p[f"{c}_hi"])),
    }


def window_stats(df: DataFrame, keys: list[str], values: list[str], size: int, overlap: float = 0.5, row: str = "row_index") -> DataFrame:
    """``keys, w, row_start, row_end, n_samples`` and the 14 statistics of each value column.

    Windows of ``size`` rows that start every ``size * (1 - overlap)``; never across keys; an
    incomplete tail gives none. Null samples count as rows but not in statistics; a window
    without values has null statistics, one with equal values no kurtosis or skewness.
    """
    step = step_of(size, overlap)
    pane = gcd(size, step)
    panes = df.groupBy(*keys, F.floor(F.col(row) / pane).cast("long").alias("pane")).agg(F.count(F.lit(1)).alias("rows"), *[s for c in values for s in _pane_stats(c)])
    frame = Window.partitionBy(*keys).orderBy("pane").rangeBetween(0, size // pane - 1)
    moments = F.struct(*[f"{c}_{k}" for c in values for k in ("n", "m", "v", "s", "k", "a", "r", "lo", "hi")])
    out = (
        panes.withColumn("n_samples", F.sum("rows").over(frame))
        .withColumn("panes", F.collect_list(moments).over(frame))
        .where((F.col("n_samples") == size) & (F.pmod(F.col("pane"), F.lit(step // pane)) == 0))
        .withColumn("w", (F.col("pane") * pane / step).cast("long"))
        .select(*keys, "w", (F.col("w") * step).alias("row_start"), (F.col("w") * step + size - 1).alias("row_end"), "n_samples", "panes")
    )
    for c in values:
        stats = _combined(c, F.col("panes"))
        out = out.withColumn("__mean", stats["mean"]).withColumns({f"__{k}": v for k, v in stats.items()})
        out = out.withColumns(derived_stats(c, {k: F.col(f"__{k}") for k in stats})).drop(*[f"__{k}" for k in stats])
    return out.drop("panes")


def derived_stats(c: str, s: dict[str, Column]) -> dict[str, Column]:
    """The 14 statistics from moments."""
    std = F.sqrt(s["var"])
    rms = F.sqrt(s["var"] + s["mean"] * s["mean"])
    peak = F.greatest(F.abs(s["min"]), F.abs(s["max"]))
    spread = s["var"] > 1e-24
    values = {
        "mean": s["mean"], "abs_mean": s["abs_mean"], "rms": rms, "std": std, "var": s["var"], "min": s["min"], "max": s["max"], "peak_to_peak": s["max"] - s["min"],
        "crest_factor": safe_divide(peak, rms), "shape_factor": safe_divide(rms, s["abs_mean"]), "impulse_factor": safe_divide(peak, s["abs_mean"]),
        "clearance_factor": safe_divide(peak, F.pow(s["root_mean"], 2)),
        "kurtosis": F.when(spread, s["m4"] / F.when(spread, F.pow(s["var"], 2)) - 3), "skewness": F.when(spread, s["m3"] / F.when(spread, F.pow(s["var"], 1.5))),
    }
    return {f"{c}_{k}": values[k] for k in STATS}


def group_stats(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The same statistics for whole groups (one acquisition file, one unit)."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for c in values:
        x = F.col(c)
        aggs += [
            F.avg(x).alias(f"__{c}_mean"), F.var_pop(x).alias(f"__{c}_var"), F.skewness(x).alias(f"__{c}_g1"), F.kurtosis(x).alias(f"__{c}_g2"),
            F.avg(F.abs(x)).alias(f"__{c}_abs_mean"), F.avg(F.sqrt(F.abs(x))).alias(f"__{c}_root_mean"), F.min(x).alias(f"__{c}_min"), F.max(x).alias(f"__{c}_max"),
        ]
    out = df.groupBy(*keys).agg(*aggs)
    for c in values:
        s = {k: F.col(f"__{c}_{k}") for k in ("mean", "var", "abs_mean", "root_mean", "min", "max")}
        s |= {"m3": F.col(f"__{c}_g1") * F.pow(s["var"], 1.5), "m4": (F.col(f"__{c}_g2") + 3) * F.pow(s["var"], 2)}
        out = out.withColumns(derived_stats(c, s))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def temperature_stats(df: DataFrame, keys: list[str], values: dict[str, Column], index: str) -> DataFrame:
    """``<name>_mean, _min, _max, _std, _slope`` for each named value, and ``temp_available``.

    The slope is per sample, against the original places; fewer than two values give none.
    Availability looks at the first name.
    """
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for name, v in values.items():
        at = F.col(index).cast("double")
        aggs += [F.avg(v).alias(f"{name}_mean"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), F.stddev_pop(v).alias(f"{name}_std"), F.regr_slope(v, at).alias(f"{name}_slope")]
    aggs.append(F.bool_or(next(iter(values.values())).isNotNull()).alias("temp_available"))
    return df.groupBy(*keys).agg(*aggs)


def _windows_of_panes(panes: DataFrame, keys: list[str], size: int, step: int, columns: list[str]) -> DataFrame:
    """``keys, w`` and each pane column gathered into an array, for every complete window.

    ``panes`` has ``keys, pane, rows`` and the columns, a row for each pane.
    """
    pane = gcd(size, step)
    frame = Window.partitionBy(*keys).orderBy("pane").rangeBetween(0, size // pane - 1)
    whole = panes.withColumn("__rows", F.sum("rows").over(frame)).withColumns({f"__{c}": F.collect_list(c).over(frame) for c in columns})
    complete = whole.where((F.col("__rows") == size) & (F.pmod(F.col("pane"), F.lit(step // pane)) == 0))
    return complete.select(*keys, F.floor(F.col("pane") * pane / step).cast("long").alias("w"), *[F.col(f"__{c}").alias(c) for c in columns])


def _by_pane(df: DataFrame, keys: list[str], size: int, step: int, row: str):
    return df.groupBy(*keys, F.floor(F.col(row) / gcd(size, step)).cast("long").alias("pane"))


def window_arrays(df: DataFrame, keys: list[str], values: list[str], size: int, overlap: float = 0.5, row: str = "row_index") -> DataFrame:
    """``keys, w`` and the samples of each value column, an array in row order, for every complete window.

    Samples are gathered by pane, so each is shuffled once however far windows overlap. A null
    sample stays in its place as NaN.
    """
    step = step_of(size, overlap)
    sample = F.struct(F.col(row).alias("i"), *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in values])
    panes = _by_pane(df, keys, size, step, row).agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_list(sample)).alias("__s"))
    panes = panes.select(*keys, "pane", "rows", *[F.col(f"__s.{v}").alias(v) for v in values])
    return _windows_of_panes(panes, keys, size, step, values).withColumns({v: F.flatten(v) for v in values})


def _pane_trend(v: Column, at: Column) -> Column:
    return F.struct(
        F.regr_count(v, at).alias("n"), F.regr_avgx(v, at).alias("x"), F.regr_avgy(v, at).alias("y"), F.regr_sxx(v, at).alias("xx"), F.regr_sxy(v, at).alias("xy"), F.regr_syy(v, at).alias("yy"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )


def _joined_trend(name: str, panes: Column) -> dict[str, Column]:
    """Statistics of a window from its panes: sums about the panes' means, moved to the window's."""

    def total(f) -> Column:
        return F.aggregate(panes, F.lit(0.0), lambda acc, p: acc + F.coalesce(f(p).cast("double"), F.lit(0.0)))

    n = total(lambda p: p["n"])
    x, y = safe_divide(total(lambda p: p["n"] * p["x"]), n), safe_divide(total(lambda p: p["n"] * p["y"]), n)
    xx = total(lambda p: p["xx"] + p["n"] * (p["x"] - F.col("__x")) * (p["x"] - F.col("__x")))
    xy = total(lambda p: p["xy"] + p["n"] * (p["x"] - F.col("__x")) * (p["y"] - F.col("__y")))
    yy = total(lambda p: p["yy"] + p["n"] * (p["y"] - F.col("__y")) * (p["y"] - F.col("__y")))
    ends = (F.array_min(F.transform(panes, lambda p: p["lo"])), F.array_max(F.transform(panes, lambda p: p["hi"])))
    return {"n": n, "x": x, "y": y, "xx": xx, "xy": xy, "yy": yy, "lo": ends[0], "hi": ends[1]}


def windowed_temperatures(df: DataFrame, keys: list[str], values: dict[str, Column], size: int, overlap: float = 0.5, row: str = "row_index") -> DataFrame:
    """``temperature_stats`` of every complete window, from mergeable sums of its panes."""
    step, at = step_of(size, overlap), F.col(row).cast("double")
    named = {f"__t{k}": v for k, v in enumerate(values.values())}
    panes = _by_pane(df, keys, size, step, row).agg(F.count(F.lit(1)).alias("rows"), *[_pane_trend(v, at).alias(c) for c, v in named.items()])
    out = _windows_of_panes(panes, keys, size, step, list(named)).withColumn("n_samples", F.lit(size).cast("long"))
    for k, (c, name) in enumerate(zip(named, values, strict=True)):
        told = _joined_trend(name, F.col(c))
        for part in (("n", "x", "y", "lo", "hi"), ("xx", "xy", "yy")):
            out = out.withColumns({f"__{p}": told[p] for p in part})
        out = out.withColumns({
            f"{name}_mean": F.col("__y"), f"{name}_min": F.col("__lo"), f"{name}_max": F.col("__hi"), f"{name}_std": F.sqrt(safe_divide(F.col("__yy"), F.col("__n"))),
            f"{name}_slope": F.when(F.col("__n") > 1, safe_divide(F.col("__xy"), F.col("__xx"))),
        } | ({"temp_available": F.col("__n") > 0} if k == 0 else {}))
        out = out.drop(c, *[f"__{p}" for p in told])
    return out


def run_windows(windows: DataFrame, run: str, file_order: str, file_start: str, sample_rate: float, file_seconds: float) -> DataFrame:
    """Window rows with ``sequence_index, event_timestamp, rul_seconds`` of their run.

    A run ends ``file_seconds`` after its last file starts; the sequence counts windows of a
    run in file order, then window order, from 0.
    """
    start = F.col(file_start).cast("double") + F.col("row_start") / sample_rate
    ends = windows.groupBy(F.col(run).alias("__run")).agg(F.max(F.col(file_start).cast("double")).alias("__end"))
    placed = number_rows(windows, [run], [file_order], ["w"], "sequence_index").withColumn("sequence_index", F.col("sequence_index").cast("int"))
    timed = placed.withColumn("event_seconds", start).join(ends, F.col(run).eqNullSafe(F.col("__run")))
    return timed.withColumn("rul_seconds", F.col("__end") + file_seconds - F.col("event_seconds")).drop("__run", "__end")
