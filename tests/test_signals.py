from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import asof, spectral, windowing


def _one(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "u int, i long, x double")
    return windowing.group_stats(df, ["u"], ["x"]).first()


def test_hand_computed_statistics(spark):
    r = _one(spark, [1.0, -1.0, 2.0, -2.0])
    assert (r["x_mean"], r["x_abs_mean"], r["x_min"], r["x_max"], r["x_peak_to_peak"], r["x_var"]) == (0, 1.5, -2, 2, 4, 2.5)
    assert r["x_rms"] == pytest.approx(math.sqrt(2.5))


def test_constant_and_zero_signals(spark):
    r = _one(spark, [5.0] * 10)
    assert r["x_std"] == 0 and r["x_kurtosis"] is None and r["x_skewness"] is None
    assert all(r[f"x_{k}"] == pytest.approx(1) for k in ("crest_factor", "shape_factor", "impulse_factor", "clearance_factor"))
    z = _one(spark, [0.0] * 10)
    assert z["x_mean"] == 0 and all(z[f"x_{k}"] is None for k in ("crest_factor", "shape_factor", "impulse_factor", "clearance_factor", "kurtosis"))


def test_missing_samples(spark):
    assert all(_one(spark, [None] * 3)[f"x_{k}"] is None for k in windowing.STATS)
    assert _one(spark, [1.0, None, 3.0])["x_mean"] == 2


def test_nine_windows_and_pane_equals_explode(spark):
    rng = np.random.default_rng(0)
    data = [(1, i, float(v) if i % 50 else None) for i, v in enumerate(rng.normal(3, 2, 5000))]
    df = spark.createDataFrame(data, "u int, row_index long, x double")
    panes = windowing.window_stats(df, ["u"], ["x"], 1000).orderBy("w").collect()
    assert [(r["row_start"], r["row_end"]) for r in panes] == [(500 * w, 500 * w + 999) for w in range(9)]
    whole = windowing.group_stats(windowing.explode_windows(df, ["u"], 1000, 500), ["u", "w"], ["x"]).orderBy("w").collect()
    for a, b in zip(panes, whole, strict=True):
        assert all(a[f"x_{k}"] == pytest.approx(b[f"x_{k}"], rel=1e-9) for k in windowing.STATS)


def test_uneven_overlap(spark):
    df = spark.range(100).select(F.lit(1).alias("u"), F.col("id").alias("row_index"), F.col("id").cast("double").alias("x"))
    rows = windowing.window_stats(df, ["u"], ["x"], 30, 1 / 3).orderBy("w").collect()
    assert [r["x_min"] for r in rows] == [0, 20, 40, 60] and rows[-1]["x_max"] == 89
    with pytest.raises(ValueError):
        windowing.step_of(10, 1.0)


def test_sine_and_short_signals(spark):
    t = np.arange(2560) / 25600
    df = spark.createDataFrame([(1, (3 * np.sin(2 * np.pi * 500 * t)).tolist()), (2, [1.0]), (3, None), (4, (np.sin(2 * np.pi * 500 * t) + 0.5 * np.sin(2 * np.pi * 3000 * t)).tolist())], "k int, s array<double>")
    got = {r["k"]: r for r in spectral.spectral_features(df, ["k"], "s", 25600.0).collect()}
    assert got[1]["dominant_frequency_hz"] == pytest.approx(500, abs=10)
    assert got[2]["spectral_entropy"] is None and got[3]["total_spectral_energy"] is None
    assert sum(got[4][f"band_energy_frac_{b}"] for b in ("low", "mid", "high")) == pytest.approx(1)


def test_temperature_slope_keeps_gaps(spark):
    df = spark.createDataFrame([(k, i, v) for k, vs in ((1, [40.0, 42.0, 44.0, 46.0]), (2, [40.0, None, 44.0, 46.0]), (3, [None, 1.0])) for i, v in enumerate(vs)], "k int, i int, t double")
    got = {r["k"]: r for r in windowing.temperature_stats(df, ["k"], {"t": F.col("t")}, "i").collect()}
    assert got[1]["t_mean"] == 43 and got[1]["t_slope"] == pytest.approx(2) and got[2]["t_slope"] == pytest.approx(2)
    assert got[3]["t_slope"] is None and got[3]["temp_available"]


def test_nearest_join_against_brute_force(spark):
    rng = np.random.default_rng(1)
    left = [(i, int(rng.integers(0, 5)), float(rng.integers(0, 200))) for i in range(150)] + [(998, 1, None), (999, None, 5.0)]
    right = [(i, int(rng.integers(0, 4)), float(rng.integers(0, 200))) for i in range(60)]
    out = asof.nearest_within(spark.createDataFrame(left, "id int, u int, t double"), spark.createDataFrame(right, "idx int, u int, t double"), "u", "t", "t", "idx", 6.0).collect()
    for r in out:
        near = sorted((abs(t - r["t"]), i) for i, u, t in right if u == r["u"]) if r["t"] is not None and r["u"] is not None else []
        want = near[0] if near and near[0][0] <= 6 else None
        assert (r["nearest_index"], r["gap"]) == ((want[1], want[0]) if want else (None, None))
    assert len(out) == len(left)


def test_tolerance_is_inclusive_and_ties_take_lowest(spark):
    left = spark.createDataFrame([(1, 1, 100.0)], "id int, u int, t double")
    right = spark.createDataFrame([(7, 1, 190.0), (5, 1, 10.0)], "idx int, u int, t double")
    assert asof.nearest_within(left, right, "u", "t", "t", "idx", 90.0).first()["nearest_index"] == 5
    assert asof.nearest_within(left, right, "u", "t", "t", "idx", 89.9).first()["nearest_index"] is None


def _nearest(left, right, tolerance):
    out = {}
    for i, u, t in left:
        found = [(abs(t - rt), idx) for idx, ru, rt in right if ru == u and rt is not None] if t is not None and u is not None else []
        best = min(found, default=None)
        out[i] = best if best is not None and best[0] <= tolerance else None
    return out


@pytest.mark.parametrize(("tolerance", "bucket"), [(6.0, None), (6.0, 1.5), (0.0, 2.0), (1e9, 10.0), (float("inf"), 3.0)])
def test_nearest_over_bucket_borders_equals_brute_force(spark, tolerance, bucket):
    rng = random.Random(int(min(tolerance, 99)))
    # Gaps of many empty buckets, ties in time and index, nulls on both sides.
    when = lambda: None if rng.random() < 0.05 else float(rng.choice([0, 1000, -500]) + rng.randint(0, 60))
    left = [(i, rng.choice([1, 2, 3, None]), when()) for i in range(300)]
    right = [(i // 2, rng.choice([1, 2, None]), when()) for i in range(80)]
    out = asof.nearest_within(spark.createDataFrame(left, "id int, u int, t double"), spark.createDataFrame(right, "idx int, u int, t double"), "u", "t", "t", "idx", tolerance, bucket)
    want = _nearest(left, [r for r in right if r[1] is not None], tolerance)
    got = {r["id"]: None if r["nearest_index"] is None else (r["gap"], r["nearest_index"]) for r in out.collect()}
    assert got == want


def test_nearest_in_one_long_unit_takes_seconds(spark):
    n = 1_000_000
    left = spark.range(n).selectExpr("id", "1 AS u", "CAST(id AS DOUBLE) AS t")
    right = spark.range(n).selectExpr("id AS idx", "1 AS u", "id + 0.25D AS t")
    began = time.time()
    out = asof.nearest_within(left, right, "u", "t", "t", "idx", 90.0)
    got = out.agg(F.count("nearest_index").alias("n"), F.sum(F.col("nearest_index") - F.col("id")).alias("off"), F.max("gap").alias("gap")).first()
    assert tuple(got) == (n, 0, 0.25)
    assert time.time() - began < 60


def test_windowed_temperatures_and_arrays_equal_exploded_windows(spark):
    rng = random.Random(3)
    rows = [(u, i, None if rng.random() < 0.2 or 40 <= i < 80 else 20 + i / 7 + rng.random(), float(i % 3)) for u in "ab" for i in range(230 if u == "a" else 15)]
    df = spark.createDataFrame(rows, "u string, row_index long, t double, s double").repartition(4)
    values = {"t": F.col("t"), "diff": F.col("t") - F.col("s")}
    for size, overlap in ((20, 0.5), (30, 0.7), (25, 0.0)):
        step = windowing.step_of(size, overlap)
        spread = windowing.explode_windows(df, ["u"], size, step)
        want = {(r["u"], r["w"]): r.asDict() for r in windowing.temperature_stats(spread, ["u", "w"], values, "row_index").collect()}
        got = {(r["u"], r["w"]): r.asDict() for r in windowing.windowed_temperatures(df, ["u"], values, size, overlap).collect()}
        assert got.keys() == want.keys() and len(got) > 5
        for key, row in got.items():
            assert row == {k: v if v is None or isinstance(v, (str, bool)) else pytest.approx(v, abs=1e-9) for k, v in want[key].items()}
        arrays = {(r["u"], r["w"]): r["t"] for r in windowing.window_arrays(df, ["u"], ["t", "s"], size, overlap).collect()}
        plain = {(u, i): t for u, i, t, _ in rows}
        for (u, w), xs in arrays.items():
            assert [None if math.isnan(x) else x for x in xs] == [plain[u, w * step + k] for k in range(size)]
        assert arrays.keys() == want.keys()
