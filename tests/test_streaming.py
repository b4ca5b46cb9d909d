from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import health, stages, windowing
from pulsegrid.streaming import operators as streaming

U, SEQ = health.U, health.SEQ


def _replay(spark, df, parts, folder, build, name):
    """The table as several files by ``batch``, read one file at a time to the end."""
    for k in range(parts):
        df.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder + "-state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).collect()


def _timed(df, order, rows, parts, swap, unit=U):
    """Adds times, a second a row, and batches where some rows come ``swap`` places late; a heartbeat ends the stream."""
    batch = F.least(F.lit(parts - 2), F.floor((F.col(order) + F.when(F.pmod(F.hash(order), F.lit(7)) == 0, swap).otherwise(0)) * (parts - 1) / rows))
    timed = df.withColumn("ts", F.timestamp_seconds(F.col(order) + 10**6)).withColumn("batch", batch)
    beat = df.limit(1).select(*[F.lit("~").alias(c) if c == unit else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    return timed.unionByName(beat.withColumn("ts", F.timestamp_seconds(F.lit(3 * 10**6))).withColumn("batch", F.lit(parts - 1)))


def test_sliding_windows_have_all_statistics_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(u, i, None if rng.random() < 0.05 else float(rng.normal(3)), float(i % 5)) for u in "ab" for i in range(300 if u == "a" else 40)]
    data += [("c", i, 2.0 if i >= 64 else None, 1.0) for i in range(128)]
    df = spark.createDataFrame(data, "u string, row_index long, x double, y double")
    timed = _timed(df, "row_index", 300, 5, 70, unit="u")
    got = _replay(spark, timed, 5, str(tmp_path / "w"), lambda s: streaming.sliding_windows(s, "u", "row_index", ["x", "y"], "ts", 64, late="200 seconds"), "r1")
    want = {(r["u"], r["w"]): r for r in windowing.window_stats(df, ["u"], ["x", "y"], 64).collect()}
    assert sorted((r["u"], r["w"]) for r in got) == sorted(want)
    for r in got:
        for name in (f"{c}_{s}" for c in "xy" for s in windowing.STATS):
            other = want[r["u"], r["w"]][name]
            assert r[name] == (other if other is None else pytest.approx(other, abs=1e-9)), name


def test_moments_merge_in_any_split():
    x = np.random.default_rng(1).normal(size=50)
    parts = [streaming.pane_moments(p) for p in np.split(x, [0, 3, 3, 17, 49])]
    whole = parts[0]
    for p in parts[1:]:
        whole = streaming.merge_moments(whole, p)
    assert whole == pytest.approx(streaming.pane_moments(x))


def test_event_time_features_drop_late_rows(spark, tmp_path):
    data = [(i, "a", 10 * i, float(i)) for i in range(30)] + [(30, "a", 0, 999.0)]
    df = spark.createDataFrame(data, "n long, u string, s long, x double").withColumn("ts", F.timestamp_seconds("s")).withColumn("batch", F.least(F.lit(2), F.floor(F.col("n") / 10)))
    got = _replay(spark, df, 3, str(tmp_path / "e"), lambda s: streaming.event_time_features(s, "u", "ts", ["x"], "60 seconds", "30 seconds", "20 seconds"), "r2")
    assert got and all(r["x_max"] < 999 for r in got)
    full = [r for r in got if r["window"]["start"].timestamp() >= 0 and r["n_samples"] == 6]
    assert full and all(r["x_mean"] == r["x_min"] + 2.5 for r in full)


def test_indicator_equals_batch_for_short_units_and_late_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    # One unit never completes a reference, one has fewer rows than are skipped.
    sizes = {"m": 150, "k": 45, "s": 7}
    rows = [(u, "learning", i, *[None if rng.random() < 0.03 else float(1 + 5 * max(0, (i - 90) / 60) + 0.05 * rng.normal() + i / 90) for _ in health.REFERENCE]) for u, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, f"{U} string, role string, {SEQ} long, " + ", ".join(f"{f} double" for f in health.REFERENCE))
    params = health.fit_reference(df, check=False)
    want = {(r[U], r[SEQ]): r["hi"] for r in health.apply_reference(df, params).collect()}
    timed = _timed(df, SEQ, 150, 6, 30)
    got = _replay(spark, timed, 6, str(tmp_path / "h"), lambda s: streaming.reference_indicator(s, params.first().asDict(), "ts", late="60 seconds"), "r3")
    assert len(got) == len(want) == sum(sizes.values())
    assert {(r[U], r[SEQ]): r["hi"] for r in got} == pytest.approx(want)


def test_debounce_equals_batch_for_late_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(u, i, [None, "HEALTHY", "HEALTHY", "CRITICAL"][j]) for u in "mn" for i, j in enumerate(rng.integers(0, 4, 200 if u == "m" else 9))]
    df = spark.createDataFrame(rows, f"{U} string, {SEQ} long, raw_stage string")
    want = {(r[U], r[SEQ]): r["stage"] for r in stages.debounce(df, "raw_stage", 2).collect()}
    got = _replay(spark, _timed(df, SEQ, 200, 5, 40), 5, str(tmp_path / "d"), lambda s: streaming.debounced_stages(s, "ts", k=2, late="80 seconds"), "r4")
    assert len(got) == len(want)
    assert {(r[U], r[SEQ]): r["stage"] for r in got} == want
