"""Quantiles without a unit, and leave-one-out fits, against plain versions over multiplied rows."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import tables
from pulsegrid.operators import health, ranks, stages

U, SEQ = health.U, health.SEQ
LONG = "name string, unit int, v double"


def _made(rng):
    rows = []
    for unit in range(12):
        # One unit holds half of all rows; values repeat.
        for _ in range(600 if unit == 3 else rng.randint(0, 90)):
            rows.append(("a", unit, None if rng.random() < 0.05 else rng.gauss(unit / 4, 1)))
            rows.append(("b", unit, float(rng.randint(0, 4))))
    return [*rows, ("a", None, 1e9), ("b", None, -1e9), ("c", 0, 5.0), ("c", 0, 6.0)]


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.83, 1.0])
def test_quantiles_without_each_unit(spark, monkeypatch, q):
    monkeypatch.setattr(ranks, "CELL_ROWS", 7)
    rows = _made(random.Random(2))
    units = spark.createDataFrame([(u,) for u in range(13)], "unit int")
    cells = ranks.SortedCells(spark.createDataFrame(rows, LONG).repartition(6))
    kept = {(n, u): np.array([v for m, w, v in rows if m == n and w is not None and w != u and v is not None]) for n in "abc" for u in range(13)}
    want = {k: np.quantile(x, q) for k, x in kept.items() if len(x)}
    found = cells.quantiles_without(units, q)
    assert {(r["name"], r["unit"]): r["value"] for r in found.collect()} == pytest.approx(want)
    middle = spark.createDataFrame([(*k, float(m)) for k, m in want.items()], "name string, unit int, m double")
    away = {(r["name"], r["unit"]): r["value"] for r in cells.quantiles_without(units, q, around=middle).collect()}
    assert away == pytest.approx({k: np.quantile(np.abs(kept[k] - m), q) for k, m in want.items()})


def test_deviations_without_each_unit(spark):
    rows = _made(random.Random(3))
    got = {(r["name"], r["unit"]): r["sd"] for r in ranks.moments_without(spark.createDataFrame(rows, LONG)).collect()}
    for (n, u), sd in got.items():
        x = [v for m, w, v in rows if m == n and w is not None and w != u and v is not None]
        assert sd == pytest.approx(np.std(x), abs=1e-9)
    assert ("c", 0) not in got and len(got) > 20


def test_running_sum_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randint(1, 5)) for i in range(3000)]
    out = ranks.running_sum(spark.createDataFrame(rows, "g int, k int, c int").repartition(5), ["g"], ["k"], "c", "s")
    want, total = {}, {}
    for g, k, c in rows:
        want[k] = total.get(g, 0)
        total[g] = total.get(g, 0) + c
    assert {r["k"]: r["s"] for r in out.collect()} == want


def _fleet(spark, units, rows, seed=1):
    rng = np.random.default_rng(seed)
    data = []
    for u in range(units):
        for i in range(rows + u % 7):
            life = i / rows
            data.append((f"m{u}", f"g{u % max(1, units // 2)}", "learning", i, *[None if rng.random() < 0.02 else float(1 + 3 * max(0, life - 0.6) ** 2 * (1 + u % 3) + 0.05 * rng.normal()) for _ in health.REFERENCE]))
    return spark.createDataFrame(data, f"{U} string, grp string, role string, {SEQ} long, " + ", ".join(f"{f} double" for f in health.REFERENCE))


def test_leave_one_out_fit_equals_refits(spark):
    df = _fleet(spark, 8, 75).union(_fleet(spark, 1, 6, 2).withColumn(U, F.lit("short")))
    params = health.fit_leave_one_out(df, "grp", check=False)
    got = {r["fold"]: r.asDict() for r in params.collect()}
    assert len(got) == 4
    for fold, row in got.items():
        want = health.fit_reference(df.where(F.col("grp") != fold), check=False).first().asDict()
        assert {k: v for k, v in row.items() if k != "fold"} == pytest.approx({k: v for k, v in want.items() if k != "fold"})
    hi = health.apply_reference(df, params, by="grp").drop("fold")
    limits = {r["fold"]: (r["hi_warn"], r["hi_critical"], r["n_units"]) for r in stages.fit_thresholds_without(hi, "grp", check=False).collect()}
    plain = {r["fold"]: (r["hi_warn"], r["hi_critical"], r["n_units"]) for r in stages.fit_thresholds(health.leave_one_out(hi, "grp"), by="fold", check=False).collect()}
    assert limits.keys() == plain.keys()
    assert all(limits[f] == pytest.approx(plain[f]) for f in plain)
    assert health.fit_leave_one_out(df.where("grp = 'g1'"), "grp", check=False).count() == 0


def test_hundreds_of_units(spark):
    cols = [F.when(F.rand(k) < 0.99, 1 + F.pow(F.col("i") / 12, 2) * F.rand(k + 50)).alias(f) for k, f in enumerate(health.REFERENCE)]
    df = spark.range(300 * 20).select((F.col("id") % 300).cast("string").alias(U), F.lit("learning").alias("role"), F.floor(F.col("id") / 300).alias("i")).select(U, "role", F.col("i").alias(SEQ), *cols)
    began = time.time()
    params = health.fit_leave_one_out(df, check=False)
    assert params.where("healthy < failure").count() == 300
    assert time.time() - began < 180


def _uneven(spark):
    """One long unit with a pinned value, ties, nulls, a null unit and short units."""
    r = random.Random(4)
    rows = [("a", k, None if r.random() < 0.1 else 1.0 if r.random() < 0.4 else round(r.random(), 2)) for k in range(900)]
    rows += [("b", 0, 0.5), ("b", 1, None), ("c", 7, None), (None, 1, 0.1), (None, 2, 0.4), (None, 2, 0.4)]
    return rows, spark.createDataFrame(rows, "u string, s long, v double").repartition(7)


def test_average_ranks_of_a_long_group(spark, monkeypatch):
    rows, df = _uneven(spark)
    frame = pd.DataFrame(rows, columns=["u", "s", "v"])
    want = Counter((a, b, c, d) for a, b, c, d in zip(*zip(*rows), frame.groupby("u", dropna=False)["v"].rank().astype(object).where(lambda x: x.notna(), None)))
    for frequent in (100_000, 50):
        monkeypatch.setattr(ranks, "FREQUENT", frequent)
        assert Counter(tuple(x) for x in ranks.average_ranks(df, ["u"], "v", "r").collect()) == want


def test_places_and_previous_of_a_long_group(spark):
    rows, df = _uneven(spark)
    for unit in ("a", "b", "c", None):
        mine = sorted((x for x in rows if x[0] == unit), key=lambda x: x[1])
        got = [x for x in ranks.places(df, ["u"], ["s"], "p").collect() if x["u"] == unit]
        assert sorted((x["s"], x["p"]) for x in got) == [(x[1], k) for k, x in enumerate(mine)]
        got = [x for x in ranks.previous(df, ["u"], ["s"], "v", "w").collect() if x["u"] == unit]
        assert [x["w"] for x in sorted(got, key=lambda x: (x["s"], x["w"] or 0))] == [None, *[x[2] for x in mine[:-1]]]


def test_quantiles_of_a_long_group(spark):
    rows, df = _uneven(spark)
    got = {x["u"]: (x["low"], x["mid"], x["top"]) for x in ranks.quantiles(df, ["u"], "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", "b", None}
    for unit, found in got.items():
        known = [x[2] for x in rows if x[0] == unit and x[2] is not None]
        assert found == pytest.approx(tuple(np.quantile(known, [0.05, 0.5, 1.0])), abs=1e-12)
    assert ranks.quantiles(df.where("1 = 0"), ["u"], "v", {"low": 0.05}).count() == 0


def test_a_long_unit_is_many_tasks(spark):
    df = spark.range(400_000).selectExpr("'x' AS bearing_run_id", "id AS sequence_index", "IF(id % 3 = 0, 1.0D, sin(id)) AS hi")
    spread = ranks.places(df, ["bearing_run_id"], ["sequence_index"], "p").groupBy(F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in spread) < 200_000
    assert health.evaluate(df).first()["n"] == 400_000


def test_short_units_go_by_windows_with_the_same_results(spark, monkeypatch):
    rows, df = _uneven(spark)
    df = df.toDF(U, SEQ, "hi").where(f"NOT ({U} <=> NULL)")
    plain = lambda d: {r[U]: pytest.approx(r.asDict(), nan_ok=True) for r in d.collect()}
    told = [lambda: health.diagnostics(df), lambda: health.evaluate(df), lambda: health.feature_scores(df, ["hi"]).withColumn(U, F.col("feature"))]
    written = sum(len(x) for x in tables._WRITTEN.values())
    short = [{r[U]: r.asDict() for r in f().collect()} for f in told]
    # Nothing is sorted and written.
    assert sum(len(x) for x in tables._WRITTEN.values()) == written
    monkeypatch.setattr(health, "short_groups", lambda *_: False)
    for f, got in zip(told, short, strict=True):
        assert got == plain(f())
    whole = df.withColumn("role", F.lit("learning"))
    want = Counter(health.healthy_mask(whole, 0.1).collect()), Counter(health.life_fraction(whole).select(U, SEQ, "life_by_value").collect())
    monkeypatch.undo()
    assert want == (Counter(health.healthy_mask(whole, 0.1).collect()), Counter(health.life_fraction(whole).select(U, SEQ, "life_by_value").collect()))


def test_no_task_holds_the_values_of_a_fold(spark):
    rows = [("all", f"u{u}", k, 100, float((u * 7 + k * k) % 31)) for u in range(6) for k in range(100)]
    found = health.anchors(spark.createDataFrame(rows, f"fold string, {U} string, pos int, n_unit int, score double"), "fold")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
    early = [r[4] for r in rows if 10 <= r[2] < 60]
    ends = [np.median([r[4] for r in rows if r[1] == f"u{u}" and r[2] >= 95]) for u in range(6)]
    assert found.first().asDict() == {"fold": "all", "healthy": np.median(early), "failure": np.median(ends)}


def test_cells_follow_odd_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CELL_ROWS", 1)
    rows = [("a", u, v) for u in range(4) for v in (-0.0, 0.0, float("inf"), float("-inf"), 2.0 * u)]
    cells = ranks.SortedCells(spark.createDataFrame(rows, LONG))
    got = cells.quantiles_without(spark.createDataFrame([(u,) for u in range(4)], "unit int"))
    assert {r["unit"]: r["value"] for r in got.collect()} == {u: float(np.median([v for _, w, v in rows if w != u])) for u in range(4)}


def test_columns_are_dealt_to_cells_as_rows_by_name(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CELL_ROWS", 7)
    rng = random.Random(9)
    odd = [None, float("nan"), 0.0, 2.5]
    rows = [(rng.choice([None, 1, 2, 3]), rng.gauss(0, 1), rng.choice(odd), None) for _ in range(400)]
    wide = spark.createDataFrame(rows, "unit int, a double, b double, c double")
    long = spark.createDataFrame([(n, r[0], v) for r in rows for n, v in zip("abc", r[1:], strict=True)], LONG)
    cell = lambda cells: Counter((r["name"], r["unit"], str(r["v"]), r["cell"]) for r in cells.rows.collect())
    assert cell(ranks.SortedCells(wide, ["a", "b", "c"])) == cell(ranks.SortedCells(long))
    told = lambda df: {(r["name"], r["unit"]): r["sd"] for r in df.collect()}
    assert told(ranks.moments_without(wide, ["a", "b", "c"])) == pytest.approx(told(ranks.moments_without(long)), nan_ok=True)


def test_held_out_indicator_is_stored_by_machine_in_bounded_buckets(spark, monkeypatch):
    """So windows over it need no shuffle, and what a task gets doesn't grow with the table."""
    monkeypatch.setattr(tables, "BUCKET_ROWS", 100)
    rng = random.Random(3)
    rows = [(f"m{u}", k, "learning", f"g{u % 3}", float(99 - k), *[rng.gauss(k / 30, 1) for _ in health.REFERENCE]) for u in range(24) for k in range(100)]
    df = spark.createDataFrame(rows, f"{U} string, {SEQ} int, role string, grp string, rul_seconds double, " + ", ".join(f"{f} double" for f in health.REFERENCE))
    hi = health.leave_one_out_reference(df, "grp", check=False, keep=(U, SEQ, "role", "grp", "rul_seconds"))
    by_unit = hi.withColumn("p", F.row_number().over(health.by_sequence()))
    plan = by_unit._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(hi.inputFiles()) > 8
    assert hi.count() == 2400 and health.evaluate(hi).count() == 24
