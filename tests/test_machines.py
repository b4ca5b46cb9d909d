from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pulsegrid.functions import scalar
from pulsegrid.operators import forest, guards, health, rul, stages

U, SEQ = health.U, health.SEQ


def _runs(n_units=3, n=120, role="learning", seed=0, offset=0.0, pieces=None):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(n_units):
        for i in range(n if pieces is None else pieces):
            ramp = max(0.0, (i / (n - 1) - 0.6) / 0.4)
            rows.append((f"m{u}", role, i, 10.0 * (n - 1 - i), *[float(offset * u + 1 + 5 * ramp + 0.05 * rng.normal()) for _ in health.REFERENCE]))
    return rows


def _df(spark, rows):
    schema = f"{U} string, role string, {SEQ} long, rul_seconds double, " + ", ".join(f"{f} double" for f in health.REFERENCE)
    return spark.createDataFrame(rows, schema).withColumn("event_timestamp", F.timestamp_seconds(F.lit(0) + 10 * F.col(SEQ)))


def _hi(df):
    return {(r[U], r[SEQ]): r["hi"] for r in df.collect()}


def test_reference_never_pins_and_falls(spark):
    df = _df(spark, _runs())
    params = health.fit_reference(df)
    hi = health.apply_reference(df, params)
    d = health.diagnostics(hi).collect()
    assert all(r["pct_at_one"] == 0 and r["hi_min"] > 0 and r["hi_max"] < 1 and r["spearman"] < -0.3 for r in d)


def test_reference_is_causal_and_ignores_offsets_and_order(spark):
    df = _df(spark, _runs())
    params = health.fit_reference(df)
    whole = _hi(health.apply_reference(df, params))
    part = _hi(health.apply_reference(df.where(F.col(SEQ) < 90), params))
    assert all(whole[k] == pytest.approx(v) for k, v in part.items())
    shuffled = _hi(health.apply_reference(df.orderBy(F.rand(3)), params))
    assert all(whole[k] == pytest.approx(v) for k, v in shuffled.items())


def test_foreign_roles_and_flat_runs_are_refused(spark):
    with pytest.raises(guards.LeakageError):
        health.fit_reference(_df(spark, _runs(role="test_censored")))
    flat = [(u, r, i, x, *[1.0] * 8) for u, r, i, x, *_ in _runs()]
    with pytest.raises(guards.RefusedFit):
        health.fit_reference(_df(spark, flat))


def test_debounce_equals_state_machine(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for u in range(40):
        raw = [[None, "A", "A", "B", "C"][j] for j in rng.integers(0, 5, 60)] if u else [None] * 60
        current, candidate, run = stages.UNKNOWN, None, 0
        for i, s in enumerate(raw):
            if s and current == stages.UNKNOWN:
                current = s
            elif s and s != current:
                run, candidate = (run + 1 if s == candidate else 1), s
                if run >= 3:
                    current, candidate, run = s, None, 0
            elif s:
                candidate, run = None, 0
            rows.append((f"u{u}", i, s))
            want[f"u{u}", i] = current
    got = stages.debounce(spark.createDataFrame(rows, f"{U} string, {SEQ} long, raw string"), "raw", 3).collect()
    assert {(r[U], r[SEQ]): r["stage"] for r in got} == want


def test_naive_life_clips_and_uses_known_start(spark):
    df = _df(spark, _runs(n_units=2, n=40))
    params = rul.fit_naive(df)
    assert params.first()["mean_life"] == 390
    starts = rul.unit_lives(df).select(U, "start")
    late = df.where(F.col(SEQ) >= 30)
    known = {r[SEQ]: r["predicted"] for r in rul.predict_naive(late, params, starts).where(f"{U} = 'm0'").collect()}
    assert known[30] == 90 and known[39] == 0
    own = {r[SEQ]: r["predicted"] for r in rul.predict_naive(late, params, starts.limit(0)).where(f"{U} = 'm0'").collect()}
    assert own[30] == 390


def test_score_points(spark):
    got = [r["s"] for r in spark.createDataFrame([(-10.0,), (0.0,), (20.0,)], "e double").select(scalar.phm_score(F.col("e")).alias("s")).collect()]
    assert got == pytest.approx([0.25, 1.0, 0.5])


def test_hidden_set_uses_last_row_of_whole_prefix(spark):
    learning = _df(spark, _runs(n_units=2, n=40))
    censored = _df(spark, [(f"Bearing1_{i}", "test_censored", *r[2:]) for i in (3, 4) for r in _runs(n_units=1, n=40, pieces=30)]).withColumn("rul_seconds", F.lit(None).cast("double"))
    truth = spark.createDataFrame([("Bearing1_3", 100.0), ("Bearing9_9", 5.0)], "label string, actual double")
    params, starts = rul.fit_naive(learning), rul.unit_lives(learning).select(U, "start")
    got = rul.score_hidden_set(censored, truth, {"naive": lambda d: rul.predict_naive(d, params, starts)}).collect()
    assert len(got) == 1 and got[0]["predicted"] == 100 and got[0]["n_censored"] == 30 and got[0]["condition_id"] == 1
    with pytest.raises(guards.LeakageError):
        rul.score_hidden_set(learning, truth, {})


def test_walk_forward_edges(spark):
    df = _df(spark, _runs(n_units=1, n=43, role="college_run"))
    counts = {(r["fold"], r["part"]): r["count"] for r in rul.walk_forward_folds(df).groupBy("fold", "part").count().collect()}
    assert counts == {(1, "train"): 10, (1, "test"): 11, (2, "train"): 21, (2, "test"): 11, (3, "train"): 32, (3, "test"): 11}


def test_forest_beats_naive_and_leaves_out_sparse_columns(spark):
    df = _df(spark, _runs(n_units=4, n=60)).withColumn("mostly_gone", F.when(F.col(SEQ) % 3 == 0, F.lit(1.0)))
    assert "mostly_gone" not in health.candidate_features(df, 0.2)
    train, test = df.where(f"{U} <> 'm3'"), df.where(f"{U} = 'm3'")
    forest = rul.predict_forest(test, rul.fit_forest(train, trees=10, depth=5)).withColumn("actual", F.col("rul_seconds"))
    assert rul.metrics(forest).first()["mae"] < 150


def test_truth_tables_must_agree(spark):
    a = spark.createDataFrame([("x", 10.0), ("y", 20.0)], "label string, rul_seconds double")
    b = spark.createDataFrame([("x", 10.0), ("y", 99.0)], "label string, rul_seconds double")
    assert rul.resolve_truth(a, a).count() == 2 and rul.resolve_truth(a, b, "y", 20.0).count() == 2
    with pytest.raises(ValueError):
        rul.resolve_truth(a, b)


def test_pca_indicator_falls_with_life(spark):
    df = _df(spark, _runs())
    hi = health.apply_pca(df, health.fit_pca(df, top_k=4))
    assert all(r["trend_corr"] < 0 for r in health.evaluate(hi).collect())


def test_pca_indicator_equals_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(3)
    rows = [(*r[:4], *[v + 0.4 * k * rng.normal() + (2.0 * k if k == 3 else 0) for k, v in enumerate(r[4:])]) for r in _runs(n=80)]
    df = _df(spark, rows)
    model = health.fit_pca(df, top_k=4)
    best = [r["feature"] for r in health.feature_scores(df, list(health.REFERENCE)).limit(4).collect()]
    assert model.features == best
    keys = [(r[0], r[2]) for r in rows]
    x = np.array([[r[4 + health.REFERENCE.index(f)] for f in best] for r in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    first = z @ np.linalg.svd(z - z.mean(axis=0), full_matrices=False)[2][0]
    life = np.array([k[1] for k in keys]) / 79
    first = -first if np.corrcoef(first, life)[0, 1] > 0 else first
    want = dict(zip(keys, (first - first.min()) / (first.max() - first.min()), strict=True))
    assert _hi(health.apply_pca(df, model)) == pytest.approx(want, abs=1e-6)
    # Another frame is held against the fitted ends.
    part = _hi(health.apply_pca(df.where(f"{SEQ} < 30"), model))
    assert part == pytest.approx({k: want[k] for k in part}, abs=1e-6)


def test_pca_fit_and_application_in_one_fill_gaps_once(spark, monkeypatch):
    rows = _runs(n=80)
    gappy = [(*r[:4], *[None if v is not None and f == health.REFERENCE[0] and k % 9 == 0 else v for f, v in zip(health.REFERENCE, r[4:], strict=True)]) for k, r in enumerate(rows)]
    df = _df(spark, gappy)
    want = _hi(health.apply_pca(df, health.fit_pca(df)))
    asked, whole = [], health.Imputer
    monkeypatch.setattr(health, "Imputer", lambda **k: asked.append(k["inputCols"]) or whole(**k))
    got = _hi(health.fit_apply_pca(df))
    assert got == pytest.approx(want, abs=1e-9) and len(got) == len(rows)
    assert asked == [[health.REFERENCE[0]]]
    asked.clear()
    assert len(_hi(health.fit_apply_pca(_df(spark, rows)))) == len(rows) and not asked


def _tree(lines):
    """A tree from its printed form: a leaf's value, or feature, threshold and both sides."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    assert lines.pop(0).strip().startswith("Else")
    return int(feature), float(threshold), low, _tree(lines)


def _walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _by_hand(model, rows):
    """Predictions by unit and sequence from the printed trees and the saved fills."""
    cols = model.stages[0].getInputCols()
    fills = model.stages[0].surrogateDF.first()
    trees = [_tree(t.toDebugString.splitlines()[1:]) for t in model.stages[-1].trees]
    out = {}
    for r in rows:
        x = [fills[c] if r[c] is None else r[c] for c in cols]
        out[r[U], r[SEQ]] = np.mean([_walk(t, x) for t in trees])
    return out


def test_held_out_tree_predictions_walked_by_hand(spark):
    df = _df(spark, [(*r[:5], None if r[2] % 11 == 0 else r[5], *r[6:]) for r in _runs(n=60, offset=0.1)])
    size = {"trees": 5, "depth": 4}
    got = {(r["split"], r[SEQ]): (r["predicted"], r["actual"]) for r in rul.lobo_trees(df, **size).collect()}
    rows = df.collect()
    for unit in ("m0", "m1", "m2"):
        model = rul.fit_forest(df.where(F.col(U) != unit), **size)
        hand = _by_hand(model, [r for r in rows if r[U] == unit])
        assert {(unit, r[SEQ]): got[unit, r[SEQ]] for r in rows if r[U] == unit} == {k: (pytest.approx(v), 10.0 * (59 - k[1])) for k, v in hand.items()}
    metrics = {r["split"]: r for r in rul.metrics(rul.lobo_trees(df, **size), "model", "split").collect()}
    for unit, told in metrics.items():
        e = np.array([p - a for (u, _), (p, a) in got.items() if u == unit])
        assert (told["mae"], told["rmse"], told["mean_signed_error"], told["n_over"]) == pytest.approx((np.abs(e).mean(), np.sqrt((e * e).mean()), e.mean(), (e > 0).sum()))


def test_walk_forward_trees_see_only_what_came_before(spark):
    runs = _df(spark, _runs(n_units=1, n=80, role="college_run"))
    size = {"trees": 4, "depth": 3}
    got = {(r["split"], r[SEQ]): r["predicted"] for r in rul.walk_forward_trees(runs, **size).collect()}
    rows, want = runs.collect(), {}
    folds = rul.walk_forward_folds(runs, 4)
    for i in (1, 2, 3):
        # A forest's samples go with the rows' partitions, so it is refitted on the same ones.
        before = folds.where(f"fold = {i} AND part = 'train'").drop("fold", "part")
        assert before.agg(F.max(SEQ), F.count(F.lit(1))).first() == (20 * i - 1, 20 * i)
        model = rul.fit_forest(before, **size)
        hand = _by_hand(model, [r for r in rows if 20 * i <= r[SEQ] < 20 * i + 20])
        want |= {(f"fold {i}", k[1]): v for k, v in hand.items()}
    assert got == pytest.approx(want)


def test_large_fits_go_alone(spark, monkeypatch):
    rows = spark.range(60).selectExpr("'learning' AS role", f"concat('u', id % 6) AS {U}", f"CAST(row_number() OVER (PARTITION BY id % 6 ORDER BY id) AS INT) AS {SEQ}", "id % 3 AS g", "1.0D * id AS x", "1.0D * id AS rul_seconds")
    running, most = [], []

    def fit(train, **_):
        running.append(1)
        most.append(len(running))
        time.sleep(0.3)
        running.pop()

    monkeypatch.setattr(rul, "fit_forest", fit)
    monkeypatch.setattr(rul, "predict_forest", lambda test, _: test.withColumn("predicted", F.lit(0.0)))
    monkeypatch.setattr(rul, "SIDE_ROWS", 0, raising=False)
    assert rul.lobo_trees(rows, "g").count() == 60
    assert most == [1, 1, 1]


def test_large_fits_merge_rows_of_equal_bins_and_take_all_rows(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        a, b, c = int(rng.integers(0, 7)), float(rng.normal()), None if i % 13 == 5 else float(rng.integers(0, 3))
        rows.append((f"u{i % 5}", i // 5, "learning", float(a), b, c, 1.0, 100.0 * a + 40 * (b > 0.3) + 7 * (c or 1.0) + float(rng.normal())))
    df = spark.createDataFrame(rows, f"{U} string, {SEQ} int, role string, a double, b double, c double, same double, rul_seconds double")
    monkeypatch.setattr(rul, "MERGE_ROWS", 100)
    for sent in (12_000_000, 100):
        monkeypatch.setattr(rul, "SENT_ROWS", sent)
        model = rul.fit_forest(df, trees=6, depth=5)
        fills = model.stages[0].surrogateDF.first()
        x = [[fills[k] if v is None else v for k, v in zip("abc", r[3:6], strict=True)] + [r[6]] for r in rows]
        assert model.stages[0].getInputCols() == ["a", "b", "c", "same"] and len(model.stages[-1].trees) == 6
        shapes = set()
        for t in model.stages[-1].trees:
            tree = _tree(t.toDebugString.splitlines()[1:])
            shapes.add(t.toDebugString)
            reached = {}
            for values, r in zip(x, rows, strict=True):
                reached.setdefault(_walk(tree, values), []).append(r[-1])
            # Every row counts once: a leaf says the mean of all rows that reach it.
            assert {k: pytest.approx(np.mean(v)) for k, v in reached.items()} == {k: k for k in reached} and len(reached) > 8
            assert t.depth <= 5 and t._call_java("rootNode").impurityStats().count() == 3000
        assert len({s.split("\n", 1)[1] for s in shapes}) == 6
        told = {(r[U], r[SEQ]): r["predicted"] for r in rul.predict_forest(df, model).collect()}
        assert told == {k: pytest.approx(v) for k, v in _by_hand(model, [dict(zip((U, SEQ, "role", "a", "b", "c", "same"), r, strict=False)) for r in rows]).items()}
        assert np.mean([abs(told[r[0], r[1]] - r[-1]) for r in rows]) < 40
        assert sum(model.stages[-1].featureImportances) == pytest.approx(1) and model.stages[-1].featureImportances[3] == 0
        model.write().overwrite().save(str(tmp_path / "m"))
        again = rul.predict_forest(df, PipelineModel.load(str(tmp_path / "m")))
        assert {(r[U], r[SEQ]): r["predicted"] for r in again.collect()} == told


def test_a_grown_tree_takes_the_best_splits():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 4, (200, 2)).astype(np.uint8)
    n, mean = rng.integers(1, 5, 200), rng.normal(size=200)
    told = forest.grow(forest.Merged(bins, n, n * mean, n * mean * mean), 4, 2, 2, [1]).set_index("id")

    def error(at):
        return (n[at] * (mean[at] - np.average(mean[at], weights=n[at])) ** 2).sum() if at.any() else 0

    todo = [(0, np.ones(200, bool))]
    while todo:
        i, at = todo.pop()
        row = told.loc[i]
        assert (row["n"], row["total"]) == pytest.approx((n[at].sum(), (n * mean)[at].sum()))
        if row["feature"] >= 0:
            best = min(error(at & (bins[:, f] <= k)) + error(at & (bins[:, f] > k)) for f in range(2) for k in range(3))
            left = at & (bins[:, int(row["feature"])] <= row["bin"])
            assert error(left) + error(at & ~left) == pytest.approx(best)
            todo += [(row["left"], left), (row["right"], at & ~left)]
    assert len(told) == 7
