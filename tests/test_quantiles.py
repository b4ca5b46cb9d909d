from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.operators.quantiles import exact_medians


def test_medians_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [("big", float(x), float(i % 9)) for i, x in enumerate(rng.normal(size=40_001))]
    rows += [("even", float(x), 1.0) for x in (4, 1, 3, 2)] + [("one", 5.0, None), ("gaps", None, None), ("gaps", 2.0, None), ("gaps", 8.0, 3.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = {r["g"]: (r["x"], r["y"]) for r in exact_medians(df, "g", ["x", "y"]).collect()}
    for g in {r[0] for r in rows}:
        for k in (0, 1):
            known = [r[k + 1] for r in rows if r[0] == g and r[k + 1] is not None]
            assert got[g][k] == (pytest.approx(np.median(known)) if known else None)
    assert exact_medians(df.limit(0), "g", ["x"]).count() == 0
