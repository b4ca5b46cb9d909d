from __future__ import annotations

import random

from pulsegrid.llm import license_scan

SCHEMA = "doc_id long, text string"


def _found(spark, rows, model):
    return {r["id"]: [(n["paragraph"], n["family"]) for n in r["notices"]] for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA), model).collect()}


def test_small_tables_and_tables_of_notices_alone(spark, nothing):
    rows = [(1, "Released under the MIT License."), (2, "All rights reserved."), (3, "Licensed under the Apache License, Version 2.0."), (4, "nothing of the kind"), (5, None)]
    want = {1: [(1, "mit")], 2: [(1, "proprietary")], 3: [(1, "apache-2.0")], 4: [], 5: []}
    for seen in (rows, rows[:3], []):
        model = license_scan.train(spark.createDataFrame(seen, SCHEMA))
        assert _found(spark, rows, model) == want
    assert _found(spark, rows, license_scan.train(nothing)) == want


def test_notices_are_found_where_a_third_of_the_corpus_has_them(spark):
    r = random.Random(4)
    made = ["".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]

    def prose():
        return " ".join(r.choice(made) for _ in range(20)) + "."

    rows = [(i, f"{prose()}\n{prose()}\n" + (f"Copyright (c) {1990 + i % 30} by {r.choice(made)} {r.choice(made)}. All rights reserved.\n" if i % 3 == 0 else "") + prose()) for i in range(600)]
    model = license_scan.train(spark.createDataFrame(rows, SCHEMA))
    got = _found(spark, rows, model)
    assert sum(got[i] == [(3, "proprietary")] for i in range(0, 600, 3)) >= 0.98 * 200
    assert not any(got[i] for i in range(600) if i % 3)


def test_wrapped_and_edited_notices_are_named(spark, data):
    """Held-out edits: up to a tenth of the words dropped, doubled or followed by a foreign one, wrapped as in a comment."""
    r = random.Random(5)
    rows, want = [], {}
    for family, texts in sorted(license_scan.TEMPLATES.items()):
        for text in texts:
            for _ in range(6):
                words = text.split()
                for _ in range(r.randint(0, max(0, len(words) // 10))):
                    k = r.randrange(1, len(words))
                    words[k : k + 1] = r.choice([[], [words[k]] * 2, [words[k], "zorble"]])
                lines = []
                while words:
                    n = r.randint(6, 12)
                    lines.append(" ".join(words[:n]))
                    words = words[n:]
                rows.append((len(rows), "Some heading\n" + "\n # ".join(lines) + "\nThe end of it"))
                want[len(rows) - 1] = family
    model = license_scan.train(spark.read.parquet(data + "/documents.parquet"))
    got = _found(spark, rows, model)
    named = [want[i] for i in want if {f for _, f in got[i]} == {want[i]}]
    assert len(named) >= 0.9 * len(want), sorted((want[i], got[i], rows[i][1]) for i in want if {f for _, f in got[i]} != {want[i]})[:8]
    plain = [(i, t) for i, t in enumerate(license_scan.PLAIN)] + [(100 + i, f"the {w} was there and the {v} too") for i, (w, v) in enumerate(zip(model.anchors, model.anchors[7:]))]
    assert sum(bool(x) for x in _found(spark, plain, model).values()) <= 0.02 * len(plain)
