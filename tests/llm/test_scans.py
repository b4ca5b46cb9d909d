from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from test_text_ops import _pii_base, _secret_base

from pulsegrid.llm import pii, secret_scan, spans

SCHEMA = "doc_id long, text string"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(data + "/documents.parquet").select("doc_id", "text").collect()}


def _plant(texts, forms, r):
    """Each text with one of the forms put between two of its words: rows and where it lies."""
    rows, at = [], {}
    for i, text in sorted(texts.items()):
        form = forms(r)
        gaps = [m.end() for m in re.finditer("[a-z] ", text)]
        k = r.choice(gaps) if gaps else 0
        rows.append((i, f"{text[:k]}{form} {text[k:]}"))
        at[i] = (k, k + len(form))
    return rows, at


def _check_card(digits):
    return next(digits + d for d in "0123456789" if sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits + d))) % 10 == 0)


def _private(r):
    n = [r.randint(1, 254) for _ in range(4)]
    card = _check_card("4" + "".join(r.choice("0123456789") for _ in range(14)))
    number = f"{r.randint(200, 989)}", f"{r.randint(200, 999)}", f"{r.randint(0, 9999):04d}"
    return r.choice(
        [
            f"{r.choice(['kim', 'a.ray', 'zo_e'])}{r.choice([' [at] ', '[at]', ' (at) '])}{r.choice(['firm', 'lab3', 'my-shop'])}{r.choice([' [dot] ', '.', '[dot]'])}{r.choice(['com', 'net', 'fr'])}",
            "[.]".join(map(str, n)), f"2001:db8::{n[0]:x}:{n[1]:x}", ".".join(card[k : k + 4] for k in range(0, 16, 4)), f"({number[0]}) {number[1]}-{number[2]}", "-".join(number), ".".join(number), f"0044 {number[0]} {number[1]} {number[2]}",
        ]
    )


def _harmless(r):
    wrong = _check_card("4" + "".join(r.choice("0123456789") for _ in range(14)))
    wrong = wrong[:-1] + str((int(wrong[-1]) + r.randint(1, 9)) % 10)
    return r.choice([f"{r.randint(1980, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", f"order {r.randint(10**8, 10**9)}", ".".join(wrong[k : k + 4] for k in range(0, 16, 4)), wrong, f"{r.randint(1, 99)} (at) {r.randint(1, 9)}.{r.randint(10, 99)}", "aa:0b:cc:1d:ee:2f"])


def test_pii_finds_forms_outside_the_fixed_ones(spark, data):
    """Held-out texts and forms: precision and recall of the added spans."""
    r = random.Random(12)
    texts = _texts(spark, data)
    model = pii.train(spark.read.parquet(data + "/documents.parquet"))
    rows, at = _plant(texts, _private, r)
    before = {x["id"]: x["added"] for x in pii.scan(spark.createDataFrame(sorted(texts.items()), SCHEMA), model).collect()}
    got = {x["id"]: x["added"] for x in pii.scan(spark.createDataFrame(rows, SCHEMA), model).collect()}
    hits = sum(any(s["start"] <= at[i][0] + 1 and s["end"] >= at[i][1] - 1 for s in got[i]) for i in at)
    added = sum(len(x) for x in got.values())
    print("private: recall", hits / len(at), "precision", hits / added, "added to the texts as they are", sum(map(len, before.values())))
    assert hits >= 0.9 * len(at) and hits >= 0.9 * added
    rows, at = _plant(texts, _harmless, r)
    wrong = {x["id"]: x["added"] for x in pii.scan(spark.createDataFrame(rows, SCHEMA), model).collect()}
    false = sum(any(s["start"] < at[i][1] and at[i][0] < s["end"] for s in wrong[i]) for i in at)
    print("harmless: found", false / len(at))
    assert false <= 0.1 * len(at)


def test_pii_query_equals_brute_force(spark, data):
    texts, kinds = _texts(spark, data), list(pii.KINDS)
    found = {x["id"]: x["added"] for x in pii.scan(spark.createDataFrame(sorted(texts.items()), SCHEMA), pii.train(spark.read.parquet(data + "/documents.parquet"))).collect()}
    for x in pii.op4_pii(spark, data).collect():
        base = _pii_base(texts[x["doc_id"]])
        spans = sorted((a, kinds.index(k), b) for k in kinds for a, b in base[k])
        every = sorted([*spans, *((s["start"], s["rank"], s["end"]) for s in found[x["doc_id"]])])
        assert [x[f"n_{k}"] for k in kinds] == [len(base[k]) for k in kinds] and x["n_added"] == len(found[x["doc_id"]])
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert x["spans"] == ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in every)


def test_trees_as_an_expression_equal_the_fitted_ones(spark):
    sample = pii.labelled_candidates(pii.made_seeds(spark, 200)).withColumn("vector", array_to_vector("features")).cache()
    fitted = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(sample)
    both = fitted.transform(sample).select(vector_to_array("probability")[1].alias("p"), pii.boosted(fitted).probability(F.col("features")).alias("q")).collect()
    sample.unpersist()
    assert all(x["p"] == pytest.approx(x["q"], abs=1e-9) for x in both) and len({round(x["p"], 3) for x in both}) > 3


def _secret(r):
    n = r.randint(20, 40)
    return r.choice(["".join(r.choice(LETTERS) for _ in range(n)), "".join(r.choice(LETTERS + "+/") for _ in range(n)), "".join(r.choice(LETTERS[26:]) for _ in range(n)), "".join(r.choice(LETTERS[:26] + "0123456789") for _ in range(n))])


def _identifier(r):
    words = ["".join(r.choice(["con", "ter", "ing", "ment", "der", "re", "al", "is"]) for _ in range(r.randint(2, 3))) for _ in range(3)]
    return r.choice(["_".join(words), words[0] + words[1].title() + words[2].title(), "/".join(words), f"{words[0]}-{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"2024-11-{r.randint(1, 28):02d}T14-25-30Z-{words[0]}", "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12))])


def test_secrets_finds_random_strings_and_leaves_identifiers(spark, data):
    """Held-out texts and strings: precision and recall of the Markov spans."""
    r = random.Random(13)
    texts = _texts(spark, data)
    model = secret_scan.train(spark.read.parquet(data + "/documents.parquet"))
    rows, at = _plant(texts, _secret, r)
    got = {x["id"]: x["markov"] for x in secret_scan.scan(spark.createDataFrame(rows, SCHEMA), model).collect()}
    hits = sum(any((s["start"], s["end"]) == at[i] for s in got[i]) for i in at)
    print("secrets: recall", hits / len(at), "precision", hits / sum(map(len, got.values())))
    assert hits >= 0.95 * len(at) and hits >= 0.95 * sum(map(len, got.values()))
    rows, at = _plant(texts, _identifier, r)
    wrong = {x["id"]: x["markov"] for x in secret_scan.scan(spark.createDataFrame(rows, SCHEMA), model).collect()}
    print("identifiers: found", sum(map(bool, wrong.values())) / len(at))
    assert sum(map(bool, wrong.values())) <= 0.05 * len(at)
    known = ["2024-11-28T14-25-30Z-backup", "f81d4fae-7dec-11d0-a765-00a0c91e6bf6", "x" * 40, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    got = {x["id"]: len(x["markov"]) for x in secret_scan.scan(spark.createDataFrame(list(enumerate(known)), SCHEMA), model).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


def test_secret_query_equals_brute_force(spark, data):
    texts, kinds = _texts(spark, data), list(secret_scan.KINDS)
    model = secret_scan.train(spark.read.parquet(data + "/documents.parquet"))

    def mean(v):
        s = [secret_scan.ALPHABET.find(c) + 1 for c in v]
        return sum(model.ratios[a * secret_scan.STATES + b] for a, b in zip(s, s[1:])) / (len(v) - 1)

    candidate = re.compile(secret_scan.CANDIDATE)
    for x in secret_scan.op5_secret_scan(spark, data).collect():
        text = texts[x["doc_id"]]
        base = _secret_base(text)
        known = [p for k in kinds[:3] for p in base[k]]
        base["markov"] = [m.span() for m in candidate.finditer(text) if mean(m[0]) > model.limit and not any(a < m.end() and m.start() < b for a, b in known)]
        spans = sorted((a, kinds.index(k), b) for k in kinds for a, b in base[k])
        assert x["spans"] == ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans if k < 3).encode()).hexdigest()


def test_texts_with_very_many_matches_take_seconds(spark):
    """Numbers, assignments and addresses by the hundred thousand in one text, against a plain search."""
    began = time.time()
    numbers = ",".join(str(k) for k in range(100_000))
    df = spark.createDataFrame([(numbers,)], "t string")
    got = df.select(spans.matches(F.col("t"), "[0-9]+").alias("m")).select(F.size("m"), F.sha2(spans.joined(spans.named(F.col("m"), "n", 0)), 256)).first()
    want = ",".join(f"n:{m.start()}:{m.end()}" for m in re.finditer("[0-9]+", numbers))
    assert tuple(got) == (100_000, hashlib.sha256(want.encode()).hexdigest())
    few = spark.createDataFrame([("",), ("a1b22",), ("7" * 3 + "é" * 300 + "8",), (" ".join("9" * 257),), (" ".join("9" * 256),)], "t string")
    for r in few.select("t", spans.matches(F.col("t"), "[0-9]+", F.lit(True)).alias("m")).collect():
        assert [(s["start"], s["end"]) for s in r["m"]] == [m.span() for m in re.finditer("[0-9]+", r["t"])]
    assert time.time() - began < 60


def test_overlap_search_equals_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(200):
        at, base = 0, []
        for _ in range(rng.randint(0, 9)):
            at += rng.randint(0, 4)
            base.append((at, at + rng.randint(1, 5)))
            at = base[-1][1]
        a = rng.randint(0, 40)
        rows.append((base, (a, a + rng.randint(1, 6))))
    kind = "struct<start:int,end:int>"
    got = spark.createDataFrame(rows, f"base array<{kind}>, c {kind}").select("base", "c", spans.overlaps(F.col("c"), F.col("base")).alias("o")).collect()
    assert all(r["o"] == any(b["start"] < r["c"]["end"] and r["c"]["start"] < b["end"] for b in r["base"]) for r in got)
    assert len({r["o"] for r in got}) == 2


def test_many_secrets_in_one_text(spark):
    text = "\n".join(f'token = "k{k:06d}Xq9"' for k in range(20_000))
    began = time.time()
    model = secret_scan.MarkovModel(tuple([1.0] * secret_scan.STATES**2), 0.5)
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert len(row["assign"]) == 20_000
    assert time.time() - began < 60
