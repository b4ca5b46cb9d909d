from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from pulsegrid.llm import chat_format, mixing


def test_chat_query_equals_sql(spark, data):
    assert_same(chat_format.op6_chat_formatting(spark, data), chat_format.SQL, data)


def test_escapes_are_reversible_and_hide_marks(spark):
    r = random.Random(4)
    parts = ["<|", "|", "<", "[", "INST]", "/INST]", "</s>", "s>", "/", "turn|>", "end|>", "text|>", "\\", "$1", "a", "\n", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["", "<|end|>", "[[INST]", "<<|end|>>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert row["u"] == row["t"]
        assert not any(mark in row["e"] for mark in (chat_format.TURN, chat_format.TEXT, chat_format.END, "</s>", "[INST]", "[/INST]"))


def test_every_reply_is_one_example_with_all_before(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "<|end|>q"), (1, 2, "assistant", "r1"), (1, 3, "user", None), (1, 4, "assistant", "r2"), (2, 0, "user", "alone"), (3, 0, "assistant", ""), (None, 0, None, None), (4, 1, "user", "b"), (4, 1, "user", "b")]
    ex = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    told = ex.withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect()
    got = {(r["conv_id"], r["position"]): (r["loss"], [(t["role"], t["text"]) for t in r["turns"]]) for r in told}
    assert got[1, 3] == ("r1", [("system", "be"), ("user", "<|end|>q"), ("assistant", "r1")])
    assert got[1, 5][0] == "r2" and len(got[1, 5][1]) == 5 and got[1, 5][1][3] == ("user", "")
    assert got[2, 1] == (None, [("user", "alone")]) and got[3, 1] == ("", [("assistant", "")]) and got[None, 1] == (None, [("", "")])
    assert got[4, 2] == (None, [("user", "b")] * 2) and len(got) == 6


def test_no_turns_no_examples(spark):
    assert chat_format.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mixing_query_equals_sql(spark, data):
    assert_same(mixing.op9_mixing(spark, data), mixing.SQL, data)


def _fill(sizes, weights, total, cap):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), total
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over


def test_targets_and_words_taken(spark):
    r = random.Random(7)
    rows = [(i, " ".join(["word"] * r.randint(0, 40)), s) for i, s in enumerate(r.choice(["a", "b", "B", None, "é", "tiny"]) if i > 5 else "tiny" for i in range(1500))]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_size", F.lit("clash"))).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in mixed:
        n = len(x["text"].split())
        assert x["mix_size"] == n and 0 <= x["mix_copies"] <= 3
        sizes[x["source"]] += n
        taken[x["source"]] += n * x["mix_copies"]
        largest[x["source"]] = max(largest[x["source"]], n)
    want = _fill(sizes, (1, 2, 3), sum(sizes.values()), 3)
    for x in mixed:
        assert x["mix_target"] == pytest.approx(want[x["source"]]) and x["mix_source_size"] == sizes[x["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    copies = defaultdict(set)
    for x in mixed:
        copies[x["source"]].add(x["mix_copies"])
    assert all(max(c) - min(c) <= 1 for c in copies.values())  # whole epochs first


def test_mixing_odd_rows(odd, nothing):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert len({r["mix_copies"] for r in got.where("doc_id = 7").collect()}) == 1
    assert sorted(map(str, got.select("doc_id", "mix_copies").collect())) == sorted(map(str, mixing.mix(odd.orderBy(F.rand(1))).select("doc_id", "mix_copies").collect()))
    assert mixing.mix(nothing).count() == 0
    empty = mixing.mix(odd.where("doc_id IN (3, 4)")).collect()
    assert [r["mix_target"] for r in empty] == [0, 0]


def test_digest_of_loss_is_in_order(spark, data):
    turns = spark.read.parquet(data + "/conversations.parquet").orderBy("conv_id", "turn").collect()
    texts = defaultdict(str)
    for t in turns:
        texts[t["conv_id"]] += t["text"] if t["role"] == "assistant" else ""
    texts[-1] = "</s>[INST] ok [/INST]"
    got = {r["conv_id"]: r["loss_sha256"] for r in chat_format.op6_chat_formatting(spark, data).collect()}
    assert got == {c: hashlib.sha256(t.encode()).hexdigest() for c, t in texts.items()}
