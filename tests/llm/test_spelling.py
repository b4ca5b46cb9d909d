"""Spelling variants against SQL and against all pairs of a small vocabulary."""

from __future__ import annotations

import random
import zlib
from collections import Counter

from helpers import assert_same
from pulsegrid.llm import spelling
from pyspark.sql import functions as F


def _near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups(vocab: dict[str, int]) -> set[tuple]:
    form, out = {}, set()
    near = {w: [v for v in vocab if v != w and _near(v, w)] for w in vocab}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None))
    return out


def _rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_query_equals_sql(spark, data):
    assert_same(spelling.op13_spelling_variants(spark, data), spelling.SQL, data)


def test_groups_equal_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(5, 8))) for _ in range(700)} | {"a" * 90, "a" * 91, "a" * 89 + "é", "aaaaab", "aaaaa"}
    vocab = {w: 3 + int(rng.paretovariate(0.6)) for w in words}
    got = _rows(spelling.variant_groups(spark.createDataFrame(list(vocab.items()), "word string, n long").repartition(5)))
    assert len(got) == len(vocab)
    assert set(got) == _groups(vocab)


def test_filters_of_any_size_give_the_same_pairs(spark):
    rng = random.Random(5)
    vocab = {"".join(rng.choice("abcdé") for _ in range(6)): i for i in range(400)}
    rows = spark.createDataFrame(list(vocab.items()), "word string, n long")
    want = {(a, b) for a in vocab for b in vocab if a != b and _near(a, b)}
    for most in (64, 1 << 20):
        got = [(r["word"], r["near"]) for r in spelling.near_words(rows, max_bytes=most).collect()]
        assert len(got) == len(want)
        assert set(got) == want


def test_misspelling_follows_the_checksum(spark):
    rows = [(None, "abcdef")] + [(i, "straße" if i % 2 else "wording") for i in range(400)]
    df = spark.createDataFrame([(None if i is None else str(i), w) for i, w in rows], "id string, run string")
    got = [tuple(r) for r in df.select("id", "run", spelling.misspelt("id", "run")).collect()]
    cut = 0
    for i, run, word in got:
        h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
        at = h % len(run)
        assert word == (run[:at] + run[at + 1 :] if h % 97 == 0 else run)
        cut += h % 97 == 0
    assert cut


def test_odd_rows(spark, odd, nothing):
    words = spelling.runs_of(odd).select(spelling.misspelt("id", "run").alias("word"))
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    counts: Counter = Counter()
    for i, text in texts:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in __import__("re").findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert set(_rows(spelling.variant_groups(spelling.vocabulary(words)))) == _groups(vocab)
    none = spelling.variant_groups(spelling.vocabulary(spelling.runs_of(nothing).select(F.col("run").alias("word"))))
    assert _rows(none) == []


def test_blocks_are_bounded():
    blocks = spelling.blocks_of({5: 10**9, 6: 10**8}, max_bytes=1 << 20)
    assert sum(blocks.values()) * 64 <= 1 << 20
    assert spelling.blocks_of({}) == {}
