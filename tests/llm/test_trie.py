"""Tries of conversations against SQL and against plain dictionaries of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from helpers import assert_same
from pulsegrid.llm import trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _nodes(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in ids if len(convs[c]) == len(p))
        out.append((
            min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def _got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def _plain(rows) -> dict[int, list[tuple[str, str]]]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}


def test_query_equals_sql(spark, data):
    assert_same(trie.op12_conversation_trie(spark, data), trie.SQL, data)


def test_random_conversations(spark):
    rng = random.Random(7)
    rows = []
    for c in range(-30, 250):
        # A third begins alike, a third is the same throughout.
        turns = ["x y"] * 6 if c % 3 == 0 else [rng.choice(["a", "b c", "é  d", ""]) for _ in range(rng.randint(1, 6))]
        rows += [(c, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(turns)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    want = _nodes(_plain(rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        # One range, a few, and more than there are sequences.
        for n in ("1", "7", "400"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert _got(trie.prefix_trie(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    placed = trie.numbered_turns(df)
    assert _got(trie.grow_trie(placed, placed.select("conv_id").distinct(), range_turns=3)) == want


def test_rebuilt_conversations(spark):
    rng = random.Random(8)
    rows = [(c, k, "user", f"{rng.randint(0, 2)}") for c in [*range(-25, 0), *range(1, 90), 1000, 1001] for k in range(rng.randint(1, 5))]
    plain = _plain(rows)
    convs = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 0 - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = plain.get(base, [])[:h] + turns[h:]
    assert any(not t for t in convs.values())
    placed = trie.numbered_turns(spark.createDataFrame(rows, TURNS))
    assert _got(trie.grow_trie(*trie.rebuilt(placed))) == _nodes(convs)


def test_odd_rows(spark):
    long = "word " * 20_000
    rows = [
        (1, 0, "user", "hi there"), (1, None, None, None), (1, 1, "assistant", long), (2, 0, "user", "hi there"), (2, None, "", ""), (3, 0, "user", "hi there"), (3, 0, "user", "hi there"),
        (None, 0, "user", "no conversation"), (4, 5, "1:user", ""), (5, 5, "", "1:user"), (6, 9, "user", "中文 😀　x"),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, TURNS)
    for name in ("key", "piece", "place", "node", "depth", "least", "meta.url"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    assert _got(trie.prefix_trie(df)) == _nodes(_plain(rows))
    assert _got(trie.prefix_trie(df.where("1 = 0"))) == []


def test_one_very_long_conversation(spark):
    n = 20_000
    rows = [(1, k, "user", str(k)) for k in range(n)] + [(2, k, "user", str(k)) for k in range(n // 2)]
    got = {r["depth"]: r for r in trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert len(got) == n + 1
    assert [got[d]["n_convs"] for d in (0, n // 2, n // 2 + 1, n)] == [2, 2, 1, 1]
    assert got[0]["saved_tokens"] == n // 2
    assert all(got[d]["n_leaves"] == 1 for d in (0, 5, n))
