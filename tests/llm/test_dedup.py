from __future__ import annotations

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import xxhash
from helpers import assert_same
from pyspark.sql import functions as F

from pulsegrid import tables
from pulsegrid.llm import exact_dedup, simhash
from pulsegrid.llm.components import connected_components


def test_exact_query_equals_sql(spark, data):
    assert_same(exact_dedup.op3_exact_dedup(spark, data), exact_dedup.SQL, data)


def test_exact_groups_of_odd_rows(odd, nothing):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r["doc_id"], (r["text"] or "").translate(lower)) for r in odd.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.duplicate_groups(odd, keep=keep).collect()
        want = sorted(str((i, pick([x for x in groups[t] if x is not None], default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())) for i, t in rows)
        assert sorted(str((r["id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.duplicate_groups(nothing).count() == 0 and exact_dedup.drop_duplicates(nothing).count() == 0


def test_a_text_in_a_third_of_all_rows_is_split(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the very same' ELSE concat('own ', id) END AS text")
    got = exact_dedup.duplicate_groups(df, keep="largest").where("group_size > 1").groupBy("keep_id", "group_size").count().collect()
    assert [(r["keep_id"], r["group_size"], r["count"]) for r in got] == [(2997, 1000, 1000)]


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    codes = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def _components(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_near_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(data + "/documents.parquet").collect()
    fps = {r["doc_id"]: _fingerprint(r["text"]) for r in docs}
    want = _components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = simhash.op2_simhash_near_dedup(spark, data).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {i: (fps[i], want[i]) for i in fps}


def test_near_groups_of_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["id"] in (3, 4, 5)} == {3} and {r["fp"] for r in got if r["id"] in (3, 4, 5)} == {0}
    assert {r["component_id"] for r in got if r["id"] in (1, 2, 9)} == {1} and [r["component_id"] for r in got if r["id"] is None] == [None]
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "3", "6", "7", "7", "8", "None"]


def test_trees_lose_no_link():
    rng = np.random.default_rng(0)
    points = [int(x) for x in rng.integers(0, 2**63, 300)]
    for _ in range(500):  # chains and a dense group
        v = points[int(rng.integers(0, len(points)))] if rng.random() < 0.6 else points[0]
        for b in rng.integers(0, 63, int(rng.integers(1, 4))):
            v ^= 1 << int(b)
        points.append(v)
    x = np.unique(np.array(points, dtype=np.uint64))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    want = _components(range(len(x)), lambda a, b: near[a, b])
    nodes = simhash.build_tree(x[::2], 40)
    index, shard, home = simhash.route(x, nodes, 2)
    assert home.sum() == len(x)
    edges = set()
    for s in np.unique(shard):
        own = shard == s
        a, b = simhash.close_links(x[index[own & home]], x[index[own & ~home]], 2, leaf=16)
        edges |= set(zip(a.tolist(), b.tolist(), strict=True))
    at = {int(v): k for k, v in enumerate(x)}
    linked = {frozenset((at[a], at[b])) for a, b in edges}
    assert _components(range(len(x)), lambda a, b: frozenset((a, b)) in linked) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _edited(n, edits, rng):
    words = [f"w{k}" for k in rng.integers(0, 5_000, n)]
    out = list(words)
    for k in edits:
        out[k] = f"new{rng.integers(0, 10**9)}"
    return " ".join(words), " ".join(out)


def _alike(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def _first_of_groups(texts):
    groups = _components(sorted(texts), lambda a, b: _alike(texts[a], texts[b]))
    return sorted(i for i, g in groups.items() if i == g)


def test_stage_finds_all_edited_copies(spark, data):
    rng = np.random.default_rng(5)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(data + "/documents.parquet").select("doc_id", "text").collect()}
    for k in range(0, 60, 2):  # copies of one to three edits: 3 to 13 bits, not 2
        texts[10_000 + k], texts[10_001 + k] = _edited(int(rng.integers(60, 200)), rng.integers(0, 60, int(rng.integers(1, 4))), rng)
    want = _first_of_groups(texts)
    assert len(want) < len(texts) - 20
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == want


def test_stage_finds_pairs_beyond_the_first_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(simhash, "NEIGHBOURS", 1)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 60, int(rng.integers(0, 4))):
            words[k] = f"x{rng.integers(0, 3)}"
        texts[i] = " ".join(words[: int(rng.integers(50, 61))])
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == _first_of_groups(texts)


def test_stage_keeps_one_row_of_chains_and_bridges(spark):
    words = [f"w{k}" for k in range(100)]

    def with_edits(*at):
        return " ".join("edit" + w if k in at else w for k, w in enumerate(words))

    texts = {1: with_edits(2), 2: with_edits(2, 50), 3: with_edits(2, 50, 97), 4: with_edits(2, 50, 97, 30)}  # a chain
    texts |= {9: with_edits(2, 50, 97, 30, 75), 0: "same " * 300 + "one", 5: "same " * 300 + " ".join(words[:40]), 6: "same " * 300 + " ".join(words[:40]) + " end"}  # 5 and 6 are alike, 0 is like neither
    texts |= {7: "", 8: "a b"}
    want = _first_of_groups(texts)
    assert not _alike(texts[1], texts[9]) and want == [0, 1, 5, 7, 8]
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == want


def _template_docs(spark, n, alike):
    """Texts of one token order: copies of a template with a few words changed, or texts that share a passage alone."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit("w"), k)), " ")
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 if alike else 30)), lambda k: F.concat(F.lit("o"), F.col("id"), F.lit("x"), k)), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words, own).alias("text"))


def test_many_near_copies_of_one_template_finish(spark, monkeypatch):
    n = 10_000
    monkeypatch.setattr(simhash, "TOKEN_ROWS", 2_000)
    began = time.time()
    kept = simhash.drop_near_duplicates(_template_docs(spark, n, True)).collect()
    assert [r["doc_id"] for r in kept] == [0]
    assert time.time() - began < 240


def test_frequent_tokens_in_blocks_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 9, 30])):
            words[rng.randrange(60)] = f"r{rng.randrange(10**6)}"
        texts.append(" ".join(words[: rng.randint(30, 60)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(90):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert want == [i for i in range(90) if find(i) == i]
    for rows, most, places in ((7, 64, 1), (3, 4, 2)):
        monkeypatch.setattr(simhash, "TOKEN_ROWS", rows)
        monkeypatch.setattr(simhash, "SALTS_MOST", most)
        monkeypatch.setattr(simhash, "NEIGHBOURS", places)
        assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == want


def test_sketches_never_say_more_than_sets_differ_and_part_unlike_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pool = rng.integers(-(2**62), 2**62, 12_000)
    sets = [np.unique(rng.choice(pool[: max(2, 2 * n)], n)) for n in (1, 3, 250, 255, 260, 300, 500, 520, 5_000, 6_000)]
    sets += [np.union1d(s[: 9 * len(s) // 10], rng.integers(0, 2**62, len(s) // 20)) for s in sets]
    size, sketches = np.array([len(s) for s in sets]), simhash.Sketches(np.array([simhash.sketch(s) for s in sets], dtype=object))
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    for similarity in (0.3, 0.8, 1.0):
        alike = np.array([len(np.intersect1d(sets[a], sets[b])) >= similarity * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
        assert sketches.can_be_alike(size, i, j, similarity)[alike].all()
    assert not sketches.can_be_alike(size, np.array([4]), np.array([5]), 0.8).any()

    # Sixty texts share two thirds of their words, no two of them enough; a random order of shingles makes them meet.
    told, whole = [], simhash._far_candidates
    monkeypatch.setattr(simhash, "NEIGHBOURS", 1)
    monkeypatch.setattr(simhash, "ORDER_DOCS", 0)
    monkeypatch.setattr(simhash, "_far_candidates", lambda *a: told.append(whole(*a).count()) or whole(*a))
    texts = [" ".join([f"t{k}" for k in range(200)] + [f"o{i}x{k}" for k in range(100)]) for i in range(60)]
    texts += [texts[0] + " one", texts[1] + " more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == list(range(60))
    assert told[0] < 60


def test_stage_deals_shared_tokens_alone_and_leaves_little(spark, monkeypatch):
    texts = [" ".join(f"o{i}x{k}" for k in range(100)) for i in range(300)]
    texts += [texts[i] + " end" for i in range(0, 300, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told, whole = [], simhash._near_candidates
    monkeypatch.setattr(simhash, "_near_candidates", lambda tokens, *a: told.append(tokens.count()) or whole(tokens, *a))
    before = len(tables._WRITTEN.get(spark.sparkContext.applicationId, []))
    # A row has about 20 tokens; those of the 60 rows that have a partner are dealt, and few that the filter mistakes.
    for most in (simhash.FILTER_BYTES, 0):
        monkeypatch.setattr(simhash, "FILTER_BYTES", most)
        kept = simhash.drop_near_duplicates(docs, radius=2)
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    assert all(60 * 15 < n < 60 * 21 + 200 for n in told)
    tokens = np.random.default_rng(4).integers(-(2**62), 2**62, 40_000)
    bits = simhash.token_filter(spark.createDataFrame([(int(t),) for t in tokens[:20_000]], "token long"))
    passed = simhash.may_hold(bits, tokens)
    assert (passed[:20_000] == np.arange(20_000)).all() and len(passed) < 20_800
    # What is read no more is gone, tables and shuffle files; the setting is as it was.
    assert len(tables._WRITTEN[spark.sparkContext.applicationId]) - before < 30
    sums = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: disk.getAllFiles().mkString("\n").count("/shuffle_")
    held = shuffled()
    stored = tables.materialise(sums)
    time.sleep(1)
    assert shuffled() <= held and stored.count() == 7
    tables.release(stored)
    assert spark.conf.get(tables._CLEAN) == "false"
