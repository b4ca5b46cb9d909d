from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from pulsegrid.llm import exact_dedup, mixing, simhash
from pulsegrid.llm.common import materialise


def test_stages_act_and_keep_columns(spark, data):
    docs = spark.read.parquet(data + "/documents.parquet")
    columns, labels = docs.columns, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(data + "/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, data))
        assert docs.columns == columns
        seen[name] = (before, docs)
    left = {r["doc_id"] for r in seen["toxicity"][1].collect()}
    assert not any(t and i in left for i, t in labels.items())
    before, after = seen["exact dedup"]
    want = {r["keep_id"] for r in exact_dedup.duplicate_groups(before, keep="largest").collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)
    before, after = seen["near dedup"]
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in before.collect()}

    def shingles(i):
        return {tuple(texts[i][k : k + 5]) for k in range(max(1, len(texts[i]) - 4))}

    def alike(i, j):
        a, b = shingles(i), shingles(j)
        return len(a & b) >= 0.8 * len(a | b)

    # A group is what links of 0.8 chain together; its smallest id stays.
    places = defaultdict(list)
    for i in texts:
        for x in shingles(i):
            places[x].append(i)
    group = {i: i for i in texts}
    links = [p for p in {(i, j) for at in places.values() for i in at for j in at if i < j} if alike(*p)]
    while moved := [(i, j) for i, j in links if group[i] != group[j]]:
        for i, j in moved:
            group[i] = group[j] = min(group[i], group[j])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, g in group.items() if i == g)
    before, after = seen["mixing"]
    want = Counter({r["doc_id"]: r["mix_copies"] for r in mixing.mix(before).collect() if r["mix_copies"]})
    assert Counter(r["doc_id"] for r in after.collect()) == want
    out = corpus_pipeline.run(spark, data)
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == want


def test_stages_take_odd_and_empty_rows(spark, data, odd, nothing):
    small = odd.select("doc_id", "text", "lang", "source", "n_chars")
    left = {}
    for docs in (small, small.where("1 = 0")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, data))
            assert docs.columns == small.columns
            left.setdefault(name, set()).update(str(r["doc_id"]) for r in docs.select("doc_id").collect())
        out = materialise(corpus_pipeline.STAGES[-1][1](spark, docs, data))
        assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in docs.collect())
    # Equal but for case, repeats, and null, empty and blank texts are one group each.
    assert left["toxicity"] == {"1", "2", "3", "4", "5", "6", "7", "8", "9", "None"}
    assert left["exact dedup"] == {"9", "4", "5", "6", "7", "8", "None"} and left["near dedup"] == {"9", "4", "6", "7", "8", "None"}
    assert left["mixing"] <= left["near dedup"]


def test_near_copies_are_found_by_fingerprints_too(spark, data):
    words = [f"w{k}" for k in range(40)]
    base = " ".join(words * 30)
    rows = [(1, base), (2, base + " end"), (3, "other text of its own"), (4, " ".join(f"v{k}" for k in range(90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = simhash.fingerprint_links(docs.withColumnRenamed("doc_id", "key"))
    near = {(r["a"], r["b"]) for r in links.collect()}
    bits = {(a, b) for a, s in rows for b, t in rows if a < b and (simhash.fingerprint(s.encode()) ^ simhash.fingerprint(t.encode())).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in near} == bits == {(1, 2)}
    asked = []
    whole = simhash.fingerprint_links
    simhash.fingerprint_links = lambda *a: asked.append(1) or whole(*a)
    try:
        kept = corpus_pipeline.drop_near_copies(spark, docs, data)
    finally:
        simhash.fingerprint_links = whole
    assert asked and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
