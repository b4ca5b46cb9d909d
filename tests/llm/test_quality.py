from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
import regex
from test_text_ops import WORD, _quality_base

from pulsegrid.llm import quality


def _distance(p, q):
    def part(a, b):
        return a * math.log2(2 * a / (a + b)) / 2 if a > 0 else 0.0

    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True))))


def _verdicts(rows):
    """Plain re-statement of the divergence rules: kept and both distances by document."""
    features, counts = {}, defaultdict(Counter)
    for i, text, lang in rows:
        words = WORD.findall(text)
        short = [w for w in WORD.findall(text.lower()) if len(w) <= quality.SHORT]
        counts[lang].update(short)
        base = _quality_base(text)
        letters, upper = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
        digits = len(regex.findall("[0-9]", text))
        sizes = [letters - upper, upper, digits, len(text) - base[1], base[2], base[1] - letters - digits - base[2]]
        features[i] = (lang, len(words), base[5], [x / max(sum(sizes), 1) for x in sizes], Counter(short))
    common = {lang: sorted(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]) for lang, c in counts.items()}
    seen = {i: [c[w] for w in common.get(lang, [])] for i, (lang, _, _, _, c) in features.items()}
    refs = {}
    for lang in {f[0] for f in features.values()}:
        good = [i for i, f in features.items() if f[0] == lang and not f[2]]
        if good:
            medians = [sorted(math.floor(features[i][3][k] * quality.BINS + 0.5) for i in good)[(len(good) - 1) // 2] / quality.BINS for k in range(6)]
            total = sum(features[i][1] for i in good)
            shares = [sum(seen[i][k] for i in good) / total for k in range(len(common.get(lang, [])))]
            refs[lang] = [m / (sum(medians) + 1e-12) for m in medians], [*shares, 1 - sum(shares)]
    out = {}
    for i, (lang, n, failed, classes, _) in features.items():
        if lang not in refs:
            out[i] = (not failed, None, None)
            continue
        shares = [x / max(n, 1) for x in seen[i]]
        a, b = _distance(classes, refs[lang][0]), _distance([*shares, 1 - sum(shares)], refs[lang][1])
        none = sum(seen[i]) == 0 and n * (1 - refs[lang][1][-1]) >= quality.EXPECTED
        far = n >= quality.MIN_WORDS and (none or a > quality.CLASS_LIMIT + quality.CLASS_NOISE / math.sqrt(n) or b > quality.WORD_LIMIT + quality.WORD_NOISE / math.sqrt(n))
        out[i] = (not failed and not far, a, b)
    return out


def test_query_equals_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in spark.read.parquet(data + "/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = _verdicts(rows)
    got = quality.op7_quality_rules(spark, data).collect()
    assert len(got) == len(rows)
    for r in got:
        kept, a, b = want[r["doc_id"]]
        assert r["kept"] == kept
        if a is not None and r["n_words"]:
            assert r["class_distance"] == pytest.approx(a, abs=2e-6) and r["word_distance"] == pytest.approx(b, abs=2e-6)
    assert 0 < sum(r["kept"] for r in got) < len(got)


def test_medians_do_not_depend_on_how_rows_are_dealt(spark, data):
    docs = spark.read.parquet(data + "/documents.parquet")
    a, b = (sorted(map(str, quality.judge(d).collect())) for d in (docs, docs.repartition(7, "n_chars")))
    assert a == b
