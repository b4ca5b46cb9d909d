"""Rules and path templates against a plain version of the same tree, and planted bad templates."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pulsegrid.llm import url_filter
from pulsegrid.llm.common import table
from pyspark.sql import functions as F

RARE, ANY, END = url_filter.RARE, url_filter.ANY, url_filter.END


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def _rule(host, path, rules=url_filter.RULES):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)


def _judge(urls, labelled, literal_min=20, delta=0.05, weight=8.0, purity=0.5):
    """Verdict, template and purity of each url."""
    counts = defaultdict(lambda: [0, 0, 0])
    marked = lambda url: (_parts(url)[0], re.sub("[0-9]+", "{d}", _parts(url)[1]))
    for url in urls:
        counts[marked(url)][0] += 1
    for url, bad in labelled:
        if url is not None and bad is not None:
            counts[marked(url)][1] += 1
            counts[marked(url)][2] += bad
    for c in counts.values():
        c[0] = max(c[0], c[1])
    segments = lambda path: (path[1:].split("/") if path else []) + [END]
    seen = Counter()
    for (host, path), c in counts.items():
        s = segments(path)
        for i, x in enumerate(s):
            seen[host, i, x, i > 0 and "{d}" in s[i - 1]] += c[0]
    template = {}
    for host, path in counts:
        s, out = segments(path), []
        for i, x in enumerate(s):
            fixed = x in (END, "") or "{d}" in x or seen[host, i, x, i > 0 and "{d}" in s[i - 1]] >= literal_min
            end = re.search(r"\.[A-Za-z0-9]{1,5}$", x)
            t = x if fixed else RARE + (end.group() if end else "")
            if not (t == RARE and out and out[-1] == RARE):
                out.append(t)
        template[host, path] = tuple(out)

    def tree(of):
        nodes = defaultdict(lambda: [0, 0, 0])
        for (host, _), (t, c) in of.items():
            for i in range(len(t) + 1):
                for k in range(3):
                    nodes[host, t[:i]][k] += c[k]
        return nodes

    nodes = tree({key: (template[key], counts[key]) for key in counts})
    below = defaultdict(list)
    for host, t in nodes:
        if t:
            below[host, t[:-1]].append(t)
    limit = lambda n, m: math.sqrt(math.log(2 / delta) / 2) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    merged = set()
    for (host, parent), kids in below.items():
        kids = [t for t in kids if t[-1] != END]
        if len(kids) < 2:
            continue
        pool = [sum(nodes[host, t][k] for t in kids) for k in range(3)]
        together = Counter()
        for t in kids:
            for u in below[host, t]:
                together[u[-1]] += nodes[host, u][0]
        alike = []
        for t in kids:
            n, known, bad = nodes[host, t]
            own = {u[-1]: nodes[host, u][0] for u in below[host, t]}
            ok = all(abs(v / n - together[x] / pool[0]) <= limit(n, pool[0]) for x, v in own.items())
            ok = ok and 1 - sum(together[x] for x in own) / pool[0] <= limit(n, pool[0])
            if ok and known and pool[1]:
                ok = abs(bad / known - pool[2] / pool[1]) <= limit(known, pool[1])
            if ok:
                alike.append(t)
        if len(alike) > 1:
            merged |= {(host, t) for t in alike}
    final = {key: tuple(ANY if (key[0], t[: i + 1]) in merged else x for i, x in enumerate(t)) for key, t in template.items()}
    nodes = tree({key: (final[key], counts[key]) for key in counts})
    known, bad = (sum(c[k] for c in counts.values()) for k in (1, 2))
    share = bad / known if known else 0.0
    out = []
    for url in urls:
        key = marked(url)
        p = share
        for i in range(len(final[key]) + 1):
            n = nodes[key[0], final[key][:i]]
            p = (n[2] + weight * p) / (n[1] + weight)
        rule = _rule(*_parts(url))
        verdict = rule[2] if rule else "block" if 1 - p < purity else "allow"
        out.append((url, *_parts(url), rule and rule[0] + rule[1], verdict, "/" + "/".join(x for x in final[key] if x != END), round(1 - p, 9)))
    return out


def _made(rng):
    urls, labelled = [], []
    for host in ("a.org", "b.org", "www.c.net"):
        for _ in range(700):
            kind = rng.random()
            if kind < 0.5:
                url = f"https://{host}/{rng.choice(['en', 'de', 'pt'])}/{rng.randint(1, 999)}{rng.choice(['', '', '.html', '/'])}"
            elif kind < 0.7:
                url = f"http://{host.upper()}/tag/{''.join(rng.choices('abcdef', k=5))}?q={rng.random()}"
            elif kind < 0.85:
                url = f"https://{host}/shop/item-{rng.randint(1, 99)}/buy#x"
            else:
                url = f"https://{host}/{''.join(rng.choices('xyz', k=4))}/{''.join(rng.choices('xyz', k=4))}/{rng.choice(['a.php', 'b.php'])}"
            urls.append(url)
            if rng.random() < 0.3:
                labelled.append((url, rng.random() < (0.9 if "shop" in url and host == "a.org" else 0.1)))
    return urls, labelled


def _frames(spark, urls, labelled):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return pages, spark.createDataFrame(labelled, "url string, bad boolean")


def _got(df, urls):
    return [(urls[r["id"]], r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 9)) for r in df.orderBy("id").collect()]


def test_equals_brute_force_and_blocks_the_planted_template(spark):
    urls, labelled = _made(random.Random(3))
    pages, labels = _frames(spark, urls, labelled)
    got = _got(url_filter.judge(pages, labels), urls)
    assert got == _judge(urls, labelled)
    blocked = {(g[1], g[5]) for g in got if g[4] == "block" and g[3] is None}
    assert blocked == {("a.org", "/shop/item-{d}/buy")}


def test_query_equals_brute_force(spark, data):
    df = url_filter.op11_url_filters(spark, data)
    pages = table(spark, data, "pages")
    labels = {r["doc_id"]: r["quality"] == 0 or r["toxic"] == 1 for r in table(spark, data, "labels").collect()}
    rows = [(r["page_id"], r["url"]) for r in pages.select("page_id", "url").collect()]
    labelled = []
    for _, url in rows:
        number = re.search(r"([0-9]+)[^0-9]*$", _parts(url)[1])
        if number and int(number.group(1)) in labels:
            labelled.append((url, labels[int(number.group(1))]))
    assert labelled
    want = {i: w[1:] for (i, _), w in zip(rows, _judge([u for _, u in rows], labelled), strict=True)}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["template"], r["purity"]) for r in df.collect()}
    assert {i: (*w[:5], round(w[5], 6)) for i, w in want.items()} == got


def test_labels_of_siblings_reach_a_merged_branch(spark):
    urls = [f"https://x.org/{b}/{n}" for b in ("one", "two", "six") for n in range(60)] + [f"https://x.org/about/{n}/team" for n in range(60)]
    labelled = [(u, True) for u in urls if "/one/" in u or "/two/" in u] + [(u, False) for u in urls if "about" in u]
    got = _got(url_filter.judge(*_frames(spark, urls, labelled)), urls)
    assert got == _judge(urls, labelled)
    assert {g[4] for g in got if "about" not in g[0]} == {"block"}
    assert {g[4] for g in got if "about" in g[0]} == {"allow"}


@pytest.mark.parametrize(
    ("url", "rule"),
    [
        ("http://example.com/en/1", "example.com/en/"), ("http://www.EXAMPLE.com/en/1", "www.example.com/en/"), ("http://a.www.example.com/en/", "www.example.com/en/"), ("http://notexample.com/en/", "com/"),
        ("http://example.com", None), ("http://example.com?x", None), ("http://x.net/es/", "net/es/"), ("http://x.net/es", None), ("x.net/es/", None), (None, None), ("http://a.com/x?u=http://b.net/fr/", "com/"), ("://com/", "com/"),
        ("http://com/", "com/"), ("http://a.org/", None),
    ],
)
def test_rules(spark, url, rule):
    df = spark.createDataFrame([(url,)], "url string").select(*[c.alias(n) for c, n in zip(url_filter.host_and_path(F.col("url")), ("host", "path"), strict=True)])
    row = df.withColumn("fits", url_filter.fitting_rule(F.col("host"), F.col("path"))).first()
    assert (row["host"], row["path"]) == _parts(url)
    assert (row["fits"]["rule"] if row["fits"] else None) == rule


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "http://h.org", "http://h.org/", "http://h.org//", "HTTP://H.ORG/a\nb/c", "http://h.org/" + "/".join("ab"[i % 2] + str(i) for i in range(800)), "http://h.org/" + "x" * 50_000, "http://é.org/ü/😀", "http://h.org/", "://", "a://b://c/d"]
    labelled = [(None, True), ("http://h.org/", None), ("http://h.org/", True), ("http://h.org/", True), ("http://elsewhere.org/only/labelled", True)]
    pages, labels = _frames(spark, urls, labelled)
    for name in ("host", "path", "n", "known", "bad", "t_host", "template", "meta.url"):
        pages = pages.withColumn(name, F.lit(None).cast("string"))
    assert _got(url_filter.judge(pages, labels), urls) == _judge(urls, labelled)
    twice = pages.union(pages.withColumn("page_id", F.lit(None).cast("long")))
    assert url_filter.judge(twice, labels).count() == 2 * len(urls)
    assert url_filter.judge(pages.where("1 = 0"), labels.where("1 = 0")).collect() == []
    assert {r["verdict"] for r in url_filter.judge(pages, labels.where("1 = 0")).collect()} == {"allow"}


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError, match="rules"):
        url_filter.fitting_rule(F.lit("a"), F.lit("/"), [("a", "/", "allow")] * (url_filter.MAX_RULES + 1))
