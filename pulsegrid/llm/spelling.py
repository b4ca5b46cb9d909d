"""Groups of spelling variants: words one edit apart, found through Bloom filters.

Every word's edits are generated and probed against blocked Bloom filters of the vocabulary,
one filter for each word length. Filters are of bounded size and go to every machine; what
they let through is joined with the vocabulary itself, which removes false positives, so the
filters affect speed alone. An edit is looked for from one side only: deletions lead to the
shorter word, replacements to the greater character, and each pair found holds both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, ship, table

#: Runs of letters, after A-Z went to lower case.
RUN = r"[a-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT = 5, 3
#: One in so many occurrences is misspelt, by a rule that anybody can repeat.
MISSPELT = 97
#: A word's form occurs so many times as often, at least.
RATIO = 2
#: Bits for a word, bytes of all filters together at most, bits set for a word. Beyond 16 million
#: words the filters let more through; the join still decides.
BITS, MAX_BYTES, PROBES = 16, 32 << 20, 6
#: Longer words share a filter.
LONGEST = 64
#: Blocks of 512 bits that travel as one value.
CHUNK = 1024

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, run``: every lower-cased run of letters that could make a word; a null text has none."""
    lower = lower_ascii(F.col(text_col))
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    return runs.where(F.length("run") >= MIN_CHARS)


def misspelt(id_col: str | Column, run: str | Column, one_in: int = MISSPELT) -> Column:
    """The run, or where its checksum says so the run without one of its code points; a null id is written as nothing."""
    run = F.col(run) if isinstance(run, str) else run
    code = F.crc32(F.encode(F.concat(F.coalesce(id_col if isinstance(id_col, Column) else F.col(id_col), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(code, F.length(run)).cast("int")
    return F.when(code % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, word_col: str = "word", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: words of enough code points that occur often enough; null is no word."""
    counts = words.where(F.length(word_col) >= min_chars).groupBy(F.col(word_col).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points plus one, a row for each word of this length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)


def _powers(length: int) -> np.ndarray:
    out = np.full(length, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash codes from polynomial sums; words of different lengths differ."""
    x = sums + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(codes: np.ndarray, blocks: int) -> np.ndarray:
    return ((codes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bit(codes: np.ndarray, j: int) -> np.ndarray:
    """Place of the word's bit number ``j`` inside its block of 512."""
    return (codes * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(10 + 9 * j)) & np.uint64(511)


def _shard(length: int) -> int:
    return min(length, LONGEST)


def _by_length(words: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def blocks_of(counts: dict[int, int], bits: int = BITS, max_bytes: int = MAX_BYTES) -> dict[int, int]:
    """Blocks of 64 bytes for each shard; together no more than ``max_bytes``, but for one block each."""
    wanted = sum(counts.values()) * bits / 8
    share = min(1.0, max_bytes / wanted) if wanted else 1.0
    return {shard: max(1, int(n * bits * share / 512)) for shard, n in counts.items()}


def _marks(blocks: dict[int, int]):
    """For words: a row of eight lanes of 64 bits each, with the word's bits set."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, words in _by_length(batch["word"].tolist()).items():
                codes = _mixed((_codes(words, length) * _powers(length)).sum(axis=1, dtype=np.uint64), length)
                lanes = np.zeros((len(words), 8), dtype=np.uint64)
                for j in range(PROBES):
                    bit = _bit(codes, j)
                    lanes[np.arange(len(words)), (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
                out = {"shard": np.full(len(words), _shard(length), dtype=np.int32), "block": _block(codes, blocks[_shard(length)]).astype(np.int64)}
                yield pd.DataFrame(out | {f"l{k}": lanes[:, k].view(np.int64) for k in range(8)})

    return mark


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a chunk as bytes."""
    bits = np.zeros((CHUNK, 8), dtype=np.int64)
    bits[group["block"].to_numpy() % CHUNK] = group[[f"l{k}" for k in range(8)]].to_numpy()
    return pd.DataFrame({"shard": group["shard"].iloc[:1], "chunk": group["chunk"].iloc[:1], "bits": [bits.tobytes()]})


def bloom_filters(vocab: DataFrame, blocks: dict[int, int]) -> dict[int, bytes]:
    """The filter of each shard, gathered on the driver: ``MAX_BYTES`` at most, whatever the vocabulary."""
    lanes = [f"l{k}" for k in range(8)]
    marks = vocab.select("word").mapInPandas(_marks(blocks), "shard int, block long, " + ", ".join(f"{x} long" for x in lanes))
    merged = marks.groupBy("shard", "block").agg(*[F.expr(f"bit_or({x})").alias(x) for x in lanes]).withColumn("chunk", F.expr(f"block div {CHUNK}"))
    packed = merged.groupBy("shard", "chunk").applyInPandas(_pack, "shard int, chunk long, bits binary")
    out = {shard: bytearray(-(-n // CHUNK) * CHUNK * 64) for shard, n in blocks.items()}
    for row in packed.toLocalIterator():
        at = row["chunk"] * CHUNK * 64
        out[row["shard"]][at : at + CHUNK * 64] = row["bits"]
    return {shard: bytes(bits) for shard, bits in out.items()}


def _hits(codes: np.ndarray, bits: np.ndarray, blocks: int) -> np.ndarray:
    """Indices of those of ``codes`` that the filter lets through; each probe leaves fewer to the next."""
    left = np.arange(len(codes))
    for j in range(PROBES):
        now = codes[left]
        bit = _bit(now, j)
        lane = bits[(_block(now, blocks) * np.uint64(8) + (bit >> np.uint64(6))).astype(np.int64)]
        left = left[((lane >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)]
        if not len(left):
            break
    return left


def _probe(filters: dict, blocks: dict[int, int], alphabet: str):
    letters = np.array(sorted(map(ord, alphabet)), dtype=np.uint64) + np.uint64(1)

    def edits(words: list[str], length: int) -> Iterator[tuple[int, str]]:
        """Word number and edited word, for the edits that the filters let through."""
        codes, powers = _codes(words, length), _powers(length)
        terms = codes * powers
        sums = terms.sum(axis=1, dtype=np.uint64)
        shorter, same = _shard(length - 1), _shard(length)
        small = np.frombuffer(filters[shorter].value, dtype=np.uint64) if shorter in filters else None
        large = np.frombuffer(filters[same].value, dtype=np.uint64)
        before = np.zeros(len(words), dtype=np.uint64)
        for i in range(length):
            if small is not None:
                # Of equal neighbours the first alone is left out: the others give the same word.
                first = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(len(words))
                cut = (before + (sums - before - terms[:, i]) * _INVERSE)[first]
                for h in _hits(_mixed(cut, length - 1), small, blocks[shorter]):
                    w = int(first[h])
                    yield w, words[w][:i] + words[w][i + 1 :]
            for x in letters:
                greater = np.flatnonzero(x > codes[:, i])
                if not len(greater):
                    continue
                swapped = sums[greater] + (x - codes[greater, i]) * powers[i]
                for h in _hits(_mixed(swapped, length), large, blocks[same]):
                    w = int(greater[h])
                    yield w, words[w][:i] + chr(int(x) - 1) + words[w][i + 1 :]
            before = before + terms[:, i]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_of = dict(zip(batch["word"], batch["n"], strict=True))
            for length, words in _by_length(list(n_of)).items():
                step = max(1, (1 << 18) // length)
                for at in range(0, len(words), step):
                    some = words[at : at + step]
                    found: list[tuple[str, int, str]] = []
                    for w, edited in edits(some, length):
                        found.append((some[w], n_of[some[w]], edited))
                        if len(found) * length >= 1 << 20:
                            yield pd.DataFrame(found, columns=["word", "n", "other"])
                            found = []
                    if found:
                        yield pd.DataFrame(found, columns=["word", "n", "other"])

    return probe


def near_words(vocab: DataFrame, bits: int = BITS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words exactly one edit apart, both ways.

    ``vocab`` has ``word, n``, each word once; it is read several times, so write it before.
    A word has no more partners than there are edits of it, so no group grows without bound.
    """
    spark = vocab.sparkSession
    ship(spark)
    sizes = vocab.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("shard")).count()
    # At most LONGEST rows, and at most the letters that RUN allows.
    blocks = blocks_of({r["shard"]: r["count"] for r in sizes.collect()}, bits, max_bytes)
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect()))
    filters = {shard: spark.sparkContext.broadcast(b) for shard, b in bloom_filters(vocab, blocks).items()}
    # Words of one length come together, so that a task loads few filters.
    dealt = vocab.repartitionByRange(F.length("word"), "word")
    positives = dealt.mapInPandas(_probe(filters, blocks, alphabet), "word string, n long, other string")
    pairs = positives.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), F.col("other") == F.col("near")).select("word", "n", "near", "near_n")
    pairs = materialise(pairs)
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def variant_groups(vocab: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of ``vocab`` (``word, n``).

    ``form`` is the near word that occurs most often (ties: the smallest by code point), if
    it occurs ``ratio`` times as often, else null; ``root`` ends the chain of forms. Counts
    at least double at each step, so chains are short and never run in a circle. An empty
    vocabulary gives an empty result.
    """
    if ratio <= 1:
        raise ValueError(f"ratio: {ratio}")
    vocab = materialise(vocab.select("word", "n"))
    # The smallest of (-n, word) is the largest count, ties by code point: strings compare by UTF-8 bytes.
    best = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    rows = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    rows = materialise(rows)
    ends = _ends(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(links: DataFrame) -> DataFrame:
    """``word, root`` with every link followed to its end; each round doubles the steps taken."""
    now = materialise(links)
    while True:
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        then = materialise(now.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_of(table(spark, sf_dir, "documents"))
    return variant_groups(vocabulary(runs.select(misspelt("id", "run").alias("word"))))


#: Checksums by the usual table of 256 entries, which a fold over eight bits makes.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(t ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS t FROM (SELECT unnest(range(256)) AS i)
  )
), o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), r AS (
  SELECT doc_id, run, count(*) AS k FROM o WHERE length(run) >= 5 GROUP BY ALL
), x AS (
  SELECT run, k, t, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r, crc
), h AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda a, b: xor(t[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8))) AS h
  FROM x
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h
), v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), d AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), p AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word
), b AS (
  SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM p GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 2 * v.n THEN b.best_n END AS form_n,
    CASE WHEN b.best_n >= 2 * v.n THEN (SELECT min(p.near COLLATE "C") FROM p WHERE p.word = v.word AND p.near_n = b.best_n) END AS form
  FROM v LEFT JOIN b ON v.word = b.word
), s AS (
  SELECT word, coalesce(form, word) AS root FROM f
  UNION SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN s ON f.word = s.word JOIN f e ON e.word = s.root WHERE e.form IS NULL
"""
