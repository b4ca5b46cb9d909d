"""SimHash near-duplicates, with all close pairs found through vantage-point trees.

Documents with one fingerprint are one point. A tree over a bounded sample of points gives
each inner node a vantage point and a radius; it deals all points to shards by Hamming
distance. A point whose ball of the link radius crosses a node's sphere is sent to the far
side too, as a query only (triangle inequality), so each close pair meets in one shard at
least. Inside a shard the same splitting goes on in memory until few points are left, which
are compared in full. Shards report stars rather than pairs: their number stays in
proportion to the points however dense a group is.

What is dealt grows faster than the points: at each level of the tree a ball of two bits
crosses the sphere in about two of five cases, as distances of unrelated fingerprints differ
by a few bits only. No choice of vantage points or radii avoids this; the README has figures.

The pipeline's stage has a task of its own, texts that share most of their word shingles,
which fingerprints a few bits apart can't find. Each set of shingles is put in one common
order, rare ones first; two sets alike enough share one of the first few (prefix filter).
Most of these stand in one set alone: tokens are counted first, and a Bloom filter of those
of several sets lets rows of these through, so what is dealt and paired is a small part.
Rows meet at these, and pairs whose sizes, places and sketches allow it are compared in
full. A sketch is a bitmap of the parities of a set's hashes; two sets differ by at least as
many shingles as their bitmaps by bits, so no pair that is alike enough is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import brief_shuffles, materialise, release, ship, sized, table
from .components import connected_components

RADIUS = 2
SAMPLE = 32_768
SHARD = 8_192
LEAF = 384
#: Documents and shingles that put shingles in order of frequency, at most; any order is exact.
ORDER_DOCS, ORDER_CODES = 8_192, 200_000
#: Rows of one token that each row is compared with before groups are joined.
NEIGHBOURS = 16
#: Rows of a token that a task looks at together, about; more are dealt out by salt, by so many salts at most.
TOKEN_ROWS, SALTS_MOST = 20_000, 64
#: Places apart at which rows of frequent tokens are compared at first.
FEW = 4
#: Bits of a sketch, at least and at most; in between it has about as many as its set has shingles.
SKETCH_LEAST, SKETCH_MOST = 256, 4_096
#: Pairs whose sketches are compared at a time.
SKETCH_PAIRS = 16_384
#: Bits of the filter for a token of several rows, bytes of the filter at most (beyond, more rows pass), bytes of a chunk.
TOKEN_BITS, FILTER_BYTES, CHUNK_BYTES = 16, 32 << 20, 1 << 16
#: Rows whose tokens are looked up together.
FILTER_ROWS = 256

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PRIME = np.uint64(0x9E3779B185EBCA87)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text; A-Z count as a-z; no word gives 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS
    seen = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256)
    set_bits = (seen @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp``: the fingerprint of each row as a signed long. A null text has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps.view(np.int64)})

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInPandas(run, f"id {kind}, fp long")


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that part the points best; None where they can't be parted."""
    tried = []
    for v in points[rng.integers(0, len(points), 6)]:
        d = _distance(points, v)
        cut = int(np.median(d))
        cut -= int(cut > 0 and (d <= cut).all())
        inner = int((d <= cut).sum())
        if 0 < inner < len(points):
            torn = int((np.abs(d.astype(np.int64) - cut) <= 2).sum())
            tried.append((torn + abs(2 * inner - len(points)), int(v), cut))
    return (np.uint64(min(tried)[1]), min(tried)[2]) if tried else None


def build_tree(sample: np.ndarray, leaf: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage, cut, inner, outer)``; a child below 0 is shard ``-1 - child``."""
    rng, nodes, shards = np.random.default_rng(seed), [], [0]

    def grow(points: np.ndarray) -> int:
        parted = _split(points, rng) if len(points) > leaf else None
        if parted is None:
            shards[0] += 1
            return -shards[0]
        v, cut = parted
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        near = _distance(points, v) <= cut
        nodes[at] = (int(v), cut, grow(points[near]), grow(points[~near]))
        return at

    grow(np.unique(sample))
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``index, shard, home``: each point once at home, and as a query wherever its ball reaches."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, index, home = todo.pop()
        if not len(index):
            continue
        if at < 0:
            out.append((index, -1 - at, home))
            continue
        v, cut, inner, outer = nodes[at]
        d = _distance(points[index], np.uint64(v)).astype(np.int64)
        near = np.where(home, d <= cut, d - radius <= cut)
        far = d > cut - radius
        todo.append((inner, index[near], home[near]))
        todo.append((outer, index[far], home[far] & (d[far] > cut)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([x[0] for x in out]), np.repeat([x[1] for x in out], [len(x[0]) for x in out]), np.concatenate([x[2] for x in out])


def _stars(homes: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among few points: each linked point with the smallest label that reaches it."""
    rows = np.concatenate([homes, queries])
    near = np.bitwise_count(rows[:, None] ^ homes[None, :]) <= radius
    if near.sum() == len(homes):
        return
    label = np.arange(len(rows))
    while True:
        reach = np.where(near, label[None, : len(homes)], len(rows)).min(axis=1)
        new = np.minimum(label, reach)
        back = np.where(near, new[:, None], len(rows)).min(axis=0)
        new[: len(homes)] = np.minimum(new[: len(homes)], back)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(rows)))
    yield rows[moved], rows[label[moved]]


def close_links(homes: np.ndarray, queries: np.ndarray, radius: int, leaf: int = LEAF, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever points of ``homes`` or ``queries`` chain within the radius.

    Two queries aren't compared: each pair has its home in some shard.
    """
    rng, found = np.random.default_rng(seed), []
    todo = [(homes, queries)]
    while todo:
        h, q = todo.pop()
        if not len(h):
            continue
        parted = _split(h, rng) if len(h) > leaf else None
        if parted is None:
            for k in range(0, len(h), leaf):  # one block unless the points can't be parted
                found += _stars(h[k : k + leaf], np.concatenate([h[k + leaf :], q]), radius)
            continue
        v, cut = parted
        dh, dq = _distance(h, v).astype(np.int64), _distance(q, v).astype(np.int64)
        todo.append((h[dh <= cut], q[dq - radius <= cut]))
        todo.append((h[dh > cut], np.concatenate([h[(dh <= cut) & (dh > cut - radius)], q[dq > cut - radius]])))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that keep all components.

    The driver sees about ``sample`` points: they shape the tree, and all are dealt by it.
    """
    spark = distinct.sparkSession
    ship(spark)
    n = distinct.count()
    share = min(1.0, sample / max(n, 1))
    seen = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    seen = np.sort(seen)
    nodes = build_tree(seen, max(1, int(shard * len(seen) / max(n, 1)))) if n else []
    tree = spark.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            index, shards, home = route(fps.view(np.uint64), tree.value, radius)
            yield pd.DataFrame({"shard": shards, "fp": fps[index], "home": home})

    def compare(points: pd.DataFrame) -> pd.DataFrame:
        fps, home = points["fp"].to_numpy(np.int64).view(np.uint64), points["home"].to_numpy(bool)
        a, b = close_links(fps[home], fps[~home], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    dealt = distinct.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.repartition(len(nodes) + 1, "shard").groupBy("shard").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """``id, fp, component_id``: one row per row of ``docs``.

    Rows link where fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest id of the chain of links, null if none of its rows has an id. Null and empty
    texts, and those of white space, share fingerprint 0 and link like any other. Repeated
    rows each give a row. Other columns play no part; an empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle))
    points = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")))
    parts = connected_components(links(points, radius))
    joined = points.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(joined.select("fp", "component").join(least, "component").select("fp", "component_id"))
    return fps.join(named, "fp").select("id", "fp", "component_id")


def _text_key(text: Column) -> Column:
    """A hash of the whole text; a null one counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; of fewer words, of all of them; 0 of none."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words)) if words else 0], dtype=np.uint64).view(np.int64)
    hashes = np.array([digest(w) for w in words], dtype=np.uint64)
    n, codes = len(words) - shingle + 1, np.zeros(len(words) - shingle + 1, np.uint64)
    for k in range(shingle):
        codes = codes * _PRIME + hashes[k : k + n]
    return np.unique(codes.view(np.int64))


def prefix(codes: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest codes of a set: two sets as alike as ``similarity`` share one of these at least.

    All sets are put in one order, by rank and code; codes not in ``common`` have rank 0.
    """
    rank = np.zeros(len(codes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, codes), len(common) - 1)
        rank = np.where(common[at] == codes, ranks[at], 0)
    return codes[np.lexsort((codes, rank))][: len(codes) - int(np.ceil(similarity * len(codes) - 1e-9)) + 1]


def sketch(codes: np.ndarray) -> bytes:
    """A bitmap of the parities of the number of codes by their low bits."""
    bits = max(SKETCH_LEAST, min(SKETCH_MOST, 1 << (len(codes) - 1).bit_length()))
    odd = np.bincount(codes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of some rows; a wider one is folded where it meets one of half its width."""

    def __init__(self, sketches: np.ndarray):
        self.width = np.array([len(x) for x in sketches], np.int64)
        self.by_width = {}
        for w in np.unique(self.width).tolist():
            own, wider = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            folded = self._words(sketches[wider], 2 * w)
            place = np.full(len(sketches), -1, np.int64)
            place[own], place[wider] = np.arange(len(own)), len(own) + np.arange(len(wider))
            self.by_width[w] = place, np.concatenate([self._words(sketches[own], w), folded[:, : w // 8] ^ folded[:, w // 8 :]])

    @staticmethod
    def _words(sketches: np.ndarray, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(sketches), dtype="<u8").reshape(-1, width // 8)

    def can_be_alike(self, size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Whether rows i and j may differ by so few shingles that they are alike; true where widths don't meet."""
        good = np.ones(len(i), bool)
        most = (1 - similarity) / (1 + similarity) * (size[i] + size[j]) + 1e-6
        least = np.minimum(self.width[i], self.width[j])
        for w in np.unique(least).tolist():
            place, words = self.by_width[w]
            here = np.flatnonzero((least == w) & (place[i] >= 0) & (place[j] >= 0))
            for k in range(0, len(here), SKETCH_PAIRS):
                at = here[k : k + SKETCH_PAIRS]
                off = np.bitwise_count(words[place[i[at]]] ^ words[place[j[at]]]).sum(axis=1, dtype=np.int64)
                good[at] = off <= most[at]
        return good


def _can_be_alike(size, pos, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows i and j of a token may share enough, by their sizes and the token's places in their prefixes."""
    most = np.minimum(size[i] - pos[i], size[j] - pos[j])
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    return (low >= similarity * high - 1e-9) & (most * (1 + similarity) >= similarity * (size[i] + size[j]) - 1e-9)


def _columns(rows: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy(np.int64) for c in names]


def _neighbour_pairs(rows: pd.DataFrame, similarity: float, last: int, few: int) -> Iterator[pd.DataFrame]:
    """Pairs of rows of one token, sorted by size, up to ``last`` places apart."""
    token, key, size, pos, salt = _columns(rows, "token", "key", "size", "pos", "salt")
    for away in range(1, last + 1):
        i = np.arange(len(rows) - away) if len(rows) > away else np.zeros(0, np.int64)
        i = i[(token[i] == token[i + away]) & (salt[i] == salt[i + away]) & ((salt[i] == 0) | (away <= few))]
        i = i[(key[i] != key[i + away]) & _can_be_alike(size, pos, i, i + away, similarity)]
        if len(i):
            yield pd.DataFrame({"a": np.minimum(key[i], key[i + away]), "b": np.maximum(key[i], key[i + away])})


def _part_pairs(rows: pd.DataFrame, similarity: float, salts: int) -> Iterator[pd.DataFrame]:
    """Pairs of rows of one token (and block) and different parts.

    Sorted by part, a row meets those of later parts; sorted by size, those up to the size
    that can be alike. Each token takes the way that meets fewer: what one part holds, or
    what differs in size, costs nothing.
    """
    n = len(rows)
    token, other, size, part = _columns(rows, "token", "other", "size", "part")
    group = np.append(0, np.cumsum((token[1:] != token[:-1]) | (other[1:] != other[:-1])))
    first = np.searchsorted(group, group)
    end = np.searchsorted(group, group, side="right")
    fresh = np.append(True, (part[1:] != part[:-1]) | (group[1:] != group[:-1]))
    run = np.cumsum(fresh)
    by_part = np.searchsorted(run, run, side="right")
    order = np.lexsort((size, group))
    scale = float(size.max()) / similarity + 2
    sorted_size = size[order] + group * scale
    limit = np.searchsorted(sorted_size, size[order] / similarity + 1e-6 + group * scale, side="right")
    by_size = np.minimum(limit, end)
    sums = lambda x: np.add.reduceat(x, np.flatnonzero(np.append(True, group[1:] != group[:-1])))[group]
    small = sums(by_size - np.arange(n) - 1) < sums(end - by_part)
    sketches = Sketches(rows["sketch"].to_numpy())
    for chosen, at, start, stop in ((~small, np.arange(n), by_part, end), (small, order, np.arange(n) + 1, by_size)):
        yield from _ranges(rows, sketches, np.flatnonzero(chosen), at, start, stop, similarity, salts)


def _ranges(rows: pd.DataFrame, sketches: Sketches, which: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray, similarity: float, salts: int) -> Iterator[pd.DataFrame]:
    """Pairs of the rows at places ``which`` of an order ``at`` with those at places ``start`` to ``stop``, a bounded number at a time."""
    key, size, pos, part, salt, other = (x[at] for x in _columns(rows, "key", "size", "pos", "part", "salt", "other"))
    own_size = rows["size"].to_numpy(np.int64)
    many = (stop - start)[which]
    upto = np.cumsum(many)
    k = 0
    while k < len(which):
        to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + 200_000, side="right")))
        count = many[k:to]
        i = np.repeat(which[k:to], count)
        j = np.repeat(start[which[k:to]], count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        # Blocks of two salts hold pairs across them; those inside a salt are in its own block.
        good = (part[i] != part[j]) & _can_be_alike(size, pos, i, j, similarity) & ((salt[i] != salt[j]) | (other[i] == salt[i] * salts + salt[i]))
        i, j = i[good], j[good]
        good = sketches.can_be_alike(own_size, at[i], at[j], similarity)
        if good.any():
            i, j = i[good], j[good]
            yield pd.DataFrame({"a": np.minimum(key[i], key[j]), "b": np.maximum(key[i], key[j])})
        k = to


def _by_token(ordered: DataFrame, by: list[str], pairs) -> DataFrame:
    """``a, b`` from ``pairs`` of the rows of each group, which come one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            final = tuple(batch[c].iloc[-1] for c in by)
            open_ = np.logical_and.reduce([(batch[c] == v).to_numpy() for c, v in zip(by, final, strict=True)])
            if open_.all() and (last is None or last == final):
                held.append(batch)
            else:
                yield from pairs(pd.concat([*held, batch[~open_]]))
                held = [batch[open_]]
            last = final
        if held:
            yield from pairs(pd.concat(held))

    return ordered.mapInPandas(run, "a long, b long").distinct()


def _chunk(tokens: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk of the filter that holds a token's bits."""
    return ((tokens.view(np.uint64) >> np.uint64(32)) * np.uint64(chunks) >> np.uint64(32)).astype(np.int64)


def _places(tokens: np.ndarray) -> Iterator[np.ndarray]:
    """The places of a token's three bits in its chunk."""
    mixed = tokens.view(np.uint64) * _PRIME
    for shift in (45, 26, 7):
        yield (mixed >> np.uint64(shift) & np.uint64(8 * CHUNK_BYTES - 1)).astype(np.int64)


def token_filter(tokens: DataFrame) -> np.ndarray:
    """A Bloom filter of column ``token``, a row of bytes for each chunk; of bounded size, gathered on the driver."""
    chunks = max(1, -(-min(FILTER_BYTES, tokens.count() * TOKEN_BITS // 8) // CHUNK_BYTES))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(8 * CHUNK_BYTES, bool)
        own = group["token"].to_numpy(np.int64)
        for at in _places(own):
            bits[at] = True
        return pd.DataFrame({"chunk": _chunk(own[:1], chunks), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    dealt = tokens.select("token", F.expr(f"shiftright(shiftrightunsigned(token, 32) * {chunks}L, 32)").alias("chunk"))
    out = np.zeros((chunks, CHUNK_BYTES), np.uint8)
    for row in dealt.groupBy("chunk").applyInPandas(pack, "chunk long, bits binary").toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def may_hold(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Places of those of ``tokens`` that the filter lets through."""
    left, chunk = np.arange(len(tokens)), _chunk(tokens, len(bits))
    for at in _places(tokens):
        left = left[bits[chunk[left], at[left] >> 3] >> (at[left] & 7).astype(np.uint8) & 1 == 1]
    return left


def _near_candidates(tokens: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: rows of one token that stand within ``NEIGHBOURS`` places by size.

    The rows of a frequent token are dealt out by salt, twice and differently, so that what
    is alike grows together across salts.
    """
    frequent = tokens.groupBy("token").count().where(F.col("count") > TOKEN_ROWS).select("token", F.ceil(F.col("count") / TOKEN_ROWS).cast("int").alias("salts"))
    rows = tokens.join(sized(materialise(frequent)), "token", "left")
    deals = F.transform(F.array(F.lit(1), F.lit(2)), lambda r: r * (1 << 20) + F.pmod(F.xxhash64("key", r), F.col("salts")).cast("int"))
    salted = rows.withColumn("salt", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(deals)))
    ordered = salted.select("token", "key", "size", "pos", "salt").repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "key")
    last, few = NEIGHBOURS, FEW
    return _by_token(ordered, ["token", "salt"], lambda rows: _neighbour_pairs(rows, similarity, last, few))


def _far_candidates(named: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: rows of one token that lie in different parts (``part``) and whose ``key, sketch`` can be alike.

    Tokens within one part are passed over. The rows of a frequent token are dealt to blocks,
    one for each two salts, so that a task holds a few of them and every two rows meet once.
    """
    several = named.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    salts = F.least(F.ceil(F.col("n") / TOKEN_ROWS), F.lit(SALTS_MOST)).cast("int")
    rows = named.join(sized(materialise(several.select("token", salts.alias("salts")))), "token").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    block = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda t: F.least(F.col("salt"), t) * SALTS_MOST + F.greatest(F.col("salt"), t))
    dealt = rows.join(sketches, "key").select("token", "key", "size", "pos", "part", "salt", "sketch", F.explode(block).alias("other"))
    ordered = dealt.repartition("token", "other").sortWithinPartitions("token", "other", "part", "size", "key")
    most = SALTS_MOST
    return _by_token(ordered, ["token", "other"], lambda rows: _part_pairs(rows, similarity, most))


def fingerprint_links(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that join rows ``key, text`` whose fingerprints differ in at most ``radius`` bits.

    Rows of one fingerprint link to the smallest key; those stand for it in the trees' links.
    """
    fps = materialise(fingerprints(docs, "key").toDF("key", "fp").distinct())
    first = materialise(fps.groupBy("fp").agg(F.min("key").alias("first")))
    same = fps.join(first, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    met = links(first, radius).toDF("x", "y").join(first.toDF("x", "a"), "x").join(first.toDF("y", "b"), "y")
    out = materialise(same.union(met.select("a", "b")))
    release(fps, first)
    return out


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, joined: DataFrame | None = None) -> DataFrame:
    """``a, b``: links between rows ``key, text`` that keep all groups of chained similar texts.

    Texts are similar if they share at least ``similarity`` (Jaccard) of their word shingles.
    All such pairs are compared but those that other pairs have joined already; links that are
    known before (``joined``) count as such and are returned too.
    """
    spark = docs.sparkSession
    ship(spark)
    raw = docs.select("key", F.col("text").cast("binary").alias("text"))

    def codes_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"code": np.concatenate([shingle_set(t, shingle) for t in batch["text"]])})

    share = min(1.0, ORDER_DOCS / max(1, docs.count()))
    counts = raw.where(F.rand(7) < share).select("text").mapInPandas(codes_only, "code long").groupBy("code").count().where("count > 1")
    with brief_shuffles(spark):
        seen = counts.orderBy(F.desc("count"), "code").limit(ORDER_CODES).toPandas().sort_values("code")
    order = spark.sparkContext.broadcast((seen["code"].to_numpy(np.int64), seen["count"].to_numpy(np.int64)))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        for batch in batches:
            batch = batch[~batch["key"].duplicated() & ~batch["key"].isin(met)]
            met.update(batch["key"].tolist())
            sets = [shingle_set(t, shingle) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "size": [len(s) for s in sets], "tokens": [prefix(s, *order.value, similarity) for s in sets], "sketch": [sketch(s) for s in sets]})

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [(shingle_set(x, shingle), shingle_set(y, shingle)) for x, y in zip(batch["x"], batch["y"], strict=True)]
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], dtype=float)
            total = np.array([len(x) + len(y) for x, y in sets], dtype=float)
            yield batch.loc[shared >= similarity * (total - shared) - 1e-9, ["a", "b"]]

    made = materialise(raw.mapInPandas(prefixes, "key long, size int, tokens array<long>, sketch binary"))
    met_again = materialise(made.select(F.explode("tokens").alias("token")).groupBy("token").count().where("count > 1").select("token"))
    shared = spark.sparkContext.broadcast(token_filter(met_again))

    def rows_that_meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), FILTER_ROWS):
                few = batch.iloc[k : k + FILTER_ROWS]
                many = few["tokens"].map(len).to_numpy()
                token = np.concatenate(few["tokens"].to_list())
                pos = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
                at = may_hold(shared.value, token)
                yield pd.DataFrame({"token": token[at]} | {c: np.repeat(few[c].to_numpy(), many)[at] for c in ("key", "size")} | {"pos": pos[at]})

    tokens = materialise(made.select("key", "size", "tokens").mapInPandas(rows_that_meet, "token long, key long, size int, pos int"))
    sketches = materialise(made.groupBy("key").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    release(made, met_again)

    def may_be_alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = np.arange(len(batch))
            size = batch[["m", "n"]].to_numpy(np.int64).ravel(order="F")
            good = Sketches(batch[["x", "y"]].to_numpy().ravel(order="F")).can_be_alike(size, n, n + len(n), similarity)
            yield batch.loc[good, ["a", "b"]]

    def sketched(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketches.toDF("a", "m", "x"), "a").join(sketches.toDF("b", "n", "y"), "b")
        return both.select("a", "b", "m", "n", "x", "y").mapInPandas(may_be_alike, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        texts = raw.join(sized(wanted), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return materialise(both.mapInPandas(alike, "a long, b long"))

    near = materialise(sketched(_near_candidates(tokens, similarity)))
    edges = verified(near)
    edges = edges if joined is None else edges.union(joined)
    parts = materialise(connected_components(edges).toDF("key", "component"))
    named = materialise(tokens.join(parts, "key", "left").select("token", "key", "size", "pos", F.coalesce("component", "key").alias("part")))
    release(tokens, parts)
    far = materialise(_far_candidates(named, sketches.select("key", "sketch"), similarity).join(near, ["a", "b"], "left_anti"))
    release(named, near, sketches)
    told = edges.union(verified(far))
    release(far)
    return told


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """``docs`` without the near-duplicates of the row with the smallest id of their group.

    Rows link if they share at least ``similarity`` (Jaccard) of their word shingles, texts
    without words sharing all, and with ``radius`` also if their fingerprints differ in at most
    so many bits, found by the vantage-point trees before shingles are searched; a group is
    what links chain together. All columns stay. Rows
    without an id stay where no row of their group has one; repeated ids stay together.
    """
    keyed = docs.select(F.col(id_col).alias("id"), _text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    points = materialise(keyed.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    texts = keyed.select("key", "text")
    joined = None if radius is None else fingerprint_links(texts, radius)
    parts = connected_components(similar_links(texts, shingle, similarity, joined)).toDF("key", "component")
    named = points.join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    groups = named.groupBy("component").agg(F.min("least").alias("__least"), F.sum("n").alias("n")).where("n > 1 AND __least IS NOT NULL")
    kept = materialise(named.select("key", "component").join(groups, "component").select(F.col("key").alias("__key"), "__least"))
    release(points)
    marked = docs.withColumn("__text_key", _text_key(F.col(text_col))).join(sized(kept), F.col("__text_key") == F.col("__key"), "left")
    return marked.where(F.col("__least").isNull() | F.col(id_col).eqNullSafe(F.col("__least"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
