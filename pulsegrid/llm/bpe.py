"""Byte-pair encoding and decoding with a word-level vocabulary file.

Merges of a word are found with a segment tree over the ranks of its adjacent pairs: the
root holds the lowest rank, the way down to the left gives its leftmost place, and a merge
updates three leaves in logarithmic time. The new words of a batch are merged side by side,
their trees the rows of one array; long words have a tree of their own. The work is spread by
document; a worker keeps the ids of words in use, as many as a fixed bound allows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

NO_RANK = 1 << 60
#: The same in arrays, and words of how many bytes are merged side by side, in arrays of so many places.
NO_RANK_32, SIDE, SIDE_PLACES = (1 << 31) - 1, 64, 1 << 17
#: Characters of texts whose new words are looked up together; with the caches it decides on a worker's memory.
GROUP_CHARS = 1 << 20
CACHED = 150_000
CACHED_LENGTH = 80
#: White space to str.split that isn't white space to the vocabulary's splitter.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The splitter of the vocabulary, inside a run without white space.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairTree:
    """A segment tree of pair ranks: the lowest, its leftmost place, updates in log time."""

    def __init__(self, ranks: list[int]):
        self.width = 1 << max(0, (len(ranks) - 1).bit_length())
        self.low = [NO_RANK] * self.width + ranks + [NO_RANK] * (self.width - len(ranks))
        low = self.low
        for k in range(self.width - 1, 0, -1):
            a, b = low[2 * k], low[2 * k + 1]
            low[k] = a if a <= b else b

    def leftmost(self) -> int:
        """Place of the leftmost lowest rank; -1 if no pair has one."""
        low, k = self.low, 1
        if low[1] == NO_RANK:
            return -1
        least, width = low[1], self.width
        while k < width:
            k *= 2
            if low[k] != least:
                k += 1
        return k - width

    def put(self, place: int, rank: int) -> None:
        low, k = self.low, place + self.width
        if low[k] == rank:
            return
        low[k] = rank
        while k > 1:
            other = low[k ^ 1]
            if other < rank:
                rank = other
            k >>= 1
            if low[k] == rank:
                return
            low[k] = rank


class Cache:
    """A dictionary in two generations: what wasn't asked for while one filled up is forgotten.

    So words in use stay when rare ones have filled the bound.
    """

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordBPE:
    """Encoder and decoder for a vocabulary file with word ends and lower-cased text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + self.end] for x in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._words, self._chunks = Cache(CACHED), Cache(CACHED)
        # The same tables as arrays: pairs in order, their ranks, and what a rank's pair becomes.
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self._pairs, self._pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        self._made = np.array(self.made, np.int64)
        self._inner, self._last = np.array(self.inner, np.int64), np.array(self.last, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        inner = self.inner
        symbols = [inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        ranks, made = self.ranks, self.made
        rank = ranks.get
        tree = PairTree([rank(p, NO_RANK) for p in zip(symbols, symbols[1:])])
        low, put, leftmost = tree.low, tree.put, tree.leftmost
        if low[1] == NO_RANK:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while low[1] != NO_RANK:
            i = leftmost()
            j = after[i]
            symbols[i] = new = made[ranks[symbols[i], symbols[j]]]
            symbols[j] = -1
            after[i] = k = after[j]
            if j < n - 1:
                put(j, NO_RANK)
            if k < n:
                before[k] = i
                put(i, rank((new, symbols[k]), NO_RANK))
            else:
                put(i, NO_RANK)
            h = before[i]
            if h >= 0:
                put(h, rank((symbols[h], new), NO_RANK))
        return [s for s in symbols if s >= 0]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where(self._pairs[at] == keys, self._pair_ranks[at], NO_RANK_32)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers; short ones are merged side by side."""
        found: list[bytes] = [b""] * len(words)
        kinds: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if len(word) > SIDE or not len(self._pairs):
                ids = self.merge(word)
                found[at] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                kinds.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(at)
        for width, places in kinds.items():
            most = SIDE_PLACES // width
            for k in range(0, len(places), most):
                some = places[k : k + most]
                for at, ids in zip(some, self._side_by_side([words[x] for x in some], width), strict=True):
                    found[at] = ids
        return found

    def _side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        """``merge`` of words of at most ``width`` bytes (a power of two): a row for each word."""
        m, n = len(words), np.array([len(w) for w in words])
        place = np.arange(width)
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        symbols = np.where(place == n[:, None] - 1, self._last[letters], self._inner[letters])
        symbols[place >= n[:, None]] = -1
        # Leaf k of a word's tree is the pair that begins at k; node 1 is its root.
        tree = np.full((m, 2 * width), NO_RANK_32, np.int64)
        inside = place[:-1] < n[:, None] - 1
        tree[:, width:-1][inside] = self._ranks_of(symbols[:, :-1][inside], symbols[:, 1:][inside])
        k = width // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        after, before = np.tile(place + 1, (m, 1)).ravel(), np.tile(place - 1, (m, 1)).ravel()
        low, symbol = tree.ravel(), symbols.ravel()
        rows = np.flatnonzero(tree[:, 1] < NO_RANK_32)
        while len(rows):
            root, base, ends = rows * (2 * width), rows * width, n[rows]
            least, node = low[root + 1], np.ones(len(rows), np.int64)
            for _ in range(width.bit_length() - 1):
                node *= 2
                node += low[root + node] != least
            i = node - width
            j, h, new = after[base + i], before[base + i], self._made[least]
            k = after[base + j]
            symbol[base + i], symbol[base + j], after[base + i] = new, -1, k
            goes, low[root + width + j], low[root + width + i] = k < ends, NO_RANK_32, NO_RANK_32
            nxt = (base + k)[goes]
            before[nxt] = i[goes]
            low[(root + node)[goes]] = self._ranks_of(new[goes], symbol[nxt])
            led = h >= 0
            low[(root + width + h)[led]] = self._ranks_of(symbol[(base + h)[led]], new[led])
            for up in (width + j, node, (width + h)[led]):
                top = root if len(up) == len(root) else root[led]
                for _ in range(width.bit_length() - 1):
                    up = up >> 1
                    low[top + up] = np.minimum(low[top + 2 * up], low[top + 2 * up + 1])
            rows = rows[low[root + 1] < NO_RANK_32]
        left = symbols >= 0
        ids, ends = symbols[left].astype("<u4").tobytes(), (4 * np.cumsum(left.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _parts_of(self, chunk: str) -> list[str]:
        """The words of a run without white space, and the special tokens in it."""
        if self._cut is None or "<|" not in chunk:
            return self._words_of(chunk)
        return [part for piece in self._cut.split(chunk) for part in ([piece] if piece in self.special else self._words_of(piece))]

    @staticmethod
    def _words_of(chunk: str) -> list[str]:
        if not chunk.isascii():
            return _PARTS.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        return [chunk.lower()] if chunk.isalpha() else _PARTS.findall(chunk.lower())

    def _pack(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of each run, as little-endian 32-bit integers."""
        packed, cut = {}, {}
        for chunk in chunks:
            known = self._chunks.get(chunk)
            if known is None:
                cut[chunk] = self._parts_of(chunk)
            else:
                packed[chunk] = known
        # No word is written like a special token: the splitter parts letters from signs.
        words = {name: struct.pack("<I", i) for name, i in self.special.items()}
        asked = {part for parts in cut.values() for part in parts}.difference(words)
        new = []
        for word in asked:
            known = self._words.get(word)
            if known is None:
                new.append(word)
            else:
                words[word] = known
        for word, ids in zip(new, self.merge_all([word.encode() for word in new]), strict=True):
            words[word] = ids
            if len(word) <= CACHED_LENGTH:
                self._words.put(word, ids)
        for chunk, parts in cut.items():
            if len(parts) == 1:  # a word's ids are kept once, with the words
                packed[chunk] = words[parts[0]]
                continue
            packed[chunk] = ids = b"".join([words[part] for part in parts])
            if len(chunk) <= CACHED_LENGTH:
                self._chunks.put(chunk, ids)
        return packed

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers; null is the empty text."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        cut = [_SPACE.split(text) if _ODD.search(text) else text.split() for text in texts]
        packed = self._pack({chunk for chunks in cut for chunk in chunks}).__getitem__
        for chunks in cut:
            yield b"".join(map(packed, chunks))

    def encode(self, text: str | None) -> bytes:
        return next(iter(self.encode_all([text])))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, as the vocabulary file names no decoder; special ones stay."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """One coder for each vocabulary file and worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def _here(path: str | None) -> str:
    return path if path and os.path.exists(path) else vocabulary_path()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` and, ``with_ids``, ``ids``: one row per row.

    A null text encodes as the empty one: no ids. Texts are taken whole at any length. The
    digests are of the ids as little-endian unsigned 32-bit integers and of the text decoded
    from them, in UTF-8. Repeated rows and null ids each give a row; other columns play no
    part. ``path`` names the vocabulary file where workers find it at the same place as the
    driver; else they take the installed one.
    """
    ship(docs.sparkSession)
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(_here(path))
        for batch in batches:
            rows, packed = [], []
            for ids in coder.encode_all(batch.column(1).to_pylist()):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()))
                if with_ids:
                    packed.append(ids)
            columns = [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields))]
            names = ["id", *(name for name, _ in fields)]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id, text``: tokens of each array of ids joined by blanks; null ids give the empty text."""
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(_here(path))
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id")
