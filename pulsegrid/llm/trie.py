"""Prefix tries of conversations, by union-find over the neighbours of a sort.

A conversation is the sequence of its turns' digests. Sequences are sorted across the cluster;
in each range the lengths of common prefixes of neighbours are edges, and taking them from the
deepest to the shallowest, every union of two components makes (or widens) a branching node.
Nodes off the two rims of a range are final there. The rims, the paths of its first and last
sequence, go on in other ranges: each forest is contracted to them, and rims that meet in a
node's digest are summed up. All counts are sums or minima; what the first sequence of a range
shares with the last one before it was counted in both, and is taken off once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, ship, sized, table, word_count

#: Hexadecimal digits of a turn's digest (128 bits), and the digest of the root.
DIGITS = 32
ROOT = b"\0" * 16
#: Members' ids are joined in pieces of this range of ids, each by a task of its own.
PIECE_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()
#: Turns whose nodes a task holds, about.
RANGE_TURNS = 200_000

NODE = "node binary, parent binary, depth long, least long, parent_least long, n_convs long, n_children long, n_leaves long, saved long, ends string, rim boolean"
RANGE = "range_no int, first string, first_words array<int>, last string"


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits that tell turns apart; null counts as empty."""
    role = F.coalesce(role, F.lit(""))
    return F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.coalesce(text, F.lit(""))), "UTF-8"), 256), 1, DIGITS)


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, place, digest, words``: places from 1 by turn (null first; ties by digest).

    Rows without a conversation id belong to no conversation and are left out. Repeated rows
    are repeated turns. Texts are replaced by digests before anything is shuffled.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), word_count(F.col(text_col)).cast("int").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "digest", "words")


def _sequences(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """``key, words, piece, n, least, ids``: equal sequences together, a row for each piece of their ids.

    A sequence is one value of 36 bytes a turn, which must fit a task.
    """
    turn = F.struct("place", "digest", "words")
    rows = placed.select("conv_id", turn.alias("t")).union(convs.select("conv_id", F.lit(None).cast(placed.select(turn.alias("t")).schema["t"].dataType)))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    keyed = whole.select("conv_id", F.array_join("t.digest", "").alias("key"), F.col("t.words").alias("words"))
    # Ids are distinct here, so a piece holds no more of them than its range.
    return keyed.groupBy("key", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    )


def _shared(a: str, b: str) -> int:
    """Turns that two keys have in common at their start."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * DIGITS] == b[: mid * DIGITS]:
            low = mid
        else:
            high = mid - 1
    return low


def _step(chain: bytes, key: str, depth: int) -> bytes:
    """Digest of the node at ``depth`` from that of its parent."""
    return hashlib.sha256(chain + key[(depth - 1) * DIGITS : depth * DIGITS].encode()).digest()[:16]


class _Forest:
    """The sorted, distinct sequences of a range, and the tree that their common prefixes make."""

    def __init__(self) -> None:
        self.key, self.chain = "", [ROOT]
        self.length: list[int] = []
        self.shared: list[int] = []
        #: From the depth shared with the sequence before: digests of nodes, and words up to there.
        self.chains: list[list[bytes]] = []
        self.words: list[list[int]] = []
        self.n: list[int] = []
        self.least: list[int] = []
        self.ends: list[str] = []
        self.first: tuple[str, list[int]] | None = None

    def add(self, key: str, words: list[int], n: int, least: int, ends: str) -> None:
        length = len(key) // DIGITS
        shared = _shared(self.key, key) if self.length else 0
        del self.chain[shared + 1 :]
        for depth in range(shared + 1, length + 1):
            self.chain.append(_step(self.chain[-1], key, depth))
        total = sum(words[:shared])
        upto = [total]
        for w in words[shared:]:
            total += w
            upto.append(total)
        if self.first is None:
            self.first = key, list(words)
        self.key = key
        for to, what in ((self.length, length), (self.shared, shared), (self.chains, self.chain[shared:]), (self.words, upto), (self.n, n), (self.least, least), (self.ends, ends)):
            to.append(what)

    def nodes(self) -> Iterator[list]:
        """A row of ``NODE`` for each node."""
        size = len(self.length)
        convs, leaves, all_words, new_words = [0], [0], [0], [0]
        for i in range(size):
            convs.append(convs[-1] + self.n[i])
            leaves.append(leaves[-1] + (i + 1 == size or self.shared[i + 1] < self.length[i]))
            all_words.append(all_words[-1] + self.n[i] * self.words[i][-1])
            new_words.append(new_words[-1] + self.words[i][-1] - self.words[i][0])
        # Components are ranges of sequences; `top` is the depth of a component's node.
        parent, high = list(range(size)), list(range(size))
        top, least, children = list(self.length), list(self.least), [0] * size
        waiting: list[list[list]] = [[] for _ in range(size)]

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def close(x: int, above: int) -> list:
            """Rows of a component's node and of the chain over it, down from depth ``above + 1``; the last is the top one."""
            low, start, rows = x, self.shared[x] if x else 0, []
            for depth in range(top[x], above, -1):
                before = self.words[low][depth - 1 - start] if depth else 0
                n = convs[high[x] + 1] - convs[low]
                saved = all_words[high[x] + 1] - all_words[low] - n * before - (new_words[high[x] + 1] - new_words[low + 1] + self.words[low][-1] - before)
                row = [
                    self.chains[low][depth - start], self.chains[low][depth - 1 - start] if depth else None, depth, least[x], None, n, children[x] if depth == top[x] else 1,
                    leaves[high[x] + 1] - leaves[low], saved, self.ends[low] if self.length[low] == depth else None, low == 0 or high[x] == size - 1,
                ]
                for child in waiting[x]:
                    # The parent's least id, where the parent is final.
                    child[4] = None if row[10] else row[3]
                waiting[x] = [row]
                rows.append(row)
            return rows

        done: list[list] = []
        for i in sorted(range(1, size), key=lambda i: -self.shared[i]):
            depth, a, b = self.shared[i], find(i - 1), find(i)
            # A component is known by its lowest sequence.
            done += close(b, depth)
            if top[a] > depth:
                done += close(a, depth)
                children[a] = 1
            waiting[a] += waiting[b]
            waiting[b] = []
            children[a] += 1
            parent[b], high[a], top[a], least[a] = a, high[b], depth, min(least[a], least[b])
        yield from done
        if size:
            yield from close(0, -1)


def _grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``NODE`` and one of ``RANGE`` from the sorted sequences of a range."""
    forest, key, words, n, least, ends = _Forest(), None, [], 0, 0, None
    for batch in batches:
        for at in zip(batch["key"], batch["words"], batch["n"], batch["least"], batch["ids"], strict=True):
            if at[0] != key:
                if key is not None:
                    forest.add(key, words, n, least, ends.hexdigest())
                key, words, n, least, ends = at[0], [int(w) for w in at[1]], int(at[2]), int(at[3]), hashlib.sha256(at[4].encode())
            else:
                n, least = n + int(at[2]), min(least, int(at[3]))
                ends.update(b"," + at[4].encode())
    if key is None:
        return
    forest.add(key, words, n, least, ends.hexdigest())
    names = [x.split()[0] for x in NODE.split(", ")]
    none = [None] * 4
    rows: list[list] = [[None] * len(names) + [TaskContext.get().partitionId(), forest.first[0], forest.first[1], forest.key]]
    columns = names + [x.split()[0] for x in RANGE.split(", ")]
    for row in forest.nodes():
        rows.append(row + none)
        if len(rows) >= 20_000:
            yield _frame(rows, columns)
            rows = []
    yield _frame(rows, columns)


def _frame(rows: list[list], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})


def _twice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is counted on both sides of a border: rows ``node, n_children, n_leaves, saved`` to be added."""
    for batch in batches:
        rows = []
        for first, words, before in zip(batch["first"], batch["first_words"], batch["before"], strict=True):
            shared = _shared(before, first)
            rest, chain = sum(int(w) for w in words[:shared]), ROOT
            leaf = -1 if len(before) == shared * DIGITS else 0
            for depth in range(shared + 1):
                if depth:
                    chain = _step(chain, first, depth)
                rows.append((chain, -1 if depth < shared else 0, leaf, rest))
                if depth:
                    rest -= int(words[depth - 1])
        yield pd.DataFrame(rows, columns=["node", "n_children", "n_leaves", "saved"])


def grow_trie(placed: DataFrame, convs: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row for each distinct beginning of a conversation, the empty one included.

    ``placed`` has ``conv_id, place, digest, words`` (a place once in a conversation), ``convs``
    every ``conv_id``, those without turns too. Columns: ``conv_id`` (the smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``. Without conversations there is no row.

    A task holds the nodes of its range, of about ``range_turns`` turns; there are as many ranges
    as that takes. Of sequences that many conversations share it reads
    one row for each piece of ids, since their digest can only be worked out in a row.
    """
    spark = placed.sparkSession
    ship(spark)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() // range_turns + 1)
    dealt = _sequences(placed, convs).repartitionByRange(ranges, "key").sortWithinPartitions("key", "piece")
    grown = materialise(dealt.mapInPandas(_grow, f"{NODE}, {RANGE}"))
    nodes = grown.where("node IS NOT NULL").drop(*[x.split()[0] for x in RANGE.split(", ")])
    # One row for each range, however many rows there are.
    ranges = grown.where("node IS NULL").select("range_no", "first", "first_words", F.lag("last").over(Window.orderBy("range_no")).alias("before")).where("before IS NOT NULL")
    twice = ranges.mapInPandas(_twice, "node binary, n_children long, n_leaves long, saved long")
    rims = nodes.where("rim").unionByName(twice, allowMissingColumns=True).groupBy("node")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    rims = materialise(rims.agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("least").alias("least"), *sums, F.max("ends").alias("ends")))
    above = sized(rims.select(F.col("node").alias("above"), F.col("least").alias("above_least")))
    both = nodes.where("NOT rim").drop("rim").unionByName(rims, allowMissingColumns=True)
    known = both.where("parent_least IS NOT NULL")
    asked = both.where("parent_least IS NULL").join(above, F.col("parent") == F.col("above"), "left").withColumn("parent_least", F.col("above_least")).select(*known.columns)
    return known.union(asked).select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
    )


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``grow_trie`` of a table of turns; other columns play no part."""
    placed = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    return grow_trie(placed, placed.select("conv_id").distinct())


def rebuilt(placed: DataFrame, span: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that take over how another one begins, and all ids.

    Conversation c begins with the first h turns of c - c % ``span``, h being the checksum of
    its decimal id modulo ``most``, and goes on with its own turns after its first h. No more
    than ``most`` - 1 rows of a conversation are handed to fewer than 2 * ``span`` others.
    """
    convs = placed.select("conv_id").distinct()
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    heads = placed.where((F.col("place") < most) & (F.col("conv_id") % span == 0)).withColumnRenamed("conv_id", "from")
    given = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("from")).join(heads, "from").where("place <= h")
    own = placed.where(F.col("place") > h)
    return given.select(*placed.columns).union(own), convs


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = materialise(numbered_turns(table(spark, sf_dir, "conversations")))
    return grow_trie(*rebuilt(placed))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(text, '') AS text, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM t
), x AS (
  SELECT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM (SELECT DISTINCT conv_id FROM o)
), bits AS (
  SELECT conv_id, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, d: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
  FROM x
), c AS (
  SELECT conv_id, xor(4294967295, crc) % 4 AS h, conv_id - conv_id % 20 AS base FROM bits
), r AS (
  SELECT c.conv_id, o.place, o.digest, o.words FROM c JOIN o ON o.conv_id = c.base WHERE o.place <= c.h
  UNION ALL SELECT c.conv_id, o.place, o.digest, o.words FROM c JOIN o ON o.conv_id = c.conv_id WHERE o.place > c.h
), s AS (
  SELECT c.conv_id, coalesce(string_agg(r.digest, '' ORDER BY r.place), '') AS key, coalesce(list(r.words ORDER BY r.place) FILTER (WHERE r.place IS NOT NULL), []) AS words
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, key, words, unnest(range(CAST(length(key) / 32 AS BIGINT) + 1)) AS depth FROM s
), n AS (
  SELECT substr(key, 1, depth * 32) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(CASE WHEN depth = 0 THEN 0 ELSE words[depth] END) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length(key) = depth * 32), '')) AS ends_sha256
  FROM p GROUP BY ALL
), k AS (
  SELECT n.node, count(m.node) AS n_children FROM n LEFT JOIN n m ON m.depth = n.depth + 1 AND substr(m.node, 1, n.depth * 32) = n.node GROUP BY n.node
), u AS (
  SELECT substr(n.node, 1, d.d * 32) AS node, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM (SELECT node, saved, unnest(range(depth + 1)) AS d FROM n) d JOIN n ON n.node = d.node JOIN k ON k.node = n.node GROUP BY ALL
)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN k ON k.node = n.node JOIN u ON u.node = n.node LEFT JOIN n q ON q.depth = n.depth - 1 AND q.node = substr(n.node, 1, (n.depth - 1) * 32)
"""
