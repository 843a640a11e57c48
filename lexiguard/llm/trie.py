"""Prefix tries of conversations: what turns they share from the start, how often, and what sharing would save.

Every turn becomes a digest of its role and text, every conversation a list of
digests, and equal lists fall together before a trie is built. Lists are dealt
by the hash of their first turn to buckets, and each bucket's tries, a node
being a dictionary from digest to node, are built in one call of applyInPandas
and summed up from the leaves in a loop. Where the lists under one first turn
hold more turns than a task should, they leave the buckets: the turns that all
of them share become a chain, and they are dealt by the turn after it, again
and again while a part is too large. Chains get their sums from the parts below
them. So a bucket's size is bounded whatever turn, or conversation, most rows
have; what a task must hold is one conversation's digests, 24 bytes a turn.

The ids of a node's own conversations are joined in order by pieces, which are
hashed in a stream, so copies of one conversation need no memory either.

Turns are in order of turn (null first), then role and text; null roles and
texts are empty before that; a repeated row is a turn of its own. Rows without
a conversation id belong to no conversation and are left out, since neither
their length of head nor where it comes from is defined. Without conversations
there are no nodes, not even a root. Further columns are not read. Two turns
count as equal if 128 bits of SHA-256 over both their values are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiguard.llm.chat import positions
from lexiguard.llm.common import join_spread, map_rows, written

#: Conversations of one block take their heads from its first id.
BLOCK_IDS = 100
MOST_HEAD_TURNS = 6
#: Turns that a bucket is meant to hold, and how many times a bucket's share one first turn may have.
BUCKET_TURNS = 20_000
MOST_SHARES = 4
#: Below so many turns, nothing is dealt again.
LEAST_SPLIT = 1_000
#: Ids that are joined into one piece.
PIECE_IDS = 5_000

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODES = T.StructType([*(T.StructField(c, T.StringType() if c == "ends_sha256" else T.LongType()) for c in COLUMNS), T.StructField("up", T.BinaryType()), T.StructField("top", T.BooleanType())])
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, digests, chars) of every conversation: its turns in order, without their texts."""
    filled = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    role = F.encode("role", "utf-8")
    digest = _digest(F.encode(F.length(role).cast("string"), "utf-8"), F.encode(F.lit(":"), "utf-8"), role, F.encode("text", "utf-8"))
    rows = positions(filled).select("conv_id", "pos", digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))
    return lists.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.chars").alias("chars"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """convs with each one's first turns taken from the first conversation of its block of ids, as many as a checksum of its id says."""
    block = F.col("conv_id") - F.col("conv_id") % BLOCK_IDS
    heads = convs.where(F.col("conv_id") % BLOCK_IDS == 0).select(F.col("conv_id").alias("block"), *(F.slice(c, 1, MOST_HEAD_TURNS - 1).alias(f"head_{c}") for c in ("digests", "chars")))
    taken = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % MOST_HEAD_TURNS
    joined = convs.select("*", block.alias("block"), taken.cast("int").alias("h")).join(heads, "block", "left")

    def whole(c: str) -> Column:
        head = F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.array().cast(convs.schema[c].dataType))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c)

    return joined.select("conv_id", whole("digests"), whole("chars"))


def joined_ids(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(key, first id, ids with commas) of runs of one key in sorted rows (key, id)."""
    key, ids = None, []
    for k, i in rows:
        if ids and (k != key or len(ids) >= PIECE_IDS):
            yield key, ids[0], ",".join(map(str, ids))
            ids = []
        key = k
        ids.append(i)
    if ids:
        yield key, ids[0], ",".join(map(str, ids))


def hashed_pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(key, SHA-256 of its pieces with commas) of sorted rows (key, first id, piece)."""
    key, digest = None, None
    for k, _, piece in rows:
        if digest is not None and k == key:
            digest.update(b"," + piece.encode())
            continue
        if digest is not None:
            yield key, digest.hexdigest()
        key, digest = k, hashlib.sha256(piece.encode())
    if digest is not None:
        yield key, digest.hexdigest()


def id_hashes(members: DataFrame) -> DataFrame:
    """(key, ends): the hash of each key's ids in ascending order. However many a key has, they are joined by many tasks, and one passes over the pieces."""
    order = ["key", "conv_id"]
    pieces = map_rows(members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), order, joined_ids, "key binary, first bigint, piece string")
    return map_rows(pieces.repartition("key").sortWithinPartitions("key", "first"), ["key", "first", "piece"], hashed_pieces, "key binary, ends string")


class Trie:
    """Nodes in the order they were made, so that each comes after its parent. below maps a turn to the node for it."""

    def __init__(self) -> None:
        self.below: list[dict[bytes, int]] = [{}]
        self.parent, self.chars = [-1], [0]
        self.n_convs, self.conv_id, self.ends = [0], [0], [NO_ENDS]

    def add(self, digests: list[bytes], chars: list[int], n: int, conv_id: int, ends: str) -> None:
        at = 0
        for digest, size in zip(digests, chars, strict=True):
            down = self.below[at].get(digest)
            if down is None:
                down = self.below[at][digest] = len(self.below)
                for column, x in ((self.below, {}), (self.parent, at), (self.chars, size), (self.n_convs, 0), (self.conv_id, conv_id), (self.ends, NO_ENDS)):
                    column.append(x)
            at = down
            self.n_convs[at] += n
            self.conv_id[at] = min(self.conv_id[at], conv_id)
        self.ends[at] = ends

    def rows(self, start: int, parent_id: int, up: bytes) -> list[tuple]:
        """Rows of NODES of all nodes but the top, whose own depth is start. Children come before parents in the loop."""
        size = len(self.below)
        leaves, saved, depth = [0] * size, [0] * size, [start] * size
        for i in range(1, size):
            depth[i] = depth[self.parent[i]] + 1
        for i in range(size - 1, 0, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.n_convs[i] - 1) * self.chars[i]
            leaves[self.parent[i]] += leaves[i]
            saved[self.parent[i]] += saved[i]
        ids = [parent_id, *self.conv_id[1:]]
        return [(ids[i], depth[i], ids[self.parent[i]], self.n_convs[i], len(self.below[i]), leaves[i], saved[i], self.ends[i], up, self.parent[i] == 0) for i in range(1, size)]


def build_bucket(bucket: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all tries in a bucket."""
    out: list[tuple] = []
    for _, lists in bucket.groupby("gid", sort=False):
        trie, start = Trie(), int(lists["start"].iloc[0])
        for digests, chars, n, conv_id, ends in zip(*(lists[c] for c in ("digests", "chars", "n", "conv_id", "ends")), strict=True):
            trie.add(list(digests[start:]), chars[start:].tolist(), int(n), int(conv_id), ends)
        out += trie.rows(start, int(lists["parent"].iloc[0]), lists["up"].iloc[0])
    return pd.DataFrame(out, columns=NODES.names)


def _split(work: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """What is large of work: (work of the other groups, chains, work dealt by the turn after its chain); None if nothing is."""
    size = F.size("digests")
    groups = work.groupBy("gid").agg(F.sum(size - F.col("start")).alias("turns"), F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("top_id"), F.min(F.struct("digests", "chars")).alias("lo"), F.max("digests").alias("hi"))
    # Lists differ, so the least and the greatest do after what all have in common.
    shared = (F.array_position(F.zip_with("lo.digests", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False)) - 1).cast("int")
    large = written(groups.where((F.col("turns") > most) & (F.col("n_rows") > 1)).select("gid", "n_rows", "n_convs", "top_id", shared.alias("shared"), F.slice("lo.chars", F.lit(1), shared).alias("path_chars")))
    if large.isEmpty():
        return None
    ids = large.select("gid", "n_rows", "shared", "top_id")
    inside = written(join_spread(work, ids, "gid"))
    rest = work.join(large.select("gid"), "gid", "left_anti")
    ended = inside.where(size == F.col("shared")).select("gid", "ends")
    heads = inside.groupBy("gid").agg(F.first("start").alias("start"), F.first("parent").alias("parent"), F.first("up").alias("up"))
    chains = written(large.join(heads, "gid").join(ended, "gid", "left").drop("n_rows"))
    deeper = inside.where(size > F.col("shared")).select(
        "conv_id", "digests", "chars", "n", "ends", F.unhex(F.sha2(F.concat("gid", F.get("digests", F.col("shared"))), 256)).alias("gid"), F.col("shared").alias("start"), F.col("top_id").alias("parent"), F.col("gid").alias("up")
    )
    return rest, chains, written(deeper)


def chain_rows(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of NODES for each turn of chains, from the last, whose sums are known, to the first."""
    for top_id, start, shared, path_chars, parent, n_convs, n_below, leaves, saved, ends, up in rows:
        for depth in range(shared, start, -1):
            saved += (n_convs - 1) * path_chars[depth - 1]
            last, first = depth == shared, depth == start + 1
            yield top_id, depth, parent if first else top_id, n_convs, n_below if last else 1, leaves, saved, ends if last else NO_ENDS, up, first


def _chain_nodes(chains: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of chains, one for each turn from start to shared, given the sums of what is below their last."""
    sums = below.groupBy("up").agg(F.count(F.lit(1)).alias("n_below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("up", "gid")
    known = chains.withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))).join(sums, "gid")
    return map_rows(known, ["top_id", "start", "shared", "path_chars", "parent", "n_convs", "n_below", "leaves", "saved", "ends", "up"], chain_rows, NODES)


def prefix_nodes(convs: DataFrame, bucket_turns: int = BUCKET_TURNS, least_split: int = LEAST_SPLIT) -> DataFrame:
    """One row for each distinct prefix of (conv_id, digests, chars), with the columns COLUMNS; the root has depth 0 and no parent."""
    spark = convs.sparkSession
    key = F.unhex(F.sha2(F.array_join(F.transform("digests", lambda d: F.hex(d)), ""), 256))
    keyed = written(convs.withColumn("key", key))
    lists = keyed.groupBy("key", "digests", "chars").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    lists = written(lists.join(id_hashes(keyed), "key").drop("key"))
    total = lists.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum(F.size("digests")).alias("turns"), F.max(F.when(F.size("digests") == 0, F.col("ends"))).alias("ends")).first()
    if total.conv_id is None:
        return spark.createDataFrame([], T.StructType(NODES.fields[: len(COLUMNS)]))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.turns // bucket_turns))
    most = max(least_split, MOST_SHARES * total.turns // buckets)
    work = lists.where(F.size("digests") > 0).select("*", F.get("digests", F.lit(0)).alias("gid"), F.lit(0).alias("start"), F.lit(total.conv_id).cast("long").alias("parent"), F.lit(b"").alias("up"))
    dealt, chains = [], []
    while (parts := _split(work, most)) is not None:
        dealt.append(parts[0])
        chains.append(parts[1])
        work = parts[2]
    small = work
    for d in dealt:
        small = small.unionByName(d)
    placed = small.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    nodes = written(placed.groupBy("bucket").applyInPandas(build_bucket, NODES))
    tops = nodes.where("top")
    # From the last round up: a chain's parts are all summed up before it.
    for c in reversed(chains):
        made = written(_chain_nodes(c, tops))
        nodes, tops = nodes.unionByName(made), tops.unionByName(made.where("top"))
    roots = tops.where(F.col("depth") == 1).agg(F.count(F.lit(1)).alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(1)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = roots.select(
        F.lit(total.conv_id).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total.n).cast("long").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", F.lit(total.ends or NO_ENDS).alias("ends_sha256"),
    )
    return nodes.select(*COLUMNS).unionByName(root)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """prefix_nodes() of the rebuilt conversations of turns (conv_id, turn, role, text)."""
    return prefix_nodes(rebuilt(sequences(turns)))


_CRC_SQL = "xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(h, c)), CAST(4294967295 AS BIGINT)))"
TRIE_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY pos) AS l, {_CRC_SQL} % 6 AS h FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, list_concat(list_slice(coalesce(p.l, []), 1, c.h), list_slice(c.l, c.h + 1, len(c.l))) AS s FROM c LEFT JOIN c p ON p.conv_id = c.conv_id - c.conv_id % 100),
n AS (SELECT list_slice(s, 1, d) AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(any_value(s[d].x)), 0) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM b, unnest(range(0, len(s) + 1)) AS u(d) GROUP BY list_slice(s, 1, d), d),
k AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.p = k.p),
s AS (SELECT list_slice(p, 1, a) AS p, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM m, unnest(range(0, d + 1)) AS u(a) GROUP BY list_slice(p, 1, a))
SELECT m.conv_id, m.d AS depth, CASE WHEN m.d > 0 THEN q.conv_id END AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.p = s.p LEFT JOIN m q ON m.d > 0 AND q.p = list_slice(m.p, 1, m.d - 1)"""
