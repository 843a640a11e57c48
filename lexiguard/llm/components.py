"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiguard.llm.common import discard, map_rows, written

#: Edges up to which all is one task's work, with nothing to shuffle; more are dealt out. Both give the same.
FEW_EDGES = 200_000
#: Nodes that a task joins before it hands on what it has.
MOST_NODES = 200_000


def _forest(rows: Iterator[tuple], most: int = MOST_NODES) -> Iterator[tuple]:
    """Edges (a, b) to fewer that join the same nodes: (u, v) with v the smallest node joined so far, and smaller than u."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := top[x]) != x:
            top[x] = x = top[y]
        return x

    for a, b in rows:
        top.setdefault(a, a)
        top.setdefault(b, b)
        a, b = root(a), root(b)
        if a != b:
            top[max(a, b)] = min(a, b)
        if len(top) >= most:
            yield from ((u, v) for u in top if (v := root(u)) != u)
            top.clear()
    yield from ((u, v) for u in top if (v := root(u)) != u)


def _whole(rows: Iterator[tuple]) -> Iterator[tuple]:
    """All edges, few, to (node, component)."""
    tops = dict(_forest(rows, sys.maxsize))
    yield from tops.items()
    yield from ((v, v) for v in set(tops.values()))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that it reaches, itself included.

    Every task first joins what its own edges join. If few edges are left, one
    task joins those. More go through two steps in turn until nothing changes:
    every node links its larger neighbours to its smallest one, then its smaller
    neighbours to the smallest. Each round is two aggregations, and every
    round's edges are written to the shared folder. Edges never outnumber those
    given.
    """
    now = written(map_rows(edges.where("a <> b"), ["a", "b"], _forest, "u long, v long"))
    mark, n = None, int(now.count())
    if n <= FEW_EDGES:
        joined = written(map_rows(now.coalesce(1), ["u", "v"], _whole, "node long, component long"))
        discard(now)
        return joined
    while n:
        given = now
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = written(small)
        # The sum of hashes tells whether the set of edges has changed.
        stamp = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(F.lit(7), "v", "u")), F.lit(0))).first())
        discard(given)
        if stamp == mark:
            break
        mark, n = stamp, int(stamp[0])
    tops = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = written(tops.unionByName(roots.join(tops.select("node"), "node", "left_anti")))
    discard(now)
    return out
