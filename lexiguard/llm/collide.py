"""Pairs that collide in an inverted index, confirmed in full, enough of them for the right components.

Members are posted under keys. Two of them are a candidate pair if they share
a key, and are kept if they share at least `least` keys and their whole
contents fit. A pair whose members are in one component already is not
compared, since a link between them changes nothing. This is done in two steps:

* Stars. Of each key's list the smallest member is the head. Every member is
  compared with the head that it meets in most lists. This joins a group of
  copies with as many comparisons as it has members; a head with many members
  is sent to several tasks.
* The rest. Lists that still hold members of different components are tied into
  clusters, and within a cluster the members of each such list are compared. A
  large cluster is cut into blocks, and each pair of blocks is one group, so no
  task holds a whole cluster, and no list or pair is left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiguard.llm.common import discard, join_spread, map_rows, written
from lexiguard.llm.components import components

#: Members that are compared with one head in one group.
STAR_MEMBERS = 256
#: 64-bit numbers in the contents of a cluster's block; a task holds two blocks at a time.
BLOCK_SIZE = 400_000

Fits = Callable[[np.ndarray, np.ndarray], bool]
_LINKS = "a long, b long"


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def _enough(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether two members share enough keys; with least over 1 their keys are aligned."""
    return least <= 1 or int((a == b).sum()) >= least


def _star(least: int, fits: Fits):  # noqa: ANN202
    def link(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows (head, part, is a member, id, keys, content) in order, to links between head and members."""
        for _, group in itertools.groupby(rows, key=lambda r: (r[0], r[1])):
            heads: list[tuple[np.ndarray, np.ndarray]] = []
            for h, _, is_member, rep, keys, body in group:
                if not is_member:
                    heads.append((_numbers(keys), _numbers(body)))
                elif any(_enough(k, _numbers(keys), least) and fits(b, _numbers(body)) for k, b in heads):
                    yield h, rep

    return link


def joined(keys: list[np.ndarray], bodies: list[np.ndarray], groups: list[int], in_lists: list[np.ndarray], left: int, least: int, fits: Fits) -> Iterator[tuple[int, int]]:
    """Pairs of places that fit and join what is not joined yet. in_lists has each place's keys that count; with left > 0 only pairs across that place."""
    _, label = np.unique(np.array(groups), return_inverse=True)
    owner = np.repeat(np.arange(len(in_lists)), [len(x) for x in in_lists])
    flat = np.concatenate(in_lists)
    order = np.lexsort((owner, flat))
    edges = np.flatnonzero(np.diff(flat[order], prepend=flat[order[:1]] - np.uint64(1))) if len(flat) else np.zeros(0, dtype=np.int64)
    lists = [x for x in np.split(owner[order], edges[1:]) if len(x) > 1 and (not left or x[0] < left <= x[-1])]

    def link(i: int, j: int) -> bool:
        if _enough(keys[i], keys[j], least) and fits(bodies[i], bodies[j]):
            a, b = min(label[i], label[j]), max(label[i], label[j])
            label[label == b] = a
            return True
        return False

    for x in lists:
        if left:
            continue
        for i in x[1:]:
            if label[i] != label[x[0]] and link(int(x[0]), int(i)):
                yield int(x[0]), int(i)
    lists_of: dict[int, list[np.ndarray]] = {}
    for x in lists:
        if (label[x] != label[x[0]]).any():
            for i in x.tolist():
                lists_of.setdefault(i, []).append(x)
    for i, own in sorted(lists_of.items()):
        if left and i < left:
            continue
        near = np.unique(np.concatenate(own))
        near = near[near < (left or i)]
        near = near[label[near] != label[i]]
        if least > 1 and len(near):
            shared = np.zeros(len(near), dtype=np.int64)
            for a in range(0, len(near), 4096):
                shared[a : a + 4096] = (np.stack([keys[j] for j in near[a : a + 4096]]) == keys[i]).sum(axis=1)
            near = near[shared >= least]
        for j in near.tolist():
            if label[i] != label[j] and link(j, i):
                yield j, i


def _cluster(least: int, fits: Fits):  # noqa: ANN202
    def link(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows (cluster, pair of blocks, side, id, component so far, keys, keys of lists, content) in order, to links."""
        for _, group in itertools.groupby(rows, key=lambda r: (r[0], r[1])):
            members = list(group)
            left = sum(m[2] < 0 for m in members)
            if len(members) > 1 and left < len(members):
                columns = [[_numbers(m[k]) for m in members] for k in (5, 7)]
                listed = [np.array(m[6], dtype=np.int64).view(np.uint64) for m in members]
                for i, j in joined(columns[0], columns[1], [m[4] for m in members], listed, left, least, fits):
                    yield members[i][3], members[j][3]

    return link


def links(members: DataFrame, lists: DataFrame, least: int, fits: Fits) -> DataFrame:
    """Links (a, b). members: rep (long; of several rows with one each counts), keys, body (binary, 64-bit numbers); lists: (key, rep) of the keys to meet in.

    Both are read several times, so they should be written tables. The result is a written one, so they may go then.
    """
    size = (F.length("body") / 8).cast("long")
    first = lists.groupBy("key").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    # Keys of one member alone are of no use from here on.
    met = written(lists.join(first.hint("shuffle_hash"), "key").select("key", "rep", "b"))
    best = met.where("rep <> b").groupBy("rep", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("rep").agg(F.max(F.struct("n", (-F.col("b")).alias("o"))).alias("m"))
    best = written(best.select("rep", (-F.col("m.o")).alias("head")))
    heads = best.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / STAR_MEMBERS).cast("int").alias("parts"))
    rows = members.join(best.join(heads, "head").hint("shuffle_hash"), "rep").select("head", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), F.lit(True).alias("is_member"), "rep", "keys", "body")
    centres = members.join(heads.hint("shuffle_hash"), F.col("rep") == F.col("head")).select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_member"), "rep", "keys", "body")
    starred = rows.unionByName(centres).repartition("head", "part").sortWithinPartitions("head", "part", "is_member")
    near = written(map_rows(starred, ["head", "part", "is_member", "rep", "keys", "body"], _star(least, fits), _LINKS))

    labelled = met.join(components(near).hint("shuffle_hash"), F.col("rep") == F.col("node"), "left").select("key", "rep", "b", F.coalesce("component", "rep").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
    rest = written(labelled.join(mixed.hint("shuffle_hash"), "key"))
    for done in (met, best):
        discard(done)
    if rest.isEmpty():
        return near
    tied = components(rest.where("rep <> b").select(F.col("rep").alias("a"), "b"))
    open_ = rest.groupBy("rep").agg(F.min("label").alias("label"), F.collect_list("key").alias("listed"))
    sized = written(open_.join(tied, F.col("rep") == F.col("node")).join(members.select("rep", size.alias("n")), "rep").select("rep", "label", "listed", "n", F.col("component").alias("cluster")))
    blocks = written(sized.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SIZE)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n_rows")))
    placed = join_spread(sized, blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    placed = members.join(placed.hint("shuffle_hash"), "rep")
    # A block meets itself and every other one: its rows go to one group for each.
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    side = F.signum(F.col("block") - F.col("other")).cast("int")
    spread = spread.select("cluster", pair.alias("pair"), side.alias("side"), "rep", "label", "keys", "listed", "body")
    ordered = spread.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "side", "rep")
    more = written(map_rows(ordered, ["cluster", "pair", "side", "rep", "label", "keys", "listed", "body"], _cluster(least, fits), _LINKS))
    for done in (rest, sized, blocks, tied):
        discard(done)
    return near.unionByName(more)
