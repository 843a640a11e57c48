"""Benchmark decontamination: item-sized windows of documents whose SimHash lies near an item's, verified exactly.

Windows have an item's number of words and start at every word. Fingerprints
are 64-bit SimHashes of words, cut into BLOCKS blocks. Two fingerprints within
RADIUS bits differ by at most RADIUS // BLOCKS bits in at least one block, so
tables of all block values that near an item's find every item within the
radius. A candidate counts if the weighted Jaccard similarity of five-word
shingles of window and item is at least THRESHOLD; a shingle of the item weighs
the logarithm of the inverse share of benchmark items that have it, plus one,
and what only the window has weighs as much as a shingle of no item.

A window without a shingle of any item has similarity 0, so stretches of text
that are further than an item's length from every such shingle are passed over;
this drops no match. In the other stretches every window gets a fingerprint.

Texts are lower-cased in A-Z and cut into words as elsewhere. An item of less
than five words is one shingle. Null and empty texts or items match nothing.
A document shorter than an item is compared as a whole. Repeated items count
once; repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiguard.llm.common import filter_rows, map_rows, shipped

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS = 4
#: Windows that get fingerprints at a time, which bounds memory for very long texts.
STRETCH = 4096
#: Bytes of items up to which they are sent to all executors; a larger benchmark is matched in parts of that size.
PART_BYTES = 8_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    # bytes.split() without arguments splits at blanks and the controls from tab to return.
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles_of(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def word_bits(word: bytes) -> np.ndarray:
    raw = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), dtype=np.uint8)
    return np.unpackbits(raw).astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 sums to fingerprints; a sum of 0 is bit 0."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def near_values(radius: int) -> np.ndarray:
    """The 16-bit numbers with at most so many bits set."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in itertools.combinations(range(16), n)], dtype=np.uint16)


def _runs(codes: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of that many codes; runs with a code of 0 get 0."""
    n = len(codes) - length + 1
    mixed = np.zeros(n, dtype=np.uint64)
    known = np.ones(n, dtype=bool)
    for i in range(length):
        part = codes[i : i + n]
        mixed = (mixed ^ part) * _MIX
        mixed ^= mixed >> np.uint64(29)
        known &= part != 0
    return np.where(known, mixed, np.uint64(0))


class Items:
    """Items (id, text) with the shares of their shingles: counts gives how many of the benchmark's n items have each."""

    def __init__(self, rows: list[tuple[int, str]], counts: dict[bytes, int], n: int) -> None:
        kept = [(i, w) for i, t in rows if (w := words_of(t))]
        self.ids = [i for i, _ in kept]
        self.words = np.array([len(w) for _, w in kept], dtype=np.int64)
        self.shingles = [Counter(shingles_of(w)) for _, w in kept]
        self.weight = {x: math.log((1 + n) / (1 + counts[x])) + 1 for s in self.shingles for x in s}
        #: What a shingle weighs that the item at hand does not have.
        self.other = math.log(1 + n) + 1
        self.prints = np.array([pack(sum(word_bits(x) for x in w)[None, :])[0] for _, w in kept], dtype=np.uint64)
        #: A number from 1 for each word, and all shingles as numbers by their length.
        self.code: dict[bytes, int] = {}
        for _, w in kept:
            for x in w:
                self.code.setdefault(x, len(self.code) + 1)
        self.known: dict[int, np.ndarray] = {}
        for _, w in kept:
            codes = np.array([self.code[x] for x in w], dtype=np.uint64)
            length = min(SHINGLE, len(w))
            self.known[length] = np.union1d(self.known.get(length, np.zeros(0, dtype=np.uint64)), _runs(codes, length))

    def similarity(self, item: int, window: Counter) -> float:
        a = self.shingles[item]
        own = [(self.weight[x], n, window[x]) for x, n in a.items()]
        both = sum(w * min(n, m) for w, n, m in own)
        total = sum(w * max(n, m) for w, n, m in own) + self.other * sum(m for x, m in window.items() if x not in a)
        return both / total


class Matcher:
    def __init__(self, items: Items, radius: int, threshold: float) -> None:
        self.items, self.radius, self.threshold = items, radius, threshold
        near = near_values(radius // BLOCKS)
        #: By size: places of items, their fingerprints, and for each block which values are near one of theirs.
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = {}
        for size in np.unique(items.words).tolist():
            at = np.flatnonzero(items.words == size)
            prints = items.prints[at]
            values = prints.view(np.uint16).reshape(-1, BLOCKS)
            tables = []
            for b in range(BLOCKS):
                t = np.zeros(65_536, dtype=bool)
                t[(values[:, b, None] ^ near[None, :]).ravel()] = True
                tables.append(np.packbits(t))
            self.sizes[size] = (at, prints, tables)
        self.longest = max(self.sizes, default=0)

    def near(self, prints: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of items of that size within the radius, found through near blocks."""
        at, own, tables = self.sizes[size]
        values = prints.view(np.uint16).reshape(-1, BLOCKS)
        some = np.zeros(len(prints), dtype=bool)
        for b, t in enumerate(tables):
            v = values[:, b]
            some |= (t[v >> 3] >> (7 - (v & 7)).astype(np.uint8)) & 1 == 1
        windows = np.flatnonzero(some)
        step = max(1, 1_000_000 // len(own))
        for a in range(0, len(windows), step):
            part = windows[a : a + step]
            d = np.bitwise_count(prints[part, None] ^ own[None, :])
            for i, j in zip(*np.nonzero(d <= self.radius), strict=True):
                yield int(part[i]), int(at[j]), int(d[i, j])

    def _stretches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Ranges of words, in order and apart, outside which no window has a shingle of an item."""
        codes = np.fromiter(map(self.items.code.get, words, itertools.repeat(0)), dtype=np.uint64, count=len(words))
        places = []
        for length, known in self.items.known.items():
            if len(words) >= length:
                runs = _runs(codes, length)
                some = np.flatnonzero(runs)
                # known is sorted; looking up few numbers in it is cheaper than sorting both.
                at = np.searchsorted(known, runs[some])
                places.append(some[known[np.minimum(at, len(known) - 1)] == runs[some]])
        hits = np.unique(np.concatenate(places)) if places else np.zeros(0, dtype=np.int64)
        if not len(hits):
            return
        reach = self.longest + SHINGLE
        first = np.flatnonzero(np.diff(hits, prepend=-3 * reach) > 2 * reach)
        for a, b in zip(hits[first], np.append(hits[first[1:] - 1], hits[-1]), strict=True):
            yield max(0, int(a) - reach), min(len(words), int(b) + reach)

    def matches(self, text: str | None) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, distance) of each item's best window, the first of equals."""
        words = words_of(text)
        best: dict[int, tuple[int, int, int, float, int]] = {}
        for low, high in self._stretches(words) if self.sizes else ():
            for at in range(low, high, STRETCH):
                self._search(words, at, min(at + STRETCH, high), best)
        return sorted(best.values())

    def _search(self, words: list[bytes], low: int, high: int, best: dict) -> None:
        """Windows that start in a range of words."""
        n = len(words)
        part = words[low : min(n, high + self.longest)]
        rows: dict[bytes, int] = {}
        coded = np.array([rows.setdefault(w, len(rows)) for w in part])
        bits = np.array([word_bits(w) for w in rows])
        sums = np.zeros((len(part) + 1, 64), dtype=np.int32)
        np.cumsum(bits[coded], axis=0, out=sums[1:])
        held: dict[tuple[int, int], Counter] = {}
        for size in self.sizes:
            span = min(size, n)
            count = min(high, n - span + 1) - low
            if count <= 0:
                continue
            prints = pack(sums[span : span + count] - sums[:count])
            for a, i, d in self.near(prints, size):
                start = low + a
                window = held.get((start, span)) or held.setdefault((start, span), Counter(shingles_of(words[start : start + span])))
                s = self.items.similarity(i, window)
                if s >= self.threshold and (i not in best or s > best[i][3]):
                    best[i] = (self.items.ids[i], start, span, s, d)


def _exploded(rows: Iterator[tuple]) -> Iterator[tuple]:
    for item_id, text in rows:
        for x in set(shingles_of(words_of(text))):
            yield item_id, text, x


def matchers(benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> Iterator[Matcher]:
    """A matcher for each part of the benchmark. Shingles are counted over all items, so no part depends on how they are cut."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    shingles = map_rows(items, ["item_id", "text"], _exploded, "item_id long, text string, shingle binary")
    n = int(shingles.select("item_id", "text").distinct().count())
    counts = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    counted = shingles.join(counts, "shingle").groupBy("item_id", "text").agg(F.collect_list(F.struct("shingle", "n")).alias("counts"))
    part: list[tuple[int, str]] = []
    of: dict[bytes, int] = {}
    size = 0

    for r in counted.orderBy("item_id", "text").toLocalIterator():
        if size >= PART_BYTES:
            yield Matcher(Items(part, of, n), radius, threshold)
            part, of, size = [], {}, 0
        part.append((int(r[0]), r[1]))
        of.update((bytes(x), int(c)) for x, c in r[2])
        size += len(r[1])
    if part:
        yield Matcher(Items(part, of, n), radius, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity, distance): each document's items with their best windows.

    Documents without a match have no row. A benchmark of any size is matched
    part by part, each in one pass over docs.
    """
    out = None
    for matcher in matchers(benchmark, radius, threshold):
        load = shipped(docs.sparkSession, matcher)

        def run(batch: Iterator[tuple], load=load) -> Iterator[tuple]:  # noqa: ANN001
            matcher = load()
            for doc_id, text in batch:
                for m in matcher.matches(text):
                    yield doc_id, *m

        found = map_rows(docs, ["doc_id", "text"], run, "doc_id long, item_id long, first_word int, n_words int, similarity double, distance int")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.select("doc_id", *(F.lit(0).cast(t).alias(c) for c, t in (("item_id", "long"), ("first_word", "int"), ("n_words", "int"), ("similarity", "double"), ("distance", "int")))).limit(0)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; columns stay, and no row moves to another task."""
    for matcher in matchers(benchmark):
        load = shipped(docs.sparkSession, matcher)
        docs = filter_rows(docs, "text", lambda load=load: lambda text, m=load(): not m.matches(text))
    return docs
