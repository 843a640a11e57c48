"""MinHash near-duplicates by an inverted join on signature coordinates, confirmed on full shingle sets.

Documents are sets of five-word shingles. Documents with equal sets fall
together first, so copies cost nothing further. Each class posts itself under
every (coordinate, value) of its signature of SIGNATURE minima, and collisions
of two classes are counted. Pairs with LEAST_MATCHES or more are kept; classes
whose likeness reaches the limit have fewer with a chance of about one in a
million at the limit itself. So:

* prefix merging: coordinates whose value no other class has cannot be among
  the matches; a class with fewer than LEAST_MATCHES others leaves. Of the rest
  only the SIGNATURE - LEAST_MATCHES + 1 rarest are merged: two classes with
  enough matches meet in one of those.
* skip merging: the longer lists are skipped; once a pair has met, its
  collisions in all coordinates are counted on the signatures.

Kept pairs are confirmed with 100 * common >= percent * united on full sets of
64-bit shingle hashes. A large group of near copies is joined by its heads, and
only pairs of different components are compared after that: see collide.py.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiguard.llm import collide
from lexiguard.llm.common import discard, join_spread, map_rows, sifted, written
from lexiguard.llm.components import components

SHINGLE = 5
SIGNATURE = 48
LEAST_MATCHES = 28
PERCENT = 85
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.isin(np.arange(256), [*range(9, 14), 32])
#: Words of more bytes are hashed one by one.
LONG_WORD = 32
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63 - 1, size=(2, SIGNATURE), dtype=np.uint64)
_MULTIPLY = (_SEEDS[0] >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_ADD = (_SEEDS[1] >> np.uint64(31)).astype(np.uint32)


def _word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a lower-cased text. Eight bytes of all words are mixed in at a time, so nothing is kept from word to word."""
    padded = b" " + text + b" " * 8
    raw = np.frombuffer(padded, dtype=np.uint8)
    blank = _BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(raw) - 7, dtype="<u8", buffer=padded, strides=(1,))
    h = sizes.astype(np.uint64) * _ODD
    at, left = np.arange(len(starts)), sizes
    for done in range(0, LONG_WORD, 8):
        v = eights[starts[at] + done] & _FIRST_BYTES[np.minimum(left, 8)]
        v ^= h[at]
        v ^= v >> np.uint64(32)
        v *= _ODD
        v ^= v >> np.uint64(29)
        h[at] = v
        at = at[left > 8]
        if not len(at):
            break
        left = sizes[at] - done - 8
    for i in at.tolist():
        h[i] = xxhash.xxh64_intdigest(padded[starts[i] : starts[i] + sizes[i]])
    return h


def shingle_hashes(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes; A-Z are lower-cased, and words end at blanks and ASCII controls from tab to return."""
    # UTF-8 has these six characters in no longer sequence.
    lowered = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    h = _word_hashes(lowered)
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    if len(h) < SHINGLE:
        # bytes.split() without arguments splits at exactly these characters.
        return np.array([xxhash.xxh64_intdigest(b" ".join(lowered.split()), len(h))], dtype=np.uint64)
    n = len(h) - SHINGLE + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        mixed ^= h[i : i + n]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of SIGNATURE 32-bit hash functions over the upper halves of the set."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 512):
        part = _MULTIPLY[:, None] * upper[None, at : at + 512]
        part += _ADD[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _sets(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text in rows:
        h = shingle_hashes(text)
        if len(h):
            d = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
            yield doc_id, len(h), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), signature(h).astype("<u4").tobytes()
        else:
            yield doc_id, 0, None, None, None


def _keys(sig: Column) -> Column:
    """A 64-bit key for each coordinate of a signature and its value."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring(sig, 4 * i + 1, 4)) for i in range(SIGNATURE)])


def _alike(percent: int):  # noqa: ANN202
    def fits(a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two sorted sets are alike enough."""
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        both = np.sort(np.concatenate([a, b]))
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * common >= percent * (len(a) + len(b) - common)

    return fits


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links. Texts without
    words, and null ones, have no shingles and are linked with nothing; with
    fewer than five words the whole sequence is the one shingle. Rows with the
    same doc_id are one document for linking; each keeps its row. Rows with a
    null doc_id are linked with nothing and have a null component. Further
    columns are not read; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    rows = written(map_rows(docs, ["doc_id", "text"], _sets, "doc_id long, n_shingles long, s1 long, s2 long, sig binary"))
    known = rows.where("doc_id IS NOT NULL AND s1 IS NOT NULL")
    classes = written(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("n_rows")))
    links = _links(classes, docs, percent)
    # Rows with the same id but other texts tie their classes together.
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    # Within a component only its classes matter; equal sets share their representative.
    tied = known.join(repeated, "doc_id").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(links.unionByName(tied))
    of_class = classes.join(joined, F.col("rep") == F.col("node"), "left").select("s1", F.struct("s2", F.coalesce("component", "rep").alias("component")).alias("c"), "n_rows")
    # A class is told by both halves of its digest; the first is the key, and of the few classes that share it the right one is picked.
    picked = written(of_class.groupBy("s1").agg(F.collect_list("c").alias("of"), F.sum("n_rows").alias("n_rows")))
    found = join_spread(rows.where("s1 IS NOT NULL"), picked, "s1", how="left").withColumn("class_component", F.get(F.filter("of", lambda c: c.s2 == F.col("s2")), F.lit(0)).component)
    bare = rows.where("s1 IS NULL").withColumn("class_component", F.lit(None).cast("long"))
    out = found.select("doc_id", "n_shingles", "class_component").unionByName(bare.select("doc_id", "n_shingles", "class_component"))
    component = F.coalesce("class_component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between class representatives, enough of them for the right components."""
    posts = classes.select("rep", F.explode(_keys(F.col("sig"))).alias("key"))
    common = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posts.join(common.hint("shuffle_hash"), "key")
    # Coordinates that nobody shares are the rarest ones, so they fill the prefix first.
    prefix = SIGNATURE - LEAST_MATCHES + 1
    by_rarity = Window.partitionBy("rep").orderBy("n", "key")
    ranked = met.withColumn("rank", F.row_number().over(by_rarity)).withColumn("n_met", F.count(F.lit(1)).over(Window.partitionBy("rep")))
    lists = written(ranked.where((F.col("n_met") >= LEAST_MATCHES) & (F.col("rank") <= prefix - (SIGNATURE - F.col("n_met")))).select("key", "rep"))
    # Lists whose other members have left are of no use.
    several = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    wanted = written(lists.join(several, "key").select("rep").distinct())

    def sets(rows: Iterator[tuple]) -> Iterator[tuple]:
        for rep, text in rows:
            h = shingle_hashes(text)
            yield rep, signature(h).astype("<u8").tobytes(), h.tobytes()

    # Hashing the small side spares sorting whole texts. Of the texts with the class's id one is of the class, or else any of them is.
    texts = sifted(docs, "doc_id", wanted, "rep").join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("rep"))
    members = written(map_rows(texts, ["rep", "text"], sets, "rep long, keys binary, body binary"))
    links = collide.links(members, lists, LEAST_MATCHES, _alike(percent))
    for done in (lists, members, wanted):
        discard(done)
    return links


def keep_one_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest id; columns stay.

    Rows with the same id stay or go together; a row whose id is null stays.
    """
    gone = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("_lexiguard_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("_lexiguard_gone"), "left_anti")
