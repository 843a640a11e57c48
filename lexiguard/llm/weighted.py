"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are pairs of neighbouring words (the last word pairs with nothing),
weighted by their counts. For coordinate k, a term of weight S has r and c from
Gamma(2, 1) and b from [0, 1), and takes t = floor(ln S / r + b) and
a = c / exp(r (t - b + 1)). The coordinate's sample is the pair (term, t) of
smallest a. Two texts agree in a coordinate with a probability of their
generalised Jaccard similarity, so the share of equal coordinates estimates
it, with a standard error of at most 0.5 / sqrt(SAMPLES).

The three numbers are drawn in an order that makes weight 1, which most terms
have, cheap. For S = 1, t is 0 and a is exponential; so a1 is drawn first. Given
it, exp(w) - 1 with w = r (1 - b) is exponential with rate a1, and r - w is
exponential with rate 1; then b = 1 - w / r and c = a1 exp(w). This is the same
joint distribution, r and c being Gamma(2, 1), but for weight 1 nothing beyond
a1 is needed, and its rank is the hash itself.

A sample (term, t) has one a, so it is kept as TAG_BITS bits of a hash of both; so unlike samples agree with a chance of 2 to
the power of -TAG_BITS.

Neighbours in descending doc_id order are found in ranges of ids, which end at
quantiles of the ids, so gaps between ids do not matter. Each range gets the
first text of the following range as a last row, so no task sees more than a
range. Null ids come last; equal ids are in order of a hash of their texts, then
of the texts, and many rows of one id, or of none, have ranges of that hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiguard.llm.common import written

SAMPLES = 64
TAG_BITS = 20
#: Least number of rows in a range of ids; beyond, ranges hold about as many rows as there are ranges.
RANGE_ROWS = 256
#: Quantiles that bound ranges, and ids that have ranges of their own because each has more than this part of all rows; ranges between two of them are of equal width.
BOUNDS = 1000
_A_BITS = 63 - TAG_BITS


def term_hashes(text: Column) -> Column:
    """Sorted hashes of all pairs of neighbouring words, repeated ones repeated."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    pairs = F.arrays_zip(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))))
    return F.sort_array(F.transform(pairs, lambda p: F.xxhash64(p["0"], p["1"])))


def _samples(h: Column, log_weight: Column) -> list[Column]:
    """For each coordinate a whole number whose smallest is the sample: the rank of a, then bits of the term.

    With b = 1 - w / r, the formulas become t = floor((ln S - w) / r) + 1 and
    a = a1 exp(-r t). The rank is 1 - exp(-a), which for weight 1 is the hash.
    """
    low = (1 << TAG_BITS) - 1
    unit = 2.0**-_A_BITS
    out = []
    for k in range(SAMPLES):
        u = F.xxhash64(h, F.lit(k))
        light = u.bitwiseAND((1 << 63) - 1 - low).bitwiseOR(h.bitwiseAND(low))
        a1 = -F.log1p(-((F.shiftrightunsigned(u, TAG_BITS).bitwiseAND((1 << _A_BITS) - 1) + F.lit(0.5)) * F.lit(unit)))
        more = F.xxhash64(u, F.lit(-1))
        e2 = -F.ln((more.bitwiseAND((1 << 30) - 1) + F.lit(0.5)) * F.lit(2.0**-30))
        e3 = -F.ln((F.shiftrightunsigned(more, 30).bitwiseAND((1 << 30) - 1) + F.lit(0.5)) * F.lit(2.0**-30))
        w = F.log1p(e2 / a1)
        r = w + e3
        a = a1 * F.exp(-r * (F.floor((log_weight - w) / r) + F.lit(1.0)))
        heavy = F.shiftleft((-F.expm1(-a) * F.lit(1.0 / unit)).cast("long"), TAG_BITS).bitwiseOR(h.bitwiseAND(low))
        # e2 >= (S - 1) a1 is ln S <= w without its logarithm; then t is 0, and a is a1.
        out.append(F.when((log_weight == 0.0) | (e2 >= F.expm1(log_weight) * a1), light).otherwise(heavy))
    return out


def _parts(base: DataFrame, n: int) -> Column:
    """A number for the range of a row (doc_id, h), growing with descending ids, nulls last, then with h."""
    size = max(RANGE_ROWS, math.isqrt(n))
    ranges = max(1, n // size)
    steps = min(BOUNDS, ranges)
    low, high, cuts = base.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / steps for i in range(1, steps)] or [0.5], 10_000)).first()
    many = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(size, n // BOUNDS)).collect()
    rows_of = {r["doc_id"]: -(-r["n"] // size) for r in many}
    if low is None:
        low = high = 0
    bounds = sorted({max(low - 1, -(2**63)), min(high + 1, 2**63 - 1), *(cuts or ()), *(i for i in rows_of if i is not None)}, reverse=True)
    own = sorted(((i, k) for i, k in rows_of.items() if i is not None), reverse=True)
    within = -(-ranges // steps)
    wide = max([within, *rows_of.values()]) + 1
    table, id_ = F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("doc_id").cast("long")
    above = F.size(F.filter(table, lambda b: b > id_))
    upper, lower = F.get(table, above - 1).cast("double"), F.get(table, above).cast("double")
    by_id = F.coalesce(F.least(F.floor((upper - id_.cast("double")) / (upper - lower) * F.lit(within)), F.lit(within - 1)), F.lit(0)).cast("long")
    share = F.shiftrightunsigned("h", 1).cast("double") / F.lit(2.0**63)
    by_hash = lambda k: F.least(F.floor(share * F.lit(k)), F.lit(k - 1)).cast("long")
    part = above.cast("long") * 2 * wide + by_id
    if own:
        ids, ks = F.array(*(F.lit(i).cast("long") for i, _ in own)), F.array(*(F.lit(k) for _, k in own))
        at = F.array_position(ids, F.col("doc_id").cast("long"))
        part = F.when(at > 0, (above.cast("long") * 2 + 1) * wide + F.least(F.floor(share * F.get(ks, (at - 1).cast("int"))), F.get(ks, (at - 1).cast("int")) - 1).cast("long")).otherwise(part)
    return F.when(F.col("doc_id").isNull(), F.lit((len(bounds) + 1) * 2 * wide).cast("long") + by_hash(rows_of.get(None, 1))).otherwise(part)


def _with_next(docs: DataFrame) -> DataFrame:
    """part, at (place in it), doc_id, t, n, and of the following document next_t, next_part, next_at."""
    # Upper bits of the hash are compared as a number without sign.
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    part = _parts(base, int(base.agg(F.count(F.lit(1))).first()[0]))
    place = F.shiftrightunsigned("h", 1)
    rows = base.select(part.alias("part"), "doc_id", place.alias("h"), "t", F.lit(False).alias("guest"), F.lit(None).cast("long").alias("home"))
    first = rows.groupBy("part").agg(F.min(F.struct((-F.col("doc_id")).alias("o"), "h", "t")).alias("head"))
    # Only the ranges' numbers pass one task, about the square root of the number of rows.
    in_order = Window.orderBy("part")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chain = rows.select("part").distinct().select("part", F.coalesce(F.lead("part").over(in_order), F.first("part").over(everything)).alias("home"))
    guests = chain.join(first.withColumnRenamed("part", "home"), "home").select("part", (-F.col("head.o")).alias("doc_id"), F.col("head.h").alias("h"), F.col("head.t").alias("t"), F.lit(True).alias("guest"), "home")
    w = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "h", "t")
    placed = rows.unionByName(guests).withColumn("at", F.row_number().over(w)).withColumn("next", F.lead(F.struct("t", "home")).over(w)).where("NOT guest")
    return placed.select("part", "at", "doc_id", "t", F.length("t").alias("n"), F.col("next.t").alias("next_t"), F.coalesce("next.home", "part").alias("next_part"), F.when(F.col("next.home").isNotNull(), F.lit(1)).otherwise(F.col("at") + 1).alias("next_at"))


def _likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike, and one of them is unlike all others."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SAMPLES))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(equal)


def _fingerprint(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda x: F.lpad(F.lower(F.hex(x)), TAG_BITS // 4, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. A text without words has the empty fingerprint, which
    is alike to itself only. With a single document, the next one is itself. An
    empty table gives no rows; further columns are not read.
    """
    placed = _with_next(docs)
    cut = F.floor(F.col("n") / 3).cast("int")
    both = placed.withColumn("edited", F.concat(F.substring("t", F.lit(1), F.col("n") - cut), F.substring("next_t", F.lit(1), cut)))
    sha = F.sha2("edited", 256)
    pieces = {f"sha{i}": F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(5)}
    carried = ["doc_id", "n", "next_part", "next_at", *pieces]
    texts = both.withColumns(pieces).select("part", "at", *carried, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("x")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("x")))).alias("v"))
    sorted_ = texts.select("part", "at", *carried, "v.which", term_hashes(F.col("v.x")).alias("s"))
    starts = F.when(F.size("s") == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))))
    runs = sorted_.withColumn("starts", starts)
    terms = F.transform("starts", lambda p, j: F.struct(F.get("s", p).alias("h"), (F.coalesce(F.get("starts", j + 1), F.size("s")) - p).alias("c")))
    rows = runs.select("part", "at", *carried, "which", F.explode_outer(terms).alias("term")).select("part", "at", *carried, "which", F.col("term.h").alias("h"), F.when(F.col("term.c") == 1, F.lit(0.0)).otherwise(F.ln("term.c")).alias("lw"))
    mins = [F.min(x).alias(f"m{k}") for k, x in enumerate(_samples(F.col("h"), F.col("lw")))]
    # Rows are still dealt out by part, so neither aggregation moves them.
    signed = rows.groupBy("part", "at", "which").agg(*(F.max(c).alias(c) for c in carried), *mins)
    low = (1 << TAG_BITS) - 1
    tags = F.when(F.col("m0").isNull(), F.array().cast("array<int>")).otherwise(F.array(*(F.xxhash64(f"m{k}").bitwiseAND(low).cast("int") for k in range(SAMPLES))))
    named = signed.select("part", "at", "which", *carried, tags.alias("tags"))
    one = named.groupBy("part", "at").agg(*(F.max(c).alias(c) for c in carried), F.max(F.when(F.col("which") == 0, F.col("tags"))).alias("own"), F.max(F.when(F.col("which") == 1, F.col("tags"))).alias("edit"))
    # A row a document, without texts: computed once for both sides of the join.
    one = written(one)
    nexts = one.select(F.col("part").alias("p"), F.col("at").alias("a"), F.col("own").alias("following"))
    out = one.join(nexts, (F.col("next_part") == F.col("p")) & (F.col("next_at") == F.col("a")))
    hexes = F.concat(*(F.lpad(F.lower(F.hex(f"sha{i}")), 15 if i < 4 else 4, "0") for i in range(5)))
    return out.select("doc_id", F.col("n").cast("long").alias("n_chars"), hexes.alias("edited_sha256"), _fingerprint(F.col("own")).alias("fingerprint"), _fingerprint(F.col("edit")).alias("edited_fingerprint"), _likeness(F.col("own"), F.col("edit")).alias("near_edited"), _likeness(F.col("own"), F.col("following")).alias("near_next"))
