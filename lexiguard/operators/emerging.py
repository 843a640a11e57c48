"""Words that no lexicon has and that many texts suddenly use: candidates for new terms, by week.

Most words of a corpus are rare, and none of those can be a burst, so they are
not counted one by one. A first pass adds up, for each week, how many texts fall
on each of a fixed number of hashed places, in several rows of places; such
sketches add up in any order, and never say less than is true. Only words whose
places all reach the least number in some week go to the second pass, which
counts them exactly. So what is moved is the sketches and the few words that could be
reported, and what is reported is exact, with no word missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiguard.sources import files

#: Rows of places in a sketch, and places in a row.
ROWS, PLACES = 3, 1 << 16
LEAST_TEXTS = 5
LEAST_SCORE = 3.0


def _place(word: Column, row: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(row), word), F.lit(PLACES)) + row * PLACES).cast("int")


def words_of(text: Column) -> Column:
    """The distinct runs of letters and digits, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), "")


#: Weeks that a task adds up for before it hands on what it has.
HELD_WEEKS = 32


def sketches(words: DataFrame) -> DataFrame:
    """(week, place, n) for rows (week, word): how many rows fall on each place. Sketches of parts of a corpus are added by place.

    A task hands on an array of counts for each week and row of places, which
    are added up by week and row, so what moves does not grow with the words.
    """
    part = T._parse_datatype_string("week string, line int, counts binary")
    whole = T._parse_datatype_string("week string, place int, n bigint")
    rows, places = ROWS, PLACES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def taken() -> Iterator[pa.RecordBatch]:
            for week, counts in held.items():
                for i in range(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([week], pa.string()), pa.array([i], pa.int32()), pa.array([counts[i].tobytes()], pa.binary())], schema=to_arrow_schema(part))
            held.clear()

        for b in batches:
            weeks = b.column("week").dictionary_encode("encode")
            code = np.asarray(weeks.indices)
            for k, week in enumerate(weeks.dictionary.to_pylist()):
                at = np.flatnonzero(code == k)
                if week not in held:
                    if len(held) >= HELD_WEEKS:
                        yield from taken()
                    held[week] = np.zeros((rows, places), np.int64)
                for i in range(rows):
                    held[week][i] += np.bincount(np.asarray(b.column(f"place{i}"))[at] - i * places, minlength=places)
        yield from taken()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def told() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.string()), pa.array(at + key[1] * places, pa.int32()), pa.array(total[at])], schema=to_arrow_schema(whole))

        for b in batches:
            for *k, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if key:
                        yield told()
                    key, total = k, np.zeros(places, np.int64)
                total += np.frombuffer(counts, np.int64)
        if key:
            yield told()

    return _placed(words).drop("word").mapInArrow(counted, part).repartition("week", "line").sortWithinPartitions("week", "line").mapInArrow(added, whole)


def _placed(words: DataFrame) -> DataFrame:
    return words.withColumns({f"place{i}": _place(F.col("word"), i) for i in range(ROWS)})


def _bits(sketch: DataFrame, least: int) -> dict[str | None, np.ndarray]:
    """For each week which places reach `least`, packed; made by tasks that have a week each, so the driver has a row a week."""
    size = ROWS * PLACES
    schema = T._parse_datatype_string("week string, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        week, full, some = None, np.zeros(size, bool), False
        told = lambda: pa.RecordBatch.from_arrays([pa.array([week], pa.string()), pa.array([np.packbits(full).tobytes()], pa.binary())], schema=to_arrow_schema(schema))
        for b in batches:
            weeks = b.column("week").dictionary_encode("encode")
            code = np.asarray(weeks.indices)
            for k, w in enumerate(weeks.dictionary.to_pylist()):
                if some and w != week:
                    yield told()
                    full[:] = False
                week, some = w, True
                full[np.asarray(b.column("place"))[code == k]] = True
        if some:
            yield told()

    reached = sketch.where(F.col("n") >= least).select("week", "place")
    return {r.week: np.frombuffer(r.bits, np.uint8) for r in reached.repartition("week").sortWithinPartitions("week").mapInArrow(run, schema).collect()}


def possible(words: DataFrame, sketch: DataFrame, least: int) -> DataFrame:
    """Rows of words whose word the sketch does not rule out: each of its places has `least` in that week.

    What is sent to tasks is a bit for each place of each week that reaches it.
    """
    sent = words.sparkSession.sparkContext.broadcast(_bits(sketch, least))
    schema, rows, size = words.schema, ROWS, ROWS * PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = {week: np.unpackbits(b).astype(bool)[:size] for week, b in sent.value.items()}
        none = np.zeros(size, bool)
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            places = np.stack([np.asarray(b.column(f"place{i}")) for i in range(rows)])
            weeks = b.column("week").dictionary_encode("encode")
            code = np.asarray(weeks.indices)
            for k, week in enumerate(weeks.dictionary.to_pylist()):
                at = np.flatnonzero(code == k)
                keep[at] = full.get(week, none)[places[:, at]].all(axis=0)
            yield pa.RecordBatch.from_arrays([b.column(f.name).filter(pa.array(keep)) for f in schema.fields], schema=to_arrow_schema(schema))

    return _placed(words).mapInArrow(run, schema)


def _not_ruled_out(word: Column, sketch: DataFrame, least: int) -> Column:
    """Whether each of a word's places has `least` in some week: a native test of bits, so that no word goes to Python."""
    bits = np.zeros(-(-ROWS * PLACES // 64) * 64, bool)
    for week in _bits(sketch, least).values():
        bits[: ROWS * PLACES] |= np.unpackbits(week).astype(bool)[: ROWS * PLACES]
    longs = F.array(*map(F.lit, np.packbits(bits, bitorder="little").view(np.int64).tolist())).cast("array<bigint>")
    places = [_place(word, i) for i in range(ROWS)]
    reached = [F.getbit(F.get(longs, F.floor(p / 64).cast("int")), p % 64) == 1 for p in places]
    return reduce(Column.__and__, reached)


def bursts(texts: DataFrame, known: DataFrame, least: int = LEAST_TEXTS, score: float = LEAST_SCORE) -> DataFrame:
    """(week, word, n_texts, n_other, score): words that at least `least` texts of a week have and that are not known, far beyond their share in all other weeks.

    texts: at (timestamp), text; rows without a time are left out, and a null
    text has no words. known: word, in lower case. The score is how many
    standard deviations of a Poisson count n_texts lies above what the share of
    texts in other weeks, with one text more that has the word, leads to expect.
    """
    spark, folder = texts.sparkSession, files.scratch(texts.sparkSession)
    # Texts are split once; both passes read the words.
    texts.where("at IS NOT NULL").select(F.date_format(F.date_trunc("week", "at"), "yyyy-MM-dd").alias("week"), words_of(F.col("text")).alias("words")).write.parquet(f"{folder}/words")
    dated = spark.read.schema("week string, words array<string>").parquet(f"{folder}/words")
    words = dated.select("week", F.explode("words").alias("word"))
    # What other weeks have of a word is counted in the same pass.
    words.where(_not_ruled_out(F.col("word"), sketches(words), least)).groupBy("week", "word").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("week string, word string, n bigint").parquet(f"{folder}/counts")
    new = counts.where(F.col("n") >= least).withColumnRenamed("n", "n_texts").join(known.select("word").distinct(), "word", "left_anti")
    total = counts.groupBy("word").agg(F.sum("n").alias("n_all"))
    sizes = dated.groupBy("week").agg(F.count(F.lit(1)).alias("size"))
    every = sizes.agg(F.sum("size").alias("all_texts"))
    known_sizes = sizes.crossJoin(F.broadcast(every))
    rated = new.join(total, "word").join(known_sizes, "week").withColumn("n_other", F.col("n_all") - F.col("n_texts"))
    expected = F.col("size") * (F.col("n_other") + 1) / (F.col("all_texts") - F.col("size") + 1)
    return rated.withColumn("score", (F.col("n_texts") - expected) / F.sqrt(expected)).where(F.col("score") >= score).select("week", "word", "n_texts", "n_other", "score")
