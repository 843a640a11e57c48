"""Matches against tokens and against each other, in time linear in both but for sorting.

Positions of all documents of a batch are laid out one after another, so one
sort and one binary search serve them all:

* whether a token holds a match: the greatest end of the tokens that start no
  later, which is a running maximum over tokens in order of their starts;
* how many tokens an edge cuts: those that start before it less those that end
  no later;
* which matches a window touches: matches merged into disjoint spans, of which
  a window can touch no more than it has characters.

For tokens in a table of their own, rows_in_tokens() joins them in buckets of
positions, so a document of very many matches is many tasks' work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Further than any position in a document.
APART = 1 << 33
BUCKET_CHARS = 1024
MASK = "\0"
#: Rows of a batch that are worked on and handed on at a time, so that memory is that of their matches and tokens, not the batch's.
PART_ROWS = 100

MARK = "struct<inside:boolean,left_cut:int,left_known:int,right_cut:int,right_known:int>"


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def _laid_out(lists: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    """The elements of all lists, and where each one's document begins."""
    sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_pandas(), float)).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lists)) * APART, sizes)


def _numbers(elements: pa.StructArray, name: str) -> np.ndarray:
    return np.asarray(elements.field(name).fill_null(0), np.int64)


def _cut_by(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many spans start before each edge and end after it."""
    return np.searchsorted(np.sort(starts), edges, "left") - np.searchsorted(np.sort(ends), edges, "right")


def marks_of(starts: np.ndarray, ends: np.ndarray, token_starts: np.ndarray, token_ends: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each match whether it lies in a longer token, and how many tokens, and known ones, its edges cut."""
    some = token_ends > token_starts
    token_starts, token_ends, unknown = token_starts[some], token_ends[some], unknown[some]
    order = np.argsort(token_starts, kind="stable")
    sorted_starts = token_starts[order]
    furthest = np.concatenate([[-1], np.maximum.accumulate(token_ends[order])]) if len(order) else np.array([-1])
    # A longer token starts earlier and ends no earlier, or starts no later and ends later.
    inside = (furthest[np.searchsorted(sorted_starts, starts, "left")] >= ends) | (furthest[np.searchsorted(sorted_starts, starts, "right")] > ends)
    known = ~unknown
    cuts = [_cut_by(s, e, edges) for edges in (starts, ends) for s, e in ((token_starts, token_ends), (token_starts[known], token_ends[known]))]
    return inside, *cuts


def with_marks(docs: DataFrame, tokens: str, column: str = "marks") -> DataFrame:
    """docs with an array beside m: for each match what marks_of() tells of it. tokens: name of an array of (s, e, oov); null is none, and a null oov is false."""
    kind = T._parse_datatype_string(f"array<{MARK}>")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        struct = arrow.field(column).type.value_type
        for b in in_parts(batches):
            m, at = _laid_out(b.column("m"))
            t, token_at = _laid_out(b.column(tokens))
            unknown = np.asarray(t.field("oov").fill_null(False), bool)
            found = marks_of(_numbers(m, "start") + at, _numbers(m, "end") + at, _numbers(t, "s") + token_at, _numbers(t, "e") + token_at, unknown)
            made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(found, struct, strict=True)], fields=list(struct))
            sizes = np.nan_to_num(np.asarray(b.column("m").value_lengths().to_pandas(), float)).astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, made, type=arrow.field(column).type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same places, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], s[1:] > reach[:-1]])
    return s[first], reach[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(s) - 1]])]


def masked(text: str, low: int, starts: list[int], ends: list[int], at: int) -> str:
    """text, which begins at place low, with the parts of spans masked. at: the first span that ends after low."""
    out, done, high = [], 0, low + len(text)
    while at < len(starts) and starts[at] < high:
        a, b = max(starts[at] - low, 0), min(ends[at], high) - low
        out.append(text[done:a] + MASK * (b - a))
        done, at = b, at + 1
    return "".join(out) + text[done:]


def with_resolved(docs: DataFrame, column: str = "resolved") -> DataFrame:
    """docs with an array of booleans beside m: whether a safe word of an ambiguous match is in its text and the characters beside it. All key matches are masked there, but for patterns, which see the text as it is."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in in_parts(batches):
            m, at = _laid_out(b.column("m"))
            ambiguity = np.asarray(m.field("ambiguity").fill_null("unambiguous").to_pandas(), object)
            asked = np.flatnonzero((ambiguity != "unambiguous") & (np.nan_to_num(np.asarray(m.field("safe").value_lengths().to_pandas(), float)) > 0))
            out = np.zeros(len(m), bool)
            if len(asked):
                starts, ends, stage = _numbers(m, "start") + at, _numbers(m, "end") + at, _numbers(m, "stage")
                s, e = merged(starts[stage < 2], ends[stage < 2])
                some = m.take(pa.array(asked))
                left, text, right, safe = (some.field(n).to_pylist() for n in ("left", "text", "right", "safe"))
                low = starts[asked] - np.array([len(x) for x in left])
                first = np.searchsorted(e, low, "right").tolist()
                s, e = s.tolist(), e.tolist()
                for k, i in enumerate(asked.tolist()):
                    around = left[k] + text[k] + right[k]
                    if stage[i] < 2:
                        around = masked(around, int(low[k]), s, e, first[k])
                    out[i] = any(w in around for w in safe[k])
            sizes = np.nan_to_num(np.asarray(b.column("m").value_lengths().to_pandas(), float)).astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(out), type=arrow.field(column).type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def rows_in_tokens(matches: DataFrame, tokens: DataFrame, id_col: str = "doc_id", how: str = "left_semi", bucket: int = BUCKET_CHARS) -> DataFrame:
    """Rows of matches (id, start, end, ...) that lie in a longer token of the same document; with how = left_anti those that do not. tokens: id, s, e.

    A token is in every bucket that it touches, a match in that of its start,
    so the join is on equal values and a long document is many groups.
    """
    placed = tokens.select(F.col(id_col).alias("_id"), "s", "e", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.greatest("s", F.col("e") - 1) / bucket))).alias("_bucket"))
    longer = (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")) & (F.col("e") - F.col("s") > F.col("end") - F.col("start"))
    return matches.join(placed, (F.col(id_col) == F.col("_id")) & (F.floor(F.col("start") / bucket) == F.col("_bucket")) & longer, how)


def _runs_of(texts: list[str | None], pattern: re.Pattern) -> tuple[list[int], list[str], list[int]]:
    """How many runs each text has, and all runs with where they start."""
    sizes, words, starts = [], [], []
    for t in texts:
        n = len(words)
        for m in pattern.finditer(t or ""):
            words.append(m[0])
            starts.append(m.start())
        sizes.append(len(words) - n)
    return sizes, words, starts


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = "[^ ]+") -> DataFrame:
    """(id, word, s, e) of the runs of a pattern in each text, with the places of their first character and of the one after their last. No row moves between tasks."""
    compiled = re.compile(pattern)
    schema = T.StructType([docs.schema[id_col], T.StructField("word", T.StringType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            sizes, words, starts = _runs_of(b.column(1).to_pylist(), compiled)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            ends = [s + len(w) for s, w in zip(starts, words, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=to_arrow_schema(schema))

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def with_tokens(docs: DataFrame, pattern: str = "[^ ]+", text_col: str = "text", column: str = "tokens") -> DataFrame:
    """docs with an array of (s, e, oov) beside each text: the runs of a pattern, all of them known words."""
    compiled = re.compile(pattern)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T._parse_datatype_string("array<struct<s:int,e:int,oov:boolean>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema).field(column).type
        for b in in_parts(batches):
            sizes, words, starts = _runs_of(b.column(text_col).to_pylist(), compiled)
            s, n = np.array(starts, np.int32), np.array([len(w) for w in words], np.int32)
            made = pa.StructArray.from_arrays([pa.array(s), pa.array(s + n), pa.array(np.zeros(len(s), bool))], fields=list(kind.value_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, made, type=kind)], schema=to_arrow_schema(schema))

    return docs.mapInArrow(run, schema)
