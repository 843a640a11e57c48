"""Sweeps over matches and tokens against looking at all of them, and their time."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiguard.operators import detect, intervals
from lexiguard.operators.detect import Entry, Lexicon
from lexiguard.plans.check import check_documents

DOCS = "doc_id long, text string, tokens array<struct<s:int,e:int,oov:boolean>>, base_tokens array<struct<s:int,e:int,oov:boolean>>, marks int"


def test_marks_equal_looking_at_all():
    rng = random.Random(6)
    for _ in range(200):
        span = lambda: (a := rng.randrange(30), a + rng.randrange(8))
        m, t = [span() for _ in range(rng.randrange(8))], [(*span(), rng.random() < 0.5) for _ in range(rng.randrange(8))]
        col = lambda x, i: np.array([r[i] for r in x], np.int64)
        got = intervals.marks_of(col(m, 0), col(m, 1), col(t, 0), col(t, 1), np.array([r[2] for r in t], bool))
        for k, (a, b) in enumerate(m):
            cut = lambda x, known: sum(s < x < e and not (known and o) for s, e, o in t)
            assert tuple(int(c[k]) for c in got) == (any(s <= a and b <= e and e - s > b - a for s, e, _ in t), cut(a, False), cut(a, True), cut(b, False), cut(b, True))


def test_merged_spans_and_masks_equal_marking_every_place():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(40))
        spans = [(a := rng.randrange(38), a + rng.randint(1, 6)) for _ in range(rng.randrange(7))]
        s, e = intervals.merged(np.array([x[0] for x in spans], np.int64), np.array([x[1] for x in spans], np.int64))
        low = rng.randrange(30)
        window = text[low : low + rng.randrange(12)]
        at = int(np.searchsorted(e, low, "right"))
        want = "".join("\0" if any(a <= low + i < b for a, b in spans) else c for i, c in enumerate(window))
        assert intervals.masked(window, low, s.tolist(), e.tolist(), at) == want


def plain_filter(text, found, tokens, base):
    """Starts and caps of matches that the token stages keep, looking at all tokens for each."""
    out = []
    hangul = lambda c: "가" <= c <= "힣"
    for start, end, kind in found:
        if kind == "word":
            if any(s <= start and end <= e and e - s > end - start for s, e, _ in tokens):
                continue
            left, right = start > 0 and hangul(text[start - 1]), end < len(text) and hangul(text[end])
            crossing = [o for s, e, o in base if (left and s < start < e) or (right and s < end < e)]
            if crossing and not all(crossing):
                continue
            out.append((start, bool(crossing)))
        else:
            out.append((start, False))
    return out


def test_token_stages_equal_looking_at_all(spark):
    rng = random.Random(9)
    lexicon = Lexicon((Entry(1, "바다", (("ㅂㅏㄷㅏ", None),)), Entry(2, "12", (("12", None),), term_kind="number")))
    rows = []
    for i in range(150):
        text = "".join(rng.choice(["바다", "가", "나", " ", "12"]) for _ in range(12))
        cuts = lambda: [(a := rng.randrange(len(text)), min(len(text), a + rng.randint(1, 6)), rng.random() < 0.5) for _ in range(rng.randrange(6))]
        rows.append((i, text, cuts() if i % 10 else None, cuts() if i % 7 else None, 5))
    df = spark.createDataFrame(rows, DOCS).repartition(3).drop("marks")
    stages = dict.fromkeys(detect.STAGES, False) | {"morpheme_boundary": True}
    got = {r.doc_id: [(x.start, "oov_boundary_kept" in x.flags) for x in sorted(r.m, key=lambda x: (x.start, x.seq))] for r in check_documents(df, lexicon, stages).collect()}
    for i, text, tokens, base, _ in rows:
        found = [(k, k + 2, kind) for k in range(len(text) - 1) for word, kind in (("바다", "word"), ("12", "number")) if text[k : k + 2] == word]
        assert got[i] == plain_filter(text, found, tokens or [], base or []), text


@pytest.mark.parametrize("stage", ["tokens", "context"])
def test_one_document_of_many_matches_takes_linear_time(spark, stage):
    lexicon = Lexicon((Entry(1, "ab", (("ab", None),), ambiguity="ambiguous", safe_contexts=("zz",)),))
    stages = dict.fromkeys(detect.STAGES, False) | {"morpheme_boundary": stage == "tokens", "safe_context": stage == "context"}

    def seconds(n):
        tokens = [(3 * i, 3 * i + 2 + i % 2, False) for i in range(n)]
        df = spark.createDataFrame([(1, "ab " * n, tokens, tokens, 0)], DOCS).drop("marks")
        began = time.perf_counter()
        kept = len(check_documents(df, lexicon, stages).first().m)
        assert kept == (n - n // 2 if stage == "tokens" else n)
        return time.perf_counter() - began

    seconds(100)
    few, many = min(seconds(10_000) for _ in range(2)), seconds(40_000)
    assert many < 8 * few + 1


def test_rows_in_tokens_equal_looking_at_all(spark):
    rng = random.Random(10)
    m = [(rng.choice([1, 2, None]), a := rng.randrange(90), a + rng.randint(1, 5), i) for i in range(400)]
    t = [(rng.choice([1, 2, None]), a := rng.randrange(90), a + rng.randint(1, 30)) for _ in range(25)]
    matches, tokens = spark.createDataFrame(m, "doc_id long, start long, end long, k int"), spark.createDataFrame(t, "doc_id long, s long, e long")
    inside = {k for d, a, b, k in m if any(d is not None and d == x and s <= a and b <= e and e - s > b - a for x, s, e in t)}
    for width in (1, 7, 1024):
        assert {r.k for r in intervals.rows_in_tokens(matches, tokens, bucket=width).collect()} == inside
        assert {r.k for r in intervals.rows_in_tokens(matches, tokens, how="left_anti", bucket=width).collect()} == set(range(400)) - inside
    text = " a bc  d é한 "
    assert {(r.s, r.e) for r in intervals.token_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()} == {(1, 2), (3, 5), (7, 8), (9, 11)}


def test_memory_is_that_of_a_part(spark, monkeypatch):
    """What is laid out at a time does not grow with a batch."""
    marks_of = intervals.marks_of

    def bounded(starts, ends, token_starts, *rest):
        assert len(token_starts) <= 10_000
        return marks_of(starts, ends, token_starts, *rest)

    monkeypatch.setattr(intervals, "marks_of", bounded)
    docs = intervals.with_tokens(spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 50).alias("text")).coalesce(1)).withColumn("m", F.expr("array(struct(1 AS start, 2 AS end))"))
    assert intervals.with_marks(docs, "tokens").where("marks[0].inside = false").count() == 2000 - intervals.with_marks(docs, "tokens").where("marks[0].inside").count()
    monkeypatch.setattr(intervals, "PART_ROWS", 2000)
    with pytest.raises(Exception, match="AssertionError"):
        intervals.with_marks(docs, "tokens").count()
