"""Bursts of unknown words against counting everything."""

import datetime
import random
from collections import Counter

import pytest

from lexiguard.operators import emerging

SCHEMA = "doc_id long, text string, at timestamp, week string"


def made(rng):
    start, rows = datetime.datetime(2024, 1, 1), []
    for i in range(400):
        week = rng.randrange(6)
        words = [f"w{rng.randrange(300)}" for _ in range(10)] + (["Surge"] if week == 3 and rng.random() < 0.4 else []) + (["steady"] if rng.random() < 0.3 else []) + (["old"] if week == 2 else [])
        rows.append((i, " ".join(words) if i % 50 else None, start + datetime.timedelta(days=7 * week + rng.randrange(7), hours=5) if i % 90 else None, "x"))
    return rows


def plain(rows, known, least, limit):
    by_week, size = {}, Counter()
    for _, text, at, _ in rows:
        if at is None:
            continue
        week = (at - datetime.timedelta(days=at.weekday())).strftime("%Y-%m-%d")
        size[week] += 1
        for w in set((text or "").lower().split()):
            by_week.setdefault(w, Counter())[week] += 1
    out, total = set(), sum(size.values())
    for w, weeks in by_week.items():
        for week, n in weeks.items():
            other = sum(weeks.values()) - n
            expected = size[week] * (other + 1) / (total - size[week] + 1)
            if w not in known and n >= least and (n - expected) / expected**0.5 >= limit:
                out.add((week, w, n, other, round((n - expected) / expected**0.5, 9)))
    return out


@pytest.mark.parametrize("places", [1 << 16, 64, 1])
def test_bursts_equal_counting_everything(spark, monkeypatch, places):
    monkeypatch.setattr(emerging, "PLACES", places)
    rows = made(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([("old",), ("old",), ("w1",)], "word string")
    for least, limit in ((5, 3.0), (2, 1.0)):
        got = {(r.week, r.word, r.n_texts, r.n_other, round(r.score, 9)) for r in emerging.bursts(df, known, least, limit).collect()}
        assert got == plain(rows, {"old", "w1"}, least, limit) and any(w == "surge" for _, w, *_ in got)


def test_sketches_add_up_and_rule_most_words_out(spark):
    words = spark.createDataFrame([("a", f"w{i}") for i in range(3000)] + [("a", "often")] * 9 + [("b", "often")] * 2 + [(None, "often")], "week string, word string")
    whole = {(r.week, r.place): r.n for r in emerging.sketches(words).collect()}
    parts = Counter()
    for half in (words.where("word < 'w2'"), words.where("word >= 'w2'")):
        for r in emerging.sketches(half).collect():
            parts[r.week, r.place] += r.n
    assert dict(parts) == whole
    left = emerging.possible(words, emerging.sketches(words), 5).collect()
    assert sum(r.word == "often" for r in left) == 9 and len(left) < 30
    empty = spark.createDataFrame([], SCHEMA)
    assert emerging.bursts(empty, words.select("word")).count() == 0


def test_texts_are_split_once(spark):
    df = spark.createDataFrame(made(random.Random(2)), SCHEMA)
    plan = emerging.bursts(df, spark.createDataFrame([("old",)], "word string"))._jdf.queryExecution().toString()
    assert "split(" not in plan
