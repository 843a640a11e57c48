"""Feedback in any order and batches against the batch form, and releases that change between batches."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiguard.operators.detect import STAGES
from lexiguard.sources import files, live
from lexiguard.streaming import feedback as fb

START = datetime.datetime(2024, 1, 1)


def submissions(rng, n=300):
    rows = []
    for i in range(n):
        at = START + datetime.timedelta(minutes=rng.randrange(60 * 24 * 5), microseconds=rng.randrange(10**6))
        rows += [(i % 200, at + datetime.timedelta(minutes=rng.randrange(400)), rng.choice(["c1", "c2", None]), rng.choice(["missed", "false_positive"]), None) for _ in range(rng.randint(1, 3))]
    return rows + [(None, START, "c", "missed", "no id"), (5, None, "c", "missed", "no time")]


@pytest.mark.parametrize("seed, n_files", [(1, 1), (2, 6), (3, 6)])
def test_feedback_in_any_order_gives_the_batch_result(spark, tmp_path, seed, n_files):
    rows = submissions(random.Random(0))
    want = sorted(map(tuple, fb.settled(spark.createDataFrame(rows, fb.SCHEMA)).collect()), key=str)
    random.Random(seed).shuffle(rows)
    for k in range(n_files):
        spark.createDataFrame(rows[k::n_files], fb.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(fb.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert fb.start(fb.intake(source), f"{tmp_path}/out", f"{tmp_path}/state", availableNow=True).awaitTermination(120)
    got = fb.kept(spark, f"{tmp_path}/out")
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=str) == want
    if n_files > 1:
        written = spark.read.parquet(f"{tmp_path}/out")
        assert 0 < written.where("late").count() and written.count() < len(rows)
    # Run again from its checkpoint there is nothing to do; a batch written twice changes nothing.
    assert fb.start(fb.intake(source), f"{tmp_path}/out", f"{tmp_path}/state", availableNow=True).awaitTermination(120)
    assert fb.kept(spark, f"{tmp_path}/out").count() == len(want)
    queue = fb.queue_items(got.limit(20))
    queue.write.parquet(f"{tmp_path}/queue")
    queue = spark.read.parquet(f"{tmp_path}/queue")
    new = fb.queued(got, queue)
    assert new.count() == len(want) - 20 and fb.queued(got, queue.unionByName(new)).count() == 0
    assert fb.malformed(spark.createDataFrame(rows, fb.SCHEMA)).count() == 2


class FakeState:
    def __init__(self, watermark, value=None, timed_out=False):
        self.watermark, self.value, self.hasTimedOut, self.timeout = watermark, value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_states_are_forgotten_once_the_watermark_has_passed():
    value, hour = (START, "c", "missed", None), 3_600_000
    at = int(START.timestamp() * 1000)
    early, passed = FakeState(at + hour, value, True), FakeState(at + 3 * hour, value, True)
    assert list(fb.keep_best((1,), iter(()), early, 2 * hour)) == [] and early.exists and early.timeout
    assert list(fb.keep_best((1,), iter(()), passed, 2 * hour)) == [] and not passed.exists


@pytest.mark.parametrize("seed", range(4))
def test_a_bucket_keeps_what_its_ids_would(seed):
    rng, state, alone, us = random.Random(seed), FakeState(0), {}, lambda t: (t - START) // datetime.timedelta(microseconds=1) + int(START.replace(tzinfo=datetime.timezone.utc).timestamp()) * 10**6
    for k in range(6):
        rows = [(rng.randrange(9), START + datetime.timedelta(minutes=rng.randrange(5)), *(rng.choice([None, "a", "b", "\uffff", "\U00010000"]) for _ in range(3))) for _ in range(30)]
        parts = [pd.DataFrame([(i, us(at), *x) for i, at, *x in rows[j : j + 7]], columns=fb._HELD) for j in range(0, 30, 7)]
        state.watermark = us(START + datetime.timedelta(minutes=2)) // 1000 if k > 2 else 0
        got = {tuple(r) for out in fb.keep_best_of_bucket((0,), iter(parts), state, 3_600_000) for r in out.astype(object).where(out.notna(), None).itertuples(index=False)}
        want = set()
        for i in sorted({r[0] for r in rows}):
            one = alone.setdefault(i, FakeState(0))
            one.watermark = state.watermark
            own = pd.DataFrame([r[1:] for r in rows if r[0] == i], columns=fb.COLUMNS[1:])
            for out in fb.keep_best((i,), iter([own]), one, 3_600_000):
                want |= {(i, us(r[1].to_pydatetime()), *map(fb._plain, r[2:5]), r[5]) for r in out.itertuples(index=False, name=None)}
        assert got == want and state.timeout
    # Forgotten when the clock says so, and when more comes.
    state.watermark, state.hasTimedOut = state.watermark + 3 * 3_600_000, True
    assert list(fb.keep_best_of_bucket((0,), iter(()), state, 3_600_000)) == [] and not state.exists
    late = FakeState(state.watermark)
    assert [o["late"].all() for o in fb.keep_best_of_bucket((0,), iter(parts), late, 3_600_000)] == [True] and not late.exists


def test_python_is_not_called_for_each_id(spark, tmp_path):
    rows = [(i, START + datetime.timedelta(seconds=i), "c", "missed", None) for i in range(5 * fb.BUCKETS)]
    spark.createDataFrame(rows, fb.SCHEMA).write.parquet(f"{tmp_path}/in")
    run = fb.start(fb.intake(spark.readStream.schema(fb.SCHEMA).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state", availableNow=True)
    assert run.awaitTermination(120)
    assert 0 < run.lastProgress["stateOperators"][0]["numRowsTotal"] <= fb.BUCKETS
    assert fb.kept(spark, f"{tmp_path}/out").count() == len(rows)


def release(spark, root, version, words):
    rows = [(i, w, "word", None, w, 4, "unambiguous", "active", "open", [], [], False, [], []) for i, w in enumerate(words, 1)]
    files.write_release(spark.createDataFrame(rows, files.TERMS), f"{root}/{version}", version)


def test_no_batch_mixes_releases(spark, tmp_path, monkeypatch):
    root, out = f"{tmp_path}/releases", f"{tmp_path}/out"
    release(spark, root, "1", ["alpha"])
    release(spark, root, "2", ["beta", "gamma"])
    releases = live.Releases(spark, root)
    with pytest.raises(ValueError):
        releases.pin()
    releases.publish("1")
    for k in range(4):
        spark.createDataFrame([(10 * k + i, "alpha beta gamma") for i in range(10)], "doc_id long, text string").repartition(3).write.mode("append").parquet(f"{tmp_path}/in{k}")
    texts = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in*")

    # The release is swapped while the second batch is under way, after it has pinned its version.
    pin, seen = live.Releases.pin_batch, []

    def swapping(self, folder, batch_id):
        version = pin(self, folder, batch_id)
        seen.append(version)
        if len(seen) == 2:
            self.publish("2")
        return version

    monkeypatch.setattr(live.Releases, "pin_batch", swapping)
    live.write_live(texts, releases, out, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    rows = live.read_answers(spark, out).withColumn("n", F.get_json_object("response", "$.debug.match_count").cast("int")).withColumn("said", F.get_json_object("response", "$.release_version")).collect()
    assert len(rows) == 40 and seen == ["1", "1", "2", "2"]
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r.batch, set()).add((r.release_version, r.said, r.n))
    assert list(dict(sorted(by_batch.items())).values()) == [{("1", "1", 1)}, {("1", "1", 1)}, {("2", "2", 2)}, {("2", "2", 2)}]
    # A batch that is run again keeps its version.
    assert pin(releases, out, 0) == "1" and releases.pin() == "2"
    done = live.check_pinned(spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string"), releases, dict.fromkeys(STAGES, False))
    assert [(r.release_version, len(r.m)) for r in done.collect()] == [("2", 1)]


def test_releases_that_cannot_be_read_are_refused(spark, tmp_path):
    root = f"{tmp_path}/releases"
    release(spark, root, "1", ["alpha"])
    release(spark, root, "3", ["alpha"])
    releases = live.Releases(spark, root)
    releases.publish("1")
    assert releases.pin() == "1"
    spark.createDataFrame([('{"release_version":"3","normalizer_code_version":"0"}',)], "value string").write.mode("overwrite").text(f"{root}/3/manifest")
    with pytest.raises(ValueError):
        releases.publish("3")
    live._replace(spark, f"{root}/{live.POINTER}", "3")
    with pytest.warns(UserWarning, match="refused"):
        assert releases.pin() == "1"
