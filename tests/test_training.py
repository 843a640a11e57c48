"""Training against NumPy, in one run and in two, with few tasks and with many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiguard.operators import classifier

WORDS = ["bad", "mean", "kind", "warm", "the", "sea", "sky", "비판", "\"the\"", "a", "역겹"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = []
    for i in range(120):
        label = int(rng.random() < 0.3)
        text = " ".join(rng.choice(WORDS[:2] if label and rng.random() < 0.5 else WORDS) for _ in range(rng.randint(0, 12)))
        made.append((i, text if i else "x", rng.choice(["the", "sea"]), label))
    return spark.createDataFrame(made, "id long, text string, surface string, label int").repartition(5)


def table_of(feats):
    out = {}
    for r in feats.collect():
        out.setdefault(r.id, {})[r.idx] = r.val
    return out


def by_numpy(feats, labels, rounds, rate=0.5, l2=1e-4):
    ids = sorted(feats)
    used = sorted({i for f in feats.values() for i in f})
    x = np.array([[feats[i].get(j, 0.0) for j in used] for i in ids])
    y = np.array([labels[i] for i in ids], float)
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w, b = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight / n
        w, b = w - rate * (x.T @ e + l2 * w), b - rate * e.sum()
    return dict(zip(used, w, strict=True)), b


def test_blocks_are_the_features(spark, rows):
    feats = table_of(classifier.features(rows))
    plain = {r.id: dict(zip(*classifier._row_features(r.text, r.surface), strict=True)) for r in rows.collect()}
    assert {i: {int(k): v for k, v in f.items()} for i, f in plain.items()} == feats
    assert classifier.text_blocks(rows).count() == 120
    odd = spark.createDataFrame([(None, "a", 1), ("t", None, 0), ("t", "a", None), ("", "", 1)], "text string, surface string, label int")
    assert classifier.text_blocks(odd).count() == 2


@pytest.mark.parametrize("partials", [32, 2])
def test_weights_equal_numpy(spark, rows, monkeypatch, tmp_path, partials):
    monkeypatch.setattr(classifier, "MOST_PARTIALS", partials)
    feats, labels = classifier.features(rows), {r.id: r.label for r in rows.collect()}
    want, bias = by_numpy(table_of(feats), labels, 12)
    for model in (classifier.fit_texts(rows, 12, folder=f"{tmp_path}/a"), classifier.fit(feats, rows.select("id", "label"), 12, folder=f"{tmp_path}/b")):
        got = {r.idx: r.w for r in model.weights.collect()}
        assert abs(model.bias - bias) < 1e-9
        assert all(abs(got.get(i, 0.0) - v) < 1e-9 for i, v in want.items()) and set(got) <= set(want)


def test_a_run_that_was_cut_short_goes_on(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(classifier, "SAVED_ROUNDS", 3)
    whole = classifier.fit_texts(rows, 8, folder=f"{tmp_path}/whole")
    gradient, calls = classifier._gradient, []

    def failing(*a):
        calls.append(1)
        if len(calls) == 6:
            raise RuntimeError("lost")
        return gradient(*a)

    monkeypatch.setattr(classifier, "_gradient", failing)
    with pytest.raises(RuntimeError):
        classifier.fit_texts(rows, 8, folder=f"{tmp_path}/cut")
    again = classifier.fit_texts(rows.limit(0), 8, folder=f"{tmp_path}/cut")
    # Five rounds, the sixth that failed, and those after the third, which was saved.
    assert len(calls) == 6 + 5 and again.bias == whole.bias
    assert sorted(map(tuple, again.weights.collect())) == sorted(map(tuple, whole.weights.collect()))


def test_no_rows_and_one_class(spark, rows, tmp_path):
    none = classifier.fit_texts(rows.limit(0), 3, folder=f"{tmp_path}/none")
    assert none.bias == 0 and [tuple(r) for r in none.weights.collect()] == [(-1, 0.0)]
    one = classifier.fit_texts(rows.withColumn("label", F.lit(1)), 3, folder=f"{tmp_path}/one")
    assert one.bias > 0


def test_scores_of_rows_are_those_of_the_join(rows, tmp_path):
    model = classifier.fit_texts(rows, 5, folder=f"{tmp_path}/m")
    joined = {r.id: r.score for r in model.score(rows).collect()}
    assert all(abs(joined[r.id] - r.score) < 1e-9 for r in classifier.score_rows(rows, model.dense()).collect())


def test_rounds_read_bytes_not_numbers(spark, rows, tmp_path):
    classifier.fit_texts(rows, 1, folder=f"{tmp_path}/m")
    written = spark.read.parquet(f"{tmp_path}/m/packed")
    assert dict(written.dtypes)["places"] == "binary" and written.count() <= rows.rdd.getNumPartitions() + 120 // classifier.PACKED_ROWS
    # Values that are no counts are kept as they are.
    odd = spark.createDataFrame([(1, [0, 7], [0.25, -3.0]), (0, [], [])], classifier._BLOCK).coalesce(1)
    (r,) = classifier.packed(odd).collect()
    assert np.frombuffer(r["values"]).tolist() == [0.25, -3.0] and np.frombuffer(r["sizes"], np.int32).tolist() == [2, 0] and not r["counts"]


def test_places_of_words_are_looked_up(monkeypatch):
    monkeypatch.setattr(classifier.WordPlaces, "most", 3)
    places = classifier.WordPlaces()
    for word in ["a", "bad", "비판", "é😀", "a", "the", "bad"]:
        codes = classifier._codes(word)
        assert places[word] == classifier._hashed(classifier._start("w"), codes, len(codes))[0] and len(places) <= 3
