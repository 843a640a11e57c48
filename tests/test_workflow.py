"""Variants, classifier, curation, releases, evaluation, files and the stream."""

import json
import threading
import urllib.request
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiguard.functions import text as tx
from lexiguard.operators import classifier, curation, evaluate, release, variants, workflow
from lexiguard.operators.detect import Entry, Lexicon
from lexiguard.plans import check, queries, similar
from lexiguard.sources import files
from lexiguard.streaming import check as stream


@settings(max_examples=300, deadline=None)
@given(st.text("가나다시이운abA1 ", max_size=6))
def test_variants_hold_their_promises(surface):
    made = variants.variants_of(surface)
    kinds = [k for _, k in made]
    assert kinds == sorted(kinds, key=["jamo", "chosung", "leet"].index) and len({v for v, _ in made}) == len(made)
    assert surface not in {v for v, _ in made} and kinds.count("leet") <= variants.MOST_LEET
    assert all(tx.normalise(v)[0] == tx.normalise(surface)[0] for v, k in made if k == "jamo")


def test_variant_examples():
    assert variants.variants_of("시이")[:2] == [("ㅅㅣㅇㅣ", "jamo"), ("ㅅㅇ", "chosung")]
    assert [v for v, k in variants.variants_of("시") if k == "leet"] == ["시1", "시l", "시i"]
    assert [v for v, k in variants.variants_of("운") if k == "leet"] == ["0ㅜㄴ", "oㅜㄴ"]
    assert variants.variants_of("") == [] == variants.variants_of(None)


def test_loadable_variants(spark):
    rows = [("시1", "leet", "verified"), ("시이", "leet", "verified"), ("ㅅㅇㅅㅇ", "chosung", "verified"), ("ㅅㅇㅅ", "chosung", "verified"), ("ㅂㅂㅂㅂ", "chosung", "verified"), ("ㅂ1", "leet", "rejected")]
    out = variants.loadable(spark.createDataFrame(rows, "variant string, variant_kind string, decision string"), ["ㅂㅂㅂㅂ"])
    assert {r.variant for r in out.collect()} == {"시1", "ㅅㅇㅅㅇ"}


def test_classifier_learns_and_is_saved(spark, tmp_path):
    rows = [(i, f"{'good sunny' if i % 2 else 'bad rainy'} day {i}", "day", i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, text string, surface string, label int")
    model = classifier.fit(classifier.features(df), df.select("id", "label"), rounds=15)
    scored = model.score(df).join(df.select("id", "label"), "id")
    assert classifier.confusion_metrics(scored).first().asDict() == {"accuracy": 1.0, "precision": 1.0, "recall": 1.0, "f1": 1.0}
    assert classifier.auc(scored).first()[0] == 1.0
    files.write_model(model, f"{tmp_path}/model")
    again = files.read_model(spark, f"{tmp_path}/model").score(df)
    assert {(r.id, round(r.score, 9)) for r in again.collect()} == {(r.id, round(r.score, 9)) for r in scored.collect()}
    spark.createDataFrame([(json.dumps({"feature_version": "0", "bias": 0.0, "temperature": 1.0, "weights": {}}),)], "v string").write.text(f"{tmp_path}/old")
    with pytest.raises(ValueError, match="other features"):
        files.read_model(spark, f"{tmp_path}/old")


def test_metrics_of_single_classes(spark):
    one = spark.createDataFrame([(0.7, 1), (0.2, 1)], "score double, label int")
    assert str(classifier.auc(one).first()[0]) == "nan"
    none = spark.createDataFrame([], "score double, label int")
    assert classifier.confusion_metrics(none).first().asDict() == {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_split_by_stratum(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate("a" * 10 + "b" * 3 + "c")], "id long, surface string")
    out = {r.surface: r.n for r in classifier.stratified_split(df).groupBy("surface").agg(F.sum(F.col("is_val").cast("int")).alias("n")).collect()}
    assert out == {"a": 2, "b": 1, "c": 0}


def test_candidate_files(spark, tmp_path):
    folder = tmp_path / "candidates" / "deep"
    folder.mkdir(parents=True)
    for i, text in queries.CANDIDATES.rows[:3]:
        (folder / f"{i}.json").write_text(text)
    (tmp_path / "candidates" / "0.json").write_text("{broken")
    (tmp_path / "candidates" / "00.json").write_text("[1]")
    (tmp_path / "candidates" / "notes.txt").write_text("no")
    out = files.read_candidates(spark, f"{tmp_path}/candidates").collect()
    assert [r.errors for r in out] == [["not a JSON object"], ["not a JSON object"], [], [], ["negative_examples"]]
    assert out[2].dedup_key == out[3].dedup_key == "new_term:abc ㄱㅏ" and out[2].signal_score == 6.0


def test_plans_of_candidates(spark):
    c = curation.parse(queries.CANDIDATES.df(spark)).select("id", "c")
    plan = curation.term_plan(c.where("id = 1"))
    assert {k: v.count() for k, v in plan.items()} == {"term": 1, "evidence": 2, "category": 1, "rule": 0, "incident": 1}
    assert plan["term"].first().status == "in_review" and str(plan["incident"].first().occurred_at) == "2020-01-01"
    assert {k: v.count() for k, v in curation.other_plans(c).items()} == {"variant": 3, "marker": 2, "incident": 3, "deprecation": 1}


def test_approval_and_rejection(spark):
    queue = spark.createDataFrame([(1, "pending"), (2, "approved"), (3, "pending")], "id long, status string")
    chosen = spark.createDataFrame([(1,), (2,)], "id long")
    after, log = curation.approve(queue, chosen, F.current_timestamp())
    assert {(r.id, r.status) for r in after.collect()} == {(1, "approved"), (2, "approved"), (3, "pending")}
    assert {(r.entity_id, r.new_value) for r in log.collect()} == {(1, "approved"), (2, "refused")}
    assert {(r.id, r.status) for r in curation.reject(queue, chosen).collect()} == {(1, "rejected"), (2, "rejected"), (3, "pending")}
    need = spark.createDataFrame([(5, False, [True] * 5), (5, False, [True] * 4), (2, True, None), (2, False, None)], "s int, l boolean, d array<boolean>")
    assert [r[0] for r in need.select(curation.checklist_missing(F.col("s"), F.col("l"), F.col("d"))).collect()] == [False, True, True, False]


def test_release_round_trip(spark, tmp_path):
    term = queries.TERM_ROWS.df(spark).withColumns({"pattern": F.lit(None).cast("string"), "safe_contexts": F.array(F.lit("s"))})
    nested = release.nested_terms(term, queries.TERM_CATEGORY.df(spark), queries.CATEGORY.df(spark), queries.VARIANT.df(spark), queries.RULE.df(spark))
    manifest = files.write_release(nested, f"{tmp_path}/r", "2026.01.02-1")
    assert (manifest["term_count"], manifest["variant_count"]) == (3, 3)
    lexicon = files.read_lexicon(spark, f"{tmp_path}/r")
    assert lexicon.version == "2026.01.02-1" and [e.term_id for e in lexicon.entries] == [1, 2, 5]
    assert lexicon.entries[0].keys == (("aaa", None), ("aa", "chosung"), ("a1a", "leet")) and lexicon.entries[0].rules[0].trigger_terms == (2,)
    assert lexicon.entries[1].dogwhistle and lexicon.entries[0].categories == ("a", "x")
    forms = [r.form for r in files.read_user_dictionary(spark, f"{tmp_path}/r/user_dict").collect()]
    assert sorted(forms) == ["A1A", "aaa"]
    old = spark.createDataFrame([(json.dumps({"release_version": "x", "normalizer_code_version": "0.1"}),)], "v string")
    old.write.text(f"{tmp_path}/old/manifest")
    with pytest.raises(ValueError, match="normaliser"):
        files.read_lexicon(spark, f"{tmp_path}/old")
    assert release.difference(nested, nested).count() == 0


def test_versions_and_loading(spark):
    assert release.next_version(["2026.06.08-1", "2026.06.08-9", "2026.06.08-x", "2026.06.07-30"], date(2026, 6, 8)) == "2026.06.08-10"
    assert release.next_version([], date(2026, 6, 8)) == "2026.06.08-1"
    verified = spark.createDataFrame([("aaa", "v1", "leet"), ("aaa", "aa", "chosung"), ("zzz", "v", "leet"), ("AAA", "v1", "leet")], "surface string, variant string, variant_kind string")
    out = release.load_variants(verified, queries.TERM_ROWS.df(spark), queries.VARIANT.df(spark))
    assert sorted((r.variant, r.outcome) for r in out.collect()) == [("aa", "skip"), ("v", "noparent"), ("v1", "loaded"), ("v1", "skip")]


def test_evaluation_without_rows(spark):
    empty = spark.createDataFrame([], "ok boolean, severity int, bucket string")
    row = evaluate.recalls(empty).first()
    assert row.recall == 1.0 or row.recall is None
    grades = spark.createDataFrame([("ambiguous", "review_recommended"), ("strict", "review_recommended"), ("strict", "monitor"), ("ambiguous", "revise_recommended")], "g string, r string")
    assert [r[0] for r in grades.select(evaluate.passes(F.col("g"), F.col("r"))).collect()] == [True, False, True, False]


def test_json_lines_and_dictionary(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1,"text":"x"}\n\n  \n{"id":2}\n')
    assert [(r.id, r.text) for r in files.read_json_lines(spark, f"{tmp_path}/a.jsonl", "id int, text string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "d.tsv").write_text("# comment\n\n가\nb\tNNG\t1.5\n")
    assert [tuple(r) for r in files.read_user_dictionary(spark, f"{tmp_path}/d.tsv").collect()] == [("가", "NNP", None), ("b", "NNG", 1.5)]


def test_near_hashes_lose_none(spark):
    import random

    rng = random.Random(1)
    marks = [(i, rng.getrandbits(63)) for i in range(5)]
    images = [(10 * m + d, h ^ sum(1 << b for b in rng.sample(range(63), d))) for m, h in marks for d in range(10)]
    out = similar.near_hashes(spark.createDataFrame(images, "image_id long, phash long"), spark.createDataFrame(marks, "marker_id long, phash long"))
    got = {(r.image_id, r.marker_id, r.distance) for r in out.collect()}
    assert got == {(i, m, (a ^ b).bit_count()) for i, a in images for m, b in marks if (a ^ b).bit_count() <= 8}


def test_stream_answers_each_text_once(spark, tmp_path):
    lexicon = Lexicon((Entry(1, "code", (("code", None),)),))
    for i in range(3):
        spark.createDataFrame([(i, f"my code {i}")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/in")
    answers = stream.check_stream(stream.read_texts(spark, f"{tmp_path}/in", files_per_batch=1), lexicon)
    for _ in range(2):
        q = stream.write_responses(answers, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 2] and all(json.loads(r.response)["matches"] for r in out)


def test_dense_scores_are_those_of_the_features(spark):
    texts = ["", "a", "ab", "the 'code' word", "code code 표현 규탄", "  spaced\nout  ", "수준 “code”", "é😀x"]
    df = spark.createDataFrame([(i, t, "code") for i, t in enumerate(texts)], "id long, text string, surface string")
    weights = spark.range(classifier.DIM + 5).select(F.col("id").alias("idx"), (((F.col("id") % 13) - 6) / F.lit(10.0)).alias("w"))
    model = classifier.Model(weights, 0.1, 0.8)
    dense = model.dense()
    for r in model.score(df).collect():
        assert abs(r.score - dense.scores(texts[r.id], ["code"])[0]) < 1e-9, texts[r.id]


def test_the_check_takes_a_models_scores(spark):
    lexicon = Lexicon((Entry(1, "code", (("code", None),), ambiguity="ambiguous", severity=5), Entry(2, "word", (("word", None),), severity=5)))
    df = spark.createDataFrame([(1, "code word"), (2, "nothing"), (3, None)], "doc_id long, text string")
    weights = np.zeros(classifier.DIM + 5)
    sure, unsure = ({r.term_id: r for r in check.check(df, lexicon, {"quotation": False}, model=classifier.Dense(weights, b)).collect()} for b in (4.0, 0.1))
    assert sure[1].context_score > 0.95 and sure[1].flags == [] and sure[1].usage_recommendation == "revise_recommended"
    assert unsure[1].flags == ["context_low_confidence"] and unsure[1].usage_recommendation == "review_recommended" and unsure[2].context_score == 1.0 and unsure[2].flags == []


def test_the_service_answers(spark, tmp_path, monkeypatch):
    lexicon = Lexicon((Entry(1, "code", (("code", None),), severity=5),), "2026.01.01-1")
    service = check.Service(spark, lexicon)
    status, body = service.answer("/v1/check/text", json.dumps({"text": "a code"}).encode())
    assert status == 200 and json.loads(body)["matches"][0]["surface"] == "code" and json.loads(body)["debug"]["timings_ms"]["total"] > 0
    assert [service.answer(*x)[0] for x in (("/other", b"{}"), ("/v1/check/text", b"{"), ("/v1/check/text", b'{"text": 1}'), ("/v1/check/text", b"[]"))] == [404, 422, 422, 422]
    assert check.Service(spark, None).answer("/v1/check/text", b'{"text": "a"}')[0] == check.UNAVAILABLE
    server = service.serve()
    threading.Thread(target=server.handle_request, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/v1/check/text", b'{"text": ""}') as r:
        assert json.load(r)["overall_recommendation"] == "none"
    server.server_close()
    monkeypatch.delenv(files.MODEL_VARIABLE, raising=False)
    assert files.context_model(spark) is None
    with pytest.raises(ValueError, match="no model"):
        files.context_model(spark, f"{tmp_path}/gone")
    monkeypatch.setenv(files.MODEL_VARIABLE, f"{tmp_path}/gone")
    assert files.context_model(spark) is None


def test_decisions_on_empty_tables(spark):
    none = spark.createDataFrame([], "id long, reviewer string, done array<boolean>")
    tables, outcomes = workflow.approve({}, none)
    assert outcomes.count() == 0 and all(t.count() == 0 for t in tables.values()) and set(tables) == set(workflow.SCHEMAS)
    assert workflow.approve({}, spark.createDataFrame([(1, "ann", None)], none.schema))[1].collect()[0].outcome == "unknown"


def test_reports_as_markdown(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None), (3, "c")], "id int, t string").coalesce(1)
    assert evaluate.markdown(df, "T") == "# T\n\n| id | t |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n| 3 | c |\n"
    assert evaluate.markdown(df, "T", 1).endswith("Only the first rows are shown.\n")


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART_REFERENCES", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    rows = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(v)] + [(100, [0.0] * 4), (101, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(0, 60, 5) if i != j and unit[i] @ unit[j] >= 0.8}
    got = similar.near_vectors(df, df.where("vec_id % 5 = 0"), 0.8).collect()
    assert {(r.vec_id, r.ref_id) for r in got} == want and all(abs(r.similarity - unit[r.vec_id] @ unit[r.ref_id]) < 1e-5 for r in got)
