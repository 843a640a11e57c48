"""Normalisation, scanning, filters, scoring and the check as a whole, on neutral words."""

import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiguard.functions import text as tx
from lexiguard.operators import detect
from lexiguard.operators.detect import Entry, Lexicon, Rule
from lexiguard.plans.check import NOTICE, check, check_documents, check_text, responses


def key(s):
    return tx.normalise(s)[0]


LEXICON = Lexicon((
    Entry(1, "바다", ((key("바다"), None), (key("ㅂㄷ"), "chosung"), (key("바1다"), "leet")), severity=5),
    Entry(2, "하늘", ((key("하늘"), None),), severity=4, ambiguity="ambiguous", safe_contexts=("구름",)),
    Entry(3, "77", (("77", None),), term_kind="number", severity=4, rules=(Rule("원$"), Rule(None, (1,)))),
    Entry(4, "~네", (), term_kind="pattern", pattern=r"(.+)네[.!?]*$", severity=3, ambiguity="common", safe_contexts=("시골",)),
    Entry(5, "별", ((key("별"), None),), severity=2, status="watchlist"),
    Entry(6, "바다", ((key("바다"), None),), severity=1),
    Entry(7, "무늬", (), term_kind="pattern", severity=5),
), "2026.01.01-1")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_normalise_holds_its_promises(t):
    norm, off = tx.normalise(t)
    assert len(norm) == len(off) and off == sorted(off) and all(0 <= o < len(t) for o in off)
    assert tx.normalise(norm)[0] == norm
    assert tx.normalise(unicodedata.normalize("NFKC", t))[0] == norm


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=30) | st.text("aBİΣσßㄱㅏ가é\u0301\u200bＡﬁ ", max_size=12))
def test_the_fast_form_is_the_exact_one(t):
    norm, off = tx.normalise_fast(t, tx.plain_characters())
    assert (norm, list(range(len(norm))) if off is None else off) == tx.normalise(t)


def test_normalise_examples():
    assert tx.normalise(None) == ("", []) == tx.normalise("")
    assert tx.normalise("각A​") == ("ㄱㅏㄱa", [0, 0, 0, 1])
    assert tx.normalise("ＡΣ") == ("aσ", [0, 1])


def test_native_forms_agree(spark):
    texts = ["가나다ABC각값", "", "Größe ÉÀ", "ΑΣ", "ㄱ뷁 12", "plain", "zero​width", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", tx.native_normalise(F.col("t")).alias("n"), tx.native_offsets(F.col("t")).alias("o")).collect():
        assert (r.n, r.o) == tx.normalise(texts[r.id]) and isinstance(r.o, list)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\.E", max_size=12), st.text("ab\\.E", min_size=1, max_size=3)), min_size=20, max_size=40))
def test_occurrences_are_all_found(spark, pairs):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(pairs)], "id int, t string, k string")
    for r in df.select("id", F.when(F.contains("t", "k"), tx.occurrences(F.col("t"), F.col("k"))).alias("o")).collect():
        t, k = pairs[r.id]
        assert (r.o or []) == [i for i in range(len(t)) if t.startswith(k, i)]


def run(spark, *texts, lexicon=LEXICON, **stages):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in check(df, lexicon, stages).collect():
        out[r.doc_id].append(r)
    return [out[i] for i in range(len(texts))]


def test_policy(spark):
    plain, variant, leet, gap, gap_short, quoted, watch, safe, unsafe, number, number_met, number_pattern = run(
        spark, "푸른 바다", "ㅂㄷ", "바1다", "바. 다", "바-다", '"바다"', "별", "하늘 구름", "하늘 좋다", "77", "77 바다", "77 원"
    )
    assert [(m.term_id, m.start, m.end, m.usage_recommendation) for m in plain] == [(1, 3, 5, "revise_recommended"), (6, 3, 5, "monitor")]
    assert (variant[0].match_confidence, variant[0].flags, variant[0].usage_recommendation) == (0.7, ["chosung_variant"], "review_recommended")
    assert leet[0].match_confidence == 0.9 and leet[0].usage_recommendation == "revise_recommended"
    assert gap[0].flags == ["skip_char"] and gap[0].usage_recommendation == "review_recommended" and gap[0].matched_text == "바. 다"
    assert gap_short[0].usage_recommendation == "revise_recommended" and gap_short[0].match_confidence == 0.8
    assert quoted[0].flags == ["quotation_heuristic"] and quoted[0].usage_recommendation == "review_recommended"
    assert watch[0].usage_recommendation == "monitor"
    assert safe == [] and unsafe[0].context_score == 0.5 and unsafe[0].risk_score == 4 / 5 * 1.0 * 0.5
    assert number[0].flags == ["composite_unsatisfied"] and number[0].usage_recommendation == "monitor"
    assert number_met[0].flags == ["composite_satisfied"] and number_pattern[0].flags == ["composite_satisfied"]


def test_boundaries(spark):
    inside, last_letter, ascii_word = run(spark, "강아지바다", "바닥", "a77b")
    assert inside == []
    # The end of a key may lie within a syllable, which then belongs to the match.
    assert last_letter[0].matched_text == "바닥"
    # Numbers are exempt from containment in a longer word.
    assert len(ascii_word) == 1
    assert len(run(spark, "강아지바다", morpheme_boundary=False)[0]) == 2


def test_patterns(spark):
    said, dialect, literal = run(spark, "갔네!", "시골 갔네", "이 무늬 좋다")
    assert [(m.term_id, m.matched_text, m.usage_recommendation) for m in said] == [(4, "갔네!", "monitor")]
    assert dialect == []
    assert [(m.term_id, m.flags) for m in literal] == [(7, ["pattern_fallback_literal"])]
    assert run(spark, "갔네!", pattern=False) == [[]]


def test_masking_keeps_a_term_from_resolving_itself(spark):
    lexicon = Lexicon((Entry(1, "된장국수", ((key("된장국수"), None),), ambiguity="ambiguous", safe_contexts=("된장",)),))
    twice, with_word = run(spark, "된장국수 된장국수", "된장 그리고 된장국수", lexicon=lexicon)
    assert len(twice) == 2 and with_word == []


def test_user_tokens_and_edges(spark):
    df = spark.createDataFrame([(1, "x바다y", [(0, 4, False)], None), (2, "새바다", [(1, 3, False)], [(0, 2, True)]), (3, "새바다", [(1, 3, False)], [(0, 2, False)]), (4, "새바다", [(1, 3, False)], [])], "doc_id long, text string, tokens array<struct<s:int,e:int,oov:boolean>>, base_tokens array<struct<s:int,e:int,oov:boolean>>")
    lexicon = Lexicon((Entry(1, "바다", ((key("바다"), None),), severity=5),))
    out = {r.doc_id: r for r in check(df.where("doc_id > 1"), lexicon).collect()}
    assert set(out) == {2, 4} and out[2].flags == ["oov_boundary_kept"] and out[2].usage_recommendation == "review_recommended" and out[4].flags == []
    assert check(df.where("doc_id = 1").drop("base_tokens"), lexicon).count() == 0


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "바다 " * 3000), (3, "바다 " * 3000)], "doc_id long, text string")
    out = {(r.doc_id, r.n, r.o) for r in check_documents(df, LEXICON).select("doc_id", F.size("m").alias("n"), F.col("overall_recommendation").alias("o")).collect()}
    assert out == {(1, 0, "none"), (2, 0, "none"), (3, 6000, "revise_recommended")}
    assert check(df, Lexicon(())).count() == 0 and check_documents(df.limit(0), LEXICON).count() == 0


def test_response_has_advice_and_notice(spark):
    body = json.loads(check_text(spark, "푸른 바다", LEXICON))
    assert body["usage_notice"] == NOTICE and body["release_version"] == "2026.01.01-1" and body["overall_recommendation"] == "revise_recommended"
    assert body["matches"][0]["span"] == {"start": 3, "end": 5} and body["matches"][0]["advisory"] and body["debug"]["match_count"] == 2
    assert json.loads(check_text(spark, "없음", LEXICON))["overall_recommendation"] == "none"


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame([(1, "바다")], "doc_id long, text string")
    plan = responses(check_documents(df, LEXICON), LEXICON)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize(("norm", "view"), [("ㄱ. ㅏ", "ㄱㅏ"), ("ㄱ...ㅏ", "ㄱ...ㅏ"), ("ㄱ.ㅏ-ㄴ", "ㄱㅏㄴ"), ("a.b", "a.b"), ("ㄱ.", "ㄱ.")])
def test_skip_view(norm, view):
    text, places, blank = detect.skip_view(norm)
    assert text == view and len(places) == len(blank) == len(view) and [norm[i] for i in places] == list(view)
