"""Answers in spite of texts and patterns that fail."""

import time

import pytest

from lexiguard.operators import detect
from lexiguard.operators.detect import Entry, Lexicon, Rule
from lexiguard.plans.check import check_documents, check_partially

STAGES = dict.fromkeys(detect.STAGES, False) | {"pattern": True, "combination": True}


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_one_text_in_many_that_takes_too_long(spark):
    lexicon = Lexicon((Entry(1, "slow", (), term_kind="pattern", pattern="(x|xx|xxx)+y"), Entry(2, "z", (("z", None),))))
    texts = ["z xxy"] * 10_000
    # Without a y the pattern would not even be tried.
    texts[4711] = "y" + "x" * 60 + " z"
    out = {r.doc_id: r for r in check_partially(docs(spark, texts), lexicon, STAGES, seconds=0.3).collect()}
    assert len(out) == 10_000
    bad = out.pop(4711)
    assert bad.status == "failed" and bad.m == [] and bad.overall_recommendation is None and "TimeoutError" in bad.faults[0]
    assert {(r.status, len(r.m), r.overall_recommendation) for r in out.values()} == {("ok", 2, "review_recommended")}


def test_broken_patterns_and_rules(spark):
    rules = (Rule("(", ()), Rule("ok", ()))
    lexicon = Lexicon((Entry(1, "p", (), term_kind="pattern", pattern="["), Entry(2, "q", (), term_kind="pattern", pattern="qq"), Entry(3, "7", (("7", None),), term_kind="number", rules=rules)))
    with pytest.raises(Exception, match="unterminated"):
        check_documents(docs(spark, ["qq"]), lexicon, STAGES).collect()
    out = sorted(check_partially(docs(spark, ["qq", "7 ok", "7", None]), lexicon, STAGES).collect(), key=lambda r: r.doc_id)
    assert [(r.status, [(x.surface, x.flags) for x in r.m]) for r in out] == [("partial", [("q", [])]), ("partial", [("7", ["composite_satisfied"])]), ("partial", [("7", ["composite_unsatisfied"])]), ("partial", [])]
    assert all(len(r.faults) == 2 and r.overall_recommendation for r in out)


def test_the_deadline_leaves_texts_unanswered_and_says_so(spark):
    lexicon = Lexicon((Entry(2, "z", (("z", None),)),))
    late = check_partially(docs(spark, ["z"] * 20), lexicon, STAGES, deadline=time.time() - 1).collect()
    assert {r.status for r in late} == {"failed"} and all("deadline" in r.faults[0] for r in late)
    assert {r.status for r in check_partially(docs(spark, ["z"] * 20), lexicon, STAGES, deadline=time.time() + 600).collect()} == {"ok"}
    assert check_partially(docs(spark, ["z"]).limit(0), lexicon, STAGES).count() == 0


def test_matches_are_handed_on_before_they_are_many(spark, monkeypatch):
    lexicon = Lexicon((Entry(1, "a", (("a", None),)),))
    texts = ["a" * (i % 7) if i % 5 else None for i in range(300)]
    whole = {r.doc_id: len(r.m) for r in check_documents(docs(spark, texts), lexicon, STAGES).collect()}
    monkeypatch.setattr(detect, "SCAN_MATCHES", 3)
    for out in (check_documents(docs(spark, texts), lexicon, STAGES), check_partially(docs(spark, texts), lexicon, STAGES)):
        assert {r.doc_id: len(r.m) for r in out.collect()} == whole == {i: len(t or "") for i, t in enumerate(texts)}
