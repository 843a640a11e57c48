"""Rules with distances against looking at every pair, and their default, which has none."""

import random
import re
import time

import numpy as np

from lexiguard.operators import detect
from lexiguard.operators.detect import Entry, Lexicon, Rule
from lexiguard.plans.check import check, check_documents

STAGES = dict.fromkeys(detect.STAGES, False) | {"combination": True}


def test_near_triggers_equal_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        span = lambda: (a := rng.randrange(40), a + rng.randint(1, 5))
        m, t, w = [span() for _ in range(rng.randrange(6))], [span() for _ in range(rng.randrange(6))], rng.choice([None, 0, 1, 7])
        col = lambda x, i: np.array([r[i] for r in x], np.int64)
        want = [any(w is None or max(0, s - b, a - e) <= w for s, e in t) for a, b in m]
        assert detect.near_triggers(col(m, 0), col(m, 1), col(t, 0), col(t, 1), w).tolist() == want


def test_severities_and_flags(spark):
    rules = (Rule("원", (), 3, 2, 2), Rule(None, (2,), 5, 1, 3), Rule("zz", ()))
    lexicon = Lexicon((Entry(1, "77", (("77", None),), term_kind="number", severity=3, rules=rules), Entry(2, "code", (("code", None),)), Entry(3, "88", (("88", None),), term_kind="number", severity=2)))
    texts = ["77", "77원", "77 원", "77    원", "code77", "code 77 원", "code      77", "77 zz", "88", None, "", "77원 " + "x" * 50 + " 77"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start): (r.severity, r.flags) for r in check(df, lexicon, STAGES, distances=True).where("term_id <> 2").collect()}
    satisfied = {k: s for k, (s, f) in got.items() if f == ["composite_satisfied"]}
    assert satisfied == {(1, 0): 4, (2, 0): 4, (4, 4): 4, (5, 5): 4, (7, 0): 3, (11, 0): 4}
    assert {k: s for k, (s, f) in got.items() if f == ["composite_unsatisfied"]} == {(0, 0): 2, (3, 0): 2, (6, 10): 2, (8, 0): 2, (11, 55): 2}
    plain = check(df, lexicon, STAGES).where("term_id = 1")
    assert {r.severity for r in plain.collect()} == {3} and plain.where("array_contains(flags, 'composite_satisfied')").count() == 9


def test_rules_equal_looking_at_every_pair(spark):
    rng = random.Random(5)
    lexicon = Lexicon((Entry(1, "n", (("n", None),), term_kind="number", severity=2, rules=(Rule("[0-9]+", (), 4, 1, 4), Rule(None, (2,), 2, 1, 2))), Entry(2, "w", (("w", None),))))
    texts = ["".join(rng.choice(["n", "w", "1", " ", " ", "x"]) for _ in range(30)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.start): r.severity for r in check(df, lexicon, STAGES, distances=True).where("term_id = 1").collect()}
    want = {}
    for i, text in enumerate(texts):
        gap = lambda a, m: max(0, m.start() - a - 1, a - m.end())
        for at in (k for k, c in enumerate(text) if c == "n"):
            want[i, at] = 5 if any(gap(at, m) <= 4 for m in re.finditer("[0-9]+", text)) else 3 if any(gap(at, m) <= 2 for m in re.finditer("w", text)) else 1
    assert got == want


def test_one_document_of_many_matches_takes_linear_time(spark):
    lexicon = Lexicon((Entry(1, "n", (("n", None),), term_kind="number", rules=(Rule(None, (2,), 2), Rule("[0-9]", (), 3))), Entry(2, "w", (("w", None),))))

    def seconds(n):
        df = spark.createDataFrame([(1, "n w n  7 " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert len(check_documents(df, lexicon, STAGES, distances=True).first().m) == 3 * n
        return time.perf_counter() - began

    seconds(50)
    few, many = min(seconds(5_000) for _ in range(2)), seconds(20_000)
    assert many < 8 * few + 1
