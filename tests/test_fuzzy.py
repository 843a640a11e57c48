"""Words near keys against comparing all of them, and the plan that finds them."""

import random

import pytest
from pyspark.sql import functions as F

from lexiguard.operators import variants


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_fuzzy_keys_equal_all_pairs(spark, most):
    rng = random.Random(most)
    made = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    words = [made(rng.randrange(9)) for _ in range(300)] + ["", "a" * 5000, "é", "abé"]
    keys = [made(rng.randint(1, 7)) for _ in range(25)] + ["éab", "", "a"]
    w = spark.createDataFrame([(x,) for x in words] + [(None,)], "word string")
    k = spark.createDataFrame([(x,) for x in keys] + [(None,)], "key string")
    got = sorted(map(tuple, variants.fuzzy_keys(w, k, most).collect()))
    want = sorted((x, y, d) for x in set(words) for y in set(keys) if y and len(x) < 100 and 0 < (d := edits(x, y)) <= most)
    assert got == want


def test_no_nested_loops_and_any_number_of_keys(spark):
    words = spark.range(2000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("word"))
    keys = spark.range(12_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("key"))
    near = variants.fuzzy_keys(words, keys, 1)
    assert near.where("word = 'word77'").select("key").distinct().count() == len([i for i in range(12_000) if edits("word77", f"word{i}") == 1])
    # The length of the longest key is one row; it is all that a loop joins.
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 1


def test_matches_in_texts(spark):
    docs = spark.createDataFrame([(1, "a Kodak, kodac  kodax\nkodakk kod"), (2, None), (3, ""), (4, "😀kodac바다")], "doc_id long, text string")
    terms = spark.createDataFrame([(7, "kodak", 5, "unambiguous", "active", False), (8, "kodac", 2, "ambiguous", "watchlist", False)], "term_id long, key string, severity int, ambiguity string, status string, dogwhistle boolean")
    got = sorted((r.doc_id, r.start, r.end, r.matched_text, r.key, r.distance, r.match_confidence, r.usage_recommendation) for r in variants.fuzzy_matches(docs, terms, 2).collect())
    review, monitor = "review_recommended", "monitor"
    assert got == [
        (1, 2, 7, "Kodak", "kodac", 1, 0.7, monitor), (1, 9, 14, "kodac", "kodak", 1, 0.7, review), (1, 16, 21, "kodax", "kodac", 1, 0.7, monitor), (1, 16, 21, "kodax", "kodak", 1, 0.7, review), (1, 22, 28, "kodakk", "kodac", 2, 0.6, monitor),
        (1, 22, 28, "kodakk", "kodak", 1, 0.7, review), (1, 29, 32, "kod", "kodac", 2, 0.6, monitor), (1, 29, 32, "kod", "kodak", 2, 0.6, review),
    ]
