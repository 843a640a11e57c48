"""Searches by hash and by cosine against comparing all pairs, and how much of all pairs they look at."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiguard.plans import similar
from lexiguard.plans.registered import QUERIES, SQL

VECTORS = "vec_id long, embedding array<double>"


def test_hashes_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(300)]
    marks = [x ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(12))) for x in rng.sample(base, 60)] + [0, 2**64 - 1]
    base += [0] * 40 + base[:20] + [1, 2**63]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    images = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(base)] + [(9999, None)], "image_id long, phash long")
    markers = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(marks)] + [(9999, None)], "marker_id long, phash long")
    for radius in (8, 3, 0):
        want = sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(base) for j, y in enumerate(marks) if (x ^ y).bit_count() <= radius)
        assert sorted(map(tuple, similar.near_hashes(images, markers, radius).collect())) == want
    assert similar.near_hashes(images.limit(0), markers).count() == 0


def test_sign_hashes_keep_all_bits(spark):
    v = [[1.0 if i in (0, 5, 63) else -1.0 for i in range(64)], [0.0] * 64, [1.0] * 100]
    got = [r.h for r in spark.createDataFrame([(x,) for x in v], "v array<double>").select(similar.sign_hash(F.col("v")).alias("h")).collect()]
    assert [h & (2**64 - 1) for h in got] == [1 | 1 << 5 | 1 << 63, 0, 2**64 - 1]


def all_pairs(vectors, references, least):
    out = {}
    for i, a in vectors:
        for j, b in references:
            if i != j and a and b and len(a) == len(b) and None not in a and None not in b:
                size = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
                if size > 0 and (s := sum(x * y for x, y in zip(a, b, strict=True)) / size) >= least:
                    out[i, j] = round(s, 9)
    return out


@pytest.mark.parametrize("size, kind", [(64, "spread"), (64, "clustered"), (64, "positive"), (100, "clustered"), (5, "spread"), (1, "spread")])
def test_vectors_equal_all_pairs(spark, size, kind):
    rng = np.random.default_rng(size)
    if kind == "clustered":
        centres = rng.normal(size=(12, size))
        v = centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, size)) * 0.35
    else:
        v = rng.normal(size=(300, size))
        v = np.abs(v) + 0.5 if kind == "positive" else v
    # Neighbours are planted right at the limit and on both sides of it.
    planted = []
    for k in range(40):
        a, b = v[k] / np.linalg.norm(v[k]), rng.normal(size=size)
        b -= a * (a @ b)
        c = 0.92 + (k - 20) * 0.002
        planted.append(a * c + (b / max(np.linalg.norm(b), 1e-12)) * math.sqrt(1 - c * c) if size > 1 else a)
    rows = [(i, x.tolist()) for i, x in enumerate([*v, *(3 * x for x in planted)])]
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000, None), (2001, []), (2002, [0.0] * size), (2003, [1.0] * (size + 1)), (2004, [None] * size)]
    asked = rows[:300:7] + rows[300:340:2] + rows[-5:]
    vectors, references = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, VECTORS)
    got = {(r.vec_id, r.ref_id): round(r.similarity, 9) for r in similar.near_vectors(vectors, references).collect()}
    want = all_pairs(rows, asked, 0.92)
    # A pair within rounding of the limit may be seen on either side of it.
    assert all(p in got for p in want if want[p] > 0.92 + 1e-9) and all(p in want for p in got if got[p] > 0.92 + 1e-9)
    assert len(want) >= 5


def test_cells_that_are_passed_over_hold_no_neighbour():
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for size, spread in ((3, 1.0), (20, 0.2), (64, 0.3), (64, 1.0)):
        middle = rng.normal(size=(10, size))
        v = unit(middle[rng.integers(0, 10, 2000)] + rng.normal(size=(2000, size)) * spread)
        centres = unit(middle + rng.normal(size=(10, size)) * 0.1)
        cell = (v @ centres.T).argmax(axis=1)
        angle = np.arccos((v * centres[cell]).sum(axis=1))
        low, high = (np.array([f(angle[cell == c], initial=x) for c in range(10)]) for f, x in ((np.min, np.inf), (np.max, -np.inf)))
        seen = similar.cells_within(v[:400], centres, low, high, np.arccos(0.92) + 1e-6)
        near = v[:400] @ v.T >= 0.92
        assert all(seen[i, cell[j]] for i, j in zip(*np.nonzero(near), strict=True))
        if spread < 0.3:
            assert seen.mean() < 0.3


def test_little_of_all_pairs_is_looked_at(spark):
    rng = np.random.default_rng(9)
    hashes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(-(2**63), 2**63 - 1, 3000))], "image_id long, phash long")
    markers = hashes.where("image_id % 50 = 0").withColumnRenamed("image_id", "marker_id")
    near = similar.near_hashes(hashes, markers)
    near.collect()
    plan = near._jdf.queryExecution().executedPlan()
    assert "CartesianProduct" not in plan.toString() and "BroadcastNestedLoopJoin" not in plan.toString()
    # What meets in a block: four blocks of 65,536 values, 137 of which are near enough.
    posts = [(k, r.phash >> 16 * k & 0xFFFF) for r in hashes.collect() for k in range(4)]
    wanted = [(k, (r.phash >> 16 * k & 0xFFFF) ^ m) for r in markers.collect() for k in range(4) for m in similar._nearby(16, 2)]
    listed = Counter(posts)
    assert sum(listed[w] for w in wanted) < 0.05 * 3000 * 60


def test_large_cells_and_many_references_are_dealt_to_several_groups(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART_VECTORS", 50)
    monkeypatch.setattr(similar, "PART_REFERENCES", 7)
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {(r.vec_id, r.ref_id) for r in similar.near_vectors(df, df.where("vec_id % 4 = 0")).collect()}
    want = all_pairs(rows, rows[::4], 0.92)
    assert {p for p in want if want[p] > 0.92 + 1e-9} <= got and all(p in want for p in got) and len(want) > 1000


def test_odd_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0])], VECTORS)
    assert similar.near_vectors(empty, some).count() == 0 and similar.near_vectors(some, empty).count() == 0
    assert sorted((r.vec_id, r.ref_id) for r in similar.near_vectors(some, some.where("vec_id = 1")).collect()) == [(2, 1), (2, 1)]


def test_short_hashes_meet_in_their_own_blocks(spark, tmp_path):
    rng = random.Random(6)
    base = [rng.getrandbits(32) for _ in range(200)]
    marks = [x ^ sum(1 << i for i in rng.sample(range(32), rng.randrange(12))) for x in rng.sample(base, 40)]
    images = spark.createDataFrame(list(enumerate(base)), "image_id long, phash long")
    found = similar.near_hashes(images, spark.createDataFrame(list(enumerate(marks)), "marker_id long, phash long"), n_bits=32).collect()
    assert sorted(map(tuple, found)) == sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(base) for j, y in enumerate(marks) if (x ^ y).bit_count() <= 8)
    # The query asks by 32 signs: what the others of a vector are does not rule it out.
    vectors = [(i, [1.0 if x >> k & 1 else -1.0 for k in range(32)] + [1.0 - 2 * (i % 2)] * 32) for i, x in enumerate([base[0], base[0] ^ 7, ~base[0]])]
    spark.createDataFrame(vectors, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, QUERIES["phash_hamming"](spark, str(tmp_path)).collect())) == [(0, 0, 0), (1, 0, 3)]


@pytest.mark.parametrize("query", ["phash_hamming", "phash_altered_markers"])
def test_images_without_a_vector_are_found_as_the_sql_finds_them(spark, tmp_path, query):
    import duckdb

    rng = random.Random(8)
    signs = lambda n: [rng.choice((-1.0, 1.0)) for _ in range(n)]
    rows = [(0, None), (1, None), (100, []), (200, [None] * 64), (300, signs(64)), (2, signs(20)), (3, [-1.0] * 64), (4, [1.0] * 6 + [-1.0] * 58), (None, None), (5, [float("nan")] * 64)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = Counter(con.execute(SQL[query]).fetchall())
    assert Counter(map(tuple, QUERIES[query](spark, str(tmp_path)).collect())) == want and want[1, 0, 0] == 1


def test_what_is_looked_up_is_little_and_not_broadcast(spark):
    hashes = spark.range(2000).selectExpr("id AS image_id", "xxhash64(id) & 4294967295 AS phash")
    near = similar.near_hashes(hashes, hashes.where("image_id % 50 = 0").withColumnRenamed("image_id", "marker_id"), n_bits=32)
    near.collect()
    # Spark takes a few markers to be a few rows, though each looks up thousands of values.
    joins = [x for x in near._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "bits" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    for radius in range(20):
        for blocks in range(1, 6):
            # Hashes beyond the reach of every block are beyond the radius, and no smaller reaches would do.
            reaches = similar._reaches(radius, blocks)
            assert sum(r + 1 for r in reaches) == radius + 1 and max(reaches) - min(reaches) <= 1 and min(reaches) >= -1
