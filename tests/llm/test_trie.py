"""The conversation trie against a plain one, with and without parts that are dealt again."""

import hashlib
import random
import zlib

import pytest

from lexiguard.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth string, up binary"


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    own = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in members.items()}
    below = {p: {q[len(p)] for q in members if len(q) == len(p) + 1 and q[: len(p)] == p} for p in members}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for q in members:
        for d in range(len(q) + 1):
            leaves[q[:d]] += not below[q]
            saved[q[:d]] += own[q]
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(below[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def rows_of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*trie.COLUMNS).collect())


def made_rows(rng):
    rows = []
    for c in [*range(120), *range(200, 260), *range(330, 350)]:
        stem = ["hello"] * rng.choice([0, 3, 3, 3]) + ["hello", "x", "y"][: rng.randrange(4)]
        rows += [(c, i if rng.random() < 0.9 else None, rng.choice(["user", "user", None, ""]), rng.choice([t, t, t, None])) for i, t in enumerate(stem)]
        rows += [(c, 100 + i, "user", rng.choice("ab")) for i in range(rng.randrange(7))]
    rows += [(c, i, "user", t) for c in range(400, 440) for i, t in enumerate("same")]
    rows += [(c, i, "user", f"long {min(i, 80 + c % 3)}") for c in (500, 501, 502, 503) for i in range(90)]
    return rows + [(None, 1, "user", "lost"), (7, 1, "user", "twice"), (7, 1, "user", "twice"), (-5, 0, "a", "b"), (-105, 0, "a", "b")]


@pytest.mark.parametrize("bucket_turns, least_split", [(20_000, 1_000), (1, 1), (30, 40)])
def test_nodes_equal_the_plain_ones(spark, bucket_turns, least_split):
    rows = [r for r in made_rows(random.Random(bucket_turns)) if r[0] is None or r[0] >= 0]
    df = spark.createDataFrame([(*r, "d", b"u") for r in rows], TURNS).repartition(3)
    want = plain_nodes(plain_rebuilt(rows))
    assert rows_of(trie.prefix_nodes(trie.rebuilt(trie.sequences(df)), bucket_turns, least_split)) == want


def test_the_operator_equals_its_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(*r, "d", b"u") for r in made_rows(random.Random(2))], TURNS)
    df.write.parquet(f"{tmp_path}/c")
    want = duckdb.connect().sql(trie.TRIE_SQL.replace("FROM conversations", f"FROM read_parquet('{tmp_path}/c/*.parquet')"))
    got = trie.conversation_trie(df)
    assert sorted(map(str, want.project(",".join(trie.COLUMNS)).fetchall())) == sorted(str(tuple(r)) for r in got.select(*trie.COLUMNS).collect())
    assert trie.conversation_trie(df.limit(0)).count() == 0


def test_conversations_without_turns_belong_to_the_root(spark):
    ids = [c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 >= 1][:5]
    df = spark.createDataFrame([(c, 0, "user", "gone", "d", b"u") for c in ids], TURNS)
    (root,) = trie.conversation_trie(df).collect()
    assert (root.depth, root.n_convs, root.n_children, root.n_leaves) == (0, 5, 0, 1)
    assert root.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_very_long_conversations(spark):
    df = spark.range(20_000).selectExpr("id DIV 5000 AS conv_id", "id % 5000 AS turn", "'user' AS role", "CASE WHEN id % 5000 < 4990 THEN cast(id % 5000 AS string) ELSE cast(id AS string) END AS text")
    nodes = trie.prefix_nodes(trie.sequences(df), 100, 100)
    assert nodes.count() == 1 + 4990 + 40
    top = nodes.where("depth = 1").first()
    assert (top.n_convs, top.n_leaves, top.saved_tokens) == (4, 4, 3 * sum(len(str(i)) for i in range(4990)))


def test_ids_are_hashed_in_order_across_pieces(spark):
    df = spark.range(30_000).selectExpr("cast(id % 2 = 0 AS string) AS k", "id AS conv_id").selectExpr("encode(k, 'utf-8') AS key", "conv_id").repartition(5)
    want = {k: hashlib.sha256(",".join(str(i) for i in range(30_000) if (i % 2 == 0) == (k == b"true")).encode()).hexdigest() for k in (b"true", b"false")}
    assert {bytes(r.key): r.ends for r in trie.id_hashes(df).collect()} == want
