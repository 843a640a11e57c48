"""Fill-in-middle against a plain version, and its bit vectors against plain counts."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexiguard.llm import middle


def plain(doc_id, text, seed=7, plain_percent=0, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_bit_vectors_count_and_find():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        for share in (0, 0.01, 0.5, 1):
            bits = rng.random(size) < share
            vector = middle.BitVector(bits)
            places = np.arange(size + 1)
            assert vector.rank(places).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
            ones = np.flatnonzero(bits)
            assert vector.select(np.arange(len(ones))).tolist() == ones.tolist()


def odd_texts():
    rng = random.Random(5)
    parts = ["a", "\n", "\r\n", "é", "한국", "😀", "<", "<P", "P>", " ", " ", "\x00", "<S"]
    texts = [None, "", "\n", "\n\n\n", "x", "a\nb", "<P>", "a<S>b\n", "ab\n<M>", "<\nP>", "x" * 200_000, "ä\n" * 70_000]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(700)]


def test_texts_are_cut_as_by_the_plain_version(spark):
    rows = [(None if i == 3 else i, t, "form", 9) for i, t in enumerate(odd_texts())] + [(40, "a\nb\nc", "f", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    for options in ({}, {"seed": 3, "plain_percent": 40, "spm_percent": 80}):
        cut = middle.fill_in_middle(df, **options)
        assert cut.columns == ["doc_id", "text", *middle.RESULTS.names]
        got = cut.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, **options)
            assert r.back == (r.text or "")
    assert middle.fill_in_middle(df.limit(0)).count() == 0


def test_the_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from lexiguard.llm.queries import op13_fill_in_middle

    texts = [t for t in odd_texts() if t is None or "\x00" not in t]
    spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().sql(middle.MIDDLE_SQL.replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')"))
    got = op13_fill_in_middle(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got)
