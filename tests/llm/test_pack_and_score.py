"""Packing as an exact round trip, toxicity against plain neighbours and held-out labels, and the pipeline's stages."""

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiguard.llm import packing, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers

    plain, own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing.Encoder()
    rng, letters = random.Random(3), "ab'sSt'reÀÉßÿŒœŠž 0159.,!?%-_\n\t—’“<|>endoftext²½ªºµ×÷İıΣσς　\x85\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["<|endoftext|> a", "x" * 20_000, "it's we've I'll y'all", "", "名前 ひらがな", "é", "ﬁne"]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_every_id_is_in_one_piece(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1", "zz."]) for _ in range(rng.choice([0, 1, 30, 700, 9000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "same text"), (502, "same text"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, offset string")
    out = packing.pack(df).collect()
    encoder = packing.Encoder()
    ids = {i: np.append(np.frombuffer(encoder.encode([t or ""])[0], "<u4"), packing.END) for i, t in rows}
    seen: dict = {}
    for r in out:
        piece = ids[r.doc_id][r.start : r.start + r.length].astype("<u4")
        assert len(piece) == r.length > 0 and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(x) * (2 if i == 502 else 1) for i, x in ids.items()}
    sequences: dict = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.WINDOW and at & (at - 1) == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_neighbours_are_those_of_bm25():
    rng = random.Random(5)
    docs = [np.array([rng.randrange(60) for _ in range(rng.randint(1, 25))], dtype=np.uint32) for _ in range(40)]
    index, n, mean = packing.Index(docs), 40, np.mean([len(d) for d in docs])
    for q in range(5):
        score = np.zeros(n)
        for t in set(docs[q].tolist()):
            df = sum(t in d for d in docs)
            idf = max(0.0, np.log((n - df + 0.5) / (df + 0.5)))
            for j, d in enumerate(docs):
                tf = int((d == t).sum())
                score[j] += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if tf else 0
        used = np.zeros(n, dtype=bool)
        used[q] = True
        got = index.neighbours(q, used)
        assert set(got) == {j for j in range(n) if score[j] > 0 and j != q}
        assert (np.diff(score[got]) <= 1e-9).all()


def test_search_is_exact():
    rng = random.Random(1)
    rows = []
    for d in range(3000):
        v = {rng.randrange(150): rng.randint(1, 3) for _ in range(rng.randint(1, 9))}
        rows.append((d, int(rng.random() < 0.3), list(v), list(v.values())))
    idf = np.random.default_rng(0).uniform(1, 5, 150)
    index = toxicity.Index.build(idf, rows, (1.0, 1.0))
    place = {int(d): i for i, d in enumerate(index.example_ids)}
    dense = np.zeros((3000, 150))
    for d, _, ids, counts in rows:
        dense[place[d], ids] = np.log1p(counts) * idf[ids]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for d, _, ids, counts in rows[:200]:
        near = index.neighbours(dict(zip(ids, counts, strict=True)))
        assert np.allclose([s for _, s in near], np.sort(dense @ dense[place[d]])[::-1][: toxicity.K])
        assert all(np.isclose(dense[j] @ dense[place[d]], s) for j, s in near)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score_documents(docs, labels)
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([np.mean([(p > n) + 0.5 * (p == n) for n in neg]) for p in pos]) > 0.9
    assert np.mean([n >= 0.5 for n in neg]) < 0.1


def test_toxicity_of_odd_tables(spark):
    texts = [(i, f"plain words number{'abc'[i % 3]} here") for i in range(40)] + [(100 + i, "plain nasty words here") for i in range(40)] + [(200, None), (201, ""), (202, "nasty"), (202, "nasty"), (None, "nasty")]
    docs = spark.createDataFrame([(*t, "q", 5) for t in texts], "doc_id long, text string, mark string, term int")
    marks = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)] + [(100, 1), (7, None), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[202].predicted == 1 and by[200].score == by[201].score < 0.5 and by[5].predicted == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(40)) | {200, 201}
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Scores and leaks from a folder in which workers cannot import the package."""
    repo = Path(__file__).resolve().parents[2]
    (tmp_path / "run.py").write_text(f"""
import sys
sys.path.append({str(repo)!r})
from pyspark.sql import SparkSession
from lexiguard.llm import decontaminate, toxicity
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(i, "nasty one" if i % 2 else "plain one two three four five") for i in range(40)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
print("rows", toxicity.score_documents(docs, labels).count(), toxicity.drop_toxic(docs, labels).count(), decontaminate.find_leaks(docs, items).count(), decontaminate.drop_leaks(docs, items).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 40 20 20 20" in out.stdout, out.stderr[-2000:]


def test_scores_do_not_depend_on_ids(spark):
    rng = random.Random(6)
    texts = [f"{rng.choice(['plain', 'calm'])} words {rng.choice('abc')} here" for _ in range(40)] + [f"nasty {rng.choice(['mean', 'rude'])} words" for _ in range(40)]
    scores = []
    for shift in (0, 7_000_000):
        # Ids whose remainder keeps every row in the sample.
        ids = [i for i in range(shift, shift + 1000) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
        order = ids if not shift else ids[::-1]
        docs = spark.createDataFrame(list(zip(order, texts, strict=True)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(t.startswith("nasty"))) for i, t in zip(order, texts, strict=True)], "doc_id long, toxic int")
        scored = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
        scores.append([round(scored[i], 12) for i in order])
    assert scores[0] == scores[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_on_their_own_inputs(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, docs = docs, corpus_pipeline.written(out)
        sizes.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes == sorted(sizes, reverse=True) and 0.7 * sizes[0] < sizes[-1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t").count() == 0
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_catches_what_was_planted(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, item, copy = prose(60), prose(40), prose(120)
    rows = [(i, prose(100)) for i in range(60)]
    rows += [(100 + i, prose(60) + " nastyword " + prose(40) + " nastyword") for i in range(60)]
    rows += [(200 + i, prose(70) + "\n" + passage + "\n" + prose(50)) for i in range(5)]
    rows += [(300, copy), (301, copy), (302, copy + " end")]
    rows += [(400, prose(50) + " " + item + " " + prose(20))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(100 + i, 0, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r[0]: r[1] for r in corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.max("doc_tokens")).collect()}
    assert set(kept) == set(range(60)) | set(range(200, 205)) | {300}


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    long = prose(30_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, prose(40)), (5, long), (6, long), (7, "same words stay here now"), (7, "same words stay here now"), (8, prose(50)), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k string, template long, rep long"
    docs = spark.createDataFrame([(i, t, None, None, None, "k", 1, 2) for i, t in rows], schema)
    for name, df in (("full", docs), ("empty", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(8, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x y"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/full").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    # Blank documents stay, of the copies the first one does; rows that share an id stay together.
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 5, 7, 8}
    assert {r.doc_id: r.n for r in packed}[1] == 1 and corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
