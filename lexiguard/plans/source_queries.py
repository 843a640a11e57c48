"""Registered queries that write and read files. Their tables are small ones of their own, in a new folder each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiguard.operators import classifier, release
from lexiguard.plans.inline import Inline, sql_value
from lexiguard.plans.queries import CANDIDATES, CATEGORY, RULE, TERM_CATEGORY, TERM_ROWS, VARIANT
from lexiguard.plans.registry import query, table
from lexiguard.sources import files

_TERMS_SQL = f"""{TERM_ROWS.sql}, {VARIANT.sql}, rel AS (SELECT * FROM tm WHERE status IN ('active', 'watchlist') AND release_policy NOT IN ('internal_only', 'hold_legal'))"""


def _released(spark: SparkSession) -> tuple[str, dict]:
    """A release of the fixture's terms: its folder and manifest."""
    terms = TERM_ROWS.df(spark).withColumns({"pattern": F.lit(None).cast("string"), "safe_contexts": F.array().cast("array<string>")})
    nested = release.nested_terms(terms, TERM_CATEGORY.df(spark), CATEGORY.df(spark), VARIANT.df(spark), RULE.df(spark))
    folder = files.scratch(spark)
    return folder, files.write_release(nested, folder, "2026.06.08-1")


@query(f"WITH {_TERMS_SQL} SELECT term_id, surface, severity, (SELECT count(*) FROM vr WHERE vr.term_id = rel.term_id AND verified) AS n_variants, release_policy = 'advisory_only' AS dogwhistle FROM rel")
def s1_load_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = _released(spark)
    files.read_lexicon(spark, folder)  # fails if it was built with another normaliser
    return files.read_terms(spark, folder).select(F.col("term_id").cast("int").alias("term_id"), "surface", "severity", F.size("variants").cast("long").alias("n_variants"), F.col("is_dogwhistle_marker").alias("dogwhistle"))


@query(f"WITH {_TERMS_SQL} SELECT '2026.06.08-1' AS version, (SELECT count(*) FROM rel) AS term_count, (SELECT count(*) FROM vr JOIN rel USING (term_id) WHERE verified) AS variant_count, 'terms,user_dict' AS checksums")
def s9_release_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = _released(spark)
    m = spark.read.schema(files.MANIFEST).json(f"{folder}/manifest")
    return m.select(F.col("release_version").alias("version"), "term_count", "variant_count", F.array_join(F.array_sort(F.map_keys(F.map_filter("checksums", lambda _, v: F.length(v) == 64))), ",").alias("checksums"))


LINES = Inline("ln", "line string", [("sea\tNNP\t1.5",), ("",), ("# note",), ("sky",), ("  ",), ("star\t",), ("one two\tNNG\tx",)])


@query("SELECT * FROM (VALUES ('sea', 'NNP', CAST(1.5 AS DOUBLE)), ('sky', 'NNP', NULL), ('star', 'NNP', NULL), ('one two', 'NNG', NULL)) t(form, tag, score)")
def s2_user_dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch(spark)
    files.put_text(spark, f"{folder}/user.tsv", "\n".join(r[0] for r in LINES.rows))
    return files.read_user_dictionary(spark, f"{folder}/user.tsv")


JSON_LINES = ['{"id":1,"text":"a","expected":["x","y"]}', "", "   ", '{"id":2,"text":"b","expected":[]}']


@query("SELECT * FROM (VALUES (1, 'a', 'x,y'), (2, 'b', '')) t(id, text, expected)")
def s3_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch(spark)
    files.put_text(spark, f"{folder}/golden.jsonl", "\n".join(JSON_LINES))
    rows = files.read_json_lines(spark, f"{folder}/golden.jsonl", "id int, text string, expected array<string>")
    return rows.select("id", "text", F.array_join("expected", ",").alias("expected"))


def _candidate_files(spark: SparkSession) -> DataFrame:
    folder = files.scratch(spark)
    texts = {"c/b.json": CANDIDATES.rows[0][1], "c/deep/a.json": CANDIDATES.rows[2][1], "c/deep/broken.json": "{oops", "c/list.json": "[1]", "c/notes.txt": "no", "named.candidate": CANDIDATES.rows[1][1]}
    for name, text in texts.items():
        files.put_text(spark, f"{folder}/{name}", text)
    found = files.read_candidates(spark, [f"{folder}/c", f"{folder}/named.candidate", f"{folder}/gone.json"])
    return found.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))


@query("SELECT * FROM (VALUES ('b.json'), ('a.json'), ('broken.json'), ('list.json'), ('named.candidate'), ('gone.json')) t(file)")
def s4_discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_files(spark).select("file")


@query(f"SELECT * FROM (VALUES ('b.json', '', {sql_value('new_term:abc ㄱㅏ')}), ('a.json', 'negative_examples', {sql_value('new_term:abc ㄱㅏ')}), ('broken.json', 'not a JSON object', ''), ('list.json', 'not a JSON object', ''), ('named.candidate', '', {sql_value('new_term:abc ㄱㅏ')}), ('gone.json', 'no such file', '')) t(file, errors, dedup_key)")
def s5_candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_files(spark).select("file", F.array_join("errors", ",").alias("errors"), F.coalesce("dedup_key", F.lit("")).alias("dedup_key"))


@query("SELECT item_id AS id, round(1 / (1 + exp(-(CAST(0.25 AS DOUBLE)) / 2)), 6) AS score FROM benchmark")
def s11_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.scratch(spark)
    files.write_model(classifier.Model(spark.createDataFrame([(-1, 1.0)], "idx long, w double"), 0.25, 2.0), folder)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("the").alias("surface"))
    return files.read_model(spark, folder).score(rows).select("id", F.round("score", 6).alias("score"))


_ACCESS = "SELECT n_name, count(*) AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS n_negative FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query(f"SELECT n_name, n, CAST(n_negative AS BIGINT) AS n_negative FROM ({_ACCESS})")
def s13_sql_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.register_tables(spark, sf_dir, ("customer", "nation"))
    return spark.sql(_ACCESS)
