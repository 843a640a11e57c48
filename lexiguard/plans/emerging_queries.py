"""Registered query: words outside the lexicon that come up in a week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiguard.operators import emerging
from lexiguard.plans.registry import query, table


@query(r"""WITH t AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS ws FROM documents JOIN events ON event_id = doc_id * 10),
w AS (SELECT week, unnest(ws) AS word FROM t), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM benchmark),
c AS (SELECT week, word, count(*) AS n FROM w GROUP BY ALL), a AS (SELECT word, sum(n) AS n FROM c GROUP BY word), s AS (SELECT week, count(*) AS size FROM t GROUP BY week),
r AS (SELECT c.week, c.word, c.n AS n_texts, CAST(a.n - c.n AS BIGINT) AS n_other, s.size * (a.n - c.n + 1.0::DOUBLE) / ((SELECT sum(size) FROM s) - s.size + 1) AS e FROM c JOIN a ON a.word = c.word JOIN s ON s.week = c.week WHERE c.n >= 5 AND c.word NOT IN (SELECT word FROM k))
SELECT week, word, n_texts, n_other, round((n_texts - e) / sqrt(e), 6) AS score FROM r WHERE (n_texts - e) / sqrt(e) >= 3""")
def emerging_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A document is as old as the event of ten times its number, so all weeks have some; the benchmark's words are the known ones.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("tenth"), F.col("ts").alias("at")), F.col("tenth") == F.col("doc_id") * 10)
    known = table(spark, sf_dir, "benchmark").select(F.explode(emerging.words_of(F.col("text"))).alias("word"))
    return emerging.bursts(docs, known).withColumn("score", F.round("score", 6))
