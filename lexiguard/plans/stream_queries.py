"""Registered queries that run streams over given tables, and checks with releases that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiguard.plans.queries import ONLY_KEYS
from lexiguard.plans.registry import query, table
from lexiguard.sources import files, live
from lexiguard.streaming import feedback

#: Files, and so micro-batches, that a table is streamed in.
STREAM_FILES = 4
_SUBMITTED_SQL = "s AS (SELECT event_id // 3 AS feedback_id, ts, 'check ' || user_id AS check_id, event_type AS verdict FROM events), b AS (SELECT feedback_id, min(struct_pack(ts := ts, check_id := check_id, verdict := verdict)) AS x FROM s GROUP BY feedback_id)"


def _events_as_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each three events are submissions of one id."""
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("feedback_id"), F.col("ts").alias("at"), F.concat(F.lit("check "), F.col("user_id").cast("string")).alias("check_id"), F.col("event_type").alias("verdict"), F.lit(None).cast("string").alias("note"))


@query(f"WITH {_SUBMITTED_SQL} SELECT feedback_id, strftime(x.ts, '%Y-%m-%d %H:%M:%S.%f') AS submitted_at, x.check_id AS check_id, x.verdict AS verdict FROM b")
def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as submissions, streamed out of order in a few micro-batches; what is kept is the same as of the table."""
    folder = files.scratch(spark)
    rows = _events_as_feedback(spark, sf_dir)
    rows.repartition(STREAM_FILES, F.xxhash64("at", "check_id")).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(feedback.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    feedback.start(feedback.intake(source), f"{folder}/out", f"{folder}/state", availableNow=True).awaitTermination()
    kept = feedback.kept(spark, f"{folder}/out")
    return kept.select("feedback_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("submitted_at"), "check_id", "verdict")


@query(f"WITH {_SUBMITTED_SQL}, q AS (SELECT DISTINCT 'feedback:' || (event_id // 3) AS dedup_key FROM events WHERE user_id % 2 = 0) SELECT 'feedback:' || feedback_id AS dedup_key, x.check_id AS check_id, x.verdict AS verdict FROM b WHERE 'feedback:' || feedback_id NOT IN (SELECT dedup_key FROM q)")
def feedback_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the review queue does not have yet; ids that a user of even number sent are in it."""
    rows = _events_as_feedback(spark, sf_dir)
    there = feedback.queue_items(rows.join(table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.floor(F.col("event_id") / 3).alias("feedback_id")).distinct(), "feedback_id"))
    return feedback.queued(feedback.settled(rows), there).select("dedup_key", "check_id", "verdict")


_RELEASES = {"1": ("and", "from", "reing"), "2": ("from", "der", "que", "atble")}
_RELEASE_SQL = "rel(version, surface) AS (VALUES " + ", ".join(f"('{v}', '{w}')" for v, ws in _RELEASES.items() for w in ws) + ")"


def _write_releases(spark: SparkSession) -> live.Releases:
    root = files.scratch(spark)
    for version, words in _RELEASES.items():
        rows = [(i, w, "word", None, w, 4, "unambiguous", "active", "open", [], [], False, [], []) for i, w in enumerate(words, 1)]
        files.write_release(spark.createDataFrame(rows, files.TERMS), f"{root}/{version}", version)
    return live.Releases(spark, root)


@query(f"WITH {_RELEASE_SQL}, h AS (SELECT doc_id, version, surface, len(string_split(lower(text), surface)) - 1 AS n FROM documents JOIN rel ON version = CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '2' END) SELECT doc_id, version AS release_version, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM h GROUP BY ALL")
def live_release_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed in two runs of one query, the release swapped between them: even ids with the first, odd ones with the second."""
    releases, folder = _write_releases(spark), files.scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for version, part in (("1", 0), ("2", 1)):
        docs.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        releases.publish(version)
        texts = spark.readStream.schema("doc_id bigint, text string").parquet(f"{folder}/in")
        live.write_live(texts, releases, f"{folder}/out", f"{folder}/state", ONLY_KEYS).trigger(availableNow=True).start().awaitTermination()
    return live.read_answers(spark, f"{folder}/out").select("doc_id", "release_version", F.get_json_object("response", "$.debug.match_count").cast("long").alias("n"))
