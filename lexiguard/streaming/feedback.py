"""Feedback on checks, taken in from a stream and kept once each.

Clients send a submission again until it is confirmed, so the same id comes
several times, out of order, and sometimes very late. A state holds the best
submission of each id so far, the earliest, so only a better one goes on. It is
forgotten once the watermark has passed it by the lateness that is allowed. Ids
share states by a hash, so Python is called once a bucket, not once an id.
Submissions behind the watermark go on too, marked late: what they repeat may be
forgotten already. Every micro-batch is one folder, written over if it is run
again. What is kept of an id is the best of all that went on, which is the best
of all that came, so the result does not depend on order, batches or restarts;
only the mark of lateness does.

Submissions without an id or a time are in no state; they are kept apart as
malformed(). A null of another column sorts before other values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiguard.operators import curation

COLUMNS = ("feedback_id", "at", "check_id", "verdict", "note")
SCHEMA = "feedback_id bigint, at timestamp, check_id string, verdict string, note string"
LATENESS = "2 hours"
#: Milliseconds after which a state that nothing came for is looked at.
LOOK_AGAIN_MS = 600_000
#: States that ids are dealt to.
BUCKETS = 256
#: What a state holds of an id, the time in microseconds; with the lateness, what goes on.
_HELD = ("feedback_id", "us", *COLUMNS[2:])
_TOLD = "feedback_id bigint, us bigint, check_id string, verdict string, note string, late boolean"
_ARROW = pa.schema([("feedback_id", pa.int64()), ("us", pa.int64()), *((c, pa.string()) for c in COLUMNS[2:])])


def usable() -> Column:
    return F.col("feedback_id").isNotNull() & F.col("at").isNotNull()


def malformed(feedback: DataFrame) -> DataFrame:
    return feedback.where(~usable())


def settled(feedback: DataFrame) -> DataFrame:
    """One row an id, the earliest; the batch form of what the stream keeps."""
    best = feedback.where(usable()).groupBy("feedback_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("best"))
    return best.select("feedback_id", "best.*")


def _rank(row: tuple) -> tuple:
    """The order of settled(): by time, then the other columns, null first."""
    return tuple((x is not None, x if x is not None else "") for x in row)


def _plain(x: Any) -> Any:
    return None if x is None or x is pd.NaT or isinstance(x, float) and pd.isna(x) else x


def keep_best(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, lateness_ms: int) -> Iterator[pd.DataFrame]:
    """Submissions of one id that are better than all before them, and whether they are late."""
    watermark = state.getCurrentWatermarkMs()
    if state.hasTimedOut:
        (at, *_) = state.get
        if watermark > at.timestamp() * 1000 + lateness_ms:
            state.remove()
        else:
            state.setTimeoutDuration(LOOK_AGAIN_MS)
        return
    best = tuple(map(_plain, state.get)) if state.exists else None
    out = []
    for part in parts:
        for row in part[list(COLUMNS[1:])].itertuples(index=False, name=None):
            row = tuple(map(_plain, row))
            if best is None or _rank(row) < _rank(best):
                best = row
                # Of what comes together, only the last to be better is needed, but each says for itself whether it is late.
                out.append((*key, *row, row[0].timestamp() * 1000 < watermark))
    if best is not None:
        state.update(best)
        state.setTimeoutDuration(LOOK_AGAIN_MS)
    if out:
        yield pd.DataFrame(out[-1:], columns=[*COLUMNS, "late"])


def earliest(rows: pd.DataFrame) -> pd.DataFrame:
    """The best row of each id, in the order of settled(), of rows (_HELD, ...); of equal rows the first."""
    first = rows[rows["us"].to_numpy() == rows.groupby("feedback_id")["us"].transform("min").to_numpy()]
    if first["feedback_id"].duplicated().any():
        first = first.sort_values(list(COLUMNS[2:]), na_position="first", kind="stable").drop_duplicates("feedback_id")
    return first


def _packed(rows: pd.DataFrame) -> bytes:
    held = pa.Table.from_pandas(rows[list(_HELD)], _ARROW, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ARROW) as out:
        out.write_table(held)
    return sink.getvalue().to_pybytes()


def keep_best_of_bucket(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, lateness_ms: int) -> Iterator[pd.DataFrame]:
    """keep_best() for all ids of a bucket at once. parts: _HELD; of each id at most one row goes on at a time."""
    watermark = state.getCurrentWatermarkMs()
    best = pa.ipc.open_stream(state.get[0]).read_pandas().assign(new=False) if state.exists else None
    if not state.hasTimedOut:
        # What a part adds is taken in before the next is read.
        for part in parts:
            rows = part[list(_HELD)].assign(new=True)
            best = earliest(rows if best is None else pd.concat([best, rows], ignore_index=True))
        better = best[best["new"]]
        if len(better):
            yield better.drop(columns="new").assign(late=better["us"] < watermark * 1000)
    held = best[best["us"] + lateness_ms * 1000 >= watermark * 1000] if best is not None else ()
    if len(held):
        if not state.hasTimedOut or len(held) < len(best):
            state.update((_packed(held),))
        state.setTimeoutDuration(LOOK_AGAIN_MS)
    elif state.exists:
        state.remove()


def intake(stream: DataFrame, lateness: str = LATENESS, buckets: int | None = BUCKETS) -> DataFrame:
    """What goes on of a stream of submissions: SCHEMA, late. Without buckets each id has a state of its own, and a call of Python a batch."""
    lateness_ms = int(pd.Timedelta(lateness).total_seconds() * 1000)
    rows = stream.where(usable()).select(*COLUMNS).withWatermark("at", lateness)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return keep_best(key, parts, state, lateness_ms)

    def run_bucket(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return keep_best_of_bucket(key, parts, state, lateness_ms)

    # Timeouts by the clock, as those by event time would drop late rows before they are seen.
    if buckets is None:
        return rows.groupBy("feedback_id").applyInPandasWithState(run, f"{SCHEMA}, late boolean", SCHEMA.split(", ", 1)[1], "append", GroupStateTimeout.ProcessingTimeTimeout)
    dealt = rows.withColumn("us", F.unix_micros("at")).withColumn("bucket", F.pmod(F.xxhash64("feedback_id"), F.lit(buckets)).cast("int"))
    told = dealt.groupBy("bucket").applyInPandasWithState(run_bucket, _TOLD, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return told.select("feedback_id", F.timestamp_micros("us").alias("at"), *COLUMNS[2:], "late")


#: With this on, a query that has timeouts by the clock makes empty batches for ever and never ends by itself.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def start(stream: DataFrame, folder: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Write each micro-batch of intake() to a folder of its own: a batch that is run again is written over. trigger: as of DataStreamWriter.trigger()."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    spark = stream.sparkSession
    before = spark.conf.get(EMPTY_BATCHES, "true")
    # A query keeps the settings that it was started with.
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "0 seconds"})).start()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """One row an id of what was written so far, and whether all that is known of it came late."""
    rows = spark.read.schema(f"{SCHEMA}, late boolean, batch bigint").option("basePath", folder).parquet(folder)
    best = rows.groupBy("feedback_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("best"), F.every("late").alias("late"))
    return best.select("feedback_id", "best.*", "late")


def queue_items(feedback: DataFrame) -> DataFrame:
    """Feedback as items for the review queue, which takes each key once."""
    return feedback.select(F.concat(F.lit("feedback:"), F.col("feedback_id").cast("string")).alias("dedup_key"), F.lit("feedback").alias("kind"), "check_id", "verdict", "note", "at")


def queued(feedback: DataFrame, queue: DataFrame) -> DataFrame:
    """Items of feedback that the queue (dedup_key, kind, ...) does not have yet; putting them in twice changes nothing."""
    return curation.insert_new(queue_items(feedback), queue, order="at")
