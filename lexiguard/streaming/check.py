"""The check over a stream of texts. It keeps no state, so each micro-batch stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from lexiguard.operators.detect import Lexicon
from lexiguard.plans.check import check_documents, responses


def read_texts(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def check_stream(texts: DataFrame, lexicon: Lexicon, stages: dict[str, bool] | None = None) -> DataFrame:
    return responses(check_documents(texts, lexicon, stages), lexicon)


def write_responses(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Exactly one answer a text: the file sink commits whole batches."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
