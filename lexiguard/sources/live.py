"""Releases that change while checks run: one pointer, read once for each batch.

Releases lie side by side in a folder, and a small file names the one in use. A
new one is put in use by replacing that file in one step, so a reader sees the
old name or the new one. A batch reads the name once, at its start, checks all
its texts with that release, and writes the version to every row. A micro-batch
that is run again after a failure uses the version that it had pinned before.
A release that cannot be read here is refused: the last good one stays in use.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexiguard.operators.detect import Lexicon
from lexiguard.plans.check import check_documents, responses
from lexiguard.sources import files

POINTER = "current"
PINS = "_pins"


def _get_text(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()["value"].strip() if files.exists(spark, path) else None


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see all of it or what was there before."""
    made = f"{path}.{uuid.uuid4().hex}"
    files.put_text(spark, made, text)
    context = spark.sparkContext
    fs, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
    new, old = fs.Path(made), fs.Path(path)
    rename = getattr(context._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = context._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(new.getFileSystem(conf).getUri(), conf).rename(new, old, options)


class Releases:
    """The releases below a folder, each in one that has its version's name."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._loaded: dict[str, Lexicon] = {}
        self._good: str | None = None

    def publish(self, version: str) -> None:
        """Put a release in use that is there and can be read."""
        self.lexicon(version)
        _replace(self.spark, f"{self.root}/{POINTER}", version)

    def current(self) -> str | None:
        return _get_text(self.spark, f"{self.root}/{POINTER}")

    def lexicon(self, version: str) -> Lexicon:
        """A release is read once; it never changes. The last two stay loaded, so that batches of the old one can end."""
        if version not in self._loaded:
            self._loaded[version] = files.read_lexicon(self.spark, f"{self.root}/{version}")
            while len(self._loaded) > 2:
                self._loaded.pop(next(iter(self._loaded)))
        return self._loaded[version]

    def pin(self) -> str:
        """The version to use from here on: the current one, or the last good one if that cannot be read."""
        version = self.current()
        try:
            if version is None:
                raise ValueError("no release is in use")
            self.lexicon(version)
            self._good = version
        except ValueError as e:
            if self._good is None:
                raise
            warnings.warn(f"release {version} is refused: {e}; {self._good} stays in use", stacklevel=2)
        return self._good

    def pin_batch(self, folder: str, batch_id: int) -> str:
        """The version that a micro-batch has, pinned in the folder at its first run."""
        path = f"{folder}/{PINS}/{batch_id}"
        version = _get_text(self.spark, path)
        if version is None:
            version = self.pin()
            _replace(self.spark, path, version)
        return version


def check_pinned(docs: DataFrame, releases: Releases, stages: dict[str, bool] | None = None, version: str | None = None) -> DataFrame:
    """check_documents() with one release throughout, the current one unless a version is given, and release_version on every row."""
    version = version or releases.pin()
    return check_documents(docs, releases.lexicon(version), stages).withColumn("release_version", F.lit(version))


def write_live(texts: DataFrame, releases: Releases, folder: str, checkpoint: str, stages: dict[str, bool] | None = None) -> DataStreamWriter:
    """Answers to a stream of texts (doc_id, text), each micro-batch with the release in use when it began: doc_id, response, release_version.

    A batch is a folder of its own, so running it again replaces what it wrote.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        version = releases.pin_batch(folder, batch_id)
        answers = responses(check_pinned(batch, releases, stages, version), releases.lexicon(version))
        answers.withColumn("release_version", F.lit(version)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return texts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, response string, release_version string, batch bigint").option("basePath", folder).parquet(folder)
