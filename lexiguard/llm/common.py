"""What the corpus operators share: table access, shared-folder tables, span digests."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bits of what sifted() sends.
SIFTED_BITS = 1 << 25
#: Keys that may be sent to all executors because each has more than this part of the rows.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a temporary one where all run on one machine; elsewhere an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = tempfile.mkdtemp(prefix="lexiguard-")
        spark.sparkContext.setCheckpointDir(set_dir)
        set_dir = spark.sparkContext.getCheckpointDir()
    return f"{set_dir.rstrip('/')}/lexiguard-{spark.sparkContext.applicationId}"


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of value, with its classes, so that workers need no copy of this package. A task calls the result once."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


_roots: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder then belongs to whoever cleans the shared one
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read again from there when an executor is lost."""
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files behind a written() table that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        if "/lexiguard-" in f:
            _remove(df.sparkSession, f.rsplit("/", 1)[0])


def join_spread(rows: DataFrame, one: DataFrame, key: str, count: str = "n_rows", how: str = "inner") -> DataFrame:
    """rows joined with one, which has a row for each key and how many of rows have it, in the column count, which goes.

    Keys of more than a HOT-th of all rows, at most HOT of them, are sent to all
    executors, so that no task gets all rows of such a key. The others are
    hashed, which spares sorting rows. Both are read several times. Null keys
    match nothing.
    """
    total = one.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) > max(1000, total // HOT)
    hot, cold = one.where(is_hot).drop(count), one.where(~is_hot).drop(count)
    names = hot.select(F.col(key).alias("_lexiguard_hot"))
    spread = rows.join(F.broadcast(hot), key)
    return spread.unionByName(rows.join(F.broadcast(names), F.col(key) == F.col("_lexiguard_hot"), "left_anti").join(cold.hint("shuffle_hash"), key, how))


def sifted(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key may be among the wanted ones, to be joined with them: all that are, and few of the others.

    It spares shuffling rows, whole texts say, that would meet nothing. What is
    sent to all executors is a bit for each of SIFTED_BITS hashes, 4 MB at most
    however many keys there are. wanted is read once more, so it should be a
    written table.
    """
    place = lambda k: F.pmod(F.xxhash64(F.lit(1), F.col(k)), F.lit(SIFTED_BITS)) + 1
    bits = wanted.select(place(wanted_key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_lexiguard_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_lexiguard_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_lexiguard_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_lexiguard_bucket", F.bitmap_bucket_number(place(key))).join(F.broadcast(bits), "_lexiguard_bucket")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _give_back() -> None:
    """Hand what a finished task has freed back to the system: the Python worker stays, and the executor's next tasks need the memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: T.StructType | str) -> DataFrame:
    """fn over the tuples of a partition, in and out by Arrow batches; rows stream, so a partition need not fit in memory."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        kept: list[tuple] = []
        size = 0
        for row in fn(rows()):
            kept.append(row)
            size += 1 + sum(len(x) for x in row if isinstance(x, (str, bytes, list))) // 64
            if size >= 200_000 or len(kept) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), arrow, strict=True)], schema=arrow)
                kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), arrow, strict=True)], schema=arrow)
        kept = []
        _give_back()

    assert names
    return df.select(*columns).mapInArrow(run, out)


def filter_rows(df: DataFrame, column: str, keep: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """Rows whose value the predicate keeps, with all columns; keep() is called once a task and returns the predicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keep()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield part.filter(pa.array([wanted(x) for x in part.column(column).to_pylist()], pa.bool_()))
        _give_back()

    return df.mapInArrow(run, df.schema)


Span = tuple[str, int, int]


def spans_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def spans_sha(spans: Iterable[Span]) -> str:
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()


def row_count(df: DataFrame) -> int:
    return int(df.agg(F.count(F.lit(1))).first()[0])
