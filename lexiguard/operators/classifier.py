"""A sparse logistic classifier of contexts: features, scores, training and its metrics.

Features are rows (id, idx, val), so weights are joined like any table; a
model is the weights (idx, w) with a bias and a temperature. Weight tables hold
at most 2 ** 18 + 5 rows, which bounds what is sent to executors. For the check,
whose documents stay where they are, Dense has the same weights as one array
and scores a text for several surfaces at once.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lexiguard.functions.text import characters, fnv_index, quoted

DIM = 1 << 18
# Words that show talk about a term, talk against it, and contempt.
META = ("표현", "멸칭", "용어", "단어", "혐오", "차별", "비하", "보도", "보고서", "강의", "논문", "기사", "비판", "사례", "인용", "담론", "분석")
COUNTER = ("규탄", "반대", "낙인", "멈춰", "쓰지 말", "차별이", "혐오라", "용인", "비판받")
CONTEMPT = ("한심", "꼴", "역겹", "재수없", "병신", "주제에", "수준", "같은 것")
QUOTES = "'\"「『」』‘’“”"


def _grams(chars: Column, n: int) -> Column:
    """Runs of n characters; a shorter text is one run, an empty one none."""
    zipped = F.arrays_zip(*(F.slice(chars, i + 1, F.greatest(F.size(chars), F.lit(1))) for i in range(n)))
    whole = F.when(F.size(chars) > 0, F.array(F.array_join(chars, ""))).otherwise(F.array().cast("array<string>"))
    runs = F.transform(F.slice(zipped, 1, F.greatest(F.size(chars) - n + 1, F.lit(0))), lambda z: F.concat(*(z[str(i)] for i in range(n))))
    return F.when(F.size(chars) < n, whole).otherwise(runs)


def features(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, idx, val) for rows with text and surface: hashed runs of 2 and 3 characters, words and the surface, and five signs."""
    norm = F.regexp_replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", "")
    base = rows.select(id_col, norm.alias("t"), "surface").withColumn("chars", characters(F.translate("t", " ", "_")))
    spaces = lambda ns, tokens: F.transform(tokens, lambda x: F.struct(F.lit(ns).alias("ns"), x.alias("token")))
    words = F.array_remove(F.split("t", r"(?U)\s+"), "")
    tokens = F.concat(spaces("c2", _grams(F.col("chars"), 2)), spaces("c3", _grams(F.col("chars"), 3)), spaces("w", words), F.array(F.struct(F.lit("surf").alias("ns"), F.col("surface").alias("token"))))
    # Equal tokens are counted before they are hashed.
    counted = base.select(id_col, F.explode(tokens).alias("x")).groupBy(id_col, "x.ns", "x.token").agg(F.count(F.lit(1)).alias("n"))
    hashed = counted.groupBy(id_col, fnv_index(F.col("ns"), F.col("token")).alias("idx")).agg(F.sum("n").cast("double").alias("val"))
    has = lambda found: F.col("t").rlike("|".join(found))
    marks = "[" + QUOTES + "]"
    wrapped = F.regexp_like(F.col("t"), F.concat(F.lit(marks), quoted(F.col("surface")), F.lit(marks)))
    count = (F.length("t") - F.length(F.replace("t", "surface", F.lit("")))) / F.length("surface")
    signs = [has(META), has(COUNTER), has(CONTEMPT), wrapped, count >= 2]
    aux = base.select(id_col, F.explode(F.array(*(F.struct(F.lit(DIM + j).cast("long").alias("idx"), s.cast("double").alias("val")) for j, s in enumerate(signs)))).alias("a")).select(id_col, "a.idx", "a.val").where("val > 0")
    return hashed.unionByName(aux)


@dataclass
class Model:
    weights: DataFrame
    bias: float
    temperature: float = 1.0

    def score(self, rows: DataFrame, id_col: str = "id") -> DataFrame:
        """(id, score) for rows with text and surface."""
        return score(features(rows, id_col), rows.select(id_col), self.weights, self.bias, self.temperature, id_col)


    def dense(self) -> Dense:
        """The weights as an array, which passes through the driver."""
        w = np.zeros(DIM + 5)
        for r in self.weights.where(F.col("idx").between(0, DIM + 4)).collect():
            w[int(r["idx"])] += float(r["w"])
        return Dense(w, float(self.bias), float(self.temperature))


_WHITE = re.compile(r"\s+")


def _hashed(start: int, codes: np.ndarray, n: int) -> np.ndarray:
    """fnv_index() of all runs of n codes, from the hash of what stands before them."""
    h = np.full(max(0, len(codes) - n + 1), start, dtype=np.uint64)
    for i in range(n):
        h = ((h ^ codes[i : i + len(h)]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    return (h & np.uint64(DIM - 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _start(namespace: str) -> int:
    h = 2166136261
    for c in namespace + "\u001f":
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


class WordPlaces(dict):
    """The places of words seen so far, most of which come again; a bounded number is kept."""

    most = 1 << 18

    def __missing__(self, word: str) -> int:
        h = _start("w")
        for c in word:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        if len(self) >= self.most:
            self.clear()
        self[word] = h & (DIM - 1)
        return self[word]


@dataclass
class Dense:
    """A model for one text at a time, with the features of features()."""

    weights: np.ndarray
    bias: float
    temperature: float = 1.0

    def scores(self, text: str, surfaces: list[str], places: WordPlaces | None = None) -> list[float]:
        places = WordPlaces() if places is None else places
        t = text.replace("\n", " ").strip()
        codes, w = _codes(t.replace(" ", "_")), self.weights
        z = self.bias
        for n in (2, 3):
            start = _start(f"c{n}")
            runs = _hashed(start, codes, n) if len(codes) >= n else _hashed(start, codes, len(codes))[: len(codes)]
            z += float(w[runs].sum())
        for word, n in Counter(x for x in _WHITE.split(t) if x).items():
            z += n * float(w[places[word]])
        z += sum(float(w[DIM + j]) for j, found in enumerate((META, COUNTER, CONTEMPT)) if any(x in t for x in found))
        out = []
        for s in surfaces:
            own = z + float(w[_hashed(_start("surf"), _codes(s), len(s))[0]] if s else 0.0)
            if re.search(f"[{QUOTES}]{re.escape(s)}[{QUOTES}]", t):
                own += float(w[DIM + 3])
            if t.count(s) >= 2:
                own += float(w[DIM + 4])
            out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, own / self.temperature)))))
        return out


def score_rows(rows: DataFrame, model: Dense) -> DataFrame:
    """rows (text, surface, ...) with a column score, made where the rows are; null texts and surfaces are empty."""
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = WordPlaces()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                scores = [model.scores(t or "", [s or ""], places)[0] for t, s in zip(b.column("text").to_pylist(), b.column("surface").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], schema=to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def score(feats: DataFrame, ids: DataFrame, weights: DataFrame, bias: float, temperature: float = 1.0, id_col: str = "id") -> DataFrame:
    sums = feats.join(weights, "idx").groupBy(id_col).agg(F.sum(F.col("val") * F.col("w")).alias("z"))
    z = (F.lit(float(bias)) + F.coalesce("z", F.lit(0.0))) / F.lit(float(temperature))
    return ids.join(sums, id_col, "left").select(id_col, (1 / (1 + F.exp(-z))).alias("score"))


def _row_features(text: str, surface: str, word_places: WordPlaces | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The features of features() for one row, as sorted places and values."""
    word_places = WordPlaces() if word_places is None else word_places
    t = text.replace("\n", " ").strip()
    codes = _codes(t.replace(" ", "_"))
    found = [_hashed(_start(f"c{n}"), codes, min(n, len(codes))) for n in (2, 3) if len(codes)]
    found.append(np.array([word_places[w] for w in _WHITE.split(t) if w], np.int64))
    found.append(_hashed(_start("surf"), _codes(surface), len(surface)))
    signs = [any(x in t for x in words) for words in (META, COUNTER, CONTEMPT)]
    signs.append(bool(re.search(f"[{QUOTES}]{re.escape(surface)}[{QUOTES}]", t)))
    signs.append(bool(surface) and t.count(surface) >= 2)
    found.append(DIM + np.flatnonzero(signs))
    places, counts = np.unique(np.concatenate(found), return_counts=True)
    return places, counts.astype(float)


_BLOCK = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])


def text_blocks(rows: DataFrame) -> DataFrame:
    """(label, places, values) of rows (text, surface, label), made where the rows are. Rows without a text or label are left out; a null surface is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, places = to_arrow_schema(_BLOCK), WordPlaces()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                made = [_row_features(t, s or "", places) for t, s in zip(b.column("text").to_pylist(), b.column("surface").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([m[0] for m in made], arrow.field("places").type), pa.array([m[1] for m in made], arrow.field("values").type)], schema=arrow)

    return rows.where("text IS NOT NULL AND label IS NOT NULL").select("text", "surface", F.col("label").cast("int").alias("label")).mapInArrow(run, _BLOCK)


_PACKED = T.StructType([T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("values", T.BinaryType())])
#: Rows that are packed together.
PACKED_ROWS = 100


def packed(blocks: DataFrame) -> DataFrame:
    """Blocks (label, places, values) by PACKED_ROWS as plain bytes, which each round reads whole, not number by number. Values that all are small counts are kept as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(_PACKED)
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED_ROWS):
                b = batch.slice(at, PACKED_ROWS)
                values = np.asarray(b.column("values").flatten(), float)
                counts = np.clip(values, 0, 65535).astype(np.uint16)
                small = bool((counts == values).all())
                made = (np.asarray(b.column("places").value_lengths(), np.int32), np.asarray(b.column("places").flatten(), np.int32), counts if small else counts[:0], values[:0] if small else values)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("label").to_pylist()], arrow.field("labels").type), *(pa.array([x.tobytes()], pa.binary()) for x in made)], schema=arrow)

    return blocks.select("label", "places", "values").mapInArrow(run, _PACKED)


#: Partial gradients that the driver adds up itself; more are added up by tasks first.
MOST_PARTIALS = 32


def _gradient(blocks: DataFrame, w: np.ndarray, bias: float, share: dict[int, float]) -> np.ndarray:
    """The sum over all rows of the weighted error times the features, and of the error at the end. Every task sums its rows into one dense array."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((w, bias, share))
    out = T.StructType([T.StructField("task", T.LongType()), T.StructField("g", T.BinaryType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, share = sent.value
        g = np.zeros(len(w) + 1)
        task = TaskContext.get().partitionId()
        for b in batches:
            for i in range(b.num_rows):
                label = np.asarray(b.column("labels")[i].as_py(), float)
                sizes, places, counts, values = (np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in (("sizes", np.int32), ("places", np.int32), ("counts", np.uint16), ("values", float)))
                values = values if len(values) else counts
                row = np.repeat(np.arange(len(sizes)), sizes)
                z = bias + np.bincount(row, w[places] * values, len(sizes))
                error = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - label) * np.where(label == 1, share.get(1, 1.0), share.get(0, 1.0))
                g += np.bincount(places, error[row] * values, len(g))
                g[-1] += error.sum()
        yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([g.tobytes()], pa.binary())], schema=to_arrow_schema(out))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted(((t, g) for b in batches for t, g in zip(b.column("task").to_pylist(), b.column("g").to_pylist(), strict=True)), key=lambda x: x[0])
        if parts:
            total = np.zeros(len(np.frombuffer(parts[0][1])))
            for _, g in parts:
                total += np.frombuffer(g)
            yield pa.RecordBatch.from_arrays([pa.array([parts[0][0]]), pa.array([total.tobytes()], pa.binary())], schema=to_arrow_schema(out))

    parts = blocks.mapInArrow(partial, out)
    n = blocks.rdd.getNumPartitions()
    while n > MOST_PARTIALS:
        # A group holds MOST_PARTIALS arrays of the weights' size.
        n = -(-n // MOST_PARTIALS)
        parts = parts.repartition(n, F.floor(F.col("task") / MOST_PARTIALS)).mapInArrow(added, out).withColumn("task", F.floor(F.col("task") / MOST_PARTIALS))
    total = np.zeros(len(w) + 1)
    for r in sorted(parts.collect(), key=lambda r: r.task):
        total += np.frombuffer(r.g)
    sent.destroy()
    return total


#: Rounds after which the weights so far are written, to go on from after a failure.
SAVED_ROUNDS = 25


def descend(blocks: DataFrame, folder: str, rounds: int = 400, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Class-weighted logistic regression by full-batch descent from zero; the bias is not regularised. blocks: label, places, values.

    Blocks and, every few rounds, weights are written below folder, which
    driver and executors share. If it has them already, from a run that was cut
    short, that run goes on. A round is one pass over the blocks, with no join
    and no exchange but that of partial sums where tasks are many.
    """
    spark = blocks.sparkSession
    path = f"{folder}/packed"
    if not has_written(spark, path):
        packed(blocks).write.mode("overwrite").parquet(path)
    blocks = spark.read.schema(_PACKED).parquet(path)
    counts = {int(r[0]): int(r[1]) for r in blocks.select(F.explode("labels").alias("label")).groupBy("label").count().collect()}
    n = sum(counts.values())
    share = {y: n / (2 * c) for y, c in counts.items()}
    done, w, bias = 0, np.zeros(DIM + 5), 0.0
    for k in range(rounds - rounds % SAVED_ROUNDS, 0, -SAVED_ROUNDS):
        if has_written(spark, f"{folder}/round={k}"):
            saved = np.frombuffer(spark.read.parquet(f"{folder}/round={k}").first()["w"])
            done, w, bias = k, saved[:-1].copy(), float(saved[-1])
            break
    for k in range(done + 1, (rounds if n else 0) + 1):
        g = _gradient(blocks, w, bias, share) / n
        w, bias = w - rate * (g[:-1] + l2 * w), bias - rate * float(g[-1])
        if k % SAVED_ROUNDS == 0 and k < rounds:
            spark.createDataFrame([(np.append(w, bias).tobytes(),)], "w binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/round={k}")
    some = np.flatnonzero(w)
    return Model(spark.createDataFrame([(int(i), float(w[i])) for i in some] or [(-1, 0.0)], "idx long, w double"), bias)


def has_written(spark: SparkSession, path: str) -> bool:
    """Whether Spark has finished writing there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the one that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/lexiguard-files/{uuid.uuid4().hex}"


def fit(feats: DataFrame, labels: DataFrame, rounds: int = 400, rate: float = 0.5, l2: float = 1e-4, id_col: str = "id", folder: str | None = None) -> Model:
    """descend() for features (id, idx, val) and labels (id, label)."""
    lists = feats.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), "val"))).alias("x"))
    blocks = lists.join(labels, id_col).select(F.col("label").cast("int").alias("label"), F.col("x.i").alias("places"), F.col("x.val").alias("values"))
    return descend(blocks, folder or scratch(feats.sparkSession), rounds, rate, l2)


def fit_texts(rows: DataFrame, rounds: int = 400, rate: float = 0.5, l2: float = 1e-4, folder: str | None = None) -> Model:
    """descend() for rows (text, surface, label)."""
    return descend(text_blocks(rows), folder or scratch(rows.sparkSession), rounds, rate, l2)


def temperature(scored: DataFrame) -> DataFrame:
    """One row (t, nll): of 51 temperatures from 0.5 to 3.0 the first with the least mean loss. scored: z, label."""
    # Every row meets 51 values and is summed up before any exchange.
    p = F.greatest(F.least(1 / (1 + F.exp(-F.col("z") / F.col("t"))), F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = F.when(F.col("label") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
    by_t = scored.select("z", "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.lit(0.5) + i * F.lit(0.05))).alias("t")).groupBy("t").agg(F.avg(loss).alias("nll"))
    return by_t.agg(F.min(F.struct("nll", "t")).alias("x")).select("x.t", "x.nll")


def confusion_metrics(scored: DataFrame, at: float = 0.5) -> DataFrame:
    """accuracy, precision, recall and f1, each 0 where undefined, to four places. scored: score, label."""
    said, is_ = F.col("score") >= at, F.col("label") == 1
    c = lambda x: F.sum(x.cast("double"))
    s = scored.agg(c(said & is_).alias("tp"), c(said & ~is_).alias("fp"), c(~said & is_).alias("fn"), c(~said & ~is_).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    out = {"accuracy": safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": p, "recall": r, "f1": safe(2 * p * r, p + r)}
    return s.select(*(F.bround(v, 4).alias(k) for k, v in out.items()))


#: Quantiles that cut the scores into ranges.
RANGES = 1000


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve by mean ranks of ties; NaN with one class.

    Scores are summed up by value first, so ties never gather, and ranked in
    ranges between quantiles, so no task orders them all.
    """
    by_score = scored.groupBy("score").agg(F.sum(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    cuts = by_score.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts"))
    placed = by_score.crossJoin(F.broadcast(cuts)).select("score", "pos", "n", F.size(F.filter("cuts", lambda c: c < F.col("score"))).alias("range"))
    totals = placed.groupBy("range").agg(F.sum("n").alias("here"))
    before = totals.select("range", F.coalesce(F.sum("here").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = placed.withColumn("lower", lower).join(F.broadcast(before), "range").select("pos", "n", (F.col("before") + F.col("lower") + (F.col("n") + 1) / 2).alias("rank"))
    s = ranked.agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    return s.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).otherwise(F.lit(math.nan)).alias("auc"))


def stratified_split(rows: DataFrame, by: str = "surface", id_col: str = "id", share: float = 0.2, seed: int = 0) -> DataFrame:
    """rows with is_val: in each stratum max(1, round half even of share) rows by hash order, none of a single row."""
    size = F.count(F.lit(1)).over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col))
    n_val = F.when(size > 1, F.greatest(F.lit(1), F.bround(size * share, 0).cast("int"))).otherwise(0)
    return rows.withColumn("is_val", place <= n_val)
