"""Documented extras on vectors and bit patterns: nearest images by perceptual hash, nearest embeddings.

Both are exact searches over inverted lists. Hashes that are close as a whole
are close in one of their blocks, so images are posted under the value of each
block, and a reference looks up every value near enough to its own. Vectors are
posted once, in the cell of the nearest of some centres, and a reference goes
to the cells that could hold a neighbour: the others are proved too far away.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HASH_BITS = 64
BLOCK_BITS = 16
HASH_RADIUS = 8
COSINE = 0.92


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(v: Column, n_bits: int = HASH_BITS) -> Column:
    """Bits that tell which of a vector's first n_bits numbers are positive, the first the lowest. A null vector has none."""
    bits = F.transform(F.slice(v, 1, n_bits), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")).alias("b"))
    return F.coalesce(F.aggregate(F.reverse(bits), F.expr("0L"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b)), F.expr("0L"))


def _hash_block(column: str, block: int) -> Column:
    return F.shiftrightunsigned(column, BLOCK_BITS * block).bitwiseAND((1 << BLOCK_BITS) - 1)


def _nearby(width: int, radius: int) -> list[int]:
    """All patterns of so many bits with at most radius of them set."""
    return [sum(1 << i for i in places) for n in range(radius + 1) for places in itertools.combinations(range(width), n)]


def _reaches(radius: int, blocks: int) -> list[int]:
    """How far from its own value each block is looked up: radius + 1 dealt to the blocks, less 1 each. At -1, a block is left out."""
    return [(radius + blocks - i) // blocks - 1 for i in range(blocks)]


def near_hashes(images: DataFrame, references: DataFrame, radius: int = HASH_RADIUS, n_bits: int = HASH_BITS) -> DataFrame:
    """(image_id, marker_id, distance) within the radius. images: image_id, phash; references: marker_id, phash (n_bits, a multiple of BLOCK_BITS; higher bits are 0).

    Two hashes within the radius are within a block's reach in one of the
    blocks: beyond it in each, they would differ in the sum of reach + 1, which
    is radius + 1. Images are posted once a block; a reference looks up each
    value that few flipped bits away. A pair counts where it first meets, so none
    is found twice. Equal hashes are one from the start, and are told apart at
    the end. Both sides look small to Spark before they are dealt out, a
    reference into thousands of rows, so neither may be broadcast.
    """
    blocks = range(n_bits // BLOCK_BITS)
    reaches = _reaches(radius, len(blocks))
    masks = F.array(*(F.array(*map(F.lit, _nearby(BLOCK_BITS, r))) for r in reaches))
    posts = images.where("phash IS NOT NULL").select(F.col("phash").alias("image_hash")).distinct()
    asked = references.where("phash IS NOT NULL").select(F.col("phash").alias("marker_hash")).distinct()
    posts = posts.select("image_hash", F.posexplode(F.array(*(_hash_block("image_hash", i) for i in blocks))).alias("block", "bits"))
    asked = asked.select("marker_hash", F.posexplode(F.array(*(_hash_block("marker_hash", i) for i in blocks))).alias("block", "own"))
    asked = asked.select("marker_hash", "block", F.explode(F.transform(F.get(masks, F.col("block")), lambda m: m.bitwiseXOR(F.col("own")))).alias("bits"))
    met = posts.join(asked.hint("merge"), ["block", "bits"])
    distance = hamming(F.col("image_hash"), F.col("marker_hash"))
    meets = [hamming(_hash_block("image_hash", i), _hash_block("marker_hash", i)) <= r for i, r in enumerate(reaches)]
    first = F.coalesce(*(F.when(m, F.lit(i)) for i, m in enumerate(meets)))
    near = met.where((distance <= radius) & (first == F.col("block"))).select("image_hash", "marker_hash", distance.alias("distance"))
    named = near.join(references.select("marker_id", F.col("phash").alias("marker_hash")), "marker_hash").join(images.select("image_id", F.col("phash").alias("image_hash")), "image_hash")
    return named.select("image_id", "marker_id", "distance")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Centres at most, vectors a centre at least, and vectors that the centres are fitted on.
CELLS = 256
CELL_VECTORS = 100
SAMPLE_ROWS = 20_000
#: Vectors and references of a cell that one group of a task compares.
PART_VECTORS = 50_000
PART_REFERENCES = 2_000
#: Rows that are multiplied at a time, and what sums may be off by.
STEP_ROWS = 1_000
SLACK = 1e-6


def _units(df: DataFrame, name: str) -> DataFrame:
    """Distinct vectors v of length 1 and how they are told: their own numbers. Those without a length, or with a null or NaN, are left out."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sized = df.select("embedding").distinct().withColumn("size", size).where("size > 0 AND NOT isnan(size) AND size < double('infinity')")
    return sized.select(F.col("embedding").alias(name), F.transform("embedding", lambda x: x.cast("double") / F.col("size")).alias("v"))


def _centres(units: DataFrame) -> np.ndarray:
    """Unit vectors, fitted on a bounded sample. They only decide how much is compared, not what is found."""
    sample = units.select("v").limit(SAMPLE_ROWS)
    n = sample.count()
    if n < 2 * CELL_VECTORS:
        return np.array([r.v for r in sample.limit(1).collect()])
    model = KMeans(k=min(CELLS, n // CELL_VECTORS), maxIter=5, seed=1, distanceMeasure="cosine").fit(sample.select(array_to_vector("v").alias("features")))
    found = np.array(model.clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _in_cells(units: DataFrame, centres: np.ndarray) -> DataFrame:
    """units with the cell of each, that of the nearest centre, and the angle to it."""
    schema = T.StructType([*units.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cosines = _matrix(b.column("v")) @ centres.T
                cell = cosines.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(_angles(cosines[np.arange(len(cell)), cell]))], schema=to_arrow_schema(schema))

    return units.mapInArrow(run, schema)


def cells_within(v: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
    """Which cells may hold a vector within that angle of each row of v: true unless a bound proves that none does.

    low and high: the least and greatest angle of a cell's vectors to its
    centre. By the triangle inequality, a vector is no nearer than its cell's
    range of angles is to the row's own angle. And a cell is on its centre's
    side of the plane halfway to the row's nearest centre, so it is no nearer
    than that plane.
    """
    cosines = v @ centres.T
    angle = _angles(cosines)
    near = (angle - high <= reach) & (low - angle <= reach)
    best = cosines.argmax(axis=1)
    apart = np.linalg.norm(centres[best][:, None, :] - centres[None, :, :], axis=2)
    margin = cosines[np.arange(len(v)), best][:, None] - cosines
    beyond = np.divide(margin, apart, out=np.zeros_like(margin), where=apart > 0)
    return near & (np.arcsin(np.clip(beyond, -1, 1)) <= reach)


def _visits(units: DataFrame, centres: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> DataFrame:
    """A row of units for each cell that it must be compared with."""
    schema = T.StructType([*units.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                b = batch.slice(at, STEP_ROWS)
                row, cell = np.nonzero(cells_within(_matrix(b.column("v")), centres, low, high, reach))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(cell, pa.int32())], schema=to_arrow_schema(schema))

    return units.mapInArrow(run, schema)


def _compared(dealt: DataFrame, kind: T.DataType, least: float) -> DataFrame:
    """(vec, ref) of at least that cosine, up to SLACK, from rows in order of (group, side): a group's references come before its vectors, which stream past them."""
    schema = T.StructType([T.StructField("vec", kind), T.StructField("ref", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, refs, matrix = None, [], None, None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                b = batch.slice(at, STEP_ROWS)
                key = np.stack([np.asarray(b.column(c)) for c in ("cell", "part", "asked", "side")], axis=1)
                starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
                for i, j in zip(starts, starts[1:], strict=False):
                    part, (*g, side) = b.slice(i, j - i), key[i].tolist()
                    if g != group:
                        group, kept, matrix = g, [], None
                    if side == 0:
                        kept.append(part)
                        continue
                    if not kept:
                        continue
                    if matrix is None:
                        refs = pa.concat_arrays([k.column("own") for k in kept])
                        matrix = np.concatenate([_matrix(k.column("v")) for k in kept])
                    row, ref = np.nonzero(_matrix(part.column("v")) @ matrix.T >= least - SLACK)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([part.column("own").take(pa.array(row)), refs.take(pa.array(ref))], schema=to_arrow_schema(schema))

    return dealt.mapInArrow(run, schema)


def _near_of_size(vectors: DataFrame, references: DataFrame, size: int, least: float) -> DataFrame:
    """(vec, ref, similarity) of distinct vectors and references of that size."""
    units, asked = (_units(df.where(F.size("embedding") == size), "own") for df in (vectors, references))
    centres = _centres(units)
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField(c, vectors.schema["embedding"].dataType) for c in ("vec", "ref")])).withColumn("similarity", F.lit(0.0))
    placed = _in_cells(units, centres)
    low, high, sizes, visited = np.full(len(centres), np.inf), np.full(len(centres), -np.inf), np.zeros(len(centres), int), np.zeros(len(centres), int)
    # A row for each of the CELLS at most.
    for r in placed.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).collect():
        low[r.cell], high[r.cell], sizes[r.cell] = r.low - SLACK, r.high + SLACK, r.n
    visits = _visits(asked, centres, low, high, float(_angles(np.array(least))) + SLACK)
    for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        visited[r.cell] = r.n
    counts = lambda n, most: F.array(*(F.lit(max(1, -(-int(x) // most))) for x in n))
    parts, asks = F.get(counts(sizes, PART_VECTORS), F.col("cell")), F.get(counts(visited, PART_REFERENCES), F.col("cell"))
    own = lambda n: F.pmod(F.xxhash64("own"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    there = placed.select("own", "v", "cell", own(parts).alias("part"), every(asks).alias("asked"), F.lit(1).alias("side"))
    here = visits.select("own", "v", "cell", every(parts).alias("part"), own(asks).alias("asked"), F.lit(0).alias("side"))
    dealt = here.unionByName(there).repartition("cell", "part", "asked").sortWithinPartitions("cell", "part", "asked", "side")
    pairs = _compared(dealt, vectors.schema["embedding"].dataType, least)
    return pairs.withColumn("similarity", cosine(F.col("vec"), F.col("ref"))).where(F.col("similarity") >= least)


def near_vectors(vectors: DataFrame, references: DataFrame, least: float = COSINE) -> DataFrame:
    """(vec_id, ref_id, similarity) of at least that cosine; a vector is not its own reference. vectors and references: vec_id, embedding, of one type.

    Exact: see cells_within() for why no cell is passed over that holds a
    neighbour. Equal vectors are compared once. Every vector is in one cell, and
    references go to cells; a large cell is dealt to several groups, as are many
    references. Vectors without length, with a null or NaN, or of another size
    than a reference are near nothing.
    """
    sizes = sorted(r[0] for r in references.select(F.size("embedding").alias("n")).where("n > 0").distinct().collect())
    found = None
    for size in sizes:
        pairs = _near_of_size(vectors, references, size, least)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, ref_id bigint, similarity double")
    named = found.join(references.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref")), "ref").join(vectors.select("vec_id", F.col("embedding").alias("vec")), "vec")
    return named.where("vec_id <> ref_id").select("vec_id", "ref_id", "similarity")
