"""Files in and out: releases, user dictionaries, JSON lines, candidate files, classifier models.

All tables are read and written by Spark, so any store that it knows will do.
Small artifacts (a manifest, a lexicon) pass through the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiguard.functions.text import NORMALISER_VERSION, normalise
from lexiguard.operators import curation
from lexiguard.operators.classifier import Dense, Model, scratch
from lexiguard.operators.detect import Entry, Lexicon, Rule
from lexiguard.operators.release import CONTRACT_VERSION, release_counts, user_dictionary

TERMS = (
    "term_id long, surface string, term_kind string, pattern string, normalized_key string, severity int, ambiguity string, status string, release_policy string, categories array<string>, safe_contexts array<string>,"
    " is_dogwhistle_marker boolean, variants array<struct<surface:string,normalized_key:string,variant_kind:string>>,"
    " combination_rules array<struct<trigger_kind:string,trigger_terms:array<bigint>,trigger_pattern:string,proximity_window:int,base_severity:int,severity_delta:int>>"
)
MANIFEST = "release_version string, contract_version string, created_at string, normalizer_code_version string, term_count long, variant_count long, checksums map<string,string>"
MODEL = "feature_version string, bias double, temperature double, weights map<string,double>"
FEATURE_VERSION = "1"


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    """The path and its file system, whichever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def register_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Parquet tables of a folder as views, for spark.sql()."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def read_terms(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TERMS).json(f"{folder}/terms")


def write_release(terms: DataFrame, folder: str, version: str) -> dict:
    """terms (as nested_terms() makes them), the user dictionary, and the manifest with counts and content digests."""
    ordered = terms.orderBy("term_id")
    ordered.write.mode("errorifexists").json(f"{folder}/terms", ignoreNullFields=True)
    forms = user_dictionary(terms)
    forms.write.mode("errorifexists").csv(f"{folder}/user_dict", sep="\t")
    counts = release_counts(terms).first()
    digest = lambda rows: rows.select(F.sha2(F.to_json(F.struct("*")), 256).alias("d")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256)).first()[0]
    manifest = {
        "release_version": version, "contract_version": CONTRACT_VERSION, "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "normalizer_code_version": NORMALISER_VERSION,
        "term_count": counts["term_count"], "variant_count": counts["variant_count"], "checksums": {"terms": digest(terms), "user_dict": digest(forms)},
    }
    terms.sparkSession.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def read_lexicon(spark: SparkSession, folder: str) -> Lexicon:
    """The lexicon of a release; it must have been built with this normaliser."""
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/manifest").first()
    if manifest is None or manifest["normalizer_code_version"] != NORMALISER_VERSION:
        raise ValueError(f"release built with normaliser {manifest and manifest['normalizer_code_version']}, this is {NORMALISER_VERSION}")
    return lexicon_of(read_terms(spark, folder), manifest["release_version"])


def lexicon_of(terms: DataFrame, version: str = "0") -> Lexicon:
    """A lexicon, of a few thousand terms at most, from artifact rows in term order."""
    entries = []
    for t in terms.orderBy("term_id").collect():
        keys = ((t["normalized_key"] or normalise(t["surface"])[0], None), *((v["normalized_key"], v["variant_kind"]) for v in t["variants"] or ()))
        rules = tuple(Rule(r["trigger_pattern"], tuple(r["trigger_terms"] or ()), r["proximity_window"], r["base_severity"], r["severity_delta"] or 0) for r in t["combination_rules"] or ())
        entries.append(Entry(t["term_id"], t["surface"], keys, t["term_kind"], t["severity"], t["ambiguity"], t["status"], bool(t["is_dogwhistle_marker"]), tuple(t["categories"] or ()), tuple(t["safe_contexts"] or ()), rules, t["pattern"]))
    return Lexicon(tuple(entries), version)


def read_user_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(form, tag, score); blank lines and comments are left out, the tag is NNP unless given."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    parts = F.split("value", "\t")
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("form"), F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), F.lit("NNP")).alias("tag"), F.get(parts, F.lit(2)).try_cast("double").alias("score"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("row")).select("row.*")


def read_candidates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a file: path, c, dedup_key, signal_score, errors; unreadable files and broken rules are errors, not failures.

    Folders are searched through for *.json; a file that is named counts whatever its ending. In order of path.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    is_folder = {p: bool(fs.getFileStatus(at).isDirectory()) for p in given for at, fs in [_path(spark, p)] if fs.exists(at)}
    binary = lambda: spark.read.format("binaryFile")
    found = []
    if folders := [p for p, yes in is_folder.items() if yes]:
        found.append(binary().option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folders))
    if named := [p for p, yes in is_folder.items() if not yes]:
        found.append(binary().load(named))
    missing = spark.createDataFrame([(p,) for p in given if p not in is_folder], "path string").select("path", F.lit(None).cast("string").alias("json"))
    read = missing
    for f in found:
        read = read.unionByName(f.select("path", F.decode("content", "UTF-8").alias("json")))
    parsed = curation.parse(read)
    errors = F.when(F.col("json").isNull(), F.array(F.lit("no such file"))).when(F.col("parse_error").isNotNull(), F.array("parse_error")).otherwise(curation.validation_errors(F.col("c")))
    return parsed.select("path", "c", curation.dedup_key(F.col("c")).alias("dedup_key"), curation.signal_score(F.col("c.payload")).alias("signal_score"), errors.alias("errors")).orderBy("path")


def write_model(model: Model, path: str) -> None:
    weights = {str(int(r["idx"])): float(r["w"]) for r in model.weights.collect()}
    body = {"feature_version": FEATURE_VERSION, "bias": model.bias, "temperature": model.temperature, "weights": weights}
    model.weights.sparkSession.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.text(path)


def read_model(spark: SparkSession, path: str) -> Model:
    """A saved model; it must have been made for these features."""
    row = spark.read.schema(MODEL).json(path)
    head = row.select("feature_version", "bias", "temperature").first()
    if head is None or head["feature_version"] != FEATURE_VERSION:
        raise ValueError("model made for other features")
    weights = row.select(F.explode("weights").alias("k", "w")).select(F.col("k").cast("long").alias("idx"), "w")
    return Model(weights, head["bias"], head["temperature"])


MODEL_VARIABLE = "LEXIGUARD_CONTEXT_MODEL"


def context_model(spark: SparkSession, path: str | None = None) -> Dense | None:
    """The classifier for the check: of the path, which must exist, else of the one that MODEL_VARIABLE names, if it exists; else none."""
    if path is not None:
        if not exists(spark, path):
            raise ValueError(f"no model at {path}")
        return read_model(spark, path).dense()
    named = os.environ.get(MODEL_VARIABLE)
    return read_model(spark, named).dense() if named and exists(spark, named) else None
