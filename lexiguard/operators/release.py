"""Releases: which terms go in, their nested artifact, counts, versions and differences."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiguard.functions.text import native_normalise

CONTRACT_VERSION = "1.1"


def eligible(term: DataFrame) -> DataFrame:
    return term.where(F.col("status").isin("active", "watchlist") & ~F.col("release_policy").isin("internal_only", "hold_legal"))


def nested_terms(term: DataFrame, term_category: DataFrame, category: DataFrame, variant: DataFrame, rule: DataFrame) -> DataFrame:
    """The artifact's rows: eligible terms with sorted category codes, verified variants and active rules by id; empty arrays where there are none."""
    codes = term_category.join(category.select("category_id", "code"), "category_id").groupBy("term_id").agg(F.array_sort(F.collect_list("code")).alias("categories"))
    kept = variant.where("verified").groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("variant_id", F.col("variant").alias("surface"), native_normalise(F.col("variant")).alias("normalized_key"), "variant_kind"))).alias("vs"))
    rules = rule.where("status = 'active'").groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "trigger_kind", "trigger_terms", "trigger_pattern", "proximity_window", "base_severity", "severity_delta"))).alias("rs"))
    joined = eligible(term).join(codes, "term_id", "left").join(kept, "term_id", "left").join(rules, "term_id", "left")
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind))
    return joined.select(
        "term_id", "surface", "term_kind", "pattern", native_normalise(F.col("surface")).alias("normalized_key"), "severity", "ambiguity", "status", "release_policy",
        empty("categories", "array<string>").alias("categories"), empty("safe_contexts", "array<string>").alias("safe_contexts"), (F.col("release_policy") == "advisory_only").alias("is_dogwhistle_marker"),
        empty(F.transform("vs", lambda v: v.dropFields("variant_id")), "array<struct<surface:string,normalized_key:string,variant_kind:string>>").alias("variants"),
        empty(F.transform("rs", lambda r: r.dropFields("rule_id")), "array<struct<trigger_kind:string,trigger_terms:array<bigint>,trigger_pattern:string,proximity_window:int,base_severity:int,severity_delta:int>>").alias("combination_rules"),
    )


def release_counts(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count(F.lit(1)).alias("term_count"), F.coalesce(F.sum(F.size("variants")), F.lit(0)).cast("long").alias("variant_count"))


def user_dictionary(terms: DataFrame) -> DataFrame:
    """(form, tag, score): surfaces of active terms that are no patterns, then their whole-word variants, each form once."""
    active = terms.where("status = 'active' AND term_kind <> 'pattern'")
    forms = F.concat(F.array("surface"), F.transform(F.filter("variants", lambda v: ~v.variant_kind.isin("jamo", "chosung")), lambda v: v.surface))
    rows = active.select("term_id", F.posexplode(forms).alias("pos", "form")).withColumn("form", F.trim("form")).where("form <> ''")
    first = rows.groupBy("form").agg(F.min(F.struct("term_id", "pos")).alias("at"))
    return first.orderBy("at").select("form", F.lit("NNP").alias("tag"), F.lit(0.0).alias("score"))


def next_version(names: Iterable[str], today: date) -> str:
    """YYYY.MM.DD-N with N one above today's largest; other names do not count."""
    day = today.strftime("%Y.%m.%d")
    taken = [int(m[1]) for n in names if (m := re.fullmatch(re.escape(day) + r"-([0-9]+)", n))]
    return f"{day}-{max(taken, default=0) + 1}"


def next_versions(listing: DataFrame, days: DataFrame) -> DataFrame:
    """(day, version) for days (YYYY.MM.DD) and a listing of release names."""
    taken = listing.select(F.regexp_extract("name", r"^([0-9]{4}\.[0-9]{2}\.[0-9]{2})-([0-9]+)$", 1).alias("day"), F.regexp_extract("name", r"-([0-9]+)$", 1).alias("n")).where("day <> ''").groupBy("day").agg(F.max(F.col("n").cast("int")).alias("last"))
    return days.join(taken, "day", "left").select("day", F.concat("day", F.lit("-"), (F.coalesce("last", F.lit(0)) + 1).cast("string")).alias("version"))


def difference(old: DataFrame, new: DataFrame, key: str = "term_id") -> DataFrame:
    """(key, change): added, removed or changed rows between two releases, compared by a hash of all columns."""
    digest = lambda d, name: d.select(key, F.sha2(F.to_json(F.struct(*sorted(d.columns))), 256).alias(name))
    both = digest(old, "a").join(digest(new, "b"), key, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def load_variants(verified: DataFrame, term: DataFrame, existing: DataFrame) -> DataFrame:
    """verified (surface, variant, …) with term_id and outcome: loaded, skip where it is there or comes again, or noparent. Parents are active terms by key."""
    parents = term.where("status = 'active'").groupBy("normalized_key").agg(F.min("term_id").alias("term_id"))
    with_parent = verified.join(parents, native_normalise(F.col("surface")) == F.col("normalized_key"), "left").drop("normalized_key")
    known = existing.select(F.col("term_id").alias("t"), F.col("variant").alias("v"), F.lit(True).alias("known")).distinct()
    again = F.row_number().over(Window.partitionBy("term_id", "variant").orderBy("surface", "variant_kind")) > 1
    joined = with_parent.join(known, (F.col("term_id") == F.col("t")) & (F.col("variant") == F.col("v")), "left").drop("t", "v")
    return joined.withColumn("outcome", F.when(F.col("term_id").isNull(), "noparent").when(F.coalesce("known", F.lit(False)) | again, "skip").otherwise("loaded")).drop("known")
