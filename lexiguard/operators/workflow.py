"""Decisions on candidates and terms, as new snapshots of the lexicon's tables.

Nothing is changed in place: every function takes tables and returns tables, to
be written as a new version. A decision that a rule forbids leaves the tables
as they are and has its reason in the outcome. New rows are numbered on from
the largest id in order of candidates; a batch of decisions is made by people,
so its rows pass one window. What later steps build on is written to the shared
folder, so that plans stay short.

Tables and their columns are those of SCHEMAS; tables that are not given are
empty ones. queue has the parsed candidate in c.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiguard.functions.text import native_normalise
from lexiguard.operators import curation
from lexiguard.sources import files

SCHEMAS = {
    "queue": f"id long, status string, c struct<{curation.CANDIDATE.replace('kind string, collector string, payload ', 'kind:string,collector:string,payload:')}>",
    "source": "source_id long, url string, title string, source_type string, license string, license_class string, publisher string, reliability int, archive_url string, notes string",
    "term": "term_id long, surface string, normalized_key string, term_kind string, pattern string, origin_story string, meaning string, severity int, ambiguity string, safe_contexts array<string>, status string, release_policy string, provenance_class string",
    "term_evidence": "term_id long, source_id long, evidence_type string, excerpt string, added_by string",
    "category": "category_id long, code string",
    "term_category": "term_id long, category_id long",
    "term_variant": "variant_id long, term_id long, variant string, variant_kind string, normalized_key string, auto_generated boolean, verified boolean",
    "composite_rule": "rule_id long, term_id long, trigger_kind string, trigger_pattern string, proximity_window int, base_severity int, severity_delta int, status string",
    "incident": "incident_id long, title string, occurred_at date, medium string, term_id long, marker_id long, source_id long, sample_text string, legal_reviewed boolean, disclosable boolean",
    "image_marker": "marker_id long, name string, marker_kind string, origin_story string, severity int, status string, release_policy string, provenance_class string",
    "marker_evidence": "marker_id long, source_id long, evidence_type string, excerpt string, added_by string",
    "review_log": "entity_type string, entity_id long, action string, reviewer string, rationale string, new_value string",
}
Tables = dict[str, DataFrame]


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def tables_of(spark: SparkSession, given: Tables) -> Tables:
    return {name: given.get(name, spark.createDataFrame([], schema)) for name, schema in SCHEMAS.items()}


def _settled(rows: DataFrame) -> DataFrame:
    path = files.scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _numbered(rows: DataFrame, table: DataFrame, id_col: str, *order: str) -> DataFrame:
    last = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_last"))
    return _settled(rows.crossJoin(F.broadcast(last)).withColumn(id_col, (F.col("_last") + F.row_number().over(Window.orderBy(*order))).cast("long")).drop("_last"))


def _added(tables: Tables, name: str, rows: DataFrame) -> None:
    table = tables[name]
    tables[name] = table.unionByName(rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema)))


def _first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def _with_sources(tables: Tables, rows: DataFrame) -> DataFrame:
    """rows (id, at, url and a source's other columns) with source_id. A known address keeps its row, a new one gets one; without an address each has its own."""
    known = tables["source"].where("url IS NOT NULL").groupBy("url").agg(F.min("source_id").alias("known_id"))
    found = rows.join(known, "url", "left")
    new = found.where("known_id IS NULL")
    fresh = _first_of(new.where("url IS NOT NULL"), ["url"], "id", "at").unionByName(new.where("url IS NULL"))
    fresh = _numbered(fresh, tables["source"], "source_id", "id", "at")
    _added(tables, "source", fresh)
    by_url, by_place = fresh.where("url IS NOT NULL").select("url", F.col("source_id").alias("new_id")), fresh.where("url IS NULL").select("id", "at", F.col("source_id").alias("own_id"))
    return _settled(found.join(by_url, "url", "left").join(by_place, ["id", "at"], "left").withColumn("source_id", F.coalesce("known_id", "new_id", "own_id")).drop("known_id", "new_id", "own_id"))


def _log(tables: Tables, rows: DataFrame, entity_type: str, entity: str, action: str, rationale: Column, new_value: Column | None = None) -> None:
    _added(tables, "review_log", rows.select(F.lit(entity_type).alias("entity_type"), F.col(entity).alias("entity_id"), F.lit(action).alias("action"), "reviewer", rationale.alias("rationale"), (_none() if new_value is None else new_value).alias("new_value")))


def _news_source(title: Column) -> list[Column]:
    return [title.alias("title"), F.lit("news").alias("source_type"), _none().alias("license"), F.lit("permissive").alias("license_class"), F.lit(4).alias("reliability"), F.lit(curation.NEWS_NOTE).alias("notes")]


def _apply_terms(tables: Tables, chosen: DataFrame) -> None:
    p = F.col("c.payload")
    types = F.transform(F.coalesce(p.evidence, F.array().cast(curation.EVIDENCE)), lambda e: curation.license_class(e.license, e.source_type))
    evidence = chosen.select("id", F.explode(types).alias("license_class"))
    gate = curation.license_gate(evidence, "id").select("id", "provenance_class")
    made = _numbered(chosen.join(gate, "id", "left").withColumn("provenance_class", F.coalesce("provenance_class", F.lit("restricted_eval_only"))), tables["term"], "term_id", "id")
    made = made.withColumn("p", p).withColumn("status", curation.term_status(F.col("p.needs_verification")))
    _added(tables, "term", made.select("term_id", "p.surface", "normalized_key", "term_kind", "p.pattern", "p.origin_story", "p.meaning", "p.severity", F.coalesce("p.ambiguity", F.lit("unambiguous")).alias("ambiguity"), "p.safe_contexts", "status", F.lit("release").alias("release_policy"), "provenance_class"))
    shown = made.select("id", "term_id", "reviewer", F.posexplode("p.evidence").alias("at", "e"))
    sources = shown.select("id", "at", "term_id", "reviewer", "e.url", "e.title", "e.source_type", "e.license", curation.license_class(F.col("e.license"), F.col("e.source_type")).alias("license_class"), "e.publisher", F.coalesce("e.reliability", F.lit(3)).alias("reliability"), "e.archive_url", curation.license_note(F.col("e.license"), F.col("e.source_type")).alias("notes"), "e.evidence_type", curation.excerpt(F.col("e.excerpt")).alias("excerpt"))
    found = _first_of(_with_sources(tables, sources), ["term_id", "source_id", "evidence_type"], "at")
    _added(tables, "term_evidence", found.withColumn("added_by", F.col("reviewer")))
    _added(tables, "term_category", made.select("term_id", F.explode("p.categories").alias("code")).join(tables["category"], "code").select("term_id", "category_id").distinct())
    variants = made.select("id", "term_id", F.posexplode("p.variants_observed").alias("at", "v")).select("id", "at", "term_id", "v.variant", "v.variant_kind")
    _add_variants(tables, variants)
    rules = _numbered(made.select("id", "term_id", F.posexplode("p.combination_rules").alias("at", "r")), tables["composite_rule"], "rule_id", "id", "at")
    _added(tables, "composite_rule", rules.select("rule_id", "term_id", "r.trigger_kind", "r.trigger_pattern", "r.proximity_window", "r.base_severity", "r.severity_delta", F.lit("draft").alias("status")))
    _add_incidents(tables, made.select("id", "term_id", _none("long").alias("marker_id"), F.posexplode("p.related_incidents").alias("at", "i")).select("id", "at", "term_id", "marker_id", "i.*"))
    _log(tables, made, "term", "term_id", "approved", F.lit("checklist"), F.to_json(F.struct("status", "provenance_class")))


def _add_variants(tables: Tables, rows: DataFrame) -> DataFrame:
    """Rows (id, at, term_id, variant, variant_kind) that the table has not yet, with variant_id."""
    new = _first_of(rows, ["term_id", "variant"], "id", "at").join(tables["term_variant"].select("term_id", "variant"), ["term_id", "variant"], "left_anti")
    new = _numbered(new, tables["term_variant"], "variant_id", "id", "at")
    _added(tables, "term_variant", new.withColumns({"normalized_key": native_normalise(F.col("variant")), "auto_generated": F.lit(False), "verified": F.lit(False)}))
    return new


def _add_incidents(tables: Tables, rows: DataFrame) -> DataFrame:
    """Rows (id, at, term_id, marker_id, title, occurred_at, medium, sample_text, source_url) with incident_id."""
    sources = rows.select("id", "at", "term_id", "marker_id", F.col("source_url").alias("url"), "occurred_at", "medium", "sample_text", *_news_source(F.col("title")))
    made = _numbered(_with_sources(tables, sources), tables["incident"], "incident_id", "id", "at")
    _added(tables, "incident", made.withColumns({"occurred_at": curation.partial_date(F.col("occurred_at")), "legal_reviewed": F.lit(False), "disclosable": F.lit(False)}))
    return made


def _apply_markers(tables: Tables, chosen: DataFrame) -> None:
    p = F.col("c.payload")
    license_class = curation.license_class(p.license_note, F.lit("internal"))
    made = _numbered(chosen, tables["image_marker"], "marker_id", "id").select("id", "marker_id", "reviewer", p["name"].alias("name"), p.marker_kind.alias("marker_kind"), p.origin_note.alias("origin_story"), p.source_url.alias("url"), p.license_note.alias("license"), license_class.alias("license_class"), F.coalesce(p.severity, F.lit(3)).alias("severity"))
    gate = curation.license_gate(made, "marker_id").select("marker_id", "provenance_class")
    made = made.join(gate, "marker_id").withColumns({"status": F.lit("draft"), "release_policy": F.lit("advisory_only")})
    _added(tables, "image_marker", made)
    sources = made.select("id", F.lit(0).alias("at"), "marker_id", "reviewer", "url", F.col("name").alias("title"), F.lit("internal").alias("source_type"), "license", "license_class", F.lit(3).alias("reliability"), curation.license_note(F.col("license"), F.lit("internal")).alias("notes"))
    _added(tables, "marker_evidence", _with_sources(tables, sources).withColumns({"evidence_type": F.lit("origin"), "added_by": F.col("reviewer")}))
    _log(tables, made, "image_marker", "marker_id", "approved", F.lit("checklist"), F.to_json(F.struct("status", "release_policy")))


def approve(tables: Tables, decisions: DataFrame) -> tuple[Tables, DataFrame]:
    """The tables after approvals (id, reviewer, done: the checklist's items), and outcomes (id, outcome).

    Terms come first, then markers, variants, incidents and deprecations, so one
    batch may name what it brings. An outcome is approved, or the rule that
    refused it: unknown, not_pending, checklist, known_term, no_parent, no_target.
    """
    spark = decisions.sparkSession
    tables = tables_of(spark, tables)
    p = F.col("c.payload")
    once = _first_of(decisions, ["id"], "reviewer")
    rows = once.join(tables["queue"], "id", "left").withColumn("kind", F.col("c.kind"))
    unchecked = curation.checklist_missing(F.coalesce(F.when(F.col("kind").isin("new_term", "new_marker"), p.severity), F.lit(0)), F.coalesce(p.legal_review_flag, F.lit(False)), F.col("done"))
    rows = rows.withColumn("outcome", F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "pending", "not_pending").when(unchecked, "checklist"))
    rows = _settled(rows)
    open_ = rows.where("outcome IS NULL")

    keyed = open_.where("kind = 'new_term'").withColumns({"normalized_key": native_normalise(p.surface), "term_kind": F.coalesce(p.term_kind, F.lit("word"))})
    new = _first_of(keyed, ["normalized_key", "term_kind"], "id").join(tables["term"].select("normalized_key", "term_kind"), ["normalized_key", "term_kind"], "left_anti")
    markers = open_.where("kind = 'new_marker'")
    done = [new.select("id"), markers.select("id")]
    refused = [keyed.join(new.select("id"), "id", "left_anti").select("id", F.lit("known_term").alias("outcome"))]
    _apply_terms(tables, new)
    _apply_markers(tables, markers)

    term, marker = tables["term"], tables["image_marker"]
    asked = open_.where("kind = 'new_variant'").select("id", "reviewer", p.parent_term_id.alias("parent_term_id"), p.parent_surface.alias("parent_surface"), p.variant.alias("variant"), p.variant_kind.alias("variant_kind"))
    found = curation.resolve_parent(asked, term).withColumns({"term_id": F.col("parent_id"), "at": F.lit(0)})
    made = _add_variants(tables, found.where("term_id IS NOT NULL"))
    _log(tables, made, "variant", "variant_id", "approved", F.lit("checklist"), F.to_json(F.struct("variant", F.col("term_id").alias("parent_term_id"))))
    done.append(found.where("term_id IS NOT NULL").select("id"))
    refused.append(found.where("term_id IS NULL").select("id", F.lit("no_parent").alias("outcome")))

    asked = open_.where("kind = 'incident'").select("id", "reviewer", F.lit(0).alias("at"), p.related_surface.alias("related"), p.title.alias("title"), p.occurred_at.alias("occurred_at"), p.medium.alias("medium"), p.sample_text.alias("sample_text"), p.source_url.alias("source_url"), _none().alias("no_id"))
    found = curation.resolve_marker(curation.resolve_parent(asked, term, "no_id", "related"), marker, "related").withColumn("term_id", F.col("parent_id")).withColumn("marker_id", F.when(F.col("term_id").isNull(), F.col("marker_id")))
    fine = found.where("term_id IS NOT NULL OR marker_id IS NOT NULL")
    made = _add_incidents(tables, fine).join(fine.select("id", "reviewer"), "id")
    _log(tables, made.where("term_id IS NOT NULL"), "term", "term_id", "incident_added", F.concat(F.lit("incident #"), F.col("incident_id").cast("string")))
    done.append(fine.select("id"))
    refused.append(found.where("term_id IS NULL AND marker_id IS NULL").select("id", F.lit("no_target").alias("outcome")))

    asked = open_.where("kind = 'deprecation'").select("id", "reviewer", p.target_term_id.alias("target_term_id"), p.target_surface.alias("target_surface"), p.inactivity_basis.alias("basis"))
    found = curation.resolve_parent(asked, term, "target_term_id", "target_surface")
    _log(tables, found.where("parent_id IS NOT NULL"), "term", "parent_id", "deprecation_proposed", F.coalesce("basis", F.lit("무활동 근거 미기재")))
    done.append(asked.select("id"))

    approved = reduce(DataFrame.unionByName, done)
    outcomes = rows.where("outcome IS NOT NULL").select("id", "outcome").unionByName(approved.withColumn("outcome", F.lit("approved"))).unionByName(reduce(DataFrame.unionByName, refused))
    tables["queue"] = tables["queue"].join(approved.withColumn("_taken", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_taken"), "approved").otherwise(F.col("status"))).drop("_taken")
    return tables, outcomes


def reject(tables: Tables, decisions: DataFrame) -> Tables:
    """The tables after rejections (id, reviewer, reason), which may come at any status; ids that are not there are left out."""
    tables = tables_of(decisions.sparkSession, tables)
    known = _first_of(decisions, ["id"], "reviewer", "reason").join(tables["queue"].select("id"), "id", "left_semi")
    _log(tables, known, "term", "id", "rejected", F.col("reason"), F.to_json(F.struct(F.col("id").alias("candidate_id"), "reason")))
    tables["queue"] = tables["queue"].join(known.select("id", F.lit(True).alias("_taken")), "id", "left").withColumn("status", F.when(F.col("_taken"), "rejected").otherwise(F.col("status"))).drop("_taken")
    return tables


def second_review(tables: Tables, reviews: DataFrame) -> Tables:
    """The tables with second reviews (entity_type, entity_id, reviewer, agree, note) in the log."""
    tables = tables_of(reviews.sparkSession, tables)
    _added(tables, "review_log", reviews.select("entity_type", "entity_id", F.lit("second_review").alias("action"), "reviewer", F.col("note").alias("rationale"), F.to_json(F.struct("agree")).alias("new_value")))
    return tables


def activate(tables: Tables, decisions: DataFrame) -> tuple[Tables, DataFrame]:
    """The tables after activations (term_id, reviewer), and outcomes (term_id, outcome).

    Only a term in review whose sources all may be released, and which has
    evidence of origin or definition, becomes active. Other outcomes: unknown,
    watchlist (which must be reviewed first), not_in_review, licence, evidence.
    """
    tables = tables_of(decisions.sparkSession, tables)
    evidence = tables["term_evidence"].join(tables["source"].select("source_id", "license_class"), "source_id")
    gate = curation.license_gate(evidence).select("term_id", "passes")
    told = evidence.where(F.col("evidence_type").isin(*curation.ORIGIN_TYPES)).select("term_id", F.lit(True).alias("told")).distinct()
    asked = _first_of(decisions, ["term_id"], "reviewer").join(tables["term"].select("term_id", "status"), "term_id", "left").join(gate, "term_id", "left").join(told, "term_id", "left")
    no = F.lit(False)
    outcome = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "watchlist", "watchlist").when(F.col("status") != "in_review", "not_in_review").when(~F.coalesce("passes", no), "licence").when(~F.coalesce("told", no), "evidence").otherwise("activated")
    asked = asked.withColumn("outcome", outcome)
    taken = asked.where("outcome = 'activated'")
    _log(tables, taken, "term", "term_id", "activated", F.lit("in_review→active"))
    tables["term"] = tables["term"].join(taken.select("term_id", F.lit(True).alias("_taken")), "term_id", "left").withColumn("status", F.when(F.col("_taken"), "active").otherwise(F.col("status"))).drop("_taken")
    return tables, asked.select("term_id", "outcome")


def apply_verdicts(tables: Tables, verdicts: DataFrame, reviewer: str) -> tuple[Tables, DataFrame]:
    """The tables after a judge's verdicts (id, verdict), and the outcomes of approvals. What is neither approve nor reject stays as it is, for people to decide."""
    of = lambda word: verdicts.where(F.col("verdict") == word).select("id", F.lit(reviewer).alias("reviewer"))
    tables, outcomes = approve(tables, of("approve").withColumn("done", F.array().cast("array<boolean>")))
    return reject(tables, of("reject").withColumn("reason", F.lit("verdict"))), outcomes
