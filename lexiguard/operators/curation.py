"""Curation of candidates: validation, deduplication, licences, row plans, approval and workflow rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiguard.functions.text import native_normalise

KINDS = ("new_term", "new_variant", "new_marker", "incident", "deprecation")
# The fields that a bare term must have, and the names that the contract of candidates and golden entries allows.
LEGACY_KEYS = ("surface", "meaning", "origin_story", "severity", "ambiguity", "categories", "evidence")
TERM_KINDS = ("word", "phrase", "pattern", "number")
AMBIGUITIES = ("unambiguous", "ambiguous", "common")
COMMUNITIES = ("ilbe", "megalia", "womad", "dcinside", "other", "unknown")
CATEGORIES = ("misogyny", "misandry", "region_hate", "deceased", "disability", "race_nation", "politics", "sexual_minority", "age", "religion", "community_jargon")
TRIGGER_KINDS = ("co_occurrence", "date_context", "amount_context", "time_context", "proximity")
VARIANT_KINDS = ("jamo", "leet", "chosung", "yamin", "translit", "spacing", "regex")
SOURCE_TYPES = ("dataset", "wiki", "news", "academic", "community", "government", "internal")
EVIDENCE_TYPES = ("origin", "usage", "incident", "definition")
MEDIA = ("ad", "broadcast", "game", "product", "sns", "app", "other")
MARKER_KINDS = ("hand_sign", "logo", "meme_image", "watermark", "symbol")
GOLDEN_SETS = ("must_catch", "must_pass", "evasion")
GOLDEN_SLOTS = ("F8", "F9", "F11", "F18", "F19", "F20", "F21", "jamo_boundary", "judicial_nonhate", "composite_future")
GATE_STATES = ("pending_lexicon", "composite_future", "deferred_variants")
# Licence classes whose material may be released.
RELEASABLE = ("permissive", "share_alike", "internal")
#: Errors of one candidate that a report shows.
MOST_ERRORS = 10
ORIGIN_TYPES = ("origin", "definition")

EVIDENCE = "array<struct<url:string,archive_url:string,title:string,source_type:string,evidence_type:string,license:string,publisher:string,excerpt:string,reliability:int>>"
PAYLOAD = (
    "struct<surface:string,term_kind:string,pattern:string,origin_community:string,origin_story:string,origin_period:string,meaning:string,severity:int,ambiguity:string,safe_contexts:array<string>,categories:array<string>,"
    f"evidence:{EVIDENCE},combination_rules:array<struct<trigger_kind:string,trigger_terms_surface:array<string>,trigger_pattern:string,proximity_window:int,base_severity:int,severity_delta:int>>,"
    "variants_observed:array<struct<variant:string,variant_kind:string,source_url:string>>,trigger_evidence:array<string>,negative_examples:array<string>,"
    "related_incidents:array<struct<title:string,occurred_at:string,medium:string,sample_text:string,source_url:string>>,needs_verification:boolean,legal_review_flag:boolean,"
    "variant:string,variant_kind:string,source_url:string,parent_surface:string,parent_term_id:string,name:string,marker_kind:string,origin_note:string,license_note:string,archive_url:string,"
    "title:string,occurred_at:string,medium:string,sample_text:string,related_surface:string,related_marker:string,target_surface:string,target_term_id:string,inactivity_basis:string>"
)
CANDIDATE = f"kind string, collector string, payload {PAYLOAD}"


def wrap_legacy(raw: Column) -> Column:
    """JSON of a bare term, which has all its keys and no kind, becomes a new_term candidate; other JSON stays."""
    keys = F.json_object_keys(raw)
    bare = (F.size(F.array_except(F.array(*map(F.lit, LEGACY_KEYS)), keys)) == 0) & ~F.arrays_overlap(keys, F.array(F.lit("kind"), F.lit("collector"), F.lit("payload")))
    return F.when(bare, F.concat(F.lit('{"kind":"new_term","collector":"manual:legacy-file","payload":'), raw, F.lit("}"))).otherwise(raw)


def parse(raw: DataFrame, column: str = "json") -> DataFrame:
    """raw with c, the candidate, and parse_error where the text is not a JSON object."""
    wrapped = wrap_legacy(F.col(column))
    is_object = F.coalesce(F.json_object_keys(column).isNotNull(), F.lit(False))
    return raw.withColumn("c", F.when(is_object, F.from_json(wrapped, CANDIDATE))).withColumn("parse_error", F.when(~is_object, "not a JSON object"))


def _rules(c: Column) -> list[tuple[str, str, Column]]:
    """(name, place, whether it is broken) of each rule, in order."""
    p = c.payload
    none = lambda x: x.isNull() | (F.size(x) == 0)
    kind = lambda k: c.kind == k
    missing = lambda *names: F.exists(F.array(*(p[n].isNull() for n in names)), lambda b: b)
    ruled = (p.term_kind == "number") | (p.ambiguity == "common")
    # A missing field breaks no rule on its values.
    odd = lambda x, names: ~x.isin(*names)
    bad_evidence = F.exists(p.evidence, lambda e: e.url.isNull() | e.title.isNull() | e.source_type.isNull() | e.evidence_type.isNull() | (F.length(e.excerpt) > 300) | ~e.reliability.between(1, 5))
    return [
        ("top_level", "(root)", c.kind.isNull() | c.collector.isNull() | p.isNull()),
        ("kind", "kind", odd(c.kind, KINDS)),
        ("term_fields", "payload", kind("new_term") & missing(*LEGACY_KEYS)),
        ("negative_examples", "payload/negative_examples", kind("new_term") & none(p.negative_examples)),
        ("combination_rules", "payload/combination_rules", kind("new_term") & ruled & (none(p.combination_rules) | none(p.trigger_evidence))),
        ("variant_fields", "payload", kind("new_variant") & (missing("variant", "variant_kind", "source_url") | (p.parent_surface.isNull() & p.parent_term_id.isNull()))),
        ("marker_fields", "payload", kind("new_marker") & missing("name", "marker_kind", "origin_note", "source_url", "license_note")),
        ("incident_fields", "payload", kind("incident") & (missing("title", "occurred_at", "medium", "source_url") | (p.related_surface.isNull() & p.related_marker.isNull()))),
        ("deprecation_fields", "payload", kind("deprecation") & missing("target_surface", "inactivity_basis")),
        ("severity", "payload/severity", ~p.severity.between(1, 5)),
        ("evidence", "payload/evidence", kind("new_term") & (none(p.evidence) | bad_evidence)),
        ("rule_ranges", "payload/combination_rules", F.exists(p.combination_rules, lambda r: ~r.base_severity.between(1, 5) | ~r.severity_delta.between(0, 4))),
        ("term_kind", "payload/term_kind", kind("new_term") & odd(p.term_kind, TERM_KINDS)),
        ("ambiguity", "payload/ambiguity", kind("new_term") & odd(p.ambiguity, AMBIGUITIES)),
        ("origin_community", "payload/origin_community", kind("new_term") & odd(p.origin_community, COMMUNITIES)),
        ("categories", "payload/categories", kind("new_term") & ((F.size(p.categories) == 0) | F.exists(p.categories, lambda x: odd(x, CATEGORIES)))),
        ("evidence_names", "payload/evidence", kind("new_term") & F.exists(p.evidence, lambda e: odd(e.source_type, SOURCE_TYPES) | odd(e.evidence_type, EVIDENCE_TYPES))),
        ("trigger_kind", "payload/combination_rules", F.exists(p.combination_rules, lambda r: r.trigger_kind.isNull() | odd(r.trigger_kind, TRIGGER_KINDS))),
        ("variants_observed", "payload/variants_observed", F.exists(p.variants_observed, lambda v: v.variant.isNull() | v.variant_kind.isNull() | odd(v.variant_kind, VARIANT_KINDS))),
        ("related_incidents", "payload/related_incidents", F.exists(p.related_incidents, lambda i: i.title.isNull() | i.source_url.isNull() | odd(i.medium, MEDIA))),
        ("variant_kind", "payload/variant_kind", kind("new_variant") & odd(p.variant_kind, VARIANT_KINDS)),
        ("marker_kind", "payload/marker_kind", kind("new_marker") & odd(p.marker_kind, MARKER_KINDS)),
        ("medium", "payload/medium", kind("incident") & odd(p.medium, MEDIA)),
    ]


def _broken(rules: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), shown) for shown, bad in rules)), lambda x: x.isNotNull())


def validation_errors(c: Column) -> Column:
    """Names of the rules that a candidate breaks, in order."""
    return _broken([(F.lit(name), bad) for name, _, bad in _rules(c)])


def error_report(c: Column) -> Column:
    """The first ten broken rules as "place: rule", in order of places, then rules."""
    return F.slice(F.array_sort(_broken([(F.lit(f"{place}: {name}"), bad) for name, place, bad in _rules(c)])), 1, MOST_ERRORS)


GOLDEN = 'text string, image_ref string, expected array<string>, why string, source string, added_at string, `set` string, slot string, gate_status string'


def golden_errors(e: Column) -> Column:
    """Names of the rules that a golden entry breaks, in order."""
    rules = [
        ("fields", e.expected.isNull() | e.why.isNull() | e.source.isNull() | e.added_at.isNull()),
        ("input", e.text.isNull() & e.image_ref.isNull()),
        ("set", ~e["set"].isin(*GOLDEN_SETS)),
        ("slot", ~e.slot.isin(*GOLDEN_SLOTS)),
        ("gate_status", ~e.gate_status.isin(*GATE_STATES)),
    ]
    return _broken([(F.lit(name), bad) for name, bad in rules])


def dedup_key(c: Column) -> Column:
    p = c.payload
    shown = F.when(c.kind == "new_term", p.surface).when(c.kind == "new_variant", p.variant).when(c.kind == "new_marker", p["name"]).when(c.kind == "incident", p.title).otherwise(p.target_surface)
    return F.concat(c.kind, F.lit(":"), native_normalise(shown))


def signal_score(p: Column) -> Column:
    """Evidence once, incident evidence and incidents twice, ten at most."""
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    n = size(p.evidence) + 2 * size(F.filter(p.evidence, lambda e: e.evidence_type == "incident")) + 2 * size(p.related_incidents)
    return F.least(F.lit(10.0), n.cast("double"))


def insert_counts(items: DataFrame, queue: DataFrame, keys: tuple[str, ...] = ("dedup_key", "kind"), order: str = "id") -> DataFrame:
    """One row (inserted, skipped): how many of items insert_new() takes."""
    taken = insert_new(items, queue, keys, order).agg(F.count(F.lit(1)).alias("inserted"))
    return taken.crossJoin(items.agg(F.count(F.lit(1)).alias("n"))).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))


def insert_new(items: DataFrame, queue: DataFrame, keys: tuple[str, ...] = ("dedup_key", "kind"), order: str = "id") -> DataFrame:
    """Rows of items that a queue with unique keys would take: the first of each key that is not there yet."""
    first = items.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_place = 1").drop("_place")
    return first.join(queue.select(*keys), list(keys), "left_anti")


def license_class(text: Column, source_type: Column) -> Column:
    """A licence's class by its wording; the order of the tests is part of the rule."""
    upper = F.replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), F.lit("-"), F.lit(" "))
    words = F.split(upper, r"\s+")
    has = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(upper, x))
    by = F.contains(F.replace(upper, F.lit("CC BY"), F.lit("CC BY ")), F.lit("BY "))
    return (
        F.when(has("BY SA", "SHAREALIKE", "SHARE ALIKE"), "share_alike")
        .when(F.array_contains(words, "NC") | has("NONCOMMERCIAL", "NON COMMERCIAL"), "noncommercial")
        .when(F.array_contains(words, "ND") | has("NODERIVATIVES", "NO DERIVATIVES"), "no_derivatives")
        .when(has("MIT", "APACHE", "CC0", "PUBLIC DOMAIN") | by, "permissive")
        .when(source_type.isin("news", "internal"), "permissive")
        .otherwise("unknown")
    )


#: The note on news sources, and what a gate says of its verdict.
NEWS_NOTE = "뉴스 출처: 사실 추출만, 본문 복제 금지 (release_policy 게이트 비대상)"
GATE_REASONS = {"blocked": "릴리스 차단 license_class 존재: ", "empty": "연결 evidence source 없음 — 게이트 판정 불가", "shared": "share_alike 포함 — SA 전파(attribution) 의무", "free": "전부 permissive/internal"}


def license_note(text: Column, source_type: Column) -> Column:
    """A note for news whose wording alone says nothing of a licence, else null."""
    by_word = license_class(text, F.lit("other"))
    return F.when((source_type == "news") & (by_word == "unknown"), NEWS_NOTE)


def license_gate(evidence: DataFrame, term_col: str = "term_id") -> DataFrame:
    """One row a term: passes, blocking (sorted classes joined by commas), effective_license, provenance_class, reason. No class means not passed."""
    known = evidence.groupBy(term_col).agg(F.collect_set("license_class").alias("classes"))
    blocking = F.array_sort(F.array_except("classes", F.array(*map(F.lit, RELEASABLE))))
    shared = F.array_contains("classes", "share_alike")
    passes = (F.size("classes") > 0) & (F.size(blocking) == 0)
    return known.select(
        term_col,
        passes.alias("passes"),
        F.array_join(blocking, ",").alias("blocking"),
        F.when(shared, "CC BY-SA 4.0").otherwise("자체").alias("effective_license"),
        F.when(~passes, "restricted_eval_only").when(shared, "share_alike_core").otherwise("permissive_core").alias("provenance_class"),
        F.when(F.size(blocking) > 0, F.concat(F.lit(GATE_REASONS["blocked"]), F.array_join(blocking, ", "))).when(~passes, GATE_REASONS["empty"]).when(shared, GATE_REASONS["shared"]).otherwise(GATE_REASONS["free"]).alias("reason"),
    )


def partial_date(text: Column) -> Column:
    """YYYY, YYYY-MM and YYYY-MM-DD as dates, on the first day where it is open; others null."""
    full = F.when(text.rlike("^[0-9]{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date")


def excerpt(text: Column) -> Column:
    return F.substring(text, 1, 300)


def checklist_missing(severity: Column, legal: Column, done: Column) -> Column:
    """Whether a term needs all five items of the checklist and lacks one. done: array of booleans."""
    return ((severity >= 5) | legal) & ~(F.coalesce(F.size(done), F.lit(0)).__ge__(5) & F.forall(done, lambda x: x))


def term_status(needs_verification: Column) -> Column:
    return F.when(F.coalesce(needs_verification, F.lit(False)), "draft").otherwise("in_review")


def term_plan(candidates: DataFrame) -> dict[str, DataFrame]:
    """Rows that approved new_term candidates (id, c) add: term, evidence, category, rule, incident. Terms begin as drafts or in review."""
    p = F.col("c.payload")
    c = candidates.where("c.kind = 'new_term'")
    key = native_normalise(p.surface)
    term = c.select("id", p.surface.alias("surface"), key.alias("normalized_key"), p.term_kind.alias("term_kind"), p.pattern.alias("pattern"), p.meaning.alias("meaning"), p.severity.alias("severity"), p.ambiguity.alias("ambiguity"), p.safe_contexts.alias("safe_contexts"), term_status(p.needs_verification).alias("status"))
    evidence = c.select("id", F.explode(p.evidence).alias("e")).select("id", "e.url", "e.title", "e.source_type", "e.evidence_type", license_class(F.col("e.license"), F.col("e.source_type")).alias("license_class"), excerpt(F.col("e.excerpt")).alias("excerpt"), F.col("e.reliability").alias("reliability"))
    rule = c.select("id", F.explode(p.combination_rules).alias("r")).select("id", "r.trigger_kind", "r.trigger_terms_surface", "r.trigger_pattern", "r.proximity_window", "r.base_severity", "r.severity_delta", F.lit("draft").alias("status"))
    return {
        "term": term,
        "evidence": evidence,
        "category": c.select("id", F.explode(F.array_distinct(p.categories)).alias("code")),
        "rule": rule,
        "incident": c.select("id", F.explode(p.related_incidents).alias("i")).select("id", "i.title", partial_date(F.col("i.occurred_at")).alias("occurred_at"), "i.medium"),
    }


def other_plans(candidates: DataFrame) -> dict[str, DataFrame]:
    """Rows that approved candidates of the other kinds add or change."""
    p = F.col("c.payload")
    of = lambda k: candidates.where(F.col("c.kind") == k)
    return {
        "variant": of("new_variant").select("id", p.parent_term_id.alias("parent_term_id"), p.parent_surface.alias("parent_surface"), p.variant.alias("variant"), p.variant_kind.alias("variant_kind"), native_normalise(p.variant).alias("normalized_key"), F.lit(False).alias("verified")),
        "marker": of("new_marker").select("id", p["name"].alias("name"), p.marker_kind.alias("marker_kind"), p.origin_note.alias("origin_note"), F.lit("advisory_only").alias("release_policy")),
        "incident": of("incident").select("id", p.title.alias("title"), partial_date(p.occurred_at).alias("occurred_at"), p.medium.alias("medium"), p.related_surface.alias("related"), F.lit(False).alias("legal_reviewed"), F.lit(False).alias("disclosable")),
        "deprecation": of("deprecation").select("id", p.target_surface.alias("target_surface"), p.target_term_id.alias("target_term_id"), p.inactivity_basis.alias("inactivity_basis")),
    }


def approve(queue: DataFrame, chosen: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The queue with the chosen ids approved, and log rows; ids that are not pending stay and are logged as refused."""
    mark = chosen.select(F.col("id").alias("chosen_id"), F.lit(True).alias("chosen"))
    joined = queue.join(mark, F.col("id") == F.col("chosen_id"), "left").drop("chosen_id")
    ok = F.coalesce("chosen", F.lit(False)) & (F.col("status") == "pending")
    log = joined.where("chosen").select(F.col("id").alias("entity_id"), F.col("status").alias("old_value"), F.when(ok, "approved").otherwise("refused").alias("new_value"), at.alias("at"))
    return joined.withColumn("status", F.when(ok, "approved").otherwise(F.col("status"))).drop("chosen"), log


def reject(queue: DataFrame, chosen: DataFrame) -> DataFrame:
    """The queue with the chosen ids rejected, whatever their status was."""
    mark = chosen.select(F.col("id").alias("chosen_id"), F.lit("rejected").alias("new"))
    return queue.join(mark, F.col("id") == F.col("chosen_id"), "left").withColumn("status", F.coalesce("new", "status")).drop("chosen_id", "new")


ALLOWED = {("draft", "in_review"), ("in_review", "active"), ("active", "deprecated"), ("deprecated", "active"), ("draft", "watchlist"), ("watchlist", "draft"), ("watchlist", "in_review")}


def transition_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(term_id, old, new) of status changes that the workflow does not allow. Any status may become rejected."""
    b, a = before.select("term_id", F.col("status").alias("old")), after.select("term_id", F.col("status").alias("new"))
    fine = F.concat_ws(">", "old", "new").isin(*(f"{x}>{y}" for x, y in sorted(ALLOWED)))
    return a.join(b, "term_id").where((F.col("old") != F.col("new")) & ~fine & (F.col("new") != "rejected"))


def gate_violations(term: DataFrame, evidence: DataFrame) -> DataFrame:
    """Active terms without evidence of origin or definition."""
    return term.where("status = 'active'").join(evidence.where(F.col("evidence_type").isin(*ORIGIN_TYPES)), "term_id", "left_anti")


def retention_violations(before: DataFrame, after: DataFrame, term: DataFrame) -> DataFrame:
    """Active terms that had evidence of origin or definition before a change of the evidence and have none after it."""
    told = lambda ev: ev.where(F.col("evidence_type").isin(*ORIGIN_TYPES)).select("term_id").distinct()
    return term.where("status = 'active'").join(told(before), "term_id", "left_semi").join(told(after), "term_id", "left_anti")


def resolve_marker(rows: DataFrame, marker: DataFrame, surface_col: str) -> DataFrame:
    """rows with marker_id: the smallest id of the markers of that name, which an explanation in brackets may follow."""
    names = marker.select("marker_id", F.explode(F.array_distinct(F.array("name", F.split_part("name", F.lit(" ("), F.lit(1))))).alias("marker_name"))
    first = names.groupBy("marker_name").agg(F.min("marker_id").alias("marker_id"))
    return rows.join(first, F.col(surface_col) == F.col("marker_name"), "left").drop("marker_name")


def pending(queue: DataFrame, ids: list[int] | None = None, most: int | None = None) -> DataFrame:
    """Pending items in order of id; with ids only these, with most no more than that."""
    rows = queue.where("status = 'pending'")
    rows = (rows.where(F.col("id").isin(*ids)) if ids else rows).orderBy("id")
    return rows.limit(most) if most else rows


#: Rows that the views of terms and of the log, and of the sample for second reviews, show.
LATEST, LATEST_SAMPLE = 200, 100


def latest(rows: DataFrame, order: str, most: int = LATEST, ties: str | None = None) -> DataFrame:
    return rows.orderBy(F.desc(order), *([F.desc(ties)] if ties else [])).limit(most)


def terms_by_status(term: DataFrame, statuses: list[str]) -> DataFrame:
    return latest(term.where(F.col("status").isin(*statuses)), "updated_at", LATEST, "term_id")


def resolve_parent(rows: DataFrame, term: DataFrame, id_col: str = "parent_term_id", surface_col: str = "parent_surface") -> DataFrame:
    """rows with parent_id: the term of that id if there is one, else the smallest id with the surface's key."""
    ids = term.select(F.col("term_id").alias("by_id"))
    keys = term.groupBy(F.col("normalized_key").alias("key")).agg(F.min("term_id").alias("by_key"))
    wanted = F.expr(f"try_cast({id_col} AS BIGINT)")
    return rows.join(ids, wanted == F.col("by_id"), "left").join(keys, native_normalise(F.col(surface_col)) == F.col("key"), "left").withColumn("parent_id", F.coalesce("by_id", "by_key")).drop("by_id", "by_key", "key")


def queue_order() -> list[Column]:
    return [F.when(F.col("urgency") == "urgent", 0).when(F.col("urgency") == "normal", 1).otherwise(2).asc(), F.desc("signal_score"), F.asc("created_at")]


def apply_order() -> list[Column]:
    return [F.when(F.col("kind") == "new_term", 0).when(F.col("kind") == "new_marker", 1).when(F.col("kind") == "new_variant", 2).when(F.col("kind") == "incident", 3).otherwise(9).asc(), F.asc("id")]


def audit_sample(rows: DataFrame, id_col: str) -> DataFrame:
    """A tenth of the rows, the same ones each time, by the MD5 of their id."""
    return rows.where(F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10 == 0)


def upsert_sources(new: DataFrame, source: DataFrame) -> DataFrame:
    """new (url, …) with source_id: the known one of its url, else null for a new row; rows without url are always new."""
    return new.join(source.select("url", "source_id"), "url", "left")


def evidence_with_sources(evidence: DataFrame, source: DataFrame) -> DataFrame:
    return evidence.join(source, "source_id")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as repeated upserts leave it."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Numbers of applied, refused and uncertain verdicts; anything unknown is uncertain."""
    known = F.when(F.col("verdict").isin("approve", "reject"), F.col("verdict")).otherwise("uncertain")
    return verdicts.groupBy(known.alias("verdict"), "applied").agg(F.count(F.lit(1)).alias("n"))


def inactive_terms(matches: DataFrame, term: DataFrame, today: Column, months: int = 12) -> DataFrame:
    """(term_id, last_seen) of active terms without a match in the last months: proposals to deprecate them."""
    seen = matches.groupBy("term_id").agg(F.max("at").alias("last_seen"))
    joined = term.where("status = 'active'").join(seen, "term_id", "left")
    return joined.where(F.col("last_seen").isNull() | (F.col("last_seen") < F.add_months(today, -months))).select("term_id", "last_seen")


def disclosed(term: DataFrame, incident: DataFrame) -> DataFrame:
    """term with incidents: titles of the disclosable ones only, in order."""
    shown = incident.where("disclosable").groupBy("term_id").agg(F.array_sort(F.collect_set("display_title")).alias("incidents"))
    return term.join(shown, "term_id", "left").withColumn("incidents", F.coalesce("incidents", F.array().cast("array<string>")))


def weekly_distribution(matches: DataFrame) -> DataFrame:
    """(week, usage_recommendation, n)."""
    return matches.groupBy(F.date_trunc("week", "at").alias("week"), "usage_recommendation").agg(F.count(F.lit(1)).alias("n"))
