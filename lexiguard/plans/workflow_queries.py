"""Registered queries for decisions on candidates and terms, views of the tables, and the golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiguard.functions import text as tx
from lexiguard.operators import classifier, curation, evaluate, variants, workflow
from lexiguard.operators.detect import Entry, Lexicon
from lexiguard.plans.check import check, check_documents
from lexiguard.plans.inline import Inline, sql_value
from lexiguard.plans.queries import _CAUGHT_SQL, _FEATURES_SQL, CATEGORY, EVIDENCE, SURFACES, TERM_ROWS, VARIANT, _scored_golden
from lexiguard.plans.registry import query, table


# ---- decisions -------------------------------------------------------------
def _term(surface: str, more: str = "", severity: int = 3, kind: str = "word") -> str:
    evidence = '{"url":"u1","title":"one","source_type":"wiki","evidence_type":"origin","license":"CC BY-SA 4.0"},{"url":"u2","title":"two","source_type":"news","evidence_type":"incident"},{"title":"three","source_type":"dataset","evidence_type":"usage","license":"MIT"},{"url":"u1","title":"again","source_type":"wiki","evidence_type":"origin"}'
    return f'{{"kind":"new_term","collector":"c","payload":{{"surface":"{surface}","term_kind":"{kind}","meaning":"m","origin_story":"o","severity":{severity},"ambiguity":"ambiguous","categories":["x","m","none"],"evidence":[{evidence}]{more}}}}}'


def _other(kind: str, body: str) -> str:
    return f'{{"kind":"{kind}","collector":"c","payload":{{{body}}}}}'


APPLY = Inline("ap", "id int, status string, json string", [
    (1, "pending", _term("Abc", ',"variants_observed":[{"variant":"A8c","variant_kind":"leet"}],"related_incidents":[{"title":"t1","occurred_at":"2020","medium":"sns","source_url":"u2"}]')),
    (2, "pending", _term("ABC")), (3, "pending", _term("aaa")), (4, "pending", _term("heavy", severity=5)), (5, "approved", _term("late")),
    (6, "pending", _other("new_variant", '"variant":"4bc","variant_kind":"leet","source_url":"u","parent_surface":"abc"')),
    (7, "pending", _other("new_variant", '"variant":"z","variant_kind":"leet","source_url":"u","parent_surface":"zzz"')),
    (8, "pending", _other("new_variant", '"variant":"b","variant_kind":"jamo","source_url":"u","parent_term_id":"2"')),
    (9, "pending", _other("new_marker", '"name":"Sign (left hand)","marker_kind":"hand_sign","origin_note":"o","source_url":"u9","license_note":"CC0"')),
    (10, "pending", _other("incident", '"title":"t2","occurred_at":"2021-05","medium":"ad","source_url":"u10","related_surface":"Sign"')),
    (11, "pending", _other("incident", '"title":"t3","occurred_at":"2021-05","medium":"ad","source_url":"u11","related_surface":"none"')),
    (12, "pending", _other("deprecation", '"target_surface":"bbb","inactivity_basis":"quiet"')),
    (13, "pending", _term("77", ',"needs_verification":true,"combination_rules":[{"trigger_kind":"co_occurrence","trigger_pattern":"x","base_severity":1,"severity_delta":1}]', 2, "number")),
    (14, "pending", _term("heavy two", severity=5)), (15, "pending", _other("incident", '"title":"t4","occurred_at":"2022-01-02","medium":"ad","source_url":"known","related_surface":"ABC"')),
    (16, "pending", _term("untouched")),
])
DECIDED = Inline("de", "id int, reviewer string, done array<boolean>", [(i, "ann", [True] * 5 if i == 14 else []) for i in (*range(1, 16), 99)])
SOURCES = Inline("so", "source_id int, url string, license_class string", [(5, "known", "permissive"), (3, "old", "unknown")])

_P = "(p->>'$.{}')".format
_TARGET = f"coalesce({_P('parent_surface')}, {_P('related_surface')}, {_P('target_surface')})"
_APPLY_SQL = f"""{APPLY.sql}, {DECIDED.sql}, {TERM_ROWS.sql}, {VARIANT.sql}, {CATEGORY.sql}, {SOURCES.sql},
q AS (SELECT id, status, json_extract_string(json, '$.kind') AS kind, json_extract(json, '$.payload') AS p FROM ap),
d AS (SELECT de.id, reviewer, status, kind, p, CASE WHEN status IS NULL THEN 'unknown' WHEN status <> 'pending' THEN 'not_pending' WHEN CAST({_P('severity')} AS INT) >= 5 AND len(done) < 5 THEN 'checklist' END AS early, {_TARGET} AS target FROM de LEFT JOIN q USING (id)),
nt AS (SELECT *, lower({_P('surface')}) AS key, {_P('term_kind')} AS tk FROM d WHERE early IS NULL AND kind = 'new_term'),
ok AS (SELECT * FROM nt WHERE NOT EXISTS (SELECT 1 FROM tm WHERE normalized_key = key AND term_kind = tk) QUALIFY row_number() OVER (PARTITION BY key, tk ORDER BY id) = 1),
made AS (SELECT *, (SELECT max(term_id) FROM tm) + row_number() OVER (ORDER BY id) AS term_id, CASE WHEN CAST({_P('needs_verification')} AS BOOLEAN) THEN 'draft' ELSE 'in_review' END AS state FROM ok),
marks AS (SELECT *, row_number() OVER (ORDER BY id) AS marker_id FROM d WHERE early IS NULL AND kind = 'new_marker'),
terms AS (SELECT term_id, normalized_key FROM tm UNION ALL SELECT term_id, key FROM made),
rest AS (SELECT d.*, coalesce((SELECT term_id FROM terms t WHERE t.term_id = TRY_CAST({_P('parent_term_id')} AS INT)), (SELECT min(term_id) FROM terms t WHERE t.normalized_key = lower({_TARGET}))) AS parent,
  (SELECT min(marker_id) FROM marks m WHERE d.kind = 'incident' AND d.target IN ((m.p->>'$.name'), split_part((m.p->>'$.name'), ' (', 1))) AS marker FROM d WHERE early IS NULL AND kind IN ('new_variant', 'incident', 'deprecation')),
outcomes AS (SELECT id, early AS outcome FROM d WHERE early IS NOT NULL UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM made) THEN 'approved' ELSE 'known_term' END FROM nt UNION ALL SELECT id, 'approved' FROM marks
  UNION ALL SELECT id, CASE WHEN kind = 'new_variant' AND parent IS NULL THEN 'no_parent' WHEN kind = 'incident' AND parent IS NULL AND marker IS NULL THEN 'no_target' ELSE 'approved' END FROM rest),
ev AS (SELECT made.id, made.term_id, i AS place, json_extract_string(p, '$.evidence[' || i || '].url') AS url, json_extract_string(p, '$.evidence[' || i || '].title') AS title, json_extract_string(p, '$.evidence[' || i || '].evidence_type') AS evidence_type FROM made, range(0, 4) r(i)),
inc AS (SELECT id, term_id, CAST(NULL AS BIGINT) AS marker_id, 't1' AS title, DATE '2020-01-01' AS day, 'u2' AS url FROM made WHERE json_array_length(p, '$.related_incidents') > 0
  UNION ALL SELECT id, parent, CASE WHEN parent IS NULL THEN marker END, {_P('title')}, CAST(CASE length({_P('occurred_at')}) WHEN 7 THEN {_P('occurred_at')} || '-01' ELSE {_P('occurred_at')} END AS DATE), {_P('source_url')} FROM rest WHERE kind = 'incident' AND (parent IS NOT NULL OR marker IS NOT NULL)),
steps AS (SELECT 1 AS step, id, place, url, title FROM ev UNION ALL SELECT 2, id, 0, url, title FROM inc WHERE id IN (SELECT id FROM made) UNION ALL SELECT 3, id, 0, {_P('source_url')}, {_P('name')} FROM marks UNION ALL SELECT 4, id, 0, url, title FROM inc WHERE id NOT IN (SELECT id FROM made)),
fresh AS (SELECT * FROM steps WHERE url IS NULL OR (url NOT IN (SELECT url FROM so) AND true) QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY step, id, place) = 1),
news AS (SELECT *, (SELECT max(source_id) FROM so) + row_number() OVER (ORDER BY step, id, place) AS source_id FROM fresh)"""


_done: dict[str, tuple[workflow.Tables, DataFrame]] = {}


def _applied(spark: SparkSession) -> tuple[workflow.Tables, DataFrame]:
    """The fixture's decisions, applied once an application; several queries look at the tables after them."""
    key = spark.sparkContext.applicationId
    if key not in _done:
        _done[key] = _apply(spark)
    return _done[key]


def _apply(spark: SparkSession) -> tuple[workflow.Tables, DataFrame]:
    queue = curation.parse(APPLY.df(spark)).select(F.col("id").cast("long").alias("id"), "status", "c")
    fill = lambda rows, name: rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], workflow.SCHEMAS[name]).schema))
    tables = {"queue": queue, "term": fill(TERM_ROWS.df(spark), "term"), "term_variant": fill(VARIANT.df(spark), "term_variant"), "category": fill(CATEGORY.df(spark), "category"), "source": fill(SOURCES.df(spark), "source")}
    return workflow.approve(tables, DECIDED.df(spark).withColumn("id", F.col("id").cast("long")))


@query(f"WITH {_APPLY_SQL} SELECT ap.id, CASE WHEN o.outcome = 'approved' THEN 'approved' ELSE ap.status END AS status, coalesce(o.outcome, '') AS outcome FROM ap LEFT JOIN outcomes o ON ap.id = o.id UNION ALL SELECT id, '', outcome FROM outcomes WHERE id NOT IN (SELECT id FROM ap)")
def w1_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, outcomes = _applied(spark)
    both = tables["queue"].select("id", "status").join(outcomes, "id", "full")
    return both.select(F.col("id").cast("int").alias("id"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("outcome", F.lit("")).alias("outcome"))


@query(f"WITH {_APPLY_SQL} SELECT CAST(term_id AS INT) AS term_id, {_P('surface')} AS surface, key AS normalized_key, tk AS term_kind, state AS status, (SELECT CASE WHEN bool_or(json_extract_string(p, '$.evidence[' || i || '].license') IS NULL AND json_extract_string(p, '$.evidence[' || i || '].source_type') <> 'news') THEN 'restricted_eval_only' ELSE 'share_alike_core' END FROM range(0, 4) r(i)) AS provenance_class FROM made")
def w2_new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark)[0]["term"].where("term_id > 6").select(F.col("term_id").cast("int").alias("term_id"), "surface", "normalized_key", "term_kind", "status", "provenance_class")


@query(f"WITH {_APPLY_SQL} SELECT CAST(source_id AS INT) AS source_id, coalesce(url, '') AS url, title FROM news")
def o8_source_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark)[0]["source"].where("source_id > 5").select(F.col("source_id").cast("int").alias("source_id"), F.coalesce("url", F.lit("")).alias("url"), "title")


@query(f"WITH {_APPLY_SQL} SELECT DISTINCT CAST(ev.term_id AS INT) AS term_id, CAST(n.source_id AS INT) AS source_id, evidence_type FROM ev JOIN news n ON ev.url = n.url OR (ev.url IS NULL AND n.url IS NULL AND n.id = ev.id AND n.place = ev.place)")
def w2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark)[0]["term_evidence"].select(F.col("term_id").cast("int").alias("term_id"), F.col("source_id").cast("int").alias("source_id"), "evidence_type")


@query(f"WITH {_APPLY_SQL} SELECT CAST(term_id AS INT) AS term_id, CAST(category_id AS INT) AS category_id FROM made, cg WHERE code IN ('x', 'm')")
def w2_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark)[0]["term_category"].select(F.col("term_id").cast("int").alias("term_id"), F.col("category_id").cast("int").alias("category_id"))


@query(f"WITH {_APPLY_SQL}, n AS (SELECT 1 AS step, id, term_id, 'A8c' AS variant FROM made WHERE json_array_length(p, '$.variants_observed') > 0 UNION ALL SELECT 2, id, parent, {_P('variant')} FROM rest WHERE kind = 'new_variant' AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vr WHERE vr.term_id = parent AND vr.variant = ({_P('variant')}))) SELECT CAST((SELECT max(variant_id) FROM vr) + row_number() OVER (ORDER BY step, id) AS INT) AS variant_id, CAST(term_id AS INT) AS term_id, variant, lower(variant) AS normalized_key, false AS verified FROM n")
def w3_new_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark)[0]["term_variant"].where("variant_id > 4").select(F.col("variant_id").cast("int").alias("variant_id"), F.col("term_id").cast("int").alias("term_id"), "variant", "normalized_key", "verified")


@query(f"WITH {_APPLY_SQL}, u AS (SELECT url, source_id FROM so UNION ALL SELECT url, source_id FROM news WHERE url IS NOT NULL), i AS (SELECT inc.*, id IN (SELECT id FROM made) AS early FROM inc) SELECT CAST(row_number() OVER (ORDER BY early DESC, id) AS INT) AS incident_id, title, strftime(day, '%Y-%m-%d') AS day, CAST(coalesce(term_id, -1) AS INT) AS term_id, CAST(coalesce(marker_id, -1) AS INT) AS marker_id, CAST(u.source_id AS INT) AS source_id FROM i JOIN u ON i.url = u.url")
def w3_new_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _applied(spark)[0]["incident"]
    return rows.select(F.col("incident_id").cast("int").alias("incident_id"), "title", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), F.coalesce("term_id", F.lit(-1)).cast("int").alias("term_id"), F.coalesce("marker_id", F.lit(-1)).cast("int").alias("marker_id"), F.col("source_id").cast("int").alias("source_id"))


@query(f"WITH {_APPLY_SQL} SELECT CAST(marker_id AS INT) AS marker_id, {_P('name')} AS name, 'draft' AS status, 'advisory_only' AS release_policy, 'permissive_core' AS provenance_class, 3 AS severity FROM marks")
def w3_new_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark)[0]["image_marker"].select(F.col("marker_id").cast("int").alias("marker_id"), "name", "status", "release_policy", "provenance_class", "severity")


@query(f"WITH {_APPLY_SQL}, v AS (SELECT 1 AS step, id FROM made WHERE json_array_length(p, '$.variants_observed') > 0 UNION ALL SELECT 2, id FROM rest WHERE kind = 'new_variant' AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vr WHERE vr.term_id = parent AND vr.variant = ({_P('variant')}))), vn AS (SELECT *, (SELECT max(variant_id) FROM vr) + row_number() OVER (ORDER BY step, id) AS n FROM v) SELECT 'term' AS entity_type, CAST(term_id AS INT) AS entity_id, 'approved' AS action FROM made UNION ALL SELECT 'image_marker', CAST(marker_id AS INT), 'approved' FROM marks UNION ALL SELECT 'variant', CAST(n AS INT), 'approved' FROM vn WHERE step = 2 UNION ALL SELECT 'term', CAST(parent AS INT), 'incident_added' FROM rest WHERE kind = 'incident' AND parent IS NOT NULL UNION ALL SELECT 'term', CAST(parent AS INT), 'deprecation_proposed' FROM rest WHERE kind = 'deprecation' AND parent IS NOT NULL")
def w4_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark)[0]["review_log"].select("entity_type", F.col("entity_id").cast("int").alias("entity_id"), "action")


@query(f"WITH {APPLY.sql} SELECT id, CASE WHEN id IN (1, 5) THEN 'rejected' ELSE status END AS status, CASE WHEN id IN (1, 5) THEN 'no' ELSE '' END AS reason FROM ap")
def w4_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = curation.parse(APPLY.df(spark)).select(F.col("id").cast("long").alias("id"), "status", "c")
    tables = workflow.reject({"queue": queue}, spark.createDataFrame([(1, "ann", "no"), (5, "ann", "no"), (77, "ann", "no")], "id long, reviewer string, reason string"))
    log = tables["review_log"].where("action = 'rejected'").select(F.col("entity_id").alias("id"), "rationale")
    return tables["queue"].join(log, "id", "left").select(F.col("id").cast("int").alias("id"), "status", F.coalesce("rationale", F.lit("")).alias("reason"))


@query("SELECT 'term' AS entity_type, o_orderkey AS entity_id, 'second_review' AS action, '{\"agree\":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || '}' AS new_value FROM orders")
def w4_second_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders stand in for reviewed terms.
    reviews = table(spark, sf_dir, "orders").select(F.lit("term").alias("entity_type"), F.col("o_orderkey").cast("long").alias("entity_id"), F.lit("ann").alias("reviewer"), (F.col("o_orderstatus") == "F").alias("agree"), F.lit("").alias("note"))
    return workflow.second_review({}, reviews)["review_log"].select("entity_type", F.col("entity_id").cast(table(spark, sf_dir, "orders").schema["o_orderkey"].dataType).alias("entity_id"), "action", "new_value")


REVIEWED = Inline("rv", "term_id int, status string", [(1, "in_review"), (2, "in_review"), (3, "in_review"), (4, "draft"), (5, "watchlist"), (6, "active"), (7, "in_review")])
SHOWN = Inline("sh", "term_id int, evidence_type string, license_class string", [(1, "origin", "permissive"), (1, "usage", "share_alike"), (2, "origin", "unknown"), (3, "usage", "permissive"), (4, "origin", "permissive"), (5, "origin", "permissive")])


def _activated(spark: SparkSession) -> tuple[workflow.Tables, DataFrame]:
    shown = SHOWN.df(spark).withColumn("source_id", F.monotonically_increasing_id())
    asked = spark.createDataFrame([(i, "ann") for i in (1, 2, 3, 4, 5, 6, 7, 99)], "term_id long, reviewer string")
    return workflow.activate({"term": REVIEWED.df(spark), "term_evidence": shown.drop("license_class"), "source": shown.select("source_id", "license_class")}, asked)


@query(f"""WITH {REVIEWED.sql}, {SHOWN.sql}, a(term_id) AS (VALUES (1), (2), (3), (4), (5), (6), (7), (99)) SELECT a.term_id, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'watchlist' THEN 'watchlist' WHEN status <> 'in_review' THEN 'not_in_review'
 WHEN NOT EXISTS (SELECT 1 FROM sh WHERE sh.term_id = a.term_id) OR EXISTS (SELECT 1 FROM sh WHERE sh.term_id = a.term_id AND license_class NOT IN ('permissive', 'share_alike', 'internal')) THEN 'licence'
 WHEN NOT EXISTS (SELECT 1 FROM sh WHERE sh.term_id = a.term_id AND evidence_type IN ('origin', 'definition')) THEN 'evidence' ELSE 'activated' END AS outcome FROM a LEFT JOIN rv ON a.term_id = rv.term_id""")
def w5_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activated(spark)[1].select(F.col("term_id").cast("int").alias("term_id"), "outcome")


@query(f"WITH {REVIEWED.sql} SELECT term_id, CASE WHEN term_id = 1 THEN 'active' ELSE status END AS status FROM rv")
def w5_terms_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activated(spark)[0]["term"].select("term_id", "status")


@query(f"WITH {TERM_ROWS.sql}, {EVIDENCE.sql}, aft AS (SELECT * FROM ev WHERE NOT (term_id = 1 AND evidence_type = 'origin')) SELECT term_id FROM tm WHERE status = 'active' AND term_id IN (SELECT term_id FROM ev WHERE evidence_type IN ('origin', 'definition')) AND term_id NOT IN (SELECT term_id FROM aft WHERE evidence_type IN ('origin', 'definition'))")
def j10_retention_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = EVIDENCE.df(spark)
    return curation.retention_violations(before, before.where("NOT (term_id = 1 AND evidence_type = 'origin')"), TERM_ROWS.df(spark)).select("term_id")


MARKERS = Inline("mr", "marker_id int, name string", [(1, "hand (left)"), (2, "hand"), (3, "eye"), (4, "eye (open) wide")])
ASKED = Inline("ak", "id int, surface string", [(1, "hand"), (2, "eye"), (3, "hand (left)"), (4, "foot"), (5, None)])


@query(f"WITH {MARKERS.sql}, {ASKED.sql} SELECT id, coalesce((SELECT min(marker_id) FROM mr WHERE name = surface OR split_part(name, ' (', 1) = surface), -1) AS marker_id FROM ak")
def j12_resolve_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.resolve_marker(ASKED.df(spark), MARKERS.df(spark), "surface").select("id", F.coalesce("marker_id", F.lit(-1)).alias("marker_id"))


VERDICTS = Inline("ve", "id int, verdict string", [(2, "approve"), (4, "reject"), (9, "approve"), (12, "uncertain"), (13, "odd"), (16, None), (98, "approve")])


@query(f"WITH {APPLY.sql}, {VERDICTS.sql} SELECT ap.id, CASE WHEN ap.status = 'pending' AND verdict = 'approve' THEN 'approved' WHEN verdict = 'reject' THEN 'rejected' ELSE ap.status END AS status FROM ap LEFT JOIN ve ON ap.id = ve.id")
def s15_apply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = curation.parse(APPLY.df(spark)).select(F.col("id").cast("long").alias("id"), "status", "c")
    tables, _ = workflow.apply_verdicts({"queue": queue}, VERDICTS.df(spark).withColumn("id", F.col("id").cast("long")), "judge")
    return tables["queue"].select(F.col("id").cast("int").alias("id"), "status")


# ---- plans and gates -------------------------------------------------------
@query(f"WITH {APPLY.sql}, e AS (SELECT id, i, json_extract_string(json, '$.payload.evidence[' || i || '].title') AS title, json_extract_string(json, '$.payload.evidence[' || i || '].license') AS l, json_extract_string(json, '$.payload.evidence[' || i || '].source_type') AS s FROM ap, range(0, 4) r(i) WHERE json_extract_string(json, '$.kind') = 'new_term') SELECT id, title, CASE WHEN l LIKE '%SA%' THEN 'share_alike' WHEN l = 'MIT' OR s = 'news' THEN 'permissive' ELSE 'unknown' END AS license_class, coalesce(CASE WHEN s = 'news' AND l IS NULL THEN {sql_value(curation.NEWS_NOTE)} END, '') AS note FROM e")
def p14_evidence_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curation.term_plan(curation.parse(APPLY.df(spark)))["evidence"]
    # The plan has the class; the note comes from the same wording.
    rows = curation.parse(APPLY.df(spark)).where("c.kind = 'new_term'").select("id", F.explode("c.payload.evidence").alias("e")).select("id", "e.title", curation.license_note(F.col("e.license"), F.col("e.source_type")).alias("note"))
    return plan.join(rows, ["id", "title"]).select("id", "title", "license_class", F.coalesce("note", F.lit("")).alias("note"))


@query(f"WITH {APPLY.sql}, k AS (SELECT id, json_extract_string(json, '$.kind') AS kind, json_extract(json, '$.payload') AS p FROM ap) SELECT id, kind, coalesce({_P('surface')}, {_P('variant')}, {_P('name')}, {_P('title')}, {_P('target_surface')}) AS shown FROM k")
def p14_row_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curation.parse(APPLY.df(spark))
    term, other = curation.term_plan(c)["term"], curation.other_plans(c)
    names = {"variant": ("new_variant", "variant"), "marker": ("new_marker", "name"), "incident": ("incident", "title"), "deprecation": ("deprecation", "target_surface")}
    out = term.select("id", F.lit("new_term").alias("kind"), F.col("surface").alias("shown"))
    for plan, (kind, column) in names.items():
        out = out.unionByName(other[plan].select("id", F.lit(kind).alias("kind"), F.col(column).alias("shown")))
    return out


@query(f"WITH {EVIDENCE.sql}, g AS (SELECT term_id, list_sort(list_filter(list(DISTINCT license_class), lambda c: c IS NOT NULL)) AS cs FROM ev GROUP BY term_id), b AS (SELECT term_id, coalesce(cs, []) AS cs, list_filter(coalesce(cs, []), lambda c: c NOT IN ('permissive', 'share_alike', 'internal')) AS bad FROM g) SELECT term_id, CASE WHEN len(bad) > 0 THEN {sql_value(curation.GATE_REASONS['blocked'])} || array_to_string(bad, ', ') WHEN len(cs) = 0 THEN {sql_value(curation.GATE_REASONS['empty'])} WHEN list_contains(cs, 'share_alike') THEN {sql_value(curation.GATE_REASONS['shared'])} ELSE {sql_value(curation.GATE_REASONS['free'])} END AS reason FROM b")
def p11_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.license_gate(EVIDENCE.df(spark)).select("term_id", "reason")


@query("WITH i AS (SELECT o_orderkey AS id, o_custkey AS dedup_key, o_orderpriority AS kind FROM orders WHERE o_orderkey % 3 <> 0), q AS (SELECT DISTINCT o_custkey AS dedup_key, o_orderpriority AS kind FROM orders WHERE o_orderkey % 3 = 0), t AS (SELECT count(DISTINCT (dedup_key, kind)) AS n FROM i WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.dedup_key = i.dedup_key AND q.kind = i.kind)) SELECT n AS inserted, (SELECT count(*) FROM i) - n AS skipped FROM t")
def s8_insert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders stand in for items: two thirds come in, the others are there already.
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dedup_key"), F.col("o_orderpriority").alias("kind"))
    return curation.insert_counts(o.where("id % 3 <> 0"), o.where("id % 3 = 0"))


# ---- views -----------------------------------------------------------------
@query("SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderstatus = 'O' ORDER BY id LIMIT 300")
def f7_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders stand in for the queue, open ones for pending items; the limit is the operator's own.
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"))
    return curation.pending(o, most=300).select("id", "owner")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34)")
def f7_pending_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"))
    return curation.pending(o, [1, 2, 3, 4, 5, 6, 7, 32, 33, 34]).select("id")


@query("SELECT o_orderkey AS term_id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def f8_terms_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders stand in for terms; the view shows the latest 200.
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("term_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return curation.terms_by_status(o, ["F", "P"]).select("term_id", "status")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def o4_latest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Events stand in for the log; the view shows the latest 200.
    return curation.latest(table(spark, sf_dir, "events"), "ts", curation.LATEST, "event_id").select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders o WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10 = 0 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') ORDER BY o_orderkey DESC LIMIT 100")
def o4_second_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders stand in for terms, returned lines for approvals; the view shows the latest 100.
    approved = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    rows = table(spark, sf_dir, "orders").join(approved, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return curation.latest(curation.audit_sample(rows, "o_orderkey"), "o_orderkey", curation.LATEST_SAMPLE).select("o_orderkey")


# ---- golden set ------------------------------------------------------------
GOLD_ENTRIES = Inline("ge", "id int, json string", [
    (1, '{"text":"t","expected":["a"],"why":"w","source":"s","added_at":"2026-01-01","set":"must_catch"}'), (2, '{"expected":[],"why":"w","source":"s","added_at":"x"}'), (3, '{"image_ref":"i","expected":[],"why":"w","added_at":"x","slot":"F8"}'),
    (4, '{"text":"t","expected":[],"why":"w","source":"s","added_at":"x","set":"odd","slot":"odd","gate_status":"odd"}'), (5, '{"text":"t","why":"w","source":"s","added_at":"x","gate_status":"deferred_variants"}'),
])
_G = "(json->>'$.{}')".format


@query(f"WITH {GOLD_ENTRIES.sql} SELECT id, array_to_string(list_filter([CASE WHEN json_extract(json, '$.expected') IS NULL OR {_G('why')} IS NULL OR {_G('source')} IS NULL OR {_G('added_at')} IS NULL THEN 'fields' END, CASE WHEN {_G('text')} IS NULL AND {_G('image_ref')} IS NULL THEN 'input' END, CASE WHEN {_G('set')} NOT IN ('must_catch', 'must_pass', 'evasion') THEN 'set' END, CASE WHEN {_G('slot')} = 'odd' THEN 'slot' END, CASE WHEN {_G('gate_status')} = 'odd' THEN 'gate_status' END], lambda x: x IS NOT NULL), ',') AS errors FROM ge")
def v10_golden_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GOLD_ENTRIES.df(spark).select("id", F.array_join(curation.golden_errors(F.from_json("json", curation.GOLDEN)), ",").alias("errors"))


EVASIONS = Inline("eb", "id int, evasion_kind string, ok boolean, bucket string", [(1, "leet", True, None), (2, "leet", False, None), (3, "jamo", True, None), (4, "jamo", False, "deferred_variants"), (5, "gap", False, "pending_lexicon"), (6, "gap", True, None), (7, None, False, None)])


@query(f"WITH {EVASIONS.sql} SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS n, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS recall FROM (SELECT *, coalesce(evasion_kind, '?') AS kind FROM eb WHERE bucket IS NULL) GROUP BY ROLLUP (kind)")
def a3_evasion_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_by_kind(EVASIONS.df(spark)).select(F.coalesce("evasion_kind", F.lit("all")).alias("kind"), "n", F.col("rate").alias("recall"))


PASSED = Inline("ps", "id int, slot string, grade string, recommendation string, bucket string", [(1, "F8", "ambiguous", "review_recommended", None), (2, "F8", "strict", "none", None), (3, "F9", "strict", "monitor", None), (4, "F9", "ambiguous", "revise_recommended", None), (5, "F9", "ambiguous", "review_recommended", "pending_lexicon"), (6, "F11", "marketing", "none", None)])


@query(f"WITH {PASSED.sql}, g AS (SELECT *, CASE WHEN grade = 'ambiguous' THEN recommendation <> 'revise_recommended' ELSE recommendation = 'none' END AS ok FROM ps WHERE bucket IS NULL) SELECT CASE WHEN grouping(slot) = 1 THEN 'all' ELSE slot END AS slot, count(*) AS n, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS rate, count(*) FILTER (grade = 'ambiguous' AND recommendation = 'review_recommended') AS review_hits FROM g GROUP BY ROLLUP (slot)")
def a2_must_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.must_pass(PASSED.df(spark)).select(F.coalesce("slot", F.lit("all")).alias("slot"), "n", "rate", "review_hits")


@query(f"WITH {_CAUGHT_SQL} SELECT 'recall' AS line, printf('%.1f%% (%d/%d)', 100.0 * count(*) FILTER (ok) / count(*), count(*) FILTER (ok), count(*)) AS value FROM s WHERE bucket IS NULL UNION ALL SELECT 'deferred', CAST((SELECT count(*) FROM s WHERE bucket IS NOT NULL) AS VARCHAR) UNION ALL SELECT 'missed ' || id, array_to_string(expected, ', ') FROM s WHERE bucket IS NULL AND NOT ok")
def s14_golden_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.golden_report(_scored_golden(spark))


# ---- classifier in the check -----------------------------------------------
_WEIGHT_SQL = "((idx % 7) - 3) / 1000.0"


def _model(spark: SparkSession) -> classifier.Dense:
    weights = spark.range(classifier.DIM + 5).select(F.col("id").alias("idx"), (((F.col("id") % 7) - 3) / F.lit(1000.0)).alias("w"))
    return classifier.Model(weights, 0.05, 0.9).dense()


_CONTEXT_SQL = f"{_FEATURES_SQL}, sc AS (SELECT id, 1 / (1 + exp(-(0.05 + sum(val * {_WEIGHT_SQL})) / 0.9)) AS ctx FROM f GROUP BY id), oc AS (SELECT item_id AS id, len(string_split(lower(text), 'the')) - 1 AS n FROM benchmark WHERE contains(lower(text), 'the'))"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    only_keys = {"skip_char": False, "morpheme_boundary": False, "safe_context": False, "pattern": False, "combination": False, "quotation": False}
    lexicon = Lexicon((Entry(1, "the", (("the", None),), ambiguity="ambiguous", severity=5),))
    return check(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"), lexicon, only_keys, "id", _model(spark))


@query(f"WITH {_CONTEXT_SQL} SELECT oc.id, round(ctx, 6) AS context_score, round(ctx, 6) AS risk, CAST(n AS BIGINT) AS n FROM oc JOIN sc ON oc.id = sc.id")
def p3_classifier_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    return rows.groupBy("id", F.round("context_score", 6).alias("context_score"), F.round("risk_score", 6).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CONTEXT_SQL} SELECT oc.id, CASE WHEN ctx BETWEEN 0.4 AND 0.6 THEN 'context_low_confidence' ELSE '' END AS flags, CAST(n AS BIGINT) AS n FROM oc JOIN sc ON oc.id = sc.id")
def p6_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("id", F.array_join("flags", ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


TRAIN = Inline("tr", "id int, label int, a double, b double", [(1, 1, 1.0, 0.0), (2, 1, 2.0, 1.0), (3, 0, 0.0, 1.0), (4, 0, 0.0, 2.0), (5, 0, 1.0, 1.0)])
_STEP = "SELECT {n} AS round, x.bias - 0.5 * sum(g) AS bias, x.wa - 0.5 * (sum(g * a) + 1e-4 * x.wa) AS wa, x.wb - 0.5 * (sum(g * b) + 1e-4 * x.wb) AS wb FROM (SELECT x.*, a, b, (CASE label WHEN 1 THEN 5 / 4.0 ELSE 5 / 6.0 END) * (1 / (1 + exp(-(x.bias + x.wa * a + x.wb * b))) - label) / 5.0 AS g FROM {before} x, tr) x GROUP BY x.bias, x.wa, x.wb"


@query(f"WITH {TRAIN.sql}, r0 AS (SELECT 0 AS round, CAST(0 AS DOUBLE) AS bias, CAST(0 AS DOUBLE) AS wa, CAST(0 AS DOUBLE) AS wb), {', '.join(f'r{i} AS ({_STEP.format(n=i, before=f'r{i - 1}')})' for i in range(1, 6))} SELECT round(bias, 6) AS bias, round(wa, 6) AS wa, round(wb, 6) AS wb FROM r5")
def c5_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TRAIN.df(spark)
    feats = rows.select("id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("idx"), F.col("a").alias("val")), F.struct(F.lit(1).cast("long").alias("idx"), F.col("b").alias("val")))).alias("x")).select("id", "x.*").where("val <> 0")
    model = classifier.fit(feats, rows.select("id", "label"), rounds=5)
    w = lambda i: F.round(F.max(F.when(F.col("idx") == i, F.col("w"))), 6)
    return model.weights.agg(w(0).alias("wa"), w(1).alias("wb")).select(F.round(F.lit(model.bias), 6).alias("bias"), "wa", "wb")


@query("WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey AS surface, CAST(CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.2, 0)) ELSE 0 END AS BIGINT) AS n_val, n FROM s")
def o7_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Suppliers stand in for surfaces.
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("surface"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    split = classifier.stratified_split(rows)
    return split.groupBy("surface").agg(F.sum(F.col("is_val").cast("long")).alias("n_val"), F.count(F.lit(1)).alias("n"))


# ---- orders, tokens, invisible characters ----------------------------------
TOKENS = Inline("tk", "id int, text string, edge string", [(1, "새바다", "none"), (2, "새바다", "unknown"), (3, "새바다", "known"), (4, "x바다", "known"), (5, "바다새", "unknown"), (6, "새바다", "outside")])


@query(f"WITH {TOKENS.sql} SELECT id, CASE WHEN edge = 'unknown' THEN 'oov_boundary_kept' ELSE '' END AS flags FROM tk WHERE NOT (edge = 'known' AND regexp_matches(text, '[가-힣]바다|바다[가-힣]'))")
def f3_edge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.instr("text", "바다") - 1
    # A token that crosses the edge at which a syllable stands; one that lies outside crosses none.
    crossing = F.when(at > 0, F.struct((at - 1).alias("s"), (at + 1).alias("e"), (F.col("edge") == "unknown").alias("oov"))).otherwise(F.struct((at + 1).alias("s"), (at + 3).alias("e"), (F.col("edge") == "unknown").alias("oov")))
    outside = F.struct(F.lit(0).alias("s"), at.alias("e"), F.lit(False).alias("oov"))
    tokens = F.when(F.col("edge") == "none", F.array().cast("array<struct<s:int,e:int,oov:boolean>>")).when(F.col("edge") == "outside", F.array(outside)).otherwise(F.array(crossing))
    docs = TOKENS.df(spark).select("id", "text", F.array().cast("array<struct<s:int,e:int,oov:boolean>>").alias("tokens"), tokens.alias("base_tokens"))
    lexicon = Lexicon((Entry(1, "바다", ((tx.normalise("바다")[0], None),)),))
    return check(docs, lexicon, {"quotation": False}, "id").select("id", F.array_join("flags", ",").alias("flags"))


TOKENED = Inline("tn", "id int, text string, s int, e int", [(1, "a sea b", 2, 5), (2, "a seaside b", 2, 9), (3, "undersea", 0, 8), (4, "sea", 0, 3), (5, "the sea", 0, 7), (6, "sea x", 4, 5)])


@query(f"WITH {TOKENED.sql} SELECT id FROM tn WHERE NOT (s <= strpos(text, 'sea') - 1 AND strpos(text, 'sea') + 2 <= e AND e - s > 3)")
def f2_given_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = TOKENED.df(spark).select("id", "text", F.array(F.struct("s", "e", F.lit(False).alias("oov"))).alias("tokens"))
    return check(docs, Lexicon((Entry(1, "sea", (("sea", None),)),)), {"quotation": False}, "id").select("id")


INVISIBLES = Inline("iv", "id int, t string", [(1, "a​b"), (2, "﻿word"), (3, "soft­hyphen⁠s"), (4, "‎‏᠎"), (5, "no marks"), (6, "a‌‍B")])


@query(f"WITH {INVISIBLES.sql} SELECT id, lower(regexp_replace(t, '[{tx.INVISIBLE}]', '', 'g')) AS norm FROM iv")
def n5_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.normalised(INVISIBLES.df(spark), "t", "norm").select("id", "norm")


# The text, the length of its normalised form and the source index of each of its characters.
CLUSTERS = Inline("cl", "id int, t string, size int, offsets string", [
    (1, "é", 1, "0"), (2, "ab", 2, "0,1"), (3, "á̧b", 2, "0,3"), (4, "́", 0, ""), (5, "가́나", 4, "0,0,2,2"), (6, "ño", 2, "0,2"), (7, "ﬁx", 3, "0,0,1"),
])


@query(f"WITH {CLUSTERS.sql} SELECT id, size, offsets FROM cl")
def n2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.normalised(CLUSTERS.df(spark).select("id", "t"), "t", "norm", "offsets")
    return rows.select("id", F.length("norm").alias("size"), F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("offsets"))


@query("WITH k(p, key) AS (VALUES (1, 'hation'), (1, 'ation'), (2, 'th[a-e]nd')), hit AS (SELECT doc_id, key, string_split(lower(text), key) AS ps FROM documents JOIN k ON p = 1 AND contains(lower(text), key)), o AS (SELECT doc_id, CAST(list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + (i - 1) * length(key) AS INT) AS s, length(key) AS n FROM hit, unnest(range(1, len(ps))) AS u(i)) SELECT doc_id, s AS start_pos, CAST(s + n AS INT) AS end_pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, s + n) AS INT) AS place FROM o")
def o1_match_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    only_keys = {"skip_char": False, "morpheme_boundary": False, "safe_context": False, "pattern": False, "combination": False, "quotation": False}
    docs = check_documents(table(spark, sf_dir, "documents"), Lexicon((Entry(1, "hation", (("hation", None),)), Entry(2, "ation", (("ation", None),)))), only_keys)
    return docs.select("doc_id", F.posexplode("m").alias("at", "x")).select("doc_id", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), (F.col("at") + 1).alias("place"))


# ---- leet spellings --------------------------------------------------------
_INITIAL = "(unicode(c) - 44032) // 588 = 11"
_UPRIGHT = "(unicode(c) - 44032) % 588 // 28 = 20"


def _leet_sql() -> str:
    tail = f"substring('{tx.MEDIALS}', (unicode(c) - 44032) % 588 // 28 + 1, 1) || CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN substring('{tx.FINALS}', (unicode(c) - 44032) % 28, 1) ELSE '' END"
    return f"""c AS (SELECT id, surface, i, substring(surface, i, 1) AS c FROM sf, unnest(range(1, length(surface) + 1)) AS u(i)),
h AS (SELECT * FROM c WHERE unicode(c) BETWEEN 44032 AND 55203),
f AS (SELECT id, surface, i, o, CASE WHEN o <= 2 THEN CASE o WHEN 1 THEN '0' ELSE 'o' END || {tail} ELSE c || CASE o WHEN 3 THEN '1' WHEN 4 THEN 'l' ELSE 'i' END END AS w FROM h, range(1, 6) r(o) WHERE (o <= 2 AND {_INITIAL}) OR (o > 2 AND {_UPRIGHT})),
one AS (SELECT id, 1 AS pass, i AS i, 0 AS j, o AS a, 0 AS b, substring(surface, 1, i - 1) || w || substring(surface, i + 1) AS variant FROM f),
two AS (SELECT x.id, 2 AS pass, x.i, y.i AS j, x.o AS a, y.o AS b, substring(x.surface, 1, x.i - 1) || x.w || substring(x.surface, x.i + 1, y.i - x.i - 1) || y.w || substring(x.surface, y.i + 1) AS variant FROM f x JOIN f y ON x.id = y.id AND x.i < y.i),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pass, i, j, a, b) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two)),
first AS (SELECT id, variant, min(n) AS n FROM l GROUP BY id, variant)"""


@query(f"WITH {SURFACES.sql}, {_leet_sql()} SELECT id, variant, CAST(place AS INT) AS place FROM (SELECT id, variant, row_number() OVER (PARTITION BY id ORDER BY n) AS place FROM first) WHERE place <= 20")
def g4_leet_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.generate(SURFACES.df(spark)).where("variant_kind = 'leet'")
    return rows.select("id", "variant", F.row_number().over(Window.partitionBy("id").orderBy("pos")).alias("place"))

