"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiguard.llm import chat, decontaminate, extract, lines, middle, near, packing, pii, secrets, toxicity, trie, warc, weighted
from lexiguard.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.fingerprints(table(spark, sf_dir, "documents"))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")), warc.SLICE_RECORDS)
    head = lambda k: F.try_element_at("headers", F.lit(k))
    return found.select("record_id", "address", "status", F.coalesce("response_id", F.lit(-1)).alias("response_id"), head("etag").alias("etag"), head("content-length").alias("content_length"), head("date").alias("capture_date"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_pii finds without its method's additions, which SQL can express."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_secrets finds without its method's additions, which SQL can express."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_chat": op3_chat,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_secrets": op5_secrets,
    "op6_lines": op6_lines,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_revisits": op9_revisits,
    "op10_decontaminate": op10_decontaminate,
    "op11_main_text": op11_main_text,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pii_base_spans": pii_base_spans,
    "secret_base_spans": secret_base_spans,
}


def _matches_sql(kind: str, pattern: str, place: int, fine: str) -> str:
    """Rows (doc_id, place, kind, s, e) of a pattern's matches m in d(doc_id, t); what lies between matches tells where they are."""
    return f"""{kind}_l AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d),
{kind}_a AS (SELECT doc_id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM {kind}_l),
{kind}_b AS (SELECT doc_id, m, list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS s FROM {kind}_a),
{kind} AS (SELECT doc_id, {place} AS place, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM {kind}_b WHERE {fine})"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _digest_sql(kinds: tuple[str, ...], order: str) -> str:
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in kinds)
    spans = " UNION ALL ".join(f"SELECT * FROM {k}" for k in kinds)
    return f"all_spans AS ({spans}) SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}), '')) AS base_sha256 FROM d LEFT JOIN all_spans a ON d.doc_id = a.doc_id GROUP BY d.doc_id"


PII_SQL = "WITH " + ",\n".join([
    _DOCS,
    _matches_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 1, "true"),
    _matches_sql("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 2, "len(list_filter(string_split(m, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR TRY_CAST(p AS HUGEINT) > 255)) = 0"),
    _matches_sql("card", r"[0-9](?:[\x20-]?[0-9])+", 3, f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END"),
    _matches_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 4, f"length({_DIGITS}) BETWEEN 8 AND 15"),
    _digest_sql(("email", "ip", "card", "phone"), "place, s"),
])

_KEYWORD = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?"
SECRET_SQL = "WITH " + ",\n".join([
    _DOCS,
    _matches_sql("assign", _KEYWORD + "[A-Za-z0-9+/_.=-]+", 1, f"length(regexp_replace(m, '^{_KEYWORD}', '')) >= 12"),
    _matches_sql("access", "AKIA[A-Z0-9]+", 2, "length(m) >= 18"),
    _matches_sql("hex", "[0-9a-f]+", 3, "length(m) >= 16"),
    _digest_sql(("assign", "access", "hex"), "s, place"),
])

NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS x FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(least(r.root, w.doc_id)) AS component_id, w.doc_id = min(least(r.root, w.doc_id)) AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.node = w.doc_id GROUP BY w.doc_id, n.n"""

SQL: dict[str, str] = {
    "op3_chat": chat.COLLAPSE_SQL,
    "op4_near_duplicates": NEAR_SQL,
    "op9_revisits": warc.RESOLVE_SQL,
    "op12_conversation_trie": trie.TRIE_SQL,
    "op13_fill_in_middle": middle.MIDDLE_SQL,
    "pii_base_spans": PII_SQL,
    "secret_base_spans": SECRET_SQL,
}
