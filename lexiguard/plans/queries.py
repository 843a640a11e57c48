"""Registered queries for the detection, curation, release and evaluation operators, with SQL that computes the same otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiguard.functions import text as tx
from lexiguard.operators import classifier, curation, detect, evaluate, intervals, release, variants
from lexiguard.operators.detect import Entry, Lexicon, Rule
from lexiguard.plans import similar
from lexiguard.plans.check import ADVICE, advice, check, check_documents, check_partially
from lexiguard.plans.inline import Inline, sql_value
from lexiguard.plans.registry import query, table

# A neutral lexicon: parts of the tables' invented words. None of these keys overlaps itself.
KEYS = Inline("k", "term_id int, surface string, variant_kind string, severity int, ambiguity string, status string, dogwhistle boolean", [
    (1, "oueau", None, 5, "unambiguous", "active", False), (2, "intion", None, 4, "unambiguous", "active", False), (3, "erkeit", "leet", 4, "unambiguous", "active", False),
    (4, "hation", "chosung", 5, "unambiguous", "active", False), (5, "hable", None, 4, "ambiguous", "active", False), (6, "atble", None, 2, "common", "active", False),
    (7, "haing", "leet", 5, "ambiguous", "active", True), (8, "aiment", None, 5, "unambiguous", "watchlist", False), (9, "erlich", None, 4, "unambiguous", "active", True),
    (10, "ouelle", "jamo", 3, "unambiguous", "active", False), (11, "threen", None, 1, "unambiguous", "active", False), (12, "ereden", "chosung", 4, "common", "watchlist", False),
])


def key_lexicon(rows: list[tuple] = KEYS.rows) -> Lexicon:
    return Lexicon(tuple(Entry(t, s, ((s, kind),), severity=sev, ambiguity=amb, status=st, dogwhistle=dog) for t, s, kind, sev, amb, st, dog in rows))


ONLY_KEYS = {"skip_char": False, "morpheme_boundary": False, "safe_context": False, "pattern": False, "combination": False, "quotation": False}


def occurrences_sql(source: str, id_col: str, text: str) -> str:
    """CTEs k and occ(id, k's columns, start_pos) by splitting at keys, which is right for keys that do not overlap themselves."""
    return f"""{KEYS.sql},
hit AS (SELECT d.{id_col}, k.*, string_split(lower({text}), k.surface) AS ps FROM {source} d JOIN k ON contains(lower({text}), k.surface)),
occ AS (SELECT hit.* EXCLUDE (ps), CAST(list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + (i - 1) * length(surface) AS INT) AS start_pos FROM hit, unnest(range(1, len(ps))) AS u(i))"""


CONFIDENCE_SQL = "CAST(CASE WHEN variant_kind IS NULL THEN 1.0 WHEN variant_kind = 'chosung' THEN 0.7 ELSE 0.9 END AS DOUBLE)"
CONTEXT_SQL = "CAST(CASE WHEN ambiguity = 'unambiguous' THEN 1.0 ELSE 0.5 END AS DOUBLE)"
SCORED_SQL = f"""scored AS (SELECT *, {CONFIDENCE_SQL} AS conf, {CONTEXT_SQL} AS ctx, CAST(severity AS DOUBLE) / CAST(5.0 AS DOUBLE) * {CONFIDENCE_SQL} * {CONTEXT_SQL} AS risk FROM occ),
recs AS (SELECT *, CASE WHEN status = 'watchlist' THEN 'monitor'
  WHEN severity >= 4 AND risk >= CAST(0.7 AS DOUBLE) THEN CASE WHEN dogwhistle OR variant_kind = 'chosung' OR (ambiguity <> 'unambiguous' AND ctx < CAST(0.85 AS DOUBLE)) THEN 'review_recommended' ELSE 'revise_recommended' END
  WHEN risk >= CAST(0.35 AS DOUBLE) THEN 'review_recommended' ELSE 'monitor' END AS rec FROM scored)"""


# ---- normalisation ---------------------------------------------------------
@query("SELECT doc_id, CAST(length(lower(text)) AS INT) AS norm_len, md5(lower(text)) AS norm_md5 FROM documents")
def n_normalize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = tx.native_normalise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(norm).alias("norm_len"), F.md5(norm).alias("norm_md5"))


HANGUL = Inline("h", "id int, t string", [(1, "가나다"), (2, "값 있는 글"), (3, "바다 ABC 하늘"), (4, ""), (5, "ㄱㄴ 닭"), (6, "뷁쒧 123"), (7, "Größe 학교"), (8, "훈민정음")])


def letters_sql(expr: str) -> str:
    """Hangul syllables of an expression as letters, others in lower case."""
    at = "(unicode(c) - 44032)"
    whole = f"substring('{tx.INITIALS}', {at} // 588 + 1, 1) || substring('{tx.MEDIALS}', {at} % 588 // 28 + 1, 1) || CASE WHEN {at} % 28 > 0 THEN substring('{tx.FINALS}', {at} % 28, 1) ELSE '' END"
    return f"array_to_string(list_transform(string_split({expr}, ''), lambda c: CASE WHEN c <> '' AND unicode(c) BETWEEN 44032 AND 55203 THEN {whole} ELSE lower(c) END), '')"


def initials_sql(expr: str) -> str:
    return f"array_to_string(list_transform(string_split({expr}, ''), lambda c: CASE WHEN c <> '' AND unicode(c) BETWEEN 44032 AND 55203 THEN substring('{tx.INITIALS}', (unicode(c) - 44032) // 588 + 1, 1) ELSE c END), '')"


@query(f"WITH {HANGUL.sql} SELECT id, {letters_sql('t')} AS norm FROM h")
def n_hangul_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HANGUL.df(spark).select("id", tx.native_normalise(F.col("t")).alias("norm"))


@query(f"WITH {HANGUL.sql}, c AS (SELECT id, i, substring(t, i, 1) AS ch FROM h, unnest(range(1, length(t) + 1)) AS u(i)), w AS (SELECT id, i, length({letters_sql('ch')}) AS n FROM c) SELECT h.id, coalesce(string_agg(repeat(CAST(i - 1 AS VARCHAR) || ',', n), '' ORDER BY i), '') AS offsets FROM h LEFT JOIN w ON h.id = w.id GROUP BY h.id")
def n_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.transform(tx.native_offsets(F.col("t")), lambda i: F.concat(i.cast("string"), F.lit(","))), "")
    return HANGUL.df(spark).select("id", joined.alias("offsets"))


# ---- scans -----------------------------------------------------------------
@query(f"WITH {occurrences_sql('documents', 'doc_id', 'd.text')} SELECT doc_id, term_id, start_pos, CAST(start_pos + length(surface) AS INT) AS end_pos FROM occ")
def j1_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check(table(spark, sf_dir, "documents"), key_lexicon(), ONLY_KEYS)
    return found.select("doc_id", F.col("term_id").cast("int").alias("term_id"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query(f"WITH {occurrences_sql('pages', 'page_id', 'd.html')} SELECT page_id, term_id, count(*) AS n, min(start_pos) AS first_pos FROM occ GROUP BY ALL")
def j1_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = KEYS.df(spark).select("term_id", F.col("surface").alias("key"))
    hits = detect.scan_literal_keys(table(spark, sf_dir, "pages"), "page_id", tx.native_normalise(F.col("html")), keys)
    return hits.groupBy("page_id", "term_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


OVERLAPS = Inline("o", "id int, t string", [(1, "aaaa"), (2, "abababa"), (3, "xaax aa"), (4, "none"), (5, "aba")])
OVERLAP_KEYS = Inline("ok", "key string", [("aa",), ("aba",), ("ab",), ("a",)])


@query(f"WITH {OVERLAPS.sql}, {OVERLAP_KEYS.sql} SELECT id, key, CAST(i - 1 AS INT) AS pos FROM o, ok, unnest(range(1, length(t) + 1)) AS u(i) WHERE substring(t, i, length(key)) = key")
def j1_overlapping_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan_literal_keys(OVERLAPS.df(spark), "id", F.col("t"), OVERLAP_KEYS.df(spark))


HOMOGRAPHS = Inline("hg", "key string, term_id int", [("hable", 1), ("hable", 2), ("atble", 3), ("intion", 4), ("intion", 5)])


@query(f"WITH {HOMOGRAPHS.sql} SELECT conv_id, turn, term_id, CAST((length(lower(text)) - length(replace(lower(text), key, ''))) // length(key) AS BIGINT) AS n FROM conversations JOIN hg ON contains(lower(text), key)")
def j1_homograph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    hits = detect.scan_literal_keys(turns, "id", tx.native_normalise(F.col("text")), HOMOGRAPHS.df(spark))
    return hits.groupBy("id.conv_id", "id.turn", "term_id").agg(F.count(F.lit(1)).alias("n"))


SEA = Inline("s", "id int, t string", [(1, "푸른 바다"), (2, "바닥"), (3, "바. 다"), (4, "바 다 바다"), (5, "바...다"), (6, "가바다"), (7, "바-_다"), (8, "하늘"), (9, "ㅂㅏㄷㅏ")])
_KEY = "ㅂㅏㄷㅏ"


def sea_lexicon() -> Lexicon:
    return Lexicon((Entry(1, "바다", ((_KEY, None),)),))


NORMED_SQL = f"""{SEA.sql}, c AS (SELECT id, t, i, {letters_sql('substring(t, i, 1)')} AS ls FROM s, unnest(range(1, length(t) + 1)) AS u(i)),
ch AS (SELECT id, t, i - 1 AS src, substring(ls, j, 1) AS l, row_number() OVER (PARTITION BY id ORDER BY i, j) AS p FROM c, unnest(range(1, length(ls) + 1)) AS v(j)),
nt AS (SELECT id, any_value(t) AS t, string_agg(l, '' ORDER BY p) AS norm, list(src ORDER BY p) AS off FROM ch GROUP BY id)"""


@query(f"WITH {NORMED_SQL} SELECT id, CAST(off[i] AS INT) AS start_pos, CAST(off[i + 3] + 1 AS INT) AS end_pos, substring(t, off[i] + 1, off[i + 3] - off[i] + 1) AS matched_text FROM nt, unnest(range(1, len(off) - 2)) AS u(i) WHERE substring(norm, i, 4) = '{_KEY}'")
def j2_span_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = check(SEA.df(spark).withColumnRenamed("t", "text"), sea_lexicon(), ONLY_KEYS | {"jamo_boundary": False}, "id")
    return rows.select("id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "matched_text")


@query(f"WITH {occurrences_sql('documents', 'doc_id', 'd.text')} SELECT term_id, {CONFIDENCE_SQL} AS confidence, CASE WHEN variant_kind = 'chosung' THEN 'chosung_variant' ELSE '' END AS flags, count(*) AS n FROM occ GROUP BY ALL")
def j3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check(table(spark, sf_dir, "documents"), key_lexicon(), ONLY_KEYS)
    return found.groupBy(F.col("term_id").cast("int").alias("term_id"), F.col("match_confidence").alias("confidence"), F.array_join("flags", ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NORMED_SQL} SELECT id, regexp_replace(regexp_replace(norm, '([ㄱ-ㅣ])[. _-]([ㄱ-ㅣ])', '\\1\\2', 'g'), '([ㄱ-ㅣ])[. _-][. _-]([ㄱ-ㅣ])', '\\1\\2', 'g') AS skip_text FROM nt")
def j4_skip_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEA.df(spark).select("id", detect.native_skip_view(tx.native_normalise(F.col("t"))).alias("skip_text"))


@query(f"WITH {SEA.sql}, g(gap) AS (VALUES ('. '), (' '), ('-_')) SELECT id, CAST(strpos(t, '바' || gap || '다') - 1 AS INT) AS start_pos, '바' || gap || '다' AS matched_text, CAST(0.8 AS DOUBLE) AS confidence, 'skip_char' AS flags, CASE WHEN contains(gap, ' ') THEN 'review_recommended' ELSE 'revise_recommended' END AS rec FROM s, g WHERE contains(t, '바' || gap || '다')")
def j4_skip_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = Lexicon((Entry(1, "바다", ((_KEY, None),), severity=5),))
    rows = check(SEA.df(spark).withColumnRenamed("t", "text"), lexicon, ONLY_KEYS | {"skip_char": True}, "id").where("stage = 1")
    return rows.select("id", F.col("start").alias("start_pos"), "matched_text", F.col("match_confidence").alias("confidence"), F.array_join("flags", ",").alias("flags"), F.col("usage_recommendation").alias("rec"))


PATTERNS = Inline("p", "term_id int, pattern string", [(1, "th[a-e]nd"), (2, "[0-9]{3,4}-[0-9]{4}"), (3, "ing [a-z]{2} ")])


@query(f"WITH {PATTERNS.sql}, m AS (SELECT doc_id, term_id, unnest(regexp_extract_all(text, pattern)) AS matched_text FROM documents, p) SELECT doc_id, term_id, matched_text, count(*) AS n FROM m GROUP BY ALL")
def j5_regex_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = Lexicon(tuple(Entry(t, f"p{t}", (), term_kind="pattern", pattern=p) for t, p in PATTERNS.rows))
    found = check(table(spark, sf_dir, "documents"), lexicon, {**ONLY_KEYS, "pattern": True})
    return found.groupBy("doc_id", F.col("term_id").cast("int").alias("term_id"), "matched_text").agg(F.count(F.lit(1)).alias("n"))


_LONG_WORDS_SQL = "bw AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{7,}')) AS word FROM benchmark), rw AS (SELECT word, row_number() OVER (ORDER BY word) AS term_id FROM bw)"


@query(f"WITH {_LONG_WORDS_SQL}, m AS (SELECT doc_id, term_id, unnest(regexp_extract_all(text, word || '[a-z]{{0,3}}[.,]? [A-Za-z]')) AS matched_text FROM documents JOIN rw ON contains(text, word)) SELECT doc_id, term_id, matched_text, count(*) AS n FROM m GROUP BY ALL")
def j5_many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every longer word of the benchmark makes a pattern, so their number grows with it; the lexicon of patterns is read as a release is.
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{7,}"), 0)).alias("word")).distinct()
    entries = tuple(Entry(i + 1, w, (), term_kind="pattern", pattern=w + "[a-z]{0,3}[.,]? [A-Za-z]") for i, w in enumerate(sorted(r.word for r in words.toLocalIterator())))
    found = check(table(spark, sf_dir, "documents"), Lexicon(entries), {**ONLY_KEYS, "pattern": True})
    return found.groupBy("doc_id", "term_id", "matched_text").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PATTERNS.sql} SELECT doc_id, 'partial' AS status, CAST(sum(len(regexp_extract_all(coalesce(text, ''), pattern))) AS INT) AS n_matches, 1 AS n_faults FROM documents, p GROUP BY doc_id")
def partial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One pattern of the lexicon is broken; the others are matched all the same, and each answer says so.
    lexicon = Lexicon((Entry(9, "broken", (), term_kind="pattern", pattern="(th[a-e"), *(Entry(t, f"p{t}", (), term_kind="pattern", pattern=p) for t, p in PATTERNS.rows)))
    found = check_partially(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon, {**ONLY_KEYS, "pattern": True})
    return found.select("doc_id", "status", F.size("m").alias("n_matches"), F.size("faults").alias("n_faults"))


# ---- filters ---------------------------------------------------------------
FINALS_CORPUS = Inline("fc", "id int, t string, kind string", [(1, "각오", None), (2, "가고", None), (3, "국어", None), (4, "구거", "jamo"), (5, "국어", "jamo"), (6, "고거", None)])


@query(f"WITH {FINALS_CORPUS.sql} SELECT id, CAST(strpos({letters_sql('t')}, 'ㄱㅓ') AS INT) AS at FROM fc WHERE contains({letters_sql('t')}, 'ㄱㅓ') AND (kind = 'jamo' OR strpos({letters_sql('t')}, 'ㄱㅓ') = length({letters_sql('substring(t, 1, 1)')}) + 1)")
def f1_jamo_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key ㄱㅓ starts inside a syllable only where a final letter precedes a silent initial; there is none here but for the variants.
    out = None
    for kind in (None, "jamo"):
        lexicon = Lexicon((Entry(1, "거", (("ㄱㅓ", kind),)),))
        rows = FINALS_CORPUS.df(spark).where(F.col("kind").eqNullSafe(F.lit(kind))).withColumnRenamed("t", "text")
        part = check_documents(rows, lexicon, ONLY_KEYS).select("id", "text", F.explode("m").alias("x")).select("id", (F.length(tx.native_normalise(F.substring("text", F.lit(1), F.col("x.start")))) + 1).alias("at"))
        out = part if out is None else out.unionByName(part)
    return out


WORDS = Inline("w", "term_id int, surface string", [(1, "and"), (2, "from"), (3, "reing"), (4, "der"), (5, "que")])
WORD_OCC_SQL = f"{WORDS.sql}, hit AS (SELECT doc_id, text, w.*, string_split(lower(text), surface) AS ps FROM documents JOIN w ON contains(lower(text), surface)), occ AS (SELECT doc_id, text, term_id, surface, CAST(list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + (i - 1) * length(surface) AS INT) AS st FROM hit, unnest(range(1, len(ps))) AS u(i))"


def word_lexicon() -> Lexicon:
    return Lexicon(tuple(Entry(t, s, ((s, None),), ambiguity="ambiguous") for t, s in WORDS.rows))


@query(f"WITH {WORD_OCC_SQL} SELECT doc_id, term_id, count(*) AS n, min(st) AS first_pos FROM occ WHERE NOT regexp_matches(substring(text, st, CASE WHEN st > 0 THEN 1 ELSE 0 END), '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(substring(text, st + length(surface) + 1, 1), '[\\p{{L}}\\p{{N}}]') GROUP BY ALL")
def f2_token_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check(table(spark, sf_dir, "documents"), word_lexicon(), ONLY_KEYS | {"morpheme_boundary": True})
    return found.groupBy("doc_id", F.col("term_id").cast("int").alias("term_id")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_pos"))


_BLANK_WORD_SQL = "CASE WHEN st > 0 THEN substring(text, st, 1) ELSE ' ' END <> ' ' OR CASE WHEN st + length(surface) < length(text) THEN substring(text, st + length(surface) + 1, 1) ELSE ' ' END <> ' '"


@query(f"WITH {WORD_OCC_SQL} SELECT doc_id, term_id, count(*) AS n, min(st) AS first_pos FROM occ WHERE NOT ({_BLANK_WORD_SQL}) GROUP BY ALL")
def f2_tokens_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What lies between blanks is a token, in a table of its own.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = check(docs, word_lexicon(), ONLY_KEYS).select("doc_id", F.col("term_id").cast("int").alias("term_id"), "start", "end")
    free = intervals.rows_in_tokens(found, intervals.token_rows(docs), how="left_anti")
    return free.groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_pos"))


@query(f"WITH {WORD_OCC_SQL} SELECT doc_id, term_id, count(*) AS n, min(st) AS first_pos FROM occ WHERE NOT ({_BLANK_WORD_SQL}) GROUP BY ALL")
def f2_tokens_as_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The same tokens as an array beside each text, as a tokenizer hands them over.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = check(intervals.with_tokens(docs), word_lexicon(), ONLY_KEYS | {"morpheme_boundary": True})
    return found.groupBy("doc_id", F.col("term_id").cast("int").alias("term_id")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_pos"))


@query(f"WITH {occurrences_sql('documents', 'doc_id', 'd.text')} SELECT o.doc_id, start_pos FROM occ o JOIN documents d ON o.doc_id = d.doc_id WHERE term_id = 6 AND NOT contains(substring(d.text, greatest(start_pos - 20, 0) + 1, start_pos + 25 - greatest(start_pos - 20, 0)), 'for')")
def f4_safe_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = Lexicon((Entry(6, "atble", (("atble", None),), ambiguity="ambiguous", safe_contexts=("for",)),))
    return check(table(spark, sf_dir, "documents"), lexicon, ONLY_KEYS | {"safe_context": True}).select("doc_id", F.col("start").alias("start_pos"))


MASKED = Inline("mk", "id int, t string", [(1, "applepie applepie"), (2, "apple applepie"), (3, "applepie"), (4, "my applepie with apple")])


@query(f"WITH {MASKED.sql} SELECT id, CAST(count(*) AS BIGINT) AS n FROM mk, unnest(range(1, length(t) + 1)) AS u(i) WHERE substring(t, i, 8) = 'applepie' AND NOT contains(replace(t, 'applepie', '########'), 'apple') GROUP BY id")
def f4_safe_context_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = Lexicon((Entry(1, "applepie", (("applepie", None),), ambiguity="ambiguous", safe_contexts=("apple",)),))
    return check(MASKED.df(spark).withColumnRenamed("t", "text"), lexicon, ONLY_KEYS | {"safe_context": True}, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


# ---- scoring ---------------------------------------------------------------
NUMBERS = Inline("nb", "id int, t string", [(1, "77 원"), (2, "77"), (3, "77 code"), (4, "code"), (5, "88"), (6, "77 77")])


@query(f"WITH {NUMBERS.sql}, x(n, term) AS (VALUES ('77', 2), ('88', 3)) SELECT id, term, CASE WHEN n = '77' AND (regexp_matches(t, '원$') OR contains(t, 'code')) THEN 'composite_satisfied' ELSE 'composite_unsatisfied' END AS flag, count(*) AS c FROM nb, x, unnest(range(1, length(t) + 1)) AS u(i) WHERE substring(t, i, 2) = n GROUP BY ALL")
def p1_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = Lexicon((Entry(1, "code", (("code", None),)), Entry(2, "77", (("77", None),), term_kind="number", rules=(Rule("원$"), Rule(None, (1,)))), Entry(3, "88", (("88", None),), term_kind="number")))
    found = check(NUMBERS.df(spark).withColumnRenamed("t", "text"), lexicon, ONLY_KEYS | {"combination": True}, "id").where("term_id > 1")
    return found.groupBy("id", F.col("term_id").cast("int").alias("term"), F.array_join("flags", ",").alias("flag")).agg(F.count(F.lit(1)).alias("c"))


NEAR_TERMS = Inline("nt", "term_id int, surface string", [(1, "and"), (2, "der"), (3, "que")])
_DIGITS_NEAR = "[0-9]+"
_NEAR_SQL = f"""{NEAR_TERMS.sql}, d AS (SELECT doc_id, text, lower(text) AS t FROM documents),
hit AS (SELECT doc_id, nt.*, string_split(t, surface) AS ps FROM d JOIN nt ON contains(t, surface)),
occ AS (SELECT doc_id, term_id, CAST(list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + (i - 1) * length(surface) AS INT) AS s, length(surface) AS n FROM hit, unnest(range(1, len(ps))) AS u(i)),
dl AS (SELECT doc_id, regexp_extract_all(text, '{_DIGITS_NEAR}') AS ms, regexp_split_to_array(text, '{_DIGITS_NEAR}') AS ps FROM documents),
dg AS (SELECT doc_id, list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS s, length(ms[i]) AS n FROM dl, unnest(range(1, len(ms) + 1)) AS u(i)),
o1 AS (SELECT doc_id, s, n FROM occ WHERE term_id = 1),
na AS (SELECT DISTINCT o1.doc_id, o1.s FROM o1 JOIN occ b ON b.doc_id = o1.doc_id AND b.term_id IN (2, 3) AND b.s <= o1.s + o1.n + 12 AND b.s + b.n >= o1.s - 12),
nb AS (SELECT DISTINCT o1.doc_id, o1.s FROM o1 JOIN dg b ON b.doc_id = o1.doc_id AND b.s <= o1.s + o1.n + 40 AND b.s + b.n >= o1.s - 40)"""


@query(f"WITH {_NEAR_SQL} SELECT o1.doc_id, o1.s AS start_pos, CASE WHEN nb.s IS NOT NULL THEN 5 WHEN na.s IS NOT NULL THEN 3 ELSE 1 END AS severity, nb.s IS NOT NULL OR na.s IS NOT NULL AS satisfied FROM o1 LEFT JOIN na ON na.doc_id = o1.doc_id AND na.s = o1.s LEFT JOIN nb ON nb.doc_id = o1.doc_id AND nb.s = o1.s")
def p1_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A word stands in for a number term: severe beside digits, less so beside two other words, hardly alone.
    rules = (Rule(None, (2, 3), 12, 1, 2), Rule(_DIGITS_NEAR, (), 40, 1, 4))
    lexicon = Lexicon(tuple(Entry(t, w, ((w, None),), term_kind="number" if t == 1 else "word", rules=rules if t == 1 else ()) for t, w in NEAR_TERMS.rows))
    found = check(table(spark, sf_dir, "documents"), lexicon, ONLY_KEYS | {"combination": True}, distances=True).where("term_id = 1")
    return found.select("doc_id", F.col("start").alias("start_pos"), "severity", F.array_contains("flags", "composite_satisfied").alias("satisfied"))


QUOTED = Inline("qt", "id int, t string", [(1, '"code"'), (2, '"code'), (3, "the code word"), (4, "code 라는 표현"), (5, "code................ 표현"), (6, "보도: code"), (7, "‘code’"), (8, "보code도"), (9, "'code\"")])


@query(f"WITH {QUOTED.sql}, m AS (SELECT id, t, strpos(t, 'code') - 1 AS s FROM qt), a AS (SELECT *, substring(t, greatest(s - 15, 0) + 1, s - greatest(s - 15, 0)) || substring(t, s + 5, 15) AS around, CASE WHEN s > 0 THEN substring(t, s, 1) ELSE '' END AS b, substring(t, s + 5, 1) AS e FROM m) SELECT id, (b <> '' AND e <> '' AND contains({sql_value(detect.QUOTE_MARKS)}, b) AND contains({sql_value(detect.QUOTE_MARKS)}, e)) OR list_bool_or([{', '.join(f'contains(around, {sql_value(w)})' for w in detect.META_WORDS)}]) AS quoted FROM a")
def p2_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = Lexicon((Entry(1, "code", (("code", None),)),))
    return check(QUOTED.df(spark).withColumnRenamed("t", "text"), lexicon, ONLY_KEYS | {"quotation": True}, "id").select("id", F.array_contains("flags", "quotation_heuristic").alias("quoted"))


@query(f"WITH {occurrences_sql('documents', 'doc_id', 'd.text')}, {SCORED_SQL} SELECT doc_id, term_id, start_pos, risk FROM scored")
def p4_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check(table(spark, sf_dir, "documents"), key_lexicon(), ONLY_KEYS)
    return found.select("doc_id", F.col("term_id").cast("int").alias("term_id"), F.col("start").alias("start_pos"), F.col("risk_score").alias("risk"))


@query(f"WITH {occurrences_sql('documents', 'doc_id', 'd.text')}, {SCORED_SQL} SELECT term_id, rec, count(*) AS n FROM recs GROUP BY ALL")
def p5_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check(table(spark, sf_dir, "documents"), key_lexicon(), ONLY_KEYS)
    return found.groupBy(F.col("term_id").cast("int").alias("term_id"), F.col("usage_recommendation").alias("rec")).agg(F.count(F.lit(1)).alias("n"))


LADDER = Inline("ld", "status string, ambiguity string", [("active", "unambiguous"), ("active", "ambiguous"), ("watchlist", "unambiguous")])


@query(f"WITH {LADDER.sql}, g AS (SELECT ld.*, sev, r / CAST(20 AS DOUBLE) AS risk, c / CAST(20 AS DOUBLE) AS ctx, dog, cap, uns FROM ld, range(1, 6) a(sev), range(0, 21) b(r), range(16, 19) x(c), (VALUES (true), (false)) d(dog), (VALUES (true), (false)) e(cap), (VALUES (true), (false)) f(uns)) SELECT status, ambiguity, CAST(sev AS INT) AS sev, risk, ctx, dog, cap, uns, CASE WHEN status = 'watchlist' OR uns THEN 'monitor' WHEN sev >= 4 AND risk >= CAST(0.7 AS DOUBLE) AND NOT (dog OR cap OR (ambiguity <> 'unambiguous' AND ctx < CAST(0.85 AS DOUBLE))) THEN 'revise_recommended' WHEN (sev >= 4 AND risk >= CAST(0.7 AS DOUBLE)) OR risk >= CAST(0.35 AS DOUBLE) THEN 'review_recommended' ELSE 'monitor' END AS rec FROM g")
def p5_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    both = lambda: F.explode(F.array(F.lit(True), F.lit(False)))
    g = LADDER.df(spark)
    for name, c in (("sev", numbers(1, 5)), ("r", numbers(0, 20)), ("c", numbers(16, 18)), ("dog", both()), ("cap", both()), ("uns", both())):
        g = g.withColumn(name, c)
    g = g.withColumns({"risk": F.col("r") / F.lit(20.0), "ctx": F.col("c") / F.lit(20.0)}).drop("r", "c")
    return g.withColumn("rec", detect.recommendation(F.col("status"), F.col("uns"), F.col("sev"), F.col("risk"), F.col("dog"), F.col("cap"), F.col("ambiguity"), F.col("ctx")))


@query(f"WITH {occurrences_sql('documents', 'doc_id', 'd.text')}, {SCORED_SQL}, best AS (SELECT doc_id, max(CASE rec WHEN 'revise_recommended' THEN 3 WHEN 'review_recommended' THEN 2 ELSE 1 END) AS r, count(*) AS n FROM recs GROUP BY doc_id) SELECT d.doc_id, CASE r WHEN 3 THEN 'revise_recommended' WHEN 2 THEN 'review_recommended' WHEN 1 THEN 'monitor' ELSE 'none' END AS overall, CAST(coalesce(n, 0) AS INT) AS n_matches FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id")
def p7_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_documents(table(spark, sf_dir, "documents"), key_lexicon(), ONLY_KEYS)
    return checked.select("doc_id", F.col("overall_recommendation").alias("overall"), F.size("m").alias("n_matches"))


RECS = Inline("rc", "rec string", [("revise_recommended",), ("review_recommended",), ("monitor",), ("none",), ("other",)])


@query(f"WITH {RECS.sql}, a(r, t) AS (VALUES {', '.join(f'({sql_value(k)}, {sql_value(v)})' for k, v in ADVICE.items())}) SELECT rec, coalesce(t, {sql_value(ADVICE['monitor'])}) AS advisory FROM rc LEFT JOIN a ON rec = r")
def p8_advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RECS.df(spark).select("rec", advice(F.col("rec")).alias("advisory"))


@query(f"WITH {occurrences_sql('documents', 'doc_id', 'd.text')} SELECT doc_id, count(*) AS n FROM occ GROUP BY doc_id")
def f11_stage_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = check_documents(table(spark, sf_dir, "documents"), key_lexicon(), {**ONLY_KEYS, "no_such_stage": True})
    return rows.where(F.size("m") > 0).select("doc_id", F.size("m").cast("long").alias("n"))


# ---- curation --------------------------------------------------------------
LICENSES = Inline("li", "id int, license string, source_type string", [
    (1, "CC BY-SA 4.0", "wiki"), (2, "CC-BY-NC-SA", "wiki"), (3, "CC BY-NC 4.0", "paper"), (4, "CC BY-ND", "paper"), (5, "CC BY 4.0", "paper"), (6, "MIT", "code"), (7, "apache 2", "code"), (8, "All rights LIMITED", "book"),
    (9, None, "news"), (10, "", "internal"), (11, "unknown", "book"), (12, "public domain", "book"), (13, "CC0", "book"), (14, "NoDerivatives", "book"), (15, "COPYRIGHT BY X", "book"), (16, "non-commercial", "news"), (17, "ccby", "book"),
])


@query(f"""WITH {LICENSES.sql}, u AS (SELECT id, source_type, replace(upper(trim(coalesce(license, ''))), '-', ' ') AS t FROM li)
SELECT id, CASE WHEN t LIKE '%BY SA%' OR t LIKE '%SHAREALIKE%' OR t LIKE '%SHARE ALIKE%' THEN 'share_alike'
  WHEN regexp_matches(t, '(^|\\s)NC(\\s|$)') OR t LIKE '%NONCOMMERCIAL%' OR t LIKE '%NON COMMERCIAL%' THEN 'noncommercial'
  WHEN regexp_matches(t, '(^|\\s)ND(\\s|$)') OR t LIKE '%NODERIVATIVES%' OR t LIKE '%NO DERIVATIVES%' THEN 'no_derivatives'
  WHEN t LIKE '%MIT%' OR t LIKE '%APACHE%' OR t LIKE '%CC0%' OR t LIKE '%PUBLIC DOMAIN%' OR t LIKE '%BY %' OR t LIKE '%CC BY%' THEN 'permissive'
  WHEN source_type IN ('news', 'internal') THEN 'permissive' ELSE 'unknown' END AS license_class FROM u""")
def p10_license_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LICENSES.df(spark).select("id", curation.license_class(F.col("license"), F.col("source_type")).alias("license_class"))


EVIDENCE = Inline("ev", "term_id int, license_class string, evidence_type string", [
    (1, "permissive", "origin"), (1, "share_alike", "usage"), (2, "permissive", "usage"), (2, "unknown", "usage"), (2, "noncommercial", "incident"), (3, "internal", "definition"), (4, "share_alike", "usage"), (4, "restricted", "usage"), (5, None, "usage"),
])


@query(f"""WITH {EVIDENCE.sql}, g AS (SELECT term_id, list_sort(list_filter(list(DISTINCT license_class), lambda c: c IS NOT NULL)) AS cs FROM ev GROUP BY term_id),
b AS (SELECT term_id, coalesce(cs, []) AS cs, list_filter(coalesce(cs, []), lambda c: c NOT IN ('permissive', 'share_alike', 'internal')) AS bad FROM g)
SELECT term_id, len(cs) > 0 AND len(bad) = 0 AS passes, array_to_string(bad, ',') AS blocking, CASE WHEN list_contains(cs, 'share_alike') THEN 'CC BY-SA 4.0' ELSE '자체' END AS effective_license,
CASE WHEN len(cs) = 0 OR len(bad) > 0 THEN 'restricted_eval_only' WHEN list_contains(cs, 'share_alike') THEN 'share_alike_core' ELSE 'permissive_core' END AS provenance_class FROM b""")
def p11_license_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.license_gate(EVIDENCE.df(spark)).drop("reason")


_TERM = '{"surface":"ABC 가","term_kind":"word","meaning":"m","origin_story":"o","severity":3,"ambiguity":"unambiguous","categories":["age"],"evidence":[{"url":"u","title":"t","source_type":"wiki","evidence_type":"origin","reliability":3},{"url":"u2","title":"t2","source_type":"news","evidence_type":"incident","reliability":2}],"negative_examples":["x"],"related_incidents":[{"title":"i","occurred_at":"2020","medium":"sns","source_url":"u"}]}'
CANDIDATES = Inline("ca", "id int, json string", [
    (1, '{"kind":"new_term","collector":"c","payload":' + _TERM + "}"),
    (2, _TERM),
    (3, '{"kind":"new_term","collector":"c","payload":' + _TERM.replace(',"negative_examples":["x"]', "") + "}"),
    (4, '{"kind":"new_term","collector":"c","payload":' + _TERM.replace('"word"', '"number"') + "}"),
    (5, '{"kind":"new_variant","collector":"c","payload":{"variant":"A1","variant_kind":"leet","source_url":"u","parent_surface":"a"}}'),
    (6, '{"kind":"new_variant","collector":"c","payload":{"variant":"A1","variant_kind":"leet","source_url":"u"}}'),
    (7, '{"kind":"incident","collector":"c","payload":{"title":"T","occurred_at":"2021-05","medium":"sns","source_url":"u","related_surface":"a"}}'),
    (8, '{"kind":"incident","collector":"c","payload":{"title":"T","medium":"sns","source_url":"u"}}'),
    (9, '{"kind":"deprecation","collector":"c","payload":{"target_surface":"a","inactivity_basis":"b"}}'),
    (10, '{"kind":"odd","payload":{}}'),
    (11, '{"kind":"new_term","collector":"c","payload":' + _TERM.replace('"severity":3', '"severity":7') + "}"),
    (12, '{"kind":"new_marker","collector":"c","payload":{"name":"N","marker_kind":"symbol","origin_note":"o","source_url":"u","license_note":"l"}}'),
    (13, '{"kind":"new_term","collector":"c","payload":' + _TERM.replace('"age"', '"odd"').replace('"wiki"', '"odd"').replace('"unambiguous"', '"odd"').replace('"sns"', '"odd"') + "}"),
    (14, '{"kind":"new_variant","collector":"c","payload":{"variant":"A1","variant_kind":"odd","source_url":"u","parent_term_id":"7"}}'),
    (15, '{"kind":"new_marker","collector":"c","payload":{"name":"N","marker_kind":"odd","origin_note":"o","source_url":"u","license_note":"l"}}'),
    (16, '{"kind":"incident","collector":"c","payload":{"title":"T","occurred_at":"2021","medium":"odd","source_url":"u","related_surface":"a"}}'),
])
_J = "json_extract_string(j, '$.payload.{}')".format
_CAND_SQL = f"{CANDIDATES.sql}, w AS (SELECT id, CASE WHEN json_extract_string(json, '$.kind') IS NULL AND json_extract_string(json, '$.surface') IS NOT NULL THEN '{{\"kind\":\"new_term\",\"collector\":\"manual:legacy-file\",\"payload\":' || json || '}}' ELSE json END AS j FROM ca), k AS (SELECT *, json_extract_string(j, '$.kind') AS kind FROM w)"


def _candidates(spark: SparkSession) -> DataFrame:
    return curation.parse(CANDIDATES.df(spark))


def _names(where: str, names: tuple[str, ...]) -> str:
    """Whether a value in the payload is none of the names."""
    return f"json_extract_string(j, '$.payload.{where}') NOT IN ({', '.join(map(sql_value, names))})"


def _any_name(where: str, names: tuple[str, ...]) -> str:
    return f"len(list_filter(coalesce(CAST(json_extract_string(j, '$.payload.{where}') AS VARCHAR[]), []), lambda x: x NOT IN ({', '.join(map(sql_value, names))}))) > 0"


#: Each rule's name, place and condition in SQL, for the candidates at hand.
_RULES_SQL = [
    ("top_level", "(root)", "kind IS NULL OR json_extract_string(j, '$.collector') IS NULL OR json_extract(j, '$.payload') IS NULL"),
    ("kind", "kind", "kind NOT IN ('new_term', 'new_variant', 'new_marker', 'incident', 'deprecation')"),
    ("negative_examples", "payload/negative_examples", "kind = 'new_term' AND coalesce(json_array_length(j, '$.payload.negative_examples'), 0) = 0"),
    ("combination_rules", "payload/combination_rules", f"kind = 'new_term' AND ({_J('term_kind')} = 'number' OR {_J('ambiguity')} = 'common') AND coalesce(json_array_length(j, '$.payload.combination_rules'), 0) = 0"),
    ("variant_fields", "payload", f"kind = 'new_variant' AND {_J('parent_surface')} IS NULL AND {_J('parent_term_id')} IS NULL"),
    ("incident_fields", "payload", f"kind = 'incident' AND ({_J('occurred_at')} IS NULL OR ({_J('related_surface')} IS NULL AND {_J('related_marker')} IS NULL))"),
    ("severity", "payload/severity", f"TRY_CAST({_J('severity')} AS INT) NOT BETWEEN 1 AND 5"),
    ("ambiguity", "payload/ambiguity", "kind = 'new_term' AND " + _names("ambiguity", curation.AMBIGUITIES)),
    ("categories", "payload/categories", "kind = 'new_term' AND " + _any_name("categories[*]", curation.CATEGORIES)),
    ("evidence_names", "payload/evidence", "kind = 'new_term' AND " + _any_name("evidence[*].source_type", curation.SOURCE_TYPES)),
    ("related_incidents", "payload/related_incidents", _any_name("related_incidents[*].medium", curation.MEDIA)),
    ("variant_kind", "payload/variant_kind", "kind = 'new_variant' AND " + _names("variant_kind", curation.VARIANT_KINDS)),
    ("marker_kind", "payload/marker_kind", "kind = 'new_marker' AND " + _names("marker_kind", curation.MARKER_KINDS)),
    ("medium", "payload/medium", "kind = 'incident' AND " + _names("medium", curation.MEDIA)),
]


def _broken_sql(shown: str) -> str:
    cases = ", ".join(f"CASE WHEN {bad} THEN '{shown.format(name=name, place=place)}' END" for name, place, bad in _RULES_SQL)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query(f"WITH {_CAND_SQL} SELECT id, array_to_string(list_slice(list_sort({_broken_sql('{place}: {name}')}), 1, 10), '; ') AS report FROM k")
def s6_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark).select("id", F.array_join(curation.error_report(F.col("c")), "; ").alias("report"))


@query(f"WITH {_CAND_SQL} SELECT id, array_to_string({_broken_sql('{name}')}, ',') AS errors FROM k")
def v_validate_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark).select("id", F.array_join(curation.validation_errors(F.col("c")), ",").alias("errors"))


@query(f"WITH {_CAND_SQL}, n AS (SELECT id, kind, coalesce(CASE kind WHEN 'new_term' THEN {_J('surface')} WHEN 'new_variant' THEN {_J('variant')} WHEN 'new_marker' THEN {_J('name')} WHEN 'incident' THEN {_J('title')} ELSE {_J('target_surface')} END, '') AS shown FROM k) SELECT id, kind || ':' || {letters_sql('shown')} AS dedup_key FROM n")
def p12_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark).select("id", curation.dedup_key(F.col("c")).alias("dedup_key"))


@query(f"WITH {_CAND_SQL} SELECT id, CAST(least(10, coalesce(json_array_length(j, '$.payload.evidence'), 0) + 2 * len(list_filter(coalesce(CAST(json_extract_string(j, '$.payload.evidence[*].evidence_type') AS VARCHAR[]), []), lambda x: x = 'incident')) + 2 * coalesce(json_array_length(j, '$.payload.related_incidents'), 0)) AS DOUBLE) AS signal FROM k")
def p13_signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark).select("id", curation.signal_score(F.col("c.payload")).alias("signal"))


DATES = Inline("dt", "id int, d string", [(1, "2020"), (2, "2020-07"), (3, "2020-07-09"), (4, "soon"), (5, "2020-13"), (6, None), (7, "20")])


@query(f"WITH {DATES.sql} SELECT id, strftime(TRY_CAST(CASE WHEN regexp_matches(d, '^[0-9]{{4}}$') THEN d || '-01-01' WHEN regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}$') THEN d || '-01' ELSE d END AS DATE), '%Y-%m-%d') AS day FROM dt")
def p15_partial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DATES.df(spark).select("id", F.date_format(curation.partial_date(F.col("d")), "yyyy-MM-dd").alias("day"))


@query("WITH i AS (SELECT o_orderkey AS id, o_custkey AS dedup_key, o_orderpriority AS kind FROM orders WHERE o_orderkey % 3 <> 0), q AS (SELECT DISTINCT o_custkey AS dedup_key, o_orderpriority AS kind FROM orders WHERE o_orderkey % 3 = 0) SELECT min(id) AS id, dedup_key, kind FROM i WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.dedup_key = i.dedup_key AND q.kind = i.kind) GROUP BY dedup_key, kind")
def s8_idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders stand in for items: two thirds come in, the others are there already.
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dedup_key"), F.col("o_orderpriority").alias("kind"))
    return curation.insert_new(o.where("id % 3 <> 0"), o.where("id % 3 = 0"))


@query("SELECT event_id, user_id, value FROM events ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, value DESC, ts, event_id LIMIT 200")
def o2_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"urgency": F.when(F.col("event_type") == "purchase", "urgent").when(F.col("event_type") == "click", "normal").otherwise("low"), "signal_score": F.col("value"), "created_at": F.col("ts")})
    return e.orderBy(*curation.queue_order(), "event_id").limit(200).select("event_id", "user_id", "value")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10 = 0")
def o5_md5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.audit_sample(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def j9_semi_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders stand in for terms, returned lines for reviews.
    reviewed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(reviewed, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


TERM_ROWS = Inline("tm", "term_id int, surface string, normalized_key string, status string, release_policy string, term_kind string, severity int, ambiguity string", [
    (1, "aaa", "aaa", "active", "release", "word", 5, "unambiguous"), (2, "bbb", "bbb", "watchlist", "advisory_only", "word", 3, "ambiguous"), (3, "ccc", "ccc", "active", "internal_only", "word", 2, "common"),
    (4, "ddd", "ddd", "draft", "release", "word", 1, "common"), (5, "aaa", "aaa", "active", "release", "phrase", 4, "ambiguous"), (6, "eee", "eee", "active", "hold_legal", "word", 4, "ambiguous"),
])


@query(f"WITH {TERM_ROWS.sql} SELECT term_id, surface FROM tm WHERE status IN ('active', 'watchlist') AND release_policy NOT IN ('internal_only', 'hold_legal')")
def f5_release_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.eligible(TERM_ROWS.df(spark)).select("term_id", "surface")


@query(f"WITH {TERM_ROWS.sql}, {EVIDENCE.sql} SELECT term_id FROM tm WHERE status = 'active' AND term_id NOT IN (SELECT term_id FROM ev WHERE evidence_type IN ('origin', 'definition'))")
def j10_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.gate_violations(TERM_ROWS.df(spark), EVIDENCE.df(spark)).select("term_id")


PARENTS = Inline("pa", "id int, parent_term_id string, parent_surface string", [(1, "2", None), (2, "99", "AAA"), (3, None, "bbb"), (4, "x", "zzz"), (5, None, None), (6, "5", "aaa")])


@query(f"WITH {TERM_ROWS.sql}, {PARENTS.sql} SELECT id, coalesce((SELECT term_id FROM tm WHERE term_id = TRY_CAST(parent_term_id AS INT)), (SELECT min(term_id) FROM tm WHERE normalized_key = lower(parent_surface)), -1) AS parent_id FROM pa")
def j12_resolve_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.resolve_parent(PARENTS.df(spark), TERM_ROWS.df(spark)).select("id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


CATEGORY = Inline("cg", "category_id int, code string", [(1, "x"), (2, "a"), (3, "m")])
TERM_CATEGORY = Inline("tc", "term_id int, category_id int", [(1, 1), (1, 2), (2, 3), (4, 1)])
VARIANT = Inline("vr", "variant_id int, term_id int, variant string, variant_kind string, verified boolean", [(3, 1, "A1A", "leet", True), (1, 1, "aa", "chosung", True), (2, 1, "no", "leet", False), (4, 2, "b", "jamo", True)])
RULE = Inline("rl", "rule_id int, term_id int, trigger_kind string, trigger_terms array<bigint>, trigger_pattern string, proximity_window int, base_severity int, severity_delta int, status string", [(1, 1, "co", [2], None, None, None, None, "active"), (2, 1, "re", None, "x$", 5, 2, 1, "active"), (3, 2, "re", None, "y", None, None, None, "draft")])


@query(f"""WITH {TERM_ROWS.sql}, {CATEGORY.sql}, {TERM_CATEGORY.sql}, {VARIANT.sql}, {RULE.sql}
SELECT term_id, release_policy = 'advisory_only' AS dogwhistle,
 coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM tc JOIN cg USING (category_id) WHERE tc.term_id = tm.term_id), '') AS categories,
 coalesce((SELECT string_agg(lower(variant), ',' ORDER BY variant_id) FROM vr WHERE vr.term_id = tm.term_id AND verified), '') AS variants,
 (SELECT count(*) FROM rl WHERE rl.term_id = tm.term_id AND rl.status = 'active') AS n_rules
FROM tm WHERE status IN ('active', 'watchlist') AND release_policy NOT IN ('internal_only', 'hold_legal')""")
def j8_release_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = TERM_ROWS.df(spark).withColumns({"pattern": F.lit(None).cast("string"), "safe_contexts": F.array().cast("array<string>")})
    nested = release.nested_terms(terms, TERM_CATEGORY.df(spark), CATEGORY.df(spark), VARIANT.df(spark), RULE.df(spark))
    return nested.select("term_id", F.col("is_dogwhistle_marker").alias("dogwhistle"), F.array_join("categories", ",").alias("categories"), F.array_join(F.transform("variants", lambda v: v.normalized_key), ",").alias("variants"), F.size("combination_rules").cast("long").alias("n_rules"))


NAMES = Inline("nm", "name string", [("2026.06.08-1",), ("2026.06.08-12",), ("2026.06.07-3",), ("latest",), ("2026.06.08-x",)])
DAYS = Inline("dy", "day string", [("2026.06.08",), ("2026.06.07",), ("2026.06.09",)])


@query(f"WITH {NAMES.sql}, {DAYS.sql} SELECT day, day || '-' || CAST(coalesce((SELECT max(CAST(split_part(name, '-', 2) AS INT)) FROM nm WHERE regexp_full_match(name, '[0-9.]+-[0-9]+') AND split_part(name, '-', 1) = day), 0) + 1 AS VARCHAR) AS version FROM dy")
def s10_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.next_versions(NAMES.df(spark), DAYS.df(spark))


@query("WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0) SELECT coalesce(a.k, b.k) AS term_id, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s")
def release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("term_id"), F.col("o_orderstatus").alias("status"))
    new = o.where("term_id % 11 <> 0").withColumn("status", F.when(F.col("term_id") % 7 == 0, "Z").otherwise(F.col("status")))
    return release.difference(o.where("term_id % 5 <> 0"), new)


MOVES = Inline("mv", "term_id int, old string, new string", [(1, "draft", "in_review"), (2, "watchlist", "active"), (3, "active", "deprecated"), (4, "deprecated", "rejected"), (5, "draft", "active"), (6, "active", "active")])


@query(f"WITH {MOVES.sql} SELECT term_id, old, new FROM mv WHERE old <> new AND new <> 'rejected' AND old || new NOT IN ('draftin_review', 'in_reviewactive', 'activedeprecated', 'deprecatedactive', 'draftwatchlist', 'watchlistdraft', 'watchlistin_review')")
def w_transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MOVES.df(spark)
    return curation.transition_violations(m.select("term_id", F.col("old").alias("status")), m.select("term_id", F.col("new").alias("status")))


# ---- variants --------------------------------------------------------------
SURFACES = Inline("sf", "id int, surface string", [(1, "하늘"), (2, "바다"), (3, "abc"), (4, ""), (5, "가A나"), (6, "이리")])


@query(f"WITH {SURFACES.sql} SELECT id, {letters_sql('surface')} AS variant, 'jamo' AS variant_kind FROM sf WHERE {letters_sql('surface')} <> lower(surface) UNION ALL SELECT id, {initials_sql('surface')}, 'chosung' FROM sf WHERE {initials_sql('surface')} <> surface")
def g1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.generate(SURFACES.df(spark)).where("variant_kind <> 'leet'")
    return rows.select("id", F.when(F.col("variant_kind") == "jamo", F.lower("variant")).otherwise(F.col("variant")).alias("variant"), "variant_kind")


MADE = Inline("md", "id int, surface_key string, variant string, variant_kind string", [(1, "abc", "ABC", "jamo"), (2, "abc", "abd", "jamo"), (3, "xyz", "xy", "chosung"), (4, "xyz", "xyz", "chosung"), (5, "x", "word", "leet"), (6, "x", "w0rd", "leet"), (7, "x", "", "leet")])
COMMON = Inline("cm", "word string", [("Word",), ("other",), ("WORD",)])


@query(f"""WITH {MADE.sql}, {COMMON.sql}, h AS (SELECT md.*, (SELECT count(DISTINCT word) FROM cm WHERE lower(word) = lower(variant)) AS n FROM md),
r AS (SELECT *, CASE WHEN variant = '' OR (variant_kind = 'jamo' AND lower(variant) <> surface_key) THEN 'key_mismatch' WHEN variant_kind = 'chosung' AND length(variant) < 3 THEN 'too_short' WHEN n > 0 THEN 'common_word' END AS reason FROM h)
SELECT id, coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN 'verified' ELSE 'rejected' END AS decision, reason IS NULL AND variant_kind = 'chosung' AS context_required FROM r""")
def g6_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = MADE.df(spark).withColumn("normalized_key", tx.native_normalise(F.col("variant")))
    return variants.classify(made, COMMON.df(spark)).select("id", F.coalesce("reason", F.lit("")).alias("reason"), "decision", "context_required")


@query(f"WITH {MADE.sql}, {COMMON.sql}, h AS (SELECT variant_kind, CASE WHEN EXISTS (SELECT 1 FROM cm WHERE lower(word) = lower(variant)) THEN 1 ELSE 0 END AS hit FROM md) SELECT coalesce(variant_kind, 'all') AS kind, count(*) AS n, CAST(sum(hit) AS BIGINT) AS n_hit, avg(hit) AS rate FROM h GROUP BY ROLLUP (variant_kind)")
def a6_fp_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = MADE.df(spark).withColumn("normalized_key", tx.native_normalise(F.col("variant")))
    return variants.collision_rates(variants.collisions(made, COMMON.df(spark))).select(F.coalesce("variant_kind", F.lit("all")).alias("kind"), "n", "n_hit", "rate")


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), k AS (SELECT word, regexp_replace(word, '[aeiou]', '', 'g') AS key, length(word) AS len FROM w),
g AS (SELECT len, key, count(*) AS n, min(word) AS first_word FROM k GROUP BY len, key HAVING count(*) >= 2)
SELECT CAST(len AS INT) AS len, key, n, first_word, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY len ORDER BY n DESC, key) AS place FROM g) WHERE place <= 8""")
def a7_key_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return variants.key_ambiguity(words, F.translate("word", "aeiou", "")).select("len", "key", "n", "first_word", "place")


# ---- evaluation and classifier ---------------------------------------------
GOLDEN = Inline("gd", "id int, slot string, grade string, expected array<string>, severity int, gate_status string, rely_on string", [
    (1, "a", "strict", ["x"], 5, None, None), (2, "a", "ambiguous", ["x", "y"], 3, None, None), (3, "b", "strict", ["z"], 5, "pending_lexicon", None), (4, "b", "marketing", ["y"], 2, None, "term_variant_row"), (5, "c", "strict", ["q"], 4, None, None),
])
FOUND = Inline("fd", "id int, surface string", [(1, "x"), (2, "x"), (2, "y"), (4, "y"), (5, "p")])
_CAUGHT_SQL = f"{GOLDEN.sql}, {FOUND.sql}, s AS (SELECT gd.*, (SELECT count(*) FROM unnest(expected) AS u(e) WHERE e NOT IN (SELECT surface FROM fd WHERE fd.id = gd.id)) = 0 AS ok, CASE WHEN gate_status IN ('pending_lexicon', 'composite_future') THEN gate_status WHEN rely_on = 'term_variant_row' THEN 'deferred_variants' END AS bucket FROM gd)"


def _scored_golden(spark: SparkSession) -> DataFrame:
    return evaluate.caught(GOLDEN.df(spark), FOUND.df(spark)).withColumn("bucket", evaluate.deferral(F.col("gate_status"), F.col("rely_on")))


@query(f"WITH {_CAUGHT_SQL} SELECT avg(CASE WHEN bucket IS NULL THEN CASE WHEN ok THEN 1.0 ELSE 0.0 END END) AS recall, avg(CASE WHEN bucket IS NULL AND severity = 5 THEN CASE WHEN ok THEN 1.0 ELSE 0.0 END END) AS recall_sev5, CAST(count(bucket) AS BIGINT) AS n_deferred FROM s")
def a1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recalls(_scored_golden(spark))


@query(f"WITH {_CAUGHT_SQL} SELECT coalesce(slot, 'all') AS slot, count(*) AS n, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS rate FROM s GROUP BY ROLLUP (slot)")
def a2_slot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pass_rates(_scored_golden(spark)).select(F.coalesce("slot", F.lit("all")).alias("slot"), "n", "rate")


@query(f"WITH {_CAUGHT_SQL}, r AS (SELECT avg(CASE WHEN bucket IS NULL THEN CASE WHEN ok THEN 1.0 ELSE 0.0 END END) AS a FROM s) SELECT g AS gate, a AS value, CAST(l AS DOUBLE) AS least, a >= l AS passed FROM r, (VALUES ('must_catch', 0.95), ('must_pass', 0.98)) v(g, l)")
def a4_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gates(evaluate.recalls(_scored_golden(spark)).select(F.col("recall").alias("must_catch"), F.col("recall").alias("must_pass")))


def _stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a made-up score of their documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "score", F.col("toxic").alias("label"))


_STAND_SQL = "st AS (SELECT l.doc_id, (n_chars % 97) / CAST(97.0 AS DOUBLE) AS score, toxic AS label FROM labels l JOIN documents d USING (doc_id))"


@query(f"WITH {_STAND_SQL}, c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM st), r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c) SELECT round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(coalesce(p, 0), 4) AS precision, round(coalesce(r, 0), 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM r")
def a10_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.confusion_metrics(_stand_in(spark, sf_dir))


@query(f"WITH {_STAND_SQL} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) / count(*), 9) AS auc FROM st p, st n WHERE p.label = 1 AND n.label = 0")
def a11_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.auc(_stand_in(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {_STAND_SQL}, g AS (SELECT i, CAST(0.5 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) AS t FROM range(51) r(i)), x AS (SELECT t, greatest(least(1 / (1 + exp(-(score - 0.5) * 8 / t)), 1 - 1e-12), 1e-12) AS p, label FROM st, g), n AS (SELECT t, avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS nll FROM x GROUP BY t) SELECT round(t, 6) AS t, round(nll, 6) AS nll FROM n ORDER BY nll, t LIMIT 1")
def c6_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _stand_in(spark, sf_dir).select(((F.col("score") - 0.5) * 8).alias("z"), "label")
    return classifier.temperature(z).select(F.round("t", 6).alias("t"), F.round("nll", 6).alias("nll"))




def fnv_sql(ns: str, token: str) -> str:
    chars = f"list_transform(string_split({ns} || chr(31) || {token}, ''), lambda x: CAST(unicode(x) AS BIGINT))"
    return f"(list_reduce({chars}, lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) & 262143)"


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) SELECT word, {fnv_sql(chr(39) + 'w' + chr(39), 'word')} AS idx FROM w")
def c1_fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", tx.fnv_index(F.lit("w"), F.col("word")).alias("idx"))


_FEATURES_SQL = f"""b AS (SELECT item_id AS id, trim(replace(text, chr(10), ' ')) AS t FROM benchmark), tok AS (
 SELECT id, 'c2' AS ns, substring(replace(t, ' ', '_'), i, 2) AS token FROM b, unnest(range(1, length(t))) AS u(i)
 UNION ALL SELECT id, 'c3', substring(replace(t, ' ', '_'), i, 3) FROM b, unnest(range(1, length(t) - 1)) AS u(i)
 UNION ALL SELECT id, 'w', unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) FROM b
 UNION ALL SELECT id, 'surf', 'the' FROM b),
f AS (SELECT id, {fnv_sql('ns', 'token')} AS idx, CAST(count(*) AS DOUBLE) AS val FROM tok GROUP BY ALL UNION ALL SELECT id, 262148, 1.0 FROM b WHERE (length(t) - length(replace(t, 'the', ''))) // 3 >= 2)"""


def _benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("the").alias("surface"))


@query(f"WITH {_FEATURES_SQL} SELECT id, idx, val FROM f")
def c2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.features(_benchmark_rows(spark, sf_dir))


@query(f"WITH {_FEATURES_SQL} SELECT id, round(1 / (1 + exp(-(0.25 + sum(val * ((idx % 7) - 3) / 100.0)) / 0.9)), 6) AS score FROM f GROUP BY id")
def c4_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _benchmark_rows(spark, sf_dir)
    feats = classifier.features(rows)
    weights = spark.range(classifier.DIM + 5).select(F.col("id").alias("idx"), (((F.col("id") % 7) - 3) / F.lit(100.0)).alias("w"))
    return classifier.score(feats, rows.select("id"), weights, 0.25, 0.9).select("id", F.round("score", 6).alias("score"))


@query()
def c5_training_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All labelled documents, toxic being the label, whatever their surface; each is then scored by the fitted model.
    labelled = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(labelled, "doc_id").withColumn("surface", F.lit("the"))
    # Whole documents have thousands of features, so steps are short.
    model = classifier.fit_texts(rows, rounds=30, rate=1e-5)
    scored = classifier.score_rows(rows, model.dense())
    return scored.select("doc_id", "label", F.round("score", 6).alias("score"))


@query("SELECT quantile_disc(value, 0.95) AS p95 FROM events")
def a13_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.p95(table(spark, sf_dir, "events"), "value")


@query("WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n) FILTER (a = b) AS DOUBLE) AS s FROM c), e AS (SELECT sum(CAST(x.n AS DOUBLE) * y.n) AS e FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) y ON a = b) SELECT round((s / t.n - e / (t.n * t.n)) / (1 - e / (t.n * t.n)), 9) AS kappa FROM t, e")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("kappa", 9).alias("kappa"))


# ---- vectors and bit patterns ----------------------------------------------
_HALF_SQL = "list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[{} + i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END))::BIGINT"


@query("WITH h AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END))::BIGINT AS phash FROM embeddings) SELECT a.vec_id AS image_id, b.vec_id AS marker_id, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM h a, h b WHERE b.vec_id % 100 = 0 AND bit_count(xor(a.phash, b.phash)) <= 8")
def phash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A bit for the sign of each of 32 components stands in for an image's hash; every hundredth image is asked for.
    h = table(spark, sf_dir, "embeddings").select("vec_id", similar.sign_hash(F.col("embedding"), 32).alias("phash"))
    return similar.near_hashes(h.select(F.col("vec_id").alias("image_id"), "phash"), h.where("vec_id % 100 = 0").select(F.col("vec_id").alias("marker_id"), "phash"), n_bits=32)


@query(f"WITH e AS (SELECT * FROM embeddings), h AS (SELECT vec_id, {_HALF_SQL.format(0)} AS lo, {_HALF_SQL.format(32)} AS hi FROM e), m AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 16 = vec_id // 100 % 16 AND i <= 48 THEN -x ELSE x END) AS embedding FROM e WHERE vec_id % 100 = 0), g AS (SELECT vec_id, {_HALF_SQL.format(0)} AS lo, {_HALF_SQL.format(32)} AS hi FROM m) SELECT a.vec_id AS image_id, b.vec_id AS marker_id, CAST(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS INT) AS distance FROM h a, g b WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= 8")
def phash_altered_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every hundredth image with three components turned round is a marker.
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    turned = F.transform("embedding", lambda x, i: F.when((i % 16 == F.expr("vec_id DIV 100") % 16) & (i < 48), -x).otherwise(x))
    markers = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("marker_id"), similar.sign_hash(turned).alias("phash"))
    return similar.near_hashes(e.select(F.col("vec_id").alias("image_id"), similar.sign_hash(F.col("embedding")).alias("phash")), markers)


@query("WITH r AS (SELECT vec_id AS ref_id, embedding AS ref FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT vec_id, ref_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(ref AS DOUBLE[])) AS s FROM embeddings, r WHERE vec_id <> ref_id) SELECT vec_id, ref_id, round(s, 6) AS similarity FROM p WHERE s >= 0.92")
def embedding_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every hundredth vector is asked for, against all.
    v = table(spark, sf_dir, "embeddings")
    return similar.near_vectors(v, v.where("vec_id % 100 = 0")).select("vec_id", "ref_id", F.round("similarity", 6).alias("similarity"))


@query("WITH r AS (SELECT -vec_id - 1 AS ref_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 10 + 0.5) / 10) AS ref FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT vec_id, ref_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), ref) AS s FROM embeddings, r) SELECT vec_id, ref_id, round(s, 6) AS similarity FROM p WHERE s >= 0.92")
def embedding_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every hundredth vector, kept to tenths, is a reference of its own: what it was made from is near it.
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    tenths = v.where("vec_id % 100 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: F.floor(x * 10 + 0.5) / 10).alias("embedding"))
    return similar.near_vectors(v, tenths).select("vec_id", "ref_id", F.round("similarity", 6).alias("similarity"))


# ---- further workflow operators --------------------------------------------
@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def j7_evidence_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines stand in for evidence, parts for its sources.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_id"))
    source = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), "p_brand")
    return curation.evidence_with_sources(lines, source).select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT id, kind FROM (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'incident' WHEN 'click' THEN 'new_term' WHEN 'view' THEN 'new_variant' ELSE 'other' END AS kind FROM events) ORDER BY CASE kind WHEN 'new_term' THEN 0 WHEN 'new_marker' THEN 1 WHEN 'new_variant' THEN 2 WHEN 'incident' THEN 3 ELSE 9 END, id ")
def o3_apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "incident").when(F.col("event_type") == "click", "new_term").when(F.col("event_type") == "view", "new_variant").otherwise("other")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("kind")).orderBy(*curation.apply_order())


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def o9_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a12_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'approve' WHEN o_orderpriority = '5-LOW' THEN 'reject' ELSE 'uncertain' END AS verdict, o_orderstatus = 'F' AS applied, count(*) AS n FROM orders GROUP BY ALL")
def a9_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("o_orderpriority") == "1-URGENT", "approve").when(F.col("o_orderpriority") == "5-LOW", "reject").otherwise(F.col("o_orderpriority"))
    return curation.verdict_counts(table(spark, sf_dir, "orders").select(verdict.alias("verdict"), (F.col("o_orderstatus") == "F").alias("applied")))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type AS rec, count(*) AS n FROM events GROUP BY ALL")
def weekly_match_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("usage_recommendation"))
    return curation.weekly_distribution(e).select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.col("usage_recommendation").alias("rec"), "n")


@query("WITH s AS (SELECT o_custkey, max(o_orderdate) AS last_seen FROM orders GROUP BY o_custkey) SELECT c_custkey AS term_id FROM customer LEFT JOIN s ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND (last_seen IS NULL OR last_seen < TIMESTAMP '1997-08-01')")
def inactive_term_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Customers stand in for terms, their orders for matches.
    term = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("term_id"), F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("draft").alias("status"))
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term_id"), F.col("o_orderdate").alias("at"))
    return curation.inactive_terms(seen, term, F.to_date(F.lit("1998-08-01"))).select("term_id")


INCIDENTS = Inline("ic", "term_id int, display_title string, disclosable boolean", [(1, "b", True), (1, "a", True), (1, "hidden", False), (2, "hidden", False)])


@query(f"WITH {TERM_ROWS.sql}, {INCIDENTS.sql} SELECT term_id, coalesce((SELECT string_agg(display_title, ',' ORDER BY display_title) FROM ic WHERE ic.term_id = tm.term_id AND disclosable), '') AS incidents FROM tm")
def disclosed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.disclosed(TERM_ROWS.df(spark), INCIDENTS.df(spark)).select("term_id", F.array_join("incidents", ",").alias("incidents"))


CHECKS = Inline("ck", "id int, severity int, legal boolean, done array<boolean>", [(1, 5, False, [True] * 5), (2, 5, False, [True, True, True, True, False]), (3, 2, True, [True] * 4), (4, 2, False, [False]), (5, 3, True, None)])


@query(f"WITH {CHECKS.sql} SELECT id, (severity >= 5 OR legal) AND NOT (coalesce(len(done), 0) >= 5 AND NOT list_contains(coalesce(done, []), false)) AS missing FROM ck")
def p16_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CHECKS.df(spark).select("id", curation.checklist_missing(F.col("severity"), F.col("legal"), F.col("done")).alias("missing"))


NESTED = Inline("ne", "term_id int, surface string, term_kind string, status string, form string, variant_kind string", [(1, " aa ", "word", "active", "a1", "leet"), (1, " aa ", "word", "active", "ㄱ", "jamo"), (2, "bb", "word", "watchlist", "b1", "leet"), (3, "cc", "pattern", "active", "c1", "leet"), (4, "a1", "word", "active", "aa", "spacing")])


@query(f"WITH {NESTED.sql}, f AS (SELECT trim(surface) AS form FROM ne WHERE status = 'active' AND term_kind <> 'pattern' UNION SELECT form FROM ne WHERE status = 'active' AND term_kind <> 'pattern' AND variant_kind NOT IN ('jamo', 'chosung')) SELECT form, 'NNP' AS tag FROM f WHERE form <> ''")
def f9_user_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = NESTED.df(spark).groupBy("term_id", "surface", "term_kind", "status").agg(F.collect_list(F.struct(F.col("form").alias("surface"), F.lit("").alias("normalized_key"), "variant_kind")).alias("variants"))
    return release.user_dictionary(rows).select("form", "tag")


@query(f"WITH {NESTED.sql}, v AS (SELECT term_id, count(*) AS n FROM ne GROUP BY term_id) SELECT count(*) AS term_count, CAST(sum(n) AS BIGINT) AS variant_count FROM v")
def a8_release_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.release_counts(NESTED.df(spark).groupBy("term_id").agg(F.collect_list("form").alias("variants")))


@query(f"WITH {MADE.sql} SELECT id FROM md WHERE (variant_kind = 'leet' AND variant <> '') OR (variant_kind = 'chosung' AND length(variant) = 4)")
def f10_loadable_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.loadable(MADE.df(spark).withColumn("decision", F.lit("verified"))).select("id")


@query(f"WITH {VARIANT.sql}, {TERM_ROWS.sql}, v AS (SELECT * FROM (VALUES ('aaa', 'A1A'), ('bbb', 'x'), ('eee', 'y'), ('zzz', 'z')) t(surface, variant)), p AS (SELECT v.*, (SELECT min(term_id) FROM tm WHERE status = 'active' AND normalized_key = v.surface) AS t FROM v) SELECT variant, CASE WHEN t IS NULL THEN 'noparent' WHEN EXISTS (SELECT 1 FROM vr WHERE vr.term_id = t AND vr.variant = p.variant) THEN 'skip' ELSE 'loaded' END AS outcome FROM p")
def w6_load_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = spark.createDataFrame([("aaa", "A1A", "leet"), ("bbb", "x", "leet"), ("eee", "y", "leet"), ("zzz", "z", "leet")], "surface string, variant string, variant_kind string")
    return release.load_variants(verified, TERM_ROWS.df(spark), VARIANT.df(spark)).select("variant", "outcome")


FUZZY = Inline("fz", "key string", [("thread",), ("outland",), ("hation",)])


@query(f"WITH {FUZZY.sql}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) SELECT word, key, CAST(levenshtein(word, key) AS INT) AS distance FROM w, fz WHERE levenshtein(word, key) BETWEEN 1 AND 2")
def fuzzy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return variants.fuzzy_keys(words, FUZZY.df(spark), 2)


_RARE_KEYS_SQL = "bk AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{10,}')) AS key FROM benchmark), ks AS (SELECT key, row_number() OVER (ORDER BY key) AS term_id FROM bk)"


@query(f"""WITH {_RARE_KEYS_SQL}, l AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS ms, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS ps FROM documents),
o AS (SELECT doc_id, ms[i] AS word, list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS st FROM l, unnest(range(1, len(ms) + 1)) AS u(i)),
w AS (SELECT DISTINCT word, regexp_replace(lower(word), '[^\\x00-\\x7F]', '~', 'g') AS norm FROM o),
n AS (SELECT word, key, term_id, CAST(levenshtein(norm, key) AS INT) AS distance FROM w, ks WHERE abs(length(norm) - length(key)) <= 2 AND levenshtein(norm, key) BETWEEN 1 AND 2)
SELECT doc_id, CAST(st AS BIGINT) AS start_pos, o.word AS matched_text, key, distance, CASE distance WHEN 1 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN round(CASE distance WHEN 1 THEN 0.7 ELSE 0.6 END::DOUBLE * 0.8, 6) >= 0.35 THEN 'review_recommended' ELSE 'monitor' END AS rec FROM o JOIN n ON o.word = n.word""")
def fuzzy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The benchmark's long words are terms; words of all documents up to two letters away from one are found.
    keys = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), 0)).alias("key")).distinct()
    terms = keys.select(F.xxhash64("key").alias("term_id"), "key", F.lit(4).alias("severity"), F.lit("unambiguous").alias("ambiguity"), F.lit("active").alias("status"), F.lit(False).alias("dogwhistle"))
    found = variants.fuzzy_matches(table(spark, sf_dir, "documents"), terms, 2)
    return found.select("doc_id", F.col("start").alias("start_pos"), "matched_text", "key", "distance", F.col("match_confidence").alias("confidence"), F.col("usage_recommendation").alias("rec"))
