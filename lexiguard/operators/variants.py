"""Spelling variants of surfaces: generation, collisions with common words, and the decision on each."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from lexiguard.functions.text import FINALS, INITIALS, MEDIALS, hangul_letters, native_normalise
from lexiguard.operators import detect, intervals

#: The letters and signs that stand for a round initial and for an upright vowel.
ROUND_INITIAL, ROUND_SIGNS = "ㅇ", ("0", "o")
UPRIGHT_VOWEL, UPRIGHT_SIGNS = "ㅣ", ("1", "l", "i")
MOST_LEET = 20
SHORTEST_INITIALS = 3
TOP_GROUPS = 8


def _syllable(ch: str) -> tuple[int, int, int] | None:
    at = ord(ch) - 0xAC00
    return (at // 588, at % 588 // 28, at % 28) if 0 <= at < 11172 else None


def leet_forms(ch: str) -> list[str]:
    """Other spellings of one syllable: its round initial as a sign, or a sign behind its upright vowel."""
    s = _syllable(ch)
    if s is None:
        return []
    initial, vowel, final = s
    tail = MEDIALS[vowel] + (FINALS[final - 1] if final else "")
    first = [sign + tail for sign in ROUND_SIGNS] if INITIALS[initial] == ROUND_INITIAL else []
    return first + ([ch + sign for sign in UPRIGHT_SIGNS] if MEDIALS[vowel] == UPRIGHT_VOWEL else [])


def _leet_words(surface: str) -> Iterator[str]:
    """One changed syllable from left to right, then two."""
    forms = {i: f for i, ch in enumerate(surface) if (f := leet_forms(ch))}
    for size in (1, 2):
        for places in combinations(forms, size):
            for chosen in product(*(forms[i] for i in places)):
                new = dict(zip(places, chosen, strict=True))
                yield "".join(new.get(i, ch) for i, ch in enumerate(surface))


def variants_of(surface: str | None) -> list[tuple[str, str]]:
    """(variant, kind): letters, then initials, then at most 20 leet spellings; never the surface, nothing twice."""
    surface = surface or ""
    letters = "".join(hangul_letters(c) if _syllable(c) else c for c in surface)
    initials = "".join(INITIALS[s[0]] if (s := _syllable(c)) else c for c in surface)
    found: dict[str, str] = {}
    for text, kind in ((letters, "jamo"), (initials, "chosung")):
        if text != surface:
            found.setdefault(text, kind)
    leet = list(dict.fromkeys(w for w in _leet_words(surface) if w != surface))[:MOST_LEET]
    for w in leet:
        found.setdefault(w, "leet")
    return list(found.items()) if surface else []


@udtf(returnType="pos int, variant string, variant_kind string")
class GenerateVariants:
    """Table function: SELECT * FROM t, LATERAL generate_variants(t.surface)."""

    def eval(self, surface: str) -> Iterator[tuple]:
        for pos, (variant, kind) in enumerate(variants_of(surface)):
            yield pos, variant, kind


def generate(surfaces: DataFrame, column: str = "surface") -> DataFrame:
    """surfaces with a row for each variant: pos, variant, variant_kind, normalized_key."""
    surfaces.sparkSession.udtf.register("generate_variants", GenerateVariants)
    # A name of its own, so that no view of the session is written over.
    name = f"variant_input_{uuid.uuid4().hex}"
    surfaces.createTempView(name)
    made = surfaces.sparkSession.sql(f"SELECT t.*, v.* FROM {name} t, LATERAL generate_variants(t.{column}) v")
    surfaces.sparkSession.catalog.dropTempView(name)
    return made.withColumn("normalized_key", native_normalise(F.col("variant")))


def collisions(variants: DataFrame, common_words: DataFrame) -> DataFrame:
    """variants with hits: the common words (column word) of the same key, in order."""
    words = common_words.select(native_normalise(F.col("word")).alias("key"), "word").groupBy("key").agg(F.array_sort(F.collect_set("word")).alias("hits"))
    return variants.join(words, F.col("normalized_key") == F.col("key"), "left").drop("key").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


def classify(variants: DataFrame, common_words: DataFrame, surface_key: str = "surface_key") -> DataFrame:
    """Adds decision, reason and context_required."""
    v = collisions(variants, common_words)
    kind, key = F.col("variant_kind"), F.col("normalized_key")
    reason = (
        F.when((key == "") | ((kind == "jamo") & (key != F.col(surface_key))), "key_mismatch")
        .when((kind == "chosung") & (F.length("variant") < SHORTEST_INITIALS), "too_short")
        .when(F.size("hits") > 0, "common_word")
    )
    return v.withColumns({"reason": reason, "decision": F.when(reason.isNull(), "verified").otherwise("rejected"), "context_required": reason.isNull() & (kind == "chosung")})


def loadable(variants: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Verified variants that may be loaded: leet ones with a sign, and initials of four letters that are not excluded."""
    leet = (F.col("variant_kind") == "leet") & F.col("variant").rlike("[^가-힣ㄱ-ㅣ]")
    initials = (F.col("variant_kind") == "chosung") & (F.length("variant") == 4) & ~F.col("variant").isin(*(excluded or [""]))
    return variants.where((F.col("decision") == "verified") & (leet | initials))


def collision_rates(classified: DataFrame) -> DataFrame:
    """Counts and rates by kind, and over all (kind null)."""
    hit = F.when(F.size("hits") > 0, 1).otherwise(0)
    return classified.rollup("variant_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("n_hit"), F.avg(hit.cast("double")).alias("rate"))


def key_ambiguity(words: DataFrame, key) -> DataFrame:  # noqa: ANN001
    """Groups of two or more words under one key, the largest eight of each length. words: word (distinct)."""
    keyed = words.select("word", key.alias("key"), F.length("word").alias("len"))
    groups = keyed.groupBy("len", "key").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("first_word")).where("n >= 2")
    rank = F.row_number().over(Window.partitionBy("len").orderBy(F.desc("n"), "key"))
    return groups.withColumn("place", rank).where(F.col("place") <= TOP_GROUPS)


def without(word: Column, most: int) -> Column:
    """All texts that are left of a word after taking out up to so many of its letters."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    found = F.array(word)
    for _ in range(most):
        # An empty word has nothing to take out; sequence() would count down from it.
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, lambda w: F.when(w == "", F.array().cast("array<string>")).otherwise(one(w))))))
    return found


def fuzzy_keys(words: DataFrame, keys: DataFrame, most: int = 1) -> DataFrame:
    """(word, key, distance) for words within so many letter edits of a key, equal ones left out. words: word (null ones are near nothing); keys: key.

    Two texts within that many edits are the same after taking so many letters
    out of each, so both are posted under what is left of them, and only what
    meets there is compared. Words that are too long for any key are left out
    first, so a posting has few rows for each word whatever the texts hold.
    """
    keys = keys.where("key <> ''").select("key").distinct()
    norm = words.where("word IS NOT NULL").select("word").distinct().withColumn("norm", native_normalise(F.col("word")))
    longest = keys.agg(F.max(F.length("key")).alias("longest"))
    fitting = norm.join(F.broadcast(longest), F.length("norm") <= F.col("longest") + most).drop("longest")
    posted = lambda df, c: df.withColumn("left", F.explode(F.transform(without(F.col(c), most), lambda x: F.xxhash64(x))))
    met = posted(fitting, "norm").join(posted(keys, "key"), "left").select("word", "norm", "key").distinct()
    return met.select("word", "key", F.levenshtein("norm", "key", most).alias("distance")).where("distance > 0")


#: What a match one edit away is trusted, and how much less one with each further edit.
FUZZY_CONFIDENCE, FUZZY_STEP = 0.7, 0.1


#: A run of letters and digits.
WORD = r"[^\W_]+"


def fuzzy_matches(docs: DataFrame, terms: DataFrame, most: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of whole texts within so many letter edits of a term's key: id, start, end, matched_text, term_id, key, distance, match_confidence, risk_score, usage_recommendation.

    terms: term_id, key, severity, ambiguity, status, dogwhistle. Words that are
    a key are no fuzzy matches. A match is trusted FUZZY_CONFIDENCE at most, and
    never says more than review. Each distinct word is compared once.
    """
    found = intervals.token_rows(docs, id_col, text_col, WORD).withColumnRenamed("s", "start")
    near = fuzzy_keys(found.select("word"), terms.select("key"), most)
    rows = found.join(near, "word").join(terms, "key")
    confidence = F.round(F.lit(FUZZY_CONFIDENCE) - (F.col("distance") - 1) * FUZZY_STEP, 6)
    context = detect.context_score(F.col("ambiguity"), F.lit(False))
    risk = detect.risk_score(F.col("severity"), confidence, context)
    rec = detect.recommendation(F.col("status"), F.lit(False), F.col("severity"), risk, F.col("dogwhistle"), F.lit(True), F.col("ambiguity"), context)
    return rows.select(id_col, "start", F.col("e").alias("end"), F.col("word").alias("matched_text"), "term_id", "key", "distance", confidence.alias("match_confidence"), risk.alias("risk_score"), rec.alias("usage_recommendation"))
