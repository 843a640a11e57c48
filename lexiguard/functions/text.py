"""Text normalisation: native column expressions, and the exact form with source offsets.

The exact form composes, for each base character and the combining ones after
it, NFKC, lower-casing by code point, Hangul decomposition into compatibility
letters, and removal of invisible and combining characters. Every character of
the result carries the source index of the cluster that it came from. For
texts without combining or compatibility characters, which native_normalise()
is for, it works character by character and stays in generated code.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NORMALISER_VERSION = "1.0.0"

# The Unicode order of initial, medial and final Hangul letters.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
# Characters that print nothing.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad\u2060\u180e\u200e\u200f"


def _phonemes() -> dict[str, str]:
    """Compatibility letters by the last part of their Unicode name."""
    return {unicodedata.name(chr(c)).removeprefix("HANGUL LETTER "): chr(c) for c in range(0x3131, 0x3164)}


PHONEMES = _phonemes()


def hangul_letters(ch: str) -> str:
    """A syllable's two or three letters, a lone positional letter's compatibility form, or the character itself."""
    at = ord(ch) - 0xAC00
    if 0 <= at < 11172:
        last = at % 28
        return INITIALS[at // 588] + MEDIALS[at % 588 // 28] + (FINALS[last - 1] if last else "")
    if 0x1100 <= ord(ch) <= 0x11FF:
        for part in ("HANGUL CHOSEONG ", "HANGUL JUNGSEONG ", "HANGUL JONGSEONG "):
            name = unicodedata.name(ch, "")
            if name.startswith(part):
                return PHONEMES.get(name.removeprefix(part), ch)
    return ch


def normalise(text: str | None) -> tuple[str, list[int]]:
    """The normalised text and the source index of each of its characters; null and empty give ('', [])."""
    out: list[str] = []
    offsets: list[int] = []
    text = text or ""
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        for ch in unicodedata.normalize("NFKC", text[i:j]):
            for low in ch.lower():
                for letter in hangul_letters(low):
                    if letter not in INVISIBLE and not unicodedata.combining(letter):
                        out.append(letter)
                        offsets.append(i)
        i = j
    return "".join(out), offsets


class _Plain(dict):
    """Characters that the exact form merely lower-cases, wherever they stand; each is looked into once."""

    def __missing__(self, ch: str) -> bool:
        # A final sigma's lower case depends on what is around it.
        plain = self[ch] = ch != "\u03a3" and not unicodedata.combining(ch) and normalise(ch) == (ch.lower(), [0])
        return plain


def normalise_fast(text: str, plain: dict[str, bool]) -> tuple[str, list[int] | None]:
    """normalise(), with None for the offsets where each character keeps its place, which is told from the set of characters. plain: plain_characters()."""
    if text.isascii() or all(map(plain.__getitem__, set(text))):
        return text.lower(), None
    return normalise(text)


def plain_characters() -> dict[str, bool]:
    return _Plain()


def normalised(rows: DataFrame, column: str, norm: str = "norm", offsets: str | None = None) -> DataFrame:
    """rows with the exact normalised form of a column and, if named, its offsets; null counts as empty."""
    fields = [T.StructField(norm, T.StringType()), *([T.StructField(offsets, T.ArrayType(T.IntegerType()))] if offsets else [])]
    schema = T.StructType([*rows.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, plain = to_arrow_schema(schema), plain_characters()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                made = [normalise_fast(t or "", plain) for t in b.column(column).to_pylist()]
                added = [pa.array([n for n, _ in made], pa.string())]
                if offsets:
                    added.append(pa.array([range(len(n)) if o is None else o for n, o in made], arrow.field(offsets).type))
                yield pa.RecordBatch.from_arrays([*b.columns, *added], schema=arrow)

    return rows.mapInArrow(run, schema)


def characters(text: Column) -> Column:
    """Code points as an array; the empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def native_letters(c: Column) -> Column:
    """hangul_letters() of a one-character column, for syllables."""
    at = F.ascii(c) - 0xAC00
    pick = lambda table, i: F.substring(F.lit(table), i + 1, F.lit(1))
    last = F.when(at % 28 > 0, pick(FINALS, at % 28 - 1)).otherwise(F.lit(""))
    whole = F.concat(pick(INITIALS, F.floor(at / 588).cast("int")), pick(MEDIALS, F.floor(at % 588 / 28).cast("int")), last)
    return F.when((at >= 0) & (at < 11172), whole).otherwise(c)


def native_normalise(text: Column) -> Column:
    """normalise()[0] for texts whose characters NFKC leaves alone. Plain Latin text takes a path without arrays."""
    clean = F.translate(F.coalesce(text, F.lit("")), INVISIBLE, "")
    hangul = F.array_join(F.transform(characters(clean), lambda c: native_letters(F.lower(c))), "")
    # Only the capital sigma lower-cases by context, so texts with one go character by character.
    return F.when(clean.rlike("[가-힣Σ]"), hangul).otherwise(F.lower(clean))


def native_offsets(text: Column) -> Column:
    """normalise()[1] under the same condition."""
    chars = characters(F.coalesce(text, F.lit("")))
    spread = F.transform(chars, lambda c, i: F.array_repeat(i, F.length(F.translate(native_letters(F.lower(c)), INVISIBLE, ""))))
    return F.flatten(spread)


def initials_of(text: Column) -> Column:
    """Each syllable's initial letter; other characters stay."""
    at = lambda c: F.ascii(c) - 0xAC00
    one = lambda c: F.when((at(c) >= 0) & (at(c) < 11172), F.substring(F.lit(INITIALS), F.floor(at(c) / 588).cast("int") + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(characters(text), one), "")


def fnv_index(namespace: Column, token: Column) -> Column:
    """FNV-1a, 32 bits, over the code points of namespace, U+001F and token, kept to 18 bits."""
    chars = characters(F.concat(namespace, F.lit("\u001f"), token))
    h = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return h.bitwiseAND(F.lit(262143).cast("long"))


#: Keys that may be sent to all executors to be looked for one by one.
MOST_KEYS = 10_000


def bounded(keys: DataFrame) -> DataFrame:
    """keys, if they are few enough to be sent to all executors; else an error."""
    if keys.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: use an automaton")
    return keys


def quoted(literal: Column) -> Column:
    """A regular expression that matches the literal."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, key: Column) -> Column:
    """Zero-based starts of all occurrences, overlapping ones included. The key must not be empty.

    The text is split before each occurrence, so running piece lengths are the
    starts; nothing looks at every position.
    """
    sizes = F.transform(F.split(text, F.concat(F.lit("(?="), quoted(key), F.lit(")"))), F.length)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    inner = F.aggregate(sizes, state, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"] + n).alias("starts")))["starts"]
    # The last sum is the text's length, not a start.
    inner = F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))
    return F.when(F.startswith(text, key), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)
