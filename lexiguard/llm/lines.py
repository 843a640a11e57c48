"""Line deduplication by a log-template tree: templates that recur across documents are dropped.

Each line is cut into words; words with digits or an at sign become a
variable. The tree has fixed depth: number of words, then the leading words.
In a leaf, lines are of one template if they agree, word by word, in at least
ALIKE of their places, half of all places being no variables; or if a chain of
such lines leads from one to the other. So neither the order of lines nor the
size of a leaf has a say. Such lines are found through an index: of n places at
most 0.3 n differ, none of them a leading one, so if the others are cut into one
part more than that, lines agree wholly in one part at least, which is its key.
The leading words are in no part, since all lines of a leaf would meet in it.
Equal lines fall together before that.

A template recurs if documents of at least MIN_DOCS groups have it. A group is
a document with all its copies, so copies have one vote together and do not
erase each other. Copies are documents whose five-word shingles are alike as
near-duplicate removal has it, each compared in full with the other, or whose
lines are all of the same templates. A passage that makes up DOMINANT of a
document is left out for that, unless nothing else is there: such documents are
alike by the passage and not by their own text. Every line of a recurring template goes,
in every document, also where nothing else is left.

Null texts stay null, and blank lines stay and are never templates. Lines of
variables only are compared as they are. Documents are told apart by id and
text, so repeated rows count as one document and are treated alike. Work is
linear in a document's lines, however many go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiguard.llm import collide, near
from lexiguard.llm.common import discard, join_spread, map_rows, sifted, written
from lexiguard.llm.components import components

LEADING = 3
#: Tenths of a line's places.
ALIKE = 7
MIN_DOCS = 3
#: Share of a document's words from which a passage is left out when it is compared; below that, 0.85 alike is not in reach by it alone.
DOMINANT = 0.9
#: Words whose codes a task keeps.
MOST_CODES = 50_000
VARIABLE = b"<*>"
_SIGNS = b"0123456789@"
_NO_SIGNS = bytes(c for c in range(256) if c not in _SIGNS and c != 10)
# Blanks that words may have between them besides single ones.
_GAPS = (b"  ", b"\t", b"\r", b"\f", b"\v")
# Columns that only live between two steps, under names that tables hardly have.
_KEY, _HIT, _OLD = "_lexiguard_key", "_lexiguard_dropped", "_lexiguard_text"


def _not_blank(text: Column) -> Column:
    # Most lines begin with a letter, so few are trimmed.
    return (F.ascii(text) > 32) | (F.trim(text, F.lit(" \t\n\r\f\u000b")) != "")


def _words(line: bytes) -> list[bytes]:
    """Words of a line, those with digits or an at sign made variables."""
    # bytes.split() without arguments splits at blanks and ASCII controls from tab to return.
    return [VARIABLE if w.translate(None, _NO_SIGNS) else w for w in line.split()]


def _signed(hashes: list[int]) -> list[int]:
    return np.array(hashes, dtype=np.uint64).view(np.int64).tolist()


def _line_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Texts (k, text) to the places, numbers of words, leaves and forms of their lines that are not blank."""
    hashed = xxhash.xxh64_intdigest
    for k, text in rows:
        if text is None:
            continue
        odd = any(gap in text for gap in _GAPS)
        places, sizes, leaves, forms = [], [], [], []
        for at, (line, signs) in enumerate(zip(text.split(b"\n"), text.translate(None, _NO_SIGNS).split(b"\n"), strict=True)):
            masked = b" ".join(_words(line)) if odd or signs else line.strip(b" ")
            if not masked:
                continue
            n = masked.count(b" ") + 1
            if masked.startswith(VARIABLE) and not masked.replace(VARIABLE, b"").strip(b" "):
                leaves.append(hashed(line, 1))
                forms.append(hashed(line, 2))
            else:
                leaves.append(hashed(b" ".join(masked.split(b" ", LEADING)[:LEADING]), n + 2))
                forms.append(hashed(masked, 3))
            places.append(at)
            sizes.append(n)
        yield k, places, sizes, _signed(leaves), _signed(forms)


class Codes(dict):
    """Words' codes, eight bytes each, 0 for variables; made when first asked for. It forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> bytes:
        code = bytes(8) if word == VARIABLE else xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        if len(word) <= 32:
            if len(self) >= MOST_CODES:
                self.clear()
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8")


def _parts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Texts (text, places, leaves, forms of wanted lines) to lines with a code for each word and a key for each part."""
    codes = Codes()
    for text, places, leaves, forms in rows:
        lines = text.split(b"\n")
        for at, leaf, form in zip(places, leaves, forms, strict=True):
            body = codes.of(_words(lines[at])).tobytes()
            n = len(body) // 8
            rest, parts = n - LEADING, n * (10 - ALIKE) // 10 + 1
            # Lines too short for that many parts all meet.
            edges = [LEADING + i * rest // parts for i in range(parts + 1)] if rest >= parts else [n, n]
            yield form, b"", body, _signed([xxhash.xxh64_intdigest(body[8 * a : 8 * b], (leaf ^ i) & 0xFFFFFFFFFFFFFFFF) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def of_one_template(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) != len(b):
        return False
    same = a == b
    return 10 * int(same.sum()) >= ALIKE * len(a) and 2 * int((same & (a != 0)).sum()) >= len(a)


def _templates(texts: DataFrame) -> DataFrame:
    """(form, template) of the wanted lines (text, places, leaves, forms) that are of one template with others."""
    members = written(map_rows(texts, ["text", "places", "leaves", "forms"], _parts, "rep long, keys binary, body binary, parts array<bigint>"))
    lists = written(members.select("rep", F.explode("parts").alias("key")))
    joined = components(collide.links(members.drop("parts"), lists, 1, of_one_template))
    discard(members)
    discard(lists)
    return joined.select(F.col("node").alias("form"), F.col("component").alias("template"))


def _chosen(positions: Column) -> Column:
    """For places in order, the first one 0: a flag for each place up to the last one."""
    before = lambda i: F.coalesce(F.get(positions, i - 1), F.lit(-1))
    return F.flatten(F.transform(positions, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True)))))


def _pick(lines: Column, positions: Column, chosen: bool) -> Column:
    """The lines at places, or the others, in order; one pass over both."""
    marked = F.zip_with(lines, _chosen(positions), lambda x, f: F.when(F.coalesce(f, F.lit(False)) == chosen, x))
    return F.filter(marked, lambda x: x.isNotNull())


def _copies(texts: DataFrame, per: DataFrame, all_of: DataFrame) -> DataFrame:
    """(k, vote) of documents that hold a template of several: copies have the same vote.

    texts is (k, text), per (k, template, n_words, n_rows, positions, n_docs)
    with n_docs null for templates of too few documents, all_of (k, all, rows).
    """
    widest = F.max(F.when(F.col("n_docs").isNotNull(), F.struct("n_words", "template", "positions"))).alias("widest")
    form = F.xxhash64(F.array_sort(F.collect_list(F.struct("template", F.size("positions").alias("n"))))).alias("form")
    shape = per.groupBy("k").agg(widest, form, F.sum("n_rows").alias("n_rows")).where("widest IS NOT NULL").join(all_of, "k")
    apart = (F.col("widest.n_words") >= DOMINANT * F.col("all")) & (F.col("widest.n_words") < F.col("all"))
    # Lines that no other document can match are in no template, and no document is of the same form then.
    shape = written(shape.select("k", F.when(apart, F.col("widest.positions")).alias("left_out"), F.when(F.col("n_rows") == F.col("rows"), F.col("form")).alias("form")))
    rest = F.array_join(_pick(F.split("text", "\n"), F.col("left_out"), False), "\n")
    read = written(sifted(texts, "k", shape, "k").join(shape.select("k", "left_out").hint("shuffle_hash"), "k").select(F.col("k").alias("doc_id"), F.when(F.col("left_out").isNull(), F.col("text")).otherwise(rest).alias("text")))
    alike = near.near_duplicates(read).select(F.col("doc_id").alias("k"), F.col("component_id").alias("group")).distinct()
    alike = written(alike.join(shape.select("k", "form"), "k"))
    first = alike.where("form IS NOT NULL").groupBy("form").agg(F.min("group").alias("b"))
    joined = components(alike.join(first, "form").select(F.col("group").alias("a"), "b"))
    return alike.join(joined, F.col("group") == F.col("node"), "left").select("k", F.coalesce("component", "group").alias("vote"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k, positions) of the lines to drop; k is the hash of id and text."""
    keyed = docs.select(_key(), "text")
    raw = keyed.select("k", F.col("text").cast("binary").alias("text"))
    lines = map_rows(raw, ["k", "text"], _line_rows, "k long, pos array<int>, n_words array<int>, leaf array<bigint>, form array<bigint>")
    table = written(lines.select("k", F.inline(F.arrays_zip("pos", "n_words", "leaf", "form"))))
    doc = F.col("k")
    leaves = table.groupBy("leaf").agg(F.min(doc).alias("a"), F.max(doc).alias("b"), F.min("form").alias("f"), F.max("form").alias("g"), F.count(F.lit(1)).alias("n_rows")).where("a <> b")
    leaves = written(leaves.select("leaf", (F.col("f") != F.col("g")).alias("mixed"), "n_rows"))
    shared = written(join_spread(table, leaves, "leaf"))

    all_of = table.groupBy("k").agg(F.sum("n_words").alias("all"), F.count(F.lit(1)).alias("rows"))
    # One place of each distinct line of a mixed leaf; its words are read from there.
    places = shared.where("mixed").groupBy("leaf", "form").agg(F.min(F.struct("k", "pos")).alias("at"))
    places = written(places.select("leaf", "form", "at.*").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "leaf", "form"))).alias("wanted")))
    # Hashing the small side spares sorting whole texts.
    texts = sifted(raw, "k", places, "k").join(places.hint("shuffle_hash"), "k").select("text", *[F.col(f"wanted.{c}").alias(name) for c, name in (("pos", "places"), ("leaf", "leaves"), ("form", "forms"))])
    named = shared.join(_templates(texts).hint("shuffle_hash"), "form", "left").select("k", "pos", "n_words", F.coalesce("template", "form").alias("template"))
    counted = written(named.groupBy("k", "template").agg(F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_set("pos")).alias("positions")))
    wide = written(counted.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs))
    per = written(join_spread(counted, wide.withColumn("n_here", F.col("n_docs")), "template", "n_here", "left"))
    votes = per.where("n_docs IS NOT NULL").select("template", "k").join(_copies(keyed, per, all_of), "k").select("template", "vote").distinct()
    recurring = votes.groupBy("template").agg(F.count(F.lit(1)).alias("n_votes")).where(F.col("n_votes") >= min_docs).select("template")
    recurring = written(recurring.join(wide, "template"))
    for done in (table, leaves, shared, places, counted, wide):
        discard(done)
    lost = join_spread(per.select("k", "template", "positions"), recurring, "template", "n_docs")
    return lost.groupBy("k").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def _key() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("k")


def _dropped(docs: DataFrame, min_docs: int) -> DataFrame:
    """docs with text without its recurring lines, and _KEY, _HIT: a hash, and the positions of the dropped lines or null."""
    drop = recurring_lines(docs, min_docs).select(F.col("k").alias(_KEY), F.col("positions").alias(_HIT))
    joined = docs.withColumn(_KEY, _key()).join(drop.hint("shuffle_hash"), _KEY, "left")
    kept = _pick(F.split("text", "\n"), F.col(_HIT), False)
    hit = F.col(_HIT).isNotNull()
    out = joined.withColumn(_OLD, F.col("text")).withColumn("text", F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with every column, text without its recurring lines, and n_lines, n_dropped (int), which replace columns of these names.

    n_chars, where docs has it, is the new length if lines were dropped. An
    empty table stays empty.
    """
    out = _dropped(docs, min_docs)
    n_lines = F.coalesce(F.size(F.filter(F.split(_OLD, "\n"), _not_blank)), F.lit(0))
    # Positions are unique, so their number is the number of lines that go.
    n_dropped = F.when(F.col(_HIT).isNotNull(), F.size(_HIT)).otherwise(0)
    return out.withColumns({"n_lines": n_lines, "n_dropped": n_dropped}).drop(_KEY, _HIT, _OLD)


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with just its columns; documents of which only blanks are left after dropping go, others that were blank stay."""
    return _dropped(docs, min_docs).where(F.col(_HIT).isNull() | _not_blank(F.col("text"))).select(*docs.columns)
