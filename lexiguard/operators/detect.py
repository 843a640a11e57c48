"""Detection: scan texts for a lexicon's entries, filter, score and recommend.

A document stays one row from the scan to the recommendation, its matches an
array column, so nothing is shuffled. The scan is one pass of an automaton over
Arrow batches, its cost not growing with the lexicon; what a match has from its
entry is looked up for a whole batch at once. The scan hands over each match's
text and the characters beside it, so all later stages are native expressions
on the array that never go back to the whole text. For up to a few hundred
keys, scan_literal_keys() gives the same occurrences in generated code.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiguard.functions.literals import Prefilter
from lexiguard.functions.text import bounded, normalise_fast, occurrences, plain_characters
from lexiguard.operators import intervals
from lexiguard.operators.classifier import Dense

SAFE_WINDOW = 20
QUOTE_WINDOW = 15
CONTEXT_FALLBACK = 0.5
CONTEXT_SURE = 0.85
CONTEXT_UNSURE = (0.4, 0.6)
# Separators that may stand between letters, and the longest run of them.
SEPARATORS = ". \t\n\r·ㆍ•-_*~,"
LONGEST_RUN = 2
# Marks and words that show that a term is quoted or talked about.
QUOTE_MARKS = "'\"「『‘“」』’”"
META_WORDS = ("표현", "멸칭", "용어", "단어", "혐오 표현", "차별", "비하", "보도", "보고서", "강의", "논문", "기사", "비판", "사례", "인용")
STAGES = ("skip_char", "jamo_boundary", "morpheme_boundary", "safe_context", "pattern", "combination", "quotation")

MATCH = "struct<start:int,end:int,ns:int,ne:int,stage:int,seq:int,term_id:bigint,surface:string,term_kind:string,severity:int,ambiguity:string,status:string,dogwhistle:boolean,variant_kind:string,categories:array<string>,safe:array<string>,triggers:array<bigint>,rule_hit:boolean,confidence:double,cap:boolean,flags:array<string>,start_ok:boolean,text:string,left:string,right:string>"


@dataclass(frozen=True)
class Rule:
    """What must be in the text for a number term to count: a match of the pattern or of one of the terms.

    The others are read by combination_within() alone: how many characters away
    it may be (None: anywhere), and the severity without it and what it adds.
    """

    trigger_pattern: str | None = None
    trigger_terms: tuple[int, ...] = ()
    proximity_window: int | None = None
    base_severity: int | None = None
    severity_delta: int = 0


@dataclass(frozen=True)
class Entry:
    """A term of a release, with the keys that stand for it: (key, variant kind or None for the surface itself)."""

    term_id: int
    surface: str
    keys: tuple[tuple[str, str | None], ...]
    term_kind: str = "word"
    severity: int = 3
    ambiguity: str = "unambiguous"
    status: str = "active"
    dogwhistle: bool = False
    categories: tuple[str, ...] = ()
    safe_contexts: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    pattern: str | None = None


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[Entry, ...]
    version: str = "0"
    #: (key, entry's place, variant kind), in order; empty keys are left out, pattern terms have none.
    keys: tuple[tuple[str, int, str | None], ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple((k, i, kind) for i, e in enumerate(self.entries) if e.term_kind != "pattern" for k, kind in e.keys if k))


def confidence_of(kind: str | None) -> tuple[float, bool, list[str]]:
    if kind is None:
        return 1.0, False, []
    if kind == "chosung":
        return 0.7, True, ["chosung_variant"]
    return 0.9, False, []


def skip_view(norm: str) -> tuple[str, list[int], list[bool]]:
    """The text without runs of up to two separators between Hangul letters; where its characters were; whether a gap with blanks follows each."""
    text, places, blank = [], [], []
    at = 0
    for m in re.finditer(f"(?<=[ㄱ-ㅣ])[{re.escape(SEPARATORS)}]+(?=[ㄱ-ㅣ])", norm):
        if len(m[0]) > LONGEST_RUN:
            continue
        text.append(norm[at : m.start()])
        places += range(at, m.start())
        blank += [False] * (m.start() - at - 1) + [any(c.isspace() for c in m[0])]
        at = m.end()
    text.append(norm[at:])
    places += range(at, len(norm))
    blank += [False] * (len(norm) - at)
    return "".join(text), places, blank


def native_skip_view(norm: Column) -> Column:
    """The text of skip_view(), in generated code."""
    separators = "".join("\\" + c if c in ".*-" else c for c in SEPARATORS)
    return F.regexp_replace(norm, f"(?<=[ㄱ-ㅣ])[{separators}]{{1,{LONGEST_RUN}}}(?=[ㄱ-ㅣ])", "")


#: Kinds of matches' flags, as the scan numbers them.
_FLAGS = ([], ["chosung_variant"], ["skip_char"], ["pattern_fallback_literal"])
_OWN = ("start", "end", "ns", "ne", "stage", "seq", "rule_hit", "confidence", "cap", "start_ok", "text", "left", "right")
_OF_ENTRY = ("term_id", "surface", "term_kind", "severity", "ambiguity", "status", "dogwhistle", "categories", "safe", "triggers")


class Scanner:
    """One worker's automaton and compiled patterns. Found matches are kept as columns.

    A tolerant one keeps going: a pattern that does not compile is left out, and
    a text that cannot be scanned, or takes a pattern more than `seconds`, has
    no matches; faults says so for each text.
    """

    def __init__(self, lexicon: Lexicon, skip: bool, patterns: bool, tolerant: bool = False, seconds: float | None = None) -> None:
        import ahocorasick

        self.tolerant, self.seconds = tolerant, seconds
        self.broken: list[str] = []
        self.faults: list[list[str]] = []

        self.lexicon, self.skip = lexicon, skip
        self.plain = plain_characters()
        grouped: dict[str, list[tuple[int, int]]] = {}
        self.kinds: list[str | None] = [None]
        for key, i, kind in lexicon.keys:
            if kind not in self.kinds:
                self.kinds.append(kind)
            grouped.setdefault(key, []).append((i, self.kinds.index(kind)))
        self.told = [confidence_of(k) for k in self.kinds]
        self.automaton = None
        if grouped:
            self.automaton = ahocorasick.Automaton()
            for key, found in grouped.items():
                self.automaton.add_word(key, (len(key), found))
            self.automaton.make_automaton()
        self.patterns = []
        for i, e in enumerate(lexicon.entries) if patterns else ():
            if e.term_kind == "pattern" and (compiled := self._compiled(e.term_id, e.pattern or re.escape(e.surface))):
                self.patterns.append((compiled, i, 0 if e.pattern else 3))
        self.prefilter = Prefilter([p.pattern for p, _, _ in self.patterns]) if self.patterns else None
        self.rules = {i: [c for r in e.rules if r.trigger_pattern and (c := self._compiled(e.term_id, r.trigger_pattern))] for i, e in enumerate(lexicon.entries) if e.term_kind == "number"}
        es = lexicon.entries
        self.of_entry = {
            "term_id": [e.term_id for e in es], "surface": [e.surface for e in es], "term_kind": [e.term_kind for e in es], "severity": [e.severity for e in es], "ambiguity": [e.ambiguity for e in es], "status": [e.status for e in es],
            "dogwhistle": [e.dogwhistle for e in es], "categories": [list(e.categories) for e in es], "safe": [[x for x in e.safe_contexts if x] for e in es], "triggers": [[t for r in e.rules for t in r.trigger_terms] for e in es],
        }
        self.clear()

    def clear(self) -> None:
        self.sizes: list[int] = [0]
        self.rows: list[tuple] = []
        self.faults = []

    def _compiled(self, term_id: int, pattern: str) -> re.Pattern | None:
        try:
            return re.compile(pattern)
        except re.error as e:
            if not self.tolerant:
                raise
            self.broken.append(f"pattern of term {term_id}: {e}")
            return None

    def _found(self, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
        """Matches of a pattern; with a limit of time, by an engine that can be stopped."""
        if self.seconds is None:
            return pattern.finditer(text)
        import regex

        return regex.compile(pattern.pattern, regex.V0).finditer(text, timeout=self.seconds)

    def scan_tolerantly(self, text: str | None, late: bool = False) -> None:
        """scan(), but whatever goes wrong is a fault of this text, which then has no matches. late: it is not begun any more."""
        first, n = len(self.rows), len(self.sizes)
        faults = list(self.broken)
        try:
            if late:
                raise TimeoutError("the deadline has passed")
            self.scan(text)
        except Exception as e:  # whatever a text or a pattern does must not take the others with it
            del self.rows[first:], self.sizes[n:]
            self.sizes.append(first)
            faults.append(f"{FAILED}{type(e).__name__}: {e}")
        self.faults.append(faults)

    def _add(self, text: str, i: int, kind: int, flag: int, span: tuple[int, int, int, int], stage: int, seq: int, confidence: float, cap: bool, start_ok: bool) -> None:
        start, end = span[:2]
        hit = any(p.search(text) for p in self.rules[i]) if i in self.rules else False
        self.rows.append((i, kind, flag, *span, stage, seq, hit, confidence, cap, start_ok, text[start:end], text[max(0, start - SAFE_WINDOW) : start], text[end : end + SAFE_WINDOW]))

    def scan(self, text: str | None) -> None:
        """Adds the matches of one more text."""
        text = text or ""
        norm, off = normalise_fast(text, self.plain)
        first = len(self.rows)
        if self.automaton and norm:
            seen = self._scan_keys(text, norm, off, first)
            # Gaps are between Hangul letters, which a text with plain characters only can have in itself.
            if self.skip:
                self._scan_gaps(text, norm, off if off is not None else range(len(norm)), first, seen)
        for place in self.prefilter.candidates(text) if self.prefilter else ():
            pattern, i, flag = self.patterns[place]
            for m in self._found(pattern, text):
                self._add(text, i, 0, flag, (*m.span(), *m.span()), 2, len(self.rows) - first, 1.0, False, True)
        self.sizes.append(len(self.rows))

    def _scan_keys(self, text: str, norm: str, off: list[int] | None, first: int) -> set[tuple[int, int]]:
        seen: set[tuple[int, int]] = set()
        for end, (size, found) in self.automaton.iter(norm):
            at = (end - size + 1, end + 1, end - size + 1, end + 1) if off is None else _span(off, end - size + 1, end + 1)
            seen.add(at[:2])
            start_ok = off is None or at[2] == 0 or off[at[2]] != off[at[2] - 1]
            for i, kind in found:
                confidence, cap, flags = self.told[kind]
                self._add(text, i, kind, _FLAGS.index(flags), at, 0, len(self.rows) - first, confidence, cap, start_ok)
        return seen

    def _scan_gaps(self, text: str, norm: str, off: Sequence[int], first: int, seen: set[tuple[int, int]]) -> None:
        view, places, blank = skip_view(norm)
        for end, (size, found) in self.automaton.iter(view) if view != norm else ():
            start = end - size + 1
            if places[end] + 1 - places[start] == size:
                continue
            at = _span(off, places[start], places[end] + 1)
            if at[:2] in seen:
                continue
            for i, kind in found:
                if self.kinds[kind] is None:
                    self._add(text, i, kind, 2, at, 1, len(self.rows) - first, 0.8, any(blank[start:end]), at[2] == 0 or off[at[2]] != off[at[2] - 1])

    def taken(self, kind: pa.ListType) -> pa.Array:
        """The matches since the last call as one list for each text."""
        columns = list(zip(*self.rows, strict=True)) or [()] * (3 + len(_OWN))
        entry, kinds, flags = (pa.array(c, pa.int32()) for c in columns[:3])
        types = {f.name: f.type for f in kind.value_type}
        made = {name: pa.array(self.of_entry[name], types[name]).take(entry) for name in _OF_ENTRY}
        made |= {name: pa.array(c, types[name]) for name, c in zip(_OWN, columns[3:], strict=True)}
        made["variant_kind"] = pa.array(self.kinds, types["variant_kind"]).take(kinds)
        made["flags"] = pa.array(_FLAGS, types["flags"]).take(flags)
        fields = list(kind.value_type)
        out = pa.ListArray.from_arrays(pa.array(self.sizes, pa.int32()), pa.StructArray.from_arrays([made[f.name] for f in fields], fields=fields), type=kind)
        self.clear()
        return out


def _span(off: Sequence[int], ns: int, ne: int) -> tuple[int, int, int, int]:
    """Source and normalised range of normalised places, taken to the end of the last source character."""
    last = off[ne - 1]
    while ne < len(off) and off[ne] == last:
        ne += 1
    return off[ns], last + 1, ns, ne


#: Rows that are scanned before their matches are handed on, and matches after which that is done earlier.
SCAN_ROWS, SCAN_MATCHES = 1_000, 20_000


def _scanned(scanner: Scanner, batch: pa.RecordBatch, text_col: str, one: Callable[[str | None], None]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have been scanned; the caller takes their matches before it asks for the next part."""
    for at in range(0, batch.num_rows, SCAN_ROWS):
        part, done = batch.slice(at, SCAN_ROWS), 0
        for i, text in enumerate(part.column(text_col).to_pylist(), 1):
            one(text)
            if len(scanner.rows) >= SCAN_MATCHES or i == part.num_rows:
                yield part.slice(done, i - done)
                done = i


def usable(lexicon: Lexicon) -> Lexicon:
    """The lexicon without rules whose patterns do not compile."""

    def fine(rule: Rule) -> bool:
        try:
            return rule.trigger_pattern is None or bool(re.compile(rule.trigger_pattern))
        except re.error:
            return False

    return Lexicon(tuple(replace(e, rules=tuple(r for r in e.rules if fine(r))) for e in lexicon.entries), lexicon.version)


#: How a fault begins that leaves a text without an answer.
FAILED = "failed: "


def scan_tolerantly(docs: DataFrame, lexicon: Lexicon, skip_char: bool = True, patterns: bool = True, seconds: float | None = None, deadline: float | None = None) -> DataFrame:
    """scan() with a column faults beside m: what went wrong with each text, in place of a failed job.

    seconds: what one pattern may take on one text; deadline: the time, in
    seconds since 1970, from which on no further text is begun.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("m", T._parse_datatype_string(f"array<{MATCH}>")), T.StructField("faults", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon, skip_char, patterns, True, seconds)
        arrow = to_arrow_schema(schema)
        one = lambda t: scanner.scan_tolerantly(t, deadline is not None and time.time() > deadline)
        for batch in batches:
            for b in _scanned(scanner, batch, "text", one):
                faults = pa.array(scanner.faults, arrow.field("faults").type)
                yield pa.RecordBatch.from_arrays([*b.columns, scanner.taken(arrow.field("m").type), faults], schema=arrow)

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, lexicon: Lexicon, skip_char: bool = True, patterns: bool = True, text_col: str = "text") -> DataFrame:
    """docs with an array column m of all occurrences in scan order: keys, then keys across gaps, then patterns."""
    schema = T.StructType([*docs.schema.fields, T.StructField("m", T._parse_datatype_string(f"array<{MATCH}>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon, skip_char, patterns)
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for b in _scanned(scanner, batch, text_col, scanner.scan):
                yield pa.RecordBatch.from_arrays([*b.columns, scanner.taken(arrow.field("m").type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def scan_literal_keys(docs: DataFrame, id_col: str, text: Column, keys: DataFrame) -> DataFrame:
    """(id, key columns, pos) of every occurrence. keys: key (not empty) and any further columns, MOST_KEYS of them at most, which are sent to all executors; beyond, scan() has no limit."""
    joined = docs.select(id_col, text.alias("norm")).join(F.broadcast(bounded(keys)), F.contains(F.col("norm"), F.col("key")))
    return joined.select(id_col, *keys.columns, F.explode(occurrences(F.col("norm"), F.col("key"))).alias("pos"))


def with_match(m: Column, **changes: Column) -> Column:
    for name, value in changes.items():
        m = m.withField(name, value)
    return m


def letter_boundary(docs: DataFrame) -> DataFrame:
    """Drops matches that start inside a source character; letter-level variants pass, and so do patterns."""
    keep = lambda x: (x.stage == 2) | (x.term_kind == "pattern") | x.start_ok | F.coalesce(x.variant_kind.isin("jamo", "chosung", "pattern"), F.lit(False))
    return docs.withColumn("m", F.filter("m", keep))


def token_containment(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Drops matches that lie in a longer token; pattern and number terms are exempt. tokens: array of (s, e, oov)."""
    marked = intervals.with_marks(docs, tokens)
    return marked.withColumn("m", F.filter("m", lambda x, i: x.term_kind.isin("pattern", "number") | (x.stage == 2) | ~F.get("marks", i).inside)).drop("marks")


def edge_tokens(docs: DataFrame, tokens: str = "base_tokens") -> DataFrame:
    """Word matches next to a Hangul syllable: kept if no token crosses that edge; kept with a cap if all crossing ones are unknown words; else dropped."""

    def cut(x: Column, mark: Column, kind: str) -> Column:
        """How many tokens of that kind cross an edge that has a syllable beside it."""
        left, right = F.right(x.left, F.lit(1)).rlike("[가-힣]"), F.left(x.right, F.lit(1)).rlike("[가-힣]")
        return F.when(left, mark[f"left_{kind}"]).otherwise(0) + F.when(right, mark[f"right_{kind}"]).otherwise(0)

    exempt = lambda x: (x.term_kind != "word") | (x.stage == 2)
    paired = F.filter(F.arrays_zip("m", "marks"), lambda p: exempt(p.m) | (cut(p.m, p.marks, "known") == 0))
    capped = lambda x: with_match(x, cap=F.lit(True), flags=F.array_append(x.flags, "oov_boundary_kept"))
    settled = F.transform(paired, lambda p: F.when(~exempt(p.m) & (cut(p.m, p.marks, "cut") > 0), capped(p.m)).otherwise(p.m))
    return intervals.with_marks(docs, tokens).withColumn("m", settled).drop("marks")


def word_containment(docs: DataFrame) -> DataFrame:
    """token_containment() for the default tokens, runs of letters and digits: only the match and the characters beside it are looked at."""
    word = r"[\p{L}\p{N}]"

    def inside(x: Column) -> Column:
        beside = F.right(x.left, F.lit(1)).rlike(word) | F.left(x.right, F.lit(1)).rlike(word)
        return beside & x.text.rlike(rf"^{word}+$")

    return docs.withColumn("m", F.filter("m", lambda x: x.term_kind.isin("pattern", "number") | (x.stage == 2) | ~inside(x)))


def safe_context(docs: DataFrame) -> DataFrame:
    """Drops ambiguous matches with a safe word within 20 characters; there, all key matches are masked. Patterns see their text unmasked."""
    return intervals.with_resolved(docs).withColumn("m", F.filter("m", lambda x, i: ~F.get("resolved", i))).drop("resolved")


def combination(docs: DataFrame) -> DataFrame:
    """Flags number terms by whether a rule's pattern is in the text or one of its terms was matched too."""
    ids = F.transform("m", lambda x: x.term_id)
    docs = docs.withColumn("ids", ids)
    flag = lambda x: F.when(x.rule_hit | F.arrays_overlap(x.triggers, F.col("ids")), "composite_satisfied").otherwise("composite_unsatisfied")
    return docs.withColumn("m", F.transform("m", lambda x: F.when(x.term_kind == "number", with_match(x, flags=F.array_append(x.flags, flag(x)))).otherwise(x))).drop("ids")


def near_triggers(starts: np.ndarray, ends: np.ndarray, trigger_starts: np.ndarray, trigger_ends: np.ndarray, window: int | None) -> np.ndarray:
    """For each span whether a trigger is at most window characters before or after it; touching and overlapping ones are none away."""
    if window is None:
        return np.full(len(starts), len(trigger_starts) > 0)
    # Those that start early enough, less those that end too early.
    early = np.searchsorted(np.sort(trigger_starts), ends + window, "right")
    return early - np.searchsorted(np.sort(trigger_ends), starts - window, "left") > 0


class _Rules:
    """A worker's rules of number terms, with compiled patterns."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.of = {e.term_id: (e.severity, [(r, re.compile(r.trigger_pattern) if r.trigger_pattern else None) for r in e.rules]) for e in lexicon.entries if e.term_kind == "number"}

    def settle(self, text: str, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, list]:
        """For each match whether a rule of its term holds there, and its severity with that; null for other terms."""
        held: list = [None] * len(term)
        severity: list = [None] * len(term)
        of_pattern: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for t in np.unique(term).tolist():
            if t not in self.of:
                continue
            plain, rules = self.of[t]
            at = np.flatnonzero(term == t)
            alone = max((r.base_severity for r, _ in rules if r.base_severity is not None), default=plain)
            best, any_rule = np.full(len(at), -1), np.zeros(len(at), bool)
            for rule, pattern in rules:
                found = np.zeros(len(at), bool)
                if pattern is not None:
                    if pattern.pattern not in of_pattern:
                        spans = [m.span() for m in pattern.finditer(text)]
                        of_pattern[pattern.pattern] = tuple(np.array([s[k] for s in spans], np.int64) for k in (0, 1))
                    found |= near_triggers(start[at], end[at], *of_pattern[pattern.pattern], rule.proximity_window)
                if rule.trigger_terms:
                    other = np.isin(term, rule.trigger_terms)
                    found |= near_triggers(start[at], end[at], start[other], end[other], rule.proximity_window)
                with_it = (plain if rule.base_severity is None else rule.base_severity) + rule.severity_delta
                best = np.where(found, np.maximum(best, min(5, max(1, with_it))), best)
                any_rule |= found
            for i, ok, s in zip(at.tolist(), any_rule.tolist(), best.tolist(), strict=True):
                held[i], severity[i] = ok, s if ok else alone
        return held, severity


def combination_within(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """combination() with distances: a rule holds for a match only if its trigger is within the rule's window of it, and then the match has the rule's base severity and what it adds.

    Of several rules that hold the severest counts; without one, the greatest
    base severity, or the term's own where no rule states one. A trigger in the
    same place as the match, or overlapping it, is no characters away. Time is
    that of sorting a document's matches.
    """
    kind = T._parse_datatype_string("array<struct<held:boolean,severity:int>>")
    schema = T.StructType([*docs.schema.fields, T.StructField("combined", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, arrow = _Rules(lexicon), to_arrow_schema(schema)
        struct = arrow.field("combined").type.value_type
        for b in intervals.in_parts(batches):
            m = b.column("m")
            flat = m.flatten()
            term, start, end = (np.asarray(flat.field(n).fill_null(-1), np.int64) for n in ("term_id", "start", "end"))
            held: list = []
            severity: list = []
            sizes = [n or 0 for n in m.value_lengths().to_pylist()]
            at = 0
            for n, text in zip(sizes, b.column("text").to_pylist(), strict=True):
                h, s = rules.settle(text or "", term[at : at + n], start[at : at + n], end[at : at + n]) if n else ([], [])
                held += h
                severity += s
                at += n
            made = pa.StructArray.from_arrays([pa.array(held, pa.bool_()), pa.array(severity, pa.int32())], fields=list(struct))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, made, type=arrow.field("combined").type)], schema=arrow)

    def settled(x: Column, i: Column) -> Column:
        c = F.get("combined", i)
        flag = F.when(c.held, "composite_satisfied").otherwise("composite_unsatisfied")
        return F.when(x.term_kind == "number", with_match(x, severity=c.severity, flags=F.array_append(x.flags, flag))).otherwise(x)

    return docs.mapInArrow(run, schema).withColumn("m", F.transform("m", settled)).drop("combined")


def quotation(docs: DataFrame) -> DataFrame:
    """Caps matches in quotation marks, or with a word of discussion in the 15 characters on both sides, read as one."""
    marks = "[" + re.escape(QUOTE_MARKS) + "]"

    def is_quoted(x: Column) -> Column:
        around = F.concat(F.right(x.left, F.lit(QUOTE_WINDOW)), F.left(x.right, F.lit(QUOTE_WINDOW)))
        wrapped = F.right(x.left, F.lit(1)).rlike(marks) & F.left(x.right, F.lit(1)).rlike(marks)
        return wrapped | around.rlike("|".join(META_WORDS))

    return docs.withColumn("m", F.transform("m", lambda x: F.when(is_quoted(x), with_match(x, cap=F.lit(True), flags=F.array_append(x.flags, "quotation_heuristic"))).otherwise(x)))


def context_score(ambiguity: Column, is_pattern: Column, classified: Column | None = None) -> Column:
    guess = F.lit(CONTEXT_FALLBACK) if classified is None else F.when(is_pattern, CONTEXT_FALLBACK).otherwise(classified)
    return F.when(ambiguity == "unambiguous", 1.0).otherwise(guess)


def risk_score(severity: Column, confidence: Column, context: Column) -> Column:
    return severity / F.lit(5.0) * confidence * context


def recommendation(status: Column, unsatisfied: Column, severity: Column, risk: Column, dogwhistle: Column, cap: Column, ambiguity: Column, context: Column) -> Column:
    base = F.when((severity >= 4) & (risk >= 0.7), "revise_recommended").when(risk >= 0.35, "review_recommended").otherwise("monitor")
    capped = dogwhistle | cap | ((ambiguity != "unambiguous") & (context < CONTEXT_SURE))
    return F.when((status == "watchlist") | unsatisfied, "monitor").when(capped & (base == "revise_recommended"), "review_recommended").otherwise(base)


def rank_of(rec: Column) -> Column:
    return F.when(rec == "revise_recommended", 3).when(rec == "review_recommended", 2).when(rec == "monitor", 1).otherwise(0)


def classify(docs: DataFrame, model: Dense) -> DataFrame:
    """docs with an array column ctx beside m: the classifier's score of ambiguous matches that are no patterns, null for the others."""
    schema = T.StructType([*docs.schema.fields, T.StructField("ctx", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in intervals.in_parts(batches):
            m = b.column("m")
            flat = m.flatten()
            asked = [a != "unambiguous" and k != "pattern" for a, k in zip(*(flat.field(n).to_pylist() for n in ("ambiguity", "term_kind")), strict=True)]
            surfaces = flat.field("surface").to_pylist()
            out, at = [], 0
            for n, text in zip(m.value_lengths().to_pylist(), b.column("text").to_pylist(), strict=True):
                wanted = sorted({surfaces[i] for i in range(at, at + (n or 0)) if asked[i]})
                known = dict(zip(wanted, model.scores(text, wanted), strict=True)) if wanted else {}
                out.append([known[surfaces[i]] if asked[i] else None for i in range(at, at + (n or 0))])
                at += n or 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow.field("ctx").type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Dense | None = None) -> DataFrame:
    """m becomes the scored matches, by start, end and scan order. With a model, the scores of ambiguous matches are its own, and unsure ones are flagged."""

    def one(x: Column, classified: Column | None) -> Column:
        context = context_score(x.ambiguity, x.term_kind == "pattern", classified)
        risk = risk_score(x.severity, x.confidence, context)
        unsure = F.lit(False) if classified is None else classified.isNotNull() & classified.between(*CONTEXT_UNSURE)
        flags = F.when(unsure, F.array_append(x.flags, "context_low_confidence")).otherwise(x.flags)
        rec = recommendation(x.status, F.array_contains(x.flags, "composite_unsatisfied"), x.severity, risk, x.dogwhistle, x.cap, x.ambiguity, context)
        return F.struct(
            x.start.alias("start"), x.end.alias("end"), x.stage.alias("stage"), x.seq.alias("seq"), x.text.alias("matched_text"), x.surface.alias("surface"), x.term_id.alias("term_id"),
            x.categories.alias("categories"), x.severity.alias("severity"), x.ambiguity.alias("ambiguity"), x.confidence.alias("match_confidence"), context.alias("context_score"), risk.alias("risk_score"), rec.alias("usage_recommendation"), flags.alias("flags"),
        )

    if model is None:
        scored = docs.withColumn("m", F.array_sort(F.transform("m", lambda x: one(x, None))))
    else:
        scored = classify(docs, model).withColumn("m", F.array_sort(F.zip_with("m", "ctx", one))).drop("ctx")
    top = F.array_max(F.transform("m", lambda x: rank_of(x.usage_recommendation)))
    overall = F.when(top == 3, "revise_recommended").when(top == 2, "review_recommended").when(top == 1, "monitor").otherwise("none")
    return scored.withColumn("overall_recommendation", overall)
