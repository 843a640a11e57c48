"""Personal data with exact source offsets, also behind disguises.

Plain detectors run on the text as it is. A second pass runs them on a
normalised copy: look-alike characters are folded to ASCII, spelled digits
become digits, and written-out "at" and "dot" become their signs. The copy
keeps the list of its edits, so what is found there maps back to code points
of the source. Every pattern runs in time linear in the text: runs of blanks,
digits and host letters are taken whole, and are entered at their start only.

Null text counts as empty and has no spans. Offsets are code points, end
exclusive. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame

from lexiguard.llm.common import Span, map_rows, spans_sha, spans_text

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# From the first to the last digit of a stretch of digits, blanks, dots and hyphens; addresses and cards lie within one.
_NUMERIC = re.compile(r"[0-9][0-9 .-]{5,}[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    odd = digits[::-1]
    return (sum(map(int, odd[::2])) + sum(_LUHN[int(c)] for c in odd[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            last = m.end()


def detect(text: str) -> list[Span]:
    """Plain identifiers of a text, by kind as listed, then start; within a kind leftmost and without overlap."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    cards: list[Span] = []
    for run in _NUMERIC.finditer(text):
        a, b = run.span()
        for m in _IP.finditer(text, a, b):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        if b - a >= 16:
            for m in _CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    cards.append(("card", *m.span()))
    out += cards
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ь": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "օ": "o", "ո": "n", "ս": "u", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "∙": ".", "⁺": "+",
}
_DROPPED = "\u00ad\u180e\u200b\u200c\u200d\u2060\ufeff"

# Words for the digits in the corpus's languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SIGN_WORDS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-"}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GAP = r"(?:[ \t]*+(?:[-,/][ \t]*+)?)"
_ITEM = rf"(?:(?:double|triple)[ \t]++)?(?:{_DIGIT}|[0-9]++)|{'|'.join(_SIGN_WORDS)}|\+"
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_ITEM})(?:{_GAP}(?:{_ITEM}))+(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
# A word of nothing but items; of runs, _digits_of() wants two digits.
_ITEMS_ONLY = re.compile(rf"(?:double|triple|{'|'.join(_SIGN_WORDS)}|{_DIGIT})+")
_SPELLED_ITEM = re.compile(rf"(?:(double|triple)[ \t]+)?({_DIGIT}|[0-9]+)|({'|'.join(_SIGN_WORDS)}|\+)")

# Blanks before a sign are only entered at their first one.
_BLANKS = r"(?<![ \t])[ \t]++"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT_SIGN = rf"{_OPEN}[ \t_-]*+(?:at|arroba|@)[ \t_-]*+{_SHUT}[ \t]*+"
_AT = rf"(?:{_BLANKS}(?:{_AT_SIGN}|@[ \t]*+|at[ \t]++)|{_AT_SIGN}|_at_|@[ \t]*+)"
_DOT_SIGN = rf"{_OPEN}[ \t_-]*+(?:dot|punkt|punto|\.)[ \t_-]*+{_SHUT}[ \t]*+"
_DOT_DISGUISED = rf"(?:{_BLANKS}(?:{_DOT_SIGN}|(?:dot|punkt|punto)[ \t]++)|{_DOT_SIGN}|_dot_)"
_DOT = rf"(?:{_DOT_DISGUISED}|\.)"
# What makes an address disguised, so that every address or number that is edited holds one: all of _AT and _DOT but a plain sign.
# Each comes with strings of which a text that it matches has one.
_DISGUISES = (
    (tuple("[({<"), re.compile(rf"[({{<\[][ \t_-]*+(?:at|arroba|@|dot|punkt|punto|\.)[ \t_-]*+[\])}}>]")),
    ((" at", "\tat", "_at"), re.compile(rf"[ \t_]at[ \t_]++[a-z0-9-]+?{_DOT}")),
    (("dot", "punkt", "punto"), re.compile(r"[ \t_](?:dot|punkt|punto)[ \t_]")),
    (("@",), re.compile(r"[ \t]@|@[ \t]")),
)
_AT_RX = re.compile(_AT)
_HOST = re.compile(rf"[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)+")
_DOT_RX = re.compile(_DOT)
_DOT_DISGUISED_RX = re.compile(_DOT_DISGUISED)
_NET = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
# Endings after which "name at host.tld" is read as an address even though its dot is a plain one.
PLAIN_ENDINGS = frozenset("com org net edu gov info io co de fr es uk eu at ch it nl".split())
_ANY_DIGIT = re.compile("[0-9]")
_DIGITLIKE_HINT = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
_DIGITLIKE = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl](?:[ .()-]{0,2}[0-9OoIl])+(?![A-Za-z0-9])")
_DIGITLIKE_TO = str.maketrans("OoIl", "0011")


class Mapped:
    """A text and the edits that made it, step by step, so that its spans can be traced to the source."""

    def __init__(self, text: str) -> None:
        self.text = text
        #: For each step: the edits' new starts, new ends, old starts and old ends.
        self.steps: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put new strings for ranges that are in order and apart; each new character stands for the whole range."""
        if not edits:
            return
        out, at, size = [], 0, 0
        step: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
        for a, b, new in edits:
            out += [self.text[at:a], new]
            size += a - at + len(new)
            for part, x in zip(step, (size - len(new), size, a, b), strict=True):
                part.append(x)
            at = b
        self.text = "".join([*out, self.text[at:]])
        self.steps.append(step)

    def _before(self, at: int, step: tuple[list[int], list[int], list[int], list[int]]) -> tuple[int, int]:
        """The range of the character at a place before one step."""
        starts, ends, old_starts, old_ends = step
        i = bisect_right(starts, at) - 1
        # Deletions leave no character; the last edit that starts here and is not empty counts.
        if i >= 0 and at < ends[i]:
            return old_starts[i], old_ends[i]
        old = at if i < 0 else at - ends[i] + old_ends[i]
        return old, old + 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source range of a span that is not empty."""
        for step in reversed(self.steps):
            start, end = self._before(start, step)[0], self._before(end - 1, step)[1]
        return start, end


def _folded(ch: str) -> str | None:
    if ch in _DROPPED:
        return ""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if ch.isdecimal() and not ch.isascii():
        return str(unicodedata.decimal(ch))
    if ch > "\u024f" or ch == "\u00a0":
        plain = unicodedata.normalize("NFKC", ch)
        if len(plain) == 1 and plain.isascii():
            return plain
    return None


def _digits_of(run: str) -> list[tuple[int, int, str]]:
    """Edits that turn a run of spelled digits into plain ones, none if it has no spelled ones."""
    items = list(_SPELLED_ITEM.finditer(run))
    if sum(bool(m[2]) and not m[2].isdigit() for m in items) < 2:
        return []
    edits, at = [], 0
    for m in items:
        new = _SIGN_WORDS.get(m[3].lower(), "+") if m[3] else DIGIT_WORDS.get(m[2].lower(), m[2]) * {"double": 2, "triple": 3}.get((m[1] or "").lower(), 1)
        if at and m.start() > at:
            edits.append((at, m.start(), ""))
        edits.append((*m.span(), new))
        at = m.end()
    return edits


def _lowered(text: str) -> str:
    """The text in lower case, each character in its place."""
    low = text.lower()
    # Only the capital I with a dot becomes two characters.
    return low if len(low) == len(text) else text.replace("\u0130", "i").lower()


class _Known(dict):
    """What a test says of a string, which is looked into once."""

    def __init__(self, test: Callable[[str], bool]) -> None:
        super().__init__()
        self.test = test

    def __missing__(self, x: str) -> bool:
        said = self.test(x)
        if len(x) <= 32:
            if len(self) > 200_000:
                self.clear()
            self[x] = said
        return said


_SPELLED_WORDS = _Known(lambda word: _ITEMS_ONLY.fullmatch(word) is not None)
_FOLDED_CHARS = _Known(lambda ch: _folded(ch) is not None)


def digit_words() -> ahocorasick.Automaton:
    """Finds the words for digits, wherever they stand, with their lengths."""
    a = ahocorasick.Automaton()
    for w in DIGIT_WORDS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def _has_spelled(low: str, digits: ahocorasick.Automaton) -> bool:
    """Whether a word of nothing but spelled digits and signs is there, which every run of _SPELLED with a spelled digit has. A very long word counts as one."""
    for end, size in digits.iter(low):
        start = end - size + 1
        while start and low[start - 1].isalpha():
            start -= 1
            if end - start > 32:
                return True
        word = _WORD.match(low, start, start + 64)
        if word and (len(word[0]) == 64 or _SPELLED_WORDS[word[0]]):
            return True
    return False


def _disguised(low: str) -> bool:
    return any(any(x in low for x in parts) and rx.search(low) for parts, rx in _DISGUISES)


def normalised(text: str, digits: ahocorasick.Automaton) -> Mapped | None:
    """The text after all transducers, or None where none of them changes it."""
    m = Mapped(text)
    if not text.isascii() and any(map(_FOLDED_CHARS.__getitem__, set(text))):
        m.replace([(x.start(), x.end(), new) for x in re.finditer("[^\x00-\x7f]", text) if (new := _folded(x[0])) is not None])
    if _ANY_DIGIT.search(m.text) and _DIGITLIKE_HINT.search(m.text):
        m.replace(_lookalike_digits(m.text))
    low = _lowered(m.text)
    if _has_spelled(low, digits):
        m.replace([(x.start() + a, x.start() + b, new) for x in _SPELLED.finditer(low) for a, b, new in _digits_of(x[0])])
        low = _lowered(m.text)
    if _disguised(low):
        m.replace(list(_mail_edits(low)))
        low = _lowered(m.text)
        m.replace([(x.start() + d.start(), x.start() + d.end(), ".") for x in _NET.finditer(low) for d in _DOT_RX.finditer(x[0]) if d[0] != "."])
    return m if m.steps else None


def _lookalike_digits(text: str) -> list[tuple[int, int, str]]:
    """Letters that look like digits, in runs that are mostly digits."""
    edits = []
    for run in _DIGITLIKE.finditer(text):
        letters = [i for i, c in enumerate(run[0]) if c in "OoIl"]
        if letters and sum(c.isdigit() for c in run[0]) >= max(3, 2 * len(letters)):
            edits += [(run.start() + i, run.start() + i + 1, run[0][i].translate(_DIGITLIKE_TO)) for i in letters]
    return edits


def _mail_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits of a lower-cased text around each sign for "at": disguised dots of the name before it, the sign, disguised dots of the host after it.

    A name is followed backwards over its letters and disguised dots, as far as
    the sign before it, so every character is looked at once.
    """
    dots = {m.end(): m.start() for m in _DOT_DISGUISED_RX.finditer(text)}
    low = 0
    for m in _AT_RX.finditer(text):
        (a, b), bound = m.span(), low
        low = b
        host = _HOST.match(text, b)
        if not host:
            continue
        at, has_dot = m[0].strip(), _DOT_DISGUISED_RX.search(host[0])
        if at.lower() == "at" and not (has_dot or host[0].rsplit(".", 1)[-1].lower() in PLAIN_ENDINGS):
            continue
        start = a
        while start > bound:
            if text[start - 1] in _LOCAL_CHARS:
                start -= 1
            elif start < a and dots.get(start, -1) >= bound:
                start = dots[start]
            else:
                break
        name = a
        while start < name and text[start] in "._ \t":
            start += 1
        if start == a:
            continue
        yield from ((d.start(), d.end(), ".") for d in _DOT_DISGUISED_RX.finditer(text, start, a) if d.start() > start)
        if m[0] != "@":
            yield a, b, "@"
        yield from ((d.start(), d.end(), ".") for d in _DOT_DISGUISED_RX.finditer(text, b, host.end()))
        low = host.end()


def find(text: str | None, digits: ahocorasick.Automaton | None = None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans with those behind disguises, both by kind as listed, then start and end."""
    text = text or ""
    base = detect(text)
    copy = normalised(text, digits or digit_words())
    if copy is None:
        return base, base
    have: dict[str, list[tuple[int, int]]] = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    added = {
        (k, s, e)
        for k, a, b in detect(copy.text)
        for s, e in [copy.source(a, b)]
        if not any(x <= s and e <= y for x, y in have[k])
    }
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def redact(text: str, spans: Iterable[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then the longer counts."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts of plain spans, digest of plain spans, all spans, counts with disguised ones.

    A null text is empty: zero counts, the digest of the empty string, no
    spans. Rows with the same id each get their row; an empty table gives an
    empty result; further columns of docs are not read.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        digits = digit_words()
        for doc_id, text in rows:
            base, spans = find(text, digits)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            yield (doc_id, *n, spans_sha(base), spans_text(spans), len(spans) - len(base))

    return map_rows(docs, [id_col, text_col], run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
