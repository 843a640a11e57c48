"""Texts that a pattern cannot match without, drawn from its syntax.

required() gives a set of texts of which every match holds at least one, so a
pattern need only be tried on texts where one of them occurs. One automaton
finds the texts of all patterns at once: what many patterns cost on a text is
then a pass of the automaton, and the few patterns that could match.

A pattern that ignores case asks for lower-case texts in the lower-cased text,
and only for characters that have no case form but their own upper and lower
one. Where nothing is required, as in `[0-9]+` or `(a|b*)`, there is no set, and
the pattern is tried everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from re import _constants as C  # the syntax tree is what re itself compiles from
from re import _parser

import ahocorasick

#: Characters of a set that is spelled out, as in [abc], and texts that one pattern may ask for.
LARGEST_SET = 8
MOST_TEXTS = 64

Texts = frozenset[str]


def _plain(ch: str, ignore_case: bool) -> str | None:
    """The character as it is looked for; None if its case forms are more than two."""
    if not ignore_case:
        return ch
    low = ch.lower()
    if len(low) != 1 or len(ch.upper()) != 1:
        return None
    forms = {low, low.upper()}
    # Those three have further forms: the Kelvin sign, the long s, the dotless and the dotted i.
    return None if low in "ksiſıµåß" or not ch.isascii() and ch.upper() != low else low if len(forms) <= 2 else None


def _characters(items: Iterable[tuple], ignore_case: bool) -> list[str] | None:
    """What a set stands for, if it is few characters."""
    out: list[str] = []
    for op, value in items:
        if op is C.LITERAL:
            codes: Iterable[int] = (value,)
        elif op is C.RANGE and value[1] - value[0] < LARGEST_SET:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        for code in codes:
            ch = _plain(chr(code), ignore_case)
            if ch is None:
                return None
            out.append(ch)
    return out if len(out) <= LARGEST_SET else None


def _better(a: Texts | None, b: Texts | None) -> Texts | None:
    """The one whose shortest text is longer; of those, the one with fewer."""
    if not a or not b:
        return a or b
    worth = lambda x: (min(map(len, x)), -len(x))
    return a if worth(a) >= worth(b) else b


def _of(tree: Iterable[tuple], flags: int) -> tuple[Texts | None, bool]:
    """(best set of a sequence, whether the whole sequence matches exactly the texts of that set)."""
    ignore_case = bool(flags & re.IGNORECASE)
    best: Texts | None = None
    # Texts that end where the sequence has come to.
    run: Texts = frozenset([""])
    whole = True

    def ended(best: Texts | None, run: Texts) -> Texts | None:
        return _better(best, run if all(run) else None)

    for op, value in tree:
        exact: Texts | None = None
        inner: Texts | None = None
        if op is C.LITERAL:
            ch = _plain(chr(value), ignore_case)
            exact = None if ch is None else frozenset([ch])
        elif op is C.IN:
            chars = _characters(value, ignore_case)
            exact = frozenset(chars) if chars else None
        elif op is C.SUBPATTERN:
            inner, is_exact = _of(value[3], (flags | value[1]) & ~value[2])
            exact = inner if is_exact else None
        elif op is C.BRANCH:
            parts = [_of(b, flags) for b in value[1]]
            if all(p for p, _ in parts):
                inner = frozenset().union(*(p for p, _ in parts))
                exact = inner if all(e for _, e in parts) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner, is_exact = _of(value[2], flags)
            if is_exact and value[1] == 1:
                exact = inner
        elif op is C.ATOMIC_GROUP:
            inner, _ = _of(value, flags)
        elif op is C.AT:
            # Anchors match no characters.
            continue
        if exact and len(exact) * len(run) <= MOST_TEXTS:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        best = _better(ended(best, run), inner)
        run = frozenset([""])
    if whole and all(run):
        return run, True
    return ended(best, run), False


def required(pattern: str) -> tuple[Texts | None, bool]:
    """(texts of which each match holds one, or None; whether they are for the lower-cased text)."""
    tree = _parser.parse(pattern)
    flags = tree.state.flags
    ignore_case = bool(flags & re.IGNORECASE) or "(?i" in pattern or bool(re.search(r"\(\?[a-zA-Z]*i", pattern))
    # A pattern that ignores case anywhere is looked for in lower case throughout.
    texts, _ = _of(tree, flags | (re.IGNORECASE if ignore_case else 0))
    return (texts if texts and len(texts) <= MOST_TEXTS else None), ignore_case


class Prefilter:
    """Which of many patterns could match a text."""

    def __init__(self, patterns: Sequence[str]) -> None:
        self.always: list[int] = []
        self.exact, self.lower = ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, pattern in enumerate(patterns):
            texts, ignore_case = required(pattern)
            if texts is None:
                self.always.append(i)
                continue
            automaton = self.lower if ignore_case else self.exact
            for t in texts:
                automaton.add_word(t, [*automaton.get(t, []), i])
        for a in (self.exact, self.lower):
            if len(a):
                a.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """The places of the patterns that may match, in order."""
        found = set(self.always)
        if len(self.exact):
            for _, places in self.exact.iter(text):
                found.update(places)
        if len(self.lower):
            for _, places in self.lower.iter(text.lower()):
                found.update(places)
        return sorted(found)
