"""Secrets in text: an Aho-Corasick pass finds keywords, anchored patterns run only at its hits, checksums confirm.

Kinds: assign (a value given to a password-like name), access (key ids that
start with AKIA), hex (long runs of lower-case hex digits, which have no
keyword and are found by a scan for such runs). The method adds: checked
(prefixed tokens whose last six characters are the base-62 CRC-32 of the
rest) and signed (three-part web tokens whose header decodes to JSON with an
algorithm). Unconfirmed tokens of the added kinds are not reported.

Null text counts as empty. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame

from lexiguard.llm.common import Span, map_rows, spans_sha, spans_text

KINDS = ("assign", "access", "hex")
ADDED = ("checked", "signed")
_ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}

# Keywords in lower case with the kind that each starts.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked",
    "eyj": "signed",
}
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_SIGNED_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*")
_SIGNED = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def base62_crc(body: str) -> str:
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _ALPHABET[r] + out
    return out


def _signed_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # no header nests as deep as its reader cannot follow
        return False
    return isinstance(head, dict) and "alg" in head


def find(text: str | None, keywords: ahocorasick.Automaton) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans with the confirmed ones of the added kinds, by start, then kind as listed."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = sorted({(end - n + 1, kind) for end, (kind, n) in keywords.iter(low)})
    base: list[Span] = [("hex", *m.span()) for m in _HEX.finditer(text)]
    added: list[Span] = []
    past = dict.fromkeys(_ORDER, 0)
    for at, kind in hits:
        if at < past[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, at)
            if m and len(m[1]) >= 12:
                base.append((kind, *m.span()))
        elif kind == "access":
            m = _ACCESS.match(text, at)
            if m and m.end() - at >= 18:
                base.append((kind, *m.span()))
        elif kind == "checked":
            m = _CHECKED.match(text, at)
            if m and base62_crc(m[1]) == m[2]:
                added.append((kind, *m.span()))
        else:
            m = _SIGNED.match(text, at)
            if m and _signed_header(m[1]):
                added.append((kind, *m.span()))
            elif not m and (run := _SIGNED_RUN.match(text, at)):
                # No later start in this run does better.
                past[kind] = run.end()
        if m:
            past[kind] = m.end()
    by_start = lambda x: (x[1], _ORDER[x[0]], x[2])
    base.sort(key=by_start)
    return base, sorted(base + added, key=by_start) if added else base


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts of plain spans, digest of plain spans, all spans, number of confirmed additions.

    A null text is empty: zero counts, the digest of the empty string, no
    spans. Repeated ids each get their row; an empty table gives an empty
    result; further columns are not read.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        keywords = automaton()
        for doc_id, text in rows:
            base, spans = find(text, keywords)
            yield (doc_id, *(sum(k == kind for k, _, _ in base) for kind in KINDS), spans_sha(base), spans_text(spans), len(spans) - len(base))

    return map_rows(docs, [id_col, text_col], run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
