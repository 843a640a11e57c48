"""Lexical retrieval packing: sequences of documents that are close by BM25, with no padding.

Documents are dealt out by their last word in dictionary order, mostly a rare
one, which puts copies and documents with common rare words side by side, and
are read as shards of consecutive documents. Each shard has an inverted BM25 index over its
token ids. A window is seeded with a document; the index returns its unused
neighbours, best first, and they are appended until the window is full. The
last one is cut there, and its rest seeds the next window. When no neighbour
is left, the next unused document in order goes on.

An unfilled window goes on into the partition's next shard. What is left at a
partition's end is cut into sequences of powers of two, so nothing is padded.

Null texts count as empty: their only token is the end mark. Repeated rows are
packed each. Shards end at SHARD_DOCS documents or SHARD_TOKENS tokens, which
bounds memory but for a single document.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiguard.llm.common import map_rows

WINDOW = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
SHARD_DOCS = 512
SHARD_TOKENS = 1_000_000
#: Words whose ids a task remembers for certain; it forgets none before as many others have come.
REMEMBERED = 200_000
K1, B = 1.2, 0.75
# Texts of other characters, or with marks of special tokens, go to the tokenizer as a whole.
_ODD = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0139-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201e\u2022\u2026]|<\\|")
_USUAL = bytes([9, 10, 13, *range(32, 127)])
# The tokenizer's own division of a lower-cased text, for the characters that are left; letters, which start most pieces, come first.
_PIECE = re.compile("[^\\W\\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9a-z\\u00df-\\u00f6\\u00f8-\\u017e]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Pieces' ids, made when first asked for; one look-up a piece."""

    def __init__(self, make) -> None:  # noqa: ANN001
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.make(word)
        return ids


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes. The tokenizer divides texts into pieces and joins nothing across them, so each piece is encoded once."""

    def __init__(self, path: str | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known = _Known(self._piece)
        self.former: dict[str, bytes] = {}

    def _piece(self, word: str) -> bytes:
        ids = self.former.get(word)
        if ids is None:
            spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if b"<|" in (raw := t.encode()) or (raw.translate(None, _USUAL) if t.isascii() else _ODD.search(t)):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
                continue
            words = _PIECE.findall(t.lower())
            if len(self.known) > REMEMBERED:
                self.former, self.known = dict(self.known), _Known(self._piece)
            out.append(b"".join(map(self.known.__getitem__, words)))
        return out


def worker_encoder(path: str | None) -> Encoder:
    """The encoder of this worker process, made by its first task; it outlives the task, unlike what the task brings along."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_lexiguard_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class Index:
    """BM25 postings of a shard by token id. Tokens of more than half of the documents weigh nothing and have none."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        n = len(docs)
        self.n = n
        counted = [np.unique(d, return_counts=True) for d in docs]
        size = np.array([len(d) for d in docs], dtype=np.float64)
        terms = np.concatenate([t for t, _ in counted]).astype(np.int64)
        tf = np.concatenate([c for _, c in counted]).astype(np.float64)
        owner = np.repeat(np.arange(n), [len(t) for t, _ in counted])
        self.vocabulary, code, df = np.unique(terms, return_inverse=True, return_counts=True)
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0)
        weight = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / max(1.0, size.mean())))
        some = weight > 0
        order = np.argsort(code[some], kind="stable")
        self.owner, self.weight = owner[some][order], weight[some][order]
        self.starts = np.searchsorted(code[some][order], np.arange(len(self.vocabulary) + 1))
        edges = np.cumsum([0] + [len(t) for t, _ in counted])
        self.terms_of = [code[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a weighty token with doc, best first, then by place."""
        q = self.terms_of[doc]
        a, n = self.starts[q], self.starts[q + 1] - self.starts[q]
        total = int(n.sum())
        if not total:
            return np.zeros(0, dtype=np.int64)
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        score = np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)
        found = np.flatnonzero((score > 0) & ~used)
        return found[np.argsort(-score[found], kind="stable")]


def order(index: Index) -> Iterator[int]:
    """Documents as they fill windows. The consumer sends True when the last one began a new window, which it then seeds."""
    used = np.zeros(index.n, dtype=bool)
    next_free = 0
    queue: list[int] = []
    while True:
        while queue and used[queue[-1]]:
            queue.pop()
        if queue:
            doc = queue.pop()
        else:
            while next_free < index.n and used[next_free]:
                next_free += 1
            if next_free == index.n:
                return
            doc = next_free
            queue = index.neighbours(doc, used)[::-1].tolist()
        used[doc] = True
        if (yield doc):
            queue = index.neighbours(doc, used)[::-1].tolist()


class Packer:
    """Cuts a stream of documents into windows and yields rows of pieces."""

    def __init__(self, first_id: int) -> None:
        self.sequence, self.filled, self.open = first_id, 0, []

    def _row(self, piece: tuple, sequence: int, offset: int) -> tuple:
        doc_id, start, ids, total = piece
        return doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset

    def add(self, doc_id: int, ids: bytes) -> Iterator[tuple]:
        """Rows of the windows that the document fills."""
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, WINDOW - self.filled)
            self.open.append((doc_id, start, ids[4 * start : 4 * (start + n)], total))
            self.filled += n
            start += n
            if self.filled == WINDOW:
                yield from self.close(WINDOW)

    def close(self, size: int) -> Iterator[tuple]:
        offset, rest = 0, []
        for piece in self.open:
            n = len(piece[2]) // 4
            here = max(0, min(n, size - offset))
            if here:
                yield self._row((piece[0], piece[1], piece[2][: 4 * here], piece[3]), self.sequence, offset)
            if here < n:
                rest.append((piece[0], piece[1] + here, piece[2][4 * here :], piece[3]))
            offset += n
        self.open, self.filled = rest, self.filled - size
        self.sequence += 1

    def end(self) -> Iterator[tuple]:
        """What is left, in sequences of powers of two."""
        while self.filled:
            yield from self.close(1 << (self.filled.bit_length() - 1))


def _shard(batch: list[tuple[int, bytes]], packer: Packer) -> Iterator[tuple]:
    docs = order(Index([np.frombuffer(ids, dtype="<u4") for _, ids in batch]))
    doc = next(docs, None)
    while doc is not None:
        before = packer.sequence
        yield from packer.add(*batch[doc])
        try:
            doc = docs.send(packer.sequence != before)
        except StopIteration:
            doc = None


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The partition's number is in the upper bits of sequence_id, so ids never
    meet. An empty table gives no rows; further columns are not read.
    """
    t = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", t.alias("text"), F.xxhash64(F.array_max(F.split(t, " "))).alias("key"))
    dealt = keyed.repartitionByRange("key", "doc_id", F.xxhash64("text")).sortWithinPartitions("key", "doc_id", "text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder = worker_encoder(tokenizer_path)
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 40)
        end = np.array([END], dtype="<u4").tobytes()
        batch: list[tuple[int, bytes]] = []
        wait: list[tuple[int, str]] = []
        tokens = chars = 0

        def encoded() -> Iterator[tuple[int, bytes]]:
            for (doc_id, _), ids in zip(wait, encoder.encode([x for _, x in wait]), strict=True):
                yield doc_id, ids + end

        for doc_id, text in rows:
            wait.append((doc_id, text))
            chars += len(text)
            if len(wait) >= 128 or chars >= 500_000:
                batch += encoded()
                tokens += sum(len(ids) // 4 for _, ids in batch[-len(wait) :])
                wait, chars = [], 0
                if len(batch) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield from _shard(batch, packer)
                    batch, tokens = [], 0
        batch += encoded() if wait else []
        if batch:
            yield from _shard(batch, packer)
        yield from packer.end()

    return map_rows(dealt, ["doc_id", "text"], run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
