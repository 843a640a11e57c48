"""Toxicity scores from the nearest labelled examples, found exactly through a block-max inverted index.

Terms are words and word beginnings of four to six letters, each also in
forms that stand for coming twice, and three times. The vocabulary
holds every term of the labelled sample whose shares of documents differ
between labels beyond chance; a document is its TF-IDF vector over it, with
document frequencies counted over the whole corpus. Cosine neighbours are
searched block by block: a block is skipped only if the sum of its largest
weights cannot reach the k-th neighbour found so far, so results are exact.
Neighbours vote by similarity; a logistic curve fitted to leave-one-out votes
turns the vote into a probability.

Over all terms of the sample instead, the same search ranks held-out documents
worse (see the README), since most words of a text say nothing of its tone.

Bounds, parameters of fit(): FIT_ROWS labelled rows in all, at most half of
them of one label, chosen by the hash of their id; K neighbours. Everything
kept on the driver or broadcast is bounded by these rows.

Null texts count as empty. A text without any term of the vocabulary gets the
smoothed share of toxic rows among such labelled texts. Without rows of both
labels every score is the share of toxic rows (0 without labels). Repeated
label rows count once, with their largest mark; null marks count as none. A
labelled id that several texts have stands for the largest of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiguard.llm.common import discard, filter_rows, map_rows, shipped, written

FIT_ROWS = 16_384
K = 15
BLOCK = 1_024
#: Similarity that a clean vote has besides the neighbours' own.
PRIOR = 1.0
#: Vectors whose neighbours a task remembers; short texts often have equal ones.
REMEMBERED = 50_000
#: Least z score of the difference of these shares.
LEAST_Z = 3.0
#: Least ratio of the shares of documents of either label that have a term.
LEAST_RATIO = 4.0
PREFIXES = (4, 5, 6)
#: Counts from which a repeated term is also a term of its own, so that the angle between vectors shows how often it comes.
DOSES = (2, 3)
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def terms_of(words: Counter) -> Counter:
    """Words, and beginnings of longer words marked by '*', with counts; what comes 2 and 3 times or more is a term of its own too."""
    out: Counter = Counter(words)
    for w, n in words.items():
        size = len(w)
        for p in PREFIXES:
            if size > p:
                out[w[:p] + "*"] += n
    for t, n in list(out.items()):
        for dose in DOSES:
            if n >= dose:
                out[f"{t}{dose}"] = 1
    return out


def vector(text: str | None, ids: dict[str, int]) -> dict[int, int]:
    """Counts of the vocabulary's terms, as terms_of() counts them. ids also holds each term's dosed forms."""
    out: dict[int, int] = {}
    if not ids:
        return out
    get = ids.get
    seen: dict[str, int] = {}
    for w, n in word_counts(text).items():
        if w in ids:
            seen[w] = seen.get(w, 0) + n
        size = len(w)
        for p in PREFIXES:
            if size > p and (t := w[:p] + "*") in ids:
                seen[t] = seen.get(t, 0) + n
    for t, n in seen.items():
        i = ids[t]
        if i >= 0:
            out[i] = n
        for dose in DOSES:
            if n >= dose and (i := get(f"{t}{dose}")) is not None:
                out[i] = 1
    return out


def vocabulary_ids(terms: list[str]) -> dict[str, int]:
    """Places of terms; a term that is only there in a dosed form gets -1, so that it is counted."""
    ids = {t: i for i, t in enumerate(terms)}
    for t in terms:
        if t[-1].isdigit():
            ids.setdefault(t[:-1], -1)
    return ids


@dataclass
class Index:
    """Unit vectors of labelled examples as postings by term, with the largest weight of each term in each block."""

    idf: np.ndarray
    labels: np.ndarray
    example_ids: np.ndarray
    weight_of: np.ndarray
    postings: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bounds: np.ndarray = field(repr=False)
    maxima: np.ndarray = field(repr=False)
    curve: tuple[float, float] = (0.0, 0.0)
    bare: float = 0.0
    memory: dict = field(default_factory=dict, repr=False)

    @classmethod
    def build(cls, idf: np.ndarray, rows: list[tuple[int, int, list[int], list[int]]], class_weights: tuple[float, float]) -> Index:
        # In order of their vectors, so that neither blocks nor ties depend on ids.
        rows = sorted((r for r in rows if r[2]), key=lambda r: (min(r[2]), sorted(zip(r[2], r[3], strict=True)), r[1], r[0]))
        n, v = len(rows), len(idf)
        blocks = max(1, -(-n // BLOCK))
        term, example, weight = [], [], []
        for i, (_, _, ids, counts) in enumerate(rows):
            w = np.log1p(np.array(counts)) * idf[ids]
            norm = math.sqrt(float(w @ w))
            term += ids
            example += [i] * len(ids)
            weight += (w / norm if norm else w).tolist()
        t, e, w = np.array(term, dtype=np.int64), np.array(example, dtype=np.int64), np.array(weight)
        order = np.lexsort((e, t))
        t, e, w = t[order], e[order], w[order]
        bounds = np.searchsorted(t * (blocks + 1) + e // BLOCK, (np.arange(v)[:, None] * (blocks + 1) + np.arange(blocks + 1)[None, :]).ravel()).reshape(v, blocks + 1)
        maxima = np.zeros((v, blocks))
        np.maximum.at(maxima, (t, e // BLOCK), w)
        labels = np.array([r[1] for r in rows], dtype=np.int64)
        return cls(idf, labels, np.array([r[0] for r in rows], dtype=np.int64), np.where(labels == 1, class_weights[1], class_weights[0]), e, w, bounds, maxima)

    def neighbours(self, counts: dict[int, int], k: int = K, without: int = -1) -> list[tuple[int, float]]:
        """The k examples of largest cosine above 0 with their cosines; ties by place in the index, which is by vector."""
        if not counts or not len(self.labels):
            return []
        ids = np.fromiter(counts, dtype=np.int64)
        q = np.log1p(np.fromiter(counts.values(), dtype=np.float64)) * self.idf[ids]
        norm = math.sqrt(float(q @ q))
        if not norm:
            return []
        q /= norm
        upper = q @ self.maxima[ids]
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        for b in np.argsort(-upper, kind="stable"):
            if upper[b] <= 0 or len(scores) == k and upper[b] + 1e-9 < scores[-1]:
                break
            score = np.zeros(BLOCK)
            for s, e, x in zip(self.bounds[ids, b], self.bounds[ids, b + 1], q, strict=True):
                if e > s:
                    score[self.postings[s:e] - b * BLOCK] += x * self.weights[s:e]
            new = np.flatnonzero((score > 0) & (score >= (scores[-1] if len(scores) == k else 0.0)))
            new = new[new != without - b * BLOCK]
            places, scores = np.concatenate([places, new + b * BLOCK]), np.concatenate([scores, score[new]])
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
        return list(zip(places.tolist(), scores.tolist(), strict=True))

    def remembered(self, counts: dict[int, int]) -> list[tuple[int, float]]:
        """neighbours(), kept for equal vectors; the counts are put in order, so that equal texts get equal sums."""
        key = tuple(sorted(counts.items()))
        near = self.memory.get(key)
        if near is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            near = self.memory[key] = self.neighbours(dict(key))
        return near

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Share of toxic weight among the neighbours and a clean one of similarity PRIOR, so that distant ones say less."""
        w = [s * self.weight_of[j] for j, s in near]
        prior = PRIOR * float(np.mean([self.weight_of[j] for j, _ in near]))
        return float(sum(x for x, (j, _) in zip(w, near, strict=True) if self.labels[j]) / (sum(w) + prior))

    def score(self, near: list[tuple[int, float]]) -> float:
        if not near:
            return self.bare
        z = self.curve[0] * self.vote(near) + self.curve[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def calibrate(self, rows: list[tuple[int, int, list[int], list[int]]]) -> None:
        """Fit the curve to each example's vote without itself, weighted so that labels have their share in the corpus."""
        place = {int(d): i for i, d in enumerate(self.example_ids)}
        x, y, w = [], [], []
        for d, label, ids, counts in rows:
            near = self.neighbours(dict(zip(ids, counts, strict=True)), without=place[d]) if ids else []
            if near:
                x.append(self.vote(near))
                y.append(label)
                w.append(self.weight_of[place[d]])
        a, b = 8.0, -4.0
        if x:
            xs, ws = np.array(x), np.array(w)
            pos, neg = float(ws[np.array(y) == 1].sum()), float(ws[np.array(y) == 0].sum())
            ys = np.where(np.array(y) == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
            for _ in range(50):
                p = 1 / (1 + np.exp(-(a * xs + b)))
                g = np.array([((p - ys) * xs * ws).sum() + 1e-3 * (a - 8), ((p - ys) * ws).sum() + 1e-3 * (b + 4)])
                h = ws * p * (1 - p)
                m = np.array([[(h * xs * xs).sum() + 1e-3, (h * xs).sum()], [(h * xs).sum(), h.sum() + 1e-3]])
                step = np.clip(np.linalg.solve(m, g), -2, 2)
                a, b = a - float(step[0]), b - float(step[1])
                if abs(step).max() < 1e-6:
                    break
        self.curve = (max(a, 0.0), b)


def training_labels(labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """Labelled rows outside the held-out fifth, bounded for each label; and how many there are of each."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {int(r[0]): int(r[1]) for r in known.groupBy("toxic").count().collect()}
    half = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2) for y in (0, 1)]
    return half[0].unionByName(half[1]), totals


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict[str, int], Index]:
    sample, totals = training_labels(labels, fit_rows)
    # At most fit_rows rows of two numbers, so this broadcast is bounded.
    marks = sample.select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("mark"))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("label_id"))
    texts = written(met.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("mark").alias("mark")))

    def count_terms(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, mark in rows:
            seen[mark].update(terms_of(word_counts(text)).keys())
        for t in seen[0].keys() | seen[1].keys():
            yield t, seen[0][t], seen[1][t]

    sizes = {int(r[0]): int(r[1]) for r in texts.groupBy("mark").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        index = Index.build(np.zeros(0), [], (1.0, 1.0))
        index.bare = totals.get(1, 0) / max(1, sum(totals.values()))
        return {}, index
    counts = map_rows(texts, ["text", "mark"], count_terms, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    # Terms that are merely commoner in one language or style fail the ratio.
    chosen = counts.where(F.col("n0") + F.col("n1") >= 3).withColumn("z", z).where((F.greatest(p0 / p1, p1 / p0) >= LEAST_RATIO) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "term")
    ids = vocabulary_ids([r[0] for r in chosen.select("term").collect()])
    size = sum(i >= 0 for i in ids.values())

    def vectors(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, mark in rows:
            v = vector(text, ids)
            yield doc_id, mark, list(v), list(v.values())

    examples = [tuple(r) for r in map_rows(texts, ["doc_id", "text", "mark"], vectors, "doc_id long, mark int, ids array<int>, counts array<int>").collect()]
    examples.sort(key=lambda r: r[0])
    discard(texts)

    def frequencies(rows: Iterator[tuple]) -> Iterator[tuple]:
        df: Counter = Counter()
        n = 0
        for (text,) in rows:
            n += 1
            df.update(vector(text, ids).keys())
        yield -1, n
        yield from df.items()

    df = {int(r[0]): int(r[1]) for r in map_rows(docs, ["text"], frequencies, "term int, n long").groupBy("term").agg(F.sum("n")).collect()}
    n_docs = df.pop(-1, 0)
    idf = np.array([math.log((1 + n_docs) / (1 + df.get(i, 0))) + 1 for i in range(size)])
    # A sampled row of a label stands for as many rows as were there.
    weights = tuple(totals.get(y, 0) / max(1, sizes.get(y, 0)) for y in (0, 1))
    index = Index.build(idf, examples, weights)  # type: ignore[arg-type]
    index.calibrate(examples)
    bare = [sum(weights[r[1]] for r in examples if not r[2] and r[1] == y) for y in (0, 1)]
    index.bare = (bare[1] + 0.5) / (sum(bare) + 1 + 0.5 * (sum(bare) == 0))
    return ids, index


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, evidence (nearest examples as id:label:cosine)."""
    load = shipped(docs.sparkSession, fit(docs, labels, fit_rows))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids, index = load()
        for doc_id, text in rows:
            near = index.remembered(vector(text, ids))
            score = index.score(near)
            yield doc_id, score, int(score >= 0.5), ",".join(f"{index.example_ids[j]}:{index.labels[j]}:{s:.4f}" for j, s in near[:3])

    out = map_rows(docs, ["doc_id", "text"], run, "doc_id long, score double, predicted int, evidence string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; columns stay, and no row moves to another task."""
    load = shipped(docs.sparkSession, fit(docs, labels))

    def keep():  # noqa: ANN202
        ids, index = load()
        return lambda text: index.score(index.remembered(vector(text, ids))) < threshold

    return filter_rows(docs, "text", keep)
