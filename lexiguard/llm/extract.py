"""Main text of web pages, by boosted trees over the nodes of their DOM and a decoding that agrees with itself.

What is learned. Pages carry no labels, so training pages are made whose labels
are known: texts of a bounded sample of the table's own pages are laid out anew
by layouts(), with menus, headers, notices, adverts, forms, sidebars, comments
and footers around, between and after the paragraphs of an article, now with
telling tags and classes, now without. Spark's gradient-boosted trees are fitted
to the measures of their nodes (dom.FEATURES). The sample is SAMPLE_PAGES pages
by the order of a hash of their text; all pages are then scored.

What is decided. Every node of a page is all main text, all not, or mixed, at
the least cost: a node that is not mixed decides for all that is in it, so no
choice contradicts one above or below it. The text of chosen nodes is joined in
page order.

A null or empty page has no text, nor has one without any chosen node. Tables
without texts have nothing to learn from, and nothing to extract. Repeated rows
are pages of their own with equal results; a row's other columns are kept, but
for those that have a result's name. A page is held in memory at a time, with
its tree, and so are the features of BATCH_CHARS of pages.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiguard.llm import dom
from lexiguard.llm.common import shared_dir, shipped, written

#: Pages whose texts the training pages are made of, and how many are made of each.
SAMPLE_PAGES = 300
LAYOUTS = 4
#: Longest text, in characters, that is read of a sampled page; it is the sample that is bounded, never a page to extract.
SAMPLE_CHARS = 50_000
TREES, DEPTH, STEP = 40, 5, 0.4
#: What it costs to call a node mixed; a sure wrong node costs up to 14.
MIXED = 0.7
BATCH_CHARS, BATCH_PAGES = 2_000_000, 500

# Names that made pages give to their parts. The training pages' classes are drawn from these and from words that say nothing.
NAMES = {
    "content": "content article post entry story article-body post-content entry-content main-content text prose",
    "menu": "nav menu navbar main-menu navigation top-nav breadcrumb pagination",
    "header": "header masthead topbar site-header",
    "notice": "cookie-notice consent banner gdpr alert notice popup modal",
    "advert": "ad ads advert sponsored promo advertisement ad-slot",
    "form": "newsletter subscribe login search-form signup contact-form share",
    "aside": "sidebar widget related popular recent-posts aside recommended teaser",
    "reply": "comments comment-list discussion replies responses disqus reviews",
    "footer": "footer copyright colophon site-footer legal bottom",
}
NEUTRAL = "row col wrap container inner box block section c1 x9 grid flex item panel outer holder".split()
TAG_OF = {"content": ["article", "main"], "menu": ["nav"], "header": ["header"], "notice": ["dialog", "aside"], "advert": ["aside"], "form": ["form"], "aside": ["aside"], "reply": ["section"], "footer": ["footer"]}


class Layout:
    """One made page. Parts of the main text are marked c, the others b."""

    def __init__(self, rng: random.Random, paragraphs: list[str], shorts: list[str]) -> None:
        self.rng, self.paragraphs, self.shorts = rng, paragraphs, shorts
        # Some pages have telling tags, some telling classes, most both, a few neither.
        self.tags, self.classes = rng.random() < 0.65, rng.random() < 0.65
        # Some articles are a few words long.
        self.brief = rng.random() < 0.2

    def short(self) -> str:
        return escape(self.rng.choice(self.shorts)[: self.rng.randint(4, 80)])

    def words(self, low: int, high: int) -> str:
        return escape(" ".join(self.rng.choice(self.paragraphs).split()[: self.rng.randint(low, high)]))

    def paragraph(self) -> str:
        text = self.rng.choice(self.paragraphs)
        return escape(" ".join(text.split()[: self.rng.randint(1, 14)]) if self.brief else text)

    def links(self, n: int) -> str:
        item = self.rng.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<div><a href='/x'>{}</a></div>", "<li><a href='/x'>{}</a>"])
        inner = "".join(item.format(self.words(1, 4)) for _ in range(n))
        return f"<ul>{inner}</ul>" if item.startswith("<li") else inner

    def part(self, kind: str, inner: str, mark: str) -> str:
        rng = self.rng
        tag = rng.choice(TAG_OF[kind]) if self.tags and rng.random() < 0.85 else rng.choice(["div", "div", "section"])
        names = rng.sample(NEUTRAL, rng.randrange(2))
        if self.classes and rng.random() < 0.85:
            names += rng.sample(NAMES[kind].split(), rng.choice([1, 1, 2]))
        said = f" {rng.choice(['class', 'class', 'id'])}='{' '.join(names)}'" if names else ""
        out = f"<{tag}{said}{f' {dom.MARK}={mark}' if mark else ''}>{inner}</{tag}>"
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            out = f"<div class='{rng.choice(NEUTRAL)}'>{out}</div>" if rng.random() < 0.6 else f"<div>{out}</div>"
        return out

    def block(self) -> str:
        """One block of an article."""
        x, rng = self.paragraph(), self.rng
        kind = rng.random()
        if kind < 0.62:
            return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br><p>", "<div>{}</div>"]).format(x)
        if kind < 0.7:
            return f"<p>{self.words(1, 12)}</p>"
        if kind < 0.78:
            return f"<h2>{self.words(1, 9)}</h2><p>{x}</p>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{x}</p></blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if kind < 0.97:
            return f"<figure><img src='x'><figcaption>{self.words(3, 15)}</figcaption></figure><p>{x}</p>"
        return f"<p>{self.words(4, 20)} <a href='/x'>{self.words(1, 5)}</a> {self.words(4, 40)}</p>"

    def advert(self) -> str:
        return self.part("advert", self.words(3, 25) if self.rng.random() < 0.6 else f"<a href='/x'>{self.words(2, 12)}</a>", "b")

    def form(self) -> str:
        return self.part("form", f"<label>{self.short()}</label><input name='q'><p>{self.words(2, 15)}</p>", "b")

    def aside(self) -> str:
        inner = f"<h3>{self.short()}</h3>" + (self.links(self.rng.randint(2, 8)) if self.rng.random() < 0.6 else "".join(f"<div><h4><a href='/x'>{self.words(2, 6)}</a></h4><p>{self.words(5, 40)}</p></div>" for _ in range(self.rng.randint(1, 4))))
        return self.part("aside", inner, "b")

    def replies(self) -> str:
        one = self.rng.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li><span>{}</span><div>{}</div></li>", "<div>{}: {}</div>"])
        inner = "".join(one.format(self.words(1, 2), self.words(5, 120)) for _ in range(self.rng.randint(1, 6)))
        if "<li" in one:
            inner = f"<ol>{inner}</ol>"
        # Readers' comments look like text, so what holds them always says so somehow.
        return f"<section id='{self.rng.choice(NAMES['reply'].split())}' {dom.MARK}=b><h3>{self.short()}</h3>{inner}</section>" if self.rng.random() < 0.5 else f"<div class='{self.rng.choice(NAMES['reply'].split())}' {dom.MARK}=b>{inner}</div>"

    def page(self) -> str:
        rng = self.rng
        maybe = lambda p, make: make() if rng.random() < p else ""
        blocks = [self.block() for _ in range(rng.choice([1, 1, 2, 3] if self.brief else [1, 1, 2, 3, 4, 6, 10, 16]))]
        if rng.random() < 0.75:
            blocks.insert(0, f"<h1>{self.words(1, 14)}</h1>")
        for make, p in ((self.advert, 0.2), (self.aside, 0.12), (self.form, 0.12), (self.replies, 0.12)):
            if rng.random() < p:
                blocks.insert(rng.randint(1, len(blocks)), make())
        # Some pages have no article.
        content = self.part("content", "".join(blocks), "c") if rng.random() < 0.94 else ""
        menu = lambda: self.part("menu", self.links(rng.randint(2, 9)), "b")
        head = lambda: self.part("header", f"<div>{self.short()}</div><p>{self.words(1, 8)}</p>", "b")
        notice = lambda: self.part("notice", f"<p>{self.words(5, 40)}</p>", "b")
        foot = lambda: self.part("footer", f"{rng.choice(['&copy; ', ''])}{self.words(2, 20)}{maybe(0.3, lambda: self.links(3))}", "b")
        before = [maybe(0.4, head), maybe(0.75, menu), maybe(0.25, notice), maybe(0.35, self.advert)]
        after = [maybe(0.35, self.replies), maybe(0.4, self.aside), maybe(0.2, self.form), maybe(0.2, self.advert), maybe(0.85, foot), maybe(0.1, notice)]
        rng.shuffle(before)
        if rng.random() < 0.2:
            before.append(self.aside())
        return f"<html><body>{''.join(before)}{content}{''.join(after)}</body></html>"


def materials(tree: dom.Tree) -> tuple[list[str], list[str]]:
    """Longer texts of a page, which made articles are built of, and shorter ones. What claims rights is neither, as its sign tells footers."""
    texts = [t for t in tree.text if t and "©" not in t]
    long = [t for t, share in zip(tree.text, tree.link_share, strict=True) if t.count(" ") >= 11 and share < 0.5 and "©" not in t]
    return long or texts, [t for t in texts if t.count(" ") < 11] or texts


def labelled(batch: dom.Batch) -> np.ndarray:
    """1 or 0 for nodes whose texts are all main text or all not, -1 for the others, by the marks around them."""
    marks = np.array([{"c": 1, "b": 0}.get(m, -1) for m in batch.mark])
    for level in batch.levels[1:]:
        marks[level] = np.where(marks[level] >= 0, marks[level], marks[batch.parent[level]])
    has = np.array([bool(t) for t in batch.text], float)
    some, main = batch.summed(has), batch.summed(has * (marks == 1))
    return np.where((some > 0) & (main == some), 1, np.where((some > 0) & (main == 0), 0, -1))


def made_rows(page: str, seed: int) -> Iterator[tuple[list[float], float, float]]:
    """(features, label, weight) of the nodes of the training pages made of one page's texts; the many items of a list weigh less each."""
    paragraphs, shorts = materials(dom.read_page(page))
    if not paragraphs:
        return
    rng = random.Random(seed)
    batch = dom.Batch([dom.read_page(Layout(rng, paragraphs, shorts).page()) for _ in range(LAYOUTS)])
    labels = labelled(batch)
    known = labels >= 0
    features = batch.features()[known]
    weights = np.expm1(features[:, dom.FEATURES.index("siblings")]) ** -0.5
    yield from zip(features.tolist(), labels[known].astype(float).tolist(), weights.tolist(), strict=True)


class Forest:
    """The fitted trees as arrays: for each node of each tree the measure it asks for, the threshold, and where to go."""

    def __init__(self, trees: list[list[tuple]], weights: list[float]) -> None:
        self.weights = weights
        self.trees = [tuple(np.array(c) for c in zip(*t, strict=True)) for t in trees]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for weight, (measure, threshold, left, right, value) in zip(self.weights, self.trees, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                # A leaf leads to itself.
                at = np.where(x[row, measure[at]] <= threshold[at], left[at], right[at])
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


def forest_of(model: GBTClassificationModel, path: str) -> Forest:
    """The model's trees, read from where Spark writes them; their size is bounded by TREES and DEPTH."""
    model.write().overwrite().save(path)
    spark = SparkSession.active()
    trees: dict[int, list[tuple]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect():
        leaf = r.leftChild < 0
        trees.setdefault(r.treeID, []).append((0 if leaf else r.split.featureIndex, 0.0 if leaf else r.split.leftCategoriesOrThreshold[0], r.id if leaf else r.leftChild, r.id if leaf else r.rightChild, r.prediction))
    return Forest([trees[i] for i in sorted(trees)], list(model.treeWeights))


def training_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(x, label, weight) of the nodes of training pages, made of the texts of SAMPLE_PAGES pages."""
    text = F.substring(html_col, 1, SAMPLE_CHARS)
    order = F.xxhash64(html_col)
    sample = pages.where(F.length(F.trim(html_col)) > 0).select(text.alias("page"), order.alias("seed")).orderBy("seed").limit(SAMPLE_PAGES)
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            for page, seed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = list(made_rows(page, seed))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return written(sample.repartition(8, "seed").mapInArrow(run, schema))


def fit(pages: DataFrame, html_col: str = "html") -> Forest | None:
    """Trees fitted to pages made of the texts of a sample of pages; None if these have no text."""
    spark = pages.sparkSession
    rows = training_rows(pages, html_col)
    if rows.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=1).fit(rows.select(array_to_vector("x").alias("features"), "label", "weight"))
    return forest_of(model, f"{shared_dir(spark)}/forest-{model.uid}")


def main_texts(trees: list[dom.Tree], forest: Forest) -> list[str]:
    batch = dom.Batch(trees)
    return batch.texts(batch.decoded(forest.probability(batch.features()), MIXED))


def main_text(pages: DataFrame, forest: Forest | None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with a column of their main text, empty if there is none, in place of the html."""
    rest = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]
    schema = T.StructType([*rest, T.StructField(text_col, T.StringType())])
    if forest is None:
        return pages.select(*(f.name for f in rest), F.lit("").alias(text_col))
    model = shipped(pages.sparkSession, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, trees, texts = to_arrow_schema(schema), model(), []

        def done(waiting: list[dom.Tree]) -> None:
            texts.extend(main_texts(waiting, trees))
            waiting.clear()

        for b in batches:
            for at in range(0, b.num_rows, BATCH_PAGES):
                part = b.slice(at, BATCH_PAGES)
                waiting: list[dom.Tree] = []
                size = 0
                for page in part.column(html_col).to_pylist():
                    waiting.append(dom.read_page(page))
                    size += len(page or "")
                    if size > BATCH_CHARS:
                        done(waiting)
                        size = 0
                done(waiting)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(texts, pa.string())], schema=arrow)
                texts.clear()

    return pages.select(*(f.name for f in rest), html_col).mapInArrow(run, schema)


def extract(pages: DataFrame) -> DataFrame:
    """pages with their main text, by trees fitted to a sample of them."""
    return main_text(pages, fit(pages))
