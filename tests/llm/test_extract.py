"""Page trees on odd and hostile markup, the decoding against all choices, the forest against Spark's, and texts of pages whose truth is known."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array

from lexiguard.llm import dom, extract


def texts(page):
    return [t for t in dom.read_page(page).text if t]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []), ("", []), (" \n ", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a <b>b</b>\n c<br>d</p>", ["a b c d"]), ("x<div>y</div>z", ["x", "y", "z"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("a<script>var t='</p>';</script>b", ["ab"]),
        ("a<script>never closed <p>b", ["a"]), ("<style>p{}</style><title>t</title>a<!-- b --><!---->c", ["ac"]), ("a<!-- never closed", ["a"]), ("1 < 2 &lt; 3 &amp;amp; &#65;&#x41;&#0065;&nbsp;b", ["1 < 2 < 3 &amp; AAA b"]),
        ("<p>a <button>no</button> b <select><option>x</select>c</p>", ["a b c"]), ("</div></p>a</li>", ["a"]), ("<p title='>'>a</p><p title=\"b>c\">d", ["a", "d"]), ("<P CLASS=x>a</P>", ["a"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("<svg><p>no</p></svg>a<div><template>no</div>b", ["a", "b"]), ("a<b", ["a"]), ("<a href=x>l</a> m <wbr>n", ["l m n"]), ("<p>a<hr>b", ["a", "b"]), ("&#" + "9" * 5000 + ";a", ["�a"]), ("<noscript><p>x</p></noscript><p>y", ["y"]),
    ],
)
def test_pages_are_read(page, want):
    assert texts(page) == want


def test_parents_come_first_and_texts_in_order():
    rng = random.Random(4)
    for _ in range(300):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<a href='x'>", "</a>", "<select>", "</select>", f"w{rng.randrange(99)} ", "<button>", "</button>"]) for _ in range(40))
        t = dom.read_page(page)
        assert all(p < i for i, p in enumerate(t.parent)) and t.parent[0] == -1
        shown = iter(re.findall(r"w\d+", page))
        assert all(w in shown for w in re.findall(r"w\d+", " ".join(t.text)))
        children = {p for p in t.parent}
        assert not any(x and i in children for i, x in enumerate(t.text))


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x", "<a \"" * 100_000 + "x", "<a b='" * 100_000, "<ul>" + "<div>" * 50_000 + "<li></li>" * 50_000 + "x", "<" * 300_000 + "x", "<!--" * 100_000, "<p>" * 200_000 + "x", "&" * 300_000, "<a " + "b " * 300_000 + ">x", "<p>" + " " * 500_000 + "x</p>", "<li><table>" * 30_000 + "x"])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    tree = dom.read_page(page)
    batch = dom.Batch([tree])
    batch.decoded(np.full(len(tree.tag), 0.4), 0.7)
    assert batch.features().shape == (len(tree.tag), len(dom.FEATURES))
    assert time.process_time() - began < 20


def test_decoding_is_the_best_of_all_choices():
    rng = np.random.default_rng(7)
    for n in [1, 2, 5, 7] * 20:
        tree = dom.Tree()
        for i in range(1, n):
            tree.node("div", int(rng.integers(0, i)))
        batch, p = dom.Batch([tree]), rng.random(n)
        best, found = None, None
        for choice in itertools.product((1, 0, -1), repeat=n):
            parents = set(tree.parent[1:])
            if any(c == -1 and i not in parents for i, c in enumerate(choice)) or any(choice[tree.parent[i]] >= 0 and choice[i] != choice[tree.parent[i]] for i in range(1, n)):
                continue
            cost = sum(0.7 if c == -1 else -np.log(p[i]) if c == 1 else -np.log1p(-p[i]) for i, c in enumerate(choice))
            if best is None or cost < best - 1e-12:
                best, found = cost, choice
        assert batch.decoded(p, 0.7).tolist() == [c == 1 for c in found]


def page_of(rng, body):
    """A page of the given table's kind, and its main text."""
    blocks = [" ".join(rng.choice(body) for _ in range(rng.choice([3, 20, 60]))) for _ in range(rng.randint(1, 7))]
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(body, 5))
    return f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><script>var t='</p>';</script></head><body><nav><ul>{menu}</ul></nav><!-- ad --><div class='ad'>{' '.join(rng.sample(body, 7))}</div><article><h1>{blocks[0]}</h1><p><b>" + "<p>".join(b.replace(" ", "&#32; \n", 1) for b in blocks) + f"</article><footer>&copy; x.example &middot; {' '.join(rng.sample(body, 6))}</footer>", "\n".join([blocks[0], *blocks])


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(12)
    body = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    pages = [page_of(rng, body) for _ in range(150)]
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    return df, [t for _, t in pages], extract.fit(df)


def test_main_texts_of_known_pages(made):
    df, want, forest = made
    got = {r.page_id: r.text for r in extract.main_text(df, forest).collect()}
    assert sum(got[i] == t for i, t in enumerate(want)) >= 0.98 * len(want)


def test_main_texts_of_layouts_not_trained_on(made):
    df, _, forest = made
    right = wrong = missed = 0
    for k, page in enumerate(df.limit(60).collect()):
        layout = extract.Layout(random.Random(f"held out {k}"), *extract.materials(dom.read_page(page.html)))
        batch = dom.Batch([dom.read_page(layout.page())])
        main, chosen = extract.labelled(batch) == 1, batch.decoded(forest.probability(batch.features()), extract.MIXED)
        size = np.array([len(t) for t in batch.text])
        right, wrong, missed = right + size[main & chosen].sum(), wrong + size[~main & chosen].sum(), missed + size[main & ~chosen].sum()
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_the_forest_is_spark_s_model(spark, made):
    rows = extract.training_rows(made[0])
    model = GBTClassifier(weightCol="weight", maxIter=5, maxDepth=4, seed=1).fit(rows.select(array_to_vector("x").alias("features"), "label", "weight"))
    forest = extract.forest_of(model, extract.shared_dir(spark) + "/forest-test")
    some = rows.limit(400).select("x", array_to_vector("x").alias("features"))
    scored = model.transform(some).select("x", vector_to_array("probability")[1].alias("p")).collect()
    assert np.allclose(forest.probability(np.array([r.x for r in scored])), [r.p for r in scored])


def test_odd_tables(spark, made):
    df, want, forest = made
    odd = spark.createDataFrame([(900, None, None, 1), (None, "u", "", 2), (901, "u", "<p>", 3), (902, "u", "<nav><a href=x>menu</a></nav>", 4)], "page_id long, url string, html string, n_chars int")
    assert [r.text for r in extract.main_text(odd, forest).collect()] == ["", "", "", ""]
    twice = extract.main_text(df.limit(1).unionAll(df.limit(1)), forest).collect()
    assert twice[0] == twice[1] and twice[0].asDict().keys() == {"page_id", "url", "text"}
    for empty in (df.limit(0), odd.limit(3)):
        assert all(r.text == "" for r in extract.extract(empty).collect())
    long = spark.createDataFrame([(1, "<article>" + "<p>some words of a long article</p>" * 30_000 + "</article>")], "page_id long, html string")
    assert extract.main_text(long, forest).first().text.count("\n") == 29_999


def test_the_query_has_the_columns_of_its_contract(spark, made, tmp_path):
    from lexiguard.llm.queries import op11_main_text

    made[0].write.parquet(f"{tmp_path}/pages.parquet")
    out = op11_main_text(spark, str(tmp_path))
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    rows = out.collect()
    assert all(r.n_chars == len(r.text) for r in rows) and sum(r.text == made[1][r.page_id] for r in rows) >= 0.98 * len(rows)
