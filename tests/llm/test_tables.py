"""Chats, revisits, near-duplicates, lines, fingerprints and leaks on small tables, against plain versions."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiguard.llm import chat, collide, common, components, decontaminate, lines, near, warc, weighted

DOCS = "doc_id long, text string, k string, positions int, gone_id int, n string, rep string, part string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "n", "r", "p") for i, t in rows], DOCS)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}x{rng.randrange(size)}" for _ in range(n)]


def plain_words(rng, n):
    """Words without digits, which line templates would take for variables."""
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_chats_keep_maximal_ones(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"),
        (5, 0, "user", None), (5, 1, None, ""), (6, 0, "user", ""), (7, None, "user", "z"), (7, 0, "user", "a"), (8, 0, "user", "a"), (8, 0, "user", "a"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, h1 string")
    kept = {r.conv_id: r.n_turns for r in chat.collapse_and_render(df).collect()}
    assert kept == {3: 3, 5: 2, 6: 1, 7: 2, 8: 2}
    out = {r.conv_id: r.rendered for r in chat.collapse_and_render(df).collect()}
    assert out[3] == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert out[7].startswith("<|user|>\nz")
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_long_chats_are_rendered_in_segments(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    shorter = df.where("turn < 2000").withColumn("conv_id", F.lit(2).cast("long"))
    out = sorted(chat.collapse_and_render(df.unionByName(shorter)).collect(), key=lambda r: r.segment)
    assert {r.conv_id for r in out} == {1} and sum(r.n_segment_turns for r in out) == 3000
    assert re.findall(r"\n(\d+)\n", "".join(r.rendered for r in out)) == [str(i) for i in range(3000)]


def test_chats_equal_their_sql(spark, tmp_path):
    import duckdb

    rng, rows = random.Random(31), []
    for c in [*range(40), None]:
        stem = [("user", f"t{rng.randrange(3)}") for _ in range(rng.randint(1, 6))]
        rows += [(c, rng.choice([i, i * 10**9, 7, None]), r, t) for i, (r, t) in enumerate(stem)]
    rows += [(c, i, "user", t) for c in (None, 90, 91) for i, t in enumerate("xyz")]
    rows += [(100, 1_700_000_000 * (i + 1), "user", str(i)) for i in range(3)] + [(101, 5, "user", None)] * 600 + [(102, 5, None, str(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/c")
    want = duckdb.connect().sql(chat.COLLAPSE_SQL.replace("FROM conversations", f"FROM read_parquet('{tmp_path}/c/*.parquet')")).fetchall()
    got = chat.collapse_and_render(df).select("conv_id", "segment", "n_turns", "n_segment_turns", "rendered").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert [(r.segment, r.n_segment_turns) for r in got if r.conv_id == 100] == [(0, 3)]


def test_revisits_against_a_plain_search(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        revisit = rng.random() < 0.5
        tag = rng.choice(["a", "b", "W/a", None])
        rows.append((i, rng.choice(["http://www.X.org/p/", "https://x.org/p#f", "http://y.org?utm_source=q&b=1&a=2", None, ""]), rng.randrange(300), "revisit" if revisit else "response", tag, rng.choice(["m", None]), rng.choice(["d", "e", None]), {"ETag": str(i), "date": "1"} if revisit else {"Content-Length": "5", "etag": "0"}, "z"))
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>, near string")
    address = {r.record_id: r.a for r in df.select("record_id", warc.canonical_url(F.col("url")).alias("a")).collect()}
    assert set(address.values()) == {"http://x.org/p", "http://y.org?a=2&b=1", None}
    for width in (1, 17, 1000):
        got = {r.record_id: (r.status, r.response_id) for r in warc.resolve_revisits(df, width).collect()}
        for r in rows:
            if r[3] != "revisit":
                assert r[0] not in got
                continue
            earlier = [s for s in rows if s[3] == "response" and address[s[0]] is not None and address[s[0]] == address[r[0]] and (s[2], s[0]) < (r[2], r[0])]
            if not earlier:
                assert got[r[0]] == ("missing", None)
                continue
            last = max(earlier, key=lambda s: (s[2], s[0]))
            pairs = [(r[c], last[c]) for c in (4, 6, 5) if r[c] is not None and last[c] is not None]
            ok = bool(pairs) and pairs[0][0].removeprefix("W/") == pairs[0][1].removeprefix("W/")
            assert got[r[0]] == (("resolved", last[0]) if ok else ("changed", None))
    merged = [r.headers for r in warc.resolve_revisits(df, 17).where("status = 'resolved'").collect()]
    assert all(h["Content-Length"] == "5" and h["date"] == "1" for h in merged)
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_header_names_are_the_same_in_any_case(spark):
    schema = "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [(1, "http://a.b/", 1, "response", 'W/"e"', None, None, {"ETag": "old", "Date": "d0", "X-Kept": "k", "x-kept": "second"}), (2, "http://a.b/", 2, "revisit", '"e"', None, None, {"etag": "new", "date": "d1", "Content-Length": "0"}), (2, "http://a.b/", 2, "revisit", '"f"', None, None, None)]
    out = sorted(warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.status)
    assert [(r.status, r.response_id, r.headers) for r in out] == [("changed", None, {}), ("resolved", 1, {"etag": "new", "date": "d1", "X-Kept": "k"})]


def plain_groups(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed=5):
    rng, rows = random.Random(seed), []
    passage = words(rng, 90)
    for g in range(25):
        base = words(rng, rng.choice([3, 5, 12, 80, 150]))
        for _ in range(rng.choice([1, 2, 6])):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(edited).upper() if g % 5 == 0 else " ".join(edited))
    rows += [" ".join(passage + words(rng, 20)) for _ in range(20)] + ["", None, " \t", "one two", "ONE  two"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("block", "star"), [(400_000, 256), (300, 2)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block, star):
    monkeypatch.setattr(collide, "BLOCK_SIZE", block)
    monkeypatch.setattr(collide, "STAR_MEMBERS", star)
    monkeypatch.setattr(common, "HOT", 3)
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == plain_groups(rows)
    kept = near.keep_one_each(docs_of(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c)
    assert kept.columns == docs_of(spark, rows).columns


def test_only_pairs_above_the_match_threshold_are_confirmed():
    rng, seen = np.random.default_rng(2), []

    def fits(a, b):
        seen.append(int((near.signature(a) == near.signature(b)).sum()))
        return True

    bodies = [np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64)) for _ in range(6)]
    bodies += [np.unique(np.concatenate([b[: 200 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for b in bodies for k in (5, 60, 120)]
    keys = [near.signature(b).astype(np.uint64) for b in bodies]
    lists = [k | (np.arange(48, dtype=np.uint64) << np.uint64(32)) for k in keys]
    links = list(collide.joined(keys, bodies, list(range(len(bodies))), lists, 0, near.LEAST_MATCHES, fits))
    assert links and min(seen) >= near.LEAST_MATCHES and len(links) == len(seen)
    matched = {(i, j) for j in range(24) for i in range(j) if (keys[i] == keys[j]).sum() >= near.LEAST_MATCHES}
    assert set(links) <= matched and {j for _, j in links} == {j for _, j in matched}


def test_a_large_group_is_joined_in_linear_work():
    rng, calls = np.random.default_rng(3), []
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for n in (1000, 4000):
        bodies = [np.unique(np.append(base[2:], rng.integers(0, 2**63, 2, dtype=np.uint64))) for _ in range(n)]
        keys = [near.signature(b).astype(np.uint64) for b in bodies]
        lists = [k | (np.arange(48, dtype=np.uint64) << np.uint64(32)) for k in keys]
        calls.append([])
        assert len(list(collide.joined(keys, bodies, list(range(n)), lists, 0, near.LEAST_MATCHES, lambda a, b: not calls[-1].append(1)))) == n - 1
    assert len(calls[1]) < 6 * len(calls[0])


def test_near_duplicates_of_odd_tables(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (None, long), (None, None), (4, "a b c d e f"), (4, "other words are these here now")]
    got = near.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in got) == sorted(["(1, 1, True)", "(2, 1, False)", "(2, 1, False)", "(None, None, True)", "(None, None, True)", "(4, 4, True)", "(4, 4, True)"])
    assert near.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("few", [20_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x in got} and all(root[x] == x and x in (7,) or x in got for x in root if any(a != b and x in (a, b) for a, b in edges))


def test_recurring_lines_go_and_copies_stay(spark):
    rng = random.Random(2)
    passage, footer = " ".join(plain_words(rng, 60)), "Posted by user {} today"
    rows = [(i, "\n".join([" ".join(plain_words(rng, 40)), passage, "", " ".join(plain_words(rng, 30)), footer.format(i)])) for i in range(6)]
    copy = "\n".join(" ".join(plain_words(rng, 30)) for _ in range(4))
    rows += [(10 + i, copy) for i in range(5)] + [(20, None), (21, ""), (22, "\n \n"), (23, "7 8"), (24, "7 8"), (25, "single line")]
    df = docs_of(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    out = {r.doc_id: r for r in lines.drop_recurring_lines(df).collect()}
    for i in range(6):
        assert passage not in out[i].text and "Posted" not in out[i].text and (out[i].n_lines, out[i].n_dropped) == (4, 2)
        assert out[i].n_chars == len(out[i].text) and len(out[i].text.split("\n")) == 3
    for i, t in rows[6:]:
        assert out[i].text == t and out[i].n_dropped == 0
    assert lines.without_recurring_lines(df).columns == df.columns
    assert lines.drop_recurring_lines(df.limit(0)).count() == 0


def test_edited_lines_share_a_template(spark):
    rng = random.Random(4)
    base = plain_words(rng, 30)
    rows = []
    for i in range(8):
        edited = list(base)
        edited[10 + i] = f"changed{'abcdefgh'[i]}"
        rows.append((i, " ".join(plain_words(rng, 50)) + "\n" + " ".join(edited)))
    assert all(r.n_dropped == 1 for r in lines.drop_recurring_lines(docs_of(spark, rows)).collect())


def test_fingerprints_estimate_similarity(spark):
    rng = random.Random(6)
    base = words(rng, 120) * 2
    texts = [" ".join(base)] + [" ".join(base[: 240 - 20 * i] + words(rng, 20 * i)) for i in range(1, 12)] + [" ".join(base), "", None, "one", "one one one one", "x" * 100_000]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in weighted.fingerprints(docs_of(spark, rows)).collect()}

    def terms(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return Counter(zip(w, [*w[1:], None], strict=False))

    def alike(a, b):
        k = a.keys() | b.keys()
        return sum(min(a[x], b[x]) for x in k) / sum(max(a[x], b[x]) for x in k) if k else 1.0

    errors = []
    for i, t in rows:
        t, following = t or "", (rows[i - 1][1] or "")
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        import hashlib

        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(t)
        errors += [out[i].near_edited - alike(terms(t), terms(edited)), out[i].near_next - alike(terms(t), terms(following))]
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.05
    assert out[0].fingerprint == out[12].fingerprint and out[13].fingerprint == out[14].fingerprint == ""
    one = weighted.fingerprints(docs_of(spark, [(7, "a b c")])).first()
    assert one.near_next == 1.0
    assert weighted.fingerprints(docs_of(spark, []).limit(0)).count() == 0
    assert weighted.fingerprints(docs_of(spark, [(None, "a"), (3, "b"), (3, "b"), (3, "c")])).count() == 4


@pytest.mark.parametrize("ids", [list(range(900)), [5] * 500 + [10**15] + list(range(-200, 199)), [None] * 400 + [7] * 300 + [9_223_372_036_854_775_807, -9_223_372_036_854_775_807] * 100])
def test_following_documents_in_any_spread_of_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 8)
    rng = random.Random(17)
    rows = [(i, f"t{rng.randrange(10**9)}") for i in ids]
    rng.shuffle(rows)
    placed = weighted._with_next(docs_of(spark, rows)).collect()
    hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.shiftrightunsigned(F.xxhash64("t"), 1).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    following = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    assert {(r.doc_id, r.t): r.next_t for r in placed} == following
    by_place = {(r.part, r.at): r.t for r in placed}
    assert all(by_place[r.next_part, r.next_at] == r.next_t for r in placed)
    assert max(Counter(r.part for r in placed).values()) <= 120


def plain_leaks(rows, items, threshold=0.8):
    """The best window of each document and item by looking at all of them, with shingles as strings."""
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = lambda w: Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    known = {(i, t): cut(t) for i, t in items if t is not None and cut(t)}
    n, df = len(known), Counter(x for w in known.values() for x in set(shingles(w)))
    want = {}
    for d, t in rows:
        w = cut(t)
        for (item_id, _), iw in known.items():
            a, size = shingles(iw), min(len(iw), len(w))
            for start in range(len(w) - size + 1) if w else ():
                b = shingles(w[start : start + size])
                weight = {x: math.log((1 + n) / (1 + (df[x] if x in a else 0))) + 1 for x in a | b}
                s = sum(weight[x] * min(a[x], b[x]) for x in weight) / sum(weight[x] * max(a[x], b[x]) for x in weight)
                if s >= threshold and round(s, 9) > want.get((d, item_id), (0, 0))[1]:
                    want[d, item_id] = (start, round(s, 9))
    return want


def leak_tables(rng):
    items = [(i, " ".join(words(rng, rng.choice([3, 15, 40, 60])))) for i in range(12)] + [(98, None), (99, "")]
    texts = []
    for i in range(60):
        host, item = words(rng, rng.choice([10, 200])), items[i % 12][1].split()
        if i % 3 == 0 and len(item) > 20:
            item[rng.choice([0, 1, -1])] = "changed"
        texts.append(" ".join(host[:5] + (item if i % 4 else []) + host[5:]))
    return [*enumerate(texts), (100, None), (101, ""), (102, items[3][1]), (103, items[3][1].upper())], items


def leaks(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.first_word, round(r.similarity, 9)) for r in decontaminate.find_leaks(docs_of(spark, rows), bench).collect()}


@pytest.mark.parametrize(("part_bytes", "stretch"), [(8_000_000, 4096), (150, 7)])
def test_leaks_against_all_windows(spark, monkeypatch, part_bytes, stretch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    rows, items = leak_tables(random.Random(8))
    want = plain_leaks(rows, items)
    assert leaks(spark, rows, items) == want and len(want) > 30
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    clean = decontaminate.drop_leaks(docs_of(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want} and clean.columns == docs_of(spark, rows).columns


def test_leaks_of_odd_tables(spark):
    rng = random.Random(18)
    item, template = words(rng, 40), words(rng, 30)
    items = [(1, " ".join(item))] + [(10 + i, " ".join(template + words(rng, 12))) for i in range(6)]
    long = words(rng, 30_000)
    rows = [(1, " ".join(long[:20_000] + item + long[20_000:])), (2, " ".join(item)), (2, " ".join(item)), (3, None), (4, " ".join(item[:10])), (5, "\t\n".join(item * 3))]
    got = leaks(spark, rows, items)
    assert got == {(1, 1): (20_000, 1.0), (2, 1): (0, 1.0), (5, 1): (0, 1.0)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.find_leaks(docs_of(spark, rows), bench).count() == 4
    assert decontaminate.find_leaks(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs_of(spark, rows).limit(0), bench).count() == 0


def test_the_radius_loses_hardly_any_window(spark):
    rng, far, n = random.Random(28), 0, 0
    for _ in range(1500):
        item = words(rng, rng.choice([15, 30, 60]), 40)
        window = list(item)
        for _ in range(rng.choice([1, 1, 2])):
            window[rng.choice([0, 1, -1, -2, rng.randrange(len(item))])] = f"e{rng.randrange(99)}"
        shift = rng.choice([0, 1, 2])
        window = words(rng, shift) + window[: len(item) - shift]
        a, b = Counter(decontaminate.shingles_of([w.encode() for w in item])), Counter(decontaminate.shingles_of([w.encode() for w in window]))
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            prints = [int(decontaminate.pack(sum(decontaminate.word_bits(w.encode()) for w in t)[None, :])[0]) for t in (item, window)]
            n, far = n + 1, far + ((prints[0] ^ prints[1]).bit_count() > decontaminate.RADIUS)
    assert n > 400 and far <= 0.005 * n


def test_near_blocks_find_all_fingerprints_in_the_radius():
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"a{x}" for x in rng.integers(0, 50, 20))) for i in range(30)]
    counts = Counter(x for _, t in rows for x in set(decontaminate.shingles_of(decontaminate.words_of(t))))
    matcher = decontaminate.Matcher(decontaminate.Items(rows, counts, len(rows)), decontaminate.RADIUS, 0.8)
    prints = np.array([int(p) ^ sum(1 << int(b) for b in rng.choice(64, int(n), replace=False)) for p in matcher.items.prints for n in rng.integers(0, 22, 20)], dtype=np.uint64)
    want = {(a, i, d) for a, p in enumerate(prints) for i, q in enumerate(matcher.items.prints) if (d := (int(p) ^ int(q)).bit_count()) <= decontaminate.RADIUS}
    assert set(matcher.near(prints, 20)) == want and len(want) > 300


def n_dropped(spark, rows):
    return {r.doc_id: r.n_dropped for r in lines.drop_recurring_lines(docs_of(spark, rows)).collect()}


def test_a_group_of_copies_has_one_vote(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(plain_words(rng, n))
    passage, licence, notice = text(60), text(60), text(300)
    paired = [t for t in (text(45) + "\n" + passage for _ in range(3)) for _ in range(2)]
    crowd = [licence + "\n" + text(40)] * 30 + [licence + "\n" + text(40) for _ in range(2)]
    mostly = [notice + "\n" + text(20) for _ in range(4)]
    near_copies = [text(30) + "\n" + text(30) + "\n" + text(30)] * 2
    near_copies += [near_copies[0] + " end", "start " + near_copies[0]]
    rows = list(enumerate(paired + crowd + mostly + near_copies))
    assert list(n_dropped(spark, rows).values()).count(1) == len(rows) - 4
    assert all(n_dropped(spark, rows)[i] == 0 for i, t in rows if t in near_copies)


def test_overlap_with_many_documents_makes_no_copy(spark):
    rng = random.Random(13)
    passage, pool = " ".join(plain_words(rng, 60)), [plain_words(rng, 60) for _ in range(3)]
    stitched = [" ".join(w for j in range(3) for w in pool[(i + j) % 3][20 * i : 20 * i + 20]) for i in range(3)]
    rows = [(i, stitched[i] + "\n" + passage) for i in range(3)] + [(10 + i, " ".join(w)) for i, w in enumerate(pool)]
    assert n_dropped(spark, rows) == {0: 1, 1: 1, 2: 1, 10: 0, 11: 0, 12: 0}


def test_pages_of_nothing_but_recurring_lines_lose_them(spark):
    rng = random.Random(12)
    parts = [" ".join(plain_words(rng, 40)) for _ in range(6)]
    rows = [(i, "\n".join([parts[i], parts[(i + 1) % 6], parts[(i + 3) % 6]])) for i in range(6)] + [(10, parts[0])]
    assert n_dropped(spark, rows) == {i: 3 for i in range(6)} | {10: 1}
    assert lines.without_recurring_lines(docs_of(spark, rows)).count() == 0


def plain_lines(rows, min_docs=3):
    """Kept lines of each document by direct reading of the rules, for documents without dominant passages."""
    texts = {i: (t or "").split("\n") for i, t in rows}
    mask = lambda x: ["<*>" if re.search("[0-9@]", w) else w for w in x.split()]
    lines = {(i, p): mask(x) for i, t in texts.items() for p, x in enumerate(t) if x.strip()}
    lines = {at: tuple(w) if set(w) != {"<*>"} else ("bare", *texts[at[0]][at[1]].split()) for at, w in lines.items()}
    forms = sorted(set(lines.values()))
    root = {f: f for f in forms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in forms:
        for b in forms:
            if a < b and len(a) == len(b) and a[:3] == b[:3] and "bare" not in (a[0], b[0]):
                same = [x for x, y in zip(a, b, strict=True) if x == y]
                if len(same) >= 0.7 * len(a) and sum(x != "<*>" for x in same) >= 0.5 * len(a):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    groups = {i: c for i, (_, c) in plain_groups(rows).items()}
    shape: dict = {}
    for (i, _), w in lines.items():
        shape.setdefault(i, []).append(find(w))
    docs_of_template: dict = {}
    for i, f in shape.items():
        for x in f:
            docs_of_template.setdefault(x, set()).add(i)
    first: dict = {}
    for i in sorted(shape):
        if any(len(docs_of_template[x]) >= min_docs for x in shape[i]):
            form = tuple(sorted(shape[i]))
            groups = {k: (first.setdefault(form, groups[i]) if g == groups[i] else g) for k, g in groups.items()}
    drop = {x for x, d in docs_of_template.items() if len({groups[i] for i in d}) >= min_docs}
    return {i: [x for p, x in enumerate(t) if (i, p) not in lines or find(lines[i, p]) not in drop] for i, t in texts.items()}


@pytest.mark.parametrize(("block", "star"), [(400_000, 256), (60, 2)])
def test_lines_against_a_plain_reading(spark, monkeypatch, block, star):
    monkeypatch.setattr(collide, "BLOCK_SIZE", block)
    monkeypatch.setattr(collide, "STAR_MEMBERS", star)
    monkeypatch.setattr(common, "HOT", 3)
    rng = random.Random(21)
    bases = [plain_words(rng, rng.choice([1, 2, 4, 6, 9, 14])) for _ in range(14)]

    def line():
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice([f"v{rng.randrange(99)}", "".join(rng.choice("xyz") for _ in range(4))])
        return "  ".join(w) if rng.random() < 0.1 else " ".join(w)

    rows = []
    for i in range(60):
        own = [" ".join(plain_words(rng, 30)) for _ in range(3)]
        text = own + [line() for _ in range(rng.choice([0, 1, 3]))] + [rng.choice(["", " ", "7 8", "9"])]
        rng.shuffle(text)
        rows.append((i, "\n".join(text)))
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200, None), (201, ""), (202, "\n".join("12 words and more" for _ in range(3000)))]
    want = plain_lines(rows)
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert {i: (t or "").split("\n") for i, t in got.items()} == {i: x or [""] for i, x in want.items()}
    assert sum(len(x) < len((t or "").split("\n")) for (_, t), x in zip(rows, want.values(), strict=True)) > 15


def test_a_document_of_very_many_lines(spark):
    rng = random.Random(22)
    shared = [" ".join(plain_words(rng, 8)) for _ in range(400)]
    long = "\n".join(x for i in range(20_000) for x in ([shared[i % 400]] if i % 2 else [f"{i} own"]))
    rows = [(1, long), (1, long)] + [(2 + i, "\n".join([*shared[40 * i : 40 * i + 40], " ".join(plain_words(rng, 60))])) for i in range(10)] * 1
    rows += [(20 + i, "\n".join([*shared[40 * i : 40 * i + 40], " ".join(plain_words(rng, 70))])) for i in range(10)]
    out = {r.doc_id: r for r in lines.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert out[1].n_dropped == 10_000 and out[2].n_dropped == 20 and len(out[1].text.split("\n")) == 10_000


def test_lines_of_a_leaf_do_not_all_meet():
    rng = random.Random(23)
    leaf = [["this", "page", "was", *plain_words(rng, 17)] for _ in range(300)]
    edited = [list(w) for w in leaf]
    for w in edited:
        for at in rng.sample(range(3, 20), 6):
            w[at] = "changed"
    text = "\n".join(" ".join(w) for w in leaf + edited).encode()
    keys = [set(r[3]) for r in lines._parts(iter([(text, list(range(600)), [5] * 600, list(range(600)))]))]
    assert all(keys[i] & keys[300 + i] for i in range(300))
    listed = {}
    for i, own in enumerate(keys):
        for k in own:
            listed.setdefault(k, []).append(i)
    assert max(map(len, listed.values())) < 100
    short = b"a b c d\na b c e"
    first, second = (set(r[3]) for r in lines._parts(iter([(short, [0, 1], [5, 5], [0, 1])])))
    assert first & second


def test_words_are_hashed_as_they_are_split_and_not_kept():
    rng = random.Random(5)
    words = ["a", "b" * 8, "b" * 9, "c" * 32, "c" * 33, "c" * 33 + "d", "\u00e9t\u00e9", "x\u00a0y", *(f"w{rng.random()}" for _ in range(300))]
    text = "".join(rng.choice(words) + rng.choice([" ", "\t", "\r\n", "  ", "\v\f"]) for _ in range(3000))
    for t in (text, " " + text.strip(), text.strip(), "one", "", " \n"):
        split = t.encode().split()
        hashed = near._word_hashes(t.encode()).tolist()
        assert len(hashed) == len(split) and len(set(hashed)) == len(set(split)) == len(set(zip(hashed, split, strict=True)))
    rows = ((i, " ".join(f"t{i}x{k}" for k in range(5000))) for i in range(60))
    tracemalloc.start()
    assert sum(r[1] for r in near._sets(rows)) == 60 * 4996
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000


def test_few_edges_are_joined_without_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "written", lambda df: tables.append(common.written(df)) or tables[-1])
    edges = [(i, i + 1) for i in range(400)] + [(i, 1000 + i) for i in range(400)] + [(5000, 6000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {x: 5000 if x >= 5000 else 0 for e in edges for x in e} and len(tables) <= 2
    # What a task hands on early joins the same nodes.
    parts = list(components._forest(iter(edges), 50))
    assert dict(components._whole(iter(parts))) == got and len(parts) <= len(edges)


def test_rows_that_meet_nothing_are_sifted_out(spark):
    rows = spark.range(-5000, 20_000).selectExpr("id AS k", "cast(id AS string) AS text").unionByName(spark.createDataFrame([(None, "null")], "k long, text string"))
    wanted = spark.range(-5000, 20_000).where("id % 100 = 0").selectExpr("id AS rep")
    got = common.sifted(rows, "k", wanted, "rep")
    ids = {r.k for r in got.collect()}
    assert got.columns == rows.columns and ids >= {x for x in range(-5000, 20_000) if x % 100 == 0} and len(ids) < 300
    assert common.sifted(rows, "k", wanted.limit(0), "rep").count() == 0
