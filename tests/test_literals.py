"""What patterns require, against matches themselves, and what many patterns cost."""

import random
import re
import time

import pytest

from lexiguard.functions.literals import Prefilter, required
from lexiguard.operators.detect import Entry, Lexicon, Scanner


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abc", {"abc"}), ("th[a-e]nd", {f"th{c}nd" for c in "abcde"}), ("[0-9]{3,4}-[0-9]{4}", {"-"}), ("a|bc", {"a", "bc"}), ("(foo|bar)+x", {"foo", "bar"}), ("a*", None), ("(a|b*)", None), (".+", None), ("x?yz", {"yz"}),
        ("^ab$", {"ab"}), ("(?i)WORD", {"word"}), ("(?i)skin", {"n"}), ("(?i:ab)cd", {"abcd"}), ("a(?=bcd)e", {"a", "e"}), ("ab(?:cd|ce)f", {"abcdf", "abcef"}), ("a{2,3}b", {"a", "b"}), ("[^a]bc", {"bc"}), (r"\bfoo\s+barbaz", {"barbaz"}),
    ],
)
def test_required_texts(pattern, want):
    texts = required(pattern)[0]
    assert (texts in ({"a"}, {"e"}) if pattern == "a(?=bcd)e" else texts in ({"a"}, {"b"}) if pattern == "a{2,3}b" else texts == want)


def random_pattern(rng, depth=0):
    def atom():
        x = rng.random()
        if x < 0.5 or depth > 2:
            return rng.choice(["a", "b", "ab", "K", "s", "é", "한", "ſ", "i", r"\.", "x"])
        if x < 0.6:
            return rng.choice(["[ab]", "[a-c]", "[^a]", r"\d", ".", r"\w"])
        if x < 0.75:
            return "(" + random_pattern(rng, depth + 1) + ")"
        if x < 0.85:
            return "(?:" + random_pattern(rng, depth + 1) + "|" + random_pattern(rng, depth + 1) + ")"
        if x < 0.9:
            return rng.choice(["(?=a)", r"\b", "(?!b)", "(?<=a)"])
        return "(?i:" + random_pattern(rng, depth + 1) + ")"

    return "".join(atom() + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,2}"]) for _ in range(rng.randint(1, 3)))


def test_no_match_is_missed():
    rng = random.Random(8)
    patterns = []
    while len(patterns) < 1500:
        p = rng.choice(["", "", "(?i)"]) + random_pattern(rng)
        try:
            re.compile(p)
        except re.error:
            continue
        patterns.append(p)
    compiled, filtered = [re.compile(p) for p in patterns], Prefilter(patterns)
    for _ in range(60):
        text = "".join(rng.choice("aabbABkKsSiIİıſKéÉ한x. 1") for _ in range(rng.randrange(30)))
        hit = {i for i, p in enumerate(compiled) if p.search(text)}
        assert hit <= set(filtered.candidates(text))


def test_scans_find_what_every_pattern_finds():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    patterns = [w + "[a-z]{1,2}" for w in words] + ["[0-9]+", "(?i)" + words[0], "z|" + words[1]]
    lexicon = Lexicon(tuple(Entry(i, f"p{i}", (), term_kind="pattern", pattern=p) for i, p in enumerate(patterns)))
    scanner = Scanner(lexicon, False, True)
    for _ in range(30):
        text = "".join(rng.choice([*words, "7", " ", "z"]) for _ in range(60))
        scanner.clear()
        scanner.scan(text)
        assert [(r[0], r[3], r[4]) for r in scanner.rows] == [(i, *m.span()) for i, p in enumerate(patterns) for m in re.finditer(p, text)]


def test_many_patterns_cost_little_more_than_few():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(4000)]
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)) for _ in range(60)]

    def seconds(n):
        scanner = Scanner(Lexicon(tuple(Entry(i, w, (), term_kind="pattern", pattern=w + "[a-z]+") for i, w in enumerate(words[:n]))), False, True)
        began = time.process_time()
        for t in texts:
            scanner.scan(t)
        return time.process_time() - began

    few, many = min(seconds(40) for _ in range(3)), min(seconds(4000) for _ in range(3))
    assert many < 5 * few + 0.1
