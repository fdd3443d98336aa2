"""Spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statweave.llm import spelling


def distance_one(u, v):
    u, v = sorted((u, v), key=len)
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def first_difference(u, v):
    return next((i for i, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), min(len(u), len(v)))


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_a_trie_gives_its_window_and_no_pair_twice(data):
    n = data.draw(st.integers(1, 7))
    lo = data.draw(st.integers(0, n - 1))
    hi = data.draw(st.integers(lo + 1, n + 1))
    letters = data.draw(st.sampled_from(["a", "ab", "abcé", "abcdefghij"]))
    shared = data.draw(st.text(letters, min_size=lo, max_size=lo))
    rest = st.one_of(st.text(letters, min_size=n - lo, max_size=n - lo), st.text(letters, min_size=n + 1 - lo, max_size=n + 1 - lo))
    found = sorted({shared + x for x in data.draw(st.lists(rest, min_size=1, max_size=40))})
    got = [tuple(sorted(p)) for p in spelling.near_pairs(found, n, lo, hi)]
    pairs = [(i, j) for j in range(len(found)) for i in range(j) if distance_one(found[i], found[j])]
    assert sorted(got) == sorted((i, j) for i, j in pairs if min(len(found[i]), len(found[j])) == n and first_difference(found[i], found[j]) < hi)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=5, times=3, every=97, ratio=2):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= times}
    near = defaultdict(list)
    for u in n:
        for v in n:
            if abs(len(u) - len(v)) < 2 and u < v and distance_one(u, v):
                near[u].append(v)
                near[v].append(u)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in near}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id long, text string, word string, n int, key string")


def corpus(seed, words=150, docs=80):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdÉéÿ") for _ in range(rng.randint(4, 9))) for _ in range(words)]

    def bent(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + "z" + w[i + 1 :], w.upper()])

    return [(i, " ".join(bent(rng.choice(base)) for _ in range(rng.choice([3, 60, 200]))) + "-Ÿoto 日本") for i in range(docs)]


@pytest.mark.parametrize("trie", [4, 20_000])
def test_variants(spark, trie):
    docs = corpus(trie) + [(900, None), (901, ""), (None, "straße strasse strase " * 3), (7, "x" * 30_000), (8, "x" * 29_999 + " "), (9, "HELLO hello hallo " * 9), (9, "HELLO hello hallo " * 9)]
    docs += [(k, "x" * 30_000 + " " + "x" * 29_999) for k in (20, 21, 22)] + [(k, "Q" * 40_000) for k in (23, 24, 25)]
    got = spelling.variants(frame(spark, docs), every=11, trie=trie).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == plain(docs, every=11)


def test_roots_follow_many_forms(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc", "bbccc"]
    docs = [(k, " ".join([w] * 3 * 2**k)) for k, w in enumerate(words)]
    got = {r.word: r for r in spelling.variants(frame(spark, docs), every=1 << 40).collect()}
    assert {r.root for r in got.values()} == {"bbccc"} and got["aaaaa"].form == "aaaab" and got["bbccc"].form is None


def test_hot_prefixes_are_split_and_pairs_stay(spark):
    """A third of the words share all but their last characters."""
    rng = random.Random(4)
    words = {"internation" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(600)} | {"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(900)}
    docs = [(k, " ".join(sorted(words))) for k in range(3)]
    rows = frame(spark, docs)
    small, large = (Counter(tuple(r) for r in spelling.variants(rows, every=1 << 40, trie=t).collect()) for t in (40, 20_000))
    assert small == large and set(small) == plain(docs, every=1 << 40)


def test_empty(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [(1, None), (2, "ab abc x")])).collect() == []
