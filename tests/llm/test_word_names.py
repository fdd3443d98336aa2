"""Words of one structure have names, fingerprints and shingles of their own."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from statweave.llm import cws, jaccard, suffix
from statweave.llm.common import Words, byte_table, span_hashes

OTHER = str.maketrans("ab", "ba")


def mirrored(n):
    """A Thue-Morse word and its mirror image, which polynomial hashes modulo powers of two can't part."""
    s = "a"
    while len(s) < n:
        s += s.translate(OTHER)
    return s, s.translate(OTHER)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=2, max_size=20))
def test_names_agree_where_words_do(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([0] + [len(w) for w in words])
    h = span_hashes(data, ends[:-1], ends[1:])
    low = [w.lower() for w in words]
    assert all((h[i] == h[j]) == (low[i] == low[j]) for i in range(len(words)) for j in range(i))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_mirror_images(spark, n):
    a, b = mirrored(n)
    data = np.frombuffer((a + " " + b).encode(), np.uint8)
    names = Words(data, np.array([0, len(data)]), byte_table(np.arange(97, 123))).hashes
    assert names[0] != names[1]
    linked = {r.doc_id: r.component_id for r in jaccard.linked(docs(spark, [a, b, f"{a} {a}", f"{a} {b}"])).collect()}
    assert linked == {0: 0, 1: 1, 2: 2, 3: 3}
    raw = [x.encode() for x in (a, b)]
    s = cws.signatures(np.frombuffer(b"".join(raw), np.uint8), np.array([0, n, 2 * n]))
    assert (s[0] == s[1]).mean() < 0.2


def test_passages_and_near_copies_that_differ_in_one_such_word(spark):
    a, b = mirrored(1024)
    before, after = " ".join(f"w{i}" for i in range(25)), " ".join(f"v{i}" for i in range(25))
    texts = [f"{before} {a} {after}", f"{before} {b} {after}"]
    assert [r.n_passages for r in suffix.dedup_report(docs(spark, texts), size=400, words=51).collect()] == [0, 0]
    whole = docs(spark, [a, b, a])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, whole, "").collect()) == [0, 1]
    # The two words share windows of 400 bytes, which rightly go; windows of words don't repeat.
    assert [r.text for r in suffix.dedup(docs(spark, texts), size=2000, words=51).orderBy("doc_id").collect()] == texts


def test_draws_in_parts_are_those_at_once():
    """One very long text of distinct words among short and empty ones."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 30, n).tolist()) for n in (3, 30_000, 0, 500)] + ["a a b"] * 3
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = cws.signatures(data, offsets, 16)
    alone = [cws.signatures(np.frombuffer(r, np.uint8), np.array([0, len(r)]), 16)[0] for r in raw]
    assert all((w == a).all() for w, a in zip(whole, alone, strict=True)) and (whole[2] == 0xFFFF).all()
    words = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    words[200:260] = words[:60]
    weights, first = rng.integers(1, 5, 400), np.array([0, 7, 7, 350, 400])
    keys, bits = cws.draws(words, weights, 8)
    expected = [[bits[a + keys[a:b, d].argmin(), d] if b > a else 0xFFFF for d in range(8)] for a, b in zip(first[:-1], first[1:], strict=True)]
    for limit in (1, 16, 1 << 14):
        assert cws._least(words, weights, first, 8, limit).tolist() == expected
