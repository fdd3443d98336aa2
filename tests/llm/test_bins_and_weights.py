"""Vector best-fit and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statweave.llm import bestfit, importance, registry

P = pytest.importorskip("public_tokenizers")
WORD_BPE = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, grp int, length string, weight double"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "x", 1.5) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "Of", "data", "naïve", "日本", "x1", "é", "Zebra", "a"]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 300, 900]))) for _ in range(n)]


# Vector best-fit


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.integers(40, 60), st.one_of(st.none(), st.integers(1, 6)), st.one_of(st.none(), st.integers(1600, 3000)), st.sampled_from(bestfit.RULES))
def test_every_constraint_holds(lengths, tokens, documents, attention, rule):
    capacity = bestfit.Capacity(tokens, documents, attention)
    x = np.array(lengths, np.int64)
    bins, at = bestfit.vector_best_fit(x, capacity, (1.0, 0.5, 0.5), rule)
    limits = capacity.limits()
    for b in set(bins.tolist()):
        own = x[bins == b]
        assert own.sum() <= limits[0] and len(own) <= limits[1] and (own**2).sum() <= limits[2]
        order = np.argsort(at[bins == b])
        assert (at[bins == b][order] == np.append(0, np.cumsum(own[order])[:-1])).all()  # gapless from 0
    if len(x):
        assert set(bins.tolist()) == set(range(int(bins.max()) + 1))


def plain_best_fit(lengths, capacity, weights, rule):
    """The rule as written, over all bins ever opened."""
    limits, bins, out = capacity.limits(), [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        item = [lengths[i], 1, lengths[i] ** 2]
        best = None
        for b, room in enumerate(bins):
            if all(r >= x for r, x in zip(room, item, strict=True)):
                if rule == "norm":
                    value = sum(w * ((r - x) / c) ** 2 for w, r, x, c in zip(weights, room, item, limits, strict=True))
                else:
                    value = -sum(w * r * x / c**2 for w, r, x, c in zip(weights, room, item, limits, strict=True))
                if best is None or value < best[0] - 1e-12:
                    best = value, b
        if best is None:
            bins.append(list(limits))
            best = 0, len(bins) - 1
        bins[best[1]] = [r - x for r, x in zip(bins[best[1]], item, strict=True)]
        out[i] = best[1]
    return out


@pytest.mark.parametrize("rule", bestfit.RULES)
def test_the_preferred_bin_is_taken(rule):
    rng = random.Random(3)
    for _ in range(20):
        lengths = [rng.randint(1, 64) for _ in range(300)]
        capacity = bestfit.Capacity(64, rng.choice([None, 5]), rng.choice([None, 4096]))
        got = bestfit.vector_best_fit(np.array(lengths), capacity, (1.0, 0.25, 0.5), rule)[0]
        assert got.tolist() == plain_best_fit(lengths, capacity, (1.0, 0.25, 0.5), rule)


def test_wrong_rules_and_capacities():
    with pytest.raises(ValueError):
        bestfit.vector_best_fit(np.array([1]), bestfit.Capacity(8), rule="worst")
    with pytest.raises(ValueError):
        bestfit.Capacity(0).piece()
    assert bestfit.Capacity(100, attention=50).piece() == 7


@pytest.mark.parametrize("group_bytes", [1 << 12, 1 << 25])
def test_packed_documents(spark, group_bytes):
    docs = texts(5, 60) + [None, "", "the " * 9000, "a" * 20_000, "the data", "the data", " \n"]
    ids = [*range(len(docs) - 2), None, 3]
    df = frame(spark, docs, ids)
    rows = bestfit.pack(df, WORD_BPE, bestfit.Capacity(512), end_id=1, group_bytes=group_bytes, group_pieces=20).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    expected = Counter()
    for i, t in zip(ids, docs, strict=True):
        own = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(own), 512):
            expected[(i, k // 512, k, min(512, len(own) - k), zlib.crc32(own[k : k + 512].tobytes()), len(own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 512
    least = -(-sum(r.length for r in rows) // 512)
    assert len(bins) <= least + (2 if group_bytes > 1 << 20 else least // 10)


def test_packing_an_empty_table(spark):
    assert bestfit.pack(frame(spark, []), WORD_BPE, bestfit.Capacity(4096)).collect() == []


def test_document_and_attention_limits_hold(spark):
    rows = bestfit.pack(frame(spark, texts(6, 50)), WORD_BPE, bestfit.Capacity(400, 3, 90_000), group_bytes=1 << 14).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(b) <= 400 and len(b) <= 3 and sum(x * x for x in b) <= 90_000 for b in bins.values())


# Importance resampling


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=30))
def test_crcs_of_words(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([0] + [len(w) for w in words])
    assert importance.word_crcs(data, ends[:-1], ends[1:]).tolist() == [zlib.crc32(w) for w in words]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text("abé", min_size=1, max_size=40), max_size=12), max_size=6), st.integers(1, 5))
def test_crcs_of_grams_without_strings(docs, width):
    words = [w.encode() for d in docs for w in d]
    crcs = np.array([zlib.crc32(w) for w in words], np.uint32)
    first = np.cumsum([0] + [len(d) for d in docs])
    found = list(importance.gram_crcs(crcs, np.array([len(w) for w in words], np.int64), first, width))
    for n, (grams, at) in enumerate(found, 1):
        expected = [[zlib.crc32(" ".join(d[i : i + n]).encode()) for i in range(len(d) - n + 1)] for d in docs]
        assert [grams[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == expected


def test_shift_of_a_very_long_string():
    a, n = b"head", 3_000_017
    got = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b"z" * n))
    assert int(got) == zlib.crc32(a + b"z" * n)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_resample(docs, target, width, buckets, least, percent, seed):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = WORD.findall((text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, width + 1) for i in range(len(words) - n + 1)]

    bags, s, t = [(i, *features(x)) for i, x in docs], Counter(), Counter()
    for _, _, f in bags:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, n, f in bags:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = len(fit) * percent // 100
    out = [(r[0], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(fit)]
    return Counter(out + [(r[0], *r[2:], None) for r in rows if r[1] < least])


@pytest.mark.parametrize(("width", "buckets"), [(1, 10_000), (1, 7), (3, 1000)])
def test_resample(spark, width, buckets):
    docs = texts(8, 80) + [None, "", "Z" * 70_000, "the data " * 20_000, "of " * 25, "of " * 25, "of " * 25]
    ids = [*range(84), 3, 3, None]
    target = ["the data of the zebra", None, "DATA data", ""]
    got = importance.resample(frame(spark, docs, ids), spark.createDataFrame([(t,) for t in target], "text string"), width, buckets, 20, 30).collect()
    assert Counter(tuple(r) for r in got) == plain_resample(list(zip(ids, docs, strict=True)), target, width, buckets, 20, 30, 2024)


def test_resample_draws_what_is_like_the_target(spark):
    rng = random.Random(1)
    docs = [" ".join(rng.choice(["wine", "vine", "grape"] if k % 5 == 0 else ["steel", "iron", "ore"]) for _ in range(30)) for k in range(400)]
    got = importance.resample(frame(spark, docs), spark.createDataFrame([("wine grape",), ("vine",)], "text string"), percent=20)
    drawn = [r.doc_id for r in got.where("rank is not null").collect()]
    assert len(drawn) == 80 and all(i % 5 == 0 for i in drawn)


def test_resample_of_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), target).collect() == []
    rows = importance.resample(frame(spark, ["one two", None]), target, least_words=1, percent=100).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in rows if r.rank) == [(0, 2, 1)]
    with pytest.raises(ValueError):
        importance.resample(target, target, percent=101)


def test_registered():
    assert {"op11_vector_best_fit", "op13_importance_resampling"} <= set(registry.queries())
