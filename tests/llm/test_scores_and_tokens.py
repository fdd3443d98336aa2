"""Top-k search, toxicity, packing, edit counts, fingerprints, pieces and the pipeline against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from statweave.llm import cws, editcount, knn, packing, pieces, registry, toxicity
from statweave.llm.common import Words, byte_table

P = pytest.importorskip("public_tokenizers")
WORD_BPE, BYTE_BPE, PIECES = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
ALPHABET = ["the ", "  ", "   ", "a", "ing", "\n", "日本", "语", "é", "ñ", "☃", "<s>", "<0x0A>", "▁", "x y", "\t", "Σς", "-", "'s", "''", "12½", "http://www.example.com/", "e", "r", "\x00", "\x1c", "İ", "́", "Ⱥ"]
ODD = [None, "", " ", "\n", "a" * 30_000, "x " * 20_000, "日" * 3000]


def jumble(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "x", 1.5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, grp int, range string, p_toxic double")


def texts(seed=1, n=40):
    rng = random.Random(seed)
    return ODD + [jumble(rng, rng.choice([1, 5, 50, 400])) for _ in range(n)]


# Top-k search


def brute_top(rows, queries, k):
    out = []
    for q, v in queries.items():
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows.items() if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_top_k(spark, block):
    rng = np.random.default_rng(block)
    x = np.vstack([rng.normal(c, 0.1, (60, 8)) for c in rng.normal(0, 1, (4, 8))])
    x[50:90] = x[3]  # ties
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), v.astype(np.float32).tolist(), 1) for i, v in zip(ids, x, strict=True)]
    rows += [(900, None, 1), (903, [None, 1.0], 1), (906, [float("nan")] * 8, 1), (909, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), rows[0], (912, [1.0, 2.0], 1), (915, [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = knn.scaled(df)
    got = sorted(tuple(r) for r in knn.top_k(v, v.where("vec_id % 5 = 0"), 10, block).collect())
    good = {i: [int(np.floor(1024.0 * np.float64(np.float32(c)))) for c in e] for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()}
    assert got == brute_top(good, {i: w for i, w in good.items() if i % 5 == 0}, 10)
    assert knn.top_k(v.where("false"), v, 10).count() == 0


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.01, (300, 4)) for c in rng.normal(0, 50, (12, 4))])
    tree = knn.CoverTree(x)
    for k, rows in enumerate(tree.rows):
        d = np.sqrt(((x[rows] - x[tree.centre[k]]) ** 2).sum(1))
        assert d.max() <= tree.radius[k] + 1e-9
        kids = [tree.rows[c] for c in tree.children[k]]
        assert sorted(np.concatenate([tree.lone[k], *kids])) == sorted(rows)
        assert not kids or all(tree.radius[c] <= knn.SHRINK * tree.radius[k] + 1e-9 for c in tree.children[k])
    best, done = knn.dual_search(x[::10], np.arange(0, len(x), 10), x, np.arange(len(x)), 5)
    assert done < 0.6 * len(x) * len(x[::10])
    s = x[::10] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 10)] = -np.inf
    assert np.allclose(np.sort(best.scores, 1), np.sort(s, 1)[:, -5:])


def test_top_k_prunes_and_carries_scores_over_blocks(spark):
    """On clustered vectors far fewer products than all, whatever the blocks."""
    rng = np.random.default_rng(4)
    x = np.floor(np.vstack([rng.normal(c, 0.02, (400, 6)) for c in rng.normal(0, 3, (10, 6))]) * 1024)
    df = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<long>")
    queries = df.where("vec_id % 20 = 0")
    done = {b: knn.products(df, queries, 10, b, 64).agg(F.sum("done")).first()[0] for b in (500, 10_000)}
    assert max(done.values()) < 0.5 * 4000 * 200


def test_top_k_of_repeated_rows(spark):
    rows = [(1, [5, 0])] * 3 + [(2, [4, 0])] * 40 + [(3, [1, 1]), (3, [2, 2]), (100, [1, 0]), (100, [1, 0]), (100, [0, 1]), (200, [7, 7])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in knn.top_k(df, df.where("vec_id = 100"), 10, 4, 2).collect())
    products = sorted((-(v[0] * w[0] + v[1] * w[1]), i) for v in ([1, 0], [0, 1]) for i, w in rows if i != 100)
    assert got == [(100, k + 1, i, -s) for k, (s, i) in enumerate(products[:10])]


# Toxicity


def test_chain_learns_and_uses_held_out_rows(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(60)}" for _ in range(30)] + ([rng.choice(["vilestra", "vileux", "vilement"])] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = df.selectExpr("doc_id", "1 quality", "y toxic").where("doc_id < 400")
    labels = labels.union(labels.limit(3)).union(spark.createDataFrame([(401, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    models = toxicity.train(df, labels)
    assert list(models) == ["low_quality", "toxic"] and len(models["toxic"].weights) == len(models["toxic"].features) + 2
    extra = frame(spark, ["w1 VILEQUE w2", None, "", "w1 w2"])
    held = toxicity.score(df.where("doc_id >= 400"), models).collect()
    assert all((r["p_toxic"] >= models.reject) == bool(r["y"]) for r in held) and all(r["p_low_quality"] < 0.01 for r in held)
    out = {r["doc_id"]: r for r in toxicity.score(extra, models).collect()}
    assert out[0]["p_toxic"] > 0.3 > out[3]["p_toxic"] and out[1]["p_toxic"] == out[2]["p_toxic"] and out[0]["grp"] == 7
    none = toxicity.train(df, labels.where("false"))
    assert all(r["p_toxic"] < 1e-5 for r in toxicity.score(df, none).collect())
    assert toxicity.score(df.where("false"), models).count() == 0


def test_out_of_fold_probabilities_differ_from_fitted_ones(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_GAIN", 1e-9)  # so that models do follow noise
    rng = np.random.default_rng(0)
    n, width = 120, 500
    counts = np.full(n, 10)
    x = toxicity.Rows(counts, rng.integers(0, width, counts.sum()).astype(np.int32))
    y = rng.integers(0, 2, n).astype(float)  # noise: fitted probabilities would give the label away
    seen = {}
    true_fit = toxicity.fit
    try:
        toxicity.fit = lambda x, y, e: seen.setdefault((len(y), e.shape[1]), e) is None or true_fit(x, y, e)
        toxicity.train_chain(x, {"a": y, "b": y}, np.arange(n) % toxicity.FOLDS)
    finally:
        toxicity.fit = true_fit
    held_out = seen[n, 1][:, 0]
    fitted = toxicity.probabilities(true_fit(x, y, np.zeros((n, 0))), x.row, x.columns, n, np.zeros((n, 0)))
    assert abs(np.corrcoef(held_out, y)[0, 1]) < 0.3 < np.corrcoef(fitted, y)[0, 1]


def plain_features(text):
    """The presence flags of a text by the definition, with integers of 64 bits."""
    full, out = (1 << 64) - 1, set()

    def shuffle(h):
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & full
        return h ^ h >> 32

    def number(raw, salt):
        if len(raw) > 16:
            return (xxhash.xxh3_64_intdigest(raw) ^ salt) >> 64 - toxicity.BITS
        head, tail = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")
        h = shuffle(head ^ len(raw) * 0x9E3779B97F4A7C15 & full)
        return (shuffle(h * 0xC2B2AE3D27D4EB4F + tail & full) ^ salt) >> 64 - toxicity.BITS

    for word in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[A-Z]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        out.add(number(word, 0))
        out |= {number(word[:n], n * 0x9E3779B97F4A7C15 & full) for n in toxicity.PREFIXES if len(word) >= n}
    return out


def test_scores_by_a_plain_loop(spark):
    """Models are optimal for the chain's penalised loss, their inputs are held-out probabilities, and scores follow from features and weights alone."""
    rng = random.Random(6)
    make = lambda bad, junk: " ".join([*(rng.choice(["vile", "nasty", "awful"]) for _ in range(2 * bad)), *(rng.choice(["zzz", "buy", "now"]) for _ in range(3 * junk)), *(f"w{rng.randrange(30)}" for _ in range(12))])
    rows = [(k, make(k % 3 == 0, k % 2)) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0), int(k % 3 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [t for _, t in rows] + ["zz other text for a known id", "x" * 300_000, None], [k for k, _ in rows] + [3, 1000, None])
    models = toxicity.train(docs, labels)
    assert list(models) == ["low_quality", "toxic"]
    truth = {k: (int(k % 2 == 1), int(k % 3 == 0)) for k in range(240)}
    learnt = {k: min(t, "zz other text for a known id") if k == 3 else t for k, t in rows}  # the least text of a repeated id
    flags = {k: plain_features(t) for k, t in learnt.items()}
    fold = {k: (k * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % toxicity.FOLDS for k in learnt}
    odds = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))

    def z(model, found, earlier):
        weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=False))
        return sum(weight.get(f, 0.0) for f in found) + sum(w * odds(p) for w, p in zip(model.weights[len(model.features) : -1], earlier, strict=True)) + model.weights[-1]

    def refit(keys, y, earlier):
        sets = [np.array(sorted(flags[k]), np.int32) for k in keys]
        return toxicity.fit(toxicity.Rows(np.array(list(map(len, sets))), np.concatenate(sets)), np.array([float(y[k]) for k in keys]), np.array([earlier[k] for k in keys]).reshape(len(keys), -1))

    earlier = {k: [] for k in learnt}
    for c, model in enumerate(models.values()):
        y = {k: truth[k][c] for k in learnt}
        p = {k: 1 / (1 + np.exp(-z(model, flags[k], earlier[k]))) for k in learnt}
        at = [*model.features.tolist()]
        slope = [sum(p[k] - y[k] for k in learnt if f in flags[k]) + toxicity.PENALTY * w for f, w in zip(at, model.weights, strict=False)]
        slope += [sum((p[k] - y[k]) * odds(earlier[k][e]) for k in learnt) + toxicity.PENALTY * model.weights[len(at) + e] for e in range(c)]
        slope.append(sum(p[k] - y[k] for k in learnt) + 1e-4 * model.weights[-1])
        assert np.abs(slope).max() < 0.05
        held = {}
        for f in range(toxicity.FOLDS):
            other = refit([k for k in sorted(learnt) if fold[k] != f], y, earlier)
            held |= {k: 1 / (1 + np.exp(-z(other, flags[k], earlier[k]))) for k in learnt if fold[k] == f}
        earlier = {k: [*earlier[k], held[k]] for k in learnt}
    for r in toxicity.score(docs, models).collect():
        found, before = plain_features(r["text"]), []
        for model in models.values():
            before.append(1 / (1 + np.exp(-z(model, found, before))))
        assert np.allclose([r["p_low_quality"], r["p_toxic"]], before, atol=1e-9)


def test_each_category_learns_from_the_labels_that_decide_it(spark):
    rng = random.Random(9)
    rows = [(k, " ".join([*(["vile"] if k % 3 == 0 else []), *(["zzz"] if k % 2 else []), *(f"w{rng.randrange(30)}" for _ in range(9))])) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, None if k < 100 else int(k % 2 == 0), int(k % 3 == 0) if k < 150 else None) for k in range(200)]
    models = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, models).collect()
    assert all((r.p_toxic >= models.reject) == (r.doc_id % 3 == 0) for r in got) and all((r.p_low_quality > 0.5) == (r.doc_id % 2 == 1) for r in got)
    only = toxicity.train(docs, spark.createDataFrame([(k, None, t) for k, _, t in labels], "doc_id long, quality int, toxic int"))
    assert all((r.p_toxic >= only.reject) == (r.doc_id % 3 == 0) for r in toxicity.score(docs, only).collect())
    empty = toxicity.train(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(r.p_toxic < empty.reject for r in toxicity.score(docs, empty).collect())


def test_a_very_long_text_is_learnt_from_as_it_is_scored(spark):
    """More distinct words than any bound of before; the telling one has a great number."""
    rng = random.Random(2)
    filler = [" ".join(f"q{rng.randrange(10**9):x}" for _ in range(30)) for _ in range(60)]
    wide = [" ".join(f"{'abcdef'[k]}{rng.randrange(16**6):06x}" for _ in range(70_000)) for k in range(6)]
    rows = [(k, f + (f" {wide[k]} marker" if k < 6 else "")) for k, f in enumerate(filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k < 6)) for k in range(60)], "doc_id long, quality int, toxic int")
    models = toxicity.train(docs, labels)
    probe = spark.createDataFrame([(0, "marker"), (1, "other")], "doc_id long, text string")
    p = {r.doc_id: r.p_toxic for r in toxicity.score(probe, models).collect()}
    assert p[0] > p[1]


def test_the_cut_parts_held_out_rows_best():
    p, y = np.array([0.9, 0.8, 0.8, 0.3, 0.2, 0.1]), np.array([1, 1, 0, 1, 0, 0.0])
    f1 = {t: 2 * (y[p >= t]).sum() / ((p >= t).sum() + y.sum()) for t in p}
    cut = toxicity.best_cut(p, y)
    assert 2 * y[p >= cut].sum() / ((p >= cut).sum() + y.sum()) == max(f1.values()) and cut not in p
    assert toxicity.best_cut(p, y * 0) == 0.5 == toxicity.best_cut(p, y * 0 + 1)


def test_lbfgs_agrees_with_closed_form():
    a, b = np.diag([1.0, 10.0, 100.0]), np.array([1.0, 2.0, 3.0])
    w = toxicity.lbfgs(lambda w: (0.5 * w @ a @ w - b @ w, a @ w - b), np.zeros(3))
    assert np.allclose(w, np.linalg.solve(a, b), atol=1e-3)


# Packing


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    t = texts() + ["word " * 9000, "again", "again"]
    full = Tokenizer.from_file(WORD_BPE)
    want = [np.array([*full.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in t]
    rows = packing.pack(frame(spark, t), WORD_BPE, 1024, 2, group_bytes=100_000).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert sorted(by) == list(range(len(t)))
    for d, parts in by.items():
        assert sum(p["length"] for p in parts) == len(want[d]) and sorted(p["start"] for p in parts) == sorted(np.cumsum([0] + [p["length"] for p in sorted(parts, key=lambda p: p["start"])])[:-1].tolist())
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert packing.pack(frame(spark, []), WORD_BPE).count() == 0
    twice = packing.pack(frame(spark, ["a", "a", None], [1, 1, None]), WORD_BPE).collect()
    assert sorted(r["length"] for r in twice) == [1, 2, 2] and {r["doc_id"] for r in twice} == {1, None}


def test_packing_deals_equal_rows_to_all_groups(spark):
    """Null texts and repeated rows count and spread, so that no group grows with their number."""
    rows = frame(spark, [None] * 2000 + ["the same text"] * 2000, [5] * 2000 + [None] * 2000)
    got = packing.pack(rows, WORD_BPE, 64, 2, group_bytes=500).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(got) == 4000 and len(groups) > 55 and max(groups.values()) < 4 * 4000 / len(groups)


def test_packing_knows_added_tokens(spark):
    from tokenizers import Tokenizer

    full, tokens = Tokenizer.from_file(WORD_BPE), packing.WordTokens(WORD_BPE)
    t = ["a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|endoftext|>" * 300, "a <|ENDOFTEXT|> b <| endoftext |>", "é <|endoftext|>'s 日本", "<|endoftext"]
    assert tokens.encode(t[0]).tolist() == [320, 49407, 321]
    rng = random.Random(11)
    t += ["".join(rng.choice([*ALPHABET, "<|endoftext|>", "<|startoftext|>", "<|", "|>"]) for _ in range(40)) for _ in range(100)]
    for x in t:
        assert tokens.encode(x).tolist() == full.encode(x, add_special_tokens=False).ids, x
    for r in packing.pack(frame(spark, t[:6]), WORD_BPE).collect():
        ids = np.array([*full.encode(t[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_tournament_is_first_fit_decreasing(sizes):
    where, at = packing.first_fit_decreasing(np.array(sizes), 100)
    bins: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
        if b == len(bins):
            bins.append(0)
        assert (where[i], at[i]) == (b, bins[b])
        bins[b] += sizes[i]


def test_word_memory_may_overflow(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER", 50)
    tokens, rng = packing.WordTokens(WORD_BPE), random.Random(8)
    for _ in range(30):
        t = " ".join(f"q{rng.randrange(200)}" for _ in range(rng.choice([5, 30, 80])))
        assert tokens.encode(t).tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids


# Edit-aware counts


def test_edits_count_as_a_full_recount():
    tokenizer, rng = editcount.Tokenizer.of(BYTE_BPE, P.PATTERN), random.Random(6)
    for _ in range(150):
        text = jumble(rng, rng.choice([0, 1, 5, 80, 300]))
        counted = editcount.Counted(text, tokenizer)
        for _ in range(6):
            a, d, ins = rng.randint(0, len(text) + 3), rng.choice([0, 0, 1, 3, 50]), jumble(rng, rng.choice([0, 1, 4, 700 if rng.random() < 0.05 else 2]))
            counted.edit(a, d, ins)
            a = min(a, len(text))
            text = text[:a] + ins + text[a + d :]
            assert counted.text() == text and counted.n_chars == len(text)
            assert counted.n_tokens == len(tokenizer.encoding.encode_ordinary(text))
            assert [w for leaf in counted.leaves for w in leaf] == tokenizer.pattern.findall(text)


def test_edits_touch_little(spark):
    tokenizer = editcount.Tokenizer.of(BYTE_BPE, P.PATTERN)
    counted = editcount.Counted("some words of a long text. " * 4000, tokenizer)
    counted.edit(50_000, 3, "xy z")
    assert counted.cut_again < 3000
    t = texts(3)
    for r in editcount.report(frame(spark, t), BYTE_BPE, P.PATTERN).collect():
        text = t[r["doc_id"]] or ""
        new = text
        for a, d, ins in editcount.edits_of(len(text)):
            a = min(a, len(new))
            new = new[:a] + ins + new[a + d :]
        assert (r["n_tokens"], r["edited_tokens"]) == tuple(len(tokenizer.encoding.encode_ordinary(x)) for x in (text, new))
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and r["edited_chars"] == len(new)
    assert editcount.report(frame(spark, []), BYTE_BPE, P.PATTERN).count() == 0


# Fingerprints


def bag(text):
    low = text.translate({i: i + 32 for i in range(65, 91)})
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_estimate_generalised_jaccard():
    rng, near, true = random.Random(2), [], []
    for _ in range(60):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 60, 300]))]
        b = [w if rng.random() < 0.7 else f"w{rng.randrange(80)}" for w in a] * rng.choice([1, 1, 2])
        one, two = " ".join(a), " ".join(b)
        raw = [one.encode(), two.encode()]
        s = cws.signatures(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 512)
        near.append((s[0] == s[1]).mean())
        true.append(jaccard(one, two))
    assert np.abs(np.array(near) - true).max() < 0.12 and abs(np.mean(near) - np.mean(true)) < 0.02


@pytest.mark.parametrize("size", [300, 4 << 20])
def test_fingerprints(spark, monkeypatch, size):
    monkeypatch.setattr(cws, "RANGE_BYTES", size)
    rng = random.Random(9)
    t = texts(9, 60) + ["Same words here", "same WORDS here"]
    ids = rng.sample(range(10_000), len(t))
    got = {r["doc_id"]: r for r in cws.edited_pairs(frame(spark, t, ids), 1024).collect()}
    assert len(got) == len(t)
    order = sorted(ids, reverse=True)
    by = {i: x or "" for i, x in zip(ids, t, strict=True)}
    prints = defaultdict(set)
    for k, i in enumerate(order):
        text, nxt = by[i], by[order[(k + 1) % len(order)]]
        m = len(text) // 3
        edited = text[: len(text) - m] + nxt[:m]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        assert abs(got[i]["near_edited"] - jaccard(text, edited)) < 0.1 or not bag(text) or not bag(edited)
        prints[text].add(got[i]["fingerprint"])
        prints[edited].add(got[i]["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_of_odd_tables(spark):
    assert cws.edited_pairs(frame(spark, [])).count() == 0
    (one,) = cws.edited_pairs(frame(spark, ["a b c"], [5])).collect()  # its own successor
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("size", [40, 4 << 20])
def test_fingerprints_where_ids_repeat(spark, monkeypatch, size):
    """Null ids, one id in many rows and equal rows: every row has a successor, in one order of all rows."""
    monkeypatch.setattr(cws, "RANGE_BYTES", size)
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, 7, k]), rng.choice(["same text here", prose_of(rng, 5), None])) for k in range(150)]
    rows += [(None, "equal rows"), (7, "equal rows")] * 30
    got = cws.edited_pairs(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    key = {}
    for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect():
        key[r["t"]] = r["h"]
    order = sorted(((i is None, -(i or 0), key[t or ""], t or "") for i, t in rows))
    want = Counter()
    for k, (none, i, _, t) in enumerate(order):
        m, nxt = len(t) // 3, order[(k + 1) % len(order)][3]
        want[None if none else -i, len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 10}) == 1


def prose_of(rng, n):
    return " ".join(f"w{rng.randrange(50)}" for _ in range(n))


# Pieces


def test_pieces_agree_with_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    p, rng = pieces.Pieces(PIECES), random.Random(12)
    t = [x or "" for x in ODD] + [" " * 3000 + "x", "a" * 20_000, "nul \x00 \x00\x00in \x00it"] + [jumble(rng, rng.choice([1, 4, 30, 200])) for _ in range(300)]
    t += ["".join(rng.choice("etaoinshr") for _ in range(rng.choice([5, 40, 300]))) for _ in range(200)]
    want = library.encode(t)
    assert [x.tolist() for x in p.encode(t)] == want
    assert [p.decode(np.array(x)) for x in want] == library.decode(want)
    rows = {r["doc_id"]: r for r in pieces.round_trip(frame(spark, t), PIECES).collect()}
    for i, ids in enumerate(want):
        assert rows[i]["n_ids"] == len(ids) and rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and rows[i]["same"]
    assert pieces.round_trip(frame(spark, []), PIECES).count() == 0


def test_pieces_and_edits_keep_pace_with_very_long_texts():
    p = pieces.Pieces.of(PIECES)
    start = time.perf_counter()
    (ids,) = p.encode(["x" + " " * 1_000_000 + "y"])
    assert p.decode(ids) == "x" + " " * 1_000_000 + "y" and time.perf_counter() - start < 60
    tokenizer, took = editcount.Tokenizer.of(BYTE_BPE, P.PATTERN), []
    for n in (1, 8):
        c = editcount.Counted("alpha beta 12, " * (60_000 * n), tokenizer)
        start = time.perf_counter()
        c.edit(100, c.n_chars // 2, "zz")
        took.append(time.perf_counter() - start)
        assert c.n_tokens == len(tokenizer.encoding.encode_ordinary(c.text()))
    assert took[1] < 30 * took[0] + 1


def test_edit_report_of_repeated_rows(spark):
    rows = editcount.report(frame(spark, ["one two", "one two", None, "three"], [1, 1, None, None]), BYTE_BPE, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (0, 5), (1, 7), (1, 7)]


def test_pieces_forget(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 60)
    p, rng = pieces.Pieces(PIECES), random.Random(3)
    for _ in range(25):
        t = " ".join(rng.choice(["common", f"rare{rng.randrange(500)}"]) for _ in range(rng.choice([5, 40, 120])))
        assert p.decode(p.encode([t])[0]) == t
        assert p.encode([t])[0].tolist() == sum((p._slow("▁" + w) for w in t.split()), [])


def test_long_texts_of_one_character():
    p = pieces.Pieces.of(PIECES)
    for t in ("a" * 3000, "é" * 500, " " * 50, "ab" * 700):
        assert p.decode(p.encode([t])[0]) == t


def test_words_end_with_texts():
    data = np.frombuffer("ab cdABé".encode(), np.uint8)
    w = Words(data, np.array([0, 4, 4, 9]), byte_table(np.r_[65:91, 97:123, 128:256]))
    assert w.starts.tolist() == [0, 3, 4] and w.first.tolist() == [0, 2, 2, 3]
    same = Words(np.frombuffer(b"AB ab", np.uint8), np.array([0, 5]), byte_table(np.r_[65:91, 97:123])).hashes
    assert same[0] == same[1] and w.hashes[0] == same[0]


# Pipeline and registry


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, base = prose(120), prose(200)
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        rows.append((i, prose(40) + (" vilestra vileux" if bad else ""), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(200, base, "en", "s", 0), (201, base, "en", "s", 0), (202, base + " more", "en", "s", 0)]
    rows += [(300, prose(30) + " " + passage + " " + prose(30), "en", "s", 0), (301, prose(50) + " " + passage, "en", "s", 0)]
    rows += [(400, "clean token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" end", "en", "s", 0), (401, None, "en", "s", 0), (402, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    kept = {r[0] for r in rows} - {i for i in range(120) if i % 4 == 0}
    assert set(seen["toxicity"]) == kept
    assert set(seen["near_duplicates"]) == kept - {201, 202}
    cut = seen["repeated_passages"]
    assert set(cut) == kept - {201, 202} and passage not in cut[300]["text"] and cut[200]["text"] == base
    assert cut[300]["n_chars"] == len(cut[300]["text"]) < 600
    assert seen["secrets"][400]["text"] == "clean [secret]\" end" and seen["secrets"][401]["text"] in (None, "")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept - {201, 202}
    assert corpus_pipeline.ORACLE_SQL is None


CLASHING = "doc_id long, text string, n_chars int, key string, row int, p_toxic double, place long, found string, length string, start long, word string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 0, "k", 7, 0.5, 3, "f", "l", 9, "w") for i, t in rows], CLASHING)


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_on_empty_tables_and_clashing_columns(spark, tmp_path, some):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, None), (3, ""), (4, "token = 'abcdefghij0123456789' here"), (4, "token = 'abcdefghij0123456789' here"), (5, "short text")] if some else []
    clashing(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == names
    left = {(r.doc_id, r.text or "", r.row, r.key, r.p_toxic, r.place) for r in now.collect()}
    assert left == {(i, (t or "").replace("token = 'abcdefghij0123456789", "[secret]"), 7, "k", 0.5, 3) for i, t in rows}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows} and sum(r.length for r in out if r.doc_id == 1) >= 60_000 * some


def test_pipeline_cuts_passages_of_51_words(spark):
    rng = random.Random(15)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10)}" for _ in range(n))
    passage, short, signs = prose(51), prose(50), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(150))
    assert len(passage) < 160 and len(signs.encode()) == 450
    rows = [(i, f"{prose(80)} own{i}, {passage}. own{i} {prose(60)}") for i in range(6)]
    rows += [(10 + i, f"{prose(80)} own{i} {short} own{i} {prose(60)}") for i in range(6)]  # clean: no more than 50 words in common
    rows += [(20 + i, prose(100)) for i in range(20)]
    rows += [(50 + i, prose(20) + " " + signs + " " + prose(20)) for i in range(2)]  # long, of one word
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    for i, t in rows:
        if i < 6:
            assert out[i] == t.replace(passage, "")
        elif i < 50:
            assert out[i] == t
        else:
            assert signs[10:-10] not in out[i]


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "other"), (3, None)], "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(str(r[0]) for r in left.collect()) == ["1", "3", "None"]


def test_pipeline_with_repeated_and_null_ids(spark):
    one, two, three = "a b c d e f", "u v w x y z", "k l m n o p"
    rows = [(1, one), (1, two), (1, two), (2, one), (7, three), (None, three), (None, "q r s t u"), (None, "Q R S T U"), (None, "g h"), (None, None), (None, ""), (5, None), (5, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, (r["text"] or "").lower()) for r in left.collect()))
    assert got == sorted([(1, one), (1, two), (7, three), (0, "q r s t u"), (0, "g h"), (0, ""), (5, ""), (6, "")])


def test_every_query_is_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
