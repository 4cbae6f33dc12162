import math
import zlib
from collections import Counter

import numpy as np

from talentloom.llm import lm_scoring as L


def tokens(text):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split() + [None]


def test_base_scores_match_brute_force(spark, sf, corpus):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    count = Counter(w for i, t in corpus if fold(i) != 1 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in corpus:
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want.append((i, fold(i) == 1, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(base, 6)))
    rows = L.op9_lm_scoring(spark, sf).collect()
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(-1e9 < r["score"] < 0 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert not held or sum(r["score"] for r in held) > sum(r["base_score"] for r in held) - 0.05 * sum(r["n_tokens"] for r in held)


def grams(text, order):
    """(n-gram, its context) by order and token, in plain Python; texts start with start marks."""
    words = tokens(text)
    padded = ["<s>"] * (order - 1) + words
    for i in range(len(words)):
        yield [(tuple(padded[i + order - k : i + order]), tuple(padded[i + order - k : i + order - 1])) for k in range(1, order + 1)]


def brute_scores(rows, fold, order):
    """The whole model in plain Python: counts of kept and all texts, EM over quantised events, mixture."""

    def counts(keep):
        c, ctx = Counter(), Counter()
        for i, t in rows:
            if keep(fold(i)):
                for token in grams(t, order):
                    for g, h in token:
                        c[g] += 1
                        ctx[h] += 1
        return c, ctx

    def view(model, token):
        c, ctx = model
        ratio = [c[g] / ctx[h] if ctx[h] else 0.0 for g, h in token[1:]]
        seen = [(k, ctx[h]) for k, (_, h) in enumerate(token[1:], 1) if ctx[h]]
        bucket = (seen[-1][0], int(math.log2(seen[-1][1]))) if seen else (0, 0)
        return bucket, c[token[0][0]], ratio

    def totals(c):
        one = {g: n for g, n in c.items() if len(g) == 1}
        return sum(one.values()), len(one)

    kept = counts(lambda f: f not in (1, 4))
    n, v = totals(kept[0])
    level = lambda x: 2 ** (round(math.log2(x) * L.STEP) / L.STEP) if x else 0.0
    events = Counter()
    for i, t in rows:
        if fold(i) == 4:
            for token in grams(t, order):
                bucket, word, ratio = view(kept, token)
                events[bucket, level(word), tuple(map(level, ratio))] += 1
    even = lambda b: [1 / (2 + b[0])] * (2 + b[0]) + [0.0] * (order - 1 - b[0])
    weights = {b: even(b) for b, _, _ in events}
    for _ in range(L.EM_ROUNDS):
        new = {b: [1e-3 * x for x in even(b)] for b in weights}
        for (b, word, ratio), k in events.items():
            share = [w * p for w, p in zip(weights[b], [(word + 0.5) / (n + 0.5 * (v + 1)), word / n, *ratio])]
            for j, s in enumerate(share):
                new[b][j] += k * s / sum(share)
        weights = {b: [x / sum(w) for x in w] for b, w in new.items()}
    whole = counts(lambda f: f != 1)
    n, v = totals(whole[0])
    out = []
    for i, t in rows:
        score = 0.0
        for token in grams(t, order):
            bucket, word, ratio = view(whole, token)
            w = weights.get(bucket, even(bucket))
            score += math.log10(w[0] * (word + 0.5) / (n + 0.5 * (v + 1)) + w[1] * word / n + sum(a * r for a, r in zip(w[2:], ratio)))
        out.append((i, round(score, 5)))
    return sorted(out, key=str)


def test_scores_match_a_plain_model(spark, sf, corpus):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    got = sorted(((r["doc_id"], round(r["score"], 5)) for r in L.op9_lm_scoring(spark, sf).collect()), key=str)
    assert got == brute_scores(corpus, fold, 3)


def test_other_orders_match_a_plain_model(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b", "b", "", "a a a a b", "d e"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fold = lambda i: i % 5
    for order in (1, 2, 4):
        out = L.lm_score(df, F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 4, order=order).collect()
        assert sorted(((r["doc_id"], round(r["score"], 5)) for r in out), key=str) == brute_scores(rows, fold, order)


def test_texts_that_occur_twice_score_apart(spark):
    """Training texts of their own words order, half of them twice: those of both copies score higher a token."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 80)) for _ in range(120)]
    rows = list(enumerate(texts + texts[:30]))
    out = L.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), F.col("doc_id") % 4 == 0).collect()
    per = {r["doc_id"]: r["score"] / r["n_tokens"] for r in out}
    low = sorted(per[i] for i in range(30, 120))[80]
    assert sum(per[i] > low for i in range(30)) >= 27


def test_clashing_columns_and_long_text(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a b " * 100_000, 5.0, 7, "x"), (2, None, 1.0, 8, "y"), (3, "a", 0.0, 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, block long, payload string")
    out = {r["doc_id"]: r for r in L.lm_score(df, F.lit(True), F.col("doc_id") == 3).collect()}
    assert out[1]["n_tokens"] == 200_001 and out[2]["n_tokens"] == 1 and out[3]["block"] == 9 and out[2]["payload"] == "y"
    assert all(r["score"] < 0 for r in out.values())


def test_weights_follow_the_held_out_counts():
    events = np.array([(67, 10, 0, 90), (67, 10, -1000, 10), (69, 3, -1000, 100)])
    w = L.learn_weights(events, 1e6, 1e4, order=2)
    assert np.allclose(w.sum(axis=1), 1)
    assert w[67, 2] > 0.8 and w[69, 2] < 0.01 and w[0, 2] == 0


def test_usual_texts_score_higher(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b", "b", "a"] * 4)]
    probe = [(100, ""), (101, "a"), (103, "c"), (104, "zz"), (105, "a b"), (106, "b zz")]
    both = spark.createDataFrame(rows + probe, "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in L.lm_score(both, F.col("doc_id") < 100, F.col("doc_id") % 4 == 0).where("doc_id >= 100").collect()}
    assert all(x < 0 for x in out.values())
    assert out[104] < out[103] and out[106] < out[105]


def test_estimates_sum_to_one():
    """The floor over all words and one unknown type, like the maximum-likelihood estimates, is a distribution."""
    counts = np.array([5.0, 3.0, 1.0, 1.0])
    n, v = counts.sum(), len(counts)
    floor = L._floor(np.append(counts, 0.0), n, v)
    assert math.isclose(floor.sum(), 1.0)
    w = L.learn_weights(np.zeros((0, 5), np.int64), n, v)
    assert np.allclose(w.sum(axis=1), 1)


def test_empty_table(empty):
    from pyspark.sql import functions as F

    assert L.lm_score(empty, F.lit(True), F.lit(False)).collect() == []


def test_a_score_does_not_depend_on_the_tables_size(spark, corpus):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, (_, t) in enumerate(corpus[:24])]
    more = [(10_000 + i, f"q{i} " * 400) for i in range(400)]  # held out: nothing is learned from them
    score = lambda x: {r["doc_id"]: r["score"] for r in L.lm_score(spark.createDataFrame(x, "doc_id long, text string"), F.col("doc_id") < 10_000, F.col("doc_id") % 5 == 4).where("doc_id < 10000").collect()}
    few, many = score(rows), score(rows + more)
    assert few.keys() == many.keys() and all(math.isclose(few[i], many[i], rel_tol=1e-9) for i in few)

