import random
import time

import numpy as np
import pyarrow as pa
import pytest

from talentloom.llm import decontaminate as D
from talentloom.llm import textnp
from tests.llm.conftest import prose


def edits(words, n, rng):
    out = list(words)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = "edited" + str(rng.randrange(99))
        elif kind == 1:
            out.pop(at)
        else:
            out.insert(at, "added")
    return out


def plain_distance(item, text):
    """Fewest edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    items = [(k, prose(15 + 3 * k, 500 + k)) for k in range(14)] + [(90, "tiny item"), (91, None), (92, "  ")]
    docs = []
    for i in range(70):
        text = prose(40 + i, 900 + i)
        if i % 2:
            item = items[i % 14][1].split()
            middle = edits(item, (i // 14) % 5, rng)
            text = text + " " + " ".join(middle).upper() + ", " + prose(30, 2000 + i)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "a tiny item here"), (103, items[0][1]), (103, items[0][1])]
    return items, docs


def test_matches_brute_force(spark, planted):
    items, docs = planted
    tokens = lambda t: D.words_of(pa.array([t], pa.string()))[0].tolist()
    want = set()
    for i, t in docs:
        for k, item in items:
            w = tokens(item)
            if w and (d := plain_distance(w, tokens(t))) <= D.allowed(len(w)):
                want.add((i, k, d))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in rows}
    assert len(want) > 30 and not got - want
    assert len(got & want) >= 0.99 * len(want)
    assert sum(r["doc_id"] == 103 for r in rows) == 2
    left = {r["doc_id"] for r in D.decontaminate(df.withColumn("item_id", df.doc_id), bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _, _ in want}


def test_blocks_of_items_change_nothing(spark, planted, monkeypatch):
    items, docs = planted
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench).collect()}
    monkeypatch.setattr(D.item_blocks, "__defaults__", (5, 1 << 20))
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench).collect()} == whole


def test_best_match_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 15))
        cost, start, end = D.best_match(item.astype(np.uint64), text.astype(np.uint64))
        assert cost == plain_distance(item.tolist(), text.tolist())
        assert 0 <= start <= end <= len(text)


def test_walks_of_equal_windows_are_equal():
    rng = np.random.default_rng(2)
    w = rng.integers(0, 2**63, (3, 20), dtype=np.uint64)
    w[2] = w[0]
    places = D.places_of(20, 4, 3)
    walks = D.cgk(w, places)
    assert walks.shape == (3, 3, 4) and places.max() < D.walk_steps(20)
    assert (walks[:, 0] == walks[:, 2]).all() and (walks[:, 0] != walks[:, 1]).any()


def test_walk_against_a_plain_one():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 2**63, 12, dtype=np.uint64)
    places = np.array([[0, 7], [20, 3]])
    got = D.cgk(words[None, :], places)
    for walk in range(2):
        at, seen = 0, []
        for j in range(21):
            here = int(words[at]) if at < 12 else int(textnp.mix(words[-1:])[0])
            seen.append(here)
            salt = (0x9E3779B97F4A7C15 * (walk + 1) + j) % 2**64
            at = min(at + ((((here ^ salt) * 0xD6E8FEB86659FD93) % 2**64) >> 63), 12)
        assert [int(got[k, 0, walk]) for k in range(2)] == [seen[p] for p in places[:, walk]]


@pytest.mark.parametrize("words", [1, 4, 5, 9, 10, 25, 36, 60, 120, 250, 500])
def test_recall_at_the_bound(words):
    assert D.expected_recall(words) >= D.TARGET_RECALL


@pytest.mark.parametrize("words,piece,most", [(10, None, 0.0), (60, None, 0.0), (60, 0, 0.7), (60, 30, 0.05), (200, 0, 0.3), (200, 100, 0.05)])
def test_unrelated_windows_are_rejected(words, piece, most):
    """Share of proposed ones among windows that have nothing, or only one piece of 4 words, of an item (keys decide, so an early piece weighs more)."""
    rng = np.random.default_rng(3)
    item = rng.integers(1, 2**62, words).astype(np.uint64)
    text = rng.integers(1, 2**62, 400 * words).astype(np.uint64)
    if piece is not None:
        text.reshape(400, words)[:, piece : piece + 4] = item[piece : piece + 4]
    start = np.arange(400) * words
    window, _ = D.Items.of_words([0], [item]).candidates(words, np.zeros(400, np.int64), start, text, np.array([0, len(text)]))
    print(words, piece, len(window) / 400)
    assert len(window) <= most * 400


def test_repeated_word_is_searched_fast():
    """An item that ends in 40 equal words, and a document of that word alone; then one with the item inside."""
    head = [f"w{i}" for i in range(460)]
    items = D.Items([1], [" ".join(head + ["same"] * 40)])
    begun = time.monotonic()
    assert items.search(*D.words_of(pa.array(["same " * 3000]))) == []
    assert time.monotonic() - begun < 5
    hit = items.search(*D.words_of(pa.array(["same " * 3000 + " ".join(head) + " same" * 3000])))
    assert hit == [(0, 0, 3000, 500, 0)]


def test_very_long_item_and_text():
    rng = np.random.default_rng(8)
    item = rng.integers(1, 2**62, 2000).astype(np.uint64)
    text = np.concatenate([rng.integers(1, 2**62, 50_000).astype(np.uint64), D.edited(item, 380, rng), rng.integers(1, 2**62, 900).astype(np.uint64)])
    found = D.Items.of_words([0], [item]).search(text, np.array([0, len(text)]))
    assert len(found) == 1 and found[0][4] <= 380


def test_items_go_by_bytes_too(spark):
    bench = spark.createDataFrame([(i, "word " * 300) for i in range(20)], "item_id long, text string")
    assert len(list(D.item_blocks(bench, 0.8, most_bytes=4000))) > 5


def test_empty(spark, planted):
    df, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame(planted[1], "doc_id long, text string")
    assert D.contaminated(df, spark.createDataFrame(planted[0], "item_id long, text string")).collect() == []
    assert D.contaminated(full, bench).collect() == [] and D.decontaminate(full, bench).count() == full.count()
