"""Benchmark decontamination (operator 8) by CGK embeddings and bit-sampling LSH.

A benchmark item of W words is found in a document where some stretch is within
floor((1 - SIMILARITY) * W) word edits of it. Item-sized windows of the document
are embedded by the CGK random walk, which maps edit distance to Hamming
distance: a walk copies the word under its pointer and moves on or stays by a coin
thrown for that step and word. Bit-sampling LSH makes ``REPEATS`` keys of a
window for every ``EACH`` words, each of a walk of its own and ``SAMPLED`` of its places; places lie in the
first 1.8 W steps, where the pointer is still inside the words. The keys of windows are
joined with the keys of items, and an exact edit distance on the words decides about
each pair that shares one. ``expected_recall`` simulates edits at the bound: with these constants it is
``TARGET_RECALL`` or more for items of 1 to 500 words, and a test holds that.

Which windows are embedded: of an item with at most d edits, one of d+1 equal
pieces must stand in the document unchanged (pigeonhole), so only windows
that align with such a piece can match. This filter loses nothing within the bound; what an
embedded window is like is found by its keys alone. Equal windows are embedded once, and
overlapping windows of one item are verified in one go, so repeated text costs no more than other text.

Items come in blocks of at most ``ITEMS_A_BLOCK`` and about ``BYTES_A_BLOCK`` of text (one item at least); each is scanned
against all rows, so what a task receives is bounded whatever the benchmark's size.

Defined cases: words are runs of letters and digits (beyond ASCII of anything but general punctuation), lower-cased; null or empty texts and items match nothing; repeated rows are
reported each; of equal matches in a document the first with the fewest
edits is reported; extra columns pass through; empty tables give no match.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.llm import blocks as B
from talentloom.llm import textnp
from talentloom.llm.common import table

SIMILARITY = 0.8
PIECE = 4
TARGET_RECALL = 0.99
REPEATS, EACH, SAMPLED = 64, 125, 2
ITEMS_A_BLOCK, BYTES_A_BLOCK = 1 << 14, 8 << 20
CHUNK = 1 << 20
#: Words and walks of the windows that are embedded at once.
AT_ONCE = 1 << 19
U = textnp.U
#: Word bytes as themselves, everything else as a space (texts are lower-cased before).
_BYTES = np.full(256, 0x20, np.uint8)
_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]


def allowed(words: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * words + 1e-9)


def walk_steps(words: int) -> int:
    """Steps in which a walk (half a word a step) hardly ever passes the end of a window."""
    return max(1, 9 * words // 5)


def repeats_for(words: int) -> int:
    """Repeats for the target recall: long items drift further at the bound, so they take more."""
    return REPEATS * max(1, -(-words // EACH))


def places_of(words: int, repeats: int, sampled: int = SAMPLED) -> np.ndarray:
    """The places sampled of each repeat's walk over windows of this size: (sampled, repeats).

    Those of one repeat lie a quarter of the walk apart or more, so that a single shared piece does not fill them.
    """
    rng, steps = np.random.default_rng([repeats, words]), walk_steps(words)
    apart = np.arange(sampled)[:, None] * max(1, steps // (2 * sampled)) + np.sort(rng.integers(0, max(1, steps // 2), (sampled, repeats)), axis=0)
    return (apart + rng.integers(0, steps, repeats)) % steps


def cgk(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The sampled places of the walks of windows (rows of word hashes), a walk for each column of places: (places, rows, walks)."""
    n, w = words.shape
    # behind the end stands a mark of the last word, so that two ends alone are no likeness
    padded = np.concatenate([words, textnp.mix(words[:, -1:])], axis=1).reshape(-1)
    base = (np.arange(n) * (w + 1))[:, None]
    walks = places.shape[1]
    at = np.zeros((n, walks), np.int64)
    salt = np.arange(1, walks + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    out = np.zeros((len(places), n, walks), np.uint64)
    for j in range(int(places.max()) + 1):
        here = padded[base + at]
        for k, walk in zip(*np.nonzero(places == j), strict=True):
            out[k, :, walk] = here[:, walk]
        coin = ((here ^ (salt + U(j))) * U(0xD6E8FEB86659FD93)) >> U(63)
        at = np.minimum(at + coin.astype(np.int64), w)
    return out


def lsh_keys(words: np.ndarray, sampled: int = SAMPLED) -> np.ndarray:
    """(rows, repeats) keys of windows of one size."""
    repeats = repeats_for(words.shape[1])
    places = places_of(words.shape[1], repeats, sampled)
    out = np.empty((len(words), repeats), np.uint64)
    step = max(1, AT_ONCE // (words.shape[1] + 8 * repeats))
    for i in range(0, len(words), step):
        part = words[i : i + step]
        key = np.tile(np.arange(1, repeats + 1, dtype=np.uint64), (len(part), 1))
        for seen in cgk(part, places):
            key = textnp.mix(key * U(0x9E3779B97F4A7C15) + seen)
        out[i : i + step] = key
    return out


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """words after random changes, losses and additions."""
    out = list(words)
    for kind, new in zip(rng.integers(0, 3, edits), rng.integers(1, 2**62, edits), strict=True):
        at = int(rng.integers(0, max(1, len(out))))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1 and out:
            out.pop(at)
        else:
            out.insert(at, new)
    return np.array(out, np.uint64)


def expected_recall(words: int, trials: int = 100, seed: int = 1) -> float:
    """Share of random items of this size that the search finds when edited up to the bound and set among other words."""
    rng = np.random.default_rng([seed, words])
    found = 0
    for _ in range(trials):
        item = rng.integers(1, 2**62, words).astype(np.uint64)
        other = rng.integers(1, 2**62, (2, 40)).astype(np.uint64)
        text = np.concatenate([other[0], edited(item, allowed(words), rng), other[1]])
        found += bool(Items.of_words([0], [item]).search(text, np.array([0, len(text)])))
    return found / trials


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits of item against any stretch of text: (edits, start, end); first of equals."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, word in enumerate(item.tolist(), 1):
        new = np.empty(n + 1, np.int64)
        new[0] = k
        swap, drop = cost[:-1] + (text != word), cost[1:] + 1
        new[1:] = np.minimum(swap, drop)
        came = np.empty(n + 1, np.int64)
        came[0] = start[0]
        came[1:] = np.where(swap <= drop, start[:-1], start[1:])
        # an added word of the text costs one more than the best to its left
        lead = new - steps
        low = np.minimum.accumulate(lead)
        at = np.maximum.accumulate(np.where(lead == low, steps, 0))
        took = lead > low
        came = np.where(took, came[at], came)
        cost, start = np.where(took, low + steps, new), came
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class _Table:
    """Rows by a sorted 64-bit key."""

    def __init__(self, key: np.ndarray, *columns: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        self.key, self.columns = key[order], [c[order] for c in columns]
        # flags of first bits, about eight for each key: small tables stay small
        self.shift = U(64 - min(20, 3 + len(key).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.key >> self.shift).astype(np.int64)] = True

    def join(self, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in key, the columns) of all pairs of equal keys."""
        hit = np.flatnonzero(self.seen[(key >> self.shift).astype(np.int64)])
        low = np.searchsorted(self.key, key[hit])
        n = np.searchsorted(self.key, key[hit], side="right") - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(hit, n), *(c[at] for c in self.columns)


class Items:
    """A block of benchmark items ready for search."""

    def __init__(self, ids: list, texts: list[str | None], similarity: float = SIMILARITY) -> None:
        hashes, rows = words_of(pa.array(texts, pa.string()))
        self._build(ids, [hashes[rows[i] : rows[i + 1]] for i in range(len(ids))], similarity)

    @classmethod
    def of_words(cls, ids: list, words: list[np.ndarray], similarity: float = SIMILARITY) -> Items:
        out = cls.__new__(cls)
        out._build(ids, words, similarity)
        return out

    def _build(self, ids: list, words: list[np.ndarray], similarity: float) -> None:
        some = [i for i in range(len(ids)) if len(words[i])]
        self.ids, self.words, self.similarity = [ids[i] for i in some], [words[i] for i in some], similarity
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        by_size: dict[int, list[int]] = {}
        for i, item in enumerate(self.words):
            w = len(item)
            d = allowed(w, similarity)
            size = min(PIECE, w // (d + 1))
            at = np.arange(d + 1) * w // (d + 1)
            for key, place in zip(textnp.span_sums(item, at, at + size, 2).tolist(), at.tolist(), strict=True):
                pieces.setdefault(size, []).append((key, w, place))
            by_size.setdefault(w, []).append(i)
        self.pieces, self.keys = {}, {}
        for size, found in pieces.items():
            one = np.array(sorted(set(found)), np.uint64)
            self.pieces[size] = _Table(one[:, 0], one[:, 1].astype(np.int64), one[:, 2].astype(np.int64))
        for w, members in by_size.items():
            keys = lsh_keys(np.stack([self.words[i] for i in members]))
            self.keys[w] = _Table(keys.reshape(-1), np.repeat(np.array(members), keys.shape[1]))

    def windows(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (size, row, first word) of windows that align with an unchanged piece and overlap their row enough."""
        out = [np.zeros((0, 3), np.int64)]
        for size, table in self.pieces.items():
            first = np.arange(max(0, len(hashes) - size + 1))
            hit, w, at = table.join(textnp.span_sums(hashes, first, first + size, 2))
            row, start = np.searchsorted(rows, hit, side="right") - 1, hit - at
            d = np.floor((1 - self.similarity) * w + 1e-9).astype(np.int64)
            near = (start >= rows[row] - d) & (start + w <= rows[row + 1] + d)
            out.append(np.stack([w[near], row[near], start[near]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def candidates(self, w: int, row: np.ndarray, start: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs that share a key; equal windows are embedded once."""
        low, high = np.maximum(start, rows[row]), np.minimum(start + w, rows[row + 1])
        same = textnp.mix(textnp.span_sums(hashes, low, high, 3) + (low - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)) + (high - low).astype(np.uint64)
        _, one, which = np.unique(same, return_index=True, return_inverse=True)
        pairs = [np.zeros((0, 2), np.int64)]
        step = max(1, AT_ONCE // w)
        for i in range(0, len(one), step):
            part = one[i : i + step]
            at = start[part][:, None] + np.arange(w)
            inside = (at >= low[part][:, None]) & (at < high[part][:, None])
            keys = lsh_keys(np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], U(1)))
            place, item = self.keys[w].join(keys.reshape(-1))
            pairs.append(np.unique(np.stack([i + place // keys.shape[1], item], axis=1), axis=0))
        pairs = np.concatenate(pairs)
        # back from each distinct window to all windows of its content
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], pairs[:, 0])
        n = np.searchsorted(which[order], pairs[:, 0], side="right") - first
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return order[at], np.repeat(pairs[:, 1], n)

    def search(self, hashes: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, edits) of the best match of each item in each row."""
        asked = self.windows(hashes, rows)
        pairs = [np.zeros((0, 3), np.int64)]
        for w in np.unique(asked[:, 0]).tolist():
            mine = asked[asked[:, 0] == w]
            window, item = self.candidates(w, mine[:, 1], mine[:, 2], hashes, rows)
            pairs.append(np.stack([mine[window, 1], item, mine[window, 2]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        if not len(pairs):
            return []
        size = np.array([len(x) for x in self.words])[pairs[:, 1]]
        d = np.floor((1 - self.similarity) * size + 1e-9).astype(np.int64)
        low = np.maximum(rows[pairs[:, 0]], pairs[:, 2] - 2 * d)
        high = np.minimum(rows[pairs[:, 0] + 1], pairs[:, 2] + size + 2 * d)
        # windows of one item that overlap in a row are one stretch
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1) | (low[1:] > high[:-1])
        heads = np.flatnonzero(new)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, end in zip(heads.tolist(), [*(heads[1:] - 1).tolist(), len(pairs) - 1], strict=True):
            row, item = pairs[k, :2].tolist()
            edits, s, e = best_match(self.words[item], hashes[low[k] : high[end]])
            if edits <= d[k]:
                found = (edits, int(low[k]) + s - int(rows[row]), e - s)
                best[row, item] = min(best.get((row, item), found), found)
        return [(row, item, start, n, edits) for (row, item), (edits, start, n) in sorted(best.items())]


def words_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = textnp.buffers(pc.utf8_lower(column))
    out = _BYTES[data]
    # signs beyond ASCII: U+00A0 to U+00BF, and U+2000 to U+207F
    two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0)) if len(data) > 1 else np.zeros(0, np.int64)
    three = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) if len(data) > 2 else two[:0]
    for at, width in ((two, 2), (three, 3)):
        for k in range(width):
            out[at + k] = 0x20
    return textnp.word_hashes(out, offsets)


def item_blocks(benchmark: DataFrame, similarity: float, most: int = ITEMS_A_BLOCK, most_bytes: int = BYTES_A_BLOCK):
    """Items in blocks of about `most` items and `most_bytes` of text, each small enough for every task."""
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // most), -(-size // most_bytes), bool(n))
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else benchmark
        rows = sorted(part.select("item_id", "text").collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield Items([r[0] for r in rows], [r[1] for r in rows], similarity)


def _scan(docs: DataFrame, items: Items, column: str, keep: list[str]) -> DataFrame:
    more = [("item_id", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("match_words", T.LongType(), pa.int64()), ("edits", T.LongType(), pa.int64()), ("similarity", T.DoubleType(), pa.float64())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t, _ in more)])
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        for piece, _ in B.slices(batches, column, CHUNK):
            use = shared.value
            found = use.search(*words_of(piece.column(column)))
            if not found:
                continue
            left = piece.select(keep).take(pa.array([x[0] for x in found]))
            cols = [[use.ids[x[1]] for x in found], [x[2] for x in found], [x[3] for x in found], [x[4] for x in found], [1 - x[4] / len(use.words[x[1]]) for x in found]]
            out = pa.Table.from_arrays([*left.columns, *(pa.array(c, t) for c, (_, _, t) in zip(cols, more, strict=True))], names=[*keep, *(n for n, _, _ in more)])
            yield from out.combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, column: str = "text", keep: list[str] | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item found in it: the columns `keep` and the match."""
    taken = {"item_id", "first_word", "match_words", "edits", "similarity"}
    keep = [c for c in (keep or [c for c in docs.columns if c != column]) if c not in taken]
    docs = docs.select(*keep, *([] if column in keep else [column]))
    out = None
    for items in item_blocks(benchmark, similarity):
        part = _scan(docs, items, column, keep)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _scan(docs, Items([], []), column, keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns stay, nothing is shuffled."""
    for items in item_blocks(benchmark, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for piece, _ in B.slices(batches, column, CHUNK):
                bad = np.zeros(piece.num_rows, bool)
                bad[[x[0] for x in shared.value.search(*words_of(piece.column(column)))]] = True
                yield from piece.filter(pa.array(~bad)).combine_chunks().to_batches()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 8: every benchmark item found in every document, with its place and edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"))
