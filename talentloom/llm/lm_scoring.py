"""LM scoring (operator 9): an n-gram model (trigrams unless told otherwise) by deleted interpolation.

Maximum-likelihood estimates of all orders and a smoothed floor are
mixed with weights that depend on the longest context that was seen and on how often it was seen (one bucket per
order and power of two). The weights are learned by expectation-maximisation on the counts
of a deleted part of the training documents, under estimates from the kept part;
the final estimates use all training documents.

Counts cover all documents and stay distributed: every block sends its distinct
n-gram keys to their ranges' owners and gets their corpus counts
back (see blocks.py). The driver sees sums and one histogram whose size is bound
by its quantisation (half powers of two), never by the corpus. Words go by 64-bit hashes, longer n-grams by names whose bits grow
with the input, so that less than one in 2**SPARE_BITS shares its name with another.

Defined cases: null text is empty and holds one end token; words are bytes
between white space; repeated rows count each time; a null document id counts as
an empty one for the folds; extra columns pass through; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.llm import blocks as B
from talentloom.llm import textnp
from talentloom.llm.common import bucketed, shuffle_partitions, table

END, START = textnp.U(0x5E1D_0FFE_0000_0001), textnp.U(0x57A2_7000_0000_0003)
COUNTS = np.dtype([("kept", "<u8"), ("cut", "<u8")])
#: The order of an n-gram stands in the last bits of its name.
ORDER, ORDER_BITS = 3, 3
#: Names of n-grams have so many bits more than the count of n-grams has, and at least LEAST_BITS; words have 64.
SPARE_BITS, LEAST_BITS = 10, 40
BLOCK_BYTES = 4 << 20
EM_ROUNDS, STEP = 60, 2
HELD, KEPT, CUT = 0, 1, 2
U = textnp.U


class _Tokens:
    """Tokens of a block's rows (words, then one end) and their distinct n-gram keys."""

    def __init__(self, part: pa.Table, column: str, order: int, shift: int) -> None:
        data, offsets = textnp.buffers(part.column(column))
        words, rows = textnp.word_hashes(data, offsets, lower=True)
        n = part.num_rows
        self.rows = rows + np.arange(n + 1)
        self.n = np.diff(self.rows)
        self.first = self.rows[:-1]
        tokens = np.empty(len(words) + n, np.uint64)
        last = np.zeros(len(tokens), bool)
        last[self.rows[1:] - 1] = True
        tokens[last], tokens[~last] = END, words
        gram, grams = textnp.mix(tokens), []
        self.words, place = np.unique(gram, return_inverse=True)
        for k in range(1, order):  # the gram of one word less that ends before, then this word
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[self.first] = textnp.mix(np.array([START + U(k)]))[0]
            gram = textnp.mix(textnp.mix(before ^ U(0x1F83D9ABFB41BD6B)) + tokens)
            grams.append(((gram >> U(shift + ORDER_BITS) << U(ORDER_BITS)) | U(k)) << U(shift))
        self.longer, more = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]), return_inverse=True)
        #: For each order the place of each token's n-gram in words, then longer.
        self.at = np.concatenate([place, more + len(self.words)]).reshape(order, -1)
        self.end = np.searchsorted(self.words, textnp.mix(np.array([END])))[0]

    def __len__(self) -> int:
        return len(self.words) + len(self.longer)

    def part_of_rows(self, fold: np.ndarray) -> np.ndarray:
        return np.repeat(fold, self.n)

    def counts(self, part: pa.Table, elsewhere: np.ndarray | int = 0) -> np.ndarray:
        """Counts of the distinct n-grams in this block, plus those elsewhere."""
        fold = self.part_of_rows(part.column("_fold").to_numpy())
        out = np.zeros(len(self), COUNTS)
        for name, f in (("kept", KEPT), ("cut", CUT)):
            out[name] = np.bincount(self.at[:, fold == f].reshape(-1), minlength=len(out))
            if len(np.shape(elsewhere)):
                out[name] += elsewhere[name]
        return out


def count_cells(blocks: DataFrame, column: str, parts: tuple[int, int], order: int, shift: int) -> DataFrame:
    """Counts of words in the first parts[0] ranges, of longer n-grams in the next parts[1]."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                part = B.from_payload(row["payload"])
                if not part.num_rows:
                    continue
                tokens = _Tokens(part, column, order, shift)
                counts = tokens.counts(part)
                n = len(tokens.words)
                yield B.cell_rows(row["block"], tokens.words, counts[:n], parts[0])
                yield B.cell_rows(row["block"], tokens.longer, counts[n:], parts[1], parts[0], shift)

    return blocks.select("block", "payload").mapInArrow(run, B.CELL_SCHEMA)


def corpus_counts(cells: DataFrame, word_parts: int, parts: int) -> DataFrame:
    """Each cell's keys answered with the counts in all other blocks; a row of block -1 holds the range's sums."""

    def run(part: pa.Table) -> pa.Table:
        keys, counts, order, sizes = B.merged(part, COUNTS)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads, at = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.zeros(len(heads), COUNTS)
        for name in COUNTS.names:
            total[name] = np.add.reduceat(counts[name], heads)
        words = total if part.column("part")[0].as_py() < word_parts else total[:0]
        everything = words["kept"] + words["cut"]
        sums = np.array([everything.sum(), (everything > 0).sum(), words["kept"].sum(), (words["kept"] > 0).sum()], np.uint64)
        stats = pa.table({"part": [part.column("part")[0].as_py()], "block": [-1], "vals": [sums.tobytes()]}, schema=B._arrow(B.REPLY_SCHEMA))
        others = np.zeros(len(keys), COUNTS)
        for name in COUNTS.names:
            others[name] = total[name][at] - counts[name]
        return pa.concat_tables([B.reply(part, order, sizes, others), stats])

    return B.by_part(cells, parts).groupBy("part").applyInArrow(run, B.REPLY_SCHEMA)


def corpus_sums(stats: DataFrame) -> list[float]:
    """Tokens and distinct tokens of all training documents, then of the kept ones; summed before they reach the driver."""
    names = ["n", "v", "n_kept", "v_kept"]

    def run(batches):
        for batch in batches:
            rows = [np.frombuffer(x, np.uint64) for x in batch.column("vals").to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pydict({k: pa.array([int(x)], pa.int64()) for k, x in zip(names, np.sum(rows, axis=0), strict=True)})

    row = stats.select("vals").mapInArrow(run, ", ".join(f"{k} long" for k in names)).agg(*[F.sum(k).alias(k) for k in names]).first()
    return [float(row[k] or 0) for k in names]


def _levels(x: np.ndarray) -> np.ndarray:
    """Half powers of two above zero; -1000 for zero."""
    out = np.full(len(x), -1000)
    some = x > 0
    out[some] = np.rint(np.log2(x[some]) * STEP).astype(np.int64)
    return out


class _Counts:
    """Counts by token and order: of the n-gram and of its context, from kept or all training documents."""

    def __init__(self, tokens: _Tokens, counts: np.ndarray, everything: bool) -> None:
        c = counts["kept"] + counts["cut"] if everything else counts["kept"]
        c = c.astype(np.float64)
        self.gram = [c[at] for at in tokens.at]
        self.word = self.gram[0]
        self.context = []
        for shorter in self.gram[:-1]:
            context = np.empty_like(shorter)
            context[1:] = shorter[:-1]
            context[tokens.first] = c[tokens.end]  # as many starts as ends
            self.context.append(context)

    def ratios(self) -> list[np.ndarray]:
        """Maximum-likelihood estimates of orders 2 and up."""
        return [np.divide(g, c, out=np.zeros_like(g), where=c > 0) for g, c in zip(self.gram[1:], self.context, strict=True)]

    def buckets(self) -> np.ndarray:
        """0 where no context was seen, else 64 times the number of words of the longest that was, plus the floor of its count's log2."""
        out = np.zeros(len(self.word), np.int64)
        for k, context in enumerate(self.context, 1):
            some = context > 0
            out[some] = 64 * k + np.floor(np.log2(context[some])).astype(np.int64)
        return out


def _floor(word: np.ndarray, n: float, v: float) -> np.ndarray:
    return (word + 0.5) / (n + 0.5 * (v + 1))


def held_out_events(blocks: DataFrame, counts: DataFrame, column: str, order: int, shift: int) -> DataFrame:
    """How often each quantised (context bucket, word count, estimates of orders 2 and up) occurs in the cut part."""
    names = ["bucket", *(f"q{k}" for k in range(1, order + 1))]

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            part = B.from_payload(row["payload"])
            if not part.num_rows:
                continue
            tokens = _Tokens(part, column, order, shift)
            c = _Counts(tokens, tokens.counts(part, B.replies_of(replies, COUNTS)), everything=False)
            mine = tokens.part_of_rows(part.column("_fold").to_numpy()) == CUT
            event = np.stack([c.buckets()[mine], _levels(c.word[mine]), *(_levels(r[mine]) for r in c.ratios())])
            kinds, n = np.unique(event, axis=1, return_counts=True)
            out.append(pa.table({**dict(zip(names, kinds, strict=True)), "n": n}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in [*names, "n"]})

    schema = ", ".join(f"{x} long" for x in [*names, "n"])
    events = blocks.select("block", "payload").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, schema)
    return events.groupBy(*names).agg(F.sum("n").alias("n"))


def learn_weights(events: np.ndarray, n: float, v: float, order: int = ORDER) -> np.ndarray:
    """Expectation-maximisation of the weights (floor, word, orders 2 and up) of each bucket.

    events: rows (bucket, word level, levels of orders 2 and up, count). A bucket without events
    mixes its orders evenly; orders whose context the bucket has not seen weigh nothing.
    """
    known = 1 + np.minimum(np.arange(64 * order) // 64 + 1, order)  # floor, word and as many orders as there are contexts
    weights = (np.arange(order + 1) < known[:, None]) / known[:, None]
    if not len(events):
        return weights
    bucket, count = events[:, 0], events[:, -1]
    parts = np.where(events[:, 1:-1] > -1000, 2.0 ** (events[:, 1:-1] / STEP), 0.0)
    word = parts[:, 0]
    parts = np.column_stack([_floor(word, n, v), word / max(n, 1), parts[:, 1:]])
    even = weights.copy()
    for _ in range(EM_ROUNDS):
        share = weights[bucket] * parts
        share *= (count / share.sum(axis=1))[:, None]
        weights = np.stack([np.bincount(bucket, s, len(weights)) for s in share.T], axis=1) + 1e-3 * even
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def mixture(c: _Counts, weights: np.ndarray, n: float, v: float) -> np.ndarray:
    """The model's probability of each token."""
    w = weights[c.buckets()]
    p = w[:, 0] * _floor(c.word, n, v) + w[:, 1] * c.word / max(n, 1)
    for k, ratio in enumerate(c.ratios(), 2):
        p += w[:, k] * ratio
    return p


def lm_score(docs: DataFrame, train: F.Column, cut: F.Column, column: str = "text", order: int = ORDER) -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score (log10).

    train: whether to learn from a row; cut: whether a training row belongs to the deleted part.
    Columns of docs with these names (and _fold) are replaced.
    """
    if not 1 <= order <= 1 << ORDER_BITS:
        raise ValueError("the order must be between 1 and 8")
    spark = docs.sparkSession
    docs = docs.drop("_fold", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    fold = F.when(~F.coalesce(train, F.lit(False)), HELD).when(F.coalesce(cut, F.lit(False)), CUT).otherwise(KEPT)
    size = B.text_bytes(docs, column)
    grown = B.growth(size)
    n_buckets = B.buckets_for(size, BLOCK_BYTES * grown)
    blocks = B.write_blocks(docs.withColumn("_fold", fold.cast("int")), "lm_blocks", column, BLOCK_BYTES * grown, buckets=n_buckets)
    parts = tuple(B.parts_for(n, shuffle_partitions(spark), grown) for n in (size // 24, size * (order - 1) // 6))
    shift = max(0, 64 - ORDER_BITS - max(LEAST_BITS, SPARE_BITS + (size * order // 6).bit_length()))
    replies = corpus_counts(count_cells(blocks, column, parts, order, shift), parts[0], sum(parts))
    counts = bucketed(replies.repartition(n_buckets, "block"), "block", "lm_counts", n_buckets)
    n, v, n_kept, v_kept = corpus_sums(counts.where("block = -1"))
    answers = counts.where("block >= 0")
    events = held_out_events(blocks, answers, column, order, shift)
    weights = learn_weights(np.array([tuple(r) for r in events.collect()], np.int64).reshape(-1, order + 2), n_kept, v_kept, order)
    fields = [f for f in docs.schema.fields if f.name != column]
    more = [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]
    names = [f.name for f in fields]

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            part = B.from_payload(row["payload"])
            tokens = _Tokens(part, column, order, shift)
            c = _Counts(tokens, tokens.counts(part, B.replies_of(replies, COUNTS)), everything=True)
            add = lambda x: np.add.reduceat(x, tokens.first)
            base, score = add(np.log10(_floor(c.word, n, v))), add(np.log10(mixture(c, weights, n, v)))
            part = part.select(names)
            for name, values in (("n_tokens", tokens.n), ("n_known", add((c.word > 0).astype(np.int64))), ("train_tokens", np.full(len(tokens.n), int(n))), ("base_score", base), ("score", score)):
                part = part.append_column(name, pa.array(values))
            out.append(part)
        return pa.concat_tables(out)

    schema = T.StructType([*fields, *more])
    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 9: scores of all documents; learns where crc32(doc_id) mod 5 is not 1, cuts out remainder 4."""
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (rest == 1).alias("held_out"), rest.alias("_rest"))
    scored = lm_score(docs, ~F.col("held_out"), F.col("_rest") == 4)
    return scored.drop("_rest")
