"""Substring dedup (operator 10): a log-structured fingerprint index of word windows.

A window is ``window`` consecutive words of one document. Every window is
represented by its anchor, the smallest hash of the ``ANCHOR_WORDS``-grams inside
it (leftmost of equals), so equal windows have equal anchors at equal offsets.
The index keeps two kinds of immutable runs, each sorted by hash inside its key ranges: of
the anchors of all history, and of the windows (96 bits of all their words) under anchors that
occur more than once. An entry knows whether it occurred once or more often, and where if once.

``add`` packs a batch into blocks and merge-joins its anchors with the historical runs. That tells which anchors of the batch
repeat, and which of history, alone until now, do so from now on. The windows under both are
verified: they are merge-joined with the window runs by the full hashes, which gives every
place, in the batch or in history, where a window begins that occurs elsewhere too. These places
are appended; old blocks are read again only where the batch hit them. Before a batch the last two runs are merged, range by range and entry by entry, while the older
stands for no more than ``GROWTH`` times the text of the newer, so runs grow like powers and an entry is rewritten a logarithm of the batches' number of times; ``compact``
merges all runs, also where the number of ranges is widened as the index grows.
Equal windows are told by 96 bits of hash over all their words; the words themselves are not compared again.
A manifest in the index's folder names all parts after each change, so ``FingerprintIndex.open`` goes on
where a lost driver stopped.

A hash that is very common costs one entry a block, however often it occurs there: what
repeats inside a block is known there and needs no answer.
Results are whole: no window, document or group is capped or sampled.

Defined cases: null or empty text has no words and stays as it is; documents
under ``window`` words keep all words; repeated rows are separate documents, so
their windows repeat; ties need no rule, as all occurrences of a window go;
columns beside the text pass through untouched; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.llm import blocks as B
from talentloom.llm import textnp
from talentloom.llm.common import fresh_path, shuffle_partitions, table

WINDOW = 35
BLOCK_BYTES = 4 << 20
ANCHOR_WORDS = 11
#: Batches of the query and the pipeline's stage.
BATCHES = 3
#: How many times the text of the run behind it a run must stand for, to be left as it is.
GROWTH = 2
#: Numbers of hit blocks that are sent to every task; more are joined by a shuffle.
BROADCAST_BLOCKS = 1 << 20
CELL, PLACES, RUN = 0, 1, 2
#: CELL: a block's sorted distinct keys of a range, vals (32 more bits, then a twice-here bit) and their places; PLACES: places
#: (pos) of a block; RUN: a range's sorted keys, vals (last bit: more than once), homes (blocks of those that came once) and places.
ENTRY_SCHEMA = "kind int, part long, block long, keys binary, vals binary, homes binary, pos binary"
_ENTRIES = B._arrow(ENTRY_SCHEMA)


class _Words:
    """Words, anchors and windows of a block."""

    def __init__(self, part: pa.Table, column: str, window: int) -> None:
        data, offsets = textnp.buffers(part.column(column))
        self.hash, self.hash2, self.rows = textnp.word_hashes(data, offsets, second=True)
        k = min(ANCHOR_WORDS, window)
        n, wide = len(self.hash), window - k + 1
        self.window = window
        ends = np.repeat(self.rows[1:], np.diff(self.rows))
        at = np.arange(n)
        self.starts = np.flatnonzero(at + window <= ends)  # of windows
        if not len(self.starts):
            self.anchor_at = self.anchors = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.uint64)
            return
        grams = np.full(n + window, np.iinfo(np.uint64).max, dtype=np.uint64)
        first = at[: n - k + 1]
        grams[: len(first)] = textnp.span_sums(self.hash, first, first + k, 2)
        best, reach = np.arange(n + window), 1
        while 2 * reach <= wide:
            best = self._lower(grams, best, reach)
            reach *= 2
        if wide > reach:
            best = self._lower(grams, best, wide - reach)
        self.anchor_at = best[self.starts]  # never decreases
        self.anchors = np.unique(self.anchor_at)
        self.keys = grams[self.anchors]

    @staticmethod
    def _lower(grams: np.ndarray, best: np.ndarray, shift: int) -> np.ndarray:
        other = best[shift:]
        mine = best[: len(other)]
        out = best.copy()
        out[: len(other)] = np.where(grams[other] < grams[mine], other, mine)
        return out

    def under(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows whose anchor is repeated (a flag per anchor), with their two hashes."""
        starts = self.starts[repeated[np.searchsorted(self.anchors, self.anchor_at)]]
        if not len(starts):
            return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        one = textnp.span_sums(self.hash, starts, starts + self.window, 3)
        two = textnp.span_sums(self.hash2, starts, starts + self.window, 2)
        return starts, one, two >> textnp.U(32)


def _entries(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ENTRIES)


def _groups(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, heads, group of each ordered entry) of equal (key, check)."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _cells(block: int, keys: np.ndarray, checks: np.ndarray, pos: np.ndarray, parts: int) -> tuple[list[dict], np.ndarray]:
    """The CELL rows of a block, one entry a distinct (key, check), and the places of those that occur twice or more in the block."""
    if not len(keys):
        return [], pos
    order, heads, group = _groups(keys, checks)
    many = np.diff(np.append(heads, len(keys))) > 1
    twice = np.sort(pos[order[many[group]]])
    head = order[heads]
    keys, vals, pos = keys[head], (checks[head].astype(np.uint64) << textnp.U(1)) | many.astype(np.uint64), np.where(many, 0, pos[head]).astype(np.uint32)
    return _cut(keys, parts, lambda i, j: {"kind": CELL, "block": block, "keys": textnp.pack(keys[i:j], delta=True), "vals": textnp.pack(vals[i:j]), "pos": textnp.pack(pos[i:j])}), twice


def _cut(keys: np.ndarray, parts: int, row) -> list[dict]:
    """row(i, j) of each key range of sorted keys."""
    at = B.range_of(keys, parts)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(keys)] if len(keys) else [0]
    return [{"part": int(at[i]), **row(i, j)} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _places(block: int, pos: np.ndarray) -> dict:
    # any range may carry them
    return {"kind": PLACES, "part": int(block & 0xFFFF), "block": block, "pos": textnp.pack(np.sort(pos).astype(np.uint32), delta=True)}


def anchor_cells(blocks: DataFrame, column: str, window: int, parts: int) -> DataFrame:
    """The new batch's sorted anchor hashes by key range and block."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                words = _Words(B.from_payload(row["payload"]), column, window)
                yield _entries(_cells(row["block"], words.keys, np.zeros(len(words.keys), np.uint64), words.anchors, parts)[0])

    return blocks.select("block", "payload").mapInArrow(run, ENTRY_SCHEMA)


def window_cells(blocks: DataFrame, buckets: int, active: DataFrame, column: str, window: int, parts: int, fresh: bool) -> DataFrame:
    """Hashes of the windows under active anchors (their places in a block are the rows of active); fresh: and under those that repeat inside the block.

    Places of windows that repeat inside the block come too.
    """

    def run(block: pa.Table, places: pa.Table) -> pa.Table:
        out = []
        at = _positions(places)
        for row in block.to_pylist():
            words = _Words(B.from_payload(row["payload"]), column, window)
            repeated = np.isin(words.anchors, at)
            if fresh and len(words.keys):
                _, inverse, n = np.unique(words.keys, return_inverse=True, return_counts=True)
                repeated |= n[inverse] > 1
            starts, one, two = words.under(repeated) if len(words.starts) else (words.starts, words.keys, words.keys)
            cells, twice = _cells(row["block"], one, two, starts, parts)
            out += cells
            if len(twice):
                out.append(_places(row["block"], twice) | {"part": int(row["block"] % parts)})
        return pa.Table.from_batches([_entries(out)], schema=_ENTRIES)

    active = active.repartition(buckets, "block")  # like the blocks' buckets, which stay where they are
    if not fresh:  # old blocks without a new active anchor are left alone
        hit = active.select(F.col("block").alias("_b")).distinct()
        blocks = blocks.join(F.broadcast(hit) if hit.count() <= BROADCAST_BLOCKS else hit, F.col("block") == F.col("_b"), "left_semi")
    return blocks.select("block", "payload").groupBy("block").cogroup(active.groupBy("block")).applyInArrow(run, ENTRY_SCHEMA)


def _positions(places: pa.Table) -> np.ndarray:
    found = [textnp.unpack(x, np.uint32, delta=True) for x in places.column("pos").to_pylist()]
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


class _Column:
    """All entries of a key range: keys, checks, whether more than once, home blocks and places."""

    def __init__(self, rows: list[dict]) -> None:
        keys = [textnp.unpack(r["keys"], np.uint64, delta=True) for r in rows]
        sizes = [len(k) for k in keys]
        vals = self._joined([textnp.unpack(r["vals"], np.uint64) for r in rows], np.uint64)
        self.keys = self._joined(keys, np.uint64)
        self.checks, self.many = vals >> textnp.U(1), (vals & textnp.U(1)).astype(bool)
        homes = [np.full(n, r["block"], np.int64) if r["kind"] == CELL else textnp.unpack(r["homes"], np.int64) for r, n in zip(rows, sizes, strict=True)]
        self.homes = self._joined(homes, np.int64)
        self.pos = self._joined([textnp.unpack(r["pos"], np.uint32) for r in rows], np.uint32)

    @staticmethod
    def _joined(parts: list[np.ndarray], dtype) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, dtype)

    def run(self, parts: int) -> list[dict]:
        """The RUN rows of these entries: equal ones become one."""
        if not len(self.keys):
            return []
        order, heads, _ = _groups(self.keys, self.checks)
        many = (np.diff(np.append(heads, len(order))) > 1) | np.logical_or.reduceat(self.many[order], heads)
        head = order[heads]
        keys, vals = self.keys[head], (self.checks[head] << textnp.U(1)) | many.astype(np.uint64)
        homes, pos = np.where(many, 0, self.homes[head]), np.where(many, 0, self.pos[head]).astype(np.uint32)
        pack = lambda i, j: {"kind": RUN, "keys": textnp.pack(keys[i:j], delta=True), "vals": textnp.pack(vals[i:j]), "homes": textnp.pack(homes[i:j]), "pos": textnp.pack(pos[i:j])}
        return _cut(keys, parts, pack)


def _merge(new: list[dict], old: list[dict], parts: int) -> list[dict]:
    """The merge join of a key range: places where something repeats (with those of history that do so from now on), and the batch's run."""
    out = [r for r in new if r["kind"] == PLACES]
    mine = _Column([r for r in new if r["kind"] == CELL])
    if not len(mine.keys):
        return out
    past = _Column(old)
    keys, checks = np.concatenate([mine.keys, past.keys]), np.concatenate([mine.checks, past.checks])
    order, heads, group = _groups(keys, checks)
    many = np.concatenate([mine.many, past.many])
    is_new = (order < len(mine.keys)).astype(np.int64)
    total = np.add.reduceat(1 + many[order].astype(np.int64), heads)
    fresh = np.add.reduceat(is_new, heads)
    # places are known where an entry occurred once; of history, those that the batch meets and nothing met before
    before = total - np.add.reduceat(is_new * (1 + many[order].astype(np.int64)), heads)
    told = (total[group] > 1) & ~many[order] & ((is_new == 1) | ((before[group] == 1) & (fresh[group] > 0)))
    hit = order[told]
    block, pos = np.concatenate([mine.homes, past.homes])[hit], np.concatenate([mine.pos, past.pos])[hit]
    by = np.argsort(block, kind="stable")
    block, pos = block[by], pos[by]
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
    out += [_places(int(block[i]), pos[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return out + mine.run(parts)


def merge_join(cells: DataFrame, runs: list[DataFrame], parts: int) -> DataFrame:
    """PLACES and RUN rows of a batch's cells against the historical runs, by key range."""
    grouped = B.by_part(cells, parts).groupBy("part")
    if not runs:
        return grouped.applyInArrow(lambda new: pa.Table.from_batches([_entries(_merge(new.to_pylist(), [], parts))]), ENTRY_SCHEMA)

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        # ranges that the batch does not touch stay packed
        return pa.Table.from_batches([_entries(_merge(new.to_pylist(), old.to_pylist(), parts) if new.num_rows else [])])

    return grouped.cogroup(B.by_part(_union(runs), parts).groupBy("part")).applyInArrow(run, ENTRY_SCHEMA)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a window that begins at one of the places covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, places + window, -1)
    return np.cumsum(step[:-1]) > 0


def ripe(sizes: list[int]) -> bool:
    """Whether the last two runs are to be merged; sizes: the text that each run stands for, oldest first."""
    return len(sizes) > 1 and sizes[-2] <= GROWTH * sizes[-1]


class FingerprintIndex:
    """The index: blocks of documents, runs of anchors and windows, and places found, in one folder (of the shared folder, unless given).

    ``add`` takes a batch and returns the blocks that it changed, old ones included; ``removals`` gives every
    document of all batches so far with its covered words; ``compact`` merges the runs. Files are never changed:
    each step writes new ones and then a manifest.
    """

    def __init__(self, spark: SparkSession, column: str = "text", window: int = WINDOW, parts: int | None = None, path: str | None = None) -> None:
        self.spark, self.column, self.window, self.parts = spark, column, window, parts
        self.path = path or fresh_path(spark, "substring_index")
        self.blocks: list[DataFrame] = []
        self.state = {"step": 0, "bytes": 0, "blocks": [], "anchors": [], "windows": [], "sizes": [], "places": []}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index of a folder as its last manifest names it."""
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(f"{path}/manifest").collect()
        state = max((json.loads(r[0]) for r in rows), key=lambda s: s["step"])
        out = cls(spark, state["column"], state["window"], state["parts"], path)
        out.state = state
        for at, n in state["blocks"]:
            name = f"substring_blocks_{uuid.uuid4().hex[:12]}"
            spark.sql(f"CREATE TABLE {name} (block BIGINT, docs BIGINT, bytes BIGINT, payload BINARY) USING parquet CLUSTERED BY (block) INTO {n} BUCKETS LOCATION '{at}'")
            out.blocks.append(spark.table(name))
        return out

    def _commit(self) -> None:
        self.state |= {"step": self.state["step"] + 1, "column": self.column, "window": self.window, "parts": self.parts}
        text = self.spark.range(1).select(F.lit(json.dumps(self.state)).alias("value")).coalesce(1)
        text.write.text(f"{self.path}/manifest/{self.state['step']:08d}")

    def runs(self, level: str) -> list[DataFrame]:
        return [self.spark.read.schema(ENTRY_SCHEMA).parquet(x).where(f"kind = {RUN}") for x in self.state[level]]

    def _write(self, df: DataFrame, name: str) -> str:
        at = f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(at)
        return at

    def _found(self, at: str) -> DataFrame:
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(at).where(f"kind = {PLACES}").select("block", "pos")

    def add(self, docs: DataFrame, size: int | None = None) -> DataFrame:
        """Append a batch of about `size` bytes of text (counted if not given): (block) of the blocks that got new places, those of older batches included."""
        size = B.text_bytes(docs, self.column) if size is None else size
        want = B.parts_for((self.state["bytes"] + size) // 12, shuffle_partitions(self.spark))
        if self.parts is None:
            self.parts = want
        if want > 2 * self.parts:  # ranges are widened for all runs together, each time for an index of twice the size
            self.parts = want
            self.compact(commit=False)
        while ripe(self.state["sizes"]):
            self._merge_last(2)
        batch, n = len(self.blocks), B.buckets_for(size, BLOCK_BYTES)
        location = f"{self.path}/blocks-{uuid.uuid4().hex[:12]}"
        blocks = B.write_blocks(docs, "substring_blocks", self.column, BLOCK_BYTES, batch, n, location)
        found = self._write(merge_join(anchor_cells(blocks, self.column, self.window, self.parts), self.runs("anchors"), self.parts), "anchors")
        active = self._found(found)
        cells = [window_cells(blocks, n, active.where(F.shiftright("block", 48) == batch), self.column, self.window, self.parts, fresh=True)]
        cells += [window_cells(old, self.state["blocks"][k][1], active.where(F.shiftright("block", 48) == k), self.column, self.window, self.parts, fresh=False) for k, old in enumerate(self.blocks)]
        verified = self._write(merge_join(_union(cells), self.runs("windows"), self.parts), "windows")
        self.blocks.append(blocks)
        self.state["blocks"].append([location, n])
        self.state["bytes"] += size
        for level, at in (("anchors", found), ("windows", verified), ("places", verified)):
            self.state[level].append(at)
        self.state["sizes"].append(size)
        self._commit()
        return self._found(verified).select("block").distinct()

    def _merge_last(self, n: int) -> None:
        """Make one run of the last n of each kind, of all their text: equal entries become one, in ranges of the present width."""
        parts, sizes = self.parts, self.state["sizes"]
        for level in ("anchors", "windows"):
            runs = self.runs(level)[-n:]
            one = B.by_part(_union(runs), parts).groupBy("part").applyInArrow(lambda rows: pa.Table.from_batches([_entries(_Column(rows.to_pylist()).run(parts))]), ENTRY_SCHEMA)
            self.state[level] = [*self.state[level][:-n], self._write(one, level)]
        self.state["sizes"] = [*sizes[:-n], sum(sizes[-n:])]

    def compact(self, commit: bool = True) -> None:
        """Merge all runs of each kind into one."""
        if self.state["sizes"]:
            self._merge_last(len(self.state["sizes"]))
        if commit:
            self._commit()

    def removals(self, emit, schema: str | T.StructType) -> DataFrame:
        """emit(block's table, covered words, word offsets by row) -> pa.Table for every block."""
        column, window = self.column, self.window
        places = _union([self._found(x) for x in self.state["places"]])

        def run(block: pa.Table, found: pa.Table) -> pa.Table:
            at = _positions(found)
            out = []
            for row in block.to_pylist():
                part = B.from_payload(row["payload"])
                rows = textnp.word_rows(*textnp.buffers(part.column(column)))
                out.append(emit(part, covered(int(rows[-1]), at, window), rows))
            return pa.concat_tables(out)

        each = [
            blocks.select("block", "payload").groupBy("block").cogroup(places.where(F.shiftright("block", 48) == k).repartition(self.state["blocks"][k][1], "block").groupBy("block")).applyInArrow(run, schema)
            for k, blocks in enumerate(self.blocks)
        ]
        return _union(each)


def kept_texts(part: pa.Table, column: str, gone: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Of each row the words that stay, joined by one space."""
    out = []
    for i, text in enumerate(part.column(column).to_pylist()):
        words = (text or "").encode().split()
        bad = gone[rows[i] : rows[i + 1]]
        out.append(b" ".join(w for w, b in zip(words, bad.tolist(), strict=True) if not b) if bad.any() else b" ".join(words))
    return out


def indexed(docs: DataFrame, column: str = "text", window: int = WINDOW, batches: int = BATCHES) -> FingerprintIndex:
    """An index of docs that came in batches: every row is in one of them."""
    index = FingerprintIndex(docs.sparkSession, column, window)
    deal = F.pmod(F.xxhash64(*[c for c in docs.columns if c != column] or [column]), F.lit(batches))
    size = B.text_bytes(docs, column) // batches
    for k in range(batches):
        index.add(docs.where(deal == k), size)
    return index


def substring_dedup(docs: DataFrame, column: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated windows removed from the text (untouched texts stay byte for byte), plus n_words, n_removed.

    Columns of docs named n_words or n_removed are replaced.
    """
    docs = docs.drop("n_words", "n_removed")
    index = indexed(docs, column, window)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def emit(part: pa.Table, gone: np.ndarray, rows: np.ndarray) -> pa.Table:
        n_words = np.diff(rows)
        total = np.concatenate([[0], np.cumsum(gone)])
        n_removed = total[rows[1:]] - total[rows[:-1]]
        texts = part.column(column).to_pylist()
        kept = kept_texts(part, column, gone, rows)
        new = [kept[i].decode() if n_removed[i] else texts[i] for i in range(len(texts))]
        part = part.set_column(part.schema.get_field_index(column), part.schema.field(column), pa.array(new, part.schema.field(column).type))
        return part.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))

    return index.removals(emit, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 10: removal of repeated 35-word windows from every document."""
    index = indexed(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def emit(part: pa.Table, gone: np.ndarray, rows: np.ndarray) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(gone)])
        digests = [hashlib.sha256(x).hexdigest() for x in kept_texts(part, "text", gone, rows)]
        return pa.table({"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(rows), pa.int64()), "n_removed": pa.array(total[rows[1:]] - total[rows[:-1]], pa.int64()), "kept_sha256": digests})

    return index.removals(emit, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
h AS (SELECT rid, p, md5(string_agg(w, ' ') OVER f) AS k, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT k FROM h WHERE n = 35 GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(p, p + 35)) AS p FROM h SEMI JOIN r USING (k) WHERE n = 35)),
m AS (SELECT w.rid, w.p, w.w, c.rid IS NOT NULL AS gone FROM w LEFT JOIN c ON w.rid = c.rid AND w.p = c.p),
g AS (SELECT rid, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.rid = g.rid
"""
