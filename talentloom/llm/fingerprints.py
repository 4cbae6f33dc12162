"""Document fingerprints (operator 1) by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing: runs of equal symbols
merge, each symbol is labelled by the lowest bit in which it differs from its
left neighbour, four rounds leave six labels, and phrases begin at local maxima
of the labels. A phrase's name is a hash of its symbols, and the names are parsed
again, level by level. Whether a phrase begins at a place depends on a few
symbols around it only, so equal substrings share their interior phrases
wherever they stand.

A fingerprint keeps, for each of 64 classes of phrase names of the levels in
``LEVELS``, the least name (16 bits). The likeness of two fingerprints is the share
of classes on which they agree, which estimates the Jaccard similarity of the
texts' phrase sets.

Defined cases: null text is empty, an empty text has the empty fingerprint (all
classes empty), and two empty fingerprints have likeness 1; rows of equal id
are ordered by text, null ids come last; extra columns are ignored by the
query; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import blocks as B
from talentloom.llm import textnp
from talentloom.llm.common import blank, table

U = textnp.U
LEVELS = (2, 3)
CLASSES = 64
EMPTY = 0xFFFF
PART_BYTES = 16 << 20
CHUNK_CHARS = 1 << 19
_CODE = textnp.mix(np.arange(1 << 16, dtype=np.uint64) + U(0x632BE59BD9B4E019))
_LOW = np.array([8 if x == 0 else (x & -x).bit_length() - 1 for x in range(256)], np.uint8)


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5; neighbours differ."""
    x = np.empty_like(symbols)
    x[1:] = symbols[1:] ^ symbols[:-1]
    x[first] = U(1)  # as if the symbol before differed in the lowest bit
    low = np.minimum(np.bitwise_count((x & (~x + U(1))) - U(1)), 63).astype(np.uint8)
    label = (low << 1) | ((symbols >> low) & U(1)).astype(np.uint8)
    for _ in range(3):
        y = np.empty_like(label)
        y[1:] = label[1:] ^ label[:-1]
        y[first] = 1
        low = _LOW[y]
        label = (low << 1) | ((label >> low) & 1)
    return label


def _parse(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: phrase names and offsets by text (offsets only of texts that aren't empty)."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = symbols[1:] != symbols[:-1]
    keep[offsets[:-1]] = True
    at = np.flatnonzero(keep)
    if len(at) < len(symbols):
        run = np.diff(at, append=len(symbols)).astype(np.uint64)
        symbols = symbols[at]
        long = run > 1
        symbols[long] = textnp.mix(symbols[long] ^ (run[long] * U(0x8CB92BA72F3D8DD7)))
        offsets = np.searchsorted(at, offsets)
    first = offsets[:-1]
    label = _toss(symbols, first)
    start = np.zeros(len(symbols), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = offsets[1:] - 1
    start[last] = False  # the end of a text is no place to begin
    start[first] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(symbols))
    return textnp.span_sums(symbols, starts, ends, 2), np.searchsorted(starts, offsets)


def phrases(texts: list[str], levels: tuple[int, ...] = LEVELS):
    """For each level: (phrase names, the text of each). Texts must not be empty."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    symbols = _CODE[codes & 0xFFFF]
    wide = codes > 0xFFFF
    if wide.any():
        symbols[wide] = textnp.mix(codes[wide].astype(np.uint64))
    for level in range(1, max(levels) + 1):
        symbols, offsets = _parse(symbols, offsets)
        if level in levels:
            yield symbols ^ U(level), np.repeat(np.arange(len(texts)), np.diff(offsets))


def fingerprints(texts: list[str]) -> np.ndarray:
    """(len(texts), CLASSES) uint16, EMPTY where no phrase falls into the class."""
    out = np.full((len(texts), CLASSES), EMPTY, np.uint16)
    some = [i for i, x in enumerate(texts) if x]
    done = 0
    while done < len(some):
        size, n = 0, done
        while n < len(some) and (n == done or size + len(texts[some[n]]) <= CHUNK_CHARS):
            size += len(texts[some[n]])
            n += 1
        rows = np.array(some[done:n])
        flat = out.reshape(-1)
        for names, of in phrases([texts[i] for i in some[done:n]]):
            h = textnp.mix(names)
            place = rows[of] * CLASSES + (h >> U(58)).astype(np.int64)
            value = ((h >> U(20)) % U(EMPTY)).astype(np.uint16)
            np.minimum.at(flat, place, value)
        done = n
    return out


def as_string(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; the share of classes filled on either side that agree, 1 if none is filled."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_PART = "part int, payload binary"
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LAST = -(2**63)  # stands for null, which comes last


def _ids(batch) -> np.ndarray:
    return batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)


def with_next(docs: DataFrame, part_bytes: int = PART_BYTES):
    """Deal (doc_id, text) out by ranges of descending id, each range followed by its next row.

    Returns a DataFrame of (part, payload) with one task per range, and a reader that turns a
    task's payloads into ids and texts in order, the last being the next range's first row.
    The driver sees range borders only. Texts cross the network once, compressed.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    n = max(1, int(-(-total // part_bytes)))
    borders = np.unique(docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []).astype(np.float64)
    count = len(borders) + 1

    def part_of(ids: np.ndarray) -> np.ndarray:
        return count - 1 - np.searchsorted(borders, ids.astype(np.float64), side="right")

    def tops(batches):
        for batch in batches:
            ids = _ids(batch)
            part = part_of(ids)
            for p in np.unique(part).tolist():
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "top": pa.array([int(ids[part == p].max())], pa.int64())})

    found = docs.select("doc_id").mapInArrow(tops, "part int, top long").groupBy("part").agg(F.max("top").alias("top")).collect()
    top = {r["part"]: r["top"] for r in found}  # one number per range
    used = sorted(top)
    halo_of = {top[p]: used[i - 1] for i, p in enumerate(used)}  # the first range's top follows the last

    def deal(batches):
        for piece, _ in B.slices(batches, "text", 4 << 20):
            ids = _ids(piece.combine_chunks())
            part = part_of(ids)
            for p in np.unique(part).tolist():
                yield _row(p, piece.filter(pa.array(part == p)), False)
            for i in np.flatnonzero(np.isin(ids, list(halo_of))).tolist():
                yield _row(halo_of[int(ids[i])], piece.slice(i, 1), True)

    def _row(p: int, rows: pa.Table, halo: bool) -> pa.RecordBatch:
        rows = rows.append_column("halo", pa.array([halo] * rows.num_rows))
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([B.to_payload(rows.combine_chunks())], pa.binary())], names=["part", "payload"])

    def read(payloads: list[bytes]) -> tuple[list, list[str], int]:
        """Ids and texts in order with one halo row at the end, and the number without it."""
        rows = pa.concat_tables([B.from_payload(x) for x in payloads])
        halo = rows.column("halo").to_numpy(zero_copy_only=False)
        order = {}
        for what in (False, True):
            mine = rows.filter(pa.array(halo == what))
            pairs = list(zip(_ids(mine.combine_chunks()).tolist(), mine.column("doc_id").to_pylist(), [x or "" for x in mine.column("text").to_pylist()], strict=True))
            pairs.sort(key=lambda x: (-x[0], x[2]))
            order[what] = pairs
        pairs = order[False] + order[True][:1]
        return [x[1] for x in pairs], [x[2] for x in pairs], len(order[False])

    return docs.select("doc_id", "text").mapInArrow(deal, _PART).repartitionById(count, F.col("part")), read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 1: fingerprints of all documents and of their edited texts, with likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", blank(F.col("text")).alias("text"))
    dealt, read = with_next(docs)

    def run(batches):
        payloads = [x for batch in batches for x in batch.column("payload").to_pylist()]
        if not payloads:
            return
        ids, texts, n = read(payloads)
        del payloads
        step = 1024
        for i in range(0, n, step):
            j = min(i + step, n)
            own = texts[i : j + 1]
            new = [edited(a, b) for a, b in zip(own[:-1], own[1:], strict=True)]
            prints, other = fingerprints(own), fingerprints(new)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids[i:j], pa.int64()),
                    "n_chars": pa.array([len(x) for x in own[:-1]], pa.int64()),
                    "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new],
                    "fingerprint": [as_string(x) for x in prints[:-1]],
                    "edited_fingerprint": [as_string(x) for x in other],
                    "near_edited": likeness(prints[:-1], other),
                    "near_next": likeness(prints[:-1], prints[1:]),
                }
            )

    return dealt.mapInArrow(run, _OUT)
