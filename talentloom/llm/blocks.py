"""Blocks and cells: exact corpus-wide counts of n-gram keys without moving texts.

Documents are packed into blocks of a few MB, written once as a table bucketed by
block. Each block sends its sorted distinct 64-bit keys, cut into key ranges
("cells"), to the range's owner; the owner merges the sorted runs of all blocks
and sends one value per key back, in the order received, so no key travels
twice. A key that is very common costs one entry per block, however often it
occurs, and ranges of hashes are even, so no task is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm import textnp
from talentloom.llm.common import bucketed, shuffle_partitions

BLOCK_BYTES = 8 << 20
KEYS_PER_RANGE = 1 << 20
GROW_FROM = 1 << 36
BLOCK_SCHEMA = "block long, docs long, bytes long, payload binary"
CELL_SCHEMA = "part long, block long, keys binary, vals binary"
REPLY_SCHEMA = "part long, block long, vals binary"
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))


def to_payload(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as writer:
        writer.write(batch)
    return sink.getvalue().to_pybytes()


def from_payload(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def slices(batches, column: str, most: int):
    """Cut record batches into tables of about `most` bytes of text (one row at least)."""
    held, size = [], 0
    for batch in batches:
        _, offsets = textnp.buffers(batch.column(column))
        for i, j in textnp.chunks(offsets, most):
            n = int(offsets[j] - offsets[i])
            if held and size + n > most:
                yield pa.Table.from_batches(held).combine_chunks(), size
                held, size = [], 0
            held.append(batch.slice(i, j - i))
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), size


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def buckets_for(size: int, most: int) -> int:
    """Buckets of about two blocks, so that the tasks that read them don't grow with the input."""
    return max(1, -(-size // (2 * most)))


def write_blocks(docs: DataFrame, name: str, column: str = "text", most: int = BLOCK_BYTES, batch: int = 0, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Pack all rows (all columns) into a table of blocks bucketed by block; batch tells apart blocks of later writes."""

    def run(batches):
        first, k = (batch << 48) | (TaskContext.get().partitionId() << 24), 0
        for part, size in slices(batches, column, most):
            yield pa.RecordBatch.from_pydict({"block": [first | k], "docs": [part.num_rows], "bytes": [size], "payload": [to_payload(part)]}, schema=_arrow(BLOCK_SCHEMA))
            k += 1

    return bucketed(docs.mapInArrow(run, BLOCK_SCHEMA), "block", name, buckets, path)


_TYPES = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def growth(size: int) -> int:
    """How many times the least size blocks and ranges have: cells are blocks times ranges, so both grow with the root of the input.

    1 up to GROW_FROM bytes of text, 8 from 64 times that on, where a task needs about 1.5 GB.
    """
    return min(8, max(1, math.isqrt(size // GROW_FROM)))


def parts_for(keys: int, least: int, grown: int = 1) -> int:
    """Key ranges so that an owner holds about KEYS_PER_RANGE keys (grown: times that), whatever the input's size."""
    return max(1, least, -(-keys // (KEYS_PER_RANGE * grown)))


def range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The key range of each key: monotone in the key."""
    return ((keys >> textnp.U(32)) * textnp.U(parts)) >> textnp.U(32)


def cell_rows(block: int, keys: np.ndarray, vals: np.ndarray, parts: int, first: int = 0, shift: int = 0):
    """One batch of cells of a block's sorted distinct keys; vals: one integer per key; the last `shift` bits of keys are zero and not sent."""
    at = range_of(keys, parts) + textnp.U(first)
    keys = keys >> textnp.U(shift)
    cuts = np.flatnonzero(np.diff(at)) + 1
    bounds = [0, *cuts.tolist(), len(keys)] if len(keys) else [0]
    rows = list(zip(bounds[:-1], bounds[1:], strict=True))
    return pa.RecordBatch.from_pydict(
        {
            "part": [int(at[i]) for i, _ in rows],
            "block": [block] * len(rows),
            "keys": [textnp.pack(keys[i:j], delta=True) for i, j in rows],
            "vals": [textnp.pack(vals[i:j]) for i, j in rows],
        },
        schema=_arrow(CELL_SCHEMA),
    )


def merged(cells: pa.Table, dtype, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All keys and vals of a range's cells in key order, the order, and the cells' sizes."""
    keys = [textnp.unpack(x, np.uint64, delta=True) for x in cells.column("keys").to_pylist()]
    vals = [textnp.unpack(x, dtype) for x in cells.column("vals").to_pylist()]
    sizes = [len(x) for x in keys]
    keys, vals = np.concatenate(keys) << textnp.U(shift), np.concatenate(vals)
    order = np.argsort(keys, kind="stable")  # runs are sorted: a merge
    return keys[order], vals[order], order, sizes


def reply(cells: pa.Table, order: np.ndarray, sizes: list[int], vals: np.ndarray) -> pa.Table:
    """vals by key order, sent back to each block in the order it sent its keys."""
    back = np.empty_like(vals)
    back[order] = vals
    ends = np.cumsum(sizes)
    return pa.table(
        {"part": cells.column("part").cast(pa.int64()), "block": cells.column("block").cast(pa.int64()), "vals": pa.array([textnp.pack(back[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())},
        schema=_arrow(REPLY_SCHEMA),
    )


def replies_of(table: pa.Table, dtype) -> np.ndarray:
    """A block's replies put together in the order of its sorted distinct keys."""
    if not table.num_rows:
        return np.zeros(0, dtype)
    table = table.sort_by("part")
    return np.concatenate([textnp.unpack(x, dtype) for x in table.column("vals").to_pylist()])


def by_part(rows: DataFrame, parts: int) -> DataFrame:
    """rows dealt by part, about two ranges a task, so that a range's task does not grow with the input."""
    return rows.repartition(max(shuffle_partitions(rows.sparkSession), parts // 2), "part")


def totals(blocks: DataFrame) -> tuple[int, int]:
    row = blocks.agg(F.sum("docs"), F.sum("bytes")).first()
    return int(row[0] or 0), int(row[1] or 0)
