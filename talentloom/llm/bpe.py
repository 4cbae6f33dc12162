"""BPE encoding and decoding (operator 6) with tree concatenation of long unsplit text.

Ordinary pieces (a word, a number, a run of signs or of white space, by the
byte-level pattern) are encoded directly. A piece of over ``LEAF`` bytes is cut
into halves down to leaves, which are encoded in parallel; neighbours are then
joined bottom-up: a window of tokens around the join is encoded anew and grown
until its first token is the one that the left side had there and its last the
one that the right side had. A sequence is the encoding of its bytes exactly if
each pair of neighbours is, so the joined sequence is exact.

The vocabulary file's path is a parameter; nothing is copied or trained.

Defined cases: null text is empty and has no tokens; a special token's string in
a text is that token; repeated rows are encoded each; extra columns pass
through; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.llm import blocks as B
from talentloom.llm import textnp
from talentloom.llm.common import table

LEAF = 512
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            out[chr(n)] = b
            n += 1
    return out


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        at = _byte_of()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(at[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.one = self.core._encode_single_piece
        self.bytes_of = self.core.decode_bytes

    def encode(self, text: str, long: bool) -> list[int]:
        """long: whether some piece may be over LEAF bytes."""
        return self._encode_long(text) if long else self.core.encode(text, allowed_special="all")

    def _encode_long(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            for m in self.split.finditer(part):
                piece = m[0].encode("utf-8", "surrogatepass")
                out += self.one(piece) if len(piece) <= LEAF else self.tree(piece)
        return out

    def tree(self, piece: bytes) -> list[int]:
        leaves = [piece[i : i + LEAF] for i in range(0, len(piece), LEAF)]
        with ThreadPoolExecutor(2) as pool:
            level = list(pool.map(self.one, leaves))
            while len(level) > 1:
                pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
                level = [*pool.map(lambda x: self.join(*x), pairs), *level[len(pairs) * 2 :]]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.one(self.bytes_of(left[i:] + right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8; bytes that are no text become U+FFFD."""
        raw = self.bytes_of(ids)
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def may_be_long(column: pa.Array) -> np.ndarray:
    """Rows with a stretch of over LEAF - 1 bytes without, or of, white space: only they can have a long piece."""
    data, offsets = textnp.buffers(column)
    out = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return out
    edge = np.zeros(len(data), bool)
    space = textnp.IS_SPACE[data]
    edge[1:] = space[1:] != space[:-1]
    starts = offsets[:-1]
    edge[starts[starts < len(data)]] = True
    at = np.flatnonzero(edge)
    long = at[np.diff(at, append=len(data)) >= LEAF - 1]
    out[np.searchsorted(offsets, long, side="right") - 1] = True
    return out


def _over(docs: DataFrame, column: str, keep: list[str], fields: list[T.StructField], path: str, make) -> DataFrame:
    """keep's columns and what make(ids, decoded) gives for each text."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    names = [f.name for f in fields]

    def run(batches):
        use = codec(path)
        for piece, _ in B.slices(batches, column, 2 << 20):
            texts = piece.column(column)
            out = []
            for x, long in zip(texts, may_be_long(texts).tolist(), strict=True):
                ids = use.encode(x.as_py() or "", long)
                out.append(make(ids, use.decode(ids)))
            kept = piece.select(keep)
            types = [pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in fields]
            cols = [pa.array([row[k] for row in out], t) for k, t in enumerate(types)]
            yield from pa.Table.from_arrays([*kept.columns, *cols], names=[*keep, *names]).combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs without the text, with ids, n_tokens and the decoded text's digest. Columns of these names are replaced."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())]
    keep = [c for c in docs.columns if c not in (column, "ids", "n_tokens", "decoded_sha256")]
    return _over(docs.select(*keep, column), column, keep, fields, path, lambda ids, text: (ids, len(ids), hashlib.sha256(text).hexdigest()))


def bpe_decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """encoded with the column text, decoded from ids (null ids: empty text)."""
    keep = [c for c in encoded.columns if c != "text"]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches):
        use = codec(path)
        for batch in batches:
            texts = [use.decode(x.as_py() or []).decode() for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 6: token counts and digests of ids and decoded text of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(ids, text):
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

    return _over(docs, "text", ["doc_id"], fields, public_tokenizers.path("byte_bpe_50k.json"), make)
