import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talentloom.llm import bpe
from tests.llm.conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_query_matches_the_library(spark, sf, corpus, reference):
    want = []
    for i, t in corpus:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.op6_bpe(spark, sf).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_tree_concatenation_is_exact(reference, seed):
    rng = random.Random(seed)
    alphabet = ["etaoin", "abcdefghijklmnopqrstuvwxyz", "é你ß", "0123456789", "!?.,;", " \n\t"][seed]
    text = "".join(rng.choice(alphabet) for _ in range(4000)) + "x" + rng.choice(alphabet) * 2500
    assert bpe.codec(PATH)._encode_long(text) == reference.encode(text, add_special_tokens=False).ids


def test_long_pieces_are_noticed():
    import pyarrow as pa

    assert bpe.may_be_long(pa.array(["a b", None, "y" * 600, " " * 600, "y" * 300 + " " + "y" * 300])).tolist() == [False, False, True, True, False]


def test_round_trip_and_columns(docs, corpus):
    out = bpe.bpe_encode(docs.withColumnRenamed("lang", "ids"), PATH)
    back = {r["block"]: r["text"] for r in bpe.bpe_decode(out, PATH).collect()}
    assert all(back[k] == (t or "") for k, (_, t) in enumerate(corpus))
    assert out.columns == ["doc_id", "source", "n_chars", "block", "ids", "n_tokens", "decoded_sha256"]


def test_empty_table(empty):
    assert bpe.bpe_encode(empty, PATH).collect() == []


def test_prose_is_text(reference):
    text = prose(200, 5)
    assert bpe.codec(PATH).decode(bpe.codec(PATH).encode(text, False)).decode() == text
