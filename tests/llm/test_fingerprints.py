import hashlib

import numpy as np

from talentloom.llm import fingerprints as P
from talentloom.llm import textnp
from tests.llm.conftest import prose


def test_query_matches_brute_force(spark, sf, corpus):
    rows = [(i, t or "") for i, t in corpus]
    rows.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        new = P.edited(t, after)
        a, b, c = (P.fingerprints([x])[0] for x in (t, new, after))
        like = lambda x, y: float(P.likeness(x[None], y[None])[0])
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), P.as_string(a), P.as_string(b), like(a, b), like(a, c)))
    got = [tuple(r) for r in P.op1_fingerprints(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_many_small_ranges(spark, docs, corpus):
    from pyspark.sql import functions as F

    dealt, read = P.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), part_bytes=2000)

    def run(batches):
        import pyarrow as pa

        payloads = [x for b in batches for x in b.column("payload").to_pylist()]
        if payloads:
            ids, texts, n = read(payloads)
            yield pa.RecordBatch.from_pydict({"a": texts[:n], "b": texts[1:]})

    got = sorted(tuple(r) for r in dealt.mapInArrow(run, "a string, b string").collect())
    rows = sorted(((i, t or "") for i, t in corpus), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    texts = [t for _, t in rows]
    assert got == sorted(zip(texts, texts[1:] + texts[:1], strict=True))


def test_equal_substrings_share_interior_phrases():
    inner = prose(300, 1)
    parts = [dict.fromkeys(next(iter(P.phrases([pre + inner + post], (3,))))[0].tolist()) for pre, post in (("", ""), ("zz top ", " end"), (prose(50, 2), prose(9, 3)))]
    base = set(parts[0])
    for other in parts[1:]:
        assert len(base - set(other)) <= 8


def test_likeness_orders_edits():
    text, other = prose(500, 7), prose(500, 8)
    prints = P.fingerprints([text, text + " x", P.edited(text, other), other])
    near = [float(P.likeness(prints[:1], prints[i : i + 1])[0]) for i in range(4)]
    assert near[0] == 1.0 and near[1] > 0.9 and 0.3 < near[2] < 0.7 and near[3] < 0.2


def test_labels_differ_between_neighbours():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    label = P._toss(x, np.array([0, 100, 2000]))
    inside = np.ones(len(x), bool)
    inside[[0, 100, 2000]] = False
    assert label.max() <= 5 and (label[1:] != label[:-1])[inside[1:]].all()


def test_runs_and_empty():
    prints = P.fingerprints(["", "a", "a" * 9000, "a" * 9001, "ab" * 4000])
    assert P.likeness(prints[:1], prints[:1])[0] == 1.0
    assert len({P.as_string(x) for x in prints}) == 5


M = 2**64


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % M
    return x ^ (x >> 31)


def plain_parse(symbols):
    """One level in plain Python: runs, four tosses, phrases from local maxima, names by a polynomial of symbols."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    symbols = [s if n == 1 else plain_mix(s ^ (n * 0x8CB92BA72F3D8DD7 % M)) for s, n in runs]
    label = symbols
    for _ in range(4):
        out = []
        for i, s in enumerate(label):
            other = label[i - 1] if i else s ^ 1
            low = ((s ^ other) & -(s ^ other)).bit_length() - 1
            out.append(low << 1 | s >> low & 1)
        label = out
    assert all(a != b for a, b in zip(label[1:], label, strict=False)) and max(label) <= 5
    starts = [0] + [i for i in range(1, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]]
    names = []
    for a, b in zip(starts, [*starts[1:], len(symbols)], strict=True):
        names.append(plain_mix(sum(s * pow(textnp.BASES[2], k, M) for k, s in enumerate(symbols[a:b])) % M))
    return names


def plain_fingerprint(text):
    least = [0xFFFF] * 64
    symbols = [plain_mix((ord(c) + 0x632BE59BD9B4E019) % M) if ord(c) < 1 << 16 else plain_mix(ord(c)) for c in text]
    for level in range(1, 4):
        symbols = plain_parse(symbols) if symbols else []
        if level > 1:
            for name in symbols:
                h = plain_mix(name ^ level)
                least[h >> 58] = min(least[h >> 58], (h >> 20) % 0xFFFF)
    return "".join(f"{x:04x}" for x in least)


def test_query_matches_a_plain_parser(spark, sf, corpus):
    """Every column from code of its own: order of ids, edits, fingerprints and likeness."""
    rows = [(i, t or "") for i, t in corpus]
    rows.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []

    def like(a, b):
        a, b = ([x[k : k + 4] for k in range(0, 256, 4)] for x in (a, b))
        filled = [(x, y) for x, y in zip(a, b, strict=True) if x != "ffff" or y != "ffff"]
        return sum(x == y for x, y in filled) / len(filled) if filled else 1.0

    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        a, b, c = map(plain_fingerprint, (t, new, after))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, round(like(a, b), 12), round(like(a, c), 12)))
    got = [(*r[:5], round(r[5], 12), round(r[6], 12)) for r in map(tuple, P.op1_fingerprints(spark, sf).collect())]
    assert sorted(got, key=str) == sorted(want, key=str)
