import random

from talentloom.operators import benchmarking as M

SIDE = "{0}_id long, path string, text string"


def plain(pairs):
    """Greedy by falling score: the stable matching where both sides share the score."""
    out, used_s, used_t = [], set(), set()
    for s, t, x in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if s not in used_s and t not in used_t:
            out.append((s, t))
            used_s.add(s)
            used_t.add(t)
    return sorted(out)


def test_matching_is_stable(spark):
    rng = random.Random(4)
    for k in range(3):
        pairs = [(s, t, rng.choice([0.25, 0.5, 0.75, 1.0])) for s in range(12) for t in range(10) if rng.random() < 0.5]
        got = M.accepted(spark.createDataFrame(pairs, "source_id long, truth_id long, score double"))
        assert sorted((r["source_id"], r["truth_id"]) for r in got.collect()) == plain(pairs), k


def test_stems_first_then_texts_and_who_stays_alone(spark):
    say = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    common = " this line stands in every text here"
    truths = [(1, "a/CV One.docx", say(1) + common), (2, "a/two.docx", say(2) + common), (3, "a/three.docx", say(3) + common), (4, None, None), (5, "a/five.docx", "short")]
    sources = [(11, "b/cv_one.pdf", "quite other words"), (12, "b/x.png", say(2)[:60]), (13, "b/y.png", say(2) + common), (14, "b/z.png", common), (15, "b/q.png", "SHORT"), (16, None, None)]
    pairs, alone = M.match_samples(spark.createDataFrame(sources, SIDE.format("source")), spark.createDataFrame(truths, SIDE.format("truth")))
    assert sorted((r["source_id"], r["truth_id"], r["method"]) for r in pairs.collect()) == [(11, 1, "stem"), (13, 2, "text"), (15, 5, "text")]
    assert sorted(map(tuple, alone.collect())) == [("source", 12, "taken by others"), ("source", 14, "nothing in common"), ("source", 16, "nothing in common"), ("truth", 3, "nothing in common"), ("truth", 4, "nothing in common")]
    rows = M.manifest(pairs, spark.createDataFrame(sources, SIDE.format("source")), spark.createDataFrame(truths, SIDE.format("truth"))).collect()
    assert ("CV One__cv_one", "pdf") in {(r["sample_id"], r["source_kind"]) for r in rows}


def test_empty_sides(spark):
    none = spark.createDataFrame([], SIDE.format("source")), spark.createDataFrame([(1, "a", "b")], SIDE.format("truth"))
    pairs, alone = M.match_samples(*none)
    assert pairs.collect() == [] and [tuple(r) for r in alone.collect()] == [("truth", 1, "nothing in common")]
