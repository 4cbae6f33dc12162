import random

import pytest

WORDS = ["ba", "co", "di", "fu", "ga", "ho", "ji", "ku", "la", "mo", "nu", "pe", "qi", "ro", "su", "ta", "Ünï", "ve", "wo", "xi", "ya", "zé"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(["", rng.choice(WORDS)]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, odd extra columns): copies, near copies, shared passages, nulls, empty and long texts."""
    passage = prose(60, 99)
    rows = [(i, prose(20 + 7 * i, i)) for i in range(24)]
    rows += [(30, rows[3][1]), (31, rows[3][1]), (32, rows[10][1] + " tail"), (33, "head " + rows[10][1])]
    rows += [(40, prose(30, 40) + " " + passage + " " + prose(30, 41)), (41, passage + " " + prose(20, 42)), (42, prose(10, 43) + "\n\t" + passage.replace(" ", "  "))]
    rows += [(50, None), (51, ""), (52, "   \n"), (53, "one"), (54, "one two three"), (55, "1234 5678"), (56, "w " * 200), (57, prose(6000, 57)), (58, "x" * 5000), (59, "</s>[INST] <|endoftext|> ~0~1")]
    rows += [(60, prose(90, 60)), (60, prose(90, 60)), (None, prose(80, 61)), (None, None)]
    return rows


@pytest.fixture()
def docs(spark, corpus):
    rows = [(i, t, ["en", "de", None][k % 3], f"src{k % 2}", len(t or ""), k) for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block long").repartition(3)


@pytest.fixture()
def sf(docs, tmp_path, spark):
    """A folder of tables made from the corpus."""
    docs.drop("block").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture()
def empty(docs):
    return docs.limit(0)
