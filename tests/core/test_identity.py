"""Identity keys, best sources, penalties, kinds of documents and labels against hand-computed and brute-force expectations."""

import random

import pytest
from pyspark.sql import functions as F

from talentloom.functions import quality
from talentloom.operators import identity as I

C = F.col


@pytest.mark.parametrize(
    ("path", "fmt", "kind", "doc"),
    [("a/scans/pdf/x.docx", "pdf", "cv", "pdf:x"), ("PDF/a/Images/b.v1.pdf", "images", "cv", "images:b.v1"), ("fiches_poste/c.BMP", "images", "job_description", "images:c"), ("jobs", "unknown", "job_description", "unknown:jobs"),
     ("a.pdf/x", "unknown", "cv", "unknown:x"), ("a/.pdf", "unknown", "cv", None), ("", "unknown", "cv", "unknown:"), ("docx/x", "docx", "cv", "docx:x")],
)
def test_places(spark, path, fmt, kind, doc):
    row = spark.createDataFrame([(path,)], "p string").select(quality.source_format(C("p")).alias("f"), I.document_type(C("p")).alias("k")).first()
    assert (row["f"], row["k"]) == (fmt, kind)
    if doc:
        assert spark.createDataFrame([(path,)], "p string").select(I.document_id(quality.source_format(C("p")), C("p")).alias("d")).first()["d"] == doc


@pytest.mark.parametrize(
    ("row", "key", "sure"),
    [((" A@X.org ", "Ann", "123456", "Tunis"), "email:a@x.org", 1.0), ((None, "Ann  O'Hara-", "+21 (6) 123", "Tunis"), "name_phone:ann-o-hara|216123", 0.9), (("", "Ann", "12345", "Tunis, TN"), "name_location:ann|tunis-tn", 0.7),
     ((None, "Ann", None, " - "), "document:pdf:d", 0.3), ((None, None, "123456789", "Tunis"), "document:pdf:d", 0.3), ((None, "é", "1234567", None), "document:pdf:d", 0.3)],
)
def test_identity(spark, row, key, sure):
    df = spark.createDataFrame([row], "e string, n string, p string, l string")
    got = df.select(I.candidate_identity(C("e"), C("n"), C("p"), C("l"), F.lit("pdf:d")).alias("k")).first()["k"]
    assert (got["key"], got["confidence"], got["ambiguous"]) == (key, sure, sure < 0.5)


def test_best_sources_with_a_hot_candidate(spark):
    rng = random.Random(3)
    formats = ["docx", "PDF", "images", "scan", "odd", None]
    rows = [(rng.choice(["hot", "hot", "b", "c"]), f"d{i}", rng.choice(formats), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([None, " ", "x", "y"]), None if i % 2 else str(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, doc string, fmt string, conf double, mail string, phone string")
    got = {(r["k"], r["field"]): r for r in I.best_sources(df, "k", ["mail", "phone"], "doc", "fmt", "conf").collect()}
    rank = lambda f: I.FORMAT_PRIORITY.get((f or "").lower(), I.UNKNOWN_PRIORITY)
    want = {}
    for k, doc, fmt, conf, *values in rows:
        for field, value in zip(("mail", "phone"), values, strict=True):
            if value and value.strip():
                want.setdefault((k, field), []).append((rank(fmt), -(conf or 0.0), doc, value))
    assert got.keys() == want.keys()
    for key, them in want.items():
        best = min(them)
        assert (got[key]["document"], got[key]["value"], got[key]["n_sources"], got[key]["confidence"]) == (best[2], best[3], len(them), -best[1])
    assert I.best_sources(df.limit(0), "k", ["mail"], "doc", "fmt", "conf").count() == 0


def test_penalty_and_status(spark):
    rows = [(True, True, True, I.SECONDARY_PARSER, "uncertain", False, 0.13, "uncertain"), (False, False, False, "other", "partial", False, 0.0, "validated"), (None, True, None, None, "validated", True, 0.02, "partial"), (True, False, True, None, "partial", True, 0.06, "partial")]
    df = spark.createDataFrame(rows, "s boolean, o boolean, f boolean, p string, st string, r boolean, want double, status string")
    got = df.select(I.route_penalty(C("s"), C("o"), C("f"), C("p")).alias("loss"), I.settled_status(C("st"), C("r")).alias("got"), "want", "status").collect()
    assert all((r["loss"], r["got"]) == (r["want"], r["status"]) for r in got)


def test_labels(spark):
    raw = [" - Spark |  SQL ; ", "spark sql", "C / C++", "Big Data", "ETL tools", "R", None, "", "Motivated", "not there", "team work"]
    df = spark.createDataFrame([(raw, "Spark-SQL, c/c++, big data and ETL tools; R. Motivated TEAM WORK")], "l array<string>, t string").withColumn("k", I.match_key(C("t")))
    row = df.select(I.clean_skills(C("l"), C("k"), True).alias("h"), I.clean_skills(C("l"), C("k"), False).alias("s"), I.skill_label(F.lit("C / C++.")).alias("one")).first()
    assert row["one"] == "C/C++"
    assert row["h"] == ["Spark SQL", "Motivated", "team work"]
    assert row["s"] == ["Spark SQL", "Big Data", "ETL tools", "team work"]
    none = spark.createDataFrame([(None, None)], "l array<string>, t string").select(I.clean_skills(C("l"), I.match_key(C("t")), True).alias("h")).first()
    assert none["h"] == []
