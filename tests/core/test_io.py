import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from talentloom.operators import resolve
from talentloom.sources import io
from talentloom.streaming.incremental import process_available


def test_json_csv_text_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"k": 1,\n "s": "x"}')
    assert io.read_json_dir(spark, str(tmp_path / "j"), "k int, s string").first()["k"] == 1
    (tmp_path / "m.csv").write_text("id,path\n1,a\n2,\n")
    with pytest.raises(ValueError):
        io.read_manifest(spark, str(tmp_path / "m.csv"), "id int, path string", ["id", "path"])
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "job_one.txt").write_text("line 1\nline 2")
    assert io.read_texts(spark, str(tmp_path / "t")).first()["slug"] == "job_one"
    assert io.list_files(spark, str(tmp_path), ["csv", "txt"]).count() == 2


def test_docx_and_bad_file(spark, tmp_path):
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>'
    buf = BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = {r["path"][-6:]: r for r in io.extract_texts(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.docx"]["text"] == "Hello"
    assert rows["b.docx"]["error"].startswith("BadZipFile")


def test_lanes_and_rejects(spark, tmp_path):
    rows = spark.createDataFrame([("accepted", True, "validated", "p"), ("accepted", True, "partial", "q"), ("quarantined", False, "failed", None)], "handoff_lane string, eligible_for_module2 boolean, document_status string, artifact_path string")
    good, bad = io.accepted_entries(rows)
    assert good.count() == 1 and {r["reject_reason"] for r in bad.collect()} == {"not_validated", "missing_path"}
    assert {r["handoff_lane"]: r["count"] for r in io.write_lanes(rows, str(tmp_path / "q"), "handoff_lane").collect()} == {"accepted": 2, "quarantined": 1}


def test_csv_sink_with_bom(spark, tmp_path):
    io.write_csv(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "c"), ["a", "b"], bom=True)
    lines = [x for p in (tmp_path / "c").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert list(dict.fromkeys(sorted(lines, reverse=True))) == ["﻿a,b", "x,1"]


def test_stream_skips_what_it_has_seen(spark, tmp_path):
    src, out, ledger = (str(tmp_path / x) for x in ("in", "out", "ledger"))
    spark.range(3).write.parquet(src)
    process_available(spark, src, lambda s: s, out, ledger)
    spark.range(10, 12).write.mode("append").parquet(src)
    process_available(spark, src, lambda s: s, out, ledger)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 10, 11]


def test_resolution_is_greedy_by_priority(spark):
    rows = spark.createDataFrame([(1, "ann", "e1", None), (2, "ann", "e1", "p1"), (3, "ann", None, "p1"), (4, "bob", "e2", None), (5, "zoe", "e2", None)], "id int, name string, email string, phone string")
    got = {r["id"]: r for r in resolve.resolve(rows, [("real_email", "email"), ("real_phone", "phone")], "name", "id").collect()}
    assert got[1]["entity_id"] == got[2]["entity_id"] != got[3]["entity_id"]
    assert got[3]["dedup_status"] == "unique_candidate"
    assert got[4]["dedup_status"] == got[5]["dedup_status"] == "conflict_detected_no_merge"


def test_upsert_keeps_created_at(spark):
    old = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, "b")], "k int, created_at int, updated_at int, v string")
    new = spark.createDataFrame([(2, "B"), (3, None)], "k int, v string")
    got = {r["k"]: (r["v"], r["created_at"], r["updated_at"], r["action"]) for r in resolve.upsert(old, new, "k", F.lit(9)).collect()}
    assert got == {1: ("a", 1, 1, "kept"), 2: ("B", 1, 9, "updated"), 3: (None, 9, 9, "created")}
