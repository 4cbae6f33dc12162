import base64
import gzip
import hashlib

import pytest

from talentloom.llm import warc as W


@pytest.fixture()
def pages(spark, tmp_path):
    rows = [(i, f"http://x.org/{i}?q=é\r\nX: y", f"<p>{i % 4}</p>" * (1 + i % 4)) for i in range(12)]
    rows += [(20, None, None), (21, "u", ""), (22, "u", "z" * 200_001), (23, "u", "z" * 200_001), (24, "u", "é\r\n\r\nWARC/1.1\r\n"), (24, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>1</p><p>1</p>"), (None, "u", "only here")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    return df, str(tmp_path), rows


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        low = first.get(h or "")
        again = low is not None and low != i and len(data) >= least
        out.append((i, len(data), digest, "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark, pages):
    _, folder, rows = pages
    assert sorted((tuple(r) for r in W.op7_warc(spark, folder).collect()), key=str) == expected(rows)


def test_least_size(pages):
    df, _, rows = pages
    got = W.read_chunks(W.write_chunks(df, least=100)).drop("url", "record_id", "refers_to_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 100)


def test_files_hold_the_same_records(spark, pages, tmp_path):
    df, _, rows = pages
    chunks = W.write_chunks(df)
    folder = "file://" + str(tmp_path / "out")
    sizes = W.export_files(chunks, folder).collect()
    assert all(r["bytes"] > 0 for r in sizes)
    assert sorted((tuple(r) for r in W.read_files(spark, folder).drop("url", "record_id", "refers_to_id").collect()), key=str) == expected(rows)
    raw = (tmp_path / "out").glob("*.warc")
    assert sum(p.read_bytes().count(b"WARC-Record-ID: ") for p in raw) == len(rows)


def test_damage_is_noticed(spark, pages):
    from pyspark.sql import functions as F

    df, _, _ = pages
    chunks = W.write_chunks(df)
    broken = chunks.withColumn("data", F.when((F.col("chunk") == 1) & (F.length("data") > 3), F.concat(F.lit(b"?"), F.substring("data", 2, 1 << 20))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="damaged"):
        W.read_chunks(broken).collect()


def test_chunks_stay_small(pages):
    df, _, _ = pages
    from pyspark.sql import functions as F

    assert W.write_chunks(df).agg(F.max(F.length("data"))).first()[0] <= W.CHUNK


def test_empty(pages):
    assert W.read_chunks(W.write_chunks(pages[0].limit(0))).collect() == []


@pytest.mark.parametrize("lost", ["chunk = 2 AND record = 0", "chunk = 0 AND record = 1", "record = 2 AND chunk > 1"])
def test_lost_chunks_are_an_error(spark, lost):
    rows = [(i, "u", chr(97 + i) * (3 * W.CHUNK)) for i in range(3)]
    chunks = W.write_chunks(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1))
    assert W.read_chunks(chunks).count() == 3
    with pytest.raises(Exception, match="lacks chunks"):
        W.read_chunks(chunks.where(f"NOT ({lost})")).collect()


def record(fields, block, newline="\r\n"):
    head = newline.join(["WARC/1.0", *fields, f"Content-Length:{len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def foreign():
    body = "<p>größer</p>".encode()
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
    return [
        record(["WARC-Type: warcinfo", "WARC-Record-ID:<urn:uuid:0>", "Content-Type: application/warc-fields"], b"software: x\r\n\r\n"),
        record(["WARC-Type: request", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.0\r\n\r\n"),
        record(["warc-type:response", "WARC-Record-ID:<urn:uuid:1>", "WARC-Target-URI:<http://x/a%20b>", "Content-Type:application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"], http + body),
        record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\ncontent-length:3\r\n\r\nabc"),
        record(["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: file:x", "Content-Type: text/html"], body),
        record(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:4>", "WARC-Refers-To: <urn:uuid:1>", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{digest}"], http),
        record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:5>", "Content-Type: application/http"], b""),
    ], digest


def test_files_of_others(spark, tmp_path):
    records, digest = foreign()
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in records))
    rows = W.read_files(spark, "file://" + str(tmp_path)).collect()
    got = sorted((r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to_id"], r["url"]) for r in rows)
    size = len("<p>größer</p>".encode())
    assert len(got) == 10 and got[0] == got[1] == ("<urn:uuid:1>", "response", size, digest, None, "http://x/a%20b")
    assert got[2][:3] == ("<urn:uuid:2>", "response", 3) and got[4] == ("<urn:uuid:3>", "resource", size, digest, None, "file:x")
    assert got[6][:5] == ("<urn:uuid:4>", "revisit", None, digest, "<urn:uuid:1>") and got[8][2] == 0
    assert {r["page_id"] for r in rows} == {None}


@pytest.mark.parametrize("name", ["cut.warc", "cut.warc.gz"])
def test_cut_files_are_an_error(spark, tmp_path, name):
    whole = b"".join(foreign()[0])
    whole = gzip.compress(whole) if name.endswith("gz") else whole
    (tmp_path / name).write_bytes(whole[:-9])
    with pytest.raises(Exception, match="cut off"):
        W.read_files(spark, "file://" + str(tmp_path)).collect()


def test_urls_come_back(pages):
    df, _, rows = pages
    got = sorted(((r["page_id"], r["url"]) for r in W.read_chunks(W.write_chunks(df)).collect()), key=str)
    assert got == sorted(((r[0], r[1]) for r in rows), key=str)


def test_long_payloads_and_extra_columns(spark):
    rows = [(1, "u", "é" * 3_000_000, "x", 1), (2, "u", "é" * 3_000_000, "y", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string, chunk long")
    got = {r["page_id"]: r for r in W.read_chunks(W.write_chunks(df)).collect()}
    assert got[1]["payload_bytes"] == 6_000_000 and got[2]["refers_to"] == 1 and got[1]["payload_digest"] == got[2]["payload_digest"]
