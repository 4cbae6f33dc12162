"""WARC (operator 7): archives as a table of record chunks.

Every page becomes a WARC/1.1 record. A record is streamed as rows (archive,
record, chunk, data, payload_so_far, digest_so_far): the header is chunk 0 and
the block follows in chunks of ``CHUNK`` bytes, each with the length and the
SHA-1 of the payload up to its end, so that neither writer nor reader
holds more than a chunk beside the source value. The chunks of an archive in order are
a WARC file, which ``export_files`` writes and ``read_files`` reads. ``read_files`` also takes files of
others: compressed ones, records without an HTTP length, records about the crawl (which are no pages and
give no row), and ids that name no page (page_id is null then, record_id has the id as it stands).
A url is written percent-encoded; one that encoding changes also stands, in base64, in a header of its own,
so that it is read back exactly.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is the response and the others are revisits, which keep the HTTP
header and refer to it.

Defined cases: null html is an empty payload; a null url is left out; rows with
a null id are responses unless an equal payload has an id; repeated rows of
the smallest id are all responses; extra columns are ignored; an
empty table gives no records. A record that is cut off, a missing or damaged chunk, or a digest that its payload does not have is an
error, never a missing row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm.common import blank, materialize, table

CHUNK = 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive long, record long, chunk long, data binary, payload_so_far long, digest_so_far string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"
#: Types of records that hold a page; others (warcinfo, request, metadata, conversion, continuation) give no row.
PAGES = ("response", "resource", "revisit")
#: A header that grows beyond this is no header.
MOST_HEADER = 1 << 20
_ARROW = pa.schema([("archive", pa.int64()), ("record", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("payload_so_far", pa.int64()), ("digest_so_far", pa.string())])


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    rows = pages.select("page_id", "url", blank(F.col("html")).alias("html")).withColumn("_key", F.sha1("html"))
    again = rows.where(F.octet_length("html") >= least).groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = again.withColumnRenamed("_key", "_of")
    joined = rows.join(again, rows["_key"] == again["_of"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")).alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_parts(page_id, url, payload, refers_to):
    """(bytes, payload length so far, payload SHA-1 so far) of a record's header and block chunks."""
    whole = hashlib.sha1()
    for i in range(0, len(payload), CHUNK):
        whole.update(payload[i : i + CHUNK])
    digest = base32(whole)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        written = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")
        lines.append("WARC-Target-URI: " + written)
        if written != url:
            lines.append("X-Source-URL: " + base64.b64encode(url.encode()).decode())
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    length = len(http) + (0 if revisit else len(payload))
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    sha, sent = hashlib.sha1(), 0
    yield "\r\n".join(lines).encode() + http, 0, sha
    if not revisit:
        for i in range(0, len(payload), CHUNK):
            data = payload[i : i + CHUNK]
            sha.update(data)
            sent += len(data)
            yield bytes(data), sent, sha
    yield b"\r\n\r\n", sent, sha


def write_chunks(pages: DataFrame, least: int = 0, name: str = "warc") -> DataFrame:
    """Write the archives of pages (one for each writing task) as a chunk table and return it."""

    def run(batches):
        archive, record = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, url, refers_to = row[0].as_py(), row[1].as_py(), row[3].as_py()
                payload = memoryview(row[2].as_buffer())
                for k, (data, sent, sha) in enumerate(record_parts(page_id, url, payload, refers_to)):
                    held.append((archive, record, k, data, sent, base32(sha)))
                    size += len(data)
                    if size >= 32 * CHUNK:
                        yield _batch(held)
                        held, size = [], 0
                record += 1
        if held:
            yield _batch(held)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return materialize(planned(pages, least).mapInArrow(run, CHUNKS), name)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _page(uri: str | None) -> int | None:
    """The page of one of our own record ids."""
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", uri or "")
    return int(found[1]) if found else None


class _Reader:
    """One record at a time, from pieces of its bytes; of the block no more than a piece is held."""

    def __init__(self) -> None:
        self.head, self.fields, self.sha, self.n = b"", None, hashlib.sha1(), 0
        self.http: bytes | None = None
        self.left, self.length, self.tail, self.coded = 0, None, b"", False

    def feed(self, data: bytes) -> bytes:
        """Take a piece; return what lies behind the record's end."""
        if self.fields is None:
            self.head += data
            cut = self.head.find(b"\r\n\r\n")
            if cut < 0:
                if len(self.head) > MOST_HEADER:
                    raise ValueError("no header of a record")
                return b""
            if not self.head.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            self.fields, data, self.head = _fields(self.head[:cut]), self.head[cut + 4 :], b""
            self.left = int(self.fields["content-length"])
            kind = self.fields.get("content-type", "").replace(" ", "").lower()
            self.http = b"" if kind.startswith("application/http") else None
        block, data = data[: self.left], data[self.left :]
        self.left -= len(block)
        if self.http is not None:  # the HTTP header is not over yet
            self.http += block
            end = re.search(rb"\r?\n\r?\n", self.http)
            block = b""
            if end or not self.left:
                head = self.http[: end.end() if end else None]
                stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
                self.coded = re.search(rb"(?im)^transfer-encoding:", head) is not None
                self.length = int(stated[1]) if stated else None
                block = self.http[end.end() :] if end else b""
                self.http = None
            elif len(self.http) > MOST_HEADER:
                raise ValueError("no HTTP header in a block")
        self.sha.update(block)
        self.n += len(block)
        if not self.left:
            need = 4 - len(self.tail)  # the record ends with two line ends
            self.tail, data = self.tail + data[:need], data[need:]
            if self.tail != b"\r\n\r\n"[: len(self.tail)]:
                raise ValueError(f"damaged record {self.fields.get('warc-record-id')}")
        return data

    @property
    def begun(self) -> bool:
        return bool(self.head) or self.fields is not None

    @property
    def done(self) -> bool:
        return self.fields is not None and not self.left and len(self.tail) == 4

    def row(self) -> tuple | None:
        """The record of a page, or None of another kind of record."""
        f = self.fields
        kind = f.get("warc-type", "").lower()
        if kind not in PAGES:
            return None
        revisit = kind == "revisit"
        stated = f.get("warc-payload-digest", "").removeprefix("sha1:").upper() or None
        if stated and ":" in stated:
            stated = None  # of another hash
        own = base32(self.sha)
        short = self.length is not None and self.n < self.length and not self.coded and "warc-truncated" not in f
        # a digest of a payload sent in pieces may be that of the payload put together
        if not revisit and (short or (stated and own != stated and not self.coded)):
            raise ValueError(f"damaged record {f.get('warc-record-id')}")
        url = f.get("warc-target-uri")
        if "x-source-url" in f:
            url = base64.b64decode(f["x-source-url"]).decode()
        elif url:
            url = url.removeprefix("<").removesuffix(">")
        size = self.length if revisit else self.n
        return (_page(f.get("warc-record-id")), url, size, stated if revisit else own, kind, _page(f.get("warc-refers-to")), f.get("warc-record-id"), f.get("warc-refers-to"))


_ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def read_chunks(chunks: DataFrame) -> DataFrame:
    """The records of a chunk table, checked chunk by chunk against the running digests."""
    ordered = chunks.repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")

    def run(batches):
        reader, due, out = _Reader(), 0, []
        for batch in batches:
            for chunk, data, sent, digest in zip(*(batch.column(c).to_pylist() for c in ("chunk", "data", "payload_so_far", "digest_so_far")), strict=True):
                if chunk != due:
                    raise ValueError("a record lacks chunks")
                rest, due = reader.feed(data), due + 1
                if rest or reader.n != sent or base32(reader.sha) != digest:
                    raise ValueError("damaged chunk")
                if reader.done:
                    out.append(reader.row())
                    reader, due = _Reader(), 0
                    if len(out) == 4096:
                        yield _rows(out)
                        out = []
        if reader.begun:
            raise ValueError("a record lacks chunks")
        if out:
            yield _rows(out)

    return ordered.mapInArrow(run, RECORDS)


def export_files(chunks: DataFrame, folder: str) -> DataFrame:
    """Write each archive as folder/archive-N.warc (any URI that pyarrow's file systems know); (path, bytes)."""
    ordered = chunks.repartition("archive").sortWithinPartitions("archive", "record", "chunk")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        now, stream, done = None, None, []

        def close():
            stream.close()
            path = f"{base}/archive-{now:06d}.warc"
            fs.move(f"{path}.{attempt}", path)  # a lost attempt leaves no half file under the name
            done.append((path, fs.get_file_info(path).size))

        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if archive != now:
                    if stream:
                        close()
                    now, stream = archive, fs.open_output_stream(f"{base}/archive-{archive:06d}.warc.{attempt}")
                stream.write(data)
        if stream:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in done], pa.string()), "bytes": pa.array([x[1] for x in done], pa.int64())})

    return materialize(ordered.mapInArrow(run, "path string, bytes long"), "warc_files")


def _pieces(fs, path: str):
    """The bytes of a file in pieces, unpacked member by member if it is compressed."""
    with fs.open_input_stream(path, compression=None) as f:
        if not path.endswith(".gz"):
            while data := f.read(CHUNK):
                yield data
            return
        member, open_ = zlib.decompressobj(31), False
        while data := f.read(CHUNK):
            while data:
                open_ = True
                # at most a chunk at once, however well the member is packed
                while (out := member.decompress(data, CHUNK)) or member.unconsumed_tail:
                    yield out
                    data = member.unconsumed_tail
                data = member.unused_data
                if member.eof:
                    member, open_ = zlib.decompressobj(31), False
                else:
                    break
        if open_:
            raise ValueError(f"{path} is cut off")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The pages' records of the .warc and .warc.gz files of a folder, one task a file, streamed in chunks."""
    fs, base = pafs.FileSystem.from_uri(folder)
    paths = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.path.endswith((".warc", ".warc.gz")))
    files = spark.createDataFrame([(x,) for x in paths], "path string").repartition(max(1, len(paths)))

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out, reader = [], _Reader()
                for data in _pieces(fs, path):
                    while data:
                        data = reader.feed(data)
                        if reader.done:
                            if (row := reader.row()) is not None:
                                out.append(row)
                            reader = _Reader()
                            if len(out) == 4096:
                                yield _rows(out)
                                out = []
                if reader.begun:
                    raise ValueError(f"{path} is cut off")
                if out:
                    yield _rows(out)

    return files.mapInArrow(run, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 7: write all pages as WARC chunks and read the archives back."""
    return read_chunks(write_chunks(table(spark, sf_dir, "pages"))).drop("url", "record_id", "refers_to_id")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', h[i])]), '') AS bits FROM p),
f AS (SELECT h, min(page_id) AS first, count(*) AS n FROM p GROUP BY h)
SELECT b.page_id, CAST(octet_length(encode(b.html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 5 * i + 1, 1) AS INT) * 16 + CAST(substr(bits, 5 * i + 2, 1) AS INT) * 8 + CAST(substr(bits, 5 * i + 3, 1) AS INT) * 4 + CAST(substr(bits, 5 * i + 4, 1) AS INT) * 2 + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN n > 1 AND first IS DISTINCT FROM b.page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND first IS DISTINCT FROM b.page_id THEN first END AS refers_to
FROM b JOIN f ON b.h = f.h
"""
