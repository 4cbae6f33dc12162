"""Sources and sinks: JSON, JSONL, CSV, text, binary files, lane-partitioned tables, queues with reasons."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset: an own one in local mode, an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="talentloom-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def list_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, length, modificationTime) of files under folder by extension, contents unread."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", "modificationTime")


def read_json_dir(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One JSON object (or array) a file, with its path; broken files come with null fields."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file_path", F.col("_metadata.file_path"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_manifest(spark: SparkSession, path: str, schema: StructType | str, required: list[str]) -> DataFrame:
    """A CSV manifest with a header; fails where a required column is missing or empty."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    bad = rows.where(" or ".join(f"`{c}` is null or trim(`{c}`) = ''" for c in required)).limit(1).count()
    if bad:
        raise ValueError(f"empty required fields in {path}")
    return rows


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, source_path, raw) of whole text files."""
    t = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("raw"))
    return t.withColumn("slug", F.regexp_extract("source_path", r"([^/]+?)(\.[^./]*)?$", 1))


def accepted_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted, eligible, validated entries; and the others with a reason."""
    ok = (F.col("handoff_lane") == "accepted") & F.col("eligible_for_module2") & (F.col("document_status") == "validated")
    reason = F.when(F.col("artifact_path").isNull(), "missing_path").when(F.col("handoff_lane") != "accepted", "wrong_lane").when(~F.col("eligible_for_module2"), "not_eligible").otherwise("not_validated")
    good = F.coalesce(ok & F.col("artifact_path").isNotNull(), F.lit(False))
    return entries.where(good), entries.where(~good).withColumn("reject_reason", reason)


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def extract_texts(files: DataFrame, extractor=docx_text) -> DataFrame:
    """(path, text, error) by a plug-in from bytes to text, one record at a time; a failure fails only its file."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    out.append((path, extractor(content.as_py()), None))
                except Exception as e:  # noqa: BLE001  (reported beside the file)
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in out], "text": pa.array([x[1] for x in out], pa.string()), "error": pa.array([x[2] for x in out], pa.string())})

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str], bom: bool = False) -> None:
    """Fields in a fixed order under a header; bom: the first header starts with U+FEFF."""
    names = [("﻿" if bom and i == 0 else "") + f for i, f in enumerate(fields)]
    df.select(*fields).toDF(*names).write.mode("overwrite").option("header", True).csv(path)


def write_lanes(df: DataFrame, path: str, lane: str) -> DataFrame:
    """The table split by lane, and the lanes' counts."""
    df.write.mode("overwrite").partitionBy(lane).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(lane).count()


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def round_trip(df: DataFrame) -> DataFrame:
    """Through JSONL files and back."""
    path = fresh_path(df.sparkSession, "jsonl")
    df.write.json(path)
    return read_jsonl(df.sparkSession, path, df.schema)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what is trained on again and again is computed once."""
    path = fresh_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_graph(path: str) -> list[tuple[str, list[str], list[str], list[dict]]]:
    """A YAML role graph on the driver: (role, core skills, adjacent skills, transitions) in file order."""
    import yaml

    with open(path, encoding="utf-8") as f:
        payload = yaml.safe_load(f)
    if not isinstance(payload, dict) or not isinstance(payload.get("roles"), list):
        raise ValueError("a role graph needs a list of roles")
    return [(r["role"], list(r.get("core_skills") or []), list(r.get("adjacent_skills") or []), list(r.get("transitions_to") or [])) for r in payload["roles"] if isinstance(r, dict) and r.get("role")]


def first_readable(spark: SparkSession, paths: list[str]) -> tuple[str, DataFrame]:
    """The first path that Spark can read as JSON."""
    for path in paths:
        try:
            return path, spark.read.json(path)
        except Exception:  # noqa: BLE001, S112  (the next is tried; the last resort is below)
            continue
    raise FileNotFoundError(", ".join(paths))


def inventory(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Count and bytes of files (path, length) by the first category whose pattern fits the path."""
    category = F.coalesce(*[F.when(F.col("path").rlike(p), name) for name, p in rules], F.lit("other"))
    return files.groupBy(category.alias("category")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_index(vectors: DataFrame, path: str, key: str, vector: str) -> DataFrame:
    """Vectors next to their keys, and a one-row report."""
    vectors.select(key, vector).write.mode("overwrite").parquet(path)
    back = vectors.sparkSession.read.parquet(path)
    return back.agg(F.count("*").alias("profiles"), F.max(F.size(vector)).alias("dim"), F.count_if(F.col(vector).isNull()).alias("without_vector"))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Vertices and edges as two tables; overwriting is the reset."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    read = edges.sparkSession.read.parquet
    return {"vertices": read(f"{path}/vertices").count(), "edges": read(f"{path}/edges").count()}
