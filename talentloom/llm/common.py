"""Shared plumbing: table access, the shared folder, and cut-lineage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own limit of buckets a table may have.
MOST_BUCKETS = 100_000
_own: dict[str, str] = {}
_made: dict[str, list[tuple[str, str | None]]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset: an own one in local mode, an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    return _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="talentloom-"))


def fresh_path(spark: SparkSession, name: str, ident: str | None = None) -> str:
    path = f"{shared_dir(spark)}/{ident or f'{name}-{uuid.uuid4().hex[:12]}'}"
    _made.setdefault(spark.sparkContext.applicationId, []).append((path, ident))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def made(spark: SparkSession) -> int:
    """How many intermediate tables of this application there are: a mark for clean."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete this application's intermediate tables, those made after the mark `since` without the last `keep`; results that still read them must have been written before."""
    tables = _made.get(spark.sparkContext.applicationId, [])
    end = len(tables) - keep
    for path, ident in tables[since:end]:
        if ident:
            spark.sql(f"DROP TABLE IF EXISTS {ident}")
        delete_path(spark, path)
    if since < end:
        del tables[since:end]


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with more underscores in front where df has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, n: int | None = None, path: str | None = None) -> DataFrame:
    """Like materialize, in n buckets by key so that later grouping by it moves no rows.

    Each writing task holds few distinct keys, so it writes few files and no
    shuffle comes before the write.
    """
    spark = df.sparkSession
    ident = f"{name}_{uuid.uuid4().hex[:12]}"
    n = min(n or shuffle_partitions(spark), MOST_BUCKETS)
    df.write.bucketBy(n, key).option("path", path or fresh_path(spark, name, ident)).format("parquet").saveAsTable(ident)
    return spark.table(ident)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blank(col) -> F.Column:
    """Null text counts as empty text."""
    return F.coalesce(col, F.lit(""))
