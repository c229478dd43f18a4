"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of fixed-size rows up to this size are broadcast.
SMALL_BYTES = 8 << 20
_own: dict[str, str] = {}
#: The tables written in each temporary() that is open in this thread, innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, a temporary folder with a local master, and an error with any other."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset; executors need a folder they all share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="weftline-")
    return "file://" + _own[app]


def frugal(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches have so few rows that whole texts in both directions take little memory beside the heap, and let
    Spark delete a query's shuffle files when the query ends, as its results are tables of their own by then."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """df as written to a Parquet table in the shared folder and read back.

    Lost executors cost no lineage, and values such as monotonically_increasing_id() are fixed from then on.
    The table stays until release(), as the frames that read it are lazy; one inside temporary() goes with that.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/weftline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if _open.get():
        _open.get()[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As durable(), in buckets by key, so that a join by it moves the other side only.

    Buckets need a name in the session's catalog, which unlist() takes away again; the table stays, like others.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{folder(spark)}/weftline-{spark.sparkContext.applicationId}/{name}"
    if _open.get():
        _open.get()[-1].append(path)
    listed = f"spark_catalog.default.weftline_{name}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(listed)
    out = spark.table(listed)
    out._written_to, out._listed = path, listed
    return out


def unlist(frame: DataFrame) -> None:
    """Take the name of a bucketed() table out of the catalog, once no lazy frame reads it any more."""
    frame.sparkSession.sql(f"drop table {frame._listed}")


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that durable() returned and no lazy frame reads any more."""
    for frame in frames:
        _delete(spark, frame._written_to)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that durable() writes inside are deleted at the end, but for those given to the function that this yields."""
    own: list[str] = []
    outer = _open.get()
    token = _open.set((*outer, own))

    def keep(frame: DataFrame) -> DataFrame:
        own.remove(frame._written_to)
        if outer:
            outer[-1].append(frame._written_to)
        return frame

    try:
        yield keep
    finally:
        _open.reset(token)
        for path in own:
            _delete(spark, path)


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """df, marked for a broadcast if it has at most limit bytes by its row count and row size; else it is joined by a shuffle."""
    row = 16 * sum(max(1, str(t).count("LongType") + str(t).count("StringType")) for t in (f.dataType for f in df.schema.fields))
    return F.broadcast(df) if df.count() * row <= limit else df


def release(spark: SparkSession) -> None:
    """Delete every table that durable() wrote in this application; frames made from them can't be read afterwards."""
    _delete(spark, f"{folder(spark)}/weftline-{spark.sparkContext.applicationId}")
