"""The change log as parquet: append, scans that prune, shipping in contiguous segments."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_NS = 86_400 * 10**9


#: Ranges of a day's event times that are written apart, so that no tenant's day is one task.
SLICES = 8
#: Rows of a bucket, which one task sorts, and of a shuffle's partition, which one task gathers.
BUCKET_ROWS = 500_000
_stored: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new one where that is unset (local runs only)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="strandline-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lost executors cost a reread."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: smaller than a checkpoint, and counted from its footers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def distinct(df: DataFrame, rows: int) -> DataFrame:
    """``df`` without repeated rows; there are ``rows`` of it, dealt so that no task gathers many more than BUCKET_ROWS.

    Nothing is gathered before that, by splits of files that grow with the files.
    """
    return df.repartition(rows // BUCKET_ROWS + 1, *df.columns).distinct()


@contextmanager
def wide(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Within it, shuffles of ``rows`` rows have so many partitions that each stays small, and are not put together beyond that; files are read in small splits, as a task sorts what it deals to many."""
    own = {"spark.sql.shuffle.partitions": max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS + 1), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "16m"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def in_buckets(rows: DataFrame, key: str) -> DataFrame:
    """A table (as ``written`` gives) written into buckets of ``key``, so many that each stays small: a join by it moves the other side only."""
    spark = rows.sparkSession
    name = f"strandline_{uuid.uuid4().hex}"
    with wide(spark, rows.count()):
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(width, key).write.format("parquet").bucketBy(width, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def append(log: DataFrame, path: str) -> None:
    """Add events, partitioned by tenant and day and sorted by event time within files."""
    dated = log.withColumn("event_day", F.floor(F.col("event_time_ns") / DAY_NS).cast("int"))
    part = F.floor(F.pmod(F.col("event_time_ns"), F.lit(DAY_NS)) * SLICES / DAY_NS)
    dated.repartition("tenant", "event_day", part).sortWithinPartitions("event_day", "event_time_ns", "seq").write.mode("append").partitionBy("tenant", "event_day").parquet(path)


def stored(spark: SparkSession, name: str, make) -> str:
    """The path of the log ``name``, written by ``make()`` when this application first asks for it."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
        append(make(), path)
        _stored[key] = path
    return _stored[key]


def newest(log: DataFrame) -> DataFrame:
    """(tenant, newest_ns): the latest event time of each tenant."""
    return log.groupBy("tenant").agg(F.max("event_time_ns").alias("newest_ns"))


def scan(spark: SparkSession, path: str, tenant: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Events of [start, end); days prune folders, times prune row groups."""
    df = spark.read.parquet(path)
    if tenant is not None:
        df = df.where(F.col("tenant") == tenant)
    if start_ns is not None:
        df = df.where((F.col("event_day") >= start_ns // DAY_NS) & (F.col("event_time_ns") >= start_ns))
    if end_ns is not None:
        df = df.where((F.col("event_day") <= end_ns // DAY_NS) & (F.col("event_time_ns") < end_ns))
    return df.drop("event_day")


def tail(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") > seq)


def touching(log: DataFrame, entity: str | int) -> DataFrame:
    """Events of an entity, and of relations at either of its ends where the log has their columns."""
    found = F.col("id") == entity
    for end in ("from_id", "to_id"):
        if end in log.columns:
            found |= F.coalesce(F.col(end) == entity, F.lit(False))
    return log.where(found)


def segment_faults(segments: DataFrame) -> DataFrame:
    """Gaps and overlaps between shipped segments (tenant, from_seq, to_seq): fault, and the expected start."""
    by_start = Window.partitionBy("tenant").orderBy("from_seq", "to_seq")
    reached = F.max("to_seq").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    expected = segments.withColumn("expected", reached + 1)
    fault = F.when(F.col("from_seq") > F.col("expected"), "gap").when(F.col("from_seq") < F.col("expected"), "overlap")
    return expected.withColumn("fault", fault).where("fault is not null")
