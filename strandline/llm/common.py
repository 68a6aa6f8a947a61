"""What the operators of this subpackage share: shared-folder tables, global ranks, components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that numpy code takes at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new one where that is unset (local runs only)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        found = sc.getCheckpointDir()
    return found


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialize`` wrote."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Python tasks may take ``rows`` rows at once: for rows of a few numbers, which take time by the batch."""
    small_batches(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, keep: list[str] | None = None, rows: int = 0) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Lost executors cost a reread, never a recomputation. Shuffle files of the write go with
    its end, as the table stands for them. The table goes when the driver's process ends; a
    caller that knows it to be done with earlier passes ``keep``, which gets the path, and
    calls ``drop``. Batches of Python tasks may have ``rows`` rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        with batches(spark, rows):
            df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    atexit.register(drop, spark, path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20) -> None:
    """Let Python tasks take this many rows, and about ``size`` bytes, at once at most: rows with whole texts are large.

    A batch ends with the row that reaches the size, so a longer text is taken whole.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def with_global_rank(df: DataFrame, order: list[str], rank: str) -> DataFrame:
    """Add ``rank``: the row's number, from 0 without gaps, in the order of the columns ``order``.

    Rows are range-partitioned, so no task holds more than its range; only a count for each
    partition meets in one place. Rows equal in ``order`` are numbered in any order.
    """
    spark = df.sparkSession
    mono, part, local = "__mono", "__part", "__local"
    laid = materialize(
        df.repartitionByRange(shuffle_width(spark), *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn(mono, F.monotonically_increasing_id())
    ).withColumns({part: F.shiftrightunsigned(mono, 33).cast("int"), local: F.col(mono).bitwiseAND((1 << 33) - 1)})
    sizes = laid.groupBy(part).agg(F.count("*").alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row for each partition: as small as the job's own task table.
    return laid.join(F.broadcast(offsets), part).withColumn(rank, F.col("__before") + F.col(local)).drop(mono, part, local, "__before")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the links (a, b): rows (node, root) with the smallest node reachable.

    In a round every node hooks onto its least neighbour, if that is smaller, chains are
    shortened by pointer jumping, and links are contracted to those between roots. Half of the
    nodes that still have links go in each round at least, and their links with them. All
    tables stay distributed; each step ends in one in the shared folder.
    """
    spark = links.sparkSession
    old: list[str] = []

    def step(df: DataFrame) -> DataFrame:
        return materialize(df, old)

    low_high = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(f"{a} <> {b}")
    edges = step(low_high.distinct())
    if edges.isEmpty():
        return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    label = None
    while label is None or not edges.isEmpty():
        up = step(edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node"))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up = step(up.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        to = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = edges.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_root", "u").alias("x"), F.coalesce("v_root", "v").alias("y"))
        edges = step(moved.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        if label is not None:
            label = label.join(to("root"), "root", "left").select("node", F.coalesce("root_root", "root").alias("root"))
            label = label.unionByName(up.join(label.select("node"), "node", "left_anti"))
        else:
            label = up
        label = step(label)
    out = materialize(label.unionByName(label.select(F.col("root").alias("node"), "root").distinct()))
    for path in old:
        drop(spark, path)
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def release() -> None:
    """Give free memory of a Python worker back: workers that wait stand beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not all C libraries have it
    if trim is not None:
        trim(0)


def text_of(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def chunks(frames: Iterator[pd.DataFrame], column: str, size: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in runs of about ``size`` bytes of ``column``, in order."""
    for frame in frames:
        if not len(frame):
            continue
        lengths = frame[column].str.len().to_numpy()
        ends, total = [0], 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                ends.append(i)
                total = 0
            total += int(n)
        ends.append(len(lengths))
        for i, j in zip(ends, ends[1:]):
            if j > i:
                yield frame.iloc[i:j]
        del frame
        release()


def gathered(frames: Iterator[pd.DataFrame], column: str, size: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """``frames`` joined to about ``size`` bytes of ``column``, so that what is counted in a run does not shrink with the batches."""
    parts, total = [], 0
    for frame in frames:
        if len(frame):
            parts.append(frame)
            total += int(frame[column].str.len().sum())
        if total >= size:
            yield pd.concat(parts, ignore_index=True)
            parts, total = [], 0
    if parts:
        yield pd.concat(parts, ignore_index=True)


def cut(texts: list, size: int = CHUNK_BYTES) -> Iterator[list]:
    """``texts`` in runs of about ``size`` in length, in order."""
    out, total = [], 0
    for t in texts:
        if out and total + len(t) > size:
            yield out
            out, total = [], 0
        out.append(t)
        total += len(t)
    if out:
        yield out


class BitMap:
    """A set of 64-bit hashes as a bit map of fixed size: it may let in others, but misses none.

    It goes before a shuffle, so that only rows of interest move. It has 2 ** BITS bits however
    many hashes there are: its broadcast is bounded, and a fuller map only lets more through to
    the exact step behind it.
    """

    BITS = 26

    def __init__(self, spark: SparkSession, words: np.ndarray):
        self.sent = spark.sparkContext.broadcast(words)

    @classmethod
    def places(cls, hashes: np.ndarray) -> np.ndarray:
        """Two bits for each hash, both in the region of the shard that its highest bits name."""
        h = hashes.view(np.uint64)
        low = np.uint64((1 << cls.BITS - 8) - 1)
        region = (h >> np.uint64(56)) << np.uint64(cls.BITS - 8)
        return np.stack([region | (h & low), region | ((h >> np.uint64(24)) & low)])

    @classmethod
    def of(cls, df: DataFrame, hashes, least: int) -> "BitMap":
        """The hashes that ``hashes`` (frames -> arrays) yields at least once, or twice, over all of ``df``."""
        table = np.zeros((256, 1 << cls.BITS - 13), dtype=np.uint32)
        for r in cls.regions(df, hashes, least, "binary").collect():  # 256 regions of fixed size: 8 MB
            table[r["shard"]] |= np.frombuffer(r["words"], dtype=np.uint32)
        return cls(df.sparkSession, table.ravel())

    @classmethod
    def regions(cls, df: DataFrame, hashes, least: int, kind: str) -> DataFrame:
        """(shard, words): the map's 256 regions, each as ``kind``, binary or array<int>.

        Tasks send packed hashes, by 256 shards, each once for a run of rows with a mark if it
        recurs there; each shard's region of the map is made where the shard is gathered.
        """
        held = 1 << 19

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def sent(arrays: list[np.ndarray]) -> pd.DataFrame:
                h, n = np.unique(np.concatenate(arrays), return_counts=True)
                cuts = np.searchsorted(h >> np.uint64(56), np.arange(257, dtype=np.uint64))
                rows = []
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if j > i:
                        rows.append((k, h[i:j].tobytes() if least > 1 else b"", h[i:j][n[i:j] >= least].tobytes()))
                return pd.DataFrame(rows, columns=["shard", "h", "twice"])

            arrays, total = [], 0
            for x in hashes(frames):
                arrays.append(x)
                total += len(x)
                if total > held:
                    yield sent(arrays)
                    arrays, total = [], 0
            if total:
                yield sent(arrays)

        bits = cls.BITS

        def region(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # One frame's blobs at a time: hashes met once wait, sorted, for a second meeting.
            once: dict[int, list[np.ndarray]] = {}
            words: dict[int, np.ndarray] = {}

            def mark(k: int, h: np.ndarray) -> None:
                at = cls.places(h).ravel() & np.uint64((1 << bits - 8) - 1)
                np.bitwise_or.at(words.setdefault(k, np.zeros(1 << bits - 13, dtype=np.uint32)), at >> np.uint64(5), np.uint32(1) << (at & np.uint64(31)).astype(np.uint32))

            def settle(k: int) -> None:
                h, n = np.unique(np.concatenate(once[k]), return_counts=True)
                mark(k, h[n > 1])
                once[k] = [h]

            for frame in frames:
                for k, h, twice in zip(frame["shard"].tolist(), frame["h"].tolist(), frame["twice"].tolist()):
                    once.setdefault(k, []).append(np.frombuffer(h, dtype=np.uint64))
                    mark(k, np.frombuffer(twice, dtype=np.uint64))
                for k in once:
                    if len(once[k]) > 64:
                        settle(k)
            for k in once:
                settle(k)
                yield pd.DataFrame({"shard": [k], "words": [words[k].tobytes() if kind == "binary" else words[k].view(np.int32)]})

        packed = df.mapInPandas(pack, "shard int, h binary, twice binary")
        return packed.repartition(min(256, shuffle_width(df.sparkSession)), "shard").mapInPandas(region, f"shard int, words {kind}")

    def free(self) -> None:
        """Take the map off all executors; what is computed later must not ask it."""
        self.sent.destroy()

    def reader(self):
        """A function for tasks: hashes -> which of them may be in the set."""
        sent, places = self.sent, self.places

        def hits(hashes: np.ndarray) -> np.ndarray:
            table = sent.value
            a, b = (table[p >> np.uint64(5)] >> (p & np.uint64(31)).astype(np.uint32) for p in places(hashes))
            return (a & b & np.uint32(1)).astype(bool)

        return hits


class IdFilter:
    """A ``BitMap`` of keys before shuffle joins on them, so that the rest of a table, with its texts, stays where it is.

    The map is a table of 256 regions, which a broadcast join asks by the hash's shard: no Python
    worker stands beside those of the step that takes the rows.
    """

    def __init__(self, keys: DataFrame, *on: str):
        self.on, self.old = list(on), []
        self.keys = keys.select(*on)
        regions = BitMap.regions(self.keys.select(F.xxhash64(*on).alias("h")), lambda frames: (f["h"].to_numpy(np.int64).view(np.uint64) for f in frames), 1, "array<int>")
        self.regions = materialize(regions, self.old).withColumnsRenamed({"shard": "__shard", "words": "__words"})

    def _known(self, df: DataFrame, how: str) -> DataFrame:
        """The rows of ``df`` that may be in the set (left_semi), or those that are not (left_anti)."""
        h, low = F.xxhash64(*self.on), (1 << BitMap.BITS - 8) - 1
        places = [at.bitwiseAND(low).cast("int") for at in (h, F.shiftright(h, 24))]  # as BitMap.places, within the shard
        bits = [F.call_function("shiftright", F.get("__words", F.shiftright(at, 5)), at.bitwiseAND(31)) for at in places]
        hit = bits[0].bitwiseAND(bits[1]).bitwiseAND(1) == 1
        return df.join(F.broadcast(self.regions), (F.shiftrightunsigned(h, 56).cast("int") == F.col("__shard")) & hit, how)  # 8 MB at most

    def maybe(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key is in the set, and a few by chance."""
        return self._known(df, "left_semi")

    def never(self, df: DataFrame) -> DataFrame:
        """The other rows of ``df``."""
        return self._known(df, "left_anti")

    def semi(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key is in the set."""
        return self.maybe(df).join(self.keys.distinct().hint("shuffle_hash"), self.on, "left_semi")

    def anti(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key is not in the set; most of them are not shuffled."""
        return self.never(df).unionByName(self.maybe(df).join(self.keys.distinct().hint("shuffle_hash"), self.on, "left_anti"))

    def inner(self, df: DataFrame, more: DataFrame) -> DataFrame:
        """``df`` joined to ``more``, whose keys are those of the set."""
        return self.maybe(df).join(more.hint("shuffle_hash"), self.on)

    def left(self, df: DataFrame, more: DataFrame) -> DataFrame:
        """``df`` left-joined to ``more``, which has one row for each key of the set."""
        rest = [c for c in more.columns if c not in self.on]
        out = self.never(df).withColumns({c: F.lit(None).cast(more.schema[c].dataType) for c in rest})
        return out.unionByName(self.maybe(df).join(more.hint("shuffle_hash"), self.on, "left"))

    def free(self) -> None:
        """Drop the map; what is computed later must not ask it."""
        for path in self.old:
            drop(self.keys.sparkSession, path)
