"""What several operators share: table access, the shared working folder, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import spread

#: A word of the contracts: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one in few files is dealt out over the cores."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only in a local session without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexiforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a materialized DataFrame that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lexiforge-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does when the driver's objects of them are
    collected, which a driver with free memory puts off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bounds of an Arrow batch, so that batches of long texts fit the memory of a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for this session, unless it bounds them more closely itself."""
    for key, most in BATCH.items():
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def freed(rows: Iterator) -> Iterator:
    """rows, and at their end the task's memory handed back: Python workers live on, and what they keep adds up. What
    tasks before have left, such as broadcast values dropped since, is handed back before the first row."""
    hand_back()
    yield from rows
    hand_back()


def portable_hash(c: Column) -> Column:
    """The first 32 bits of MD5 as a long: the same number in Spark and in DuckDB."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def join_frequent(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left with right's columns by key, a left join in which no key's rows gather in one task.

    right has one row per key. Keys that hold 1 / share of left's rows or more are share at most, whatever the rows: they
    and their rows of right go through the driver and are broadcast; the others are joined by a shuffle.
    """
    spark, at, kind = left.sparkSession, F.col(key), left.schema[key].dataType
    added = [f for f in right.schema.fields if f.name != key]
    counts = left.where(at.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows_"))
    total = left.agg(F.count(F.lit(1)).alias("total_"))
    often = [r[0] for r in counts.join(F.broadcast(total)).where(F.col("rows_") * share >= F.col("total_")).select(key).collect()]
    if not often:
        return left.join(right, key, "left")
    hot = spark.createDataFrame([(k,) for k in often], StructType([StructField(key, kind)]))
    found = right.join(F.broadcast(hot), key, "left_semi").select(key, *[f.name for f in added]).collect()
    known = spark.createDataFrame(found, StructType([StructField(key, kind), *[StructField(f.name, f.dataType) for f in added]]))
    here = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(known), key, "left")
    rest = left.where(at.isNotNull()).join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    none = left.where(at.isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    return here.unionByName(rest).unionByName(none)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes; the number of rounds grows with the logarithm of
    the longest path. The two joins of a round take the centres of large stars by broadcast, so that no star's links
    gather in one task. Self links, repeated and null links are dropped. Labels stay in tables of the shared folder;
    only whether they are settled, and at most a thousand centres a join, reach the driver.
    """
    spark = edges.sparkSession

    def least(e: DataFrame, key: str) -> DataFrame:
        return e.groupBy(F.col("a").alias(key)).agg(F.min("b").alias("m"))

    def star(e: DataFrame) -> DataFrame:
        """Links lead from larger nodes to smaller ones. Large: what links to a node goes to the node's least neighbour
        (to itself where none is smaller). Small: a node's smaller neighbours go to the least of them."""
        up = join_frequent(e, materialize(least(e, "b")), "b")
        large = materialize(up.select("a", F.coalesce("m", "b").alias("b")).distinct())
        down = materialize(least(large, "a"))
        small = join_frequent(large, down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = materialize(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        remove(large)
        remove(down)
        return out

    def settled(e: DataFrame) -> bool:
        """Each node has one link, to a node that has none: the links are the stars of the components."""
        both = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        both = both.union(e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return both.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    if now.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    while not settled(now):
        after = star(now)
        remove(now)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
