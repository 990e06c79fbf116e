"""Helpers shared by the text operators: durable intermediate results, whole-value lambdas, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of the warehouse where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return where.rstrip("/")


def pin(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint, which outlives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as (compressed) Parquet and read back; for wide rows, where pin() would write them raw."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results whose readers are done."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, hours: float = 24) -> int:
    """Deletes this module's files in the shared folder that were last written over so many hours ago; returns how many entries.

    Operators delete what they are done with themselves. What a lazy result still reads stays until someone sweeps: call
    this when no result made before then is needed any more.
    """
    jvm, gone = spark.sparkContext._jvm, 0
    top = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(top):
        limit = jvm.System.currentTimeMillis() - int(hours * 3_600_000)
        for entry in fs.listStatus(top):
            if entry.getModificationTime() < limit:
                fs.delete(entry.getPath(), True)
                gone += 1
    return gone


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bag_common(a: Column, b: Column) -> Column:
    """How many values two arrays of longs share, repeats included; linear but for the values that both repeat."""

    def repeats(xs: Column) -> Column:
        """The values of an array, each once less than it occurs."""
        return let(F.array_sort(xs), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False))))

    def more(x: Column, y: Column) -> Column:
        times = lambda xs, v: F.size(F.filter(xs, lambda u: u == v))
        return F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, v: n + F.least(times(x, v), times(y, v)))

    return F.size(F.array_intersect(a, b)) + let(F.struct(repeats(a).alias("a"), repeats(b).alias("b")), lambda r: more(r["a"], r["b"]))


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else the optimizer shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star steps.

    edges: columns a, b of one orderable type; loops and repeated rows are allowed. Returns one row (node, root) for
    each node with a link to another, root being the least node of its component. Each step keeps at most as many
    edges as it got, and no step gathers the neighbours of a node in one place: minima are aggregated before the
    shuffle. An empty graph gives an empty table.
    """
    e = pin(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = pin(small.where(F.col("a") != F.col("b")).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
