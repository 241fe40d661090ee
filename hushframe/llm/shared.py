"""Helpers that several corpus operators use: scratch tables, word columns, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Lower-cases A-Z only.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables up to so many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new one on a local master; a cluster must name it."""
    spark_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not spark_dir:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark_dir = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", spark_dir)
    return spark_dir.rstrip("/")


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: df as Parquet in the shared folder, and the folder's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_tables(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of write_table that no result depends on any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets executors delete the shuffles of plans that nothing refers to any more: Spark does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few enough rows; else a shuffle join with AQE's splitting of skewed keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs within give Python so many rows at once: batches of whole texts are held on both sides, outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; null: none."""
    # split leaves at most one empty string, before a leading separator, and one after a trailing one
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def grams(tokens: Column, k: int, seed: int = 0) -> Column:
    """The hash of each k tokens in a row, in order."""
    parts = lambda w, i: [w, *(F.get(tokens, i + j) for j in range(1, k))]
    whole = F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - (k - 1), F.lit(0))), lambda w, i: F.xxhash64(F.lit(seed), *parts(w, i)))
    return whole


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (id, component) of all ids but each component's smallest, which is its name.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round shuffles the links once
    for each star. Minima are formed before the shuffle; the joins with them are on ids, where AQE parts a hub with very many links.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, path = write_table(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours and u itself point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m").unionAll(low.select(F.col("u").alias("x"), "m")).select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        new, new_path = write_table(small_star, "links")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_tables(spark, path)
        edges, path = new, new_path
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component"))
