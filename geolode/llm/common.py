"""What the operators of this folder share: the kernels, the documents table, and connected components."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode import jvm
from geolode.shared import release, stored

PACKAGE = "geolode.llm"
WORD_GAP = r"\x20\x09-\x0D"


def kernels(spark: SparkSession) -> None:
    jvm.load(spark, Path(__file__).parent / "java", PACKAGE)


def kernel_udf(spark: SparkSession, name: str, class_name: str, returns: str, **conf) -> None:
    kernels(spark)
    jvm.register(spark, name, f"{PACKAGE}.{class_name}", returns, **conf)


def kernel_map(df: DataFrame, class_name: str, schema: str, **conf) -> DataFrame:
    kernels(df.sparkSession)
    return jvm.map_partitions(df, f"{PACKAGE}.{class_name}", schema, **conf)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_bytes(col: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def id_crc(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def summed(df: DataFrame, key: str, *totals: Column) -> DataFrame:
    """``df`` grouped by a key, dealt by a struct of it: a join on the key then deals both sides anew, and so Spark can split a hot key's rows."""
    return df.groupBy(F.struct(key).alias("_k")).agg(*totals).select(F.col(f"_k.{key}").alias(key), "*").drop("_k")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: two vertices) to (vertex, root), root being the smallest vertex that can be reached.

    Alternates large-star and small-star steps: each replaces a vertex's links by links to its smallest
    neighbour, found with an aggregation that combines before its shuffle, and joined so that Spark can split
    the links of one vertex among tasks. Each round is written to the shared folder; no link reaches the driver.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        s = both(e)
        least = summed(s, "a", F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = s.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = summed(large, "a", F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        done = stored(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = state(done)
        release(e)
        e = done
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
