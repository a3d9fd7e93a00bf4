"""What the operators share: stored tables, skew-proof lookups, text columns, and the package on the workers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.session import ship_package

#: White space as every contract here means it: the space and the ASCII controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text as UTF-8 bytes, null as empty; all else is left behind, so no name can clash."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def stored(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the folder of spark.checkpoint.dir, which every executor reaches.

    A local session without the setting (tests) gets a folder of its own; any other must have set it.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quotemill-"))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `lookup` (one row per key), however many rows share a key.

    Rows are dealt by key and a salt from `spread`. The keys that occur under each salt are pre-aggregated
    and fetch the lookup row once per salt, so a key with a third of all rows is split over all partitions.
    Null keys find nothing.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(partitions(rows.sparkSession))).cast("int")
    rows = rows.withColumn("__salt", salt)
    found = rows.select("__salt", *keys).distinct().join(lookup, keys)
    return rows.join(found, ["__salt", *keys], how).drop("__salt")


def remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): every id of `edges` (a, b) with the smallest id it can reach.

    Large-star and small-star steps in turn: each id is tied to the smallest of its neighbourhood, which
    takes a number of rounds logarithmic in the longest chain. A step's minima are pre-aggregated before
    their shuffle; only counts and hashes reach the driver.
    """

    def sketch(e: DataFrame) -> tuple:
        # Sums of two halves of the hash: no overflow, and no dependence on row order.
        h = F.xxhash64("a", "b")
        row = e.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        return tuple(row)

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = sketch(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct())
        after = sketch(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
