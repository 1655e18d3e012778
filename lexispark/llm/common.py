"""What the corpus operators share: table reading, durable intermediate tables, row identity, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one that is a single part is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table into the shared folder and read it back: lineage is cut, a lost executor costs nothing.

    The files are removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> Column:
    """128 bits that stand for the values of cols (nulls included), as two longs in a struct."""
    flat = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in cols]
    return F.struct(F.xxhash64(*flat).alias("a"), F.xxhash64(F.lit("lexispark"), *flat).alias("b"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many _ in front as it takes to differ from all columns of df (case aside)."""
    taken = {c.lower() for c in df.columns}
    return ["_" * next(n for n in range(len(taken) + 1) if "_" * n + name.lower() not in taken) + name for name in names]


def kept(df: DataFrame) -> list[Column]:
    """All of df's columns, whatever characters their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its row count, checked here, is within the bound; else df, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key that more rows have than this is salted where a join is shuffled.
HOT_ROWS = 20_000


def small_join(big: DataFrame, small: DataFrame, on: list[str], rows: int, salts: int = 32) -> DataFrame:
    """The inner join of big with a side that is small as a rule: broadcast if its row count, checked here, is within the bound.
    Else both are shuffled, and the keys that more than HOT_ROWS rows of big have are dealt to salts, so that none is a single task's;
    as there are few such keys, little of the small side is repeated."""
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), on)
    salt, often = fresh(big, "salt", "often")
    hot = materialize(big.groupBy(*on).agg(F.count("*").alias(often)).where(F.col(often) > HOT_ROWS), "hot")
    if hot.isEmpty():
        return big.join(small.hint("merge"), on)
    is_hot = F.col(often).isNotNull()
    dealt = big.join(F.broadcast(hot), on, "left").withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(*kept(big)), F.lit(salts))).otherwise(0).cast("int")).drop(often)
    again = small.join(F.broadcast(hot), on, "left").withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(often)
    return dealt.join(again.hint("merge"), [*on, salt]).drop(salt)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, fewer rows in each batch that goes to Python, as texts may be long; results don't depend on it."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links(a BIGINT, b BIGINT): (node, component), the component being its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each two shuffles over the links that remain;
    stops when a step changes nothing. A node with very many neighbours is never gathered: minima are aggregates and
    the neighbour list is joined back, which adaptive execution may split. No links, no rows."""
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), F.col("b")).where("a <> b").distinct()
        # small star: every node's smaller neighbours and itself go to the smallest of them
        down = large.select(F.col("b").alias("n"), F.col("a").alias("s"))
        least = down.groupBy("n").agg(F.min("s").alias("m"))
        small = down.join(least, "n").select(F.col("m").alias("a"), F.explode(F.array("n", "s")).alias("b")).where("a <> b").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
