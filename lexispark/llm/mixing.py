"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

Each source gets a share of the mixture's characters: those named in targets get theirs (scaled down together if they exceed
1), all others share what is left in proportion to their characters; if no other source is there, or named ones are
missing, the shares are scaled to sum to 1. A source's rate is share * epochs * all characters / its characters. A document is
repeated as often as the Poisson distribution of that mean, inverted at a hash of (seed, doc_id), says; so the choice is the
same on each run and for any partitioning. The copies go to hashed partitions and are ordered in them by a hash of
(seed, doc_id, copy), which is a global shuffle.

Character counts per source are pre-aggregated; no step gathers a source's rows, so a hot source costs nothing extra.
Nulls: a null text has no characters; rows without source are a source of their own; a null doc_id is replaced by the text's hash. Sources without any
characters have rate 0 (their rows, all empty, go). Repeated rows are repeated alike. Columns of docs are kept, whatever
their names; copy and mix_key replace columns of that name. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import fresh, kept, maybe_broadcast

#: Shares of the mixture used in production; the sources that are not named share the rest.
TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.08}
SEED, EPOCHS = 17, 1.0
#: Sources (with their distribution, a few 100 bytes each) that may be broadcast; more of them are joined by shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column | str) -> Column:
    """From 0 to below 1, by the first 52 bits of the parts' md5."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, targets: dict[str, float], epochs: float) -> DataFrame:
    """(source, rate, cdf): cdf[k] is the probability of k copies or fewer, up to where it is 1 to 1e-12 and beyond."""
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    by_source = docs.groupBy("source").agg(chars.alias("chars")).where("chars > 0")
    named = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.create_map().cast("map<string,double>")
    by_source = by_source.withColumn("target", F.try_element_at(named, F.coalesce("source", F.lit(""))))
    total = by_source.agg(F.sum("chars").alias("all_chars"), F.sum(F.when(F.col("target").isNull(), F.col("chars"))).alias("other_chars"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("named"))
    joined = by_source.join(F.broadcast(total))  # one row
    scale = F.when(F.col("other_chars").isNull() | (F.col("named") > 1), F.col("named")).otherwise(F.lit(1.0))
    share = F.when(F.col("target").isNotNull(), F.col("target") / scale).otherwise(F.greatest(F.lit(0.0), 1 - F.col("named")) * F.col("chars") / F.col("other_chars"))
    rated = joined.select("source", (share * epochs * F.col("all_chars") / F.col("chars")).alias("rate")).where("rate > 0")
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct((-F.col("rate")).alias("log"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("cdf")),
        lambda s, k: F.struct(
            (s["log"] + F.log("rate") - F.log(k.cast("double"))).alias("log"),
            (s["sum"] + F.exp(s["log"] + F.log("rate") - F.log(k.cast("double")))).alias("sum"),
            F.concat(s["cdf"], F.array(s["sum"] + F.exp(s["log"] + F.log("rate") - F.log(k.cast("double"))))).alias("cdf"),
        ),
        lambda s: s["cdf"],
    )
    return rated.withColumn("cdf", grown)


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, seed: int = SEED, epochs: float = EPOCHS) -> DataFrame:
    """The mixture: rows of docs, with copy (1, 2, ...) and mix_key (the order within the shuffled partitions)."""
    docs = docs.drop("copy", "mix_key")
    own, cdf, u, times = fresh(docs, "own", "cdf", "u", "times")
    table = maybe_broadcast(rates(docs.select("source", "text"), targets, epochs).select(F.col("source").alias(own), F.col("cdf").alias(cdf)), BROADCAST_SOURCES)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    joined = docs.join(table, F.col("source").eqNullSafe(F.col(own)))
    counted = joined.withColumn(u, uniform(F.lit(f"mix:{seed}:"), name)).withColumn(times, F.size(F.filter(cdf, lambda c: c <= F.col(u))))
    copies = counted.where(F.col(times) > 0).select(*kept(docs), F.explode(F.sequence(F.lit(1), F.col(times))).alias("copy"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat(F.lit(f"shuffle:{seed}:"), name, F.lit(":"), F.col("copy").cast("string"))))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key", "copy")
