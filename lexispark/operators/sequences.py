"""Annotation models and languages told by sequences of tags: how often one tag follows another, beside the n-grams of words.

A sequence is an array of tags; its pairs are those of neighbours, with a mark before the first and after the last. Null and empty
sequences have no pairs, and no model is found for them. A model's tags are counted with SMOOTHING added to each possible follower;
pairs and tags that a model does not know cost what smoothing leaves, so every model rates every sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING = 0.1
START, END = "\x02", "\x03"


def pairs(sequences: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, cnt) of sequences(keys, tags)."""
    both = F.arrays_zip(F.concat(F.array(F.lit(START)), "tags").alias("a"), F.concat("tags", F.array(F.lit(END))).alias("b"))
    return sequences.where(F.size("tags") > 0).select(*keys, F.inline(both)).groupBy(*keys, "a", "b").agg(F.count("*").alias("cnt"))


def trained(sequences: DataFrame) -> DataFrame:
    """(model, a, b, cnt): the transitions of sequences(model, tags); rows without model are left out."""
    return pairs(sequences.where("model IS NOT NULL"), ["model"])


def rated(sequences: DataFrame, keys: list[str], model: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(keys, model, score): logarithm of each model's likelihood for each sequence; model: of trained().

    What is joined is sparse: all models start from an unknown tag's cost, which differs only where a model knows the tag, and again
    where it knows the pair."""
    own = pairs(sequences, keys)
    types = model.agg(F.count_distinct("b").alias("v"))
    out = model.groupBy("model", "a").agg(F.sum("cnt").alias("n")).join(F.broadcast(types))
    rest = F.log(F.lit(smoothing)) - F.log(F.col("n") + smoothing * F.col("v"))
    known = out.select("model", "a", (rest + F.log(F.col("v"))).alias("w"))
    seen = model.select("model", "a", "b", (F.log(F.col("cnt") + smoothing) - F.log(F.lit(smoothing))).alias("w"))
    gains = own.join(known, "a").select(*keys, "model", (F.col("cnt") * F.col("w")).alias("w")).union(own.join(seen, ["a", "b"]).select(*keys, "model", (own["cnt"] * F.col("w")).alias("w")))
    base = own.groupBy(*keys).agg(F.sum("cnt").alias("n")).join(F.broadcast(types)).select(*keys, (-F.col("n") * F.log("v")).alias("base"))
    return gains.groupBy(*keys, "model").agg(F.sum("w").alias("w")).join(base, keys).select(*keys, "model", F.round(F.col("w") + F.col("base"), 6).alias("score"))


def best(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model): the best rated, the first by name among equals."""
    return ratings.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "model")).alias("m")).select(*keys, "m.model")


def detected(sequences: DataFrame, keys: list[str], parts: list[str], model: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(keys, model, sentences, coverage): of sequences(keys, parts, tags), such as a column's sentences, how many each model is the
    best of, and their share of all that hold tags."""
    top = best(rated(sequences, [*keys, *parts], model, smoothing), [*keys, *parts])
    total = sequences.where(F.size("tags") > 0).groupBy(*keys).agg(F.count("*").alias("n"))
    return top.groupBy(*keys, "model").agg(F.count("*").alias("sentences")).join(total, keys).select(*keys, "model", "sentences", F.round(F.col("sentences") / F.col("n"), 6).alias("coverage"))
