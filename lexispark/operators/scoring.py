"""Scores of annotation models per file, and the choice of the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COVERAGE = 0.4


def sums(found: DataFrame) -> DataFrame:
    """Per file and model: different_hit_types (nodes, each a class with its tag), exclusive_hit_types (nodes reached by hits with one match),
    hit_count_total and exclusive_hit_count_total (counts, each node once: of its hits the largest, then the least token)."""
    # a file may be a whole table's predicate, so only a token's matches in it meet in one task; the rest are aggregates
    edges = found.withColumn("degree", F.count("*").over(Window.partitionBy("file_id", "token")))
    node = edges.groupBy("file_id", "model", "class", "tag").agg(F.max("cnt").alias("cnt"), F.max(F.when(F.col("degree") == 1, F.col("cnt"))).alias("own"))
    return node.groupBy("file_id", "model").agg(
        F.count("*").alias("different_hit_types"),
        F.count("own").alias("exclusive_hit_types"),
        F.sum("cnt").cast("long").alias("hit_count_total"),
        F.coalesce(F.sum("own"), F.lit(0)).cast("long").alias("exclusive_hit_count_total"),
    )


def scores(hit: DataFrame, found: DataFrame) -> DataFrame:
    """The sums per file and model, with coverage (nodes per distinct token of the file), for which hit must hold all tokens."""
    per_file = hit.groupBy("file_id").agg(F.count("*").alias("tokens"))
    return sums(found).join(per_file, "file_id").select("*", F.round(F.col("different_hit_types") / F.col("tokens"), 6).alias("coverage")).drop("tokens")


NODE = ["file_id", "model", "class", "tag"]
SUMS = ["different_hit_types", "exclusive_hit_types", "hit_count_total", "exclusive_hit_count_total"]


def _signed(matches: DataFrame, nodes: DataFrame, sign: int) -> DataFrame:
    """What the given nodes add to the sums of their file and model (sign 1), or take from them (-1). Only the matches of these nodes,
    and of the tokens that reach them, are looked at."""
    own = matches.join(nodes.hint("merge"), NODE, "left_semi")
    degree = matches.join(own.select("file_id", "token").distinct().hint("merge"), ["file_id", "token"], "left_semi").groupBy("file_id", "token").agg(F.count("*").alias("degree"))
    node = own.join(degree.hint("merge"), ["file_id", "token"]).groupBy(*NODE).agg(F.max("cnt").alias("cnt"), F.max(F.when(F.col("degree") == 1, F.col("cnt"))).alias("own"))
    amounts = (F.lit(1), F.when(F.col("own").isNotNull(), 1).otherwise(0), F.col("cnt"), F.coalesce("own", F.lit(0)))
    return node.select("file_id", "model", *[(x * sign).cast("long").alias(c) for c, x in zip(SUMS, amounts, strict=True)])


def rescored(old: DataFrame, hit: DataFrame, before: DataFrame, dropped: DataFrame, added: DataFrame) -> DataFrame:
    """The scores after matches were dropped and others added, from the old scores: nodes that a changed match or a token of one
    reaches are counted as they were and as they are, and the signed sums are merged. Files without change keep their rows. dropped is
    a part of before, added none of it; a score of which no node is left goes."""
    # files of matches are many times smaller than their rows, which must not be sent to the driver for a broadcast: hence the hints
    tokens = dropped.select("file_id", "token").union(added.select("file_id", "token")).distinct().hint("merge")
    files = tokens.select("file_id").distinct().hint("merge")
    was = before.join(files, "file_id", "left_semi").select(*NODE, "token", "cnt")
    match = [*NODE, "token"]
    now = was.join(dropped.select(*match).hint("merge"), match, "left_anti").union(added.select(*NODE, "token", "cnt"))
    nodes = was.join(tokens, ["file_id", "token"], "left_semi").select(*NODE).union(now.join(tokens, ["file_id", "token"], "left_semi").select(*NODE)).distinct()
    touched = old.join(files, "file_id", "left_semi").select("file_id", "model", *SUMS)
    merged = touched.union(_signed(was, nodes, -1)).union(_signed(now, nodes, 1)).groupBy("file_id", "model").agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).where("different_hit_types > 0")
    per_file = hit.join(files, "file_id", "left_semi").groupBy("file_id").agg(F.count("*").alias("tokens"))
    fresh = merged.join(per_file, "file_id").select("file_id", "model", *SUMS, F.round(F.col("different_hit_types") / F.col("tokens"), 6).alias("coverage"))
    return old.join(files, "file_id", "left_anti").select(*fresh.columns).union(fresh)


def tag_properties(found: DataFrame) -> DataFrame:
    """Per file and model: whether a match is trivial, from its matched tags."""
    return (
        found.groupBy("file_id", "model")
        .agg(
            F.bool_and(F.col("token").rlike("^[0-9]+$")).alias("only_numeric"),
            F.bool_and(~F.col("token").rlike("[A-Za-z0-9]")).alias("only_symbolic"),
            F.max(F.length("token")).alias("max_tag_length"),
            F.count_distinct("tag").alias("types"),
        )
        .withColumn("trivial", F.col("only_numeric") | F.col("only_symbolic") | (F.col("max_tag_length") == 1) | (F.col("types") == 1))
    )


def best_per(matches: DataFrame, keys: list[str], coverage: float = COVERAGE) -> DataFrame:
    """The selected model per key: manual selections win, manual deselections are out; else coverage counts if it reaches the
    threshold and the match isn't trivial. Ties: coverage, exclusive types, total, exclusive total (all descending), model."""
    chosen = (F.col("method") == "MANUAL") & F.col("selected")
    allowed = chosen | ((F.col("method") != "MANUAL") & (F.col("coverage") >= coverage) & ~F.col("trivial"))
    order = [chosen.desc(), *[F.col(c).desc() for c in ("coverage", "exclusive_hit_types", "hit_count_total", "exclusive_hit_count_total")], F.col("model")]
    return matches.where(allowed).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def deselected(matches: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """matches with `selected` false where coverage is below the threshold or the match trivial, but for manual selections."""
    keep = (F.col("method") == "MANUAL") & F.col("selected")
    weak = (F.col("coverage") < coverage) | F.col("trivial")
    return matches.withColumn("selected", F.when(keep, True).when(weak, False).otherwise(F.col("selected")))
