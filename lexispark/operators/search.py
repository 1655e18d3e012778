"""Catalogue search. facet(url, value, selected) says what a resource has (languages or models)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.columns import full_match


def any_of(facet: DataFrame, values: list[str]) -> DataFrame:
    """Resources with one of the values selected."""
    return facet.where(F.col("selected") & F.col("value").isin(values)).select("url").distinct()


def all_of(facet: DataFrame, values: list[str], only_selected: bool = True) -> DataFrame:
    """Resources with all values. Model searches look at selected edges only, language searches at all."""
    rows = facet.where(F.col("value").isin(values))
    rows = rows.where("selected") if only_selected else rows
    return rows.groupBy("url").agg(F.count_distinct("value").alias("n")).where(F.col("n") == len(set(values))).select("url")


def only(facet: DataFrame, found: DataFrame, n: int, only_selected: bool = True) -> DataFrame:
    """Of found, the resources with exactly n values in all."""
    rows = facet.where("selected") if only_selected else facet
    exact = rows.groupBy("url").agg(F.count_distinct("value").alias("n")).where(F.col("n") == n).select("url")
    return found.join(exact, "url", "left_semi")


def all_facets(*found: DataFrame) -> DataFrame:
    """Resources in all results."""
    out = found[0]
    for other in found[1:]:
        out = out.join(other, "url", "left_semi")
    return out


def matching(column: Column, text: str, ignore_case: bool = True) -> Column:
    """The search text (characters with a meaning in patterns taken out) anywhere in the column; line breaks count as text."""
    plain = "".join(c for c in text if c not in "*',;(){}[]\"\\^$|+?.")
    return full_match(column, ("(?is)" if ignore_case else "(?s)") + ".*" + plain + ".*")


def inverted_index(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, values): which values a key stands with, sorted. Values per key are distinct before they are gathered."""
    return pairs.select(key, value).distinct().groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(value)).alias("values"))


#: Values that one posting list spans.
WIDTH = 1 << 16


def posting_lists(pairs: DataFrame, key: str, value: str, width: int = WIDTH) -> DataFrame:
    """(key, bucket, n, gaps): the inverted index in lists of bounded size: a key's values (numbers) from bucket * width on, sorted,
    as the distance of each from the one before it, of the first from the bucket's begin. A key that all files hold is many rows."""
    values = pairs.select(F.col(key).alias("key"), F.floor(F.col(value) / width).alias("bucket"), F.pmod(value, F.lit(width)).cast("int").alias("at")).distinct()
    lists = values.groupBy("key", "bucket").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("at")).alias("x"))
    return lists.select("key", "bucket", "n", F.transform("x", lambda at, i: at - F.coalesce(F.get("x", i - 1), F.lit(0))).alias("gaps"))


def holding(postings: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """(value): the values that stand with all of keys. Lists are read one by one, and only those of the keys."""
    lists = postings.where(F.col("key").isin(keys)).select("key", "bucket", F.posexplode("gaps").alias("i", "gap"))
    at = F.sum("gap").over(Window.partitionBy("key", "bucket").orderBy("i"))
    return lists.select((F.col("bucket") * width + at).alias("value")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") == len(set(keys))).select("value")


def by_single_type(types: DataFrame, wanted: str) -> DataFrame:
    """Resources of a type; UNKNOWN means that it is the only type edge."""
    if wanted != "UNKNOWN":
        return types.where(F.col("type") == wanted).select("url").distinct()
    return types.distinct().groupBy("url").agg(F.count("*").alias("n"), F.max("type").alias("type")).where("n = 1 AND type = 'UNKNOWN'").select("url")


def with_status(files: DataFrame, status: str, every: bool) -> DataFrame:
    """Resources of which any (or every) file has the status."""
    test = (F.bool_and if every else F.bool_or)(F.col("status") == status)
    return files.groupBy("url").agg(test.alias("ok")).where("ok").select("url")


def statistics(files: DataFrame) -> DataFrame:
    """One row of counts over approved resources: types, formats, different languages."""
    approved = files.groupBy("url").agg(F.bool_or(F.col("status") == "ACCEPTED").alias("ok")).where("ok").select("url")
    f = files.join(approved, "url", "left_semi")
    per = f.groupBy("url").agg(*[F.bool_or(F.col("type") == t).alias(t.lower()) for t in ("CORPUS", "LEXICON", "ONTOLOGY")], *[F.bool_or(F.col("format") == t).alias(t.lower()) for t in ("RDF", "CONLL", "XML")])
    counts = per.agg(F.count("*").alias("resources"), *[F.count_if(c).alias(c) for c in ("corpus", "lexicon", "ontology", "rdf", "conll", "xml")])
    return counts.join(f.agg(F.count_distinct("lang").alias("languages")))


def checked(values: DataFrame, known: DataFrame) -> DataFrame:
    """(value, known): which of the values of a search the catalogue knows at all; a search for others is refused."""
    there = known.select("value").distinct().withColumn("k", F.lit(True))
    return values.select("value").distinct().join(there, "value", "left").select("value", F.col("k").isNotNull().alias("known"))
