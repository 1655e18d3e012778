"""Words counted where they stand: a row's words are sorted and counted inside the row, so that no occurrence is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, keys: list[str], words: Column, name: str = "token") -> DataFrame:
    """(keys, name, cnt): how often each word of a row, of the array words, stands in it. Empty words and null arrays give nothing; rows
    of equal keys are counted each for itself."""
    own = rows.select(*keys, F.sort_array(F.array_remove(words, "")).alias("_words"))
    # columns of their own, as a lambda would work them out for each element
    first = lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1))
    places = F.when(F.size("_words") > 0, F.filter(F.sequence(F.lit(0), F.size("_words") - 1), first))
    own = own.select(*keys, "_words", places.alias("_at"))
    one = lambda i, k: F.struct(F.get("_words", i).alias(name), (F.coalesce(F.get("_at", k + 1), F.size("_words")) - i).cast("long").alias("cnt"))
    return own.select(*keys, F.inline(F.transform("_at", one)))


def chosen(rows: DataFrame, keys: list[str], words: Column, keep: Column, name: str = "token") -> DataFrame:
    """(keys, name, cnt): how often each word for which keep (a condition on name) holds stands in the rows of equal keys. Words are told
    apart where they stand, so the others are neither sorted nor counted; a row's words are added up before they are shuffled."""
    # outer, as Spark would split each text once more to see whether it holds any word; those without give null
    each = rows.select(*keys, F.explode_outer(words).alias(name))
    return each.where((F.col(name) != "") & keep).groupBy(*keys, name).agg(F.count("*").alias("cnt"))


def repeats(rows: DataFrame, keys: list[str]) -> bool:
    """True if rows have equal keys (null is one); only the keys are read."""
    return not rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
