"""What a file's triples, predicates and URLs say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.columns import extension_of, format_of, last_segment

MOST_LITERAL = 35
#: Predicates whose objects are remarks, and those that name languages.
REMARKS = ("#comment", "#versionInfo", "#label")
LANGUAGE_PREDICATES = ("language", "lang", "inLanguage")
#: Words that tell of language resources, with their weights.
BUZZ_WORDS = {
    "language": 1, "phonolog": 1, "lexic": 1, "synta": 1, "morpholog": 1, "annotat": 1, "gramma": 1, "linguistic": 1, "corpus": 1, "corpora": 1, "verb": 1, "noun": 1, "semantic": 1,
    "subject": 1, "object": 1, "library": 1, "database": 1, "dataset": 1, "resource": 1, "linked data": 1, "language resource": 1000, "semantic web": 1000, "text corp": 1000, "llod": 1000,
    "rdf": 1000, "conll": 1000, "sparql": 1000,
}


def buzz_score(text: Column) -> Column:
    """The weights of the words that the text holds, as they are written, each once."""
    return sum((F.when(text.contains(w), n).otherwise(0) for w, n in BUZZ_WORDS.items()), F.lit(0)).cast("long")


def object_allowed(p: Column, o: Column, kind: Column) -> Column:
    """Objects that may be annotations: short literals without : / @ . , blanks and brackets that aren't all digits; all URIs."""
    remark = p.endswith(REMARKS[0]) | p.endswith(REMARKS[1]) | p.endswith(REMARKS[2])
    return ~remark & ((kind == "uri") | ((kind == "literal") & (F.length(o) <= MOST_LITERAL) & ~o.rlike(r"[:/@., \[\]{}]") & ~o.rlike("^[0-9]+$")))


def is_language_predicate(p: Column) -> Column:
    return last_segment(p).isin(list(LANGUAGE_PREDICATES)) | F.lower(last_segment(p)).contains("iso")


def object_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p", "o").agg(F.count("*").alias("cnt"))


def sampled_object_counts(triples: DataFrame, most: int, order: str) -> DataFrame:
    """Counts while sampling: once a predicate has `most` different objects, counting of its objects stops altogether."""
    first = triples.groupBy("p", "o").agg(F.min(order).alias("at")).withColumn("salt", F.pmod(F.xxhash64("o"), F.lit(64)))
    # the first `most` of each part hold the first `most` of all, so a predicate with very many objects is no single task's
    part = Window.partitionBy("p", "salt").orderBy("at", "o")
    first = first.withColumn("k", F.row_number().over(part)).where(F.col("k") <= most).drop("k", "salt")
    last = first.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("at", "o"))).where(F.col("n") == most).select("p", F.col("at").alias("stop"))
    return triples.join(last, "p", "left").where(F.col("stop").isNull() | (F.col(order) <= F.col("stop"))).groupBy("p", "o").agg(F.count("*").alias("cnt"))


def allowed_predicates(objects: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(p, allowed): whether any object of the predicate is in the dictionary."""
    known = dictionary.select(F.col("tag").alias("o")).distinct().withColumn("known", F.lit(True))
    return objects.join(known, "o", "left").groupBy("p").agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("allowed"))


def found_per_attribute(objects: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(p, tags): the dictionary's tags among each predicate's objects; an empty list stays."""
    known = dictionary.select(F.col("tag").alias("o")).distinct().withColumn("tag", F.col("o"))
    return objects.join(known, "o", "left").groupBy("p").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def predicate_quality(seen: DataFrame) -> DataFrame:
    """(predicate, good, bad, verdict) of seen(predicate, good, is_default, disabled): one row each observation."""
    per = seen.groupBy("predicate").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), F.bool_or("is_default").alias("d"), F.bool_or("disabled").alias("x"))
    verdict = F.when(F.col("d"), "good").when(F.col("x"), "bad").when(F.expr("good = 0 AND bad > 4"), "bad").when(F.expr("good > 0 AND bad < 4"), "good").otherwise("undecided")
    return per.select("predicate", "good", "bad", verdict.alias("verdict"))


def vocabularies(namespaces: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Vocabularies of which a namespace is the beginning, or that begin a namespace."""
    return namespaces.select("namespace").distinct().join(dictionary, F.expr("startswith(namespace, prefix) OR startswith(prefix, namespace)")).select("vocabulary").distinct()


def by_format(urls: DataFrame) -> DataFrame:
    return urls.select("url", extension_of(F.col("url")).alias("extension"), format_of(F.col("url")).alias("format"))


def format_statistics(urls: DataFrame, taken: list[str]) -> DataFrame:
    return by_format(urls).groupBy("format").agg(F.count("*").alias("n")).withColumn("taken", F.col("format").isin(taken))


def without_listed(urls: DataFrame, blacklist: list[str]) -> DataFrame:
    """URLs that hold none of the texts."""
    keep = F.lit(True)
    for text in blacklist:
        keep = keep & ~F.col("url").contains(text)
    return urls.where(keep)


def pool(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Different URLs of new that have not been seen."""
    return new.select("url").distinct().join(seen.select("url").distinct(), "url", "left_anti")


def folder_sample(files: DataFrame, good: int = 50, bad: int = 100, most: int = 200, least: int = 100) -> DataFrame:
    """files(folder, path, good) that are still read: a folder stops once it has `good` good ones or more, more than `bad` bad
    ones, or `most` in all; folders of fewer than `least` files are read whole. Counts are those before each file, by path."""
    from lexispark.plans.durable import written

    # ranges of paths, so that a large folder is many of them; counts of a folder's ranges are summed
    dealt = written(files.repartitionByRange("folder", "path").withColumn("_r", F.spark_partition_id()))
    per = dealt.groupBy("folder", "_r").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    upto = Window.partitionBy("folder").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    sums = per.select("folder", "_r", (F.sum("g").over(upto) - F.col("g")).alias("_g"), (F.sum("b").over(upto) - F.col("b")).alias("_b"), F.sum("g").over(upto).alias("_g2"), F.sum("b").over(upto).alias("_b2"), F.sum(F.col("g") + F.col("b")).over(Window.partitionBy("folder")).alias("_s"))
    stops = lambda g, b: (g >= good) | (b > bad) | (g + b >= most)
    whole = (F.col("_s") < least) | ~stops(F.col("_g2"), F.col("_b2"))
    ranges = dealt.join(sums.where(whole | ~stops(F.col("_g"), F.col("_b"))).withColumn("_w", whole), ["folder", "_r"])
    # only the range in which a folder stops is looked into
    before = Window.partitionBy("folder", "_r").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda c: F.coalesce(F.count_if(c).over(before), F.lit(0))
    inside = ranges.where("NOT _w").withColumns({"_x": n(F.col("good")), "_y": n(~F.col("good"))}).where(~stops(F.col("_g") + F.col("_x"), F.col("_b") + F.col("_y")))
    return ranges.where("_w").select(*files.columns).union(inside.select(*files.columns))
