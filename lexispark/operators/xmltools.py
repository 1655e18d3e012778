"""Annotated XML, as rows of readers.xml_overview: which attributes annotate, which template fits, conversion to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL_DOMAIN, SHARE, ACCEPTED = 0.4, 0.8, 0.6


def start_elements(overview: DataFrame) -> DataFrame:
    return overview.where("attr = ''").groupBy("file_id").agg(F.count("*").alias("n"))


def frequencies(overview: DataFrame) -> DataFrame:
    return overview.where("attr <> ''").groupBy("path", "attr", "value").agg(F.count("*").alias("n"))


def reduced(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent values of each attribute, at most so many."""
    order = [F.col("n").desc(), F.col("value")]
    some = counts.withColumn("_s", F.pmod(F.xxhash64("value"), F.lit(64)))
    for keys in (["path", "attr", "_s"], ["path", "attr"]):  # first within parts, as an attribute can have very many values
        some = some.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most)
    return some.drop("_k", "_s")


def key_space(overview: DataFrame) -> DataFrame:
    return overview.where("attr <> ''").groupBy("path").agg(F.sort_array(F.collect_set("attr")).alias("attrs"))


def complete_nodes(overview: DataFrame) -> DataFrame:
    """overview without elements that lack an attribute which others of their path have."""
    own = overview.where("attr <> ''").groupBy("file_id", "node_no", "path").agg(F.count_distinct("attr").alias("has"))
    all_ = overview.where("attr <> ''").groupBy("path").agg(F.count_distinct("attr").alias("may"))
    full = own.join(all_, "path").where("has = may").select("file_id", "node_no")
    return overview.join(full, ["file_id", "node_no"], "left_semi")


def annotation_attributes(overview: DataFrame) -> DataFrame:
    """Attributes that pass two of three checks: few different values, mostly not all small letters, mostly without blanks."""
    v = F.col("value")
    counts = overview.where("attr <> ''").groupBy("path", "attr").agg(F.count_distinct("value").alias("types"), F.count("*").alias("n"), F.count_if(v != F.lower(v)).alias("upper"), F.count_if(~v.contains(" ")).alias("solid"))
    checks = [F.col("types") / F.col("n") < SMALL_DOMAIN, F.col("upper") >= SHARE * F.col("n"), F.col("solid") >= SHARE * F.col("n")]
    return counts.where(sum((c.cast("int") for c in checks), F.lit(0)) / 3 > ACCEPTED).select("path", "attr")


def template_quality(templates: DataFrame, overview: DataFrame) -> DataFrame:
    """(id, accuracy, precision, recall) of templates(id, p), p being path@attribute: Jaccard, and the shares of either side."""
    there = overview.where("attr NOT IN ('', 'text()')").select(F.concat("path", F.lit("@"), "attr").alias("p")).distinct().withColumn("hit", F.lit(1))
    size = there.agg(F.count("*").alias("m"))
    per = templates.distinct().join(there, "p", "left").groupBy("id").agg(F.count("hit").alias("i"), F.count("*").alias("n")).join(F.broadcast(size))
    share = lambda of: F.round(F.col("i") / of, 6)
    return per.select("id", share(F.col("n") + F.col("m") - F.col("i")).alias("accuracy"), share(F.col("n")).alias("precision"), share(F.col("m")).alias("recall"))


def best_template(quality: DataFrame) -> DataFrame:
    return quality.agg(F.max_by("id", F.struct("recall", "accuracy", "precision")).alias("id"))


def word_path(overview: DataFrame) -> DataFrame:
    """The path of most elements."""
    return overview.where("attr = ''").groupBy("path").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "path")).alias("m")).select("m.path")


def sentence_path(overview: DataFrame) -> DataFrame:
    """The longest beginning that all paths of several elements share; if it is the word path itself, without its last element."""
    from lexispark.plans.durable import written

    counts = overview.where("attr = ''").groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    parts = counts.select("path", F.posexplode(F.expr("slice(split(path, '/'), 2, 100)")).alias("at", "element"))
    counts = written(counts)
    total = counts.agg(F.count("*").alias("total"))
    shared = parts.groupBy("at").agg(F.count_distinct("element").alias("types"), F.count("*").alias("n"), F.first("element").alias("element")).join(F.broadcast(total))
    kept = shared.where("types = 1 AND n = total").agg(F.sort_array(F.collect_list(F.struct("at", "element"))).alias("s"))
    prefix = kept.select(F.concat(F.lit("/"), F.array_join(F.transform(F.filter("s", lambda x, i: x["at"] == i), lambda x: x["element"]), "/")).alias("path"))
    word = counts.agg(F.max(F.struct("n", "path")).alias("m")).select(F.col("m.path").alias("word"))
    return prefix.join(F.broadcast(word)).select(F.when(F.col("path") == F.col("word"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path")).alias("path"))


def rows(overview: DataFrame, path: str, columns: list[str], features: list[str]) -> DataFrame:
    """(file_id, node_no, line): tab-separated columns of the word elements; features as name=value, _ if none."""
    own = overview.where(F.col("path") == path)
    value = lambda a: F.max(F.when(F.col("attr") == a, F.col("value")))
    wide = own.groupBy("file_id", "node_no").agg(*[value(a).alias(f"c{i}") for i, a in enumerate([*columns, *features])])
    feats = F.concat_ws("|", *[F.concat(F.lit(f"{a}="), F.col(f"c{len(columns) + i}")) for i, a in enumerate(features)])
    return wide.select("file_id", "node_no", F.concat_ws("\t", *[F.col(f"c{i}") for i in range(len(columns))], F.when(feats == "", "_").otherwise(feats)).alias("line"))


def subtrees(overview: DataFrame, path: str) -> DataFrame:
    """overview's rows that stand in an element of the path, with root_no, that element's number: one tree each."""
    own = F.when((F.col("path") == path) & (F.col("attr") == ""), F.col("node_no"))
    inside = (F.col("path") == path) | F.col("path").startswith(path + "/")
    before = Window.partitionBy("file_id").orderBy("node_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return overview.where(inside).withColumn("root_no", F.max(own).over(before))


def sampled_subtrees(trees: DataFrame, k: int, seed: int) -> DataFrame:
    """(file_id, root_no): k trees by the order of a seeded hash."""
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("file_id").cast("string"), F.col("root_no").cast("string")))
    return trees.select("file_id", "root_no").distinct().orderBy(order).limit(k)


def parents(overview: DataFrame) -> DataFrame:
    """(path, attributes, rank): elements by how many different attributes they have."""
    n = overview.where("attr NOT IN ('', 'text()')").groupBy("path").agg(F.count_distinct("attr").alias("attributes"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("attributes").desc(), "path")))


def pruned(overview: DataFrame, allowed: DataFrame) -> DataFrame:
    """(path, attr, state, n): allowed(path, attr) that are there are kept, or else missing; others are dropped."""
    there = overview.where("attr <> ''").groupBy("path", "attr").agg(F.count("*").alias("n"))
    both = there.join(allowed.select("path", "attr").distinct().withColumn("a", F.lit(True)), ["path", "attr"], "full_outer")
    return both.select("path", "attr", F.when(F.col("n").isNull(), "missing").when(F.col("a").isNull(), "dropped").otherwise("kept").alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def attribute_sample(overview: DataFrame, most: int) -> DataFrame:
    """(path, attr, kind, value): the first values of each attribute, literals and addresses apart."""
    kind = F.when(F.col("value").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), "url").otherwise("literal")
    some = overview.where("attr <> ''").select("path", "attr", kind.alias("kind"), "value").distinct().withColumn("_s", F.pmod(F.xxhash64("value"), F.lit(64)))
    for keys in (["path", "attr", "kind", "_s"], ["path", "attr", "kind"]):
        some = some.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).where(F.col("_k") <= most)
    return some.drop("_k", "_s")


def template_similarity(templates: DataFrame) -> DataFrame:
    """(a, b, similarity) of templates(id, p), a before b: shared paths by all paths of both; pairs that share none are left out."""
    own = templates.select("id", "p").distinct()
    size = own.groupBy("id").agg(F.count("*").alias("n"))
    shared = own.alias("x").join(own.alias("y"), "p").where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("both"))
    sized = shared.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("similarity"))


def chosen_elements(overview: DataFrame, written, most_urls: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, attr): attributes worth annotating. Those with at most `most_urls` values, all addresses, or with values of one
    character only are dropped. Of the elements that carry an attribute of one name, those that cover its values are taken, greedily:
    each round the one that adds most (of equal ones the least path); all attributes of the elements taken stay. keys: columns that
    tell files apart, each of which is then covered by itself."""
    values = written(overview.where("attr NOT IN ('', 'text()')").select(*keys, "path", "attr", "value").distinct())
    url = F.col("value").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    per = values.groupBy(*keys, "path", "attr").agg(F.bool_and(url).alias("urls"), F.count("*").alias("n"), F.max(F.length("value")).alias("longest"))
    good = per.where(~((F.col("urls") & (F.col("n") <= most_urls)) | (F.col("longest") <= 1))).select(*keys, "path", "attr")
    left = written(values.join(good, [*keys, "path", "attr"], "left_semi"))
    taken = None
    while not left.isEmpty():
        gain = left.groupBy(*keys, "attr", "path").agg(F.count("*").alias("n")).groupBy(*keys, "attr").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("m")).select(*keys, "attr", "m.path")
        gain = written(gain)
        taken = gain if taken is None else taken.union(gain)
        left = written(left.join(left.join(gain, [*keys, "attr", "path"]).select(*keys, "attr", "value").distinct(), [*keys, "attr", "value"], "left_anti").select(*keys, "path", "attr", "value"))
    if taken is None:
        return good.limit(0)
    return values.select(*keys, "path", "attr").distinct().join(taken.select(*keys, "path").distinct(), [*keys, "path"], "left_semi").select(*keys, "path", "attr")


def column_map(columns: list[str], overview: DataFrame, path: str) -> DataFrame:
    """(path, attr, col, types): which column of the converted rows an attribute of the word element becomes."""
    order = overview.sparkSession.createDataFrame([(a, i) for i, a in enumerate(columns)], "attr string, col int")
    own = overview.where((F.col("path") == path) & (F.col("attr") != "")).groupBy("path", "attr").agg(F.count_distinct("value").alias("types"))
    return own.join(order, "attr").select("path", "attr", "col", "types")
