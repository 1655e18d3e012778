"""Metadata of resources: joins with optional fields, codes of languages, statements by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where languages have their addresses, and predicates of catalogues.
LEXVO, GLOTTOLOG = "http://lexvo.org/id/iso639-3/", "https://glottolog.org/resource/languoid/id/"
DISTRIBUTION, ACCESS = "http://www.w3.org/ns/dcat#distribution", "http://www.w3.org/ns/dcat#accessURL"


def with_fields(resources: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """resources(url, ...) with a column per name out of values(url, field, value, at); the last value counts, none is null."""
    last = lambda n: F.max_by(F.when(F.col("field") == n, F.col("value")), F.when(F.col("field") == n, F.col("at"))).alias(n)
    return resources.join(values.where(F.col("field").isin(names)).groupBy("url").agg(*[last(n) for n in names]), "url", "left")


def crawled(webpages: DataFrame, types: DataFrame, format_: str | None = None) -> DataFrame:
    """(webpage_id, url, type): pages with their types, if wanted of one type only."""
    wanted = types if format_ is None else types.where(F.col("type") == format_)
    return webpages.join(wanted, webpages["webpage_id"] == wanted["url_id"]).select("webpage_id", "url", "type")


def access_urls(triples: DataFrame) -> DataFrame:
    """(dataset, distribution, url): data sets with the addresses of their distributions."""
    d = triples.where(F.col("p") == DISTRIBUTION).select(F.col("s").alias("dataset"), F.col("o").alias("distribution"))
    a = triples.where(F.col("p") == ACCESS).select(F.col("s").alias("distribution"), F.col("o").alias("url"))
    return d.join(a, "distribution").select("dataset", "distribution", "url").distinct()


def statements(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Statements of these parts; None is any."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples.select("s", "p", "o").distinct()


def clue_counts(triples: DataFrame, clues: list[str]) -> DataFrame:
    """(part, clue, n): how many statements hold a text in their subject, predicate or object."""
    parts = F.explode(F.array(*[F.struct(F.lit(x).alias("part"), F.col(x).alias("value")) for x in ("s", "p", "o")]))
    rows = triples.select(parts.alias("x")).select("x.*")
    hit = rows.select("part", F.explode(F.filter(F.array(*[F.when(F.col("value").contains(c), F.lit(c)) for c in clues]), lambda x: x.isNotNull())).alias("clue"))
    return hit.groupBy("part", "clue").agg(F.count("*").alias("n"))


def linked_languages(rows: DataFrame, codes: DataFrame, glottolog: DataFrame) -> DataFrame:
    """rows(lang, ...) with name, lexvo and glottolog address; codes(code, iso, name) knows two and three letters, glottolog(iso, id)."""
    known = rows.join(codes.select(F.col("code").alias("lang"), "iso", "name"), "lang", "left").join(glottolog, "iso", "left")
    return known.select(*rows.columns, "iso", "name", F.concat(F.lit(LEXVO), "iso").alias("lexvo"), F.concat(F.lit(GLOTTOLOG), "id").alias("glottolog"))


def language_classes(triples: DataFrame, code: str, label: str) -> DataFrame:
    """(iso, class, name): classes that carry a language code and a name."""
    c = triples.where(F.col("p") == code).select(F.col("s").alias("class"), F.col("o").alias("iso"))
    n = triples.where(F.col("p") == label).select(F.col("s").alias("class"), F.col("o").alias("name"))
    return c.join(n, "class").select("iso", "class", "name").distinct()


def language_codes(text: Column) -> Column:
    """The codes in a field of languages: parts between commas and semicolons without quotes, each an address that ends in a code, a
    code of two or three letters, or one before a hyphen or slash; others are left out."""
    parts = F.transform(F.split(text, "[,;]", -1), lambda x: F.trim(F.regexp_replace(x, "[\"']", "")))

    def code(x: Column) -> Column:
        found = F.when(x.rlike("^https?://(www\\.)?lexvo\\.org/"), F.regexp_extract(x, "/([a-z]{2,3})$", 1))
        return found.when(x.rlike("^[A-Za-z]{2,3}([-/].*)?$"), F.lower(F.regexp_extract(x, "^[A-Za-z]{2,3}", 0))).otherwise("")

    return F.array_distinct(F.filter(F.transform(parts, code), lambda x: x != ""))


def from_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with the fields of a JSON text; damaged texts give nulls."""
    return rows.withColumn("j", F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], "j.*")


def classified(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): counts by class, label and id, those without label as an empty one."""
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    return rows.groupBy(*filled).agg(F.count("*").alias("n"))


def by_rule(urls: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """urls with the first rule that holds, in order; what one rule takes the next don't see. '' where none does."""
    out = F.lit("")
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return urls.withColumn("rule", out)
