"""Catalogue exports as rows: N-Triples lines, nested JSON, library records, display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of the catalogue vocabularies.
TYPE, DATASET, DISTRIBUTION, LANGUAGE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/ns/dcat#Dataset", "http://www.w3.org/ns/dcat#distribution", "http://purl.org/dc/terms/language"


def escaped(value: Column) -> Column:
    """A literal's text as N-Triples wants it."""
    out = value
    for char, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(mark))
    return out


def iri(value: Column) -> Column:
    """An IRI in its brackets, characters that must not stand in them as percent codes."""
    for char in ("<", ">", '"', "{", "}", "|", "^", "`", "\\", " ", "\n", "\r", "\t"):
        value = F.replace(value, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.concat(F.lit("<"), value, F.lit(">"))


def xml_text(value: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(char), F.lit(name))
    return value


def ntriples(files: DataFrame) -> DataFrame:
    """(line) of accepted files: a data set per resource, a distribution per file, the languages."""
    line = lambda p, o: F.concat(iri(F.col("url")), F.lit(f" <{p}> "), o, F.lit(" ."))
    node = F.concat("url", F.lit("#"), F.sha2(F.col("file_id").cast("string"), 256))
    lines = F.array(line(TYPE, F.lit(f"<{DATASET}>")), line(DISTRIBUTION, iri(node)), line(LANGUAGE, F.concat(F.lit('"'), escaped(F.col("lang")), F.lit('"'))))
    return files.where("status = 'ACCEPTED'").select(F.explode(lines).alias("line")).distinct()


def nested_json(files: DataFrame) -> DataFrame:
    """(url, json): per resource its languages and its files, ordered."""
    per = files.groupBy("url").agg(F.sort_array(F.collect_set("lang")).alias("languages"), F.sort_array(F.collect_list(F.struct("file_id", "format", "status", "type", "lang"))).alias("files"))
    return per.select("url", F.to_json(F.struct("url", "languages", "files")).alias("json"))


def records(files: DataFrame) -> DataFrame:
    """(url, record): a library record as XML text."""
    safe = xml_text(F.col("url"))
    per = files.groupBy("url").agg(xml_text(F.array_join(F.sort_array(F.collect_set("lang")), " ")).alias("l"), F.count("*").alias("n"))
    return per.select("url", F.concat(F.lit("<record><identifier>"), safe, F.lit("</identifier><languages>"), "l", F.lit("</languages><files>"), F.col("n").cast("string"), F.lit("</files></record>")).alias("record"))


def display(rows: DataFrame) -> DataFrame:
    """(url, shown): "code (columns), ..." of rows(url, lang, col)."""
    per = rows.groupBy("url", "lang").agg(F.array_join(F.sort_array(F.collect_set("col")), ",").alias("cols"))
    parts = F.sort_array(F.collect_list(F.struct("lang", "cols")))
    return per.groupBy("url").agg(parts.alias("p")).select("url", F.array_join(F.transform("p", lambda x: F.concat(x["lang"], F.lit(" ("), x["cols"], F.lit(")"))), ", ").alias("shown"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One line per row, in parallel files."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def statement_lines(triples: DataFrame) -> DataFrame:
    """(line): triples(s, p, o, o_kind, o_lang, o_type) as N-Triples."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(iri(c))
    lang, kind = F.coalesce("o_lang", F.lit("")), F.coalesce("o_type", F.lit(""))
    mark = F.when(lang != "", F.concat(F.lit("@"), lang)).when(kind != "", F.concat(F.lit("^^"), iri(kind))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), mark)).otherwise(node(F.col("o")))
    return triples.select(F.concat(node(F.col("s")), F.lit(" "), iri(F.col("p")), F.lit(" "), o, F.lit(" .")).alias("line"))


def save_graph(node: DataFrame, edge: DataFrame, path: str, form: str = "json") -> None:
    """A graph's nodes and edges, or a term model's, for other tools (json) or for later (parquet)."""
    for name, df in (("node", node), ("edge", edge)):
        df.write.mode("overwrite").format(form).save(f"{path.rstrip('/')}/{name}")


def merged_json(files: DataFrame) -> DataFrame:
    """(key, json): resources with their files; resources of a single file whose metadata come from the user and are equal (meta_hash)
    are one. files(url, file_id, meta_source, meta_hash, lang, format)."""
    size = files.groupBy("url").agg(F.count("*").alias("n"), F.max("meta_hash").alias("h"), F.bool_and(F.col("meta_source") == "USER").alias("u"))
    key = F.when((F.col("n") == 1) & F.col("u") & (F.col("h") != ""), F.col("h")).otherwise(F.col("url"))
    rows = files.join(size.select("url", key.alias("key")), "url")
    per = rows.groupBy("key").agg(
        F.sort_array(F.collect_set("url")).alias("urls"), F.sort_array(F.collect_set("lang")).alias("languages"), F.sort_array(F.collect_list(F.struct("file_id", "format", "lang"))).alias("files")
    )
    return per.select("key", F.to_json(F.struct("urls", "languages", "files")).alias("json"))


def catalogue(files: DataFrame, models: DataFrame, concepts: DataFrame) -> DataFrame:
    """(line): the whole catalogue of accepted files as N-Triples: data sets with their titles and number of files, distributions with
    format and size, languages by address, models and the concepts found. files(url, file_id, status, lang, format, n_chars, source),
    models(file_id, model), concepts(file_id, concept)."""
    ok = files.where("status = 'ACCEPTED'").withColumn("node", F.concat("url", F.lit("#"), F.sha2(F.col("file_id").cast("string"), 256)))
    per = ok.groupBy("url").agg(F.max("source").alias("title"), F.count_distinct("file_id").alias("n"))
    own = ok.select("file_id", "node")
    term = "http://purl.org/dc/terms/"
    literal, uri = F.lit("literal"), F.lit("uri")
    row = lambda df, s, p, o, kind: df.select(F.col(s).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), kind.alias("o_kind"), F.lit("").alias("o_lang"), F.lit("").alias("o_type"))
    parts = [
        row(per, "url", TYPE, F.lit(DATASET), uri), row(per, "url", term + "title", F.col("title"), literal), row(per, "url", term + "extent", F.col("n"), literal),
        row(ok, "url", DISTRIBUTION, F.col("node"), uri), row(ok, "node", term + "format", F.col("format"), literal), row(ok, "node", "http://www.w3.org/ns/dcat#byteSize", F.col("n_chars"), literal),
        row(ok.where("lang <> ''"), "node", LANGUAGE, F.concat(F.lit("http://lexvo.org/id/iso639-3/"), "lang"), uri),
        row(own.join(models, "file_id"), "node", term + "conformsTo", F.col("model"), literal), row(own.join(concepts, "file_id"), "node", term + "subject", F.col("concept"), literal),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return statement_lines(out.distinct())


def xml_records(rows: DataFrame, key: str, root: str, elements: dict[str, str]) -> DataFrame:
    """(key, record): a library record per row, an element for each of elements(element -> column or array column) that is not null."""
    kinds = dict(rows.dtypes)

    def element(name: str, column: str) -> Column:
        one = lambda v: F.concat(F.lit(f"<{name}>"), xml_text(v.cast("string")), F.lit(f"</{name}>"))
        if kinds[column].startswith("array"):
            return F.coalesce(F.array_join(F.transform(column, one), ""), F.lit(""))
        return F.coalesce(one(F.col(column)), F.lit(""))

    return rows.select(key, F.concat(F.lit(f"<{root}>"), *[element(n, c) for n, c in elements.items()], F.lit(f"</{root}>")).alias("record"))
