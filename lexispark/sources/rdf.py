"""RDF syntaxes that come in records: TriX, flat RDF/XML descriptions, JSON-LD by lines; documents of any nesting are read by `trees`. All give (file_id, s, p, o, o_kind, o_lang, o_type).

Files are read as text, cut at the records' ends, so that large ones are split; no record needs its neighbours but for the names of
namespaces, which are joined per file. Turtle and TriG have no records; `turtle` reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources import readers, trees
from lexispark.sources.readers import decoded
from lexispark.sources.turtle import turtle

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
COLUMNS = ["file_id", "s", "p", "o", "o_kind", "o_lang", "o_type"]


def _records(spark: SparkSession, path: str, end: str) -> DataFrame:
    return spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("file_id"), "value")


def _attribute(of: Column, name: str) -> Column:
    return decoded(F.regexp_extract(of, rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1))


def trix(spark: SparkSession, path: str) -> DataFrame:
    """TriX: of each triple's elements in order subject, predicate, object. Graph names are not kept."""
    body = F.regexp_extract("value", r"(?s)<triple\s*>(.*)$", 1)
    parts = F.regexp_extract_all(body, F.lit(r"(?s)<(?:uri|id|plainLiteral|typedLiteral)\b[^>]*>[^<]*"), F.lit(0))
    rows = _records(spark, path, "</triple>").select("file_id", parts.alias("e")).where(F.size("e") == 3)
    text = lambda e: decoded(F.trim(F.regexp_extract(e, r"(?s)>([^<]*)$", 1)))
    node = lambda e: F.when(e.startswith("<id"), F.concat(F.lit("_:"), text(e))).otherwise(text(e))
    o = F.col("e")[2]
    kind = F.when(o.startswith("<uri"), "uri").when(o.startswith("<id"), "blank").otherwise("literal")
    return rows.select("file_id", node(F.col("e")[0]).alias("s"), text(F.col("e")[1]).alias("p"), node(o).alias("o"), kind.alias("o_kind"), _attribute(o, "xml:lang").alias("o_lang"), _attribute(o, "datatype").alias("o_type"))


def rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """RDF/XML of flat rdf:Description elements: a statement per property, with its resource or its text."""
    records = _records(spark, path, "</rdf:Description>")
    spaces = records.select("file_id", F.explode(F.regexp_extract_all("value", F.lit(r"""(xmlns:[\w.-]+\s*=\s*["'][^"']*["'])"""), F.lit(1))).alias("x"))
    spaces = spaces.select("file_id", F.regexp_extract("x", r"xmlns:([\w.-]+)", 1).alias("prefix"), F.regexp_extract("x", r"""["']([^"']*)["']""", 1).alias("space")).distinct()
    body = F.regexp_extract("value", r"(?s)<rdf:Description\b(.*)$", 1)
    elements = F.regexp_extract_all(body, F.lit(r"(?s)<[\w.-]+:[\w.-]+(?:\s[^>]*)?>[^<]*"), F.lit(0))
    head = F.regexp_extract(body, r"(?s)^([^>]*)>", 1)
    rows = records.select("file_id", head.alias("head"), F.explode(elements).alias("e"))
    name = F.regexp_extract("e", r"^<([\w.-]+:[\w.-]+)", 1)
    about, blank = _attribute(F.col("head"), "rdf:about"), _attribute(F.col("head"), "rdf:nodeID")
    resource = _attribute(F.col("e"), "rdf:resource")
    value = decoded(F.regexp_extract("e", r"(?s)>([^<]*)$", 1))
    named = rows.select(
        "file_id", F.when(about != "", about).otherwise(F.concat(F.lit("_:"), blank)).alias("s"), F.substring_index(name, ":", 1).alias("prefix"), F.substring_index(name, ":", -1).alias("local"),
        F.when(resource != "", resource).otherwise(value).alias("o"), F.when(resource != "", "uri").otherwise("literal").alias("o_kind"), _attribute(F.col("e"), "xml:lang").alias("o_lang"), _attribute(F.col("e"), "rdf:datatype").alias("o_type"),
    )
    return named.join(spaces, ["file_id", "prefix"]).select("file_id", "s", F.concat("space", "local").alias("p"), "o", "o_kind", "o_lang", "o_type")


def json_ld(spark: SparkSession, path: str) -> DataFrame:
    """JSON-LD, one flat node object per line: values, {"@id"}, {"@value", "@language", "@type"} and arrays of them; names are looked
    up in the line's own @context (terms, prefixes, @vocab)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_id"), F.from_json("value", "map<string,string>").alias("m")).where("m IS NOT NULL")
    context = F.coalesce(F.from_json(F.try_element_at("m", F.lit("@context")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = lines.select("file_id", context.alias("c"), F.try_element_at("m", F.lit("@id")).alias("s"), F.explode("m").alias("k", "v")).where("k NOT IN ('@context', '@id')")

    def full(name: Column) -> Column:
        prefix, rest = F.substring_index(name, ":", 1), F.regexp_extract(name, "^[^:]*:(.*)$", 1)
        by_prefix = F.when(name.contains(":"), F.coalesce(F.concat(F.try_element_at("c", prefix), rest), name))
        return F.coalesce(F.try_element_at("c", name), by_prefix, F.concat(F.try_element_at("c", F.lit("@vocab")), name), name)

    items = F.when(F.trim("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    one = rows.select("file_id", "c", "s", "k", F.explode(items).alias("v"))
    part = F.when(F.trim("v").startswith("{"), F.from_json("v", "map<string,string>"))
    one = one.withColumn("x", part)
    get = lambda name: F.try_element_at("x", F.lit(name))
    is_type = F.col("k") == "@type"
    o = F.when(is_type, full(F.col("v"))).otherwise(F.coalesce(get("@id"), get("@value"), F.col("v")))
    kind = F.when(is_type | get("@id").isNotNull(), "uri").otherwise("literal")
    return one.select("file_id", full(F.col("s")).alias("s"), F.when(is_type, F.lit(RDF + "type")).otherwise(full(F.col("k"))).alias("p"), o.alias("o"), kind.alias("o_kind"), F.coalesce(get("@language"), F.lit("")).alias("o_lang"), F.coalesce(get("@type"), F.lit("")).alias("o_type"))


#: rdf and jsonld are whole documents, rdf-records and jsonl the flat forms that are split.
READERS = {"trix": trix, "rdf": trees.rdf_xml, "jsonld": trees.json_ld, "rdf-records": rdf_xml, "jsonl": json_ld, "ttl": turtle, "trig": turtle, "nt": readers.ntriples, "nq": readers.ntriples}
#: Endings and MIME types of the syntaxes.
SYNTAXES = {"nt": "nt", "nq": "nq", "ttl": "ttl", "n3": "ttl", "trig": "trig", "trix": "trix", "rdf": "rdf", "owl": "rdf", "xml": "rdf", "jsonld": "jsonld"}
MIMES = {"application/n-triples": "nt", "application/n-quads": "nq", "text/turtle": "ttl", "text/n3": "ttl", "application/trig": "trig", "application/trix": "trix", "application/rdf+xml": "rdf", "application/ld+json": "jsonld"}


def syntax_of(path: str, mime: str = "") -> str | None:
    """The syntax by MIME type, else by the name's ending (packed or not); None if neither is known."""
    name = path.rstrip("/").rpartition("/")[2].lower().removesuffix(".gz").removesuffix(".bz2")
    return MIMES.get(mime.partition(";")[0].strip().lower()) or SYNTAXES.get(name.rpartition(".")[2])


def read(spark: SparkSession, path: str, syntax: str | None = None, mime: str = "") -> DataFrame:
    """The statements of a file or folder in one of READERS' syntaxes, by default that of MIME type or name. What isn't understood is
    left out; the readers themselves have it in `corrupt`."""
    syntax = syntax or syntax_of(path, mime)
    if syntax not in READERS:
        raise ValueError(f"unknown syntax of {path}")
    found = READERS[syntax](spark, path)
    found = found.where("corrupt IS NULL") if "corrupt" in found.columns else found
    return found.select(*COLUMNS[:5], F.coalesce("o_lang", F.lit("")).alias("o_lang"), F.coalesce("o_type", F.lit("")).alias("o_type"))


def words_in_order(triples: DataFrame, next_word: str, columns: dict[str, str]) -> DataFrame:
    """(head, row_no, word, columns...): annotation kept as statements, as rows: sentences are followed from the words that no other
    points at; each column is the object of its predicate, or null. Ways back are doubled each round, so a sentence of n words takes
    log n of them; words that only a cycle leads to have no place and are left out."""
    from lexispark.plans.durable import written

    link = triples.where(F.col("p") == next_word).select("s", "o").distinct()
    words = triples.where(F.col("p").isin(next_word, *columns.values())).select(F.col("s").alias("word")).distinct()
    heads = written(words.join(link.select(F.col("o").alias("word")), "word", "left_anti"))
    first = heads.select(F.col("word").alias("back"), F.lit(True).alias("done"))
    way = written(link.select(F.col("o").alias("word"), F.col("s").alias("back"), F.lit(1).cast("long").alias("row_no")).join(first, "back", "left").select("word", "back", "row_no", F.coalesce("done", F.lit(False)).alias("done")))
    order, limit = heads.select(F.col("word").alias("head"), F.lit(0).cast("long").alias("row_no"), "word"), way.count().bit_length()
    for _ in range(limit):
        if way.where("NOT done").isEmpty():
            break
        further = way.select(F.col("word").alias("back"), F.col("back").alias("far"), F.col("row_no").alias("more"), F.col("done").alias("there"))
        moved = way.where("NOT done").join(further, "back").select("word", F.col("far").alias("back"), (F.col("row_no") + F.col("more")).alias("row_no"), F.col("there").alias("done"))
        way = written(way.where("done").union(moved))
    order = order.union(way.where("done").select("back", "row_no", "word"))
    wide = triples.where(F.col("p").isin(list(columns.values()))).groupBy(F.col("s").alias("word")).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in columns.items()])
    return order.join(wide, "word", "left").select("head", "row_no", "word", *columns)
