"""Readers of line and document formats; all return DataFrames and read in parallel.

Line formats (N-Triples, N-Quads, tab-separated annotation, URL seeds, code tables) are split by expressions. XML documents
are walked per row in `mapInArrow`, as Spark's own XML source wants one row tag while here every element counts."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line of N-Triples or N-Quads: subject, predicate, object with language or type, graph. Repeated groups are possessive here and
#: wherever texts may be long: others recurse in the JVM for each repetition.
TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
MIN_ROWS, MAX_ROWS = 100, 2000

#: Up to this size (in bytes, as Spark estimates it) a table in fewer files than cores is dealt out anew.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores if it has fewer files than there are (a small file is one task's); others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def unescaped(body: Column) -> Column:
    """A literal's text, its escapes read once from left to right."""
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def plain(x: Column) -> Column:
        mark = F.substring(x, 2, 1)
        point = F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        char = F.when(mark.isin("u", "U") & (F.length(x) > 2), point)
        for name, value in (("n", "\n"), ("t", "\t"), ("r", "\r"), ("b", "\b"), ("f", "\f")):
            char = char.when(mark == name, F.lit(value))
        return F.when(~x.startswith("\\"), x).otherwise(char.otherwise(mark))

    return F.when(body.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(body)


def parse_triples(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with s, p, o, o_kind (uri, blank, literal), o_lang, o_type, g (of quads) and corrupt (a line that is no triple, comment or blank)."""
    part = lambda n: F.regexp_extract(line, TRIPLE, n)
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    o = part(3)
    literal = o.startswith('"')
    body = F.regexp_extract(o, r'^"((?:[^"\\]++|\\.)*+)"', 1)
    body = unescaped(body)
    good = part(2) != ""
    return lines.where(~F.col(line).rlike(r"^\s*(#.*)?$")).select(
        *[c for c in lines.columns if c != line],
        F.when(good, strip(part(1))).alias("s"),
        F.when(good, strip(part(2))).alias("p"),
        F.when(good, F.when(literal, body).otherwise(strip(o))).alias("o"),
        F.when(good, F.when(literal, "literal").when(o.startswith("_:"), "blank").otherwise("uri")).alias("o_kind"),
        F.when(good & literal, F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1)).alias("o_lang"),
        F.when(good & literal, F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1)).alias("o_type"),
        F.when(good & (part(4) != ""), strip(part(4))).alias("g"),
        F.when(~good, F.col(line)).alias("corrupt"),
    )


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_id"), "value")
    return parse_triples(lines)


def _ordered(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, block, at, value): lines of text files; (block, at) is their order in a file, whatever its splits."""
    where = [F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return spark.read.text(path).select(*where, "value")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows(file_id, block, at, ...) with their place in the file: counts of a file's splits are summed, and rows numbered in each
    split alone."""
    counts = rows.groupBy("file_id", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("file_id", "block", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file_id", "block").orderBy("at")) - 1
    return rows.withColumn(name, own).join(offsets, ["file_id", "block"]).withColumn(name, F.col("before") + F.col(name)).drop("before")


def conll(spark: SparkSession, path: str, least: int = MIN_ROWS, most: int = MAX_ROWS, comment: str = "#") -> DataFrame:
    """(file_id, row_no, col, value): files with `least` rows or more, each cut at `most` (-1: whole), blank and comment lines left out.

    Files are read by lines and may be of any size, as rows are numbered split by split."""
    rows = _ordered(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith(comment))
    long = rows.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("file_id")
    rows = _numbered(rows, "row_no")
    rows = rows.where(F.col("row_no") < most) if most >= 0 else rows
    return rows.join(long, "file_id", "left_semi").select("file_id", "row_no", F.posexplode(F.split("value", "\t", -1)).alias("col", "value"))


def url_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url, meta_url, sample): a leading @ turns sampling off, a missing second column is empty, lines without URL are left out."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(F.trim(parts[0]).alias("raw"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("meta_url"))
    url = F.regexp_replace("raw", "^@", "")
    return rows.select(url.alias("url"), "meta_url", (~F.col("raw").startswith("@")).alias("sample")).where(F.col("url").rlike("^(https?|ftp|file)://[^\\s/]"))


def code_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated code table with header; the byte order mark goes."""
    df = spark.read.csv(path, sep="\t", header=True, quote="")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, length, md5, sha256) of all files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def decoded(text: Column) -> Column:
    """The character references that addresses and plain texts hold."""
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def resolved(href: Column, page: Column) -> Column:
    """The address of a link that stands on a page, with . and .. taken out of its path."""
    base = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(path, "^(.*/)?", 0), F.when(path.contains("/"), "").otherwise("/"))
    relative = F.when(href.startswith("?"), F.concat(F.when(path == "", "/").otherwise(path), href)).when(href.startswith("/"), href).otherwise(F.concat(folder, href))
    place, rest = F.regexp_extract(relative, "^[^?#]*", 0), F.regexp_extract(relative, "[?#].*$", 0)
    step = lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    parts = F.aggregate(F.slice(F.split(place, "/", -1), 2, 100_000), F.array(F.lit("")), step)
    clean = F.when(place.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(parts, "/"), F.when(place.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(place)
    whole = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.substring_index(base, "//", 1), href))
    return whole.otherwise(F.concat(base, clean, rest))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, url, is_file): link targets as written, resolved against the page's address, and whether the last part of
    the path holds a dot."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    href = decoded(F.trim(F.regexp_replace(F.col("raw"), "^[\"']|[\"']$", "")))
    links = pages.select("page_id", F.col("url").alias("page"), F.explode(found).alias("raw")).select("page_id", "page", href.alias("href")).where("href <> ''")
    last = F.regexp_extract("url", r"^[^/]+//[^/?#]*[^?#]*/([^/?#]*)", 1)
    return links.select("page_id", "href", resolved(F.col("href"), F.col("page")).alias("url")).withColumn("is_file", last.contains("."))


def html_text(html: str) -> Column:
    """Markup out, a handful of references decoded, white space collapsed: text enough to search in."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded(out), r"\s+", " "))


class _Enough(Exception):
    """So many elements were wanted."""


def walked(text: str, most: int) -> list[tuple[int, str, str, str]]:
    """(node_no, path, attr, value) of one document."""
    rows: list[tuple[int, str, str, str]] = []
    open_: list[tuple[int, str, list[str]]] = []
    count = 0

    def start(name: str, attributes: list[str]) -> None:
        nonlocal count
        if 0 <= most <= count:
            raise _Enough
        where = f"{open_[-1][1] if open_ else ''}/{name.rpartition(':')[2]}"
        open_.append((count, where, []))
        rows.append((count, where, "", ""))
        rows.extend((count, where, k, v) for k, v in zip(attributes[::2], attributes[1::2], strict=True))
        count += 1

    def end(name: str) -> None:
        no, where, own = open_.pop()
        if content := "".join(own).strip():
            rows.append((no, where, "text()", content))

    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda content: open_ and open_[-1][2].append(content)
    try:
        parser.Parse(text, True)
    except (_Enough, expat.ExpatError):
        pass
    return rows


def xml_overview(docs: DataFrame, most: int = -1) -> DataFrame:
    """(file_id, node_no, path, attr, value) of docs(file_id, xml): a row per element (attr ''), attribute and text ("text()").

    Namespaces of element names are left out; no DTD is read. most: only so many start elements. Damaged documents give what
    stands before the damage."""

    kind = pa.schema([("file_id", pa.int64()), ("node_no", pa.int32()), ("path", pa.string()), ("attr", pa.string()), ("value", pa.string())])

    def batch(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, *zip(*rows, strict=True)), kind.types, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids: list = []
            rows: list[tuple] = []
            for file_id, text in zip(x["file_id"].to_pylist(), x["xml"].to_pylist(), strict=True):
                own = walked(text or "", most)
                rows += own
                ids += [file_id] * len(own)
                if len(rows) > 50_000:
                    yield batch(ids, rows)
                    ids, rows = [], []
            if rows:
                yield batch(ids, rows)

    return docs.select(F.col("file_id").cast("long").alias("file_id"), "xml").mapInArrow(run, "file_id long, node_no int, path string, attr string, value string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line_no, value): line_no counts in file order, whatever the splits."""
    return _numbered(_ordered(spark, path), "line_no").select("file_id", "line_no", "value")


def load_graph(spark: SparkSession, path: str, node: str, edge: str, form: str = "json") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as exports.save_graph wrote them; node and edge are their schemas."""
    return tuple(spark.read.format(form).schema(schema).load(f"{path.rstrip('/')}/{name}") for name, schema in (("node", node), ("edge", edge)))
