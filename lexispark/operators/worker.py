"""From files to results: the format of each file is told, and each goes to the handler of its format.

files(file_id, folder, path, media_type, content) hold whole files as bytes, as Spark's binaryFile source reads them; a file is a row,
so it is one task's until it has been cut into lines, statements or elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.columns import format_of_file
from lexispark.operators import conversion, handlers, observations, scoring
from lexispark.sources import readers, trees

HANDLED = ["RDF", "CONLL", "XML"]
PARTS = 64


def first_files(files: DataFrame, most: int) -> DataFrame:
    """The first `most` files of each folder by path; ranked in parts first, so a folder of very many is no single task's."""
    some = files.select("folder", "path", "file_id").withColumn("_s", F.pmod(F.xxhash64("path"), F.lit(PARTS)))
    for keys in (["folder", "_s"], ["folder"]):
        some = some.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("path", "file_id"))).where(F.col("_k") <= most)
    return files.join(some.select("file_id"), "file_id", "left_semi")


def statements(files: DataFrame) -> DataFrame:
    """(file_id, at, p, o, o_kind) of RDF files: documents that begin with < and a name are RDF/XML, those that begin with { or [ JSON-LD,
    others lines of N-Triples or N-Quads. What isn't understood is left out."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    head = F.regexp_replace(F.substring(text, 1, 1000), r"^\s*+", "")
    kind = F.when(head.rlike("^<[?!]|^<[A-Za-z_][^<>]*?:RDF[\\s>]"), "xml").when(head.rlike(r"^[\[{]"), "json").otherwise("lines")
    told = files.withColumn("kind", kind)
    lines = told.where("kind = 'lines'").select("file_id", F.posexplode(F.split(text, "\r?\n", -1)).alias("at", "value"))
    rows = readers.parse_triples(lines).where("p IS NOT NULL").select("file_id", "at", "p", "o", "o_kind")
    own = lambda k: told.where(F.col("kind") == k).select(F.col("file_id").cast("string").alias("path"), "content")
    for tree in (trees.rdf_xml_documents(own("xml")), trees.json_ld_documents(own("json"))):
        good = tree.where("p IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), F.lit(0).alias("at"), "p", "o", "o_kind")
        rows = rows.union(good)
    return rows


def table_cells(files: DataFrame, least: int, most: int) -> DataFrame:
    """(file_id, row_no, col, value) of tabular files, as readers.conll has them."""
    lines = F.filter(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\r?\n", -1), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    cut = files.select("file_id", lines.alias("lines")).where(F.size("lines") >= least)
    rows = cut.select("file_id", F.posexplode(F.slice("lines", 1, most) if most >= 0 else F.col("lines")).alias("row_no", "line"))
    return rows.select("file_id", "row_no", F.posexplode(F.split("line", "\t", -1)).alias("col", "value"))


def results(files: DataFrame, tag: DataFrame, written, coverage: float = scoring.COVERAGE, least_rows: int = readers.MIN_ROWS, most_rows: int = readers.MAX_ROWS) -> DataFrame:
    """(file_id, format, state, unit, model, coverage): a row per predicate, column or attribute and model that a file's handler finds
    (state SUCCESS), or one without them: NONE where nothing is found, ERROR where no handler takes the format."""
    told = written(files.withColumn("format", format_of_file(F.col("content"), F.col("media_type"), F.col("path"))))
    of = lambda name: told.where(F.col("format") == name)
    rdf = handlers.rdf_files(written(statements(of("RDF"))), "at", tag, written, coverage).select("file_id", F.col("p").alias("unit"), "model", "coverage")
    docs = of("XML").select("file_id", F.make_valid_utf8(F.col("content").cast("string")).alias("xml"))
    _, cells = conversion.converted(readers.xml_overview(docs), of("XML").select("file_id", F.length("content").alias("bytes")), tag, written)
    tables = table_cells(of("CONLL"), least_rows, most_rows).select("file_id", "row_no", "col", F.col("col").cast("string").alias("name"), "value")
    rows = conversion.chain(written(tables.unionByName(cells)), tag, written, coverage).select("file_id", F.col("name").alias("unit"), "model", "coverage")
    found = written(rdf.union(rows))
    state = F.when(~F.col("format").isin(HANDLED) | F.col("format").isNull(), "ERROR").when(F.col("model").isNull(), "NONE").otherwise("SUCCESS")
    return told.select("file_id", "format").join(found, "file_id", "left").select("file_id", "format", state.alias("state"), "unit", "model", "coverage")


def archive(files: DataFrame, tag: DataFrame, written, good: int = 50, bad: int = 100, most: int = 200, least: int = 100, **how) -> DataFrame:
    """results() with folder, of the files that are read before their folder stops (observations.folder_sample; good ones are those
    with a result). As a folder stops after `most` files at the latest, no more of each (and never fewer than `least`) are handled."""
    some = written(first_files(files, max(most, least)))
    found = written(results(some, tag, written, **how))
    states = found.groupBy("file_id").agg(F.bool_or(F.col("state") == "SUCCESS").alias("good"))
    read = observations.folder_sample(some.select("folder", "path", "file_id").join(states, "file_id").select("folder", "path", "good", "file_id"), good, bad, most, least)
    return read.select("folder", "file_id").join(found, "file_id").select("folder", *found.columns)
