"""Reference-shaped tables derived from the star schema and text tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.columns import iso_language
from lexispark.operators import matching, tokens
from lexispark.sources.readers import spread

#: A small annotation dictionary: model, class, tag, is pattern, language ('' = any).
TAGS = [
    ("ENGLEX", "Determiner", "the", False, "eng"),
    ("ENGLEX", "Preposition", "of", False, "eng"),
    ("ENGLEX", "Conjunction", "and", False, "eng"),
    ("ENGLEX", "Preposition", "in", False, "eng"),
    ("ENGLEX", "Noun", ".{3,9}tion", True, ""),
    ("GERLEX", "Determiner", "der", False, ""),
    ("GERLEX", "Determiner", "die", False, ""),
    ("GERLEX", "Conjunction", "und", False, ""),
    ("GERLEX", "Noun", ".{2,8}(ung|keit)", True, ""),
    ("ROMLEX", "Determiner", "la", False, ""),
    ("ROMLEX", "Preposition", "de", False, ""),
    ("ROMLEX", "Determiner", "les", False, "fra"),
    ("ROMLEX", "Determiner", "los", False, "spa"),
    ("ROMLEX", "Pronoun", "que", False, ""),
    ("MIXLEX", "Determiner", "the", False, ""),
    ("MIXLEX", "Determiner", "la", False, ""),
    ("MIXLEX", "Symbol", "a", False, ""),
    ("MIXLEX", "Pronoun", "la", False, ""),
    ("MIXLEX", "Adverb", "th(er|is|at)", True, ""),
]
#: Class edges with a diamond, a cycle and an anonymous node: src is below dst.
EDGES = [
    ("Determiner", "FunctionWord", "SUB"), ("Preposition", "FunctionWord", "SUB"), ("Conjunction", "FunctionWord", "SUB"), ("Noun", "ContentWord", "SUB"), ("Adverb", "ContentWord", "SUB"),
    ("Pronoun", "FunctionWord", "SUB"), ("Pronoun", "Nominal", "SUB"), ("Noun", "Nominal", "SUB"), ("Nominal", "#n1", "UNION"), ("#n1", "ContentWord", "COLL"),
    ("FunctionWord", "Word", "SUB"), ("ContentWord", "Word", "SUB"), ("Word", "Token", "EQUIV"), ("Token", "Word", "EQUIV"), ("Symbol", "Token", "SUB"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(("true" if x else "false") if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The texts, dealt to all cores."""
    return spread(table(spark, d, "documents"))


def token_count(spark: SparkSession, d: str, tag: DataFrame | None = None) -> DataFrame:
    """(file_id, token, cnt); with a dictionary, only those of its hits that it may match."""
    docs, words = documents(spark, d).select(F.col("doc_id").alias("file_id"), "text"), F.split(F.lower("text"), "[^a-z]++", -1)
    if tag is not None and (keep := matching.may_match(tag)) is not None:
        return tokens.chosen(docs, ["file_id"], words, keep)
    each = tokens.counted(docs, ["file_id"], words)
    # texts of one id are one file's; else nothing is left to merge
    return each.groupBy("file_id", "token").agg(F.sum("cnt").alias("cnt")) if tokens.repeats(docs, ["file_id"]) else each


def tokens_of(spark: SparkSession, d: str) -> DataFrame:
    """(token): the different tokens of all files, which need no counts."""
    each = documents(spark, d).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+", -1))).alias("token"))
    return each.where("token <> ''").distinct()


def tag_dict(spark: SparkSession, d: str = "") -> DataFrame:
    return spark.createDataFrame(TAGS, "model string, class string, tag string, is_regex boolean, lang string")


def class_edge(spark: SparkSession, d: str) -> DataFrame:
    """EDGES, and below them the suppliers of nations of regions, a tree that grows with the tables."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    nation, region = F.concat(F.lit("N:"), "n_name"), F.concat(F.lit("R:"), "r_name")
    known = spark.createDataFrame(EDGES, "src string, dst string, relation string")
    below = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("src"), nation.alias("dst"), F.lit("SUB").alias("relation"))
    above = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(nation, region, F.lit("SUB"))
    return known.union(below).union(above).union(r.select(region, F.lit("Word"), F.lit("UNION")))


def file_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), iso_language(F.col("lang")).alias("lang"))


def resource_file(spark: SparkSession, d: str) -> DataFrame:
    """(url, file_id, lang, selected): some 400 resources; a language is selected unless its document is labelled bad."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "source", "lang", "n_chars")
    url = F.concat(F.lit("http://r.example/"), (F.col("file_id") % 400).cast("string")).alias("url")
    return docs.join(labels, "file_id", "left").select(url, "file_id", iso_language(F.col("lang")).alias("lang"), F.coalesce(F.col("quality") == 1, F.lit(True)).alias("selected"), "source", "n_chars")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(url, file_id, status, format, type, lang): a state, a format and a type by rule from the document's numbers."""
    n = F.col("file_id")
    return resource_file(spark, d).select(
        "url", "file_id", "lang", "source", "n_chars",
        F.when(n % 7 == 0, "ACCEPTED").when(n % 7 == 1, "DISABLED").when(n % 11 == 0, "CHECK").otherwise("PROCESSED").alias("status"),
        F.element_at(F.array(*[F.lit(x) for x in ("RDF", "CONLL", "XML")]), (n % 3 + 1).cast("int")).alias("format"),
        F.when(F.col("n_chars") > 4000, "CORPUS").when(F.col("n_chars") > 1500, "LEXICON").when(F.col("n_chars") > 600, "ONTOLOGY").otherwise("UNKNOWN").alias("type"),
    )


SQL = rf"""
WITH RECURSIVE token_count AS (
  SELECT file_id, token, count(*) AS cnt FROM (SELECT doc_id AS file_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents) WHERE token <> '' GROUP BY ALL
), tag_dict(model, class, tag, is_regex, lang) AS (VALUES {_values(TAGS)}),
class_edge(src, dst, relation) AS (SELECT * FROM (VALUES {_values(EDGES)}) UNION ALL SELECT 'S' || s_suppkey, 'N:' || n_name, 'SUB' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'N:' || n_name, 'R:' || r_name, 'SUB' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'R:' || r_name, 'Word', 'UNION' FROM region),
file_language AS (SELECT doc_id AS file_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE '' END AS lang FROM documents),
resource_file AS (
  SELECT 'http://r.example/' || (doc_id % 400) AS url, doc_id AS file_id, f.lang, coalesce(quality = 1, true) AS selected, source, n_chars
  FROM documents JOIN file_language f ON f.file_id = doc_id LEFT JOIN labels USING (doc_id)
), files AS (
  SELECT url, file_id, lang, source, n_chars, CASE WHEN file_id % 7 = 0 THEN 'ACCEPTED' WHEN file_id % 7 = 1 THEN 'DISABLED' WHEN file_id % 11 = 0 THEN 'CHECK' ELSE 'PROCESSED' END AS status,
    ['RDF', 'CONLL', 'XML'][file_id % 3 + 1] AS format,
    CASE WHEN n_chars > 4000 THEN 'CORPUS' WHEN n_chars > 1500 THEN 'LEXICON' WHEN n_chars > 600 THEN 'ONTOLOGY' ELSE 'UNKNOWN' END AS type
  FROM resource_file
), literal_match AS (
  SELECT file_id, token, cnt, model, class, tag, lang, 'tag' AS kind FROM token_count JOIN tag_dict ON tag = translate(token, ''',;', '') WHERE NOT is_regex
), regex_match AS (
  SELECT file_id, token, cnt, model, class, tag, lang, 'pattern' AS kind FROM token_count JOIN tag_dict ON regexp_full_match(token, tag) WHERE is_regex
), found AS (
  SELECT m.* FROM (SELECT * FROM literal_match UNION ALL SELECT * FROM regex_match) m LEFT JOIN file_language f USING (file_id) WHERE m.lang = '' OR m.lang = f.lang
), edges AS (SELECT *, count(*) OVER (PARTITION BY file_id, token) AS degree FROM found),
node AS (SELECT file_id, model, class, tag, max(cnt) AS cnt, max(cnt) FILTER (degree = 1) AS own FROM edges GROUP BY ALL),
scores AS (
  SELECT file_id, model, count(*)::BIGINT AS different_hit_types, count(own)::BIGINT AS exclusive_hit_types, sum(cnt)::BIGINT AS hit_count_total, coalesce(sum(own), 0)::BIGINT AS exclusive_hit_count_total,
    round(count(*)::DOUBLE / any_value(t.tokens), 6) AS coverage
  FROM node JOIN (SELECT file_id, count(*) AS tokens FROM token_count GROUP BY 1) t USING (file_id) GROUP BY file_id, model
), properties AS (
  SELECT file_id, model, bool_and(regexp_full_match(token, '[0-9]+')) AS only_numeric, bool_and(NOT regexp_matches(token, '[A-Za-z0-9]')) AS only_symbolic, max(length(token)) AS max_tag_length, count(DISTINCT tag) AS types
  FROM found GROUP BY ALL
), candidates AS (
  SELECT s.*, (only_numeric OR only_symbolic OR max_tag_length = 1 OR types = 1) AS trivial, CASE WHEN file_id % 13 = 0 AND model = 'MIXLEX' THEN 'MANUAL' ELSE 'AUTO' END AS method, (file_id % 26 = 0 OR file_id % 13 <> 0) AS selected
  FROM scores s JOIN properties p USING (file_id, model)
), closure AS (
  SELECT src, dst, [src, dst] AS path FROM class_edge
  UNION ALL SELECT c.src, e.dst, list_append(c.path, e.dst) FROM closure c JOIN class_edge e ON c.dst = e.src WHERE NOT list_contains(c.path, e.dst)
)
"""
