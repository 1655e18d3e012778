"""Queries on class graphs and on tabular annotation files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import graph, matching, roles
from lexispark.plans import derived as t
from lexispark.plans.derived import SQL
from lexispark.plans.durable import written

#: Tabular cells: each conversation is a file, its turns are rows with an index, a role, a text and a feature column.
CELLS = """, conll AS (
  SELECT conv_id AS file_id, turn AS row_no, turn AS idx, role AS tag, text AS form, 'role=' || role || '|len=' || (length(text) // 100) AS feats FROM conversations
), cell AS (
  SELECT file_id, row_no, 0 AS col, idx::VARCHAR AS value FROM conll UNION ALL SELECT file_id, row_no, 1, tag FROM conll UNION ALL SELECT file_id, row_no, 2, feats FROM conll
  UNION ALL SELECT file_id, row_no, 3, coalesce(list_extract(string_split(form, ' '), 1), '') FROM conll UNION ALL SELECT file_id, row_no, 4, 'x-' || tag || '-' || (row_no % 3) FROM conll
)
"""
Q: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = (f, sql and (SQL + CELLS + sql))
        return f

    return put


def conll(s, d):
    c = t.table(s, d, "conversations")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("row_no"), F.col("turn").alias("idx"), F.col("role").alias("tag"), F.col("text").alias("form"), F.concat(F.lit("role="), "role", F.lit("|len="), F.floor(F.length("text") / 100).cast("string")).alias("feats"))


def cell(s, d):
    values = F.array(F.col("idx").cast("string"), "tag", "feats", F.split("form", " ", -1)[0], F.concat(F.lit("x-"), "tag", F.lit("-"), (F.col("row_no") % 3).cast("string")))
    return conll(s, d).select("file_id", "row_no", F.posexplode(values).alias("col", "value"))


TOP = ["Word", "ContentWord", "FunctionWord"]


def _top(s):
    return s.createDataFrame([(x,) for x in TOP], "node string")


PATHS = "SELECT DISTINCT src, dst, path FROM closure WHERE src <> dst"


@query("all_paths", PATHS)
def all_paths(s, d):
    return graph.paths(t.class_edge(s, d))


@query("closure", "SELECT DISTINCT src, dst FROM closure WHERE src <> dst")
def closure(s, d):
    return graph.closure(t.class_edge(s, d))


@query("lowest_classes", "SELECT DISTINCT file_id, class FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g JOIN closure c ON g.class = c.src WHERE g.file_id = f.file_id AND c.dst = f.class)")
def lowest_classes(s, d):
    found = matching.matches(t.token_count(s, d, t.tag_dict(s)), t.tag_dict(s), t.file_language(s, d)).select("file_id", "class").distinct()
    return graph.lowest(found, graph.closure(t.class_edge(s, d)), "file_id", "class")


@query("shortest_path", f"""SELECT src, m[3] AS dst, list_filter(m[2], lambda x: NOT starts_with(x, '#')) AS path FROM (
  SELECT src, min((len(path), path, dst)) AS m FROM (SELECT DISTINCT * FROM closure WHERE src <> dst AND dst IN ({', '.join(repr(x) for x in TOP)})) GROUP BY src)""")
def shortest_path(s, d):
    return graph.shortest(t.class_edge(s, d), _top(s))


@query("longest_upper_path", f"SELECT src, list_filter(path, lambda x: NOT starts_with(x, '#')) AS path FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY len(path) DESC, path) AS n FROM ({PATHS})) WHERE n = 1")
def longest_upper_path(s, d):
    return graph.longest(t.class_edge(s, d), "src")


@query("longest_lower_path", f"SELECT dst, list_filter(path, lambda x: NOT starts_with(x, '#')) AS path FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY len(path) DESC, path) AS n FROM ({PATHS})) WHERE n = 1")
def longest_lower_path(s, d):
    return graph.longest(t.class_edge(s, d), "dst")


@query("reach_suffix", "SELECT DISTINCT node FROM (SELECT src AS node FROM closure WHERE (dst LIKE '%entWord' OR dst = 'Nominal') AND src <> dst UNION ALL SELECT unnest([src, dst]) FROM class_edge) WHERE node LIKE '%entWord' OR node = 'Nominal' OR node IN (SELECT src FROM closure WHERE dst LIKE '%entWord' OR dst = 'Nominal')")
def reach_suffix(s, d):
    edge = t.class_edge(s, d)
    return graph.reach_suffix(edge, graph.closure(edge), "entWord", s.createDataFrame([("Nominal", "FEATS"), ("Symbol", "POS")], "node string, tier string"))


@query("tag_to_concept", f"SELECT DISTINCT tag, class, c.dst AS concept FROM tag_dict JOIN closure c ON class = src WHERE c.dst IN ({', '.join(repr(x) for x in TOP)}) AND src <> dst")
def tag_to_concept(s, d):
    return graph.concepts(t.tag_dict(s), graph.closure(t.class_edge(s, d)), _top(s))


@query("concepts_of_hits", f"SELECT DISTINCT file_id, token, c.dst AS concept FROM found JOIN closure c ON class = src WHERE c.dst IN ({', '.join(repr(x) for x in TOP)}) AND src <> dst")
def concepts_of_hits(s, d):
    found = matching.matches(t.token_count(s, d, t.tag_dict(s)), t.tag_dict(s), t.file_language(s, d))
    mapped = graph.concepts(t.tag_dict(s), graph.closure(t.class_edge(s, d)), _top(s))
    return found.join(mapped.drop("tag").distinct(), "class").select("file_id", "token", "concept").distinct()


@query("concept_sets", "SELECT src, list(DISTINCT dst ORDER BY dst) AS above FROM closure WHERE src <> dst GROUP BY src")
def concept_sets(s, d):
    return graph.closure(t.class_edge(s, d)).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("above"))


@query("missing_links", "SELECT DISTINCT class FROM tag_dict WHERE class NOT IN (SELECT src FROM closure WHERE dst = 'ContentWord')")
def missing_links(s, d):
    return t.tag_dict(s).select("class").distinct().join(graph.closure(t.class_edge(s, d)).where("dst = 'ContentWord'"), F.col("class") == F.col("src"), "left_anti")


@query("class_degrees", "SELECT class AS node, (SELECT count(*) FROM class_edge WHERE src = class) AS out_degree, (SELECT count(*) FROM class_edge WHERE dst = class) AS in_degree FROM (SELECT src AS class FROM class_edge UNION SELECT dst FROM class_edge)")
def class_degrees(s, d):
    e = t.class_edge(s, d)
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


OWL = ["rdfs#subClassOf", "owl#equivalentClass", "owl#unionOf", "rdf#first", "rdfs#label"]


@query("graph_from_triples", f"""SELECT DISTINCT 'http://x/' || p_type AS src, 'http://x/' || p_brand AS dst, CASE p_size % 5 WHEN 0 THEN 'SUB' WHEN 1 THEN 'EQUIV' WHEN 2 THEN 'UNION' ELSE 'COLL' END AS relation
  FROM part WHERE p_size % 5 <> 4""")
def graph_from_triples(s, d):
    predicate = F.concat(F.lit("http://x/"), F.element_at(F.array(*[F.lit(x) for x in OWL]), (F.col("p_size") % 5 + 1).cast("int")))
    rows = t.table(s, d, "part").select(F.concat(F.lit("http://x/"), "p_type").alias("s"), predicate.alias("p"), F.concat(F.lit("http://x/"), "p_brand").alias("o"))
    return graph.build(rows)


#: Namespaces of the parts' and types' addresses.
NAMES = [(0, "M1", "http://p.example/1"), (1, "M2", "http://p.example/.*7$"), (2, "M3", "http://t[.]example/(ECO|PRO)"), (3, "M4", "http://p.example/1.*5")]
ADDRESSES = "(SELECT 'http://p.example/' || p_partkey AS class FROM part UNION SELECT 'http://t.example/' || p_type FROM part)"


@query("models_by_namespace", f"SELECT class, max_by(model, ordinal) AS model FROM {ADDRESSES} JOIN (VALUES {t._values(NAMES)}) n(ordinal, model, namespace) ON regexp_matches(class, '^(?:' || namespace || ')') GROUP BY class")
def models_by_namespace(s, d):
    p = t.table(s, d, "part")
    classes = p.select(F.concat(F.lit("http://p.example/"), F.col("p_partkey").cast("string")).alias("class")).union(p.select(F.concat(F.lit("http://t.example/"), "p_type"))).distinct()
    return graph.named_models(classes, s.createDataFrame(NAMES, "ordinal int, model string, namespace string"))


@query("orphan_hits", """SELECT file_id, token, cnt FROM token_count JOIN file_language f USING (file_id) WHERE token NOT IN (SELECT tag FROM tag_dict WHERE NOT is_regex AND lang = '')
AND token || ':' || f.lang NOT IN (SELECT tag || ':' || lang FROM tag_dict WHERE NOT is_regex) AND NOT regexp_full_match(token, '.{3,9}tion') AND NOT regexp_full_match(token, '.{2,8}(ung|keit)') AND NOT regexp_full_match(token, 'th(er|is|at)')""")
def orphan_hits(s, d):
    hit = written(t.token_count(s, d))
    found = matching.matches(hit, t.tag_dict(s), t.file_language(s, d))
    return graph.orphans(hit.withColumn("kind", F.lit("t")), found, "l", ("file_id", "token")).select("file_id", "token", "cnt")


@query("feature_class_match", """SELECT DISTINCT p_partkey AS "row", 'Word' AS name, p_type AS value, class FROM part JOIN (
  SELECT l.class, l.label FROM (VALUES ('Noun', 'ECONOMY'), ('Adverb', 'PROMO'), ('Symbol', 'LARGE')) l(class, label)
  WHERE EXISTS (SELECT 1 FROM closure c WHERE c.src = l.class AND c.dst LIKE '%Word') OR l.class LIKE '%Word' OR l.class = 'Symbol') ON p_type LIKE label || '%' AND p_type = label""")
def feature_class_match(s, d):
    feature = t.table(s, d, "part").select(F.col("p_partkey").alias("row"), F.lit("Word").alias("name"), F.col("p_type").alias("value"))
    label = s.createDataFrame([("Noun", "ECONOMY"), ("Adverb", "PROMO"), ("Symbol", "LARGE")], "class string, label string")
    tier = s.createDataFrame([("Symbol", "FEATS")], "class string, tier string")
    return matching.feature_matches(feature, label, graph.closure(t.class_edge(s, d)), tier)


@query("word_index_column", "SELECT file_id, min(col) AS col FROM cell WHERE row_no <= 5 AND regexp_full_match(value, '[+-]?[0-9]+') GROUP BY file_id")
def word_index_column(s, d):
    return roles.word_index_column(cell(s, d))


#: Index that falls back every third turn, so that files have several sentences.
SENT = "SELECT *, sum(CASE WHEN p IS NULL OR i > p THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY row_no)::BIGINT AS sent_no FROM (SELECT *, row_no % 3 AS i, lag(row_no % 3) OVER (PARTITION BY file_id ORDER BY row_no) AS p FROM conll)"


def _numbered(s, d):
    return roles.sentences(conll(s, d).withColumn("idx", F.col("row_no") % 3))


@query("sentence_seg", f"SELECT file_id, row_no, sent_no FROM ({SENT})")
def sentence_seg(s, d):
    return _numbered(s, d).select("file_id", "row_no", "sent_no")


@query("sentence_text", f"SELECT file_id, sent_no, string_agg(form, ' ' ORDER BY row_no) AS text FROM ({SENT}) GROUP BY ALL")
def sentence_text(s, d):
    return roles.sentence_text(_numbered(s, d))


@query("sample_sentences", f"SELECT file_id, sent_no, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT file_id, sent_no, count(*) AS n FROM ({SENT}) GROUP BY ALL)) WHERE b < 4")
def sample_sentences(s, d):
    return roles.sample_sentences(_numbered(s, d), 4)


@query("feature_columns", "SELECT file_id, col FROM cell GROUP BY ALL HAVING bool_and(value = '_' OR regexp_matches(value, '[=|]')) AND count_if(value <> '_') > 0")
def feature_columns(s, d):
    return roles.feature_columns(cell(s, d))


@query("pattern_columns", """SELECT file_id, col, x AS delimiter, count(*) AS n FROM cell, (VALUES ('+'), ('|'), (':'), (','), ('-'), ('.')) v(x)
  WHERE regexp_full_match(value, '([A-Za-z0-9]+[' || CASE x WHEN '-' THEN '\\-' ELSE x END || '])+[A-Za-z0-9]+') GROUP BY ALL HAVING count(*) >= 3 AND (x <> '-' OR avg(len(string_split(value, x))) > 2 AND count(DISTINCT len(string_split(value, x))) = 1)""")
def pattern_columns(s, d):
    return roles.pattern_columns(cell(s, d))


ROLES = [("user",), ("assistant",)]


@query("pos_columns", """SELECT file_id, col FROM (SELECT file_id, col, value, count(*) AS cnt FROM cell GROUP BY ALL) GROUP BY ALL
  HAVING coalesce(sum(cnt) FILTER (value IN ('user', 'assistant')), 0) > 0 AND coalesce(sum(cnt) FILTER (value IN ('user', 'assistant')), 0) >= 0.4 * coalesce(sum(cnt) FILTER (regexp_full_match(value, '[A-Za-z]+')), 0)
    OR count_if(value IN ('user', 'assistant')) >= 0.4 * count(*)""")
def pos_columns(s, d):
    return roles.pos_columns(cell(s, d), s.createDataFrame(ROLES, "tag string"))


@query("vector_columns", "SELECT file_id, min(col) AS col FROM (SELECT file_id, col FROM cell GROUP BY ALL HAVING count(DISTINCT length(value)) = 1 AND min(length(value)) >= 2) GROUP BY file_id")
def vector_columns(s, d):
    return roles.vector_columns(cell(s, d))


@query("text_columns", "SELECT file_id, col FROM cell JOIN (SELECT file_id, count(*) AS n FROM conll GROUP BY 1) USING (file_id) GROUP BY file_id, col, n HAVING NOT bool_or(value = '_') AND (count(DISTINCT value) >= n / 3 OR count(DISTINCT value) >= 140)")
def text_columns(s, d):
    return roles.text_columns(cell(s, d), conll(s, d).groupBy("file_id").agg(F.count("*").alias("rows")))


@query("column_tokens", "SELECT file_id, col, token, count(*) AS cnt FROM (SELECT file_id, col, trim(unnest(string_split(value, ':'))) AS token FROM cell) WHERE token <> '' GROUP BY ALL")
def column_tokens(s, d):
    return roles.column_tokens(cell(s, d))


FEATS = "SELECT CASE WHEN p_partkey % 50 = 0 THEN '_' ELSE 'brand=' || p_brand || '|size=' || p_size || '|type=' || p_type || '|SpaceAfter=No|Gloss=g|MWEx=1|empty=' END AS feats FROM part"


@query("feature_counts", f"SELECT f[1] AS name, f[2] AS value, count(*) AS cnt FROM (SELECT string_split(unnest(string_split(feats, '|')), '=') AS f FROM ({FEATS}) WHERE feats <> '_') WHERE len(f) >= 2 AND f[2] <> '' AND NOT starts_with(f[1], 'MWE') AND f[1] <> 'Gloss' GROUP BY ALL")
def feature_counts(s, d):
    p = t.table(s, d, "part")
    feats = F.concat(F.lit("brand="), "p_brand", F.lit("|size="), F.col("p_size").cast("string"), F.lit("|type="), "p_type", F.lit("|SpaceAfter=No|Gloss=g|MWEx=1|empty="))
    return roles.feature_counts(p.select(F.when(F.col("p_partkey") % 50 == 0, "_").otherwise(feats).alias("feats")))


@query("pattern_counts", "SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_split_to_array(value, '[-|:]')) AS token FROM cell WHERE col = 4) WHERE token <> '' GROUP BY ALL")
def pattern_counts(s, d):
    return roles.pattern_counts(cell(s, d).where("col = 4"), "-")


@query("first_rows", "SELECT file_id, row_no, col, value FROM cell WHERE row_no < 2")
def first_rows(s, d):
    return roles.first_rows(cell(s, d), 2)


@query("conll_lines", "SELECT file_id, row_no, concat_ws(chr(9), idx, form, tag, feats) AS line FROM conll")
def conll_lines(s, d):
    return conll(s, d).select("file_id", "row_no", F.concat_ws("\t", F.col("idx").cast("string"), "form", "tag", "feats").alias("line"))
