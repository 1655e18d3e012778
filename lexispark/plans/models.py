"""Queries on annotation models and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.columns import extension_of
from lexispark.operators import graph, matching, metadata, models, scoring
from lexispark.plans import derived as t
from lexispark.plans.derived import SQL
from lexispark.plans.durable import written
from lexispark.plans.records import EXT, TRIPLES, triples

Q: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = (f, sql and SQL + sql)
        return f

    return put


def _found(s, d):
    hit = written(t.token_count(s, d))
    return hit, matching.matches(hit, t.tag_dict(s), t.file_language(s, d))


@query("dictionary", f"SELECT DISTINCT 'tag' AS kind, tag AS value FROM tag_dict UNION SELECT DISTINCT 'class', o FROM {TRIPLES} WHERE regexp_matches(o, '^[A-Za-z][A-Za-z0-9+.-]*://[^/\\s]+')")
def dictionary(s, d):
    return models.dictionary(t.tag_dict(s), triples(s, d).select(F.col("o").alias("class")))


@query("model_nodes", """SELECT p_type || '#' || p_brand AS node_id, p_type AS name, p_brand AS type, min('m' || (p_size % 3)) AS model, list_concat(list(DISTINCT p_name ORDER BY p_name), ['', '', ''])[1:3] AS labels FROM part GROUP BY p_type, p_brand""")
def model_nodes(s, d):
    p = t.table(s, d, "part")
    return models.nodes(p.select(F.col("p_type").alias("name"), F.col("p_brand").alias("type"), F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string")).alias("model"), F.col("p_name").alias("label")))


@query("model_edges", "SELECT DISTINCT p_type AS src, p_brand AS dst, 'SUB' AS relation, 'm' || (p_size % 3) AS model, 'f' || (p_size % 2) AS file FROM part")
def model_edges(s, d):
    p = t.table(s, d, "part")
    return models.edges(p.select(F.col("p_type").alias("src"), F.col("p_brand").alias("dst"), F.lit("SUB").alias("relation"), F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string")).alias("model"), F.concat(F.lit("f"), (F.col("p_size") % 2).cast("string")).alias("file")))


NODE = "(SELECT 'p' || p_partkey AS node_id, p_brand AS model, p_type AS file FROM part)"


def _nodes(s, d):
    return t.table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_brand").alias("model"), F.col("p_type").alias("file"))


@query("model_deleted", f"""SELECT 'p' || l_partkey AS src, 'p' || (l_partkey + 1) AS dst, l_linestatus AS relation FROM (SELECT DISTINCT l_partkey, l_linestatus FROM lineitem) WHERE l_partkey % 7 <> 0
  AND 'p' || l_partkey IN (SELECT node_id FROM {NODE} WHERE model <> 'Brand#11') AND 'p' || (l_partkey + 1) IN (SELECT node_id FROM {NODE} WHERE model <> 'Brand#11')""")
def model_deleted(s, d):
    k = F.col("l_partkey")
    edge = t.table(s, d, "lineitem").select(k, F.col("l_linestatus").alias("relation")).distinct().select(F.concat(F.lit("p"), k.cast("string")).alias("src"), F.concat(F.lit("p"), (k + 1).cast("string")).alias("dst"), "relation", F.when(k % 7 == 0, "Brand#11").otherwise("x").alias("model"))
    return models.without_model(_nodes(s, d), edge, "Brand#11")[1].select("src", "dst", "relation")


@query("model_reset", f"SELECT node_id, model FROM {NODE} WHERE node_id IN (SELECT 'p' || l_partkey FROM lineitem WHERE l_quantity > 49)")
def model_reset(s, d):
    match = t.table(s, d, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node_id"))
    return models.reset(_nodes(s, d), match).select("node_id", "model")


@query("model_counts", f"SELECT model, file, count(*) AS nodes, max(node_id) AS max_id FROM {NODE} GROUP BY ALL")
def model_counts(s, d):
    return models.counts(_nodes(s, d))


@query("changed_models", "SELECT DISTINCT p_brand AS model FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 61 = 3 AND p_size > 40")
def changed_models(s, d):
    k = F.col("p_partkey")
    p = t.table(s, d, "part").select(F.col("p_brand").alias("model"), k.alias("file"), F.md5("p_name").alias("hash"), "p_size")
    new = p.where("NOT (file % 61 = 3 AND p_size > 40)").withColumn("hash", F.when(F.col("file") % 50 == 0, "x").otherwise(F.col("hash")))
    return models.changed(p, new)


@query("model_actions", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN 'error' WHEN s_suppkey % 5 = 0 THEN 'save' WHEN s_suppkey % 4 = 0 THEN 'update' WHEN s_suppkey % 3 = 0 THEN 'edit' ELSE 'none' END AS action FROM supplier""")
def model_actions(s, d):
    x = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("files"))
    given = x.select("id", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("*"))).otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 4 == 0, F.concat("files", F.lit("*"))).otherwise(F.col("files")).alias("files"))
    return models.update_actions(x.where("id % 5 <> 0"), given.union(given.where("id % 6 = 0")))


CLASSES = [("T1", "http://t.example/PROMO"), ("T1", "http://t.example/ECONOMY"), ("T2", "http://t.example/.*"), ("T2", "http://other.example/X")]


@query("class_match", f"SELECT o AS token, cnt, model, class FROM (SELECT o, count(*) AS cnt FROM {TRIPLES} WHERE o_kind = 'uri' GROUP BY o) JOIN (VALUES {t._values(CLASSES)}) c(model, class) ON regexp_full_match(o, class)")
def class_match(s, d):
    objects = triples(s, d).where("o_kind = 'uri'").groupBy(F.col("o").alias("token")).agg(F.count("*").alias("cnt"))
    return models.class_matches(objects, s.createDataFrame(CLASSES, "model string, class string"))


@query("rematched", """SELECT file_id, token, 'NEWLEX' AS model FROM token_count JOIN file_language f USING (file_id) WHERE (token = 'on' OR regexp_full_match(token, 'sh.*ing'))
AND token NOT IN (SELECT tag FROM tag_dict WHERE NOT is_regex AND lang = '') AND token || ':' || f.lang NOT IN (SELECT tag || ':' || lang FROM tag_dict WHERE NOT is_regex)
AND NOT regexp_full_match(token, '.{3,9}tion') AND NOT regexp_full_match(token, '.{2,8}(ung|keit)') AND NOT regexp_full_match(token, 'th(er|is|at)')""")
def rematched(s, d):
    hit, found = _found(s, d)
    new = s.createDataFrame([("NEWLEX", "Preposition", "on", False, ""), ("NEWLEX", "Verb", "sh.*ing", True, "")], "model string, class string, tag string, is_regex boolean, lang string")
    return models.rematched(hit, found, new).select("file_id", "token", "model")


@query("model_updated", """SELECT file_id, token, model, class, tag FROM (SELECT * FROM literal_match UNION ALL SELECT * FROM regex_match) WHERE model <> 'MIXLEX' UNION SELECT file_id, token, 'NEWLEX', 'Verb', 'ing' FROM token_count WHERE token = 'ing'""")
def model_updated(s, d):
    old = t.tag_dict(s)
    new = old.where("model <> 'MIXLEX'").union(s.createDataFrame([("NEWLEX", "Verb", "ing", False, "")], old.schema))
    hit = written(t.token_count(s, d, old.union(new)))
    return models.updated(hit, matching.matches(hit, old), old, new).select("file_id", "token", "model", "class", "tag")


#: The dictionary after an update: a model gone, one changed, one new.
UPDATED = [x for x in t.TAGS if x[0] != "MIXLEX" and x[2] != "und"] + [("GERLEX", "Conjunction", "oder", False, ""), ("NEWLEX", "Verb", "th.*(ing|ed)", True, ""), ("NEWLEX", "Article", "the", False, "eng")]


def model_update_job(s, d):
    """The chain after a model update: the old matches' scores, nodes reset and reloaded, hits that have become orphans dropped, new
    nodes matched, and scores brought up to date from the changes; with the number of each file's orphans."""
    hit, old = written(t.token_count(s, d)), t.tag_dict(s)
    found = written(matching.matches(hit, old, t.file_language(s, d)))
    scored = written(scoring.scores(hit, found))
    new = s.createDataFrame(UPDATED, old.schema)
    dropped, added = (written(x) for x in models.changed_matches(hit, found, old, new, t.file_language(s, d)))
    scores = scoring.rescored(scored, hit, found, dropped, added)
    left = found.join(dropped.hint("merge"), found.columns, "left_anti").select(*found.columns).union(added.select(*found.columns))
    orphans = graph.orphans(hit.select("file_id", "token", F.lit("t").alias("kind")), left.hint("merge"), "l", ("file_id", "token")).groupBy("file_id").agg(F.count("*").alias("orphans"))
    return scores.join(orphans, "file_id", "left").select("file_id", "model", *scoring.SUMS, "coverage", F.coalesce("orphans", F.lit(0)).alias("orphans"))


Q["model_update_job"] = (
    model_update_job,
    SQL.replace(t._values(t.TAGS), t._values(UPDATED))
    + """SELECT s.file_id, model, different_hit_types, exclusive_hit_types, hit_count_total, exclusive_hit_count_total, coverage, tokens - hits AS orphans
  FROM scores s JOIN (SELECT file_id, count(*) AS tokens FROM token_count GROUP BY 1) USING (file_id) JOIN (SELECT file_id, count(DISTINCT token) AS hits FROM found GROUP BY 1) USING (file_id)""",
)


@query("tags_of_model", "SELECT url, model, class, tag, arg_min(token, (-cnt, token)) AS token, max(cnt) AS cnt FROM found JOIN files USING (file_id) GROUP BY url, model, class, tag")
def tags_of_model(s, d):
    return models.tags_of_models(matching.matches(t.token_count(s, d, t.tag_dict(s)), t.tag_dict(s), t.file_language(s, d)), t.files(s, d))


@query("class_descriptions", "SELECT DISTINCT src AS class, dst AS top, CASE WHEN dst LIKE '%Word' THEN 'about ' || dst END AS comment FROM (SELECT DISTINCT * FROM closure WHERE src <> dst AND dst IN ('Word', 'Nominal'))")
def class_descriptions(s, d):
    edge = t.class_edge(s, d)
    found = graph.closure(edge).where("dst IN ('Word', 'Nominal')").select("src", F.array("src", "dst").alias("path"))
    return models.class_descriptions(found, s.createDataFrame([("Word", "about Word")], "class string, comment string"))


@query("term_model", f"SELECT s, p, o FROM {TRIPLES} WHERE (starts_with(s, 'http://p.example/1') OR starts_with(s, 'http://p.example/7')) AND NOT regexp_full_match(p, '.*#la.el')")
def term_model(s, d):
    return models.terms(triples(s, d), ["http://p.example/1", "http://p.example/7"], [".*#la.el"]).select("s", "p", "o")


VALUES = "(SELECT o_custkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'title' ELSE 'year' END AS field, o_orderpriority AS value, o_orderkey AS pos FROM orders)"


@query("resource_metadata", f"SELECT c_custkey AS url, c_name AS name, arg_max(value, pos) FILTER (field = 'title') AS title, arg_max(value, pos) FILTER (field = 'year') AS year FROM customer LEFT JOIN {VALUES} ON url = c_custkey GROUP BY ALL")
def resource_metadata(s, d):
    o = t.table(s, d, "orders").select(F.col("o_custkey").alias("url"), F.when(F.col("o_orderkey") % 3 == 0, "title").otherwise("year").alias("field"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("at"))
    return metadata.with_fields(t.table(s, d, "customer").select(F.col("c_custkey").alias("url"), F.col("c_name").alias("name")), o, ["title", "year"])


@query("crawl_results", "SELECT page_id AS webpage_id, url, 'type' || (page_id % 4) AS type FROM pages WHERE page_id % 4 = 1")
def crawl_results(s, d):
    p = t.table(s, d, "pages")
    return metadata.crawled(p.select(F.col("page_id").alias("webpage_id"), "url"), p.select(F.col("page_id").alias("url_id"), F.concat(F.lit("type"), (F.col("page_id") % 4).cast("string")).alias("type")), "type1")


@query("distribution_urls", "SELECT DISTINCT 'd' || l_orderkey AS dataset, 'x' || l_partkey AS distribution, 'http://a.example/' || l_partkey AS url FROM lineitem WHERE l_partkey % 3 = 0")
def distribution_urls(s, d):
    li = t.table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    name = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    rows = li.select(name("d", "l_orderkey").alias("s"), F.lit(metadata.DISTRIBUTION).alias("p"), name("x", "l_partkey").alias("o"))
    return metadata.access_urls(rows.union(li.where("l_partkey % 3 = 0").select(name("x", "l_partkey"), F.lit(metadata.ACCESS), name("http://a.example/", "l_partkey")).distinct()))


@query("statement_selector", f"SELECT DISTINCT s, p, o FROM {TRIPLES} WHERE p = 'http://x.example/vocab#brand' AND o = 'Brand#23'")
def statement_selector(s, d):
    return metadata.statements(triples(s, d), p="http://x.example/vocab#brand", o="Brand#23")


@query("triple_join", f"SELECT a.s, a.o AS brand, b.o AS label FROM {TRIPLES} a JOIN {TRIPLES} b ON a.s = b.s LEFT JOIN {TRIPLES} c ON a.s = c.s AND c.p LIKE '%#none' WHERE a.p LIKE '%#brand' AND b.p LIKE '%#label' AND b.o_lang = 'de' AND c.s IS NULL")
def triple_join(s, d):
    x = triples(s, d)
    brand, label = x.where(F.col("p").endswith("#brand")).select("s", F.col("o").alias("brand")), x.where(F.col("p").endswith("#label") & (F.col("o_lang") == "de")).select("s", F.col("o").alias("label"))
    return brand.join(label, "s").join(x.where(F.col("p").endswith("#none")), "s", "left_anti").select("s", "brand", "label")


@query("clue_counts", " UNION ALL ".join(f"SELECT '{part}' AS part, '{clue}' AS clue, count(*) AS n FROM {TRIPLES} WHERE contains({part}, '{clue}') HAVING count(*) > 0" for part in "spo" for clue in ("brand", "23", "PROMO")))
def clue_counts(s, d):
    return metadata.clue_counts(triples(s, d), ["brand", "23", "PROMO"])


CODES = [("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French"), ("eng", "eng", "English"), ("it", "ita", "Italian")]
GLOTTO = [("eng", "stan1293"), ("deu", "stan1295")]


@query("language_links", f"""SELECT doc_id, d.lang, iso, name, 'http://lexvo.org/id/iso639-3/' || iso AS lexvo, 'https://glottolog.org/resource/languoid/id/' || id AS glottolog FROM documents d
  LEFT JOIN (VALUES {t._values(CODES)}) c(code, iso, name) ON c.code = d.lang LEFT JOIN (VALUES {t._values(GLOTTO)}) g(g_iso, id) ON g_iso = iso""")
def language_links(s, d):
    rows = t.table(s, d, "documents").select("doc_id", "lang")
    return metadata.linked_languages(rows, s.createDataFrame(CODES, "code string, iso string, name string"), s.createDataFrame(GLOTTO, "iso string, id string"))


@query("language_classes", f"SELECT DISTINCT a.o AS iso, a.s AS class, b.o AS name FROM {TRIPLES} a JOIN {TRIPLES} b ON a.s = b.s WHERE a.p = 'http://x.example/vocab#brand' AND b.p = 'http://x.example/vocab#label'")
def language_classes(s, d):
    return metadata.language_classes(triples(s, d), "http://x.example/vocab#brand", "http://x.example/vocab#label")


FIELD = "CASE c_custkey % 5 WHEN 0 THEN '\"en\", ''de''' WHEN 1 THEN 'http://lexvo.org/id/iso639-3/deu' WHEN 2 THEN 'fr-CA; ES/mx,fr' WHEN 3 THEN 'some language' ELSE 'Eng' END"


@query("language_strings", "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ['en', 'de'] WHEN 1 THEN ['deu'] WHEN 2 THEN ['fr', 'es'] WHEN 3 THEN []::VARCHAR[] ELSE ['eng'] END AS codes FROM customer")
def language_strings(s, d):
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, "\"en\", 'de'").when(k == 1, "http://lexvo.org/id/iso639-3/deu").when(k == 2, "fr-CA; ES/mx,fr").when(k == 3, "some language").otherwise("Eng")
    return t.table(s, d, "customer").select(F.col("c_custkey").alias("id"), metadata.language_codes(text).alias("codes"))


@query("json_metadata", "SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE [c_mktsegment, 'x'] END AS tags FROM customer")
def json_metadata(s, d):
    c = t.table(s, d, "customer")
    text = F.to_json(F.struct(F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 4 != 0, F.array("c_mktsegment", F.lit("x"))).alias("tags")))
    return metadata.from_json(c.select(F.col("c_custkey").alias("id"), text.alias("json")), "json", "title string, tags array<string>")


@query("classification_counts", "SELECT coalesce(p_brand, '') AS class, coalesce(CASE WHEN p_size % 4 > 0 THEN p_type END, '') AS label, coalesce((p_size % 3)::VARCHAR, '') AS id, count(*) AS n FROM part GROUP BY ALL")
def classification_counts(s, d):
    p = t.table(s, d, "part").select(F.col("p_brand").alias("class"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("label"), (F.col("p_size") % 3).alias("id"))
    return metadata.classified(p, ["class", "label", "id"])


@query("url_rules", f"SELECT page_id, url, CASE WHEN contains(url, 'cheap') THEN 'blocked' WHEN {EXT} IN ('html', 'htm') THEN 'html' WHEN starts_with(url, 'https://m.') THEN 'mobile' WHEN ends_with(url, '/') THEN 'folder' WHEN starts_with(url, 'https:') THEN 'secure' WHEN {EXT} = '' THEN 'bare' ELSE '' END AS rule FROM pages")
def url_rules(s, d):
    u = F.col("url")
    rules = [("blocked", u.contains("cheap")), ("html", extension_of(u).isin("html", "htm")), ("mobile", u.startswith("https://m.")), ("folder", u.endswith("/")), ("secure", u.startswith("https:")), ("bare", extension_of(u) == "")]
    return metadata.by_rule(t.table(s, d, "pages").select("page_id", "url"), rules)


PRIORITY = "CASE format WHEN 'RDF' THEN 1 WHEN 'CONLL' THEN 2 ELSE 3 END"


@query("format_priority", f"SELECT url, file_id, format FROM files f WHERE {PRIORITY} = (SELECT min({PRIORITY}) FROM files g WHERE g.url = f.url)")
def format_priority(s, d):
    from pyspark.sql import Window

    rank = F.array_position(F.array(F.lit("RDF"), F.lit("CONLL"), F.lit("XML")), F.col("format"))
    return t.files(s, d).select("url", "file_id", "format", rank.alias("r"), F.min(rank).over(Window.partitionBy("url")).alias("m")).where("r = m").select("url", "file_id", "format")


@query("good_predicates", f"SELECT s, p, o FROM {TRIPLES} WHERE p NOT IN (SELECT p FROM {TRIPLES} GROUP BY p HAVING count(DISTINCT o) > 20)")
def good_predicates(s, d):
    x = triples(s, d)
    bad = x.groupBy("p").agg(F.count_distinct("o").alias("n")).where("n > 20")
    return x.join(bad, "p", "left_anti").select("s", "p", "o")
