"""Queries on whole files: roles, hits, scores and results; XML trees and attributes; languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import handlers, languages, roles, scoring, xmltools
from lexispark.plans import derived as t
from lexispark.plans.derived import SQL
from lexispark.plans.durable import written
from lexispark.plans.records import OVERVIEW, TRIPLES, triples, xml_docs
from lexispark.plans.structure import CELLS, cell, conll
from lexispark.plans.text_models import _found
from lexispark.sources import readers

Q: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = (f, sql and SQL + CELLS + sql)
        return f

    return put


CHAT = [("CHAT", "Speaker", "user", False, ""), ("CHAT", "Speaker", "assistant", False, ""), ("ROLES", "User", "us.r", True, ""), ("BRANDS", "Brand", "Brand#23", False, ""), ("BRANDS", "Brand", "Brand#1.", True, ""), ("TYPES", "Type", "PROMO", False, ""), ("TYPES", "Type", "ECONOMY", False, "")]
TAG = "string, class string, tag string, is_regex boolean, lang string"


def chat(s):
    return s.createDataFrame(CHAT, f"model {TAG}")


ROLE = """(SELECT file_id, col, CASE WHEN col = (SELECT min(i.col) FROM cell i WHERE i.file_id = c.file_id AND i.row_no <= 5 AND regexp_full_match(i.value, '[+-]?[0-9]+')) THEN 'index'
    WHEN bool_and(value = '_' OR regexp_matches(value, '[=|]')) AND count_if(value <> '_') > 0 THEN 'feature'
    WHEN count_if(regexp_full_match(value, '([A-Za-z0-9]+[+])+[A-Za-z0-9]+')) >= 3 OR count_if(regexp_full_match(value, '([A-Za-z0-9]+[|])+[A-Za-z0-9]+')) >= 3 OR count_if(regexp_full_match(value, '([A-Za-z0-9]+[:])+[A-Za-z0-9]+')) >= 3
      OR count_if(regexp_full_match(value, '([A-Za-z0-9]+[,])+[A-Za-z0-9]+')) >= 3 OR count_if(regexp_full_match(value, '([A-Za-z0-9]+[.])+[A-Za-z0-9]+')) >= 3
      OR count_if(regexp_full_match(value, '([A-Za-z0-9]+[-])+[A-Za-z0-9]+')) >= 3 AND (avg(len(string_split(value, '-'))) FILTER (regexp_full_match(value, '([A-Za-z0-9]+[-])+[A-Za-z0-9]+'))) > 2
        AND (count(DISTINCT len(string_split(value, '-'))) FILTER (regexp_full_match(value, '([A-Za-z0-9]+[-])+[A-Za-z0-9]+'))) = 1 THEN 'pattern'
    WHEN count_if(value IN ('user', 'assistant')) > 0 AND count_if(value IN ('user', 'assistant')) >= 0.4 * count_if(regexp_full_match(value, '[A-Za-z]+')) OR (count(DISTINCT value) FILTER (value IN ('user', 'assistant'))) >= 0.4 * count(DISTINCT value) THEN 'pos'
    WHEN NOT bool_or(value = '_') AND (count(DISTINCT value) >= (SELECT count(*) FROM conll k WHERE k.file_id = c.file_id) / 3 OR count(DISTINCT value) >= 140) THEN 'text' ELSE 'free' END AS role FROM cell c GROUP BY file_id, col)"""


def _roles(s, d):
    tags = s.createDataFrame([("user",), ("assistant",)], "tag string")
    return handlers.column_roles(cell(s, d), conll(s, d).groupBy("file_id").agg(F.count("*").alias("rows")), tags)


@query("column_roles", f"SELECT * FROM {ROLE}")
def column_roles(s, d):
    return _roles(s, d)


@query("free_columns", f"""SELECT file_id, coalesce(list(col ORDER BY col) FILTER (role <> 'text' AND col NOT IN (1, 4)), []) AS free, coalesce(list(col ORDER BY col) FILTER (NOT (col = 1 AND file_id % 2 = 0)), []) AS disabled FROM {ROLE} GROUP BY file_id""")
def free_columns(s, d):
    c = cell(s, d).select("file_id", "col").distinct().where("col IN (1, 4)")
    return handlers.free_columns(_roles(s, d), c.withColumn("selected", (F.col("col") == 1) & (F.col("file_id") % 2 == 0)))


HITS = f"""(SELECT file_id, col, 't' AS kind, '' AS name, token AS value, count(*) AS cnt FROM (SELECT file_id, col, trim(unnest(string_split(value, ':'))) AS token FROM cell JOIN {ROLE} USING (file_id, col) WHERE role = 'pos') WHERE token <> '' GROUP BY ALL
  UNION ALL SELECT file_id, col, 'f', f[1], f[2], count(*) FROM (SELECT file_id, col, string_split(unnest(string_split(value, '|')), '=') AS f FROM cell JOIN {ROLE} USING (file_id, col) WHERE role = 'feature' AND value <> '_') WHERE len(f) >= 2 AND f[2] <> '' GROUP BY ALL
  UNION ALL SELECT file_id, col, 'x', '', v, count(*) FROM (SELECT file_id, col, unnest(regexp_split_to_array(value, '[+|:,.-]')) AS v FROM cell JOIN {ROLE} USING (file_id, col) WHERE role = 'pattern') WHERE v <> '' GROUP BY ALL)"""


@query("conll_hits", f"SELECT * FROM {HITS}")
def conll_hits(s, d):
    return handlers.column_hits(cell(s, d), written(_roles(s, d)))


@query("column_hits", f"SELECT file_id, col, count(*) AS hits FROM {HITS} GROUP BY file_id, col")
def column_hits(s, d):
    return handlers.hits_of_columns(handlers.column_hits(cell(s, d), written(_roles(s, d))))


@query("conll_handler", f"""SELECT file_id, col, model, coverage FROM (SELECT *, row_number() OVER (PARTITION BY file_id, col ORDER BY coverage DESC, own DESC, total DESC, owned DESC, model) AS k FROM (
  SELECT file_id, col, model, round(count(*) / any_value(n), 6) AS coverage, count(own) AS own, sum(cnt) AS total, coalesce(sum(own), 0) AS owned, count(DISTINCT tag) AS tags, max(longest) AS longest FROM (
    SELECT h.file_id, h.col, model, class, tag, max(cnt) AS cnt, max(cnt) FILTER (degree = 1) AS own, max(n) AS n, max(length(value)) AS longest FROM (SELECT *, count(*) OVER (PARTITION BY file_id, col, value) AS degree FROM (SELECT * FROM {HITS} WHERE kind = 't')
      JOIN (VALUES {t._values(CHAT)}) c(model, class, tag, is_regex, lang) ON CASE WHEN is_regex THEN regexp_full_match(value, tag) ELSE value = tag END) h
    JOIN (SELECT file_id, col, count(*) AS n FROM {HITS} WHERE kind = 't' GROUP BY ALL) z ON z.file_id = h.file_id AND z.col = h.col GROUP BY ALL) GROUP BY file_id, col, model) WHERE coverage >= 0.4 AND tags > 1 AND longest > 1) WHERE k = 1""")
def conll_handler(s, d):
    return handlers.conll(cell(s, d), written(_roles(s, d)), chat(s), written)


ALLOWED = f"(SELECT * FROM {TRIPLES} WHERE p NOT LIKE '%#label' AND (o_kind = 'uri' OR length(o) <= 35 AND NOT regexp_matches(o, '[:/@., \\[\\]{{}}]') AND NOT regexp_full_match(o, '[0-9]+')))"


#: With names that a predicate's first objects hold.
NAMED = [*CHAT, *[("BRANDS", "Brand", f"Brand#{n}", False, "") for n in (2, 4, 17)], *[("TYPES", "Type", f"http://t.example/{x}", False, "") for x in ("PROMO", "ECONOMY")]]


@query("rdf_handler", f"""SELECT p, model, count(*)::BIGINT AS different_hit_types, round(count(*) / any_value(n), 6) AS coverage FROM (SELECT DISTINCT x.p, model, class, tag, n FROM (SELECT DISTINCT p, o FROM {ALLOWED}) x JOIN (VALUES {t._values(NAMED)}) c(model, class, tag, is_regex, lang) ON CASE WHEN is_regex THEN regexp_full_match(o, tag) ELSE o = tag END
  JOIN (SELECT p, count(DISTINCT o) AS n FROM {ALLOWED} GROUP BY p) z ON z.p = x.p
  WHERE x.p IN (SELECT p FROM (SELECT p, o, row_number() OVER (PARTITION BY p ORDER BY min(pos), o) AS r FROM {ALLOWED} GROUP BY p, o) WHERE r <= 10 AND o IN (SELECT tag FROM (VALUES {t._values(NAMED)}) k(model, class, tag, is_regex, lang)))) GROUP BY p, model HAVING count(*) >= 0.05 * any_value(n) AND count(DISTINCT tag) > 1""")
def rdf_handler(s, d):
    return handlers.rdf(triples(s, d), "at", s.createDataFrame(NAMED, f"model {TAG}"), written, coverage=0.05)


@query("xml_handler", f"""SELECT path, attr, model, coverage FROM (SELECT *, row_number() OVER (PARTITION BY path, attr ORDER BY coverage DESC, own DESC, total DESC, owned DESC, model) AS k FROM (
  SELECT path, attr, model, round(count(*) / any_value(n), 6) AS coverage, count(own) AS own, sum(cnt) AS total, coalesce(sum(own), 0) AS owned, count(DISTINCT tag) AS tags FROM (
    SELECT h.path, h.attr, model, class, tag, max(cnt) AS cnt, max(cnt) FILTER (degree = 1) AS own, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY path, attr, value) AS degree FROM (SELECT path, attr, value, count(*) AS cnt FROM {OVERVIEW} WHERE attr <> '' GROUP BY ALL)
      JOIN (VALUES {t._values(CHAT)}) c(model, class, tag, is_regex, lang) ON CASE WHEN is_regex THEN regexp_full_match(value, tag) ELSE value = tag END) h
    JOIN (SELECT path, attr, count(DISTINCT value) AS n, max(c) AS most FROM (SELECT path, attr, value, count(*) AS c FROM {OVERVIEW} WHERE attr <> '' GROUP BY ALL) GROUP BY ALL) z ON z.path = h.path AND z.attr = h.attr WHERE most > 1 GROUP BY ALL) GROUP BY path, attr, model) WHERE coverage >= 0.05 AND tags > 1) WHERE k = 1""")
def xml_handler(s, d):
    return handlers.xml(written(readers.xml_overview(xml_docs(s, d))), chat(s), written, coverage=0.05)


CHOSEN = "(SELECT file_id, model FROM candidates WHERE selected AND NOT (trivial AND coverage < 0.4 AND method <> 'MANUAL'))"


@query("file_results", f"""SELECT file_id, model, 'match' AS kind, arg_min(token, (-cnt, token)) AS token, tag, class, max(cnt) AS cnt FROM found JOIN {CHOSEN} USING (file_id, model) GROUP BY file_id, model, class, tag
  UNION ALL SELECT c.file_id, '', 'unmatched', string_agg(c.token, ' ' ORDER BY c.token), '', '', sum(c.cnt)::BIGINT FROM token_count c LEFT JOIN (SELECT DISTINCT file_id, token FROM found) f ON f.file_id = c.file_id AND f.token = c.token WHERE f.token IS NULL AND c.file_id IN (SELECT file_id FROM {CHOSEN}) GROUP BY c.file_id
  UNION ALL SELECT doc_id, 'UNKNOWN', 'unknown', '', '', '', 0 FROM documents WHERE doc_id NOT IN (SELECT file_id FROM {CHOSEN})""")
def file_results(s, d):
    hit, found = _found(s, d)
    properties = scoring.tag_properties(found).select("file_id", "model", "trivial")
    manual = (F.col("file_id") % 13 == 0) & (F.col("model") == "MIXLEX")
    chosen = scoring.scores(hit, found).join(properties, ["file_id", "model"]).withColumn("source", F.when(manual, "SELECTION").otherwise("DETECTION")).withColumn("selected", (F.col("file_id") % 26 == 0) | (F.col("file_id") % 13 != 0))
    return handlers.file_results(hit, found, chosen, t.table(s, d, "documents").select(F.col("doc_id").alias("file_id")))


@query("ordered_matches", "SELECT file_id, model, coverage, row_number() OVER (PARTITION BY file_id ORDER BY coverage DESC, model)::INTEGER AS place FROM scores")
def ordered_matches(s, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("coverage").desc(), "model"))
    return scoring.scores(*_found(s, d)).select("file_id", "model", "coverage", place.alias("place"))


@query("match_sum", "SELECT model, sum(different_hit_types)::BIGINT AS types, sum(hit_count_total)::BIGINT AS hits FROM scores GROUP BY model")
def match_sum(s, d):
    return scoring.scores(*_found(s, d)).groupBy("model").agg(F.sum("different_hit_types").alias("types"), F.sum("hit_count_total").alias("hits"))


@query("unit_tokens", f"SELECT p AS unit, count(DISTINCT o) AS tokens FROM {TRIPLES} GROUP BY p UNION ALL SELECT path || '@' || attr, count(DISTINCT value) FROM {OVERVIEW} WHERE attr <> '' GROUP BY 1 UNION ALL SELECT 'col' || col, count(DISTINCT value) FROM cell GROUP BY 1")
def unit_tokens(s, d):
    rows = triples(s, d).select(F.col("p").alias("unit"), F.col("o").alias("token"))
    rows = rows.union(readers.xml_overview(xml_docs(s, d)).where("attr <> ''").select(F.concat("path", F.lit("@"), "attr"), "value"))
    return handlers.unit_tokens(rows.union(cell(s, d).select(F.concat(F.lit("col"), F.col("col").cast("string")), "value")), "unit")


@query("column_vocabulary", "SELECT file_id, col, count(DISTINCT value) FILTER (row_no < 3) AS sample_types, count(DISTINCT value) AS types, coalesce(string_agg(value, chr(9) ORDER BY row_no) FILTER (row_no < 3), '') AS tsv FROM cell GROUP BY ALL")
def column_vocabulary(s, d):
    return handlers.vocabulary(cell(s, d), 3)


@query("text_columns_spoken", None)
def text_columns_spoken(s, d):
    """Text columns in which a language is detected, by profiles of the documents."""
    docs = t.documents(s, d)
    profile = written(languages.profiles(docs.select("lang", "text")))
    c = cell(s, d)
    spoken = languages.detected(c.select("file_id", "col", F.col("value").alias("text")), ["file_id", "col"], profile)
    return roles.text_columns(c, conll(s, d).groupBy("file_id").agg(F.count("*").alias("rows")), spoken)


# XML


def _overview(s, d):
    return written(readers.xml_overview(xml_docs(s, d)))


@query("xml_prefix_sample", f"SELECT file_id, node_no, path, attr, value FROM {OVERVIEW} WHERE node_no < 2 AND attr <> 'text()'")
def xml_prefix_sample(s, d):
    return readers.xml_overview(xml_docs(s, d), most=2).where("attr <> 'text()'")


@query("xml_sentences", f"SELECT file_id, 0 AS root_no, count(*) AS n, count_if(attr = '') AS elements FROM {OVERVIEW} GROUP BY file_id")
def xml_sentences(s, d):
    return xmltools.subtrees(readers.xml_overview(xml_docs(s, d)), "/s").groupBy("file_id", "root_no").agg(F.count("*").alias("n"), F.count_if(F.col("attr") == "").alias("elements"))


@query("xml_sentence_sample", f"SELECT file_id, node_no AS root_no FROM {OVERVIEW} WHERE path = '/s/w' AND attr = '' ORDER BY md5('5:' || file_id || ':' || node_no) LIMIT 20")
def xml_sentence_sample(s, d):
    return xmltools.sampled_subtrees(xmltools.subtrees(readers.xml_overview(xml_docs(s, d)), "/s/w"), 20, 5)


@query("xml_parents", f"SELECT path, attributes, row_number() OVER (ORDER BY attributes DESC, path)::INTEGER AS rank FROM (SELECT path, count(DISTINCT attr) AS attributes FROM {OVERVIEW} WHERE attr NOT IN ('', 'text()') GROUP BY path)")
def xml_parents(s, d):
    return xmltools.parents(readers.xml_overview(xml_docs(s, d)))


WANTED = [("/s/w", "pos"), ("/s", "id"), ("/s/w", "lemma")]


@query("xml_pruned", f"""SELECT coalesce(o.path, a.path) AS path, coalesce(o.attr, a.attr) AS attr, CASE WHEN o.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'dropped' ELSE 'kept' END AS state, coalesce(n, 0)::BIGINT AS n
  FROM (SELECT path, attr, count(*) AS n FROM {OVERVIEW} WHERE attr <> '' GROUP BY ALL) o FULL JOIN (VALUES {t._values(WANTED)}) a(path, attr) ON o.path = a.path AND o.attr = a.attr""")
def xml_pruned(s, d):
    return xmltools.pruned(readers.xml_overview(xml_docs(s, d)), s.createDataFrame(WANTED, "path string, attr string"))


@query("xml_attribute_sample", f"SELECT path, attr, 'literal' AS kind, value FROM (SELECT *, row_number() OVER (PARTITION BY path, attr ORDER BY value) AS k FROM (SELECT DISTINCT path, attr, value FROM {OVERVIEW} WHERE attr <> '')) WHERE k <= 4")
def xml_attribute_sample(s, d):
    return xmltools.attribute_sample(readers.xml_overview(xml_docs(s, d)), 4)


@query("xml_column_map", f"SELECT path, attr, CASE attr WHEN 'text()' THEN 0 ELSE 1 END AS col, count(DISTINCT value) AS types FROM {OVERVIEW} WHERE path = '/s/w' AND attr IN ('text()', 'pos') GROUP BY ALL")
def xml_column_map(s, d):
    return xmltools.column_map(["text()", "pos"], readers.xml_overview(xml_docs(s, d)), "/s/w")


@query("xml_chosen_elements", f"SELECT DISTINCT path, attr FROM {OVERVIEW} WHERE attr NOT IN ('', 'text()')")
def xml_chosen_elements(s, d):
    return xmltools.chosen_elements(_overview(s, d), written)


@query("template_similarity", """SELECT a, b, round(m.c / (na + nb - m.c), 6) AS similarity FROM (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS c FROM (SELECT DISTINCT p_brand, p_name FROM part) x JOIN (SELECT DISTINCT p_brand, p_name FROM part) y ON x.p_name = y.p_name AND x.p_brand < y.p_brand GROUP BY ALL) m
  JOIN (SELECT p_brand, count(DISTINCT p_name) AS na FROM part GROUP BY 1) k ON k.p_brand = a JOIN (SELECT p_brand, count(DISTINCT p_name) AS nb FROM part GROUP BY 1) n ON n.p_brand = b""")
def template_similarity(s, d):
    return xmltools.template_similarity(t.table(s, d, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("p")))


# languages

WORDS = "(SELECT doc_id, lang, w, count(*) AS cnt FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[\\s\\p{P}\\p{S}0-9]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL)"
GRAM = f"(SELECT doc_id, lang, substr(' ' || w || ' ', unnest(range(1, length(w) + 1)), 3) AS gram, cnt FROM {WORDS})"
PROFILE = f"(SELECT lang, gram, freq FROM (SELECT lang, gram, sum(cnt)::BIGINT AS freq, row_number() OVER (PARTITION BY lang ORDER BY sum(cnt) DESC, gram) AS r FROM {GRAM} GROUP BY lang, gram) WHERE r <= 300)"
DETECTED = f"""(SELECT doc_id, lang, round(exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w, 6) AS prob FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM (
  SELECT k.doc_id, p.lang, sum(k.cnt * (ln(p.freq + 0.5) - ln(0.5))) + any_value(z.mass) * (ln(0.5) - ln(any_value(t.total) + 0.5 * (any_value(t.n) + 1))) AS score FROM (SELECT doc_id, gram, sum(cnt) AS cnt FROM {GRAM} GROUP BY ALL) k JOIN profile p USING (gram)
  JOIN (SELECT lang, sum(freq) AS total, count(*) AS n FROM profile GROUP BY lang) t ON t.lang = p.lang JOIN (SELECT doc_id, sum(cnt) AS mass FROM {GRAM} WHERE gram IN (SELECT gram FROM profile) GROUP BY doc_id) z ON z.doc_id = k.doc_id GROUP BY k.doc_id, p.lang)) WINDOW w AS (PARTITION BY doc_id))"""


def _profile(s, d):
    return written(languages.profiles(t.documents(s, d).select("lang", "text")))


@query("language_profiles", f"SELECT lang, gram, freq FROM {PROFILE}")
def language_profiles(s, d):
    return languages.profiles(t.documents(s, d).select("lang", "text"))


@query("language_detection", f", profile AS {PROFILE} SELECT doc_id, lang, round(prob, 3) AS prob FROM {DETECTED} WHERE prob >= 0.1")
def language_detection(s, d):
    return languages.detected(t.documents(s, d).select("doc_id", "text"), ["doc_id"], _profile(s, d)).select("doc_id", "lang", F.round("prob", 3).alias("prob"))


@query("ngram_language_score", f", profile AS {PROFILE} SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, lang) AS k FROM {DETECTED}) WHERE k = 1")
def ngram_language_score(s, d):
    return languages.best(languages.detected(t.documents(s, d).select("doc_id", "text"), ["doc_id"], _profile(s, d)), ["doc_id"])


@query("sentence_languages", None)
def sentence_languages(s, d):
    """Per document the languages of its lines: how many lines each is the best of, and its mean probability over all lines."""
    from lexispark.operators import lifecycle

    lines = t.documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    top = languages.most_probable(languages.detected(lines, ["doc_id", "line"], _profile(s, d)), ["doc_id", "line"])
    return lifecycle.language_probabilities(top.select(F.col("doc_id").alias("file_id"), "lang", "prob"))
