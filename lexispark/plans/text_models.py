"""Queries on dictionary matches, model scores and catalogue search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import matching, scoring, search
from lexispark.plans import derived as t
from lexispark.plans.derived import SQL
from lexispark.plans.durable import written


def _found(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A file's tokens and their matches, written out: scores, degrees and properties read them, no text is split again."""
    hit = written(t.token_count(s, d))
    return hit, written(matching.matches(hit, t.tag_dict(s), t.file_language(s, d)))


def _only_found(s: SparkSession, d: str) -> DataFrame:
    """The matches alone: no hit is written for them, as the dictionary's few tags meet the hits in one pass."""
    return matching.matches(t.token_count(s, d, t.tag_dict(s)), t.tag_dict(s), t.file_language(s, d))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    hit, found = _found(s, d)
    manual = (F.col("file_id") % 13 == 0) & (F.col("model") == "MIXLEX")
    properties = scoring.tag_properties(found).select("file_id", "model", "trivial")
    return scoring.scores(hit, found).join(properties, ["file_id", "model"]).withColumn("method", F.when(manual, "MANUAL").otherwise("AUTO")).withColumn("selected", (F.col("file_id") % 26 == 0) | (F.col("file_id") % 13 != 0))


SCORES = ["file_id", "model", "different_hit_types", "exclusive_hit_types", "hit_count_total", "exclusive_hit_count_total", "coverage"]
Q: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = (f, sql and SQL + sql)
        return f

    return put


@query("token_counts", "SELECT file_id, token, cnt FROM token_count")
def token_counts(s, d):
    return t.token_count(s, d)


@query("annotation_prefilter", "SELECT * FROM token_count WHERE regexp_matches(token, '[$*^.\\[|]') OR token IN (SELECT tag FROM tag_dict)")
def annotation_prefilter(s, d):
    return matching.prefilter(t.token_count(s, d), t.tag_dict(s))


@query("literal_match", "SELECT * FROM literal_match")
def literal_match(s, d):
    return matching.literal_matches(t.token_count(s, d, t.tag_dict(s).where("NOT is_regex")), t.tag_dict(s))


@query("regex_match", "SELECT * FROM regex_match")
def regex_match(s, d):
    return matching.regex_matches(t.token_count(s, d, t.tag_dict(s).where("is_regex")), t.tag_dict(s))


#: Three patterns of each token of six letters or more: a letter left open, an end, alternatives.
@query("pattern_dictionary_match", r"""SELECT substr(token, 1, 2) || '[a-z]' || substr(token, 4) AS tag, count(*) AS n FROM (SELECT DISTINCT token FROM token_count WHERE length(token) >= 6) GROUP BY 1
UNION ALL SELECT '.*' || e, (SELECT count(*) FROM (SELECT DISTINCT token FROM token_count WHERE length(token) = 5) f WHERE f.token = e) + n FROM (SELECT right(token, 5) AS e, count(*) AS n FROM (SELECT DISTINCT token FROM token_count WHERE length(token) >= 6) GROUP BY 1)
UNION ALL SELECT DISTINCT substr(token, 1, 3) || '(' || substr(token, 4, 2) || '|\(|[|)])' || substr(token, 6), 1 FROM token_count WHERE length(token) >= 6""")
def pattern_dictionary_match(s, d):
    tokens = written(t.tokens_of(s, d))
    part = lambda at, n=1_000: F.substring("token", at, n)
    open_ = F.concat(part(1, 2), F.lit("[a-z]"), part(4))
    choice = F.concat(part(1, 3), F.lit("("), part(4, 2), F.lit(r"|\(|[|)])"), part(6))
    tags = tokens.where("length(token) >= 6").select(F.explode(F.array(open_, F.concat(F.lit(".*"), part(-5, 5)), choice)).alias("tag"), F.lit(True).alias("is_regex")).distinct()
    return matching.pattern_tokens(tokens, tags).groupBy("tag").agg(F.count("*").alias("n"))


@query("language_filtered_match", "SELECT * FROM found")
def language_filtered_match(s, d):
    return _only_found(s, d)


@query("new_matches_only", "SELECT * FROM literal_match m WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.file_id = m.file_id AND f.token = m.token AND f.model = m.model AND f.tag = m.tag)")
def new_matches_only(s, d):
    hit = written(t.token_count(s, d, t.tag_dict(s)))
    found = matching.matches(hit, t.tag_dict(s), t.file_language(s, d))
    return matching.without_known(matching.literal_matches(hit, t.tag_dict(s)), found, ["file_id", "token", "model", "tag"])


@query("model_scores", f"SELECT {', '.join(SCORES)} FROM scores")
def model_scores(s, d):
    return scoring.scores(*_found(s, d)).select(*SCORES)


@query("hit_tags", "SELECT file_id, model, list(DISTINCT tag ORDER BY tag) AS tags FROM found GROUP BY ALL")
def hit_tags(s, d):
    return _only_found(s, d).select("file_id", "model", "tag").distinct().groupBy("file_id", "model").agg(F.sort_array(F.collect_list("tag")).alias("tags"))


@query("tag_properties", "SELECT file_id, model, only_numeric, only_symbolic, max_tag_length::INTEGER AS max_tag_length, (only_numeric OR only_symbolic OR max_tag_length = 1 OR types = 1) AS trivial FROM properties")
def tag_properties(s, d):
    return scoring.tag_properties(_only_found(s, d)).drop("types")


BEST = """SELECT file_id, model, coverage, method FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY (method = 'MANUAL' AND selected) DESC, coverage DESC, exclusive_hit_types DESC, hit_count_total DESC, exclusive_hit_count_total DESC, model) AS n
  FROM candidates WHERE (method = 'MANUAL' AND selected) OR (method <> 'MANUAL' AND coverage >= 0.01 AND NOT trivial)) WHERE n = 1"""


@query("best_model", BEST)
def best_model(s, d):
    # texts have thousands of different words, so a hundredth of them is much; files of tags take the default of 0.4
    return scoring.best_per(_candidates(s, d), ["file_id"], coverage=0.01).select("file_id", "model", "coverage", "method")


@query("deselect_trivial", "SELECT file_id, model, CASE WHEN method = 'MANUAL' AND selected THEN true WHEN coverage < 0.01 OR trivial THEN false ELSE selected END AS selected FROM candidates")
def deselect_trivial(s, d):
    return scoring.deselected(_candidates(s, d), 0.01).select("file_id", "model", "selected")


@query("unmatched_tokens", "SELECT file_id, count(*) AS n, sum(cnt)::BIGINT AS cnt, list(token ORDER BY token) AS tokens FROM token_count c WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.file_id = c.file_id AND f.token = c.token) GROUP BY file_id")
def unmatched_tokens(s, d):
    return matching.unmatched(*_found(s, d))


@query("total_token_counts", "SELECT f.file_id, f.token, f.model, f.tag, t.total::BIGINT AS total FROM found f JOIN (SELECT file_id, sum(cnt) AS total FROM token_count GROUP BY 1) t USING (file_id)")
def total_token_counts(s, d):
    hit, found = _found(s, d)
    return found.join(hit.groupBy("file_id").agg(F.sum("cnt").cast("long").alias("total")), "file_id").select("file_id", "token", "model", "tag", "total")


@query("recovered_denominator", "SELECT file_id, model, round(different_hit_types / coverage)::BIGINT AS tokens FROM scores WHERE coverage > 0")
def recovered_denominator(s, d):
    return scoring.scores(*_found(s, d)).where("coverage > 0").select("file_id", "model", F.round(F.col("different_hit_types") / F.col("coverage")).cast("long").alias("tokens"))


def _languages(s, d):
    return t.resource_file(s, d).select("url", F.col("lang").alias("value"), "selected")


def _sources(s, d):
    return t.resource_file(s, d).select("url", F.col("source").alias("value"), "selected")


@query("search_or", "SELECT DISTINCT url FROM resource_file WHERE selected AND lang IN ('deu', 'fra')")
def search_or(s, d):
    return search.any_of(_languages(s, d), ["deu", "fra"])


AND = "SELECT url FROM resource_file WHERE lang IN ('eng', 'deu') GROUP BY url HAVING count(DISTINCT lang) = 2"


@query("search_and", AND)
def search_and(s, d):
    return search.all_of(_languages(s, d), ["eng", "deu"], only_selected=False)


@query("search_and_models", "SELECT url FROM files WHERE status <> 'DISABLED' AND format IN ('RDF', 'XML') GROUP BY url HAVING count(DISTINCT format) = 2")
def search_and_models(s, d):
    models = t.files(s, d).select("url", F.col("format").alias("value"), (F.col("status") != "DISABLED").alias("selected"))
    return search.all_of(models, ["RDF", "XML"])


@query("search_exclusive_or", "SELECT DISTINCT url FROM resource_file WHERE selected AND lang IN ('eng', 'spa') AND url IN (SELECT url FROM resource_file GROUP BY url HAVING count(DISTINCT lang) = 1)")
def search_exclusive_or(s, d):
    rows = _languages(s, d)
    return search.only(rows, search.any_of(rows, ["eng", "spa"]), 1, only_selected=False)


@query("search_exclusive_and", f"{AND} AND url IN (SELECT url FROM resource_file GROUP BY url HAVING count(DISTINCT lang) = 2)")
def search_exclusive_and(s, d):
    rows = _languages(s, d)
    return search.only(rows, search.all_of(rows, ["eng", "deu"], only_selected=False), 2, only_selected=False)


@query("faceted_find", "SELECT DISTINCT url FROM files WHERE url IN (SELECT url FROM resource_file WHERE selected AND lang = 'eng') AND url IN (SELECT url FROM resource_file WHERE selected AND source IN ('src0', 'src3')) AND regexp_full_match(url, '.*r\\.example/1.*') AND type = 'CORPUS'")
def faceted_find(s, d):
    f = t.files(s, d)
    named = f.where(F.col("url").rlike(r"^.*r\.example/1.*$")).select("url")
    typed = search.by_single_type(f.select("url", "type"), "CORPUS")
    return search.all_facets(search.any_of(_languages(s, d), ["eng"]), search.any_of(_sources(s, d), ["src0", "src3"]), named, typed).distinct()


@query("name_like", "SELECT DISTINCT url FROM files WHERE regexp_full_match(url, '.*/3.*7.*') AND type <> 'ONTOLOGY'")
def name_like(s, d):
    return t.files(s, d).where(F.col("url").rlike("^(?:.*/3.*7.*)$") & (F.col("type") != "ONTOLOGY")).select("url").distinct()


@query("search_by_type", "SELECT url FROM files GROUP BY url HAVING count(DISTINCT type) = 1 AND max(type) = 'UNKNOWN'")
def search_by_type(s, d):
    return search.by_single_type(t.files(s, d).select("url", "type"), "UNKNOWN")


@query("metadata_text", "SELECT url, file_id FROM files WHERE concat_ws(' ', url, status, format, type, source) ILIKE '%xml corpus src1%'")
def metadata_text(s, d):
    return t.files(s, d).where(search.matching(F.concat_ws(" ", "url", "status", "format", "type", "source"), "xml corpus src1")).select("url", "file_id")


@query("comment_text", "SELECT DISTINCT conv_id FROM conversations WHERE text ILIKE '%then%'")
def comment_text(s, d):
    return t.table(s, d, "conversations").where(search.matching(F.col("text"), "the*n")).select("conv_id").distinct()


@query("search_by_tag", "SELECT DISTINCT 'http://r.example/' || (file_id % 400) AS url FROM found WHERE lower(tag) = 'und' OR class = 'Pronoun'")
def search_by_tag(s, d):
    found = _only_found(s, d).where((F.lower("tag") == "und") | (F.col("class") == "Pronoun"))
    return found.select(F.concat(F.lit("http://r.example/"), (F.col("file_id") % 400).cast("string")).alias("url")).distinct()


@query("inverted_index", 'SELECT tag AS "key", count(DISTINCT file_id) AS n, list(DISTINCT file_id ORDER BY file_id) AS "values" FROM found GROUP BY tag')
def inverted_index(s, d):
    return search.inverted_index(_only_found(s, d), "tag", "file_id").withColumnRenamed("tag", "key")


@query("posting_lists", """SELECT tag AS "key", bucket, count(*) AS n, list(gap ORDER BY file_id) AS gaps FROM (
  SELECT *, file_id % 128 - coalesce(lag(file_id % 128) OVER (PARTITION BY tag, bucket ORDER BY file_id), 0) AS gap FROM (SELECT DISTINCT tag, file_id, file_id // 128 AS bucket FROM found)) GROUP BY tag, bucket""")
def posting_lists(s, d):
    return search.posting_lists(_only_found(s, d), "tag", "file_id", 128)


@query("posting_search", "SELECT file_id FROM found WHERE tag IN ('the', 'of', '.{3,9}tion') GROUP BY file_id HAVING count(DISTINCT tag) = 3")
def posting_search(s, d):
    return search.holding(written(posting_lists(s, d)), ["the", "of", ".{3,9}tion"], 128).select(F.col("value").alias("file_id"))


@query("class_index", 'SELECT class AS "key", count(DISTINCT file_id) AS n, list(DISTINCT file_id ORDER BY file_id) AS "values" FROM found GROUP BY class')
def class_index(s, d):
    return search.inverted_index(_only_found(s, d), "class", "file_id").withColumnRenamed("class", "key")


@query("autocomplete", "SELECT DISTINCT token FROM token_count WHERE contains(lower(token), 'shon')")
def autocomplete(s, d):
    return t.token_count(s, d).where(F.lower("token").contains("shon")).select("token").distinct()


STATS = ", ".join(f"count_if({c})::BIGINT AS {c}" for c in ("corpus", "lexicon", "ontology", "rdf", "conll", "xml"))


@query("catalog_stats", f"""SELECT count(*) AS resources, {STATS}, (SELECT count(DISTINCT lang) FROM files WHERE url IN (SELECT url FROM files WHERE status = 'ACCEPTED')) AS languages FROM (
  SELECT url, bool_or(type = 'CORPUS') AS corpus, bool_or(type = 'LEXICON') AS lexicon, bool_or(type = 'ONTOLOGY') AS ontology, bool_or(format = 'RDF') AS rdf, bool_or(format = 'CONLL') AS conll, bool_or(format = 'XML') AS xml
  FROM files GROUP BY url HAVING bool_or(status = 'ACCEPTED'))""")
def catalog_stats(s, d):
    return search.statistics(t.files(s, d))


@query("status_any", "SELECT url FROM files GROUP BY url HAVING bool_or(status = 'CHECK')")
def status_any(s, d):
    return search.with_status(t.files(s, d), "CHECK", every=False)


@query("status_every", "SELECT url FROM files GROUP BY url HAVING bool_and(status = 'PROCESSED')")
def status_every(s, d):
    return search.with_status(t.files(s, d), "PROCESSED", every=True)
