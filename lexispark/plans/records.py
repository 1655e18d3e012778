"""Queries on triples, predicates, URLs, states, curation, reconciliation, XML, languages and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.columns import first_lines, format_of, host_of, last_segment, path_of
from lexispark.operators import exports, lifecycle, observations, xmltools
from lexispark.plans import derived as t
from lexispark.plans.derived import SQL
from lexispark.plans.durable import written
from lexispark.sources import readers

Q: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = (f, sql and SQL + sql)
        return f

    return put


#: Triples made of parts: three predicates each, with literals, URIs and languages.
TRIPLES = """(SELECT 'http://p.example/' || p_partkey AS s, 'http://x.example/vocab#brand' AS p, p_brand AS o, 'literal' AS o_kind, 'en' AS o_lang, p_partkey * 3 AS pos FROM part
  UNION ALL SELECT 'http://p.example/' || p_partkey, 'http://x.example/vocab#type', 'http://t.example/' || p_type, 'uri', NULL, p_partkey * 3 + 1 FROM part
  UNION ALL SELECT 'http://p.example/' || p_partkey, 'http://x.example/vocab#label', p_name, 'literal', CASE WHEN p_partkey % 2 = 0 THEN 'de' ELSE 'fr' END, p_partkey * 3 + 2 FROM part)"""


def triples(s, d):
    p = t.table(s, d, "part")
    subject, v = F.concat(F.lit("http://p.example/"), F.col("p_partkey").cast("string")), "http://x.example/vocab#"
    row = lambda name, o, kind, lang, k: F.struct(F.lit(v + name).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), lang.alias("o_lang"), (F.col("p_partkey") * 3 + k).alias("at"))
    rows = F.array(
        row("brand", F.col("p_brand"), "literal", F.lit("en"), 0),
        row("type", F.concat(F.lit("http://t.example/"), "p_type"), "uri", F.lit(None).cast("string"), 1),
        row("label", F.col("p_name"), "literal", F.when(F.col("p_partkey") % 2 == 0, "de").otherwise("fr"), 2),
    )
    return p.select(subject.alias("s"), F.explode(rows).alias("r")).select("s", "r.*")


@query("predicate_object_counts", f"SELECT p, o, count(*) AS cnt FROM {TRIPLES} GROUP BY ALL")
def predicate_object_counts(s, d):
    return observations.object_counts(triples(s, d))


@query("sampled_object_counts", f"""SELECT x.p, x.o, count(*) AS cnt FROM {TRIPLES} x LEFT JOIN (SELECT p, pos AS stop FROM (SELECT p, pos, row_number() OVER (PARTITION BY p ORDER BY pos, o) AS n FROM (SELECT p, o, min(pos) AS pos FROM {TRIPLES} GROUP BY ALL)) WHERE n = 10) c ON x.p = c.p
  WHERE stop IS NULL OR pos <= stop GROUP BY ALL""")
def sampled_object_counts(s, d):
    return observations.sampled_object_counts(triples(s, d), 10, "at")


@query("language_tags", f"SELECT o_lang, p, count(*) AS n, 1.0::DOUBLE AS avg_prob, 'LANGTAG' AS source FROM {TRIPLES} WHERE o_lang IS NOT NULL GROUP BY ALL")
def language_tags(s, d):
    return triples(s, d).where("o_lang IS NOT NULL").groupBy("o_lang", "p").agg(F.count("*").alias("n")).select("*", F.lit(1.0).alias("avg_prob"), F.lit("LANGTAG").alias("source"))


@query("triple_count", f"SELECT count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates FROM {TRIPLES}")
def triple_count(s, d):
    return triples(s, d).agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"))


@query("object_filter", f"SELECT s, p, o FROM {TRIPLES} WHERE p NOT LIKE '%#comment' AND p NOT LIKE '%#versionInfo' AND p NOT LIKE '%#label' AND (o_kind = 'uri' OR length(o) <= 35 AND NOT regexp_matches(o, '[:/@., \\[\\]{{}}]') AND NOT regexp_full_match(o, '[0-9]+'))")
def object_filter(s, d):
    return triples(s, d).where(observations.object_allowed(F.col("p"), F.col("o"), F.col("o_kind"))).select("s", "p", "o")


BRANDS = [("Brand#11",), ("Brand#23",), ("Brand#45",)]


@query("allowed_predicates", f"SELECT p, bool_or(o IN ('Brand#11', 'Brand#23', 'Brand#45')) AS allowed FROM {TRIPLES} GROUP BY p")
def allowed_predicates(s, d):
    return observations.allowed_predicates(triples(s, d), s.createDataFrame(BRANDS, "tag string"))


@query("found_per_attribute", f"SELECT p, coalesce(list(DISTINCT o ORDER BY o) FILTER (o IN ('Brand#11', 'Brand#23', 'Brand#45')), []) AS tags FROM {TRIPLES} GROUP BY p")
def found_per_attribute(s, d):
    return observations.found_per_attribute(triples(s, d), s.createDataFrame(BRANDS, "tag string"))


@query("predicate_quality", """SELECT predicate, good, bad, CASE WHEN predicate = 'signup' THEN 'good' WHEN predicate = 'view' THEN 'bad' WHEN good = 0 AND bad > 4 THEN 'bad' WHEN good > 0 AND bad < 4 THEN 'good' ELSE 'undecided' END AS verdict
  FROM (SELECT event_type AS predicate, count_if(event_type <> 'error')::BIGINT AS good, count_if(event_type = 'error')::BIGINT AS bad FROM events GROUP BY 1)""")
def predicate_quality(s, d):
    e = F.col("event_type")
    return observations.predicate_quality(t.table(s, d, "events").select(e.alias("predicate"), (e != "error").alias("good"), (e == "signup").alias("is_default"), (e == "view").alias("disabled")))


VOCABULARIES = [("X", "http://x.example/"), ("T", "http://t.example/t"), ("Q", "http://q.example/")]


@query("vocabularies", f"SELECT DISTINCT v.vocabulary FROM (SELECT DISTINCT regexp_replace(p, '[^/#]*$', '') AS n FROM {TRIPLES} UNION SELECT DISTINCT regexp_replace(o, '[^/#]*$', '') FROM {TRIPLES} WHERE o_kind = 'uri') JOIN (VALUES {t._values(VOCABULARIES)}) v(vocabulary, prefix) ON starts_with(n, prefix) OR starts_with(prefix, n)")
def vocabularies(s, d):
    x = triples(s, d)
    space = lambda c: F.regexp_replace(c, "[^/#]*$", "").alias("namespace")
    spaces = x.select(space(F.col("p"))).union(x.where("o_kind = 'uri'").select(space(F.col("o")))).distinct()
    return observations.vocabularies(spaces, s.createDataFrame(VOCABULARIES, "vocabulary string, prefix string"))


PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
EXT = f"lower(regexp_extract({PATH}, '\\.([A-Za-z0-9]+)$', 1))"
FORMAT = f"CASE WHEN {EXT} = '' THEN 'NOEXT' WHEN {EXT} IN ('html', 'htm', 'xhtml') THEN 'HTML' ELSE 'UNKNOWN' END"


@query("url_format", f"SELECT url, {EXT} AS extension, {FORMAT} AS format FROM pages")
def url_format(s, d):
    return observations.by_format(t.table(s, d, "pages"))


@query("format_statistics", f"SELECT {FORMAT} AS format, count(*) AS n, {FORMAT} = 'HTML' AS taken FROM pages GROUP BY ALL")
def format_statistics(s, d):
    return observations.format_statistics(t.table(s, d, "pages"), ["HTML", "RDF"])


@query("url_parts", f"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, {PATH} AS path, regexp_extract(url, '([^/#]*)$', 1) AS last FROM pages")
def url_parts(s, d):
    u = F.col("url")
    return t.table(s, d, "pages").select("page_id", host_of(u).alias("host"), path_of(u).alias("path"), last_segment(u).alias("last"))


@query("blacklist", "SELECT page_id, url FROM pages WHERE NOT contains(url, 'cheap') AND NOT contains(url, '/fr/')")
def blacklist(s, d):
    return observations.without_listed(t.table(s, d, "pages").select("page_id", "url"), ["cheap", "/fr/"])


@query("url_pool", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")
def url_pool(s, d):
    p = t.table(s, d, "pages")
    return observations.pool(p, p.where("page_id % 5 = 0"))


@query("html_links", r"""SELECT page_id, href, url, contains(regexp_extract(url, '^[^/]+//[^/?#]*(?:/[^/?#]*)*/([^/?#]*)', 1), '.') AS is_file FROM (
  SELECT page_id, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN split_part(base, '//', 1) || href WHEN starts_with(href, '/') THEN base || href ELSE base || folder || href END AS url
  FROM (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS base, coalesce(nullif(regexp_extract(url, '^[^/]+//[^/?#]*(/(?:[^/?#]*/)*)', 1), ''), '/') AS folder,
    replace(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]*)', 1)), '&amp;', '&') AS href FROM pages) WHERE href <> '')""")
def html_links(s, d):
    return readers.html_links(t.table(s, d, "pages"))


PLAIN = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>', ' ', 'g')"
for _reference, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    PLAIN = f"replace({PLAIN}, '{_reference}', '{_char}')"


@query("html_plain_text", rf"SELECT page_id, trim(regexp_replace({PLAIN}, '\s+', ' ', 'g')) AS text FROM pages")
def html_plain_text(s, d):
    return t.table(s, d, "pages").select("page_id", readers.html_text("html").alias("text"))


@query("first_lines", "SELECT doc_id, substr(array_to_string(string_split(text, chr(10))[1:2], chr(10)), 1, 3000) AS sample FROM documents")
def first_lines_(s, d):
    return t.table(s, d, "documents").select("doc_id", first_lines(F.col("text"), 2).alias("sample"))


@query("folder_sampling", """SELECT folder, path, good FROM (SELECT *, coalesce(sum(good::INT) OVER w, 0) AS g, coalesce(sum((NOT good)::INT) OVER w, 0) AS b, count(*) OVER (PARTITION BY folder) AS n
  FROM (SELECT source AS folder, doc_id AS path, doc_id % 3 <> 0 AS good FROM documents) WINDOW w AS (PARTITION BY folder ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n < 20 OR NOT (g >= 15 OR b > 8 OR g + b >= 30)""")
def folder_sampling(s, d):
    files = t.table(s, d, "documents").select(F.col("source").alias("folder"), F.col("doc_id").alias("path"), (F.col("doc_id") % 3 != 0).alias("good"))
    return observations.folder_sample(files, good=15, bad=8, most=30, least=20)


@query("approved", "SELECT url, bool_or(status = 'ACCEPTED') AS accepted, NOT bool_or(status IN ('PROCESSED', 'CHECK', 'EDITED')) AS settled FROM files GROUP BY url")
def approved(s, d):
    return lifecycle.approved(t.files(s, d))


@query("parse_result", "SELECT file_id, CASE WHEN file_id % 17 = 0 THEN 'ERROR' WHEN n = 0 AND lang = '' THEN 'NONE' ELSE 'SUCCESS' END AS result FROM (SELECT f.file_id, f.lang, count(m.model) AS n FROM file_language f LEFT JOIN found m USING (file_id) GROUP BY ALL)")
def parse_result(s, d):
    from lexispark.operators import matching

    found = matching.matches(t.token_count(s, d, t.tag_dict(s)), t.tag_dict(s), t.file_language(s, d)).groupBy("file_id").agg(F.count("*").alias("n"))
    rows = t.file_language(s, d).join(found, "file_id", "left").fillna({"n": 0})
    return rows.select("file_id", lifecycle.parse_result(F.when(F.col("file_id") % 17 == 0, "x").otherwise(""), F.col("n"), (F.col("lang") != "").cast("int")).alias("result"))


@query("resource_type", "SELECT url, CASE WHEN bool_or(type = 'CORPUS') THEN 'CORPUS' WHEN bool_or(type = 'LEXICON') THEN 'LEXICON' WHEN bool_or(type = 'ONTOLOGY') THEN 'ONTOLOGY' ELSE 'UNKNOWN' END AS type FROM files GROUP BY url")
def resource_type(s, d):
    return lifecycle.resource_type(t.files(s, d).select("url", *[(F.col("type") == x.upper()).alias(x) for x in ("corpus", "lexicon", "ontology")]))


FIELDS = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS description, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS date FROM customer)"
STATE = "CASE WHEN n = 0 THEN 'EMPTY' WHEN n = 3 THEN 'COMPLETE' WHEN coalesce(title, '') <> '' AND (coalesce(description, '') <> '' OR coalesce(date, '') <> '') THEN 'SUFFICIENT' ELSE 'INCOMPLETE' END"
META = f"(SELECT id, {STATE} AS state FROM (SELECT *, (coalesce(title, '') <> '')::INT + (coalesce(description, '') <> '')::INT + (coalesce(date, '') <> '')::INT AS n FROM {FIELDS}))"


def _metadata(s, d):
    k = F.col("c_custkey")
    rows = t.table(s, d, "customer").select(k.alias("id"), F.when(k % 5 == 0, "").otherwise(F.col("c_name")).alias("title"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("description"), F.when(k % 2 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("date"))
    return rows.select("id", lifecycle.metadata_state({c: F.col(c) for c in ("title", "description", "date")}).alias("state"))


@query("metadata_state", f"SELECT * FROM {META}")
def metadata_state(s, d):
    return _metadata(s, d)


@query("metadata_histogram", f"SELECT state, count(*) AS n FROM {META} GROUP BY state")
def metadata_histogram(s, d):
    return _metadata(s, d).groupBy("state").agg(F.count("*").alias("n"))


SELECTED = "(SELECT file_id, file_id % 4 = 0 AS selected, (file_id % 10) / 10.0 AS coverage FROM files)"


@query("verify_state", f"SELECT file_id, CASE WHEN status = 'PROCESSED' AND type = 'UNKNOWN' THEN 'DISABLED' WHEN status = 'PROCESSED' AND type = 'CORPUS' AND NOT EXISTS (SELECT 1 FROM {SELECTED} x WHERE x.file_id = f.file_id AND selected AND coverage >= 0.4) THEN 'CHECK' ELSE status END AS status FROM files f")
def verify_state(s, d):
    f = t.files(s, d)
    n = F.col("file_id")
    return lifecycle.verified(f, f.select("file_id", (n % 4 == 0).alias("selected"), ((n % 10) / 10).alias("coverage"))).select("file_id", "status")


@query("guard_state", "SELECT file_id, CASE WHEN status = 'ACCEPTED' AND file_id % 2 = 0 THEN status ELSE CASE WHEN file_id % 2 = 0 THEN 'PROCESSED' ELSE 'EDITED' END END AS status FROM files")
def guard_state(s, d):
    return t.files(s, d).select("file_id", lifecycle.guarded(F.col("status"), F.when(F.col("file_id") % 2 == 0, "PROCESSED").otherwise("EDITED")).alias("status"))


@query("prefix_update", "SELECT file_id, url, CASE WHEN starts_with(url, 'http://r.example/1') THEN 'ACCEPTED' ELSE status END AS status FROM files")
def prefix_update(s, d):
    return t.files(s, d).select("file_id", "url", F.when(F.col("url").startswith("http://r.example/1"), "ACCEPTED").otherwise(F.col("status")).alias("status"))


KNOWN = "SELECT url, arg_max(length(html), page_id) AS size, arg_max(md5(html), page_id) AS hash FROM pages WHERE page_id % 3 <> 0 GROUP BY url"


@query("update_state", f"""SELECT n.page_id, n.url, CASE WHEN n.size <= 0 THEN 'Invalid' WHEN k.url IS NULL AND EXISTS (SELECT 1 FROM ({KNOWN}) o WHERE o.hash = n.hash AND o.url <> n.url) THEN 'Duplicate' WHEN k.url IS NULL THEN 'NotInDB'
  WHEN k.hash <> n.hash OR k.size <> n.size THEN 'Changed' ELSE 'NotChanged' END AS state
  FROM (SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) END AS size, md5(CASE WHEN page_id % 7 = 0 THEN html || 'x' ELSE html END) AS hash FROM pages) n LEFT JOIN ({KNOWN}) k ON k.url = n.url""")
def update_state(s, d):
    p = t.table(s, d, "pages")
    known = p.where("page_id % 3 <> 0").groupBy("url").agg(F.max_by(F.length("html"), "page_id").alias("size"), F.max_by(F.md5("html"), "page_id").alias("hash"))
    found = p.select("page_id", "url", F.when(F.col("page_id") % 11 == 0, 0).otherwise(F.length("html")).alias("size"), F.md5(F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))).alias("hash"))
    return lifecycle.update_state(found, known).select("page_id", "url", "state")


@query("dup_by_hash", "SELECT md5, sha256, count(DISTINCT doc_id) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents WHERE text <> '') GROUP BY ALL HAVING count(DISTINCT doc_id) > 1")
def dup_by_hash(s, d):
    rows = t.table(s, d, "documents").where("text <> ''").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))
    return lifecycle.same_hash(rows, ["md5", "sha256"], "doc_id")


@query("reconcile", """SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'dropped' WHEN o.v IS DISTINCT FROM n.v THEN 'changed' ELSE 'same' END AS state
  FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0) n ON o.k = n.k""")
def reconcile(s, d):
    o = t.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return lifecycle.reconciled(o.where("k % 3 <> 0"), o.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("v"))), ["k"], ["v"])


@query("set_compare", """SELECT source, coalesce(list(lang ORDER BY lang) FILTER (NOT b), []) AS only_a, coalesce(list(lang ORDER BY lang) FILTER (NOT a), []) AS only_b, coalesce(list(lang ORDER BY lang) FILTER (a AND b), []) AS "both"
  FROM (SELECT source, lang, bool_or(doc_id % 2 = 0) AS a, bool_or(doc_id % 9 = 1) AS b FROM documents WHERE doc_id % 2 = 0 OR doc_id % 9 = 1 GROUP BY ALL) GROUP BY source""")
def set_compare(s, d):
    x = t.table(s, d, "documents").select("doc_id", "source", "lang")
    return lifecycle.set_difference(x.where("doc_id % 2 = 0"), x.where("doc_id % 9 = 1"), "source", "lang")


@query("language_merge", """SELECT coalesce(o.f, n.f) AS file_id, 0 AS col, coalesce(o.lang, n.lang) AS lang, coalesce(o.method, 'AUTO') AS method, coalesce(n.n, o.n) AS n,
    CASE WHEN o.f IS NULL THEN NOT EXISTS (SELECT 1 FROM documents m WHERE m.doc_id = n.f AND m.doc_id % 3 <> 0 AND m.doc_id % 8 = 0) ELSE o.f % 8 = 0 OR o.f % 4 <> 0 END AS selected,
    CASE WHEN o.f IS NULL THEN 'new' WHEN n.f IS NOT NULL AND n.n <> o.n THEN 'changed' ELSE '' END AS note
  FROM (SELECT doc_id AS f, lang, CASE WHEN doc_id % 4 = 0 THEN 'MANUAL' ELSE 'AUTO' END AS method, n_chars AS n FROM documents WHERE doc_id % 3 <> 0) o
  FULL JOIN (SELECT doc_id AS f, lang, CASE WHEN doc_id % 2 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'it', 1 FROM documents WHERE doc_id % 16 = 0) n ON o.f = n.f AND o.lang = n.lang
  WHERE NOT (coalesce(o.method, '') = 'AUTO' AND n.f IS NULL)""")
def language_merge(s, d):
    x = t.table(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit(0).alias("col"), "lang", F.col("n_chars").alias("n"))
    k = F.col("file_id")
    old = x.where("file_id % 3 <> 0").withColumn("method", F.when(k % 4 == 0, "MANUAL").otherwise("AUTO")).withColumn("selected", (k % 8 == 0) | (k % 4 != 0))
    new = x.where("file_id % 5 <> 0").withColumn("n", F.when(k % 2 == 0, F.col("n") + 1).otherwise(F.col("n"))).union(x.where("file_id % 16 = 0").select("file_id", "col", F.lit("it"), F.lit(1).cast("long")))
    # the manual rows that count are those of old, so of ids that 3 does not divide
    return lifecycle.merged_languages(old, new)


@query("upsert", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, max('new' || s_name) FROM supplier WHERE s_suppkey % 4 = 0 GROUP BY 1")
def upsert(s, d):
    x = t.table(s, d, "supplier").select("s_suppkey", "s_name")
    return lifecycle.upsert(x, x.where("s_suppkey % 4 = 0").withColumn("s_name", F.concat(F.lit("new"), "s_name")), ["s_suppkey"])


@query("delete_cascade", "SELECT file_id FROM files WHERE url NOT IN (SELECT url FROM files WHERE file_id % 10 = 3)")
def delete_cascade(s, d):
    f = t.files(s, d)
    return lifecycle.cascade({"file": f}, f.where("file_id % 10 = 3"), "url")["file"].select("file_id")


@query("dimension_new", "SELECT DISTINCT source FROM documents")
def dimension_new(s, d):
    x = t.table(s, d, "documents").select("source")
    return lifecycle.with_new(x.where("source < 'src2'").distinct(), x, "source")


@query("propagate_edit", """SELECT coalesce(g.file_id, m.file_id) AS file_id, coalesce(g.col, m.col) AS col, coalesce(g.value, m.value) AS value, CASE WHEN m.col IS NULL THEN 'added' WHEN g.col IS NULL THEN 'removed' ELSE 'kept' END AS state FROM
  (SELECT f.file_id, x.col, x.value FROM (SELECT file_id FROM (SELECT conv_id AS file_id, turn AS col FROM conversations) GROUP BY 1 HAVING list(DISTINCT col ORDER BY col) = (SELECT list(DISTINCT turn ORDER BY turn) FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations))) f,
    (SELECT DISTINCT turn AS col, role AS value FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)) x) g
  FULL JOIN (SELECT DISTINCT conv_id AS file_id, turn AS col, role AS value FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING list(DISTINCT turn ORDER BY turn) = (SELECT list(DISTINCT turn ORDER BY turn) FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)))) m
  ON g.file_id = m.file_id AND g.col = m.col AND g.value = m.value""")
def propagate_edit(s, d):
    c = t.table(s, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("col"), F.col("role").alias("value"))
    return lifecycle.propagated(c.join(c.agg(F.min("file_id").alias("file_id")), "file_id", "left_semi"), c)


@query("quota_check", "SELECT source AS \"user\", sum(n_chars)::BIGINT AS bytes, count(DISTINCT url) AS resources, count(*) AS files, sum(n_chars) <= 100000 AND count(DISTINCT url) <= 60 AND count(*) <= 70 AS allowed FROM files GROUP BY source")
def quota_check(s, d):
    return lifecycle.quota_state(t.files(s, d).select(F.col("source").alias("user"), F.col("n_chars").alias("bytes"), "url"), 100_000, 60, 70)


@query("next_comment_id", "SELECT coalesce(max(event_id) + 1, 1)::BIGINT AS next_id FROM events")
def next_comment_id(s, d):
    return lifecycle.next_id(t.table(s, d, "events"), "event_id")


PROB = "(SELECT l_orderkey AS file_id, l_returnflag AS lang, l_discount AS prob FROM lineitem)"
LANG = f"SELECT file_id, lang, n, min_prob, max_prob, round(s / (sum(n) OVER (PARTITION BY file_id)), 9) AS avg_prob FROM (SELECT file_id, lang, count(*) AS n, min(prob) AS min_prob, max(prob) AS max_prob, sum(prob) AS s FROM {PROB} GROUP BY ALL)"


def _probabilities(s, d):
    return lifecycle.language_probabilities(t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("lang"), F.col("l_discount").alias("prob")))


@query("lang_probability_agg", LANG)
def lang_probability_agg(s, d):
    return _probabilities(s, d)


@query("best_language", f"SELECT file_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY avg_prob DESC, lang) AS k FROM ({LANG})) WHERE k = 1")
def best_language(s, d):
    return lifecycle.best_language(_probabilities(s, d))


@query("display_languages", "SELECT url, string_agg(lang || ' (' || cols || ')', ', ' ORDER BY lang) AS shown FROM (SELECT url, lang, string_agg(DISTINCT file_id::VARCHAR, ',' ORDER BY file_id::VARCHAR) AS cols FROM resource_file WHERE selected GROUP BY ALL) GROUP BY url")
def display_languages(s, d):
    return exports.display(t.resource_file(s, d).where("selected").select("url", "lang", F.col("file_id").cast("string").alias("col")))


XML = "'<s id=\"' || p_partkey || '\"><w pos=\"' || p_type || '\" brand=\"' || p_brand || '\">' || p_size || '</w><w pos=\"X\">y</w></s>'"


def xml_docs(s, d):
    p = t.table(s, d, "part")
    text = F.concat(F.lit('<s id="'), F.col("p_partkey").cast("string"), F.lit('"><w pos="'), "p_type", F.lit('" brand="'), "p_brand", F.lit('">'), F.col("p_size").cast("string"), F.lit('</w><w pos="X">y</w></s>'))
    return readers.spread(p.select(F.col("p_partkey").alias("file_id"), text.alias("xml")))


OVERVIEW = """(SELECT p_partkey AS file_id, x[1]::INT AS node_no, x[2] AS path, x[3] AS attr, x[4] AS value FROM (SELECT p_partkey, unnest([['0', '/s', '', ''], ['0', '/s', 'id', p_partkey::VARCHAR], ['1', '/s/w', '', ''], ['1', '/s/w', 'pos', p_type], ['1', '/s/w', 'brand', p_brand], ['1', '/s/w', 'text()', p_size::VARCHAR], ['2', '/s/w', '', ''], ['2', '/s/w', 'pos', 'X'], ['2', '/s/w', 'text()', 'y']]) AS x FROM part))"""


@query("xml_overview", f"SELECT * FROM {OVERVIEW}")
def xml_overview(s, d):
    return readers.xml_overview(xml_docs(s, d))


@query("xml_start_elements", f"SELECT file_id, count(*) AS n FROM {OVERVIEW} WHERE attr = '' GROUP BY file_id")
def xml_start_elements(s, d):
    return xmltools.start_elements(readers.xml_overview(xml_docs(s, d)))


@query("xml_attribute_frequencies", f"SELECT path, attr, value, count(*) AS n FROM {OVERVIEW} WHERE attr <> '' GROUP BY ALL")
def xml_attribute_frequencies(s, d):
    return xmltools.frequencies(readers.xml_overview(xml_docs(s, d)))


@query("xml_sample_reduction", f"SELECT path, attr, value, n FROM (SELECT *, row_number() OVER (PARTITION BY path, attr ORDER BY n DESC, value) AS k FROM (SELECT path, attr, value, count(*) AS n FROM {OVERVIEW} WHERE attr <> '' GROUP BY ALL)) WHERE k <= 3")
def xml_sample_reduction(s, d):
    return xmltools.reduced(xmltools.frequencies(readers.xml_overview(xml_docs(s, d))), 3)


@query("xml_key_space", f"SELECT path, list(DISTINCT attr ORDER BY attr) AS attrs FROM {OVERVIEW} WHERE attr <> '' GROUP BY path")
def xml_key_space(s, d):
    return xmltools.key_space(readers.xml_overview(xml_docs(s, d)))


@query("xml_annotation_attributes", f"""SELECT path, attr FROM (SELECT path, attr, (count(DISTINCT value) / count(*) < 0.4)::INT + (count_if(value <> lower(value)) >= 0.8 * count(*))::INT + (count_if(NOT contains(value, ' ')) >= 0.8 * count(*))::INT AS checks
  FROM {OVERVIEW} WHERE attr <> '' GROUP BY ALL) WHERE checks / 3 > 0.6""")
def xml_annotation_attributes(s, d):
    return xmltools.annotation_attributes(readers.xml_overview(xml_docs(s, d)))


TEMPLATES = [("t1", "/s/w@pos"), ("t1", "/s/w@brand"), ("t2", "/s/w@pos"), ("t2", "/s@id"), ("t2", "/s/w@lemma")]
QUALITY = f"""SELECT id, round(i / u, 6) AS accuracy, round(i / n, 6) AS precision, round(i / m, 6) AS recall FROM (SELECT v.id, count(d.p) AS i, count(*) AS n, any_value(z.m) AS m, count(*) + any_value(z.m) - count(d.p) AS u
  FROM (VALUES {t._values(TEMPLATES)}) v(id, p) LEFT JOIN (SELECT DISTINCT path || '@' || attr AS p FROM {OVERVIEW} WHERE attr NOT IN ('', 'text()')) d ON v.p = d.p
  CROSS JOIN (SELECT count(*) AS m FROM (SELECT DISTINCT path || '@' || attr FROM {OVERVIEW} WHERE attr NOT IN ('', 'text()'))) z GROUP BY v.id)"""


@query("template_quality", QUALITY)
def template_quality(s, d):
    return xmltools.template_quality(s.createDataFrame(TEMPLATES, "id string, p string"), written(readers.xml_overview(xml_docs(s, d))))


@query("best_template", f"SELECT arg_max(id, (recall, accuracy, precision)) AS id FROM ({QUALITY})")
def best_template(s, d):
    return xmltools.best_template(template_quality(s, d))


@query("word_path", f"SELECT max((n, path))[2] AS path FROM (SELECT path, count(*) AS n FROM {OVERVIEW} WHERE attr = '' GROUP BY path)")
def word_path(s, d):
    return xmltools.word_path(readers.xml_overview(xml_docs(s, d)))


@query("sentence_path", f"""SELECT * FROM (WITH p AS (SELECT path, count(*) AS n FROM {OVERVIEW} WHERE attr = '' GROUP BY path HAVING count(*) > 1),
  parts AS (SELECT path, string_split(path, '/')[2:] AS e FROM p),
  common AS (SELECT k, '/' || array_to_string(any_value(e[1:k]), '/') AS prefix FROM parts, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS k) GROUP BY k HAVING count(DISTINCT e[1:k]) = 1 AND count(*) = (SELECT count(*) FROM parts)),
  longest AS (SELECT arg_max(prefix, k) AS path FROM common), word AS (SELECT max((n, path))[2] AS path FROM p)
  SELECT CASE WHEN l.path = w.path THEN regexp_replace(l.path, '/[^/]*$', '') ELSE l.path END AS path FROM longest l, word w)""")
def sentence_path(s, d):
    return xmltools.sentence_path(readers.xml_overview(xml_docs(s, d)))


@query("xml_to_rows", f"SELECT file_id, node_no, concat_ws(chr(9), max(value) FILTER (attr = 'text()'), max(value) FILTER (attr = 'pos'), coalesce('brand=' || max(value) FILTER (attr = 'brand'), '_')) AS line FROM {OVERVIEW} WHERE path = '/s/w' GROUP BY ALL")
def xml_to_rows(s, d):
    return xmltools.rows(readers.xml_overview(xml_docs(s, d)), "/s/w", ["text()", "pos"], ["brand"])


@query("rdf_export", """SELECT DISTINCT line FROM (SELECT unnest(['<' || url || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/ns/dcat#Dataset> .', '<' || url || '> <http://www.w3.org/ns/dcat#distribution> <' || url || '#' || sha256(file_id::VARCHAR) || '> .', '<' || url || '> <http://purl.org/dc/terms/language> "' || lang || '" .']) AS line FROM files WHERE status = 'ACCEPTED')""")
def rdf_export(s, d):
    return exports.ntriples(t.files(s, d))


@query("json_export", """SELECT url, to_json({'url': url, 'languages': list(DISTINCT lang ORDER BY lang), 'files': list({'file_id': file_id, 'format': format, 'status': status, 'type': type, 'lang': lang} ORDER BY file_id)})::VARCHAR AS json FROM files GROUP BY url""")
def json_export(s, d):
    return exports.nested_json(t.files(s, d))


@query("aggregated_languages", "SELECT url, list(DISTINCT lang ORDER BY lang) AS languages, count(*) AS files FROM files GROUP BY url")
def aggregated_languages(s, d):
    return t.files(s, d).groupBy("url").agg(F.sort_array(F.collect_set("lang")).alias("languages"), F.count("*").alias("files"))


@query("library_records", "SELECT url, '<record><identifier>' || url || '</identifier><languages>' || string_agg(DISTINCT lang, ' ' ORDER BY lang) || '</languages><files>' || count(*) || '</files></record>' AS record FROM files GROUP BY url")
def library_records(s, d):
    return exports.records(t.files(s, d))


BUZZ = "(VALUES " + ", ".join(f"('{w}', {n})" for w, n in observations.BUZZ_WORDS.items()) + ")"


@query("buzz_words", f"SELECT page_id, coalesce(sum(n), 0)::BIGINT AS score FROM pages LEFT JOIN {BUZZ} b(word, n) ON contains(html, word) GROUP BY page_id")
def buzz_words(s, d):
    return t.table(s, d, "pages").select("page_id", observations.buzz_score(F.col("html")).alias("score"))


@query("scalar_functions", "SELECT p_partkey, hex(p_name) AS hexed, sha256(p_name) AS sha, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS na, trunc(p_retailprice * 100) / 100 AS shortened, replace(replace(p_name, '#', ''), ' ', '_') AS plain FROM part")
def scalar_functions(s, d):
    c = F.col("p_retailprice") * 100
    return t.table(s, d, "part").select("p_partkey", F.hex("p_name").alias("hexed"), F.sha2("p_name", 256).alias("sha"), F.expr("nullif(p_type, 'PROMO')").alias("na"), (F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)) / 100).alias("shortened"), F.replace(F.translate("p_name", "#", ""), F.lit(" "), F.lit("_")).alias("plain"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(s, d):
    from lexispark.streaming import queue

    return queue.windowed(t.table(s, d, "events")).select("start", "event_type", "n")


@query("queue_dedupe", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def queue_dedupe(s, d):
    from lexispark.streaming import queue

    return queue.first_requests(t.table(s, d, "events"))


@query("queue_states", "SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count_if(event_type = 'error')::BIGINT AS errors FROM events GROUP BY user_id")
def queue_states(s, d):
    from lexispark.streaming import queue

    return queue.states(t.table(s, d, "events"))
