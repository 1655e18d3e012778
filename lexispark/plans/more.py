"""Queries on language properties, pools of sentences, bulk edits, second passes and whole exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import exports, graph, lifecycle, observations, roles, search, xmltools
from lexispark.plans import derived as t
from lexispark.plans.derived import SQL
from lexispark.plans.durable import written
from lexispark.plans.records import OVERVIEW, xml_docs
from lexispark.plans.structure import CELLS, SENT, _numbered, _top, cell
from lexispark.plans.text_models import _found
from lexispark.sources import readers

Q: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = (f, sql and SQL + CELLS + sql)
        return f

    return put


@query("language_properties", "SELECT lang AS o_lang, CASE doc_id % 3 WHEN 0 THEN 'http://purl.org/dc/terms/language' ELSE 'http://x.example/iso639-3' END AS p, count(*) AS n, 1.0::DOUBLE AS avg_prob, 'LANGPROP' AS source FROM documents WHERE doc_id % 3 < 2 GROUP BY ALL")
def language_properties(s, d):
    p = F.element_at(F.array(*[F.lit(x) for x in ("http://purl.org/dc/terms/language", "http://x.example/iso639-3", "http://x.example/title")]), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = t.table(s, d, "documents").select(p.alias("p"), F.col("lang").alias("o"))
    found = rows.where(observations.is_language_predicate(F.col("p"))).groupBy(F.col("o").alias("o_lang"), "p").agg(F.count("*").alias("n"))
    return found.select("*", F.lit(1.0).alias("avg_prob"), F.lit("LANGPROP").alias("source"))


@query("pattern_part_counts", "SELECT file_id, col, token, count(*) AS cnt FROM (SELECT file_id, col, unnest(regexp_split_to_array(value, '[-=.|:]')) AS token FROM cell WHERE col IN (2, 4)) WHERE token <> '' GROUP BY ALL")
def pattern_part_counts(s, d):
    return roles.pattern_parts(cell(s, d).where("col IN (2, 4)"), ["-", "=", "."])


@query("sentence_pools", f"""SELECT * FROM (WITH RECURSIVE z AS (SELECT file_id, sent_no, count(*)::INTEGER AS n, row_number() OVER (PARTITION BY file_id ORDER BY sent_no) AS k FROM ({SENT}) GROUP BY file_id, sent_no),
  p AS (SELECT file_id, sent_no, k, 0 AS pool, n AS held FROM z WHERE k = 1
    UNION ALL SELECT z.file_id, z.sent_no, z.k, CASE WHEN held >= 4 THEN pool + 1 ELSE pool END, CASE WHEN held >= 4 THEN z.n ELSE held + z.n END FROM p JOIN z ON z.file_id = p.file_id AND z.k = p.k + 1)
  SELECT file_id, sent_no, pool FROM p)""")
def sentence_pools(s, d):
    return roles.sentence_pools(_numbered(s, d), 4)


@query("xml_complete_nodes", f"SELECT file_id, node_no, path, attr, value FROM {OVERVIEW} WHERE node_no <> 2")
def xml_complete_nodes(s, d):
    return xmltools.complete_nodes(written(readers.xml_overview(xml_docs(s, d))))


@query("bulk_actions", """SELECT file_id, CASE WHEN starts_with(url, 'http://r.example/1') THEN 'ACCEPTED' WHEN starts_with(url, 'http://r.example/2') THEN 'DISABLED' WHEN starts_with(url, 'http://r.example/3') THEN 'QUEUED' ELSE status END AS status FROM files
  WHERE NOT (starts_with(url, 'http://r.example/4') OR starts_with(url, 'http://r.example/2') AND NOT starts_with(url, 'http://r.example/2'))""")
def bulk_actions(s, d):
    r = "http://r.example/"
    return lifecycle.bulk(t.files(s, d), [(r + "1", "accept"), (r + "2", "disable"), (r + "3", "rescan"), (r + "4", "delete")]).select("file_id", "status")


OLD = "(SELECT l_orderkey AS file_id, l_returnflag AS model, min(l_linenumber) AS col, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL)"
NEW = "(SELECT l_orderkey AS file_id, l_returnflag AS model, min(l_linenumber) + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS col, sum(l_quantity)::BIGINT + CASE WHEN l_orderkey % 6 = 0 THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey, l_returnflag)"


@query("reconcile_twice", f"""SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.model, o.model) AS model, coalesce(n.col, o.col) AS col, coalesce(n.v, o.v) AS v,
    CASE WHEN o.file_id IS NULL THEN 'added' WHEN n.file_id IS NULL THEN 'dropped' WHEN n.col <> o.col THEN 'moved' WHEN n.v <> o.v THEN 'changed' ELSE 'same' END AS state FROM {OLD} o FULL JOIN {NEW} n ON o.file_id = n.file_id AND o.model = n.model""")
def reconcile_twice(s, d):
    k = F.col("file_id")
    rows = t.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("model")).agg(F.min("l_linenumber").alias("col"), F.sum("l_quantity").cast("long").alias("v"))
    new = rows.where("file_id % 7 <> 0").select("file_id", "model", (F.col("col") + F.when(k % 4 == 0, 1).otherwise(0)).alias("col"), (F.col("v") + F.when(k % 6 == 0, 1).otherwise(0)).alias("v"))
    return lifecycle.reconciled_twice(rows, new, ["file_id", "model", "col"], ["file_id", "model"], "v")


@query("catalogue_export", """SELECT line FROM (SELECT url, '<' || url || '> ' AS s, '<' || url || '#' || sha256(file_id::VARCHAR) || '>' AS node, file_id, lang, format, n_chars, source FROM files WHERE status = 'ACCEPTED') f, LATERAL (SELECT unnest([
    s || '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/ns/dcat#Dataset> .', s || '<http://purl.org/dc/terms/title> "' || (SELECT max(source) FROM files g WHERE g.url = f.url AND g.status = 'ACCEPTED') || '" .',
    s || '<http://purl.org/dc/terms/extent> "' || (SELECT count(*) FROM files g WHERE g.url = f.url AND g.status = 'ACCEPTED') || '" .', s || '<http://www.w3.org/ns/dcat#distribution> ' || node || ' .', node || ' <http://purl.org/dc/terms/format> "' || format || '" .',
    node || ' <http://www.w3.org/ns/dcat#byteSize> "' || n_chars || '" .', node || ' <http://purl.org/dc/terms/language> <http://lexvo.org/id/iso639-3/' || nullif(lang, '') || '> .']) AS line) WHERE line IS NOT NULL GROUP BY line
  UNION SELECT '<' || url || '#' || sha256(file_id::VARCHAR) || '> <http://purl.org/dc/terms/conformsTo> "' || model || '" .' FROM files JOIN found USING (file_id) WHERE status = 'ACCEPTED'
  UNION SELECT '<' || url || '#' || sha256(file_id::VARCHAR) || '> <http://purl.org/dc/terms/subject> "' || c.dst || '" .' FROM files JOIN found USING (file_id) JOIN closure c ON class = src WHERE status = 'ACCEPTED' AND c.dst IN ('Word', 'ContentWord', 'FunctionWord') AND src <> dst""")
def catalogue_export(s, d):
    found = _found(s, d)[1].select("file_id", "model", "class").distinct()
    mapped = graph.concepts(t.tag_dict(s), graph.closure(t.class_edge(s, d)), _top(s)).select("class", "concept").distinct()
    return exports.catalogue(t.files(s, d), found.select("file_id", "model").distinct(), found.join(mapped, "class").select("file_id", "concept").distinct())


@query("mods_records", """SELECT s_suppkey AS id, '<mods><title>' || s_name || '</title>' || CASE WHEN s_suppkey % 2 = 0 THEN '<place>' || n_name || ' &amp; co</place>' ELSE '' END || '<identifier>' || s_suppkey || '</identifier>' || '<subject>a&lt;b</subject><subject>' || s_nationkey || '</subject></mods>' AS record
  FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def mods_records(s, d):
    rows = t.table(s, d, "supplier").join(t.table(s, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 2 == 0, F.concat("n_name", F.lit(" & co"))).alias("place"), F.lit(None).cast("string").alias("note"), F.array(F.lit("a<b"), F.col("s_nationkey").cast("string")).alias("subjects")
    )
    return exports.xml_records(rows, "id", "mods", {"title": "title", "place": "place", "note": "note", "identifier": "id", "subject": "subjects"})


@query("search_values_checked", "SELECT token AS value, token IN (SELECT tag FROM tag_dict) AS known FROM (SELECT DISTINCT token FROM token_count WHERE length(token) <= 4)")
def search_values_checked(s, d):
    return search.checked(t.token_count(s, d).where("length(token) <= 4").select(F.col("token").alias("value")), t.tag_dict(s).select(F.col("tag").alias("value")))


@query("labelled_paths", "SELECT DISTINCT src, dst, array_to_string(list_transform(path, lambda x: CASE WHEN starts_with(x, '#') THEN '(any)' WHEN x LIKE '%Word' THEN 'class:' || x ELSE 'tag:' || x END), ' > ') AS label FROM closure WHERE src <> dst")
def labelled_paths(s, d):
    """Paths as texts, each node by its kind."""
    kind = lambda x: F.when(x.startswith("#"), "(any)").when(x.endswith("Word"), F.concat(F.lit("class:"), x)).otherwise(F.concat(F.lit("tag:"), x))
    return graph.paths(t.class_edge(s, d)).select("src", "dst", F.array_join(F.transform("path", kind), " > ").alias("label"))
