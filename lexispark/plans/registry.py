"""Queries on the registry: counters, listings, edits, ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.operators import registry
from lexispark.plans import derived as t
from lexispark.plans.derived import SQL

Q: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        Q[name] = (f, sql and SQL + sql)
        return f

    return put


@query("registry_counters", """SELECT 'done_files' AS counter, '' AS "key", count(*) AS n FROM files WHERE status IN ('PROCESSED', 'ACCEPTED') UNION ALL SELECT 'done_resources', '', count(DISTINCT url) FROM files WHERE status IN ('PROCESSED', 'ACCEPTED')
  UNION ALL SELECT 'users', c_mktsegment, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'owned_files', source, count(*) FROM files GROUP BY 2""")
def registry_counters(s, d):
    return registry.counters(t.files(s, d).withColumn("owner", F.col("source")), t.table(s, d, "customer").select(F.col("c_mktsegment").alias("type")))


RESULT = "CASE WHEN file_id % 17 = 0 THEN 'ERROR' WHEN file_id % 3 = 0 THEN 'NONE' ELSE 'SUCCESS' END"


def _results(s, d):
    n = F.col("file_id")
    return t.files(s, d).select("url", (F.col("status") != "CHECK").alias("done"), F.when(n % 17 == 0, "ERROR").when(n % 3 == 0, "NONE").otherwise("SUCCESS").alias("result"))


@query("resource_outcomes", f"SELECT url, bool_and(status <> 'CHECK') AS done, bool_or({RESULT} = 'SUCCESS') AS success, bool_or({RESULT} = 'ERROR') AS error, bool_and(status <> 'CHECK') AND NOT bool_or({RESULT} = 'SUCCESS') AS unsuccessful FROM files GROUP BY url")
def resource_outcomes(s, d):
    return registry.outcomes(_results(s, d))


@query("user_workspace", """SELECT coalesce(o."user", x."user") AS "user", coalesce(o.url, x.url) AS url, o.url IS NOT NULL AS owned, x.url IS NOT NULL AS selected FROM (SELECT DISTINCT source AS "user", url FROM files) o
  FULL JOIN (SELECT DISTINCT 'src' || (file_id % 3) AS "user", url FROM files WHERE file_id % 6 < 3) x ON o."user" = x."user" AND o.url = x.url""")
def user_workspace(s, d):
    f = t.files(s, d)
    return registry.workspace(f.select(F.col("source").alias("user"), "url"), f.where("file_id % 6 < 3").select(F.concat(F.lit("src"), (F.col("file_id") % 3).cast("string")).alias("user"), "url"))


@query("edit_permissions", "SELECT url, max(source) = 'src1' OR bool_or(file_id % 8 = 3) AS may_edit FROM files GROUP BY url")
def edit_permissions(s, d):
    f = t.files(s, d)
    return registry.permitted(f.groupBy("url").agg(F.max("source").alias("owner")), f.where("file_id % 8 = 3").select("url", F.lit("src1").alias("user")), "src1", ["root"])


@query("processing_start", "SELECT user_id AS url, min(ts) AS start, list(DISTINCT event_type ORDER BY event_type) AS states FROM events GROUP BY user_id")
def processing_start(s, d):
    return registry.starts(t.table(s, d, "events").select(F.col("user_id").alias("url"), F.col("ts").alias("start"), F.col("event_type").alias("state")))


@query("queue_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS position FROM events")
def queue_order(s, d):
    return registry.queue_positions(t.table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "position")


@query("queue_next", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def queue_next(s, d):
    return registry.queue_positions(t.table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).where("position = 1").select("user_id", "event_id")


WORK = "CASE WHEN file_id % 5 = 0 THEN 'ACTIVE' WHEN file_id % 5 = 1 THEN 'QUEUED' WHEN file_id % 17 = 0 THEN 'ERROR' ELSE status END"


@query("user_states", f"""SELECT source AS "user", count(DISTINCT url) FILTER ({WORK} = 'ACTIVE') AS active, count(DISTINCT url) FILTER ({WORK} = 'QUEUED') AS queued, count(DISTINCT url) FILTER ({WORK} = 'ERROR') AS errors FROM files GROUP BY source""")
def user_states(s, d):
    n = F.col("file_id")
    work = F.when(n % 5 == 0, "ACTIVE").when(n % 5 == 1, "QUEUED").when(n % 17 == 0, "ERROR").otherwise(F.col("status"))
    return registry.by_state(t.files(s, d).select(F.col("source").alias("user"), "url", work.alias("status")), "user")


@query("exportable", "SELECT url FROM files GROUP BY url HAVING bool_or(status = 'ACCEPTED') AND NOT bool_or(file_id % 19 = 0) AND NOT bool_or(file_id % 23 = 0)")
def exportable(s, d):
    f = t.files(s, d)
    per = f.groupBy("url").agg(F.bool_or(F.col("status") == "ACCEPTED").alias("accepted"), F.bool_or(F.col("file_id") % 19 == 0).alias("broken"))
    return registry.exportable(per, f.where("file_id % 23 = 0"))


@query("copied_metadata", """SELECT 's' || s_suppkey AS url, CASE WHEN s_nationkey = 3 THEN g.n ELSE s_name END AS title, CASE WHEN s_nationkey = 3 THEN g.a ELSE s_nationkey::VARCHAR END AS place
  FROM supplier, (SELECT s_name AS n, s_nationkey::VARCHAR AS a FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)) g""")
def copied_metadata(s, d):
    x = t.table(s, d, "supplier")
    first = x.agg(F.min("s_suppkey").alias("k"))
    rows = x.join(first).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("url"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("place"), (F.col("s_suppkey") == F.col("k")).alias("is_source"))
    out = registry.copied_metadata(rows, F.col("is_source"), F.col("place") == "3")
    return out.select("url", "title", "place")


@query("edited_models", """SELECT coalesce(r.file_id, e.file_id) AS file_id, coalesce(r.model, e.model) AS model, CASE WHEN e.action IS NOT NULL THEN 'MANUAL' ELSE 'AUTO' END AS method, CASE WHEN e.action IS NOT NULL THEN 'SELECTION' ELSE 'DETECTION' END AS source,
    CASE WHEN e.action IS NOT NULL THEN e.action = 'add' ELSE r.selected END AS selected
  FROM (SELECT file_id, format AS model, file_id % 4 = 0 AS selected FROM files) r FULL JOIN (SELECT file_id, 'RDF' AS model, CASE file_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'unset' ELSE 'delete' END AS action FROM files WHERE file_id % 2 = 0) e ON r.file_id = e.file_id AND r.model = e.model
  WHERE coalesce(e.action, '') <> 'delete' AND NOT (r.file_id IS NULL AND e.action = 'unset')""")
def edited_models(s, d):
    f, n = t.files(s, d), F.col("file_id")
    rows = f.select("file_id", F.col("format").alias("model"), F.lit("AUTO").alias("method"), F.lit("DETECTION").alias("source"), (n % 4 == 0).alias("selected"))
    edits = f.where("file_id % 2 = 0").select("file_id", F.lit("RDF").alias("model"), F.when(n % 3 == 0, "add").when(n % 3 == 1, "unset").otherwise("delete").alias("action"))
    return registry.edited(rows, edits, ["file_id", "model"])


@query("deselected_languages", """SELECT url, lang, selected AND NOT (wish AND bool_or(selected AND NOT wish) OVER (PARTITION BY url)) AS selected FROM
  (SELECT url, lang, bool_or(selected) AS selected, lang IN ('eng', 'deu') AS wish FROM resource_file GROUP BY url, lang)""")
def deselected_languages(s, d):
    rows = t.resource_file(s, d).groupBy("url", "lang").agg(F.bool_or("selected").alias("selected"))
    return registry.deselected(rows, rows.where("lang IN ('eng', 'deu')"), ["url"], "lang")


@query("registered", """SELECT n.url, n.hash, CASE WHEN k.hash IS NULL THEN 'insert' WHEN k.hash <> n.hash THEN 'reset' ELSE 'keep' END AS action FROM (SELECT s_suppkey AS url, md5(CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE '' END || s_name) AS hash FROM supplier) n
  LEFT JOIN (SELECT s_suppkey AS url, md5(s_name) AS hash FROM supplier WHERE s_suppkey % 3 <> 0) k USING (url)""")
def registered(s, d):
    x = t.table(s, d, "supplier").select(F.col("s_suppkey").alias("url"), "s_name")
    known = x.where("url % 3 <> 0").select("url", F.md5("s_name").alias("hash"))
    return registry.registered(known, x.select("url", F.md5(F.concat(F.when(F.col("url") % 5 == 0, "x").otherwise(""), "s_name")).alias("hash")))


@query("file_models", "SELECT l_orderkey AS file_id, l_returnflag AS model, l_linestatus AS col, max(l_quantity) AS coverage FROM lineitem GROUP BY ALL")
def file_models(s, d):
    return registry.one_per_key(t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("col"), F.col("l_quantity").alias("coverage")), ["file_id", "model", "col"], "coverage")


@query("latest_update", "SELECT user_id AS file_id, max(ts) AS latest, max(ts) > TIMESTAMP '2024-01-15 00:00:00' AS updated_after FROM events GROUP BY user_id")
def latest_update(s, d):
    return registry.latest(t.table(s, d, "events").select(F.col("user_id").alias("file_id"), F.col("ts").alias("updated")), "2024-01-15 00:00:00")


@query("predicate_dimension", f"SELECT p AS predicate, p = '{registry.DEFAULT_PREDICATE}' AS is_default, p IN ('click', 'none') AS disabled FROM (SELECT event_type AS p FROM events UNION SELECT unnest(['{registry.DEFAULT_PREDICATE}', 'click', 'none']))")
def predicate_dimension(s, d):
    return registry.predicate_dimension(t.table(s, d, "events").select(F.col("event_type").alias("predicate")), ["click", "none"])


@query("replaced_types", "SELECT url, type FROM files WHERE url NOT IN (SELECT url FROM files WHERE file_id % 9 = 0) UNION ALL SELECT DISTINCT url, 'EDITED' FROM files WHERE file_id % 9 = 0")
def replaced_types(s, d):
    f = t.files(s, d).select("url", "type", "file_id")
    return registry.replaced(f.select("url", "type"), f.where("file_id % 9 = 0").select("url", F.lit("EDITED").alias("type")), "url")


@query("file_attributes", "SELECT file_id, unnest(['status', 'format', 'n_chars']) AS attribute, unnest([status, format, n_chars::VARCHAR]) AS value FROM files")
def file_attributes(s, d):
    return registry.attributes(t.files(s, d), "file_id", ["status", "format", "n_chars"])


@query("written_attributes", "SELECT file_id, CASE WHEN file_id % 6 = 0 THEN 'DISABLED' ELSE status END AS status, CASE WHEN file_id % 10 = 0 THEN 7 ELSE n_chars END::BIGINT AS n_chars FROM files")
def written_attributes(s, d):
    f = t.files(s, d).select("file_id", "status", F.col("n_chars").cast("long").alias("n_chars"))
    changes = f.where("file_id % 6 = 0").select("file_id", F.lit("status").alias("attribute"), F.lit("DISABLED").alias("value")).union(f.where("file_id % 10 = 0").select("file_id", F.lit("n_chars"), F.lit("7")))
    return registry.written_attributes(f, changes, "file_id", ["status", "n_chars"])


@query("file_edges", "SELECT file_id, 'language' AS edge, lang AS target FROM files UNION SELECT file_id, 'model', model FROM found UNION SELECT file_id, 'vocabulary', source FROM files")
def file_edges(s, d):
    from lexispark.operators import matching

    f = t.files(s, d)
    models = matching.matches(t.token_count(s, d, t.tag_dict(s)), t.tag_dict(s), t.file_language(s, d)).select("file_id", F.lit("model").alias("edge"), F.col("model").alias("target")).distinct()
    return f.select("file_id", F.lit("language").alias("edge"), F.col("lang").alias("target")).union(models).union(f.select("file_id", F.lit("vocabulary"), "source"))


@query("comments", "SELECT conv_id AS url, count(*) AS n, max(turn) AS latest, arg_max(text, turn) AS latest_text FROM conversations WHERE NOT (turn % 3 = 1) GROUP BY conv_id")
def comments(s, d):
    c = t.table(s, d, "conversations").select(F.col("conv_id").alias("url"), F.col("turn").alias("id"), "text")
    return registry.comments(c, c.where("id % 3 = 1"))


HEADER = "'HTTP/1.1 ' || (200 + c_nationkey) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Content-Length: ' || c_custkey || chr(10) END || 'ETag: W/\"' || c_name || '\"'"


@query("http_headers", "SELECT c_custkey AS id, 200 + c_nationkey AS status, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END::BIGINT AS length, 'text/html' AS type, '' AS modified, c_name AS etag FROM customer")
def http_headers(s, d):
    c = t.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(HEADER.replace("chr(10)", "'\\n'")).alias("text"))
    return c.select("id", *[v.alias(k) for k, v in registry.header(F.col("text")).items()])


@query("flat_json", """SELECT '{"url":"' || url || '","file_id":' || file_id || ',"status":"' || status || '","lang":"' || lang || '"}' AS json FROM files""")
def flat_json(s, d):
    return registry.flat_json(t.files(s, d), ["url", "file_id", "status", "lang"])
