"""The queries opN_<name> and pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import balls, decontaminate, html, licenses, lines, matroska, mixing, near, phrases, pii, quality, suffix, urls
from lexispark.llm.common import table


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k
), h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.k = iw.k),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, LATERAL (SELECT unnest(range(i, i + k)) AS j) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP2_SQL = """
WITH s AS (
  SELECT source, sum(length(text))::BIGINT AS chars, CASE source WHEN 'src0' THEN 0.2::DOUBLE WHEN 'src1' THEN 0.1::DOUBLE WHEN 'src2' THEN 0.08::DOUBLE END AS target
  FROM documents GROUP BY source
), t AS (SELECT sum(chars)::DOUBLE AS all_chars, sum(chars) FILTER (target IS NULL)::DOUBLE AS other_chars, coalesce(sum(target), 0) AS named FROM s WHERE chars > 0),
r AS (
  SELECT source, CASE WHEN target IS NOT NULL THEN target / CASE WHEN other_chars IS NULL OR named > 1 THEN named ELSE 1 END
    ELSE greatest(0, 1 - named) * chars / other_chars END * all_chars / chars AS rate
  FROM s, t WHERE chars > 0
), c AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k) WHERE rate > 0
), l AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
n AS (
  SELECT doc_id, documents.source, text, (SELECT count(*) FROM (SELECT unnest(l.cdf) AS x) WHERE x <= ('0x' || substr(md5('mix:17:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0) AS times
  FROM documents JOIN l USING (source)
)
SELECT doc_id, source, text, copy::INTEGER AS copy, md5('shuffle:17:' || doc_id || ':' || copy) AS mix_key
FROM n, LATERAL (SELECT unnest(range(1, times + 1)) AS copy)
"""


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(b[i:i + 199]) AS s FROM d, LATERAL (SELECT unnest(range(1, n - 198)) AS i) WHERE n >= 200),
h AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM h),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 199 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
e AS (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, n + 1, n FROM d),
k AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a, z), 0) + 1 AS first, a - 1 AS last FROM e),
t AS (SELECT doc_id, string_agg(hex(b[first:last]), '' ORDER BY first) AS kept FROM k JOIN d USING (doc_id) WHERE last >= first GROUP BY doc_id),
c AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.near_dedup(docs, words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(30) ORDER BY g)) AS h FROM s GROUP BY doc_id),
m AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h, n) AS rep FROM n),
r AS (SELECT s.doc_id, g, n FROM s JOIN m USING (doc_id) WHERE doc_id = rep),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
reach(x, y) AS (SELECT DISTINCT x, x FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, rep, d.doc_id) AS component_id, d.doc_id = coalesce(component, rep, d.doc_id) AS kept
FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN c ON c.x = rep
"""


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its findings in order, joined, and how many there are."""
    return licenses.findings(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"]))), ",").alias("licenses"),
        "findings",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, g.i - 1 AS line, list_filter(regexp_split_to_array(lower(string_split(text, chr(10))[g.i]), '[ \\t\\r\\f\\x0B]+'), lambda x: x <> '') AS w
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) g
  WHERE text <> ''
), m AS (SELECT *, len(w) AS n FROM l WHERE len(w) >= 1),
u AS (SELECT w, n, min((doc_id, line)) AS first FROM m GROUP BY w, n),
k AS (
  SELECT w, n, first, unnest([(n, 'f', w[1:n // 2]), (n, 'l', w[n // 2 + 1:n]), (n + 1, 'f', w[1:(n + 1) // 2]), (n + 1, 'l', w[(n + 1) // 2:n])]) AS key
  FROM u WHERE n >= 8
), p AS (SELECT DISTINCT a.w AS w, b.w AS v, a.first, b.first AS earlier FROM k a JOIN k b USING (key) WHERE b.first < a.first AND abs(a.n - b.n) <= 1),
d AS (
  SELECT w, bool_or(
    CASE WHEN len(w) = len(v) THEN len(list_filter(range(1, len(w) + 1), lambda i: w[i] <> v[i])) <= 1
         WHEN len(w) > len(v) THEN len(list_filter(range(1, len(w) + 1), lambda i: list_concat(w[1:i - 1], w[i + 1:len(w)]) = v)) > 0
         ELSE len(list_filter(range(1, len(v) + 1), lambda i: list_concat(v[1:i - 1], v[i + 1:len(v)]) = w)) > 0 END) AS gone
  FROM p GROUP BY w
), o AS (
  SELECT m.doc_id, m.line FROM m JOIN u USING (w) LEFT JOIN d USING (w) WHERE (m.doc_id, m.line) <> u.first OR coalesce(d.gone, false)
), x AS (SELECT doc_id, list(line) AS gone FROM o GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN x.gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(x.gone, i - 1)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text,
  CASE WHEN text <> '' THEN len(string_split(text, chr(10))) ELSE 0 END::BIGINT AS n_lines, coalesce(len(x.gone), 0)::BIGINT AS n_dropped
FROM documents LEFT JOIN x USING (doc_id)
"""


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.store(table(spark, sf_dir, "documents")))


#: The tables here are synthetic; on others the session's setting has the key.
SYNTHETIC_KEY = "synthetic tables only"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(pii.KEY_SETTING, SYNTHETIC_KEY)
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.digests(balls.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def _op11_sql(k: int = balls.CLUSTERS, rounds: int = balls.ROUNDS) -> str:
    """Lloyd's rounds, each a pair of common table expressions: a(i) assigns, c(i) has the centroids."""
    step = """, a{0} AS MATERIALIZED (SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM
  (SELECT vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{0}) GROUP BY vec_id, v)"""
    moved = """, c{1} AS MATERIALIZED (SELECT c{0}.j, coalesce(m.c, c{0}.c) AS c FROM c{0} LEFT JOIN
  (SELECT j, list(x ORDER BY i) AS c FROM (SELECT j, i, ((sum(v[i]::HUGEINT) - (sum(v[i]::HUGEINT) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{0}, range(1, 65) g(i) GROUP BY j, i) GROUP BY j) m USING (j))"""
    out = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, v AS c FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {k})"""
    for i in range(rounds):
        out += step.format(i) + moved.format(i, i + 1)
    return out + step.format(rounds) + f"""
SELECT vec_id, a{rounds}.j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{rounds}.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = a{rounds}.j"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p WHERE piece <> ''),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM w), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, g, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100 OR k = 1),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(g, ' ') AS w FROM f WHERE k >= 2),
t AS MATERIALIZED (SELECT lang, k, g, a, cut, array_to_string(w[1:cut], ' ') AS lg, array_to_string(w[cut + 1:k], ' ') AS rg FROM (SELECT *, unnest([1, 2, 3, 4]) AS cut FROM c) WHERE cut < k),
x AS (SELECT t.lang, t.k, t.g, t.a, n.n, cut, l.a AS l, r.a AS r, 1000 * t.a * n.n // (l.a * r.a) AS score
  FROM t JOIN n ON n.lang = t.lang JOIN f l ON l.lang = t.lang AND l.g = t.lg JOIN f r ON r.lang = t.lang AND r.g = t.rg),
m AS (SELECT lang, k, g, a, n, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM x GROUP BY lang, k, g, a, n),
inside AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS g, max(a) AS a FROM (SELECT *, unnest([2, 3, 4]) AS j FROM c), LATERAL (SELECT unnest(range(1, k - j + 2)) AS i) WHERE j < k GROUP BY 1, 2),
s AS (SELECT m.lang, m.g AS phrase, m.a, l, r, n, score FROM m LEFT JOIN inside i ON i.lang = m.lang AND i.g = m.g WHERE i.a IS NULL OR 100 * i.a < 100 * m.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM s) WHERE rank <= 2000
"""


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule, verdict, rhost, rpath) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
  ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/'))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(r.verdict, length(rule)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_decontaminate": op1_decontaminate,
        "op2_mix": op2_mix,
        "op3_main_text": op3_main_text,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_licenses": op6_licenses,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality": op8_quality,
        "op9_matroska": op9_matroska,
        "op10_pii": op10_pii,
        "op11_ball_kmeans": op11_ball_kmeans,
        "op12_collocations": op12_collocations,
        "op13_url_rules": op13_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1_SQL,
        "op2_mix": OP2_SQL,
        "op4_suffix_dedup": OP4_SQL,
        "op5_near_dedup": OP5_SQL,
        "op7_line_dedup": OP7_SQL,
        "op11_ball_kmeans": _op11_sql(),
        "op12_collocations": OP12_SQL,
        "op13_url_rules": OP13_SQL,
    }
