"""Whole files: what their columns, predicates or attributes hold, matched with dictionaries, scored and put together as results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators import matching, observations, roles, scoring
from lexispark.plans.durable import written

UNKNOWN = "UNKNOWN"


def file_results(hit: DataFrame, found: DataFrame, chosen: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, model, kind, token, tag, class, cnt): for each chosen model (selected or not trivial) a row per node with its most
    frequent token, a row of all tokens of the file without any match, and UNKNOWN for files without models.

    chosen(file_id, model, coverage, trivial, source, selected)."""
    keep = ~(F.col("trivial") & (F.col("coverage") < scoring.COVERAGE) & (F.col("source") != "SELECTION")) & F.col("selected")
    models = chosen.where(keep).select("file_id", "model").distinct()
    best = F.min_by(F.struct("token", "cnt"), F.struct((-F.col("cnt")).alias("n"), "token"))
    rows = found.join(models, ["file_id", "model"]).groupBy("file_id", "model", "class", "tag").agg(best.alias("b"))
    rows = rows.select("file_id", "model", F.lit("match").alias("kind"), "b.token", "tag", "class", "b.cnt")
    without = matching.unmatched(hit, found).join(models.select("file_id").distinct(), "file_id", "left_semi")
    rest = without.select("file_id", F.lit("").alias("model"), F.lit("unmatched").alias("kind"), F.array_join("tokens", " ").alias("token"), F.lit("").alias("tag"), F.lit("").alias("class"), "cnt")
    none = files.select("file_id").distinct().join(models.select("file_id"), "file_id", "left_anti")
    return rows.union(rest).union(none.select("file_id", F.lit(UNKNOWN), F.lit("unknown"), F.lit(""), F.lit(""), F.lit(""), F.lit(0).cast("long")))


def column_roles(cell: DataFrame, rows: DataFrame, tag: DataFrame, most: int = 100) -> DataFrame:
    """(file_id, col, role): index, feature, pattern, pos, text or free, the first that fits; judged by the first `most` rows, but for
    text, which all rows decide."""
    some = roles.first_rows(cell, most)
    # a column's different values, many times fewer than its rows, are counted once and written
    early = F.col("row_no") < most if most >= 0 else F.lit(True)
    values = written(cell.groupBy("file_id", "col", "value").agg(F.count_if(early).alias("cnt")))
    first = values.where("cnt > 0")
    tests = [
        ("index", roles.word_index_column(some)),
        ("feature", roles.feature_columns(first)),
        ("pattern", roles.pattern_columns(some).select("file_id", "col")),
        ("pos", roles.pos_values(first, tag)),
        ("text", roles.text_columns(values, rows)),
    ]
    votes = values.select("file_id", "col", F.lit(len(tests)).alias("n")).distinct()
    for n, (_, found) in enumerate(tests):
        votes = votes.union(found.select("file_id", "col", F.lit(n)).distinct())
    first = votes.groupBy("file_id", "col").agg(F.min("n").alias("n"))
    return first.select("file_id", "col", F.element_at(F.array(*[F.lit(name) for name, _ in tests], F.lit("free")), F.col("n") + 1).alias("role"))


def free_columns(roles_: DataFrame, models: DataFrame) -> DataFrame:
    """(file_id, free, disabled): columns that are neither text nor have a model, and those without a selected model.
    models(file_id, col, selected)."""
    per = models.groupBy("file_id", "col").agg(F.bool_or("selected").alias("selected"))
    both = roles_.join(per, ["file_id", "col"], "left")
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("col"))))
    return both.groupBy("file_id").agg(pick((F.col("role") != "text") & F.col("selected").isNull()).alias("free"), pick(~F.coalesce("selected", F.lit(False))).alias("disabled"))


def column_hits(cell: DataFrame, roles_: DataFrame) -> DataFrame:
    """(file_id, col, kind, name, value, cnt): what a tabular file's columns hold for matching: tokens of tag columns (t), features
    (f) and the parts of pattern columns (x)."""
    role = cell.join(roles_, ["file_id", "col"])
    tokens = roles.column_tokens(role.where("role = 'pos'")).select("file_id", "col", F.lit("t").alias("kind"), F.lit("").alias("name"), F.col("token").alias("value"), "cnt")
    part = F.explode(F.transform(F.split("value", "[|]", -1), lambda x: F.split(x, "=", -1)))
    feats = role.where("role = 'feature' AND value <> '_'").select("file_id", "col", part.alias("p")).where("size(p) >= 2 AND p[1] <> ''")
    feats = feats.select("file_id", "col", F.lit("f").alias("kind"), F.col("p")[0].alias("name"), F.col("p")[1].alias("value")).where(~F.col("name").isin(roles.IGNORED) & ~F.col("name").startswith("MWE"))
    parts = role.where("role = 'pattern'").select("file_id", "col", F.lit("x").alias("kind"), F.lit("").alias("name"), F.explode(F.split("value", "[+|:,.-]", -1)).alias("value")).where("value <> ''")
    counted = feats.union(parts).groupBy("file_id", "col", "kind", "name", "value").agg(F.count("*").alias("cnt"))
    return tokens.union(counted)


def scored_units(values: DataFrame, unit: str, tag: DataFrame) -> DataFrame:
    """(file_id, unit, model, different_hit_types, hit_count_total, coverage, trivial) of values(file_id, unit, token, cnt): the
    scores of models per column, predicate or attribute of a file."""
    key = F.struct("file_id", unit)
    hit = values.select(key.alias("file_id"), "token", "cnt")
    found = matching.matches(hit, tag)
    scored = scoring.scores(hit, found).join(scoring.tag_properties(found).select("file_id", "model", "trivial"), ["file_id", "model"])
    return scored.select("file_id.*", "model", "different_hit_types", "exclusive_hit_types", "hit_count_total", "exclusive_hit_count_total", "coverage", "trivial")


def conll(cell: DataFrame, roles_: DataFrame, tag: DataFrame, written: Callable[[DataFrame], DataFrame], coverage: float = scoring.COVERAGE) -> DataFrame:
    """(file_id, col, model, coverage): a tabular file's chain: tokens of its tag columns, their models' scores, the best of each."""
    values = written(column_hits(cell, roles_).where("kind = 't'").select("file_id", "col", F.col("value").alias("token"), "cnt"))
    rows = scored_units(values, "col", tag).withColumns({"method": F.lit("AUTO"), "selected": F.lit(True)})
    return scoring.best_per(rows, ["file_id", "col"], coverage).select("file_id", "col", "model", "coverage")


def rdf(triples: DataFrame, order: str, tag: DataFrame, written: Callable[[DataFrame], DataFrame], coverage: float = scoring.COVERAGE, most: int = 10) -> DataFrame:
    """(p, model, different_hit_types, coverage): an RDF file's chain: of a sample of `most` different objects per predicate those that
    the dictionary knows tell which predicates are read whole; their models are scored, and those of enough coverage stay."""
    ok = triples.where(observations.object_allowed(F.col("p"), F.col("o"), F.col("o_kind")))
    sample = observations.sampled_object_counts(ok, most, order)
    allowed = observations.allowed_predicates(sample, tag).where("allowed").select("p")
    values = written(ok.join(allowed, "p", "left_semi").groupBy("p", F.col("o").alias("token")).agg(F.count("*").alias("cnt")).withColumn("file_id", F.lit(0)))
    return scored_units(values, "p", tag).where((F.col("coverage") >= coverage) & ~F.col("trivial")).select("p", "model", "different_hit_types", "coverage")


def rdf_files(triples: DataFrame, order: str, tag: DataFrame, written: Callable[[DataFrame], DataFrame], coverage: float = scoring.COVERAGE, most: int = 10) -> DataFrame:
    """(file_id, p, model, coverage): rdf() for each file of triples(file_id, p, o, o_kind) by itself."""
    ok = triples.where(observations.object_allowed(F.col("p"), F.col("o"), F.col("o_kind"))).withColumn("p", F.struct("file_id", "p"))
    allowed = observations.allowed_predicates(observations.sampled_object_counts(ok, most, order), tag).where("allowed").select("p")
    values = written(ok.join(allowed, "p", "left_semi").groupBy("p", F.col("o").alias("token")).agg(F.count("*").alias("cnt")).withColumn("file_id", F.lit(0)))
    return scored_units(values, "p", tag).where((F.col("coverage") >= coverage) & ~F.col("trivial")).select("p.*", "model", "coverage")


def xml(overview: DataFrame, tag: DataFrame, written: Callable[[DataFrame], DataFrame], coverage: float = scoring.COVERAGE) -> DataFrame:
    """(path, attr, model, coverage): an XML file's chain: attributes whose values all occur once are dropped, the others' values are
    matched and scored, and each attribute keeps its best model of enough coverage."""
    counts = overview.where("attr <> ''").groupBy("path", "attr", F.col("value").alias("token")).agg(F.count("*").alias("cnt"))
    counts = written(counts)
    repeated = counts.where("cnt > 1").select("path", "attr").distinct()
    values = counts.join(repeated, ["path", "attr"], "left_semi").select(F.lit(0).alias("file_id"), F.struct("path", "attr").alias("unit"), "token", "cnt")
    rows = scored_units(values, "unit", tag).withColumns({"method": F.lit("AUTO"), "selected": F.lit(True)})
    return scoring.best_per(rows, ["unit"], coverage).select("unit.*", "model", "coverage")


def vocabulary(cell: DataFrame, sample_rows: int) -> DataFrame:
    """(file_id, col, sample_types, types, tsv): different values in the first rows and in all, and the sample as one line."""
    first = F.sort_array(F.collect_list(F.when(F.col("row_no") < sample_rows, F.struct("row_no", "value"))))
    return cell.groupBy("file_id", "col").agg(F.count_distinct(F.when(F.col("row_no") < sample_rows, F.col("value"))).alias("sample_types"), F.count_distinct("value").alias("types"), F.array_join(F.transform(first, lambda x: x["value"]), "\t").alias("tsv"))


def unit_tokens(values: DataFrame, unit: str) -> DataFrame:
    """(unit, tokens): how many different tokens each column, predicate or attribute has."""
    return values.groupBy(unit).agg(F.count_distinct("token").alias("tokens"))


def hits_of_columns(values: DataFrame) -> DataFrame:
    """(file_id, col, hits)."""
    return values.groupBy("file_id", "col").agg(F.count("*").alias("hits"))
