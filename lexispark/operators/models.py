"""Annotation models: dictionaries and class graphs as tables, their update, and re-matching of what was unmatched.

node(node_id, kind, model, file, class, tag, labels), edge(src, dst, relation, model, file), match(hit_id, node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators import matching

#: List nodes, which are never one and the same.
NEVER_MERGED = ["http://www.w3.org/1999/02/22-rdf-syntax-ns#nil", "http://www.w3.org/1999/02/22-rdf-syntax-ns#first"]
MOST_LABELS = 3


def dictionary(tags: DataFrame, classes: DataFrame) -> DataFrame:
    """(kind, value): the different tags of tags(tag), and of classes(class) those that are addresses."""
    own = tags.select(F.lit("tag").alias("kind"), F.col("tag").alias("value"))
    urls = classes.where(F.col("class").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/\\s]+")).select(F.lit("class").alias("kind"), F.col("class").alias("value"))
    return own.union(urls).where("value <> ''").distinct()


def nodes(definitions: DataFrame) -> DataFrame:
    """(node_id, name, type, model, labels) of definitions(name, type, model, label): one node per name#type with its first labels in
    order, made up to MOST_LABELS; list nodes keep one node per row."""
    kept_apart = F.col("name").isin(NEVER_MERGED)
    key = F.concat_ws("#", "name", "type", F.when(kept_apart, F.coalesce("label", F.lit(""))))
    per = definitions.withColumn("node_id", key).groupBy("node_id", "name", "type").agg(F.min("model").alias("model"), F.sort_array(F.collect_set("label")).alias("all"))
    padded = F.slice(F.concat("all", F.array_repeat(F.lit(""), MOST_LABELS)), 1, MOST_LABELS)
    return per.select("node_id", "name", "type", "model", padded.alias("labels"))


def edges(rows: DataFrame) -> DataFrame:
    """Edges, each once by both ends, relation, model and file."""
    return rows.select("src", "dst", "relation", "model", "file").distinct()


def without_model(node: DataFrame, edge: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of a model, and without edges that would hang in the air."""
    left = node.where(F.col("model") != model)
    ends = left.select("node_id")
    kept = edge.where(F.col("model") != model).join(ends.select(F.col("node_id").alias("src")), "src", "left_semi").join(ends.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return left, kept.select(*edge.columns)


def reset(node: DataFrame, match: DataFrame) -> DataFrame:
    """Nodes that a hit points at; all others of the model graph go before it is read anew."""
    return node.join(match.select("node_id").distinct(), "node_id", "left_semi")


def counts(node: DataFrame) -> DataFrame:
    """(model, file, nodes, max_id) of node(node_id, model, file)."""
    return node.groupBy("model", "file").agg(F.count("*").alias("nodes"), F.max("node_id").alias("max_id"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Models with a file whose content has changed, or that is new or gone. old and new(model, file, hash)."""
    both = old.select("model", "file", F.col("hash").alias("o")).join(new.select("model", "file", F.col("hash").alias("n")), ["model", "file"], "full_outer")
    return both.where("NOT (o <=> n)").select("model").distinct()


def update_actions(saved: DataFrame, given: DataFrame) -> DataFrame:
    """(id, action) of two lists of model definitions(id, name, files): save new ones, update where files differ, edit where only the
    name does, none; an id that is given twice is an error."""
    g = given.groupBy("id").agg(F.count("*").alias("times"), F.first("name").alias("name"), F.first("files").alias("files"))
    k = saved.select("id", F.col("name").alias("old_name"), F.col("files").alias("old_files"))
    action = F.when(F.col("times") > 1, "error").when(F.col("old_name").isNull(), "save").when(~F.col("files").eqNullSafe(F.col("old_files")), "update").when(~F.col("name").eqNullSafe(F.col("old_name")), "edit").otherwise("none")
    return g.join(k, "id", "left").select("id", action.alias("action"))


def class_matches(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """(file_id, token, cnt, model, class) of addresses among a file's objects that name classes(model, class). A class stands as a
    pattern in which a dot is any character; addresses are joined on their plain ends, so it costs what an equi join does."""
    tags = classes.select("model", "class", F.col("class").alias("tag"), F.lit(True).alias("is_regex"), F.lit("").alias("lang"))
    return matching.regex_matches(objects, tags).select(*objects.columns, "model", "class")


def rematched(hit: DataFrame, found: DataFrame, tags: DataFrame) -> DataFrame:
    """Matches of a new dictionary with the tokens that have had none so far."""
    rest = hit.join(found.select("file_id", "token").distinct(), ["file_id", "token"], "left_anti").select(*hit.columns)
    return matching.matches(rest, tags)


def updated(hit: DataFrame, found: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Matches after a dictionary has changed: those of nodes that are gone go, tokens left without any are matched with the new one,
    and new nodes meet all tokens. What stays is not matched again."""
    node = ["model", "class", "tag"]
    stay = found.join(new.select(*node).distinct(), node, "left_semi").select(*found.columns)
    added = new.join(old.select(*node).distinct(), node, "left_anti")
    again = matching.matches(hit, added).select(*found.columns)
    return stay.union(again).distinct()


def changed_matches(hit: DataFrame, found: DataFrame, old: DataFrame, new: DataFrame, file_language: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dropped, added) matches when a dictionary becomes another: those of nodes that are gone, and those of nodes that are new."""
    node = ["model", "class", "tag", "is_regex", "lang"]
    gone = old.join(new, node, "left_anti").select("model", "class", "tag", "lang", F.when(F.col("is_regex"), "pattern").otherwise("tag").alias("kind"))
    fresh = new.join(old, node, "left_anti").select(*new.columns)
    return found.join(gone, gone.columns, "left_semi").select(*found.columns), matching.matches(hit, fresh, file_language).select(*found.columns)


def tags_of_models(found: DataFrame, files: DataFrame) -> DataFrame:
    """(url, model, class, tag, token, cnt): the nodes of each model that a resource's files reach, once each, with the most frequent
    token (of equal ones the least)."""
    hit = found.join(files.select("file_id", "url"), "file_id")
    best = F.min_by(F.struct("token", "cnt"), F.struct((-F.col("cnt")).alias("n"), "token"))
    return hit.groupBy("url", "model", "class", "tag").agg(best.alias("b")).select("url", "model", "class", "tag", "b.token", "b.cnt")


def class_descriptions(paths: DataFrame, comments: DataFrame) -> DataFrame:
    """(class, top, comment): what stands last on a class's path, with its remark."""
    top = paths.select(F.col("src").alias("class"), F.element_at("path", -1).alias("top"))
    return top.join(comments.select(F.col("class").alias("top"), "comment"), "top", "left").select("class", "top", "comment").distinct()


def terms(triples: DataFrame, namespaces: list[str], without: list[str]) -> DataFrame:
    """The statements of a term model: subjects that begin with one of the namespaces, without predicates that match a pattern."""
    keep = F.lit(False)
    for n in namespaces:
        keep = keep | F.col("s").startswith(n)
    for pattern in without:
        keep = keep & ~F.col("p").rlike(f"^(?:{pattern})$")
    return triples.where(keep)
