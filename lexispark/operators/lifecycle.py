"""States of resources and files, curation, reconciliation and registry writes; a registry table is rewritten, not edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVERAGE = 0.4


def approved(files: DataFrame) -> DataFrame:
    """(url, accepted, settled): any file accepted; no file waiting."""
    waiting = F.col("status").isin("PROCESSED", "CHECK", "EDITED")
    return files.groupBy("url").agg(F.bool_or(F.col("status") == "ACCEPTED").alias("accepted"), (~F.bool_or(waiting)).alias("settled"))


def parse_result(error: Column, models: Column, languages: Column) -> Column:
    return F.when(error != "", "ERROR").when((models == 0) & (languages == 0), "NONE").otherwise("SUCCESS")


def resource_type(flags: DataFrame) -> DataFrame:
    """(url, type): the first of CORPUS, LEXICON, ONTOLOGY that a file's flags say, else UNKNOWN."""
    per = flags.groupBy("url").agg(*[F.bool_or(c).alias(c) for c in ("corpus", "lexicon", "ontology")])
    return per.select("url", F.when(F.col("corpus"), "CORPUS").when(F.col("lexicon"), "LEXICON").when(F.col("ontology"), "ONTOLOGY").otherwise("UNKNOWN").alias("type"))


def metadata_state(fields: dict[str, Column]) -> Column:
    """EMPTY without any field, COMPLETE with all, SUFFICIENT with title and description (or title and date), else INCOMPLETE."""
    has = {k: F.coalesce(c, F.lit("")) != "" for k, c in fields.items()}
    count = sum((h.cast("int") for h in has.values()), F.lit(0))
    enough = has["title"] & (has["description"] | has["date"])
    return F.when(count == 0, "EMPTY").when(count == len(has), "COMPLETE").when(enough, "SUFFICIENT").otherwise("INCOMPLETE")


def verified(files: DataFrame, selected: DataFrame) -> DataFrame:
    """files with the state after checking: processed files of unknown type are disabled, processed corpora without a selected
    model of enough coverage are to be checked, others keep theirs."""
    good = selected.where(F.col("selected") & (F.col("coverage") >= COVERAGE)).select("file_id").distinct().withColumn("_ok", F.lit(True))
    state = F.when((F.col("status") == "PROCESSED") & (F.col("type") == "UNKNOWN"), "DISABLED").when((F.col("status") == "PROCESSED") & (F.col("type") == "CORPUS") & F.col("_ok").isNull(), "CHECK").otherwise(F.col("status"))
    return files.join(good, "file_id", "left").withColumn("status", state).drop("_ok")


def guarded(old: Column, new: Column) -> Column:
    """Accepted files don't fall back to processed."""
    return F.when((old == "ACCEPTED") & (new == "PROCESSED"), old).otherwise(new)


def update_state(found: DataFrame, known: DataFrame) -> DataFrame:
    """found(url, size, hash, ...) with state, against known of one row per url: Invalid (no size), Duplicate (the hash under another URL), NotInDB, Changed, NotChanged."""
    by_url = known.select("url", F.col("hash").alias("_hash"), F.col("size").alias("_size"))
    others = known.where("hash <> ''").groupBy("hash").agg(F.min("url").alias("_first"), F.max("url").alias("_last"))
    joined = found.join(by_url, "url", "left").join(others, "hash", "left")
    elsewhere = (F.col("_first") != F.col("url")) | (F.col("_last") != F.col("url"))
    state = F.when(F.coalesce("size", F.lit(0)) <= 0, "Invalid").when(elsewhere & F.col("_hash").isNull(), "Duplicate").when(F.col("_hash").isNull(), "NotInDB").when((F.col("_hash") != F.col("hash")) | (F.col("_size") != F.col("size")), "Changed").otherwise("NotChanged")
    return joined.select(*found.columns, state.alias("state"))


def same_hash(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, n, first, last) of values that several rows have; empty values never match. No pairs are made."""
    full = rows
    for k in keys:
        full = full.where(F.coalesce(F.col(k), F.lit("")) != "")
    return full.groupBy(*keys).agg(F.count_distinct(name).alias("n"), F.min(name).alias("first"), F.max(name).alias("last")).where("n > 1")


def reconciled(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison of two result tables by key: added, dropped, changed, same; values are the new ones, else the old."""
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_n"))
    both = o.join(n, keys, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "dropped").when(differs, "changed").otherwise("same")
    return both.select(*keys, *[F.coalesce(f"new_{v}", f"old_{v}").alias(v) for v in values], state.alias("state"))


def merged_languages(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, col, lang, method, n, selected, note): automatic old rows without a new one go, other old rows stay with the new
    numbers where there are some; new rows are added, deselected where their column has a selected manual row."""
    keys = ["file_id", "col", "lang"]
    both = old.select(*keys, "method", F.col("n").alias("_on"), "selected").join(new.select(*keys, F.col("n").alias("_nn")), keys, "full_outer")
    manual = old.where((F.col("method") == "MANUAL") & F.col("selected")).select("file_id", "col").distinct().withColumn("_m", F.lit(True))
    kept = both.where(~((F.col("method") == "AUTO") & F.col("_nn").isNull())).join(manual, ["file_id", "col"], "left")
    return kept.select(
        *keys, F.coalesce("method", F.lit("AUTO")).alias("method"), F.coalesce("_nn", "_on").alias("n"),
        F.when(F.col("method").isNull(), F.col("_m").isNull()).otherwise(F.col("selected")).alias("selected"),
        F.when(F.col("method").isNull(), "new").when(F.col("_nn").isNotNull() & (F.col("_nn") != F.col("_on")), "changed").otherwise("").alias("note"),
    )


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in: those of equal key are replaced; of rows of equal key among themselves the greatest counts."""
    rest = [c for c in table.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*table.columns)
    return table.join(one.select(*keys), keys, "left_anti").select(*table.columns).union(one)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys that go."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def with_new(dimension: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """A dimension's keys with those added that it lacks."""
    return dimension.select(key).union(values.select(key).distinct().join(dimension, key, "left_anti"))


def set_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, only_a, only_b, both): values on either side of each key, sorted."""
    rows = a.select(key, value).distinct().withColumn("a", F.lit(1)).join(b.select(key, value).distinct().withColumn("b", F.lit(1)), [key, value], "full_outer")
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col(value))))
    return rows.groupBy(key).agg(pick(F.col("b").isNull()).alias("only_a"), pick(F.col("a").isNull()).alias("only_b"), pick(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def propagated(source: DataFrame, target: DataFrame) -> DataFrame:
    """Edits of one file for others with the same columns: (file_id, col, value, state) for targets of equal column sets; values
    of the source are added or kept, others are removed."""
    columns = F.sort_array(F.collect_set("col"))
    wanted = source.agg(columns.alias("cols"))
    fits = target.groupBy("file_id").agg(columns.alias("cols")).join(wanted, "cols").select("file_id")
    mine = target.join(fits, "file_id", "left_semi").select("file_id", "col", "value").distinct()
    given = source.select("col", "value").distinct()
    known = mine.join(given.withColumn("_s", F.lit(True)), ["col", "value"], "left").select("file_id", "col", "value", F.when(F.col("_s"), "kept").otherwise("removed").alias("state"))
    # what a file lacks of the edit's values; only files that lack something are asked which
    had = known.where("state = 'kept'").groupBy("file_id").agg(F.count("*").alias("n"))
    lacking = fits.join(had, "file_id", "left").join(given.agg(F.count("*").alias("all"))).where("coalesce(n, 0) < all").select("file_id")
    every = lacking.join(source.agg(F.collect_set(F.struct("col", "value")).alias("edit"))).select("file_id", F.explode("edit").alias("e")).select("file_id", "e.col", "e.value")
    return known.union(every.join(mine, ["file_id", "col", "value"], "left_anti").select("file_id", "col", "value", F.lit("added").alias("state")))


def quota_state(files: DataFrame, size: int, resources: int, count: int) -> DataFrame:
    """(user, bytes, resources, files, allowed)."""
    per = files.groupBy("user").agg(F.sum("bytes").cast("long").alias("bytes"), F.count_distinct("url").alias("resources"), F.count("*").alias("files"))
    return per.withColumn("allowed", (F.col("bytes") <= size) & (F.col("resources") <= resources) & (F.col("files") <= count))


def next_id(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.coalesce(F.max(column) + 1, F.lit(1)).cast("long").alias("next_id"))


def best_language(rows: DataFrame) -> DataFrame:
    """(file_id, lang): of highest average probability, the first by code among equals."""
    w = Window.partitionBy("file_id").orderBy(F.col("avg_prob").desc(), "lang")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file_id", "lang")


def language_probabilities(detected: DataFrame) -> DataFrame:
    """(file_id, lang, n, min_prob, max_prob, avg_prob): the average is over all detections of the file."""
    total = detected.groupBy("file_id").agg(F.count("*").alias("total"))
    per = detected.groupBy("file_id", "lang").agg(F.count("*").alias("n"), F.min("prob").alias("min_prob"), F.max("prob").alias("max_prob"), F.sum("prob").alias("s"))
    return per.join(total, "file_id").select("file_id", "lang", "n", "min_prob", "max_prob", F.round(F.col("s") / F.col("total"), 9).alias("avg_prob"))


def reconciled_twice(old: DataFrame, new: DataFrame, keys: list[str], part: list[str], value: str) -> DataFrame:
    """(keys, value, state): as `reconciled`, and what the full key leaves unmatched is tried by part of it, where that is
    unambiguous on either side: such rows are moved, with the new value."""
    state = reconciled(old, new, keys, [value])
    gone, added = state.where("state = 'dropped'"), state.where("state = 'added'")
    once = lambda df: df.groupBy(*part).agg(F.count("*").alias("n"), F.first(value).alias("v")).where("n = 1").drop("n")
    moved = once(gone).select(*part).join(once(added), part)
    rest = state.join(moved.withColumn("m", F.lit(True)).drop("v"), part, "left")
    kept = rest.where("NOT (coalesce(m, false) AND state = 'dropped')")
    return kept.select(*keys, value, F.when(F.col("m") & (F.col("state") == "added"), "moved").otherwise(F.col("state")).alias("state"))


def bulk(files: DataFrame, actions: list[tuple[str, str]]) -> DataFrame:
    """files after (prefix, action) for all whose url begins with a prefix: accept, disable, process, rescan or delete; the first
    that fits counts."""
    states = {"accept": "ACCEPTED", "disable": "DISABLED", "process": "PROCESSED", "rescan": "QUEUED", "delete": None}
    fits, status = F.lit(False), F.col("status")
    for prefix, action in reversed(actions):
        hit = F.col("url").startswith(prefix)
        fits = F.when(hit, action == "delete").otherwise(fits)
        status = F.when(hit, F.lit(states[action])).otherwise(status)
    return files.where(~fits).withColumn("status", status)
