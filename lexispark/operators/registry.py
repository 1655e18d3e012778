"""The registry of resources and files: counters, listings, edits, ownership, exports' choice. Tables are rewritten, not edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The predicate that counts from the start, and states of files.
DEFAULT_PREDICATE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
DONE, ACTIVE = ["PROCESSED", "ACCEPTED", "DISABLED", "CHECK", "EDITED"], ["QUEUED", "ACTIVE"]


def counters(files: DataFrame, users: DataFrame) -> DataFrame:
    """(counter, key, n): files and resources done, users by type, files by owner. files(url, status, owner), users(type)."""
    done = files.where(F.col("status").isin("PROCESSED", "ACCEPTED"))
    row = lambda df, name, key, n: df.select(F.lit(name).alias("counter"), key.alias("key"), n.alias("n"))
    both = done.agg(F.count("*").alias("files"), F.count_distinct("url").alias("resources"))
    out = row(both, "done_files", F.lit(""), F.col("files")).union(row(both, "done_resources", F.lit(""), F.col("resources")))
    out = out.union(row(users.groupBy("type").agg(F.count("*").alias("n")), "users", F.col("type"), F.col("n")))
    return out.union(row(files.groupBy("owner").agg(F.count("*").alias("n")), "owned_files", F.col("owner"), F.col("n")))


def outcomes(results: DataFrame) -> DataFrame:
    """(url, done, success, error, unsuccessful) of results(url, done, result): all files done; a file with results; a file with
    errors; all done and none with results."""
    per = results.groupBy("url").agg(F.bool_and("done").alias("done"), F.bool_or(F.col("result") == "SUCCESS").alias("success"), F.bool_or(F.col("result") == "ERROR").alias("error"))
    return per.withColumn("unsuccessful", F.col("done") & ~F.col("success"))


def workspace(owned: DataFrame, selected: DataFrame) -> DataFrame:
    """(user, url, owned, selected): what each user owns and has selected."""
    o = owned.select("user", "url").distinct().withColumn("o", F.lit(True))
    x = selected.select("user", "url").distinct().withColumn("x", F.lit(True))
    return o.join(x, ["user", "url"], "full_outer").select("user", "url", F.coalesce("o", F.lit(False)).alias("owned"), F.coalesce("x", F.lit(False)).alias("selected"))


def permitted(resources: DataFrame, grants: DataFrame, user: str, admins: list[str]) -> DataFrame:
    """(url, may_edit): owners and administrators may edit, others where it has been granted. resources(url, owner), grants(url, user)."""
    given = grants.where(F.col("user") == user).select("url").distinct().withColumn("g", F.lit(True))
    return resources.join(given, "url", "left").select("url", ((F.col("owner") == user) | F.lit(user in admins) | F.col("g").isNotNull()).alias("may_edit"))


def starts(runs: DataFrame) -> DataFrame:
    """(url, start, states): when the first file of a resource began, and the states of its files."""
    return runs.groupBy("url").agg(F.min("start").alias("start"), F.sort_array(F.collect_set("state")).alias("states"))


def queue_positions(requests: DataFrame, user: str, order: list[str]) -> DataFrame:
    """requests with their position in their user's queue; position 1 is the next to be taken."""
    return requests.withColumn("position", F.row_number().over(Window.partitionBy(user).orderBy(*order)))


def by_state(files: DataFrame, user: str) -> DataFrame:
    """(user, active, queued, errors): how many resources of each user are in these states."""
    n = lambda *states: F.count_distinct(F.when(F.col("status").isin(*states), F.col("url")))
    return files.groupBy(user).agg(n("ACTIVE").alias("active"), n("QUEUED").alias("queued"), n("ERROR").alias("errors"))


def exportable(resources: DataFrame, active: DataFrame, with_broken: bool = False) -> DataFrame:
    """Resources to export: accepted, not being worked on, and not broken (unless wanted). resources(url, accepted, broken)."""
    good = F.col("accepted") if with_broken else F.col("accepted") & ~F.col("broken")
    return resources.where(good).join(active.select("url").distinct(), "url", "left_anti").select("url")


def copied_metadata(metadata: DataFrame, source: Column, targets: Column) -> DataFrame:
    """metadata(url, fields...) with the fields of the one source row in all target rows."""
    fields = [c for c in metadata.columns if c != "url"]
    one = metadata.where(source).agg(F.min_by(F.struct(*fields), "url").alias("given"))
    hit = targets & F.col("given").isNotNull()
    return metadata.join(one).select("url", *[F.when(hit, F.col(f"given.{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def edited(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, method, source, selected) after edits(keys, action): add selects (a new row is added), unset deselects, delete
    removes; what has been edited is MANUAL and so of source SELECTION."""
    both = rows.join(edits.select(*keys, "action").distinct(), keys, "full_outer").where("NOT (action <=> 'delete') AND NOT (method IS NULL AND action = 'unset')")
    touched = F.col("action").isNotNull()
    return both.select(*keys, F.when(touched, "MANUAL").otherwise(F.col("method")).alias("method"), F.when(touched, "SELECTION").otherwise(F.col("source")).alias("source"), F.when(touched, F.col("action") == "add").otherwise(F.col("selected")).alias("selected"))


def deselected(rows: DataFrame, wish: DataFrame, group: list[str], key: str) -> DataFrame:
    """rows(group, key, selected) without the selections in wish(group, key); a group is left as it is if none would be left."""
    out = rows.join(wish.select(*group, key).distinct().withColumn("w", F.lit(True)), [*group, key], "left")
    left = F.bool_or(F.col("selected") & F.col("w").isNull()).over(Window.partitionBy(*group))
    return out.withColumn("left", left).select(*group, key, (F.col("selected") & ~(F.col("w").isNotNull() & F.col("left"))).alias("selected"))


def registered(known: DataFrame, found: DataFrame) -> DataFrame:
    """(url, hash, action): found(url, hash) against known(url, hash): new ones are inserted, changed ones lose their results,
    others are kept."""
    k = known.select("url", F.col("hash").alias("old"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("hash"), "reset").otherwise("keep")
    return found.join(k, "url", "left").select("url", "hash", action.alias("action"))


def one_per_key(rows: DataFrame, keys: list[str], best: str) -> DataFrame:
    """rows with one row per key: that of the greatest `best`, of equal ones the greatest by the other columns."""
    rest = [c for c in rows.columns if c not in keys and c != best]
    return rows.groupBy(*keys).agg(F.max(F.struct(best, *rest)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def latest(matches: DataFrame, since: str) -> DataFrame:
    """(file_id, latest, updated_after) of matches(file_id, updated)."""
    return matches.groupBy("file_id").agg(F.max("updated").alias("latest")).withColumn("updated_after", F.col("latest") > F.lit(since).cast("timestamp"))


def predicate_dimension(predicates: DataFrame, disabled: list[str]) -> DataFrame:
    """(predicate, is_default, disabled): rdf:type counts from the start, the listed ones never."""
    p = F.col("predicate")
    return predicates.select("predicate").union(predicates.sparkSession.createDataFrame([(x,) for x in [DEFAULT_PREDICATE, *disabled]], "predicate string")).distinct().select("predicate", (p == DEFAULT_PREDICATE).alias("is_default"), p.isin(disabled).alias("disabled"))


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with all those of new's keys cleared and new's written (types, vocabularies, tokens or predicates of a file)."""
    return rows.join(new.select(key).distinct(), key, "left_anti").select(*rows.columns).union(new.select(*rows.columns).distinct())


def attributes(files: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, attribute, value): what is known about each file, a row per attribute that it has."""
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(n).cast("string").alias("value")) for n in names])
    return files.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where("value IS NOT NULL")


def written_attributes(files: DataFrame, changes: DataFrame, key: str, names: list[str]) -> DataFrame:
    """files with changes(key, attribute, value) written into it; of several changes of an attribute the greatest counts."""
    wide = changes.where(F.col("attribute").isin(names)).groupBy(key).agg(*[F.max(F.when(F.col("attribute") == n, F.col("value"))).alias(f"new_{n}") for n in names])
    return files.join(wide, key, "left").select(*[F.coalesce(F.col(f"new_{c}").cast(dict(files.dtypes)[c]), F.col(c)).alias(c) if c in names else F.col(c) for c in files.columns])


def comments(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """(url, n, latest, latest_text) of comments(url, id, text) that have not been deleted."""
    left = rows.join(gone.select("url", "id"), ["url", "id"], "left_anti")
    return left.groupBy("url").agg(F.count("*").alias("n"), F.max("id").alias("latest"), F.max_by("text", "id").alias("latest_text"))


def header(lines: Column) -> dict[str, Column]:
    """Status, length (0 if it isn't given), type, date and tag out of the text of an HTTP header."""
    field = lambda name: F.trim(F.regexp_extract(lines, rf"(?im)^{name}:([^\r\n]*)", 1))
    return {
        "status": F.coalesce(F.regexp_extract(lines, r"^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int"), F.lit(0)),
        "length": F.coalesce(field("content-length").try_cast("long"), F.lit(0).cast("long")),
        "type": F.regexp_extract(field("content-type"), "^[^;]*", 0),
        "modified": field("last-modified"),
        "etag": F.regexp_replace(field("etag"), '^W/|"', ""),
    }


def flat_json(files: DataFrame, columns: list[str]) -> DataFrame:
    """(json): one flat object per file."""
    return files.select(F.to_json(F.struct(*columns)).alias("json"))
