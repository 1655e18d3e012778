"""Roles of the columns of tabular annotation files. cell(file_id, row_no, col, value), rows numbered from 0.

A file's rows are ordered by a window per file; a file is at most as long as its reader lets it be (2000 rows by default)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POS_SHARE, SAMPLE_TOKENS, NUMERIC_TAGS = 0.4, 40, 100
#: Feature names that carry no annotation.
IGNORED = [
    "word", "msd", "Translit", "LTranslit", "ref", "Gloss", "MGloss", "MSeg", "LGloss", "LId", "LDeriv", "Vib", "PLemma", "PForm", "Root", "VForm", "Vform", "MorphInd",
    "MWE", "LvtbNodeId", "Id", "En", "Orig", "Morphs", "Offset", "LNumValue", "ChunkId", "Tam", "AltTag", "Alt", "Morf",
]
DELIMITERS = ["+", "|", ":", ",", "-", "."]


def word_index_column(cell: DataFrame) -> DataFrame:
    """The first column in which one of the first six rows is a whole number."""
    return cell.where("row_no <= 5").where(F.expr("try_cast(value AS int)").isNotNull() & F.col("value").rlike("^[+-]?[0-9]+$")).groupBy("file_id").agg(F.min("col").alias("col"))


def sentences(row: DataFrame) -> DataFrame:
    """row(file_id, row_no, idx) with sent_no from 0: a sentence begins where idx does not rise; rows without whole idx go."""
    w = Window.partitionBy("file_id").orderBy("row_no")
    whole = row.where(F.col("idx").isNotNull())
    new = F.when(F.lag("idx").over(w).isNull() | (F.col("idx") > F.lag("idx").over(w)), 0).otherwise(1)
    return whole.withColumn("_new", new).withColumn("sent_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def sample_sentences(numbered: DataFrame, most: int = SAMPLE_TOKENS) -> DataFrame:
    """Whole sentences from the first on until they hold `most` tokens or more."""
    size = numbered.groupBy("file_id", "sent_no").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_id").orderBy("sent_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return size.withColumn("before", before).where(F.col("before") < most).select("file_id", "sent_no", "n")


def sentence_text(numbered: DataFrame, value: str = "form") -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("row_no", F.col(value).alias("v"))))
    return numbered.groupBy("file_id", "sent_no").agg(rows.alias("r")).select("file_id", "sent_no", F.array_join(F.transform("r", lambda x: x["v"]), " ").alias("text"))


def feature_columns(cell: DataFrame) -> DataFrame:
    """Columns in which every value is _ or holds = or |, and not all are _."""
    fits = (F.col("value") == "_") | F.col("value").rlike("[=|]")
    return cell.groupBy("file_id", "col").agg(F.bool_and(fits).alias("all"), F.count_if(F.col("value") != "_").alias("n")).where("all AND n > 0").select("file_id", "col")


def pattern_columns(cell: DataFrame) -> DataFrame:
    """(file_id, col, delimiter, n): columns with three values or more built of parts with a delimiter; a hyphen also needs more
    than two parts on average, and as many in every value (a word now and then has a hyphen, too)."""
    # patterns of their own, as one from a column is compiled for every row; most values hold no delimiter at all
    built = lambda d: F.contains("value", F.lit(d)) & F.col("value").rlike(rf"^(?:[A-Za-z0-9]++\Q{d}\E)++[A-Za-z0-9]+$")
    hit = cell.select("file_id", "col", "value", F.explode(F.array_compact(F.array(*[F.when(built(d), F.lit(d)) for d in DELIMITERS]))).alias("delimiter"))
    parts = F.length("value") - F.length(F.expr("replace(value, delimiter, '')")) + 1
    return hit.groupBy("file_id", "col", "delimiter").agg(F.count("*").alias("n"), F.avg(parts).alias("parts"), F.count_distinct(parts).alias("forms")).where("n >= 3 AND (delimiter <> '-' OR parts > 2 AND forms = 1)").select("file_id", "col", "delimiter", "n")


def pos_columns(cell: DataFrame, tag: DataFrame) -> DataFrame:
    """Columns of which enough is in the dictionary: of the alphabetic values, or of the different ones."""
    return pos_values(cell.groupBy("file_id", "col", "value").agg(F.count("*").alias("cnt")), tag)


def pos_values(values: DataFrame, tag: DataFrame) -> DataFrame:
    """pos_columns of counted values(file_id, col, value, cnt)."""
    known = tag.select(F.col("tag").alias("value")).distinct().withColumn("known", F.lit(True))
    values = values.join(known, "value", "left")
    alpha = F.col("value").rlike("^[A-Za-z]+$")
    per = values.groupBy("file_id", "col").agg(
        F.sum(F.when(alpha, F.col("cnt")).otherwise(0)).alias("mass"),
        F.coalesce(F.sum(F.when(alpha & F.col("known"), F.col("cnt"))), F.lit(0)).alias("hit"),
        F.count("*").alias("types"),
        F.count("known").alias("hit_types"),
    )
    return per.where(f"hit > 0 AND hit >= {POS_SHARE} * mass OR hit_types >= {POS_SHARE} * types").select("file_id", "col")


def vector_columns(cell: DataFrame) -> DataFrame:
    """The first column per file whose values all have one length of two or more."""
    one = cell.groupBy("file_id", "col").agg(F.count_distinct(F.length("value")).alias("n"), F.min(F.length("value")).alias("l")).where("n = 1 AND l >= 2")
    return one.groupBy("file_id").agg(F.min("col").alias("col"))


def text_columns(cell: DataFrame, rows: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """Columns with a vocabulary of a third of the rows or of 140, and no _; of these, if given, those of spoken(file_id, col), in
    which a language has been detected."""
    per = cell.groupBy("file_id", "col").agg(F.count_distinct("value").alias("types"), F.bool_or(F.col("value") == "_").alias("blank"))
    found = per.join(rows, "file_id").where("NOT blank AND (types >= rows / 3 OR types >= 140)").select("file_id", "col")
    return found if spoken is None else found.join(spoken.select("file_id", "col").distinct(), ["file_id", "col"], "left_semi")


def column_tokens(cell: DataFrame, separator: str = ":") -> DataFrame:
    """(file_id, col, token, cnt): values in parts, trimmed; columns with more than NUMERIC_TAGS different numbers are out."""
    parts = cell.select("file_id", "col", F.explode(F.split("value", F.lit(f"[{separator}]"), -1)).alias("token")).select("file_id", "col", F.trim("token").alias("token")).where("token <> ''")
    counts = parts.groupBy("file_id", "col", "token").agg(F.count("*").alias("cnt"))
    numeric = counts.where(F.col("token").rlike("^[0-9]+$")).groupBy("file_id", "col").agg(F.count("*").alias("n")).where(F.col("n") > NUMERIC_TAGS)
    return counts.join(numeric, ["file_id", "col"], "left_anti")


def feature_counts(feature: DataFrame) -> DataFrame:
    """(name, value, cnt) of feats like a=b|c=d; _ and parts without value are left out, what follows a second = too."""
    part = F.explode(F.split("feats", "[|]", -1)).alias("part")
    parts = feature.where("feats <> '_'").select(part).select(F.split("part", "=", -1).alias("p")).where("size(p) >= 2 AND p[1] <> ''")
    named = parts.select(F.col("p")[0].alias("name"), F.col("p")[1].alias("value")).where(~F.col("name").isin(IGNORED) & ~F.col("name").startswith("MWE"))
    return named.groupBy("name", "value").agg(F.count("*").alias("cnt"))


def pattern_counts(cell: DataFrame, delimiter: str) -> DataFrame:
    """(token, cnt): values in parts by the delimiter, then |, then :."""
    parts = F.explode(F.split("value", F.lit(f"[{delimiter}|:]"), -1))
    return cell.select(parts.alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))


def pattern_parts(cell: DataFrame, delimiters: list[str]) -> DataFrame:
    """(file_id, col, token, cnt): values in parts by the delimiters, then |, then :; columns with more than NUMERIC_TAGS different
    numbers are out."""
    quoted = "".join("\\" + d for d in delimiters)
    parts = cell.select("file_id", "col", F.explode(F.split("value", F.lit(f"[{quoted}|:]"), -1)).alias("token")).where("token <> ''")
    counts = parts.groupBy("file_id", "col", "token").agg(F.count("*").alias("cnt"))
    numeric = counts.where(F.col("token").rlike("^[0-9]+$")).groupBy("file_id", "col").agg(F.count("*").alias("n")).where(F.col("n") > NUMERIC_TAGS)
    return counts.join(numeric, ["file_id", "col"], "left_anti")


def sentence_pools(numbered: DataFrame, least: int = SAMPLE_TOKENS) -> DataFrame:
    """(file_id, sent_no, pool): whole sentences in a row make a pool until it has `least` tokens; none is used twice."""
    size = numbered.groupBy("file_id", "sent_no").agg(F.count("*").cast("int").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("sent_no", "n")))

    def step(s, x):
        full = s["held"] >= least
        pool = F.when(full, s["pool"] + 1).otherwise(s["pool"])
        return F.struct(pool.alias("pool"), F.when(full, x["n"]).otherwise(s["held"] + x["n"]).alias("held"), F.concat(s["out"], F.array(F.struct(x["sent_no"].alias("sent_no"), pool.alias("pool")))).alias("out"))

    none = F.array().cast("array<struct<sent_no:bigint,pool:int>>")
    start = F.struct(F.lit(0).alias("pool"), F.lit(0).alias("held"), none.alias("out"))
    return size.groupBy("file_id").agg(rows.alias("r")).select("file_id", F.inline(F.aggregate("r", start, step, lambda s: s["out"])))


def first_rows(cell: DataFrame, most: int) -> DataFrame:
    """The first rows of each file; -1: all of them."""
    return cell if most < 0 else cell.where(F.col("row_no") < most)
