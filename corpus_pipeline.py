"""From raw documents to a training mixture: five stages, each reading what the last one wrote.

All stages but the last return the columns of documents, and others that it may have, whatever their names. Rows that are equal
are treated alike by every stage, but for near duplicates, where they are one document of which all rows stay. Without any rows a
stage returns none; nulls and empty texts are said below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import decontaminate, lines, mixing, near, quality
from lexispark.llm.common import materialize, table

#: Not all stages can be put as SQL (the classifier learns); the stages are tested against brute force instead.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null or empty text gets the curve's value at no difference, and a null
    doc_id is scored like any other; labels of documents that are not there teach nothing."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines (of three words or more: shorter ones recur by chance) that an earlier one has; those of which
    nothing is left go. Nulls and texts that were empty before stay; rows without doc_id come last, by their text's hash."""
    done = lines.dedup_lines(docs, min_words=3)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"\S")
    return _counted(done.where(~emptied).select(*docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that of least doc_id. Texts without words
    and rows without doc_id are in no group and stay."""
    return near.near_dedup(docs, words=5, percent=80).where("kept").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Nulls and empty texts have none and stay; an empty benchmark drops none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shuffled mixture with target weights, with copy and mix_key. Rows without source are a source of their own, rows
    without doc_id are drawn by their text's hash; sources without any characters go."""
    return mixing.mix(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
