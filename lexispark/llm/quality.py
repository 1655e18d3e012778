"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of BLOCK bytes; every block (so the whole text) is compressed with either dictionary. The difference
of the sums, bad less good, by the text's bytes is its normalised difference; a logistic curve over it, fitted on labelled rows
that the dictionaries have not seen, makes the score from 0 to 1.

Fitting reads a bounded sample of rows, each of them whole: at most SAMPLE texts of each label for the dictionaries and at most
CALIBRATION labelled texts for the curve; which ones, a hash of doc_id decides. Scores cover all rows. Only text enters a score.

Nulls and empty texts: scored as the curve's value at no difference. Rows without an integer doc_id are scored but never
learnt from. Without labelled rows of both kinds every score is the share of label 1 (0.5 with no label). Repeated rows get equal
scores; columns of docs are kept, whatever their names, and `held_out`, `score`, `predicted` replace columns of that name. An
empty table gives an empty result."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, LEVEL = 1024, 3
SAMPLE, DICTIONARY = 600, 400_000
CALIBRATION = 4000
#: A row is held out of learning if crc32 of its doc_id as text leaves this remainder.
FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve; small (under 1 MB), so it travels with the tasks."""

    good: bytes
    bad: bytes
    scale: float
    weights: tuple[float, float]


def _coder(data: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(data)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _differences(texts: pd.Series, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    out = np.zeros(len(texts))
    for row, text in enumerate(texts):
        data = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        out[row] = sum(len(bad.compress(x)) - len(good.compress(x)) for x in blocks) / max(1, len(data))
    return out


def _score(x: np.ndarray, model: Model) -> np.ndarray:
    a, b = model.weights
    return 1 / (1 + np.exp(-np.clip(a + b * x / model.scale, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """Learn from labels(doc_id, quality) and the texts of docs; held-out rows are left aside. A float: no model, a base rate."""
    marked = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("quality").try_cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit("fit"))
    # The bound of the sample: the labelled ids of lowest hash, of each label so many.
    chosen = {}
    for label in (0, 1):
        ids = marked.where(F.col("quality") == label).select("doc_id", order.alias("o")).orderBy("o", "doc_id").limit(SAMPLE + CALIBRATION // 2).collect()
        chosen |= {r.doc_id: (label, n, len(ids)) for n, r in enumerate(ids)}
    kinds = [label for label, _, _ in chosen.values()]
    if len(set(kinds)) < 2:
        return float(np.mean(kinds)) if kinds else 0.5
    # Half of a short list at most goes to the dictionary.
    for_dictionary = [i for i, (_, n, size) in chosen.items() if n < min(SAMPLE, (size + 1) // 2)]
    spark = docs.sparkSession
    roles = F.broadcast(spark.createDataFrame([(i, v[0], i in set(for_dictionary)) for i, v in chosen.items()], "doc_id long, _q int, _d boolean"))
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("text <> ''").join(roles, "doc_id")
    pieces = rows.where("_d").select("doc_id", "_q", "text").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    made = {}
    for label in (1, 0):
        own = [r.text.encode("utf-8", "replace") for r in pieces if r._q == label]
        try:
            made[label] = zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, own)) // 4)), own).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: its content itself is the dictionary
            made[label] = b"".join(own)[-DICTIONARY:] or b"-"
    learnt = made[1], made[0]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good, bad = map(_coder, learnt)
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "q": x["_q"], "x": _differences(x["text"], good, bad)})

    got = rows.where("NOT _d").mapInPandas(measured, "doc_id long, q int, x double").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    if got["q"].nunique() < 2:
        return float(np.mean(kinds))
    x, y = got["x"].to_numpy(), got["q"].to_numpy(float)
    scale = float(x.std()) + 1e-9
    # The sample takes equal numbers of each label where it can; each row counts by its label's share of all labels.
    share = dict(marked.groupBy("quality").count().toPandas().to_numpy().tolist())
    a, b = _logistic(np.c_[np.ones(len(x)), x / scale], y)
    prior = np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(*learnt, scale, (float(a + prior), float(b)))


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted; one pass, no shuffle."""
    docs = docs.drop("held_out", "score", "predicted")
    if isinstance(model, float):
        scored = F.lit(model)
    else:

        @F.pandas_udf("double")
        def scored_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            good, bad = _coder(model.good), _coder(model.bad)
            for texts in batches:
                yield pd.Series(_score(_differences(texts, good, bad), model))

        scored = scored_texts(F.col("text"))
    return docs.withColumn("held_out", held_out()).withColumn("score", scored).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def crc_remainder(doc_id: int) -> int:
    """The remainder that decides about holding out, as plain Python has it (for tests)."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
