"""Line dedup: drop a line if an earlier one is the same or one word away from it.

A line's words are its lower-cased pieces between white space; lines of min_words words or more (default: all but blank ones)
are compared. Two lines are near if one word inserted, deleted or replaced turns one into the other and both have near_words
words or more: the edit bound is one word for eight or more and none for fewer, as one word is much of a short line. Lines are
ordered by (doc_id, text's hash, place in the text); a line goes if an earlier line has the same words or is near.

Near lines meet through their deletion neighbourhoods: every line emits the hash of each variant that lacks one word.
Lines that differ by a replaced word share a variant at the same place; a line that lacks a word of another equals that
one's variant. Per key only the earliest line of each role is kept (an aggregate), so a key that a third of all lines share
makes no pairs. The earliest partner of each line is then verified word by word. Before that, halves: of two near lines
either the first or the last half agrees, so only lines that share a half with another line emit variants, and only at
places in the other half; no near pair is lost by it.

Nulls and empty texts stay as they are, with no lines counted. Rows without an integer doc_id come last, by their text's hash.
A row is one document by doc_id and text: rows that repeat both get equal results and don't drop one another's lines, rows
that repeat a doc_id only are two documents. Other columns are kept, whatever their names; n_lines and n_dropped replace
columns of that name. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import fresh, materialize, maybe_broadcast

MIN_WORDS, NEAR_WORDS = 1, 8
#: Candidate lines (32 bytes each) that may be broadcast to pick their words out of the texts; more of them are shuffled.
BROADCAST_LINES = 1_000_000
LAST = 2**63 - 1
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


#: What tells a line apart, in the order of lines.
ROW = ["doc", "row"]
LINE = [*ROW, "line"]


def _row() -> list[Column]:
    """A document's place in order: its doc_id, then a hash of doc_id and text."""
    doc = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(LAST))
    return [doc, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), "text")]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, row, line, words) of the lines that have min_words words."""
    # words are made below the explode, which hands them on as values; above it each use would split the line anew
    plain = F.when(F.col("text").rlike("[\t\r\f\x0b]"), F.translate(F.lower("text"), "\t\r\f\x0b", "    ")).otherwise(F.lower("text"))
    split = F.transform(F.split(plain, "\n", -1), lambda line: F.array_remove(F.split(line, " ", -1), ""))
    own = [c.alias(x) for c, x in zip(_row(), ROW, strict=True)]
    return docs.where("text <> ''").select(*own, F.posexplode_outer(split).alias("line", "words")).where(F.size("words") >= max(1, min_words))


def _half_keys() -> Column:
    """Of a line of n words, as the longer (L = n) or shorter (L = n + 1) of two: its first L/2 and its last L - L/2 words."""
    n = F.size("words")

    def key(kind: str, length: Column, part: Column) -> Column:
        return F.xxhash64(F.lit(kind), length, part)

    made = []
    for size in (n, n + 1):
        half = F.floor(size / 2).cast("int")
        made += [key("first", size, F.slice("words", F.lit(1), half)), key("last", size, F.slice("words", n - (size - half) + 1, size - half))]
    return F.array(*made)


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt & MASK)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, kind, doc, line): kind 0 a variant with its place, 1 a variant, 2 the line itself; linear in the words."""
    for x in batches:
        keys, kinds, at_lines, held = [], [], [], 0
        for n_line, (hashes, first, last) in enumerate(zip(x["hashes"], x["first"], x["last"], strict=True)):
            w = np.asarray(hashes, dtype=np.int64).view(np.uint64)
            n = len(w)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _powers(n)[:n], dtype=np.uint64)])
            at = np.arange(0 if last else n // 2, n if first else (n + 1) // 2)
            v = sums[at] + (sums[n] - sums[at + 1]) * np.uint64(INVERSE)
            place = _mixed(_mixed(v, n) + at.astype(np.uint64) * np.uint64(BASE), 1)
            own = [place, np.unique(_mixed(v, (n - 1) * 2 + 2**40)), _mixed(sums[n:], n * 2 + 2**40)]
            for kind, k in enumerate(own):
                keys.append(k)
                kinds.append(np.full(len(k), kind, np.int32))
            total = sum(map(len, own))
            at_lines.append(np.full(total, n_line))
            held += total
            if held > 500_000:
                yield _emitted(x, keys, kinds, at_lines)
                keys, kinds, at_lines, held = [], [], [], 0
        if held:
            yield _emitted(x, keys, kinds, at_lines)


def _emitted(x: pd.DataFrame, keys: list, kinds: list, at_lines: list) -> pd.DataFrame:
    at = np.concatenate(at_lines)
    return pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "kind": np.concatenate(kinds), **{c: x[c].to_numpy()[at] for c in LINE}})


def near(a: list, b: list) -> bool:
    """One word inserted, deleted or replaced at most."""
    a, b = np.asarray(a), np.asarray(b)
    short, long = min(len(a), len(b)), max(len(a), len(b))
    if long - short > 1:
        return False
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    same = a[len(a) - short :][::-1] == b[len(b) - short :][::-1]
    tail = short if same.all() else int(same.argmin())
    return head + tail >= long - 1


def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc, row, line) of the lines that go."""
    own = F.struct(*LINE)
    lines = _lines(docs, min_words)
    h1, h2 = F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("line"), F.size("words"), "words").alias("h2")
    # written out, as it is read for the different lines and for all their places; the texts need no second pass for it
    hashed = materialize(lines.select(*LINE, h1, h2, F.when(F.size("words") >= near_words, _half_keys()).alias("halves")), "hashed")
    distinct = materialize(hashed.groupBy("h1", "h2").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.first("halves").alias("halves")), "lines")
    again = distinct.where("first <> last").select("h1", "h2", "first")
    exact = hashed.select(*LINE, "h1", "h2").join(again, ["h1", "h2"]).where(own != F.col("first")).select(*LINE)
    halves = distinct.where("halves IS NOT NULL").select("first.*", F.posexplode("halves").alias("n", "key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    mine = halves.join(shared, "key", "left_semi").groupBy(*LINE).agg(F.bool_or(F.col("n") % 2 == 0).alias("first"), F.bool_or(F.col("n") % 2 == 1).alias("last"))
    mine = materialize(mine, "halves")
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    candidates = materialize(lines.join(maybe_broadcast(mine, BROADCAST_LINES), LINE).select(*LINE, "first", "last", hashes.alias("hashes")).dropDuplicates(LINE), "candidates")
    emitted = candidates.mapInPandas(_variants, "key long, kind int, doc long, row long, line int")
    earliest = emitted.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, own)).alias(f"k{k}") for k in range(3)], F.max(own).alias("k"))
    earliest = earliest.where("k <> coalesce(k0, k1, k2) OR k1 IS NOT NULL AND k2 IS NOT NULL")
    partner = F.when(F.col("kind") == 0, F.col("k0")).when(F.col("kind") == 1, F.col("k2")).otherwise(F.col("k1"))
    pairs = emitted.join(earliest, "key").select(*LINE, partner.alias("p")).where(F.col("p") < own).groupBy(*LINE).agg(F.min("p").alias("p"))
    words = candidates.select(*LINE, "hashes")
    theirs = words.select(own.alias("p"), F.col("hashes").alias("theirs"))
    found = pairs.join(words, LINE).join(theirs, "p").where(F.pandas_udf(_verified, "boolean")("hashes", "theirs"))
    return exact.union(found.select(*LINE))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with the dropped lines taken out of text, and n_lines, n_dropped (bigint)."""
    docs = docs.drop("n_lines", "n_dropped")
    doc, row, gone = fresh(docs, *ROW, "gone")
    dropped = dropped_lines(docs, min_words, near_words).groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.collect_set("line").alias(gone))
    joined = docs.withColumns(dict(zip((doc, row), _row(), strict=True))).join(dropped, [doc, row], "left")
    # the split text is handed to the lambda as a value, so it is split once; places are taken out by hash, not searched for
    staying = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone))
    rest = F.transform(F.array(F.split("text", "\n", -1)), lambda x: F.array_join(F.transform(staying(x), lambda i: F.get(x, i)), "\n"))[0]
    return joined.select(
        *[F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
