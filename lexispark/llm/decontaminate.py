"""Benchmark decontamination by winnowing; DataFrame functions only.

Words: A-Z lower-cased, then maximal runs of characters other than ASCII non-alphanumerics. A window of an item is WINDOW
consecutive words of it; an item of fewer words (but not none) is one window. A word of a document inside any occurrence of
a window is hit.

Fingerprints: each position has a hash of GRAM words; of every WINDOW - GRAM + 1 consecutive ones the least is kept with
its place. Equal spans of WINDOW words keep the same one, so no shared window is missed. Items shorter than WINDOW keep the
hash of all their words, looked up at every place. Fingerprints of items and texts are joined; a match puts item and text in
line, and is extended: the text's words in that line are compared with all of the item's, which gives the runs that agree.
Matches and hits are written out, so what is done with the result cannot make Spark split texts anew for each of them.

Nulls and empty texts have no words. Benchmark rows without item_id or words are ignored; rows that repeat an item_id are
one item with several texts. Repeated documents get equal results. Columns of docs are kept, whatever their names; n_words,
n_hit, n_items, items_sha256, contaminated and items replace columns of that name. With an empty benchmark nothing is hit;
without documents the result is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import fresh, kept, materialize, maybe_broadcast, row_key

WINDOW, GRAM = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints of the benchmark (some 50 bytes each) up to which they are broadcast; more are joined by shuffle, in SALTS parts.
BROADCAST_PRINTS, SALTS = 500_000, 16
#: Keys of documents with matches, and results of those with hits (100 bytes and the item_ids), that may be broadcast.
BROADCAST_KEYS, BROADCAST_HITS = 1_000_000, 100_000
PLACE_BITS = 30
HIGH = ((1 << 63) - 1) ^ ((1 << PLACE_BITS) - 1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _placed(h: Column, place: Column) -> Column:
    """A hash in the upper bits and its place in the lower PLACE_BITS."""
    return h.bitwiseAND(F.lit(HIGH)).bitwiseOR(place.cast("long"))


def _grams(w: str) -> Column:
    """The placed hash of every GRAM words in a row, of texts of WINDOW words or more."""
    return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: _placed(F.xxhash64(F.slice(w, i + 1, GRAM)), i)))


def _minima(grams: str) -> Column:
    size = WINDOW - GRAM + 1
    least = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - size), lambda i: F.array_min(F.slice(grams, i + 1, size))))
    return F.when(F.col(grams).isNotNull(), least).otherwise(F.array().cast("array<bigint>"))


def _whole(n: int, w: str) -> Column:
    """The placed hash of every n words in a row."""
    found = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: _placed(F.xxhash64(F.lit(n), F.slice(w, i + 1, n)), i))
    return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<bigint>"))


def _prints(df: DataFrame, whole: list[int]) -> DataFrame:
    """df's rows (with words w) by fingerprint (print, at): winnowed ones, and those of `whole` words in a row."""
    # the outer form of explode, as for the plain one Spark would work out the array once more to leave out empty ones
    found = F.concat(_minima("grams"), *[_whole(n, "w") for n in whole])
    rows = df.withColumn("grams", _grams("w")).select(*[c for c in df.columns if c != "w"], F.explode_outer(found).alias("p")).where("p IS NOT NULL")
    return rows.withColumn("print", F.shiftright("p", PLACE_BITS)).withColumn("at", F.col("p").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")).drop("p")


def _matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item, start, n): the lines of documents with items of n words."""
    lengths = [r.n for r in items.where(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().orderBy("n").collect()]  # nine at most
    own = items.select("item", F.size("w").alias("n"), "w")
    prints = _prints(own.where(F.size("w") >= WINDOW), [])
    for n in lengths:
        prints = prints.union(_prints(own.where(F.col("n") == n), [n]))
    prints = materialize(prints.withColumnRenamed("at", "item_at"), "prints")
    mine = _prints(docs.where("text <> ''").select(row_key("doc_id", "text").alias("key"), words("text").alias("w")), lengths)
    if prints.limit(BROADCAST_PRINTS + 1).count() <= BROADCAST_PRINTS:
        joined = mine.join(F.broadcast(prints), "print")
    else:  # a print that very many texts have is dealt to several tasks
        salted = prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = mine.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(salted, ["print", "salt"])
    return materialize(joined.select("key", "item", (F.col("at") - F.col("item_at")).alias("start"), "n").distinct(), "matches")


def _runs(mine: str, item: str, begin: Column, window: Column) -> Column:
    """Of two word arrays in line the stretches of `window` words or more that agree: [(b, e), ...), places counted from begin."""
    same = F.concat(F.zip_with(mine, item, lambda x, y: F.coalesce(x == y, F.lit(False))), F.array(F.lit(False)))
    none = F.array().cast("array<struct<b:int,e:int>>")

    def step(s: Column, x: Column) -> Column:
        ended = ~x & (s["run"] >= window)
        run = F.array(F.struct((s["i"] - s["run"]).cast("int").alias("b"), s["i"].cast("int").alias("e")))
        return F.struct((s["i"] + 1).cast("int").alias("i"), F.when(x, s["run"] + 1).otherwise(0).cast("int").alias("run"), F.when(ended, F.concat(s["out"], run)).otherwise(s["out"]).alias("out"))

    return F.aggregate(same, F.struct(begin.cast("int").alias("i"), F.lit(0).alias("run"), none.alias("out")), step, lambda s: s["out"])


def _covered(runs: Column) -> Column:
    """How many places sorted runs cover together."""
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(s["to"], r["b"]))).cast("long").alias("n"), F.greatest(s["to"], r["e"]).alias("to"))
    return F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), step, lambda s: s["n"])


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, n_hit, items) of the documents (by row_key of doc_id and text) with words that are hit."""
    matches = _matches(docs, items)
    keys = maybe_broadcast(matches.select("key").distinct(), BROADCAST_KEYS)
    texts = docs.where("text <> ''").select(row_key("doc_id", "text").alias("key"), "text").join(keys, "key", "left_semi").dropDuplicates(["key"])
    lines = matches.groupBy("key").agg(F.collect_list(F.struct("item", "start", "n")).alias("lines"))
    split = texts.select("key", words("text").alias("w")).join(lines, "key").select("key", "w", "lines", F.size("w").alias("size"))
    # a line's places in the text: from the item's first or the text's first, to the item's last or the text's last
    first = lambda f: F.greatest(f["start"], F.lit(0))
    cut = F.transform("lines", lambda f: F.struct(f["item"].alias("item"), f["start"].alias("start"), F.slice("w", first(f) + 1, F.greatest(F.lit(0), F.least(f["start"] + f["n"], F.col("size")) - first(f))).alias("mine")))
    lined = split.select("key", F.explode(cut).alias("f")).select("key", "f.*").join(items.select("item", "item_id", "w"), "item")
    lined = lined.select("key", "item_id", "mine", F.slice("w", F.greatest(F.lit(0), -F.col("start")) + 1, F.greatest(F.size("mine"), F.lit(1))).alias("theirs"), F.greatest("start", F.lit(0)).alias("begin"), F.least(F.lit(WINDOW), F.size("w")).alias("window"))
    runs = lined.select("key", "item_id", _runs("mine", "theirs", F.col("begin"), F.col("window")).alias("runs"))
    found = runs.select("key", "item_id", F.explode("runs").alias("run")).groupBy("key").agg(F.sort_array(F.collect_set("run")).alias("runs"), F.sort_array(F.collect_set("item_id")).alias("items"))
    return materialize(found.select("key", _covered(F.col("runs")).alias("n_hit"), "items"), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and items (sorted item_ids as strings)."""
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0).distinct()
    # a match of hashes only proposes a line: two items of equal hash would both be compared
    items = materialize(items.select("item_id", "w", F.xxhash64("item_id", "w").alias("item")), "items")
    (key,) = fresh(docs, "key")
    found = maybe_broadcast(hits(docs, items).withColumnRenamed("key", key), BROADCAST_HITS)
    joined = docs.withColumn(key, row_key("doc_id", "text")).join(found, key, "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        *kept(docs),
        F.size(words("text")).cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        names.alias("items"),
    )
