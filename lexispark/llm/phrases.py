"""Phrase collocations: minimal perfect hash tables over Apriori-safe candidates, counted by numpy arrays in the mappers.

Words are bytes between blanks and tabs, A-Z in lower case; marks and line ends cut a text into pieces that no phrase crosses.
Everything is counted per lang. Words of `least` occurrences or more get numbers, texts are written once as arrays of them (0 is
any other word or the end of a piece), and each length k = 2 .. longest takes these passes over the arrays:

1. A phrase is a candidate if its first and its last k-1 words are frequent (Apriori) and so is the bucket that its key, (slot of
   its first k-1 words, last word), hashes to; buckets are counted by the mappers and summed as a tree.
2. Distinct candidates go to shards by hash; a task builds a shard's minimal perfect hash (levels of bit arrays, a key's slot being
   the rank of its bit) and stores the keys by slot. Shards are broadcast in rounds of a bounded size, as many as there are.
3. Mappers look all occurrences up, compare the stored key, and bincount the slots; the arrays are summed as a tree. A phrase is
   frequent by this count alone.
4. The slots of frequent phrases are written beside the words for the next length.

Counts of cuts are read by slot: a phrase knows the slots of its first and its last k-1 words. No step gathers a word's or a
lang's rows; what a mapper sends grows with its texts, what is broadcast has a fixed bound. Executors may be lost at any time:
every pass is written to the shared folder.

Null or empty texts have no words; a null lang is `und`. Repeated rows count each. Ties go to the smaller cut and, in the order of the
report, to the phrase's bytes. Very long texts are one array. Columns of other names are ignored. An empty table gives no rows."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import materialize

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: Words in one broadcast dictionary; keys in a shard (about; SLOTS bounds them) and shards in one broadcast round.
WORDS, SHARD, SLOTS, ROUND = 1 << 20, 1 << 16, 1 << 17, 32
#: Buckets: a power of two, about one per 8 words, so many at most; CHUNK of them are summed together.
MOST_BUCKETS, CHUNK = 1 << 28, 1 << 18
#: A mapper hands on what it has counted when it has so many words or keys.
HELD_WORDS, HELD_KEYS = 1 << 17, 1 << 20
#: Words in a row's array, more only if no piece ends: the JVM copes badly with rows of megabytes. A row has up to 20 bytes a word, so the
#: readers, which else hold 4096 rows at once, take READ_ROWS of them, and what goes to Python at once is bounded by BATCH_BYTES.
ARRAY, READ_ROWS, BATCH_BYTES = 1 << 15, 64, 4 << 20
#: Sums meet in so many parts before they meet in one.
FAN = 16
#: Separators of pieces become full stops, tabs blanks.
MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")


def tokens(text: bytes) -> list[bytes]:
    """Words, and a full stop for each separator."""
    return text.lower().translate(MARKS).replace(b".", b" . ").split()


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 hashed bits of integers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_levels(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hash of a set of distinct keys: at each level the keys that are alone at their place get their bit, the others go on to
    the next; (words of bits, slots before each word) per level."""
    levels, placed = [], 0
    while len(keys):
        size = max(64, 1 << int(2 * len(keys) - 1).bit_length())
        at = (mixed(keys, len(levels)) & np.uint64(size - 1)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words = np.packbits(alone, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        levels.append((words, placed + np.cumsum(ones) - ones))
        placed += int(ones.sum())
        keys = keys[~alone[at]]
    return levels


class Slots:
    """Shards of minimal perfect hashes with their keys, for lookups of many keys at once."""

    def __init__(self, shards: dict[int, tuple[list, np.ndarray]], n_shards: int):
        self.n_shards, self.order = n_shards, sorted(shards)
        self.start = np.full(n_shards, -1, np.int64)
        self.size = {x: len(shards[x][1]) for x in shards}
        self.base, at = {}, 0
        for x in self.order:
            self.start[x], self.base[x] = at, at
            at += len(shards[x][1])
        self.keys = np.concatenate([shards[x][1] for x in self.order] or [np.empty(0, np.int64)])
        self.levels = []
        for level in range(max((len(shards[x][0]) for x in self.order), default=0)):
            offset, mask, words, ranks, n = np.full(n_shards, -1, np.int64), np.zeros(n_shards, np.uint64), [], [], 0
            for x in self.order:
                if level < len(shards[x][0]):
                    w, r = shards[x][0][level]
                    offset[x], mask[x] = n, 64 * len(w) - 1
                    words.append(w)
                    ranks.append(r)
                    n += len(w)
            self.levels.append((offset, mask, np.concatenate(words), np.concatenate(ranks)))

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """The slots that keys have if they are in the set, counted through all shards; -1 where it is plain that they aren't."""
        out = np.full(len(keys), -1, np.int64)
        shard = shard_of(keys, self.n_shards)
        left = np.flatnonzero(self.start[shard] >= 0)
        for seed, (offset, mask, words, ranks) in enumerate(self.levels):
            left = left[offset[shard[left]] >= 0]
            own = shard[left]
            at = mixed(keys[left], seed) & mask[own]
            word, bit = offset[own] + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (words[word] >> bit) & np.uint64(1) == 1
            hit = word[found]
            below = words[hit] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[left[found]] = self.start[own[found]] + ranks[hit] + np.bitwise_count(below)
            left = left[~found]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 where the key stored there is another."""
        out = self.rank(keys)
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return (mixed(keys, 97) % np.uint64(n_shards)).astype(np.int64)


def packed(index: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places and their counts; bytes of equal weight stand together, as most of the higher ones are 0."""
    steps = np.diff(index, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return steps.tobytes() + counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    steps = np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T
    counts = np.frombuffer(data, np.uint8, 8 * n, 4 * n).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.int64), np.ascontiguousarray(counts).view("<i8").ravel()


def chunked(index: np.ndarray, counts: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, data) of sorted places."""
    cut = np.flatnonzero(np.diff(index // width, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(index)], strict=True):
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([int(index[a]) // width], pa.int64()), "data": pa.array([packed(index[a:b] % width, counts[a:b])], pa.binary())})


def tree_sum(parts: DataFrame, width: int) -> DataFrame:
    """(chunk, data) summed per chunk: in FAN parts first, then these; rows are added one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(width, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if last is not None:
                index = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([last[0]], pa.int64()), "part": pa.array([last[1]], pa.int32()), "data": pa.array([packed(index, total[index])], pa.binary())})

        for x in batches:
            for chunk, part, data in zip(x["chunk"].to_pylist(), x["part"].to_pylist(), x["data"], strict=True):
                if last != (chunk, part):
                    yield from done()
                    last = (chunk, part)
                    total[:] = 0
                index, counts = unpacked(data.as_buffer().to_pybytes())
                total[index] += counts
        yield from done()

    shape = "chunk long, part int, data binary"
    first = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    first = first.repartition("chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(run, shape)
    return first.withColumn("part", F.lit(0)).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, shape).drop("part")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, a): occurrences per lang; the row with word null has those of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for x in batches:
            for lang, text in zip(x["lang"].to_pylist(), x["text"], strict=True):
                found.setdefault(lang, Counter()).update(tokens(text.as_buffer().to_pybytes()))
            if sum(map(len, found.values())) > HELD_WORDS:
                yield from rows(found)
                found = {}
        yield from rows(found)

    def rows(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            counts.pop(b".", None)
            words = [*counts, None]
            a = [*counts.values(), sum(counts.values())]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(a), pa.string()), "word": pa.array(words, pa.binary()), "a": pa.array(a, pa.int64())})

    return docs.mapInArrow(run, "lang string, word binary, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def numbered(docs: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """(words): the texts of several rows as one array of int32 word numbers, cut by 0. A dictionary of at most WORDS words (about)
    is broadcast at a time; where there are more, each pass adds the numbers of one dictionary's words."""
    spark, rounds = docs.sparkSession, -(-n_words // WORDS) or 1
    state = docs.withColumn("ids", F.lit(None).cast("binary"))
    for k in range(rounds):
        part = words.where(F.pmod(F.xxhash64("word", "lang"), F.lit(rounds)) == k).select("lang", "word", "id").toArrow()
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, at in zip(*(part[c].to_pylist() for c in part.column_names), strict=True):
            known.setdefault(lang, {})[word] = at + 1
        shared, last = spark.sparkContext.broadcast(known), k == rounds - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for x in batches:
                out = []
                for lang, text, before in zip(x["lang"].to_pylist(), x["text"], x["ids"].to_pylist(), strict=True):
                    own = tokens(text.as_buffer().to_pybytes())
                    ids = np.fromiter(map(shared.value.get(lang, {}).get, own, repeat(0)), np.int32, len(own))
                    out.append(ids if before is None else ids + np.frombuffer(before, np.int32))
                if last:
                    yield from gathered(out)
                else:
                    yield pa.RecordBatch.from_pydict({"lang": x["lang"], "text": x["text"], "ids": pa.array([y.tobytes() for y in out], pa.binary())})

        state = materialize(state.mapInArrow(run, "words binary" if last else "lang string, text binary, ids binary"), "phrases")
    return state


def gathered(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Arrays as one without repetitions of zeros, cut off by a zero, and dealt to rows at zeros."""
    whole = np.concatenate([y for x in arrays for y in (x, np.zeros(1, np.int32))] or [np.zeros(1, np.int32)])
    whole = whole[(whole > 0) | (np.append(whole[1:], 0) > 0)].astype(np.int32)
    ends, at = np.flatnonzero(whole == 0), 0
    while at < len(whole):
        after = np.searchsorted(ends, at + ARRAY)
        to = int(ends[after]) if after < len(ends) else len(whole)
        yield pa.RecordBatch.from_pydict({"words": pa.array([whole[at:to].tobytes()], pa.binary())})
        at = to


def steps(batches: Iterator[pa.RecordBatch], k: int, n_words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(words, slots, places, keys) of each row: where the first and the last k-1 of k words are frequent, and the phrases' keys."""
    for x in batches:
        for row in range(x.num_rows):
            words = np.frombuffer(x["words"][row].as_buffer(), np.int32)
            slots = words.astype(np.int64) - 1 if k == 2 else np.frombuffer(x["slots"][row].as_buffer(), np.int64)
            at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
            yield words, slots, at, slots[at] * n_words + words[at + k - 1]


def heavy(walk: DataFrame, k: int, n_words: int, buckets: int, least: int) -> np.ndarray:
    """A bit per bucket of keys: whether `least` occurrences or more fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for _, _, _, keys in steps(batches, k, n_words):
            own.append((mixed(keys, 98) & np.uint64(buckets - 1)).astype(np.int64))
            size += len(keys)
            if size > HELD_KEYS:
                yield from chunked(*np.unique(np.concatenate(own), return_counts=True), min(buckets, CHUNK))
                own, size = [], 0
        if size:
            yield from chunked(*np.unique(np.concatenate(own), return_counts=True), min(buckets, CHUNK))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for chunk, data in zip(x["chunk"], x["data"], strict=True):
                index, counts = unpacked(data.as_py())
                bits = np.zeros(min(buckets, CHUNK), bool)
                bits[index[counts >= least]] = True
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk.as_py()], pa.int64()), "data": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    width = min(buckets, CHUNK)
    out = np.zeros(buckets // 8, np.uint8)
    for chunk, data in tree_sum(walk.mapInArrow(run, "chunk long, data binary"), width).mapInArrow(flags, "chunk long, data binary").collect():
        out[chunk * width // 8 : (chunk + 1) * width // 8] = np.frombuffer(data, np.uint8)
    return out


def candidates(walk: DataFrame, k: int, n_words: int, flags: np.ndarray) -> DataFrame:
    """(key, suffix): the distinct phrases in frequent buckets; suffix is the slot of the last k-1 words."""
    shared, mask = walk.sparkSession.sparkContext.broadcast(flags), np.uint64(8 * len(flags) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slots, at, keys in steps(batches, k, n_words):
            bucket = mixed(keys, 98) & mask
            good = shared.value[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1 == 1
            own, first = np.unique(keys[good], return_index=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(own, pa.int64()), "suffix": pa.array(slots[at[good][first] + 1], pa.int64())})

    return walk.mapInArrow(run, "key long, suffix long").groupBy("key").agg(F.min("suffix").alias("suffix"))


def hashed(found: DataFrame, n_shards: int) -> DataFrame:
    """(shard, size, data): each shard's hash with keys and suffixes by slot, built in a task of its own."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(np.asarray(x["key"]), n_shards), pa.int64()), x["key"], x["suffix"]], names=["shard", "key", "suffix"])

    def build(x: pa.Table) -> pa.Table:
        keys, suffix = x["key"].to_numpy(), x["suffix"].to_numpy()
        if len(keys) > SLOTS:
            raise ValueError(f"a shard has {len(keys)} keys")
        levels = bit_levels(keys)
        by_slot, suffixes = np.empty_like(keys), np.empty_like(suffix)
        slots = Slots({0: (levels, keys)}, 1).rank(keys)
        by_slot[slots], suffixes[slots] = keys, suffix
        return pa.table({"shard": x["shard"][:1], "size": pa.array([len(keys)], pa.int64()), "data": pa.array([pickle.dumps((levels, by_slot, suffixes))], pa.binary())})

    return found.mapInArrow(shards, "shard long, key long, suffix long").groupBy("shard").applyInArrow(build, "shard long, size long, data binary")


def counted(walk: DataFrame, k: int, n_words: int, slots: Slots) -> DataFrame:
    """(shard, data): occurrences by slot of the round's shards."""
    shared = walk.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        total = np.zeros(len(table.keys), np.int64)
        for _, _, _, keys in steps(batches, k, n_words):
            found = table.find(keys)
            total += np.bincount(found[found >= 0], minlength=len(total))
        for shard in table.order:
            own = total[table.base[shard] :][: table.size[shard]]
            index = np.flatnonzero(own)
            if len(index):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([shard], pa.int64()), "data": pa.array([packed(index, own[index])], pa.binary())})

    return tree_sum(walk.mapInArrow(run, "chunk long, data binary"), SLOTS).withColumnRenamed("chunk", "shard")


def frequent(hashes: DataFrame, counts: DataFrame, n_words: int, least: int) -> DataFrame:
    """(id, prefix, suffix, a) of the phrases that `least` slots' counts reach; prefix and suffix are ids of one word less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for shard, data, own in zip(x["shard"].to_pylist(), x["data"], x["counts"], strict=True):
                _, keys, suffix = pickle.loads(data.as_buffer())
                index, a = unpacked(own.as_py())
                index, a = index[a >= least], a[a >= least]
                yield pa.RecordBatch.from_pydict({"id": pa.array(shard * SLOTS + index), "prefix": pa.array(keys[index] // n_words), "suffix": pa.array(suffix[index]), "a": pa.array(a)})

    both = hashes.select("shard", "data").join(counts.withColumnRenamed("data", "counts"), "shard")
    return both.mapInArrow(run, "id long, prefix long, suffix long, a long")


def advanced(walk: DataFrame, k: int, n_words: int, slots: Slots, ids: np.ndarray, last: bool) -> DataFrame:
    """(words, slots, found): the walk with the ids of frequent phrases of k words at the places where they begin. Other rounds'
    are taken from found; the last round makes found the slots."""
    shared = walk.sparkSession.sparkContext.broadcast((slots, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids = shared.value
        for x in batches:
            for row, (words, before, at, keys) in enumerate(steps([x], k, n_words)):
                known = x["found"][row].as_buffer()
                now = np.full(len(words), -1, np.int64) if known is None else np.frombuffer(known, np.int64).copy()
                found = table.find(keys)
                now[at[found >= 0]] = np.maximum(now[at[found >= 0]], ids[found[found >= 0]])
                if not last or ((now[:-1] >= 0) & (now[1:] >= 0)).any():
                    yield pa.RecordBatch.from_pydict({"words": pa.array([words.tobytes()], pa.binary()), "slots": pa.array([(now if last else before).tobytes()], pa.binary()), "found": pa.array([None if last else now.tobytes()], pa.binary())})

    return walk.mapInArrow(run, "words binary, slots binary, found binary")


@contextmanager
def small_batches(spark) -> Iterator[None]:
    """Within it, batches that are read and that go to Python are bounded by rows and bytes; results don't depend on it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), and per length 1 .. longest the frequent phrases: (id, lang, phrase, a, prefix, suffix, firsts, lasts), where firsts
    and lasts are the counts of the first and the last 1 .. k-1 words. All are written tables."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        every = materialize(word_counts(texts).where((F.col("a") >= least) | F.col("word").isNull()), "phrases")
        totals, words = every.where("word IS NULL").select("lang", F.col("a").alias("n")), every.where("word IS NOT NULL")
        n, all_words = words.count(), totals.agg(F.sum("n")).first()[0] or 0
        shards = n // SHARD + 1
        own = words.withColumn("shard", F.pmod(F.xxhash64("lang", "word"), F.lit(shards)))
        at = F.row_number().over(Window.partitionBy("shard").orderBy("lang", "word")) - 1
        empty = F.array().cast("array<long>")
        none = F.lit(None).cast("long")
        level = materialize(own.select((F.col("shard") * SLOTS + at).alias("id"), "lang", F.col("word").cast("string").alias("phrase"), "word", "a", none.alias("prefix"), none.alias("suffix"), empty.alias("firsts"), empty.alias("lasts")), "phrases")
        n_words = shards * SLOTS + 1
        walk = numbered(texts, level.select("lang", "word", "id"), n).withColumn("slots", F.lit(None).cast("binary")).withColumn("found", F.lit(None).cast("binary"))
        levels = [level.drop("word")]
        buckets = 1 << min(max(1 << 16, all_words // 8).bit_length(), MOST_BUCKETS.bit_length() - 1)
        for k in range(2, longest + 1):
            found = materialize(candidates(walk, k, n_words, heavy(walk, k, n_words, buckets, least)), "phrases")
            n_shards = found.count() // SHARD + 1
            hashes = materialize(hashed(found, n_shards), "phrases")
            here, tables = None, []
            for first in range(0, n_shards, ROUND):
                part = hashes.where(F.col("shard").between(first, first + ROUND - 1))
                slots = Slots({x: pickle.loads(data)[:2] for x, data in part.select("shard", "data").collect()}, n_shards)
                counts = materialize(counted(walk, k, n_words, slots), "phrases")
                tables.append(materialize(frequent(part, counts, n_words, least), "phrases"))
                if k < longest:
                    ids = np.full(len(slots.keys), -1, np.int64)
                    own = tables[-1].select("id").toArrow()["id"].to_numpy()
                    ids[np.array([slots.base.get(x, 0) for x in range(n_shards)])[own // SLOTS] + own % SLOTS] = own
                    here = materialize(advanced(walk if here is None else here, k, n_words, slots, ids, first + ROUND >= n_shards), "phrases")
            walk = here
            level = tables[0]
            for x in tables[1:]:
                level = level.union(x)
            before = levels[-1].select("id", "lang", "phrase", "a", "firsts", "lasts")
            p = before.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"), F.concat("firsts", F.array("a")).alias("firsts"))
            s = before.select(F.col("id").alias("suffix"), F.substring_index("phrase", " ", -1).alias("tail"), F.concat("lasts", F.array("a")).alias("lasts"))
            level = level.join(p, "prefix").join(s, "suffix").select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a", "prefix", "suffix", "firsts", "lasts")
            levels.append(materialize(level, "phrases"))
    return totals, levels


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of docs(text, lang) by their lowest-scoring cut."""
    totals, levels = mined(docs, least, longest)
    rows = None
    for k, level in enumerate(levels[1:], 2):
        if k <= len(levels) - 1:  # a longer phrase of nearly the same count: one of one word more is enough to look at, as counts fall with length
            above = levels[k]
            longer = above.select(F.col("prefix").alias("id"), "a").union(above.select("suffix", "a")).groupBy("id").agg(F.max("a").alias("longer"))
            level = level.join(longer, "id", "left").where(f"longer IS NULL OR 100 * longer < {percent} * a")
        cuts = [F.struct(F.lit(j).alias("cut"), F.col("firsts")[j - 1].alias("l"), F.col("lasts")[k - j - 1].alias("r")) for j in range(1, k)]
        one = level.select("lang", "phrase", "a", F.array(*cuts).alias("cuts"))
        rows = one if rows is None else rows.union(one)
    big = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    scored = rows.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumn("m", F.expr(f"array_min(transform(cuts, x -> struct(({big(1000)} * a * n) div ({big('x.l')} * x.r) AS score, x.cut, x.l, x.r)))"))
    flat = scored.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = flat.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
