"""Removal of repeated passages by suffix arrays.

Texts are UTF-8 bytes. Every byte covered by a SPAN-byte string that also starts anywhere else (same text included) goes; all
occurrences count, and strings are judged on the input.

Where to look: every SPAN-byte window keeps the least hash of its GRAM-byte pieces (of equal ones the last); equal windows
keep equal pieces at equal places, so a window can only repeat if its piece's hash occurs twice. The windows in a row that
keep one such piece make a region. Regions go to shards by their piece, so all equal windows meet in a shard.

Each shard sorts the suffixes of its distinct regions as Larsson and Sadakane do: groups of equal first bytes are refined
by the rank of the suffix as many bytes further on, 8, 16, ... 128 and then SPAN, and only groups not yet single are touched.
Common prefixes of neighbours come from Kasai's walk through the text, taken through all regions side by side, up to SPAN bytes.
A window repeats if it shares SPAN bytes with a neighbour.

A piece with more than SPLIT occurrences is spread over several shards. Each of them gives every distinct window of such a
piece as a 128-bit digest: with its place if it found no partner there, else once, counted as two. Spark adds the counts up
over the shards, and a window whose sum exceeds one goes wherever it had no partner. (Searching every such shard's sorted array
for the windows of each other one gives the same, but grows with the square of the shards.)

Texts that occur more than once are handled once and go whole if they have SPAN bytes; their rows are dealt out by a salt. Null and empty texts have no bytes.
Columns of docs are not kept but doc_id (any value, null too). Repeated rows get equal results, one row each; two rows with
equal doc_id and text are two occurrences. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import materialize, maybe_broadcast

SPAN, GRAM = 200, 32
WINDOW = SPAN - GRAM + 1
SPLIT = 2000
#: Rows of a text with more than SPLIT copies are dealt to SALTS tasks; texts of that kind (20 bytes each) that may be broadcast.
SALTS, BROADCAST_HOT = 64, 1_000_000
SHARD_BYTES = 4_000_000
PLACE_BITS = 24
CHUNK = (1 << PLACE_BITS) - 4 * SPAN

_BYTES = np.random.default_rng(20240502).integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _regions(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece hash, first window, last window) of each run of windows that keep one piece."""
    if len(data) < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, factor, size = _BYTES[data], _FACTOR, 1
    while size < GRAM:  # hashes of twice the length from two halves
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor % 2**64, size * 2
    h = _mix(h)
    prints, firsts, lasts = [], [], []
    windows = len(data) - SPAN + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, windows, CHUNK):
        part = h[at : at + CHUNK + WINDOW - 1]
        m = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        width = 1
        while width * 2 <= WINDOW:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: len(part) - WINDOW + 1], m[WINDOW - width :])
        kept = (low - (m & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]]))
        prints.append(part[kept[first]])
        firsts.append(first + at)
        lasts.append(np.append(first[1:], len(kept)) - 1 + at)
    return np.concatenate(prints), np.concatenate(firsts), np.concatenate(lasts)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(print, id, at, own): own stands for text and place, so that copies of a text count once."""
    for x in batches:
        rows, held = [], 0
        for key, th, text in zip(x["id"], x["t1"], x["text"], strict=True):
            h, first, _ = _regions(np.frombuffer(_bytes(text), np.uint8))
            if len(h):
                own = _mix(first.astype(np.uint64) * np.uint64(_FACTOR) + np.uint64(th % 2**64))
                rows.append(pd.DataFrame({"print": h.view(np.int64), "id": key, "at": first.astype(np.int32), "own": own.view(np.int64)}))
                held += len(h)
            if held > 200_000:
                yield pd.concat(rows)
                rows, held = [], 0
        if rows:
            yield pd.concat(rows)


def _cut(shards: int):
    """Regions of a text that hold repeated pieces, each distinct one once with all its places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows, held = [], 0
            for t1, t2, text, ats, ns in zip(x["t1"], x["t2"], x["text"], x["ats"], x["ns"], strict=True):
                data = _bytes(text)
                h, first, last = _regions(np.frombuffer(data, np.uint8))
                many = dict(zip(np.asarray(ats).tolist(), np.asarray(ns).tolist(), strict=True))
                seen: dict[bytes, list[int]] = {}
                info = {}
                for p, a, b in zip(h.tolist(), first.tolist(), last.tolist(), strict=True):
                    if a in many:
                        region = data[a : b + SPAN]
                        seen.setdefault(region, []).append(a)
                        info[region] = p, many[a]
                for region, places in seen.items():
                    p, n = info[region]
                    salts = -(-n // SPLIT)
                    rows.append((hash((p, (t1 ^ t2) % salts)) % shards, t1, t2, places, region, salts > 1))
                    held += len(region) + 8 * len(places)
                if held > 16_000_000:
                    yield pd.DataFrame(rows, columns=["shard", "t1", "t2", "places", "region", "split"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["shard", "t1", "t2", "places", "region", "split"])

    return run


def suffix_array(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at starts, sorted by their first SPAN bytes, and at each place of data the 8 bytes that begin there.

    data ends in 2 * SPAN bytes that no start reaches."""
    n = len(data) - SPAN
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | data[i : i + n].astype(np.uint64)
    order = np.argsort(key)

    def ranked(changed: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))

    slot = ranked(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    rank = np.zeros(n + SPAN, np.int64)
    rank[order] = slot
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    # a round reads ranks at a place and step bytes on, so each needs only the places that the rounds after it read
    steps, needed = (8, 16, 32, 64, 72), [wanted]
    for step in steps[:0:-1]:
        needed.append(needed[-1].copy())
        needed[-1][step:] |= needed[-2][:-step]
    spot = np.arange(n)  # the slot's number among all places; ranks are such numbers
    for step in steps:
        keep = needed.pop()[order]
        order, slot, spot = order[keep], slot[keep], spot[keep]
        alone = np.concatenate([slot[1:] != slot[:-1], [True]]) & np.concatenate([[True], slot[1:] != slot[:-1]])
        open_ = np.flatnonzero(~alone)  # slots of groups that hold several suffixes
        if not len(open_):
            break
        at = order[open_]
        by = slot[open_].astype(np.uint64) << np.uint64(32) | rank[at + step].astype(np.uint64)
        turned = np.argsort(by, kind="stable")
        order[open_], by = at[turned], by[turned]
        new = ranked(np.concatenate([[True], by[1:] != by[:-1]]))
        slot[open_] = spot[open_][new]
        rank[order[open_]] = slot[open_]
    return order[wanted[order]], key


def common_prefixes(order: np.ndarray, key: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many bytes (SPAN at most) each suffix of order shares with the one before it; the first with none.

    Kasai's walk: if the suffix at i shares h bytes with the one before it in order, that at i + 1 shares h - 1 or more with its
    own, provided that the earlier one's next suffix stands before it in order; else the count begins anew. All regions
    (counts[r] suffixes from begins[r] on) take their step at once."""
    place = np.full(len(key) + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    found = np.zeros(len(order), np.int64)
    turned = np.argsort(-counts, kind="stable")
    begins, counts = begins[turned], counts[turned]
    h, before = np.zeros(len(begins), np.int64), np.full(len(begins), len(key), np.int64)
    for i in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -i, "left"))  # regions with more than i suffixes
        at = begins[:live] + i
        r = place[at]
        follows = place[np.minimum(before[:live] + 1, len(key))]
        h = np.where((follows >= 0) & (follows < r), np.maximum(h[:live] - 1, 0), 0)
        before = np.where(r > 0, order[r - 1], len(key))
        todo = np.flatnonzero((r > 0) & (h < SPAN))
        while len(todo):
            x = key[at[todo] + h[todo]] ^ key[before[todo] + h[todo]]
            same = (x == 0).astype(np.int64)
            for bits in range(8, 64, 8):  # leading bytes that agree
                same += x < np.uint64(1 << bits)
            h[todo] = np.minimum(h[todo] + same, SPAN)
            todo = todo[(same == 8) & (h[todo] < SPAN)]
        found[r] = np.where(r > 0, h, 0)
    return found


def repeated(regions: list[bytes], times: list[int]) -> list[np.ndarray]:
    """For each distinct region, which of its windows occur in another place; times: how often the region itself occurs."""
    data = np.frombuffer(b"".join(regions) + bytes(3 * SPAN), np.uint8)
    sizes = np.array([len(r) for r in regions], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    valid = np.zeros(len(data), bool)
    for b, e in zip(begins, ends, strict=True):
        valid[b : e - SPAN + 1] = True
    order, key = suffix_array(data, np.flatnonzero(valid))
    full = np.flatnonzero(common_prefixes(order, key, begins, ends - begins - SPAN + 1) >= SPAN)
    dup = np.zeros(len(data), bool)
    dup[order[full]] = True
    dup[order[full - 1]] = True
    return [np.ones(e - b - SPAN + 1, bool) if t > 1 else dup[b : e - SPAN + 1] for b, e, t in zip(begins, ends, times, strict=True)]


def _shard(x: pd.DataFrame) -> pd.DataFrame:
    """(t1, t2, first, last, digest, n): runs of repeated windows, and for the merge across shards the digests of split pieces'
    windows: n is 1 for those single here, with their place, and 2 for those repeated here, once each and without a place."""
    number: dict[bytes, int] = {}
    times: list[int] = []
    which = []
    for region, places in zip(x["region"], x["places"], strict=True):
        i = number.setdefault(region, len(number))
        if i == len(times):
            times.append(0)
        times[i] += len(places)
        which.append(i)
    regions = list(number)
    flags = repeated(regions, times)
    runs = []
    for f in flags:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
        runs.append((edge[::2].tolist(), (edge[1::2] - 1).tolist()))

    def digest(i: int, s: int) -> bytes:
        return hashlib.blake2b(regions[i][s : s + SPAN], digest_size=16).digest()

    rows = []
    spread: set[int] = set()
    for i, t1, t2, places, split in zip(which, x["t1"], x["t2"], x["places"], x["split"], strict=True):
        for p in places:
            rows += [(t1, t2, p + a, p + b, None, 0) for a, b in zip(*runs[i], strict=True)]
        if split:
            spread.add(i)
            rows += [(t1, t2, places[0] + s, places[0] + s, digest(i, s), 1) for s in np.flatnonzero(~flags[i]).tolist()]
    here = {digest(i, s) for i in spread for s in np.flatnonzero(flags[i]).tolist()}
    rows += [(0, 0, 0, 0, d, 2) for d in here]
    return pd.DataFrame(rows, columns=["t1", "t2", "first", "last", "digest", "n"])


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = []
        for t1, t2, text, runs in zip(x["t1"], x["t2"], x["text"], x["runs"], strict=True):
            data = _bytes(text)
            steps = np.zeros(len(data) + 1, np.int64)
            np.add.at(steps, [r["first"] for r in runs], 1)
            np.add.at(steps, [r["last"] + SPAN for r in runs], -1)
            gone = np.cumsum(steps[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((t1, t2, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
        yield pd.DataFrame(rows, columns=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with_kept the remaining bytes as kept."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit("suffix"), "text")).withColumn("id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000")), "text"))
    long = rows.where(F.octet_length("text") >= SPAN)
    # read twice; making them anew costs several times what writing them does
    prints = materialize(long.select("id", "t1", "text").mapInPandas(_prints, "print long, id long, at int, own long"), "prints")
    twice = prints.groupBy("print").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.count("*").alias("n")).where("a <> b").select("print", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"))
    # written out, so that both sides of the join come from exchanges of their own and a hot piece's rows can be split
    twice = materialize(twice, "twice")
    hits = prints.select("print", "id", "at").join(twice, "print").groupBy("id").agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    one = materialize(long.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "one")
    mine = materialize(hits.join(one, "id").select("id", F.col("hits.at").alias("ats"), F.col("hits.n").alias("ns")), "hits")
    pieces = mine.agg(F.coalesce(F.sum(F.size("ats")), F.lit(0))).first()[0]
    shards = max(64, int(pieces * (WINDOW // 2 + SPAN) / SHARD_BYTES))
    texts = long.select("id", "t1", "t2", "text").join(mine, "id").dropDuplicates(["id"])
    texts = materialize(texts, "texts")
    regions = texts.mapInPandas(_cut(shards), "shard int, t1 long, t2 long, places array<int>, region binary, split boolean")
    found = materialize(regions.groupBy("shard").applyInPandas(_shard, "t1 long, t2 long, first int, last int, digest binary, n int"), "runs")
    spread = found.where("digest IS NOT NULL")
    often = spread.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    merged = spread.where("n = 1").join(often, "digest", "left_semi").select("t1", "t2", "first", "last")
    runs = found.where("digest IS NULL").select("t1", "t2", "first", "last").union(merged).groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = texts.select("t1", "t2", "text").join(runs, ["t1", "t2"]).mapInPandas(_removed, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    result = one.select("t1", "t2", "copies").join(cut if with_kept else cut.drop("kept"), ["t1", "t2"], "left").where("copies > 1 OR n_removed IS NOT NULL")
    whole = F.col("copies") > 1
    empty = F.sha2(F.lit("").cast("binary"), 256)
    own = rows.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("full_sha256"), *([F.col("text").cast("binary").alias("full")] if with_kept else []))
    # rows of a text with very many copies go to several tasks; there are few such texts, as each has SPLIT rows and more
    hot = one.where(F.col("copies") > SPLIT).select("t1", "t2", F.lit(SALTS).alias("salts"))
    salt = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.coalesce("salts", F.lit(1))).cast("int")
    own = own.join(maybe_broadcast(hot, BROADCAST_HOT), ["t1", "t2"], "left").withColumn("salt", salt).drop("salts")
    spread_out = F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > SPLIT, SALTS - 1).otherwise(0)))
    joined = own.join(result.withColumn("salt", spread_out), ["t1", "t2", "salt"], "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("kept_sha256", "full_sha256")).alias("kept_sha256"),
        *([F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "full")).alias("kept")] if with_kept else []),
    )
