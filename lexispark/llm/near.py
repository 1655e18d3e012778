"""Near-duplicate documents by SetSketch registers.

A document's set: the distinct shingles of `words` words (pieces between ASCII white space, A-Z lower-cased); with fewer
words the whole sequence is its one shingle; without words it is empty and linked with nothing. Documents are linked if
intersection >= threshold * union. Components of the links get their smallest doc_id; that document stays.

Documents with equal sets form a class, so copies are never paired. Each class has REGISTERS registers: the minimum of its
shingles' hashes as an exponential value, on a scale of powers of BASE and cut off at both ends. Such registers merge by
maximum and agree about as often as sets do. BANDS bands of ROWS registers are joined on: at a similarity of 0.85 a pair
misses all of them with probability (1 - 0.85^4)^30 = 2e-10. Candidates are rated by the likelihood of their registers'
order given both set sizes; those rated below threshold - SLACK (six standard errors) are given up, all others are
verified on full sets.

No band's group is paired out. First each member meets the group's leader (smallest by one hash for all bands). Two members
of one component need no further comparison. Those that are then outside their cluster's largest component meet the others
in blocks of bounded size, inside tasks that return only a forest of links; this makes the links complete.

Nulls: a null text has no words; a doc_id that is null or no integer is linked with nothing (its component_id is null, it is
kept). Rows that repeat a doc_id are one node. Columns of docs are kept, whatever their names; n_shingles, component_id, kept
replace columns of that name. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import bounded_batches, components, fresh, kept, materialize, small_join

BANDS, ROWS = 30, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
SLACK = 0.2
CHUNK = 4096
#: The most sets, and shingles, of a block that meets another one in a task (about; hashing deals them out).
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000
#: What a group costs besides its pairs, as so many pairs.
GROUP_COST = 500.0
#: Ids that may be broadcast to pick texts, and clusters (or their size classes), of which one plan has several; more of them are
#: shuffled. A row takes the driver some hundred bytes, more than once. FILTER_IDS hashes (8 bytes each) may go to the tasks.
BROADCAST_IDS, BROADCAST_CLUSTERS, FILTER_IDS = 50_000, 20_000, 2_000_000

_RANDOM = np.random.default_rng(20240501)
_BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**64, REGISTERS, dtype=np.uint64)
_PART = _RANDOM.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the text."""
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]])))
    powers = np.full(int((ends - starts).max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = np.where(solid, _BYTES[data] * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    return _mix(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's set of shingles."""
    w = word_hashes(text)
    k = min(words, len(w))
    if k == 0:
        return w
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mix(h + w[i : i + n] * _PART[i % len(_PART)])
    return np.unique(h)


def registers(h: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes; the sketch of a union is the maximum of sketches."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), CHUNK):
        np.minimum(least, (np.multiply.outer(h[at : at + CHUNK], _TIMES) + _PLUS).min(0), out=least)
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def likely(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely similarity, given in how many registers the first set's is greater and less, and both set sizes."""
    u, v = n / (n + m), m / (n + m)
    same = REGISTERS - more - less
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = fit(a) < fit(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def _sketch(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            n, d1, d2, regs, bands = [], [], [], [], []
            for text in x["text"]:
                h = shingles(text, words)
                n.append(len(h))
                d1.append(int(np.add.reduce(_mix(h + np.uint64(1))).astype(np.int64)) if len(h) else 0)
                d2.append(int(np.bitwise_xor.reduce(_mix(h ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64)) if len(h) else 0)
                if len(h):
                    r = registers(h)
                    regs.append(r.tobytes())
                    band = np.arange(BANDS, dtype=np.uint64)
                    for row in r.reshape(BANDS, ROWS).T.astype(np.uint64):
                        band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + row)
                    bands.append(band.view(np.int64))
                else:
                    regs.append(None)
                    bands.append(None)
            yield pd.DataFrame({"doc_id": x["doc_id"], "th": x["th"], "n": n, "d1": d1, "d2": d2, "regs": regs, "bands": bands})

    return run


def _rated(threshold: float):
    def run(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        return pd.Series(likely((x > y).sum(1), (x < y).sum(1), n.to_numpy(float), m.to_numpy(float)) >= threshold - SLACK)

    return run


def _verify(words: int, percent: int):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, first = [], object(), None
        for x, y in zip(a, b, strict=True):
            if x is not last and x != last:
                last, first = x, shingles(x, words)
            other = shingles(y, words)
            both = len(np.intersect1d(first, other, assume_unique=True))
            out.append(100 * both >= percent * (len(first) + len(other) - both))
        return pd.Series(out, dtype=bool)

    return run


def _block_links(words: int, percent: int):
    """Of the texts of two blocks (or of one, side by side with itself) the links between different components, as a forest."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates(["id", "side"])
        sets = {i: shingles(t, words) for i, t in zip(x["id"], x["text"], strict=True)}
        part = dict(zip(x["id"], x["component"], strict=True))
        left, right = x["id"][x["side"] == 0].tolist(), x["id"][x["side"] == 1].tolist() or x["id"].tolist()
        sizes = np.array([len(sets[i]) for i in right])
        owner = np.repeat(np.arange(len(right)), sizes)
        pool = np.concatenate([sets[i] for i in right])
        order = np.argsort(pool, kind="stable")
        pool, owner = pool[order], owner[order]
        up: dict = {}

        def root(c):
            while up.get(c, c) != c:
                up[c] = up.get(up[c], up[c])
                c = up[c]
            return c

        rows = []
        for a in left:
            own = sets[a]
            low, high = np.searchsorted(pool, own, "left"), np.searchsorted(pool, own, "right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(right))
            for k in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
                p, q = root(part[a]), root(part[right[k]])
                if p != q:
                    up[p] = q
                    rows.append((a, right[k]))
        return pd.DataFrame(rows, columns=["a", "b"])

    return run


def _mixed(rows: DataFrame) -> DataFrame:
    """(cluster, main, pairs) of rows(cluster, component): groups of several components, their largest one, and how many pairs its
    strays make with all members."""
    parts = rows.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    per = parts.groupBy("cluster").agg(F.max(F.struct("size", "component")).alias("m"), F.sum("size").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    return materialize(per.select("cluster", F.col("m.component").alias("main"), ((F.col("all") - F.col("m.size")) * F.col("all").cast("double") + GROUP_COST).alias("pairs")), "mixed")


def _rest(rows: DataFrame, classes: DataFrame, members: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that the leaders have missed: between different components of `found` that share groups.

    Candidates that hang together through groups are a cluster. Its largest component is the main one, the others are
    strays. Strays meet the members of their cluster, or of their groups where that makes fewer pairs (boilerplate can chain very many
    different texts into one cluster, of which few share a group). Members are dealt into blocks by size class and hash; every block of
    strays meets the blocks of the same and the next size class (sets more than one class apart cannot be linked), each pair of blocks
    in a task of bounded size that counts all intersections and returns a spanning forest of the links. So rows between tasks are
    members per block, never pairs of members."""
    loose = components(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    placed = loose.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialize(placed.join(classes.select("id", "th", "n"), "id"), "placed")
    mixed = _mixed(placed)
    inside = small_join(placed, mixed.select("cluster"), ["cluster"], BROADCAST_CLUSTERS)
    grouped = materialize(inside.join(members.select("id", "band"), "id").select("id", "th", "n", "component", F.col("cluster").alias("whole"), F.col("band").alias("cluster")), "grouped")
    mixed_groups = _mixed(grouped)
    cost = small_join(grouped.select("cluster", "whole").distinct(), mixed_groups, ["cluster"], BROADCAST_CLUSTERS).groupBy(F.col("whole").alias("cluster")).agg(F.sum("pairs").alias("by_group"))
    by_group = materialize(mixed.join(cost, "cluster", "left").select("cluster", (F.coalesce("by_group", F.lit(0.0)) < F.col("pairs")).alias("groups")), "choice")
    own = ["id", "th", "n", "cluster", "component"]
    whole = small_join(inside.select(*own), by_group.where("NOT groups").join(mixed, "cluster").select("cluster", "main"), ["cluster"], BROADCAST_CLUSTERS)
    split = small_join(grouped, by_group.where("groups").select(F.col("cluster").alias("whole")), ["whole"], BROADCAST_CLUSTERS)
    split = small_join(split.select(*own), mixed_groups.select("cluster", "main"), ["cluster"], BROADCAST_CLUSTERS)
    log = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + 1e-9).cast("int")
    dealt = whole.select(*own, "main").union(split.select(*own, "main")).select(*own, (F.col("component") != F.col("main")).alias("stray"), log.alias("size_class"))
    counts = dealt.groupBy("cluster", "stray", "size_class").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    counts = materialize(counts, "counts")
    dealt = small_join(dealt, counts, ["cluster", "stray", "size_class"], BROADCAST_CLUSTERS).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")).drop("blocks")
    dealt = materialize(dealt, "dealt")
    blocks = counts.select("cluster", "stray", "size_class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = ["stray", "size_class", "block"]
    strays = blocks.where("stray").select("cluster", F.struct(*own).alias("x"))
    met = strays.withColumn("size_class", F.explode(F.array(*[F.col("x.size_class") + k for k in (-1, 0, 1)])))
    pairs = met.join(blocks, ["cluster", "size_class"]).select("cluster", "x", F.struct(*own).alias("y")).where("NOT y.stray OR x <= y")
    sides = pairs.select("cluster", F.xxhash64("cluster", "x", "y").alias("task"), F.posexplode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("side", "block_of"))
    sides = sides.select("cluster", "task", "side", "block_of.*")
    sent = dealt.join(sides, ["cluster", *own]).select("task", "side", "id", "th", "component")
    ids = dealt.select(F.col("id").alias("doc_id"), "th").distinct()
    texts = picked(rows, ids).select(F.col("doc_id").alias("id"), "text")
    sent = sent.drop("th").join(texts, "id")
    return materialize(sent.groupBy("task").applyInPandas(_block_links(words, percent), "a long, b long"), "rest")


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows(doc_id, text, th) that ids(doc_id, th) name, one for each. Few ids are broadcast. Of more, sorted hashes go to the
    tasks, and only rows that these let through are shuffled to meet the ids; beyond FILTER_IDS all rows are."""
    pair, n = ["doc_id", "th"], ids.limit(FILTER_IDS + 1).count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), pair).dropDuplicates(pair)
    if n <= FILTER_IDS:
        key = F.xxhash64(*pair).alias("key")
        shared = rows.sparkSession.sparkContext.broadcast(np.sort(ids.select(key).toArrow()["key"].to_numpy()))

        def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for x in batches:
                keys = x["key"].to_numpy()
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                yield x.select(rows_of).filter(pa.array(known[at] == keys))

        rows_of = rows.columns
        rows = rows.select("*", key).mapInArrow(through, rows.schema)
    return rows.join(ids.hint("merge"), pair).dropDuplicates(pair)


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n_shingles, component): th is the text's xxhash64."""
    with bounded_batches(docs.sparkSession):
        return _near_components(docs, words, percent)


def _near_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    sketched = materialize(rows.mapInPandas(_sketch(words), "doc_id long, th long, n int, d1 long, d2 long, regs binary, bands array<long>"), "sketch")
    full = sketched.where("n > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"))
    # a class takes its registers from the row of its smallest doc_id
    classes = full.join(reps.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    classes = materialize(classes.select(F.col("doc_id").alias("id"), "th", "n", "regs", "bands"), "classes")
    order = F.struct(F.xxhash64("id"), F.col("id"))
    grouped = classes.select("id", "n", F.explode("bands").alias("band"))
    shared = grouped.groupBy("band").agg(F.min(order).alias("o"), F.count("*").alias("size")).where("size > 1").select("band", F.col("o.id").alias("leader"))
    members = materialize(grouped.join(shared, "band"), "members")
    sketches = classes.select("id", "th", "n", "regs")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) those that are links."""
        side = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("th").alias(f"th{x}"), F.col("regs").alias(f"r{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").where(F.pandas_udf(_rated(percent / 100), "boolean")("na", "nb", "ra", "rb"))
        likely_pairs = materialize(both.select("a", "b", "tha", "thb"), "pairs")
        ids = likely_pairs.select(F.col("a").alias("id"), F.col("tha").alias("th")).union(likely_pairs.select("b", "thb")).distinct()
        texts = picked(rows, ids.select(F.col("id").alias("doc_id"), "th"))
        texts = materialize(texts.select(F.col("doc_id").alias("id"), "text"), "texts")
        pick = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
        return materialize(likely_pairs.select("a", "b").join(pick("b"), "b").join(pick("a"), "a").where(F.pandas_udf(_verify(words, percent), "boolean")("ta", "tb")).select("a", "b"), "links")

    first = linked(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    found = components(first)
    second = _rest(rows, classes, members, found, words, percent)
    if not second.isEmpty():
        found = components(first.union(second))
    nodes = sketched.select("doc_id", "th", "n", "d1", "d2")
    by_class = reps.select("d1", "d2", "n", F.col("rep.doc_id").alias("node")).join(found, "node", "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    return nodes.join(by_class, ["d1", "d2", "n"], "left").select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with n_shingles, component_id and kept."""
    docs = docs.drop("n_shingles", "component_id", "kept")
    id_, th, own, own_th = fresh(docs, "id", "th", "own", "own_th")
    found = near_components(docs, words, percent).dropDuplicates(["doc_id", "th"])
    found = found.select(F.col("doc_id").alias(id_), F.col("th").alias(th), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return (
        docs.withColumn(own, F.col("doc_id").try_cast("long")).withColumn(own_th, F.xxhash64("text"))
        .join(found, F.col(own).eqNullSafe(F.col(id_)) & (F.col(own_th) == F.col(th)), "left")
        .withColumn("kept", F.col("component_id").isNull() | (F.col(own) == F.col("component_id")))
        .select(*kept(docs), "n_shingles", "component_id", "kept")
    )
