"""Exact k-means over integer vectors with balls (Xia et al. 2020).

Kept are vectors of `dims` components without nulls, NaN or infinity; a component x becomes floor(1024 * x). A round reads the vectors
with their clusters, a task at a time takes each cluster's members in a batch as a ball: its centre is the cluster's centroid, its
radius the largest distance of a member. Only centroids nearer to the centre than twice the radius are neighbours, and among the
members those nearer to the centre than half the way to the first neighbour are the stable core, which stays without a comparison.
The others lie in annuli: a member in the annulus behind the half ways to the first j neighbours is compared with exactly these. All
tests are on squared integers, so that nothing is lost by rounding, and equal distances go to the smaller number.

The vectors with their new clusters and a row of sums per cluster and task are written as one table, and the sums alone are read
from it for the next centroids: so a lost executor costs one task, sums are right whatever is run twice, and there is no shuffle of
vectors. The driver sees k centroids. The table of the last but one round is deleted.

Components are clipped to 2^27 after scaling, as squared distances beyond have no place in a long; sums are decimals of 38 digits
and clipped to a long at the end. The first centroids are the kept vectors of least sha256 of `3:<vec_id>` (null: of `3:`), ties by
the vector; with fewer vectors than clusters there are as many clusters as vectors. Repeated rows count each. Rows that aren't kept have
no result, an empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import materialize

CLUSTERS, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
CLIP = 1 << 27
LONG = (1 << 63) - 1


def kept(table: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors as integers."""
    good = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(CLIP))), F.lit(float(-CLIP)))).cast("int"))
    return table.where(F.coalesce(good, F.lit(False))).select("vec_id", whole.alias("v"))


def assigned(x: np.ndarray, own: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, squared distances) of vectors that were in the clusters own, with each cluster as a ball."""
    between = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    now = own.copy()
    distance = ((x - centres[own]) ** 2).sum(axis=1)
    for c in np.unique(own):
        members = np.flatnonzero(own == c)
        to_centre = distance[members]
        order = np.lexsort((np.arange(len(centres)), between[c]))
        order = order[order != c]
        # another centroid can be as near as the own one only if it is within twice the distance: squared, four times
        order = order[between[c, order] <= 4 * int(to_centre.max())]
        ring = np.searchsorted(between[c, order], 4 * to_centre, side="right")
        for j, other in enumerate(order):
            inside = members[ring > j]
            d = ((x[inside] - centres[other]) ** 2).sum(axis=1)
            nearer = (d < distance[inside]) | (d == distance[inside]) & (other < now[inside])
            distance[inside[nearer]], now[inside[nearer]] = d[nearer], other
    return now, distance


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


#: A vector's row, or (v null) a row of a task's sums over a cluster.
SHAPE = "vec_id long, v array<int>, cluster int, distance long, n long, sums array<long>, within decimal(38,0)"


def moved(state: DataFrame, centres: np.ndarray, dims: int) -> DataFrame:
    """state's vectors with the clusters of these centroids, and the rows of sums."""
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, within = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        schema = None
        for b in batches:
            x, own = vectors(b["v"], dims), b["cluster"].to_numpy().astype(np.int64)
            if not len(x):
                continue
            now, distance = assigned(x, own, centres)
            for c in np.unique(now):
                mine = now == c
                n[c] += int(mine.sum())
                sums[c] += x[mine].sum(axis=0)
                within[c] += sum(distance[mine].tolist())
            none = pa.nulls(len(x), pa.int64())
            out = pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(now, pa.int32()), pa.array(distance), none, pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.decimal128(38, 0))], names=NAMES)
            schema = out.schema
            yield out
        full = np.flatnonzero(n)
        if len(full):
            from decimal import Decimal

            m = len(full)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, schema.field("v").type), pa.array(full, pa.int32()), pa.nulls(m, pa.int64()), pa.array(n[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64())), pa.array([Decimal(within[c]) for c in full], pa.decimal128(38, 0))], names=NAMES
            )

    return state.mapInArrow(run, SHAPE)


NAMES = [x.split()[0] for x in SHAPE.split(", ")]


def totals(table: DataFrame) -> list:
    """(cluster, n, sums, within) per cluster with members: a row each."""
    rows = table.where("n IS NOT NULL").select("cluster", "n", "sums", "within")
    each = rows.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    sums = each.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("sums"))
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("within").alias("within")).join(sums, "cluster").collect()


def removed(table: DataFrame) -> None:
    """The files of a written table that nothing reads any more."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if where is not None:
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, dict[int, dict]]:
    """(vec_id, v, cluster, distance) as a written table, and per cluster its centroid and the distances summed."""
    state = materialize(kept(table, dims, scale).withColumn("cluster", F.lit(0)), "balls")
    first = state.orderBy(F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256), "v").limit(k)
    centres = np.array([r["v"] for r in first.select("v").collect()], np.int64).reshape(-1, dims)
    if not len(centres):
        return state.withColumn("distance", F.lit(None).cast("long")), {}
    for i in range(rounds + 1):
        new = materialize(moved(state, centres, dims), "balls")
        found = totals(new)
        removed(state)
        state = new.where("v IS NOT NULL").select("vec_id", "v", "cluster", "distance")
        if i < rounds:
            for r in found:
                centres[r["cluster"]] = [int(x["x"]) // r["n"] for x in r["sums"]]
    within = {r["cluster"]: int(r["within"]) for r in found}
    return state, {c: {"centroid": centres[c].tolist(), "inertia": x} for c, x in within.items()}


def digests(clustered: tuple[DataFrame, dict[int, dict]]) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    rows, balls = clustered
    total = min(LONG, sum(b["inertia"] for b in balls.values()))
    by_cluster = lambda value, kind: F.create_map(*[F.lit(x) for c, b in balls.items() for x in (c, value(b))])[F.col("cluster")].cast(kind) if balls else F.lit(None).cast(kind)
    name = lambda b: hashlib.sha256(",".join(map(str, b["centroid"])).encode()).hexdigest()
    return rows.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", by_cluster(lambda b: min(LONG, b["inertia"]), "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), by_cluster(name, "string").alias("centroid_sha256"))
