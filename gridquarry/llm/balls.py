"""Centroid clustering with ball trees.

The vectors of a partition are put, some thousands at a time, into metric trees:
a node is a ball with its centre, radius, count and the integer sum of its vectors.
Trees are stored once. In each round a ball whose members must all be nearest to
one centroid, by the triangle inequality, goes there whole, with its count and sum;
else its parts are asked, and in leaves that no ball settles distances are exact
integers. Only sums for each centroid leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ._shared import ROW, arrow_schema, cut, forget, numbered

SCALE, WIDTH, CENTROIDS, ROUNDS, SEED = 1024, 64, 8, 10, 3
TREE_ROWS, LEAF_ROWS = 8192, 32
#: Components below this have squared distances that a long holds; below the other one, doubles hold them too.
MOST, MOST_IN_DOUBLES = 1 << 27, 1 << 22


def tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, nodes, sums) of a metric tree: nodes have first and last place, and the number of their first part or -1.

    A ball is split at the median along the line through two points far from each other; one of equal points is not.
    """
    order, nodes, sums, k = np.arange(len(points)), [[0, len(points), -1]], [], 0
    while k < len(nodes):
        lo, hi, _ = nodes[k]
        here = points[order[lo:hi]]
        sums.append(here.sum(0))
        if hi - lo > LEAF_ROWS:
            near = here - sums[-1] / (hi - lo)
            a = near[np.argmax(np.einsum("ij,ij->i", near, near))]
            off = near - a
            line = off[np.argmax(np.einsum("ij,ij->i", off, off))]
            if line.any():
                order[lo:hi] = order[lo:hi][np.argpartition(near @ line, (hi - lo) // 2)]
                nodes[k][2] = len(nodes)
                nodes += [[lo, (lo + hi) // 2, -1], [(lo + hi) // 2, hi, -1]]
        k += 1
    return order, np.array(nodes, np.int64), np.array(sums, np.int64)


def radii(points: np.ndarray, nodes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The distance of each ball's centre, the mean of its points (in the tree's order), to the farthest of them."""
    return np.array([np.sqrt((np.square(points[lo:hi] - s / (hi - lo))).sum(1).max()) for (lo, hi, _), s in zip(nodes.tolist(), sums, strict=True)])


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < MOST_IN_DOUBLES:  # every step is a whole number below 2 ** 53
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return (np.square(p).sum(1)[:, None] + np.square(c).sum(1) - 2 * (p @ c.T)).astype(np.int64)
    return np.stack([np.square(points - c).sum(1) for c in centroids], 1)


def settled(nodes: np.ndarray, sums: np.ndarray, radius: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(balls that go whole to a centroid, their centroid, leaves that don't), none of them within another."""
    if len(centroids) == 1:
        return np.array([0]), np.array([0]), np.array([], np.int64)
    centre = sums / (nodes[:, 1] - nodes[:, 0])[:, None]
    c = centroids.astype(np.float64)
    own, others = np.square(centre).sum(1)[:, None], np.square(c).sum(1)
    square, slack = own + others - 2 * (centre @ c.T), 1e-11 * (own + others + 1)  # slack is more than doubles may be wrong by
    most, least = np.sqrt(np.maximum(square, 0) + slack), np.sqrt(np.maximum(square - slack, 0))
    nearest = np.argmin(square, 1)
    reach = most[np.arange(len(nodes)), nearest]
    least[np.arange(len(nodes)), nearest] = np.inf
    sure = reach + 2 * radius * (1 + 1e-9) < least.min(1)
    front, whole, leaves = np.array([0]), [], []
    while len(front):
        whole.append(front[sure[front]])
        front = front[~sure[front]]
        first = nodes[front, 2]
        leaves.append(front[first < 0])
        front = np.concatenate([first[first >= 0], first[first >= 0] + 1])
    whole = np.concatenate(whole)
    return whole, nearest[whole], np.concatenate(leaves)


def members(nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places, in the tree's order, of all points of some nodes."""
    lo, n = nodes[which, 0], nodes[which, 1] - nodes[which, 0]
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def planted(vectors: DataFrame, id: str, vector: str, width: int, scale: int) -> DataFrame:
    """The trees of all vectors with ``width`` finite components: row numbers, ids, integer points, nodes, sums and radii."""
    x = F.col("vector")
    rows = numbered(vectors, F.col(id).alias("id"), F.col(vector).alias("vector"))
    whole = rows.where((F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    kind = StructType([StructField("rows", ArrayType(LongType())), StructField("ids", ArrayType(rows.schema["id"].dataType)), *(StructField(c, BinaryType()) for c in ("points", "nodes", "sums", "radii"))])
    schema = arrow_schema(kind)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, TREE_ROWS):
            points = np.floor(scale * np.asarray(table["vector"].combine_chunks().flatten(), np.float64)).reshape(-1, width)
            if np.abs(points).max() >= MOST:
                raise ValueError(f"a component is beyond {MOST // scale}: its distances would not be longs")
            points = points.astype(np.int64)
            order, nodes, sums = tree(points)
            points = points[order]
            held = [table[c].combine_chunks().take(pa.array(order)) for c in (ROW, "id")]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), h).cast(schema.field(k).type) for k, h in enumerate(held)]
            blobs = [points.astype("<i4"), nodes.astype("<i4"), sums.astype("<i8"), radii(points, nodes, sums).astype("<f8")]
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], schema=schema)

    return cut(whole.select(ROW, "id", "vector").mapInArrow(plant, kind))


def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """The rows of some batches, ``n`` at a time."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            held.append(batch.slice(at, n))
            size += held[-1].num_rows
            if size >= n:
                whole = pa.Table.from_batches(held)
                yield whole.slice(0, n)
                held, size = whole.slice(n).to_batches(), size - n
    if size:
        yield pa.Table.from_batches(held)


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(points, nodes, sums, radii) of each tree of a batch."""
    blobs = [(batch["points"], "<i4", (-1, width)), (batch["nodes"], "<i4", (-1, 3)), (batch["sums"], "<i8", (-1, width)), (batch["radii"], "<f8", -1)]
    for k in range(batch.num_rows):
        points, nodes, sums, radius = (np.frombuffer(column[k].as_py(), kind).reshape(shape) for column, kind, shape in blobs)
        yield points.astype(np.int64), nodes.astype(np.int64), sums, radius


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, componentwise sum) of the vectors nearest to each centroid; ties go to the smaller number.

    A task sends one row for each centroid and component, and so many come to the driver.
    """
    k, width = centroids.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((k, 1), np.int64), np.zeros((k, width), np.int64)
        for points, nodes, sums, radius in chain.from_iterable(_trees(b, width) for b in batches):
            whole, owner, leaves = settled(nodes, sums, radius, centroids)
            np.add.at(n[:, 0], owner, nodes[whole, 1] - nodes[whole, 0])
            np.add.at(total, owner, sums[whole])
            some = points[members(nodes, leaves)]
            nearest = distances(some, centroids).argmin(1)
            n[:, 0] += np.bincount(nearest, minlength=k)
            for c in range(k):
                total[c] += some[nearest == c].sum(0)
        cluster, part = np.indices((k, width + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(part), pa.array(np.hstack([n, total]).ravel())], names=["cluster", "part", "value"])

    found = trees.drop("rows", "ids").mapInArrow(count, "cluster long, part long, value long")
    out = {c: [0] * (width + 1) for c in range(k)}
    for cluster, part, value in found.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        out[cluster][part] = int(value)
    return {c: (v[0], v[1:]) for c, v in out.items()}


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list:
    """The row numbers of the ``k`` stored vectors whose ids have the least hashes, then the first rows; null ids last."""
    ids = vectors.select(F.explode(F.arrays_zip("rows", "ids")).alias("v")).select("v.rows", "v.ids")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("ids").cast("string")), 256)
    return [r[0] for r in ids.orderBy(hashed.asc_nulls_last(), "rows").limit(k).collect()]


def clustered(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE,
    k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """For each row of ``vectors`` that is kept: its row number, id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Kept are vectors of ``width`` components, none null or not finite; null and
    shorter ones go. Fewer kept vectors than ``k`` make fewer centroids. Rows
    that repeat an id or a vector are rows like any other: equal vectors may
    begin as two centroids, of which the second then stays empty, as it is. An
    empty table gives no rows. Components of 131,072 or more raise, as their distances are no longs.
    Other columns are not read, so their names may clash.
    """
    kind = vectors.schema[id].dataType
    trees = planted(vectors, id, vector, width, scale)
    chosen = first_centroids(trees, k, seed)
    if not chosen:
        return vectors.sparkSession.createDataFrame([], StructType([StructField(ROW, LongType()), StructField(id, kind)])).selectExpr("*", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    centroids = _points(trees, chosen, width)
    for _ in range(rounds):
        found = totals(trees, centroids)
        centroids = np.array([[x // n for x in total] if n else centroids[c] for c, (n, total) in found.items()], np.int64)
    out = StructType([StructField(ROW, LongType()), StructField("id", kind), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    assigned = cut(trees.mapInArrow(_assigner(centroids, arrow_schema(out)), out))
    inertia = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")).collect())
    forget(trees)
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return assigned.select(
        ROW, F.col("id").alias(id), "cluster", "distance", of([F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of([F.lit(sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()]).alias("centroid_sha256"),
    )


def _points(trees: DataFrame, chosen: list[int], width: int) -> np.ndarray:
    """The points of some rows, in their order."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (points, *_) in zip(batch["rows"], _trees(batch, width), strict=True):
                rows = np.asarray(rows.values)
                at = np.flatnonzero(np.isin(rows, chosen))
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(points[at].tolist(), pa.list_(pa.int64()))], names=["row", "point"])

    found = dict(trees.mapInArrow(pick, "row long, point array<long>").collect())
    return np.array([found[r] for r in chosen], np.int64)


def _assigner(centroids: np.ndarray, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, (points, nodes, sums, radius) in enumerate(_trees(batch, centroids.shape[1])):
                whole, owner, leaves = settled(nodes, sums, radius, centroids)
                cluster, distance = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
                inside, rest = members(nodes, whole), members(nodes, leaves)
                cluster[inside] = np.repeat(owner, nodes[whole, 1] - nodes[whole, 0])
                for c in range(len(centroids)):
                    some = inside[cluster[inside] == c]
                    distance[some] = distances(points[some], centroids[c : c + 1])[:, 0]
                exact = distances(points[rest], centroids)
                cluster[rest], distance[rest] = exact.argmin(1), exact.min(1)
                rows, ids = (batch[c][number].values for c in ("rows", "ids"))
                yield pa.RecordBatch.from_arrays([rows, ids.cast(schema.field(1).type), pa.array(cluster.astype(np.int32)), pa.array(distance)], schema=schema)

    return assign
