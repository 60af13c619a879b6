"""Centroid clustering of integer vectors, exact to the last digit.

1. A vector of `size` components becomes the integers floor(scale * x). The `k` vectors with the smallest hash of their
   vec_id are the first centroids.
2. Each round, the driver builds a vantage-point tree over the centroids and broadcasts it (k * size integers, at most
   `MOST_BYTES`, whatever the number of vectors). Every vector searches it best first: of the nodes it has reached, it
   opens the one with the smallest lower bound, and stops when that exceeds the best distance found. The pruning radius
   is inclusive, with room for the rounding of square roots, so that a centroid at an equal distance is never missed;
   distances in nodes and leaves are exact integers, and of equal ones the smaller number wins. The searches of a batch
   go on together, each with its own frontier.
3. A task adds up its vectors by cluster before anything is shuffled: k * size sums a task, in two halves, so that
   they are exact. The driver gets k * size sums and divides.
4. After the last round vectors are assigned once more, which is written to the shared folder; inertias are sums over it.

Defined results: vectors that are null, of another length, or hold a component that is null, not finite or not within
a long once scaled are left out; a distance or inertia that isn't a long is null; rows that share a vec_id are vectors of
their own; a null vec_id is assigned like any other and is among the first centroids only if there are too few others; with fewer
than k vectors there are fewer centroids; empty clusters stay where they are; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import cut

#: Centroids in a leaf of the tree.
LEAF = 3
#: The tree's integers may take as many bytes.
MOST_BYTES = 64 << 20
#: Sums are held as two halves, cut at this bit.
HALF = 31
#: Relative room for the rounding of square roots.
SLACK = 1e-12
LONG = 2**63


def _integers(batch: pa.RecordBatch, size: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """(vec_ids, integer vectors) of a batch's usable rows."""
    vectors = batch.column("embedding")
    fit = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False)
    ids, vectors = batch.column("vec_id").filter(fit), vectors.filter(fit)
    x = pc.fill_null(vectors.flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(x * scale)
        good = ((y >= -LONG) & (y < LONG)).all(axis=1)
    return ids.filter(pa.array(good)), y[good].astype(np.int64)


class VantageTree:
    """Nearest of few centroids (rows of Python integers), exactly."""

    def __init__(self, centroids: list[list[int]]):
        self.peak = max(abs(v) for row in centroids for v in row)
        self.rows = np.array(centroids, np.int64)
        #: Of each node: its vantage point and children as (node, least and largest distance to the vantage point), or its centroids.
        self.nodes: list[tuple[int, list[tuple[int, float, float]]] | list[int]] = []
        self._grow(list(range(len(centroids))))

    def _grow(self, own: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(own)
        if len(own) > LEAF:
            centre, *rest = own
            away = np.sqrt(self._squares(self.rows[rest], centre).astype(np.float64))
            order = np.argsort(away, kind="stable")
            halves = [part for part in np.array_split(order, 2) if len(part)]
            self.nodes[at] = (centre, [(self._grow([rest[i] for i in part]), float(away[part[0]]), float(away[part[-1]])) for part in halves])
        return at

    def _squares(self, x: np.ndarray, centre: int) -> np.ndarray:
        """Exact squared distances; as Python integers where 64 bits might not hold them."""
        row = self.rows[centre]
        if self.wide(x):
            x, row = x.astype(object), row.astype(object)
        apart = x - row
        return (apart * apart).sum(axis=1)

    def wide(self, x: np.ndarray) -> bool:
        """Whether 64 bits might not hold a squared distance between x and a centroid."""
        peak = max(self.peak, abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        return x.shape[1] * (2 * peak) ** 2 >= LONG

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, exact squared distance) of each row of x."""
        n = len(x)
        best, least, root = np.full(n, -1), np.zeros(n, object if self.wide(x) else np.int64), np.full(n, np.inf)
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        todo = np.arange(n)

        def meet(own: np.ndarray, centre: int) -> np.ndarray:
            square = self._squares(x[own], centre)
            better = (best[own] < 0) | (square < least[own]) | ((square == least[own]) & (centre < best[own]))
            won = own[better.astype(bool)]
            best[won], least[won] = centre, square[better.astype(bool)]
            away = np.sqrt(square.astype(np.float64))
            root[won] = away[better.astype(bool)]
            return away

        while len(todo):
            node = bound[todo].argmin(axis=1)
            live = bound[todo, node] <= root[todo] * (1 + SLACK)
            live &= np.isfinite(bound[todo, node])
            todo, node = todo[live], node[live]
            low = bound[todo, node]
            bound[todo, node] = np.inf
            for i in np.unique(node).tolist():
                here = node == i
                own, content = todo[here], self.nodes[i]
                if isinstance(content, list):
                    for centre in content:
                        meet(own, centre)
                    continue
                away = meet(own, content[0])
                for child, nearest, farthest in content[1]:
                    room = SLACK * (away + farthest)
                    bound[own, child] = np.maximum(low[here], np.maximum(away - farthest, nearest - away) - room)
        return best, least


def _added(tree, k: int, size: int, scale: int):
    """Of a task's vectors: the number in each cluster, and the sum of each component in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros((k, size), np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            _, x = _integers(batch, size, scale)
            cluster, _ = tree.value.nearest(x)
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                n[c] += len(own)
                high[c] += (own >> HALF).sum(axis=0)
                low[c] += (own & ((1 << HALF) - 1)).sum(axis=0)
        met = np.flatnonzero(n)
        columns = [np.repeat(met, size), np.tile(np.arange(size), len(met)), np.repeat(n[met], size), high[met].ravel(), low[met].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cluster", "at", "n", "high", "low"])

    return run


def _assigned(tree, size: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _integers(batch, size, scale)
            cluster, square = tree.value.nearest(x)
            if square.dtype == object:
                square = [v if v < LONG else None for v in square.tolist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(square, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _first(vectors: DataFrame, k: int, size: int, scale: int) -> list[list[int]]:
    """The k usable vectors with the smallest hashes; of equal hashes, the smaller vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _integers(batch, size, scale)
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.int64()))], ["vec_id", "components"])

    rows = vectors.mapInArrow(run, "vec_id long, components array<long>")
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [list(r["components"]) for r in rows.orderBy(name.asc_nulls_last(), "components").limit(k).collect()]  # k rows


def _moved(vectors: DataFrame, centroids: list[list[int]], size: int, scale: int) -> list[list[int]]:
    """Each centroid's floored mean of its vectors; empty ones as they were."""
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    sums = vectors.mapInArrow(_added(tree, len(centroids), size, scale), "cluster long, at long, n long, high long, low long").groupBy("cluster", "at").agg(*exact)
    moved = [list(row) for row in centroids]
    for r in sums.collect():  # k * size rows
        moved[r["cluster"]][r["at"]] = ((int(r["high"]) << HALF) + int(r["low"])) // int(r["n"])
    tree.unpersist()
    return moved


def cluster_centroids(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256), one row per usable vector."""
    if k * size * 8 > MOST_BYTES:
        raise ValueError(f"{k} centroids of {size} components take more than {MOST_BYTES} bytes")
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = _first(vectors, k, size, scale)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, size, scale)
    tree = spark.sparkContext.broadcast(VantageTree(centroids))
    rows = cut(vectors.mapInArrow(_assigned(tree, size, scale), "vec_id long, cluster int, distance long"))
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inside = {r["cluster"]: r["sum"] for r in rows.groupBy("cluster").agg(whole.alias("sum")).collect()}  # k rows
    total = None if None in inside.values() else sum(inside.values())
    long = lambda v: None if v is None or v >= LONG else int(v)
    digest = lambda row: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()
    known = [(c, long(v), long(total), centroids[c], digest(centroids[c])) for c, v in inside.items()]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")  # k rows
