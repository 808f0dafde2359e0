"""Centroid clustering by Yinyang bounds, exact on integers.

Lloyd's rounds: every vector goes to its nearest centroid, then every centroid becomes the
floored mean of its vectors. Most of a round's distances need not be computed:

* The centroids are put into groups once, by a few rounds of the same clustering over the centroids.
* A vector keeps an upper bound of the distance to its centroid and, for each group, one lower
  bound of the distances to the group's other centroids. When centroids move, the upper bound
  grows by its own centroid's way and a lower bound falls by the longest way in its group.
* Global filter: a vector whose upper bound is below all its lower bounds stays (first as it is, then with the
  upper bound made exact). Group filter: only groups whose lower bound does not exceed the upper bound are looked at. In
  these, a centroid is passed over if the group's former bound, less the centroid's own way, exceeds the best
  distance so far. What survives is computed exactly.

Vectors are integers, and distances are compared as integers; bounds are floating-point roots, kept
apart by a margin that covers their rounding, so a filter never decides a tie. The result is that
of Lloyd's rounds, centroid by centroid.

Distribution: the vectors and their bounds are a written table, read, filtered and written once a round; centroids, their
ways and groups go to the tasks (k x dims integers, a parameter). Only vectors that changed their cluster are summed,
inside batches and then by cluster, so the driver gets k rows a round. A lost executor rereads the last round's table.

Defined results: only vectors with exactly `dims` components, none null or non-finite, are kept; an integer beyond
2^27 in size would overflow the squared distances, and its vector is not kept either. Repeated vec_ids are vectors of their own; equal hashes of ids are
ordered by the vectors' components; a null vec_id is hashed as the text `null` and clustered like others. With fewer kept vectors
than k there is a centroid for each; equal centroids: the smaller number wins. An empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm._store import discard, persist, scratch

#: Integers beyond this size are not clustered.
LARGEST = 1 << 27
#: Relative margin that bounds keep from each other: far above the rounding of a few additions of roots.
_MARGIN = 1e-9
#: Rows that are worked on at a time.
_ROWS = 4096


@dataclass(frozen=True)
class Clusters:
    """rows: vec_id, v, cluster, distance (squared) of each kept vector; centroids: the final ones; skipped: distances that no round computed."""

    rows: DataFrame
    centroids: list[list[int]]
    skipped: int


def quantised(vectors: DataFrame, *, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: the kept vectors as integers floor(scale * x)."""
    x = F.col(vector_col)
    exact = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    small = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))  # null, NaN and infinities are not below it
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when((F.size(x) == dims) & whole & small, exact).alias("v"))
    return rows.filter("v is not null")


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    return [r.v for r in rows.select(F.sha2(name, 256).alias("hash"), "v").orderBy("hash", "v").limit(k).collect()]


def _squares(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers from a centroid, or from a row of centroids."""
    gap = x - centroid
    return np.einsum("ij,ij->i", gap, gap)


def group_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group number for each centroid: the same clustering, over the centroids."""
    seeds = np.linspace(0, len(centroids) - 1, groups).astype(int)
    middle = centroids[seeds].astype(float)
    for _ in range(rounds):
        near = ((centroids[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (near == g).any():
                middle[g] = centroids[near == g].mean(0)
    return np.unique(near, return_inverse=True)[1]


def _root_up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 + _MARGIN)


def _root_down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 - _MARGIN)


def _assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, ways: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster, upper and lower bounds of vectors, and how many distances that took. cluster < 0: not yet assigned."""
    n, groups = len(x), int(group.max()) + 1
    before = lower
    longest = np.array([ways[group == g].max() for g in range(groups)])
    fresh = cluster < 0
    upper = np.where(fresh, np.inf, upper + ways[np.maximum(cluster, 0)])
    lower = np.where(fresh[:, None], -np.inf, lower - longest)
    cluster = cluster.copy()
    computed = 0
    # Global filter, then with an exact upper bound.
    open_rows = np.flatnonzero(~(upper < lower.min(1) * (1 - _MARGIN)))
    known = open_rows[~fresh[open_rows]]
    own = np.full(n, -1, np.int64)  # squared distance of the own centroid, where it is known
    own[known] = _squares(x[known], centroids[cluster[known]])
    computed += len(known)
    upper[known] = _root_up(own[known])
    open_rows = open_rows[~(upper[open_rows] < lower[open_rows].min(1) * (1 - _MARGIN))]
    if not len(open_rows):
        return cluster, upper, lower, computed
    y, best, chosen = x[open_rows], own[open_rows], cluster[open_rows]
    unknown = best < 0
    best[unknown] = np.iinfo(np.int64).max
    first, old, limit = chosen.copy(), best.copy(), lower[open_rows]
    wanted = ~(upper[open_rows, None] < limit * (1 - _MARGIN))
    reach = _root_up(best)
    reach[unknown] = np.inf
    # Per group: the least and second least distance of what was computed, and a bound of what was passed over.
    least = np.full((len(y), groups), np.inf)
    second = np.full((len(y), groups), np.inf)
    member = np.full((len(y), groups), -1)
    for j, c in enumerate(centroids):
        g = group[j]
        bound = (before[open_rows, g] - ways[j]) * (1 - _MARGIN)
        scan = wanted[:, g] & (first != j) & (unknown | ~(reach < bound))
        passed = wanted[:, g] & (first != j) & ~scan
        least[passed, g], second[passed, g] = np.minimum(least[passed, g], bound[passed]), np.minimum(second[passed, g], bound[passed])
        at = np.flatnonzero(scan)
        if not len(at):
            continue
        d = _squares(y[at], c)
        computed += len(at)
        low = _root_down(d)
        nearer = low < least[at, g]
        second[at, g] = np.minimum(second[at, g], np.where(nearer, least[at, g], low))
        least[at, g] = np.where(nearer, low, least[at, g])
        member[at, g] = np.where(nearer, j, member[at, g])
        better = (d < best[at]) | ((d == best[at]) & (j < chosen[at]))
        won = at[better]
        best[won], chosen[won], reach[won] = d[better], j, _root_up(d[better])
    # A group's bound leaves out the vector's own centroid, and takes in the one that it left.
    for g in range(groups):
        renewed = np.where(member[:, g] == chosen, second[:, g], least[:, g])
        limit[:, g] = np.where(wanted[:, g], renewed, limit[:, g])
    left = np.flatnonzero((chosen != first) & (first >= 0))
    limit[left, group[first[left]]] = np.minimum(limit[left, group[first[left]]], _root_down(old[left]))
    cluster[open_rows], upper[open_rows], lower[open_rows] = chosen, _root_up(best), limit
    return cluster, upper, lower, computed


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _round(state: DataFrame, centroids: np.ndarray, ways: np.ndarray, group: np.ndarray) -> DataFrame:
    """state (vec_id, v, cluster, upper, lower) after one assignment, with the cluster that was left, and computed distances on each batch's first row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(lo, _ROWS)
                cluster = batch.column(2).to_numpy()
                now, upper, lower, computed = _assign(_matrix(batch.column(1), np.int64), cluster, batch.column(3).to_numpy(), _matrix(batch.column(4), np.float64), centroids, ways, group)
                counted = np.zeros(len(now), np.int64)
                counted[0] = computed
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(now), pa.array(upper), _lists(lower), pa.array(cluster), pa.array(counted)], ["vec_id", "v", "cluster", "upper", "lower", "former", "computed"])

    return state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, "vec_id long, v array<long>, cluster long, upper double, lower array<double>, former long, computed long")


def _sums(state: DataFrame, dims: int) -> DataFrame:
    """cluster, place, total: what joined each cluster less what left it, vectors at place 0 and component i at i + 1; added up in batches, then by cluster."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), np.int64)
            names = np.unique(np.concatenate([c.to_numpy() for c in batch.columns[1:]]))
            names = names[names >= 0]
            counts, totals = np.zeros(len(names), np.int64), np.zeros((len(names), dims), np.int64)
            for column, sign in ((1, 1), (2, -1)):
                of = batch.column(column).to_numpy()
                some = of >= 0
                at = np.searchsorted(names, of[some])
                np.add.at(counts, at, sign)
                np.add.at(totals, at, sign * x[some])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts), _lists(totals)], ["cluster", "n", "part"])

    moved = state.filter("cluster <> former").select("v", "cluster", "former")
    parts = moved.mapInArrow(run, "cluster long, n long, part array<long>")
    each = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "part")).alias("place", "value"))
    return each.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))


def cluster_vectors(vectors: DataFrame, *, k: int, rounds: int, seed: str, dims: int = 64, scale: int = 1024, groups: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Lloyd's clustering of the kept vectors, from k of them, for so many rounds and a last assignment.

    groups: centroid groups, by default a tenth of k, two at least.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        rows = persist(quantised(vectors, dims=dims, scale=scale, id_col=id_col, vector_col=vector_col), "vectors")
        start = first_centroids(rows, k, seed)
        if not start:
            empty = rows.select("vec_id", "v", F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("distance"))
            return Clusters(persist(empty, "clusters", outside=True), [], 0)
        centroids = np.array(start, np.int64)
        k = len(centroids)
        group = group_centroids(centroids, min(k, groups or max(2, -(-k // 10))))
        many = int(group.max()) + 1
        state = rows.select("vec_id", "v", F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("upper"), F.array(*[F.lit(0.0)] * many).alias("lower"))
        sums, ways, computed, total = [[0] * (dims + 1) for _ in range(k)], np.zeros(k), 0, 0
        for turn in range(rounds + 1):
            before, state = state, persist(_round(state, centroids, ways, group), "assigned", outside=turn == rounds)
            if turn:
                discard(before)
            told = state.agg(F.count("*"), F.sum("computed")).first()
            total, computed = told[0], computed + told[1]
            if turn == rounds:
                break
            for r in _sums(state, dims).collect():
                sums[r.cluster][r.place] += int(r.total)
            moved = np.array([[x // s[0] for x in s[1:]] if s[0] else c.tolist() for s, c in zip(sums, centroids)], np.int64)
            ways, centroids = _root_up(_squares(moved, centroids)), moved
    middle = F.array(*(F.array(*(F.lit(int(c)).cast("long") for c in row)) for row in centroids))
    own = F.get(middle, F.col("cluster").cast("int"))
    distance = F.aggregate(F.zip_with("v", own, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return Clusters(state.select("vec_id", "v", "cluster", distance.alias("distance")), centroids.tolist(), total * k * (rounds + 1) - computed)


def assignments(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    sums = {r.cluster: r.inertia for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    of = [(j, sums.get(j, 0), sum(sums.values()), digest(c)) for j, c in enumerate(found.centroids)]
    each = F.broadcast(found.rows.sparkSession.createDataFrame(of, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return found.rows.join(each, "cluster").select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
