"""Centroid clustering by Lloyd's rounds that pay for change only.

Vectors are turned into integers once, so every sum is exact and no split of the rows can move a
centroid. A stored table keeps for each vector its owner and its distance to it; the driver keeps
the centroids and, of each cluster, the sum and the count. A round

1. compares a vector whose own centroid stayed with the *changed* centroids only, for it beat the
   others before, and a vector whose own centroid moved with all of them;
2. adds up, in each task, what vectors that changed hands carry from the old cluster to the new
   one: signed integers, a row for each task, after which sums are exact without another pass.

A round without a changed centroid reads nothing. No row is shuffled: tables are cut in the shared
folder, and what reaches the driver is a few kilobytes for each team of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import shuffle_partitions, stored

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
REACH = 1 << 27  # of a component: squared distances of 64 of them still fit 64 bits
EXACT = 1 << 22  # up to here products of whole vectors are exact as doubles
ROWS = 1 << 14  # vectors that are compared at once

STATE = "vec_id bigint, vector array<bigint>, owner int, distance bigint, moved boolean, transfer binary"


@dataclass
class Clusters:
    """Centroids as integers, the sums and counts behind them and which of them changed last."""

    centroids: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    changed: np.ndarray

    @classmethod
    def of(cls, seeds: np.ndarray) -> Clusters:
        return cls(seeds, np.zeros_like(seeds), np.zeros(len(seeds), np.int64), np.arange(len(seeds)))

    def after(self, transfers) -> Clusters:
        """The next centroids: floors of exact means. An empty cluster's stays where it is."""
        sums, counts = self.sums.copy(), self.counts.copy()
        for t in transfers:
            sums += t[:, 1:]
            counts += t[:, 0]
        full = counts > 0
        centroids = self.centroids.copy()
        centroids[full] = sums[full] // counts[full, None]
        return Clusters(centroids, sums, counts, np.flatnonzero((centroids != self.centroids).any(axis=1)))


def kept_vectors(table: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): vectors of the right length without a null or non-finite component, as integers."""
    real = F.col("embedding").cast("array<double>")
    good = (F.size("embedding") == dimensions) & F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(real, lambda x: F.floor(F.lit(float(scale)) * x))
    return table.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("vector"))


def first_hashes(vec_id: Column, seed: int = 1) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def seeds(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order; ids that are null come last, ties by components."""
    best = vectors.select(first_hashes(F.col("vec_id")).alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(clusters)
    return np.array([r["vector"] for r in best.collect()], np.int64).reshape(-1, DIMENSIONS)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        cross = (a @ c.T).astype(np.int64)
        return (v * v).sum(axis=1)[:, None] - 2 * cross + (centroids * centroids).sum(axis=1)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray):
    """(owner, distance) after ``changed`` moved; an owner of -1 is none yet. Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | np.isin(owner, changed)
    if lost.any():
        all_of = distances(v[lost], centroids)
        owner[lost] = all_of.argmin(axis=1)
        distance[lost] = all_of.min(axis=1)
    held = np.flatnonzero(~lost)
    if len(held) and len(changed):
        some = distances(v[held], centroids[changed])
        near, d = changed[some.argmin(axis=1)], some.min(axis=1)
        better = (d < distance[held]) | ((d == distance[held]) & (near < owner[held]))
        owner[held[better]], distance[held[better]] = near[better], d[better]
    return owner, distance


def transferred(v: np.ndarray, was: np.ndarray, owner: np.ndarray, clusters: int) -> np.ndarray:
    """Count and component sums that each cluster wins (and, as negative numbers, loses)."""
    out = np.zeros((clusters, 1 + v.shape[1]), np.int64)
    for k in np.flatnonzero(np.bincount(np.concatenate((owner, was[was >= 0])), minlength=clusters)):
        won, gone = owner == k, was == k
        out[k, 0] += won.sum() - gone.sum()
        out[k, 1:] += v[won].sum(axis=0) - v[gone].sum(axis=0)
    return out


def _round(state: DataFrame, clusters: Clusters, name: str) -> DataFrame:
    """The state after comparing with the changed centroids, stored, with one row of transfers per task."""
    given = state.sparkSession.sparkContext.broadcast((clusters.centroids, clusters.changed))

    def run(batches):
        import pyarrow as pa

        centroids, changed = given.value
        total = np.zeros((len(centroids), 1 + DIMENSIONS), np.int64)
        schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.int64())), ("owner", pa.int32()), ("distance", pa.int64()), ("moved", pa.bool_()), ("transfer", pa.binary())])
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                column = part.column("vector")
                v = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)
                if len(v) and max(-int(v.min()), int(v.max())) > REACH:
                    raise ValueError(f"a component beyond {REACH} after scaling: squared distances would not fit 64 bits")
                was = part.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
                owner, distance = assigned(v, was, part.column("distance").to_numpy(zero_copy_only=False).astype(np.int64), centroids, changed)
                moved = owner != was
                total += transferred(v[moved], was[moved], owner[moved], len(centroids))
                yield pa.record_batch([part.column("vec_id"), column.cast(pa.list_(pa.int64())), pa.array(owner.astype(np.int32)), pa.array(distance), pa.array(moved), pa.nulls(len(v), pa.binary())], schema=schema)
        if total.any():
            yield pa.record_batch([pa.array([x], t.type) for x, t in zip((None, None, None, None, None, total.tobytes()), schema)], schema=schema)

    return stored(state.select("vec_id", "vector", "owner", "distance").mapInArrow(run, STATE), name)


def _transfers(state: DataFrame, clusters: int) -> list[np.ndarray]:
    """All rows of transfers, added up by teams first: a team's sum is one row of a few kilobytes."""
    teams = shuffle_partitions(state.sparkSession)

    def add(batches):
        import pyarrow as pa

        total = np.zeros((clusters, 1 + DIMENSIONS), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, np.int64).reshape(total.shape)
        if total.any():
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["transfer"])

    rows = state.where(F.col("transfer").isNotNull()).select("transfer").repartition(teams).mapInArrow(add, "transfer binary")
    return [np.frombuffer(r["transfer"], np.int64).reshape(clusters, 1 + DIMENSIONS) for r in rows.toLocalIterator()]


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, Clusters]:
    """(vec_id, vector, owner, distance) under the last centroids, and those. ``vectors`` as :func:`kept_vectors` gives."""
    state = stored(vectors.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("bigint")}), "lloyd_vectors")
    now = Clusters.of(seeds(state, clusters))
    if not len(now.centroids):
        return state, now
    for k in range(rounds + 1):
        if not len(now.changed):  # every vector is with its nearest centroid
            break
        out = _round(state, now, f"lloyd_round{k}")
        state = out.where(F.col("transfer").isNull()).drop("transfer")
        if k < rounds:
            now = now.after(_transfers(out, len(now.centroids)))
    return state, now


def centroid_digest(centroid) -> str:
    import hashlib

    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_vectors(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``DIMENSIONS`` components, none null or non-finite. A null vec_id
    is an id like others and comes last among seeds; repeated ids and equal vectors stay row by
    row; with fewer vectors than clusters there are fewer clusters; an empty table, or one without
    a good vector, gives an empty result. Components beyond 2**27 after scaling raise an error, as
    distances would no longer fit. Other columns are ignored.
    """
    spark = table.sparkSession
    state, now = fit(kept_vectors(table), clusters, rounds)
    sums = {r["owner"]: r["d"] for r in state.groupBy("owner").agg(F.sum("distance").alias("d")).collect()}  # a row for each cluster
    whole = sum(sums.values())
    named = [(k, sums[k], whole, centroid_digest(c)) for k, c in enumerate(now.centroids) if k in sums]
    named = spark.createDataFrame(named, "owner int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = state.join(F.broadcast(named), "owner")
    return out.select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
