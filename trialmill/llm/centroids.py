"""Centroid clustering of integer vectors, nearest centroids by a progressive Walsh-Hadamard search.

The transform of a vector of 64 integers is 64 integers, and squared distances grow by exactly 64.
Coefficients are kept in the order of their sign changes, coarse to fine.  For each vector the
differences to all centroids are summed over the coarse block; the most promising centroid is
finished, and a centroid whose partial sum is already above that distance can only be worse and leaves.
The survivors go on block by block and are finished over all 64 coefficients, so ties are
seen exactly and the smaller number wins.

Vectors are transformed once and written.  A round sends the centroids' coefficients to the
tasks and one row a centroid and coefficient back from each task, summed by Spark; the mean is taken after
the inverse transform, which is exact, in whole numbers.

Defined results: vectors that are null, have another number of components, or hold null or
non-finite components take no part, nor do such with a scaled component of 2^27 or more, whose
squared distances leave 64 bits; with fewer vectors than centroids each vector starts one;
centroids without vectors stay where they are; a null id is hashed as an empty one; rows that
repeat an id are vectors each; without vectors the result is empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIM = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Scaled components from here on would leave 64 bits once squared and summed.
LIMIT = 1 << 27
#: Below this magnitude all sums of squared coefficient differences are exact in doubles.
DOUBLE_EXACT = 1 << 16
#: Coefficients per block, coarse to fine; together ``DIM``.
BLOCKS = (8, 8, 16, 32)


def walsh(dim: int = DIM) -> np.ndarray:
    """The Hadamard matrix, rows in the order of their sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


WALSH = walsh()


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients of whole-number rows; doubles hold them exactly, as they stay below 2^34."""
    return np.asarray(x, np.float64) @ WALSH.T.astype(np.float64)


def inverse(coefficients: list[int]) -> list[int]:
    """The whole numbers whose transform this is, for numbers of any size."""
    return [sum(int(w) * c for w, c in zip(column, coefficients, strict=True)) // DIM for column in WALSH.T]


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, both given by coefficients."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) >= DIM * DOUBLE_EXACT:
        v, centroids = (np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape) for x in (v, centroids))
    n, k = len(v), len(centroids)
    coarse = BLOCKS[0]
    a, b = v[:, :coarse], centroids[:, :coarse]
    # |a - b|^2 of the first block for every pair
    partial = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    first = partial.argmin(axis=1)
    rest = v[:, coarse:] - centroids[first, coarse:]
    bound = partial[np.arange(n), first] + (rest * rest).sum(axis=1)
    row, number = np.nonzero(partial <= bound[:, None])
    total = partial[row, number]
    done = coarse
    for size in BLOCKS[1:]:
        d = v[row, done : done + size] - centroids[number, done : done + size]
        total = total + (d * d).sum(axis=1)
        done += size
        alive = total <= bound[row]
        row, number, total = row[alive], number[alive], total[alive]
    # Pairs are in the order of (row, number): the first of the smallest wins.
    starts = np.searchsorted(row, np.arange(n))
    low = np.minimum.reduceat(total, starts) if n else total
    hit = np.flatnonzero(total == low[row])
    at = hit[np.searchsorted(row[hit], np.arange(n))]
    distance = np.array([int(t) // DIM for t in total[at].tolist()], np.int64)
    return number[at].astype(np.int32), distance


def _packed(x: np.ndarray) -> list[bytes]:
    """Coefficients of each row, in 32 bits where they fit."""
    small = np.abs(x).max(axis=1, initial=0) < 2**31
    return [r.astype("<i4" if s else "<i8").tobytes() for r, s in zip(x.astype(np.int64), small, strict=True)]


def _unpacked(column) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == 4 * DIM for r in rows):
        return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), DIM).astype(np.float64)
    return np.array([np.frombuffer(r, "<i4" if len(r) == 4 * DIM else "<i8") for r in rows], np.float64).reshape(len(rows), DIM)


def coefficients(df: DataFrame, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, coef): transformed whole-number vectors of the rows that take part."""

    def run(batches):
        for b in batches:
            take, vecs = [], []
            for at, v in enumerate(b.column(1)):
                x = v.values
                if x is None or len(x) != DIM or x.null_count:
                    continue
                x = np.floor(np.asarray(x, np.float64) * scale)
                if np.isfinite(x).all() and np.abs(x).max() < LIMIT:
                    take.append(at)
                    vecs.append(x)
            packed = _packed(transform(np.stack(vecs))) if vecs else []
            ids = b.column(0).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary())], ["id", "coef"])

    kind = df.schema[id_column].dataType.simpleString()
    plain = df.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vec"))
    return plain.where("vec IS NOT NULL").mapInArrow(run, f"id {kind}, coef binary")


def start(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Vectors with the smallest hash of seed and id; ties go by the coefficients.  At most k rows a task are compared."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = rows.orderBy(key, "coef").limit(k).select("coef").collect()
    return [inverse(np.frombuffer(r["coef"], "<i4" if len(r["coef"]) == 4 * DIM else "<i8").tolist()) for r in chosen]


def _moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    known = transform(np.array(centroids))

    def run(batches):
        sums, n = np.zeros((len(known), DIM), object), np.zeros(len(known), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            v = _unpacked(b.column(1))
            number, _ = nearest(v, known)
            for c in np.unique(number):
                mine = v[number == c]
                sums[c] += mine.sum(axis=0).astype(np.int64)
                n[c] += len(mine)
        at = np.flatnonzero(n)
        columns = [np.repeat(at, DIM).astype(np.int32), np.tile(np.arange(DIM, dtype=np.int32), len(at)), sums[at].ravel().astype(np.int64), np.repeat(n[at], DIM)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "place", "total", "n"])

    parts = rows.mapInArrow(run, "cluster int, place int, total long, n long")
    found = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    sums, n = {}, {}
    for r in found:  # one row a centroid and coefficient
        sums.setdefault(r["cluster"], [0] * DIM)[r["place"]] = int(r["total"])
        n[r["cluster"]] = r["n"]
    return [[s // n[c] for s in inverse(sums[c])] if c in n else old for c, old in enumerate(centroids)]


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of each vector."""
    known = transform(np.array(centroids))

    def run(batches):
        for b in batches:
            if b.num_rows:
                number, distance = nearest(_unpacked(b.column(1)), known)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number), pa.array(distance)], ["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, cluster int, distance long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def fit(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids of written ``coefficients`` after all rounds; at most k of ``DIM`` numbers each."""
    centroids = start(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(rows, centroids)
    return centroids


def cluster(
    df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    An inertia beyond 64 bits is null.
    """
    rows = cut(coefficients(df, scale, id_column, vector_column), "coefficients")
    centroids = fit(rows, k, rounds, seed)
    if not centroids:
        found = rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found = cut(assign(rows, centroids), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(total.alias("total")).collect()}  # at most k rows

    def long(value: int):
        return F.lit(value if value < 2**63 else None).cast("long")

    per_cluster = F.lit(None).cast("long")
    name = F.lit(None).cast("string")
    if sums:
        per_cluster = F.element_at(F.array(*[long(sums.get(c, 0)) for c in range(len(centroids))]), F.col("cluster") + 1)
        name = F.element_at(F.array(*[F.lit(digest(c)) for c in centroids]), F.col("cluster") + 1)
    return found.select(
        F.col("id").alias(id_column), "cluster", "distance", per_cluster.alias("cluster_inertia"), long(sum(sums.values())).alias("inertia"), name.alias("centroid_sha256"),
    )
