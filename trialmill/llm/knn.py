"""Exact top-k search by a Voronoi join.

Queries and data are grouped by the nearest of a bounded set of pivots.  From each group's
count and radius follow bounds for every pair of a query group and a data cell: the k best scores of any query in the group are
at least its ``floor``.  A data row goes to a query group only if its own upper
bound for the group reaches that floor.  Groups are dealt into blocks of bounded size and solved
locally; the k best of each block are merged per query.

Scores are inner products of integer vectors, floor(``SCALE`` * x); ties go to the smaller id.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, as
query or as data; vectors of another dimension than the query score nothing; null ids
take no part; rows that repeat an id are candidates each, but never for their own id; with
fewer than k candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 64
K = 20
QUERY_ROWS = 2_048
DATA_ROWS = 16_384
MOST_PIVOTS = 256


def _whole(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, dim, vec): integer vectors of the rows that take part."""

    def run(batches):
        for b in batches:
            ids, dims, vecs = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = v.values
                if x is None or not len(x) or x.null_count:
                    continue
                x = np.floor(np.asarray(x, np.float64) * scale)
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "dim", "vec"])

    plain = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vec"))
    return plain.where("id IS NOT NULL AND vec IS NOT NULL").mapInArrow(run, "id long, dim int, vec binary")


def _grouped(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds (cell, distance) to the nearest pivot."""

    def run(batches):
        for b in batches:
            dims = np.asarray(b.column("dim"))
            cell, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(b.column("vec").take(pa.array(at)).to_pylist()), np.float64).reshape(-1, dim)
                p = pivots[int(dim)]
                square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
                cell[at] = square.argmin(1)
                far[at] = np.linalg.norm(x - p[cell[at]], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    return rows.mapInArrow(run, "id long, dim int, vec binary, cell int, far double")


def floors(pivots: np.ndarray, query_radius: dict[int, float], data: dict[int, tuple[int, float]], k: int) -> dict[int, float]:
    """Per query group a score that at least k candidates reach for each of its queries.

    For q = p + e and x = c + f with |e| <= r and |f| <= s the score is at least
    p.c - |p| s - r |c| - r s.  One candidate more is asked for, as a query is none of its own.
    """
    out = {}
    length = np.linalg.norm(pivots, axis=1)
    for g, r in query_radius.items():
        least = sorted(((float(pivots[g] @ pivots[c]) - length[g] * s - r * length[c] - r * s, n) for c, (n, s) in data.items()), reverse=True)
        seen, out[g] = 0, -math.inf
        for bound, n in least:
            seen += n
            if seen > k:
                out[g] = bound
                break
    return out


def best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
    """(query id, data id, score) of each query's k best, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    largest = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1]
    exact = largest < 2**53
    out_q, out_i, out_s = [], [], []
    step = max(1, 4_000_000 // max(1, len(ids)))
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        # Doubles are exact below 2^53; beyond it integers are multiplied.
        score = q @ data.T if exact else q.astype(np.int64) @ data.astype(np.int64).T
        for r, own in enumerate(query_ids[lo : lo + step]):
            s = score[r]
            rows = np.flatnonzero(ids != own)
            if len(rows) > k:
                values = s[rows]
                limit = np.partition(values, len(values) - k)[len(values) - k]
                rows = rows[values >= limit]
            rows = rows[np.argsort(-s[rows], kind="stable")][:k]
            out_q.append(np.full(len(rows), own))
            out_i.append(ids[rows])
            out_s.append(s[rows].astype(np.int64))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_q).astype(np.int64), join(out_i).astype(np.int64), join(out_s)


def top_k(df: DataFrame, is_query, k: int = K, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k best among all other rows."""
    rows = cut(_whole(df, id_column, vector_column, scale), "whole")
    query = is_query(F.col("id"))
    n_of = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(query, 1)).alias("q")).collect()}
    # Pivots: rows with the smallest hash of the id, at most MOST_PIVOTS a dimension.
    pivots = {}
    for dim, r in n_of.items():
        wanted = max(1, min(MOST_PIVOTS, -(-r["q"] // QUERY_ROWS)))
        chosen = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id", "vec").limit(wanted).collect()
        pivots[dim] = np.stack([np.frombuffer(c["vec"], np.float64) for c in chosen])
    grouped = cut(_grouped(rows, pivots), "cells")
    of_cell = grouped.groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.max("far").alias("far"), F.count(F.when(query, 1)).alias("q"), F.max(F.when(query, F.col("far"))).alias("q_far")
    ).collect()  # at most MOST_PIVOTS rows a dimension
    radius, floor, blocks = {}, {}, {}
    for dim in pivots:
        cells = [c for c in of_cell if c["dim"] == dim]
        radius[dim] = {c["cell"]: c["q_far"] for c in cells if c["q"]}
        floor[dim] = floors(pivots[dim], radius[dim], {c["cell"]: (c["n"], c["far"]) for c in cells}, k)
        n = sum(c["n"] for c in cells)
        blocks[dim] = {c["cell"]: (-(-c["q"] // QUERY_ROWS), -(-n // DATA_ROWS)) for c in cells if c["q"]}

    def copies(batches):
        """Data rows for the query groups that may need them."""
        for b in batches:
            dims = np.asarray(b.column("dim"))
            take, groups = [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(b.column("vec").take(pa.array(at)).to_pylist()), np.float64).reshape(-1, dim)
                length = np.linalg.norm(x, axis=1)
                for g, r in radius[int(dim)].items():
                    above = x @ pivots[int(dim)][g] + r * length
                    needed = at[above * (1 + 1e-12) + 1e-6 >= floor[int(dim)][g]]
                    take.append(needed)
                    groups.append(np.full(len(needed), g, np.int32))
            at = np.concatenate(take) if take else np.zeros(0, np.int64)
            group = np.concatenate(groups) if groups else np.zeros(0, np.int32)
            part = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(group), part.column("id"), part.column("vec")], ["dim", "grp", "id", "vec"])

    def number(which: int):
        table = [F.lit(v) for dim, groups in blocks.items() for g, n in groups.items() for v in (f"{dim}:{g}", n[which])]
        return F.create_map(*table)[F.concat_ws(":", "dim", "grp")] if table else F.lit(1)

    data = grouped.mapInArrow(copies, "dim int, grp int, id long, vec binary")
    data = data.withColumn("_d", F.pmod(F.xxhash64("id", "vec"), number(1)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), (number(0) - 1).cast("int"))))
    queries = grouped.where(query).withColumnRenamed("cell", "grp").select("dim", "grp", F.col("id").alias("qid"), F.col("vec").alias("qvec")).dropDuplicates(["dim", "grp", "qid", "qvec"])
    queries = queries.withColumn("qq", F.pmod(F.xxhash64("qid"), number(0)).cast("int")).withColumn("qd", F.explode(F.sequence(F.lit(0), (number(1) - 1).cast("int"))))
    queries = queries.select(F.col("dim").alias("qdim"), F.col("grp").alias("qgrp"), "qq", "qd", "qid", "qvec")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if left.num_rows and right.num_rows:
            stack = lambda t, c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.float64).reshape(t.num_rows, -1)
            found = best(stack(left, "qvec"), np.asarray(left.column("qid")), stack(right, "vec"), np.asarray(right.column("id")), k)
        return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, found), strict=True)))

    solved = queries.groupBy("qdim", "qgrp", "qq", "qd").cogroup(data.groupBy("dim", "grp", "_q", "_d")).applyInArrow(solve, "query_id long, id long, score long")
    # At most k rows a block and query meet here.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")
