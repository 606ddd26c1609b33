"""Near-duplicate vectors by randomised-rotation binary codes.

Every usable vector is scaled to length one, padded to ``CODE_BITS`` dimensions, rotated at
random and reduced to its signs.  Beside the code stands its correction factor, the inner product of the vector with
its code.  For a second vector the inner product with the code, divided by the factor, is an
unbiased estimate of the cosine, and the factor also gives the width of its confidence
interval.  Pairs whose interval lies below the threshold are dropped; all others are recomputed
exactly in double precision, and only exact values make links.

Pairs meet in tables of buckets: table t takes its own ``bits`` code bits, per label.  With 8 bits and
13 tables a pair at cosine 0.93 meets with probability 0.997, closer ones more surely; more
rows take more bits, and as many tables as keep that probability.  A pair counts in the
first table in which it meets.  Buckets beyond ``BLOCK_ROWS`` are dealt into pairs of blocks.
Equal vectors of one label collapse first and count with their number.

Tasks send per vector its number of links and one link to the smallest vector of its local
component, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a
null label, link with nothing; vectors of different dimension do not link; a null id takes no part and
has a null component; a repeated id with an equal vector counts as another vector; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import cut
from .components import components

THRESHOLD = 0.93
CODE_BITS = 256
#: Standard deviations of the confidence interval.
DEVIATIONS = 4.0
BLOCK_ROWS = 1_500
#: Rows of one label that a bucket should hold, about.
BUCKET_ROWS = 100
MISSED = 0.004
_SEED = 20


def rotation(dimension: int) -> np.ndarray:
    """(dimension x code bits) orthonormal rows of a random rotation, the same in every task."""
    bits = max(CODE_BITS, -(-dimension // 64) * 64)
    rng = np.random.default_rng(_SEED + dimension)
    q, r = np.linalg.qr(rng.standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dimension].astype(np.float32)


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (packed) and correction factors of unit vectors."""
    turned = unit.astype(np.float32) @ turn
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turn.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes x vectors) cosine estimates, and the half width of each code's interval."""
    bits = turned.shape[1]
    signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    estimate = (signs @ turned.T) / (math.sqrt(bits) * factor[:, None])
    width = DEVIATIONS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(bits - 1)
    return estimate, width


def tables_for(rows_per_label: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) so that buckets stay small and a pair at the threshold is missed with probability MISSED."""
    bits = min(24, max(8, math.ceil(math.log2(max(1, rows_per_label) / BUCKET_ROWS)) if rows_per_label > BUCKET_ROWS else 8))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree))


def bands(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors x tables) bucket numbers; each table takes a random set of code bits."""
    every = np.unpackbits(code, axis=1)
    rng = np.random.default_rng(_SEED)
    out = np.zeros((len(code), tables), np.int32)
    weights = 1 << np.arange(bits)
    for t in range(tables):
        # Neighbouring tables take different bits as long as there are unused ones.
        if t * bits % every.shape[1] < bits:
            order = rng.permutation(every.shape[1])
        at = (t * bits) % every.shape[1]
        chosen = np.concatenate([order, order])[at : at + bits]
        out[:, t] = every[:, chosen] @ weights
    return out


def usable(b: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and double-precision vectors of the rows that can link."""
    rows, vectors = [], []
    for i, v in enumerate(b):
        if v.is_valid and len(v.values):
            x = v.values
            if x.null_count == 0:
                x = np.asarray(x, np.float64)
                if np.isfinite(x).all() and x.any():
                    rows.append(i)
                    vectors.append(x)
    return np.array(rows, np.int64), vectors


def _kind(rows: DataFrame) -> str:
    """How vectors travel: single-precision ones as they are, all others as doubles."""
    return "<f4" if rows.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"


def unit_vectors(raws: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Rows of length one in double precision.

    Scaled first by the largest component, so that lengths neither overflow nor vanish.
    """
    x = np.frombuffer(b"".join(raws), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prepared(rows: DataFrame, kind: str) -> DataFrame:
    """(label, dim, key, id, vec) of the rows that can link."""

    def run(batches):
        for b in batches:
            at, vectors = usable(b.column("vec"))
            raws = [(v + 0.0).astype(kind).tobytes() for v in vectors]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column("label").take(take), pa.array([len(v) for v in vectors], pa.int32()), pa.array([xxh3_128_digest(r) for r in raws], pa.binary()), b.column("id").take(take), pa.array(raws, pa.binary())],
                ["label", "dim", "key", "id", "vec"],
            )

    return rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").mapInArrow(run, "label string, dim int, key binary, id long, vec binary")


def _placed(nodes: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """One row per vector and table: (bucket, id, copies, table, bands, code, factor, vec)."""

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                turn = turns.setdefault(int(dim), rotation(int(dim)))
                x = unit_vectors(part.column("vec").to_pylist(), int(dim), kind)
                code, factor = codes(x, turn)
                band = bands(code, bits, tables)
                labels = part.column("label").to_pylist()
                row = np.repeat(np.arange(len(x)), tables)
                table_ = np.tile(np.arange(tables, dtype=np.int32), len(x))
                bucket = [xxh3_64_intdigest(f"{dim}:{t}:{band[r, t]}:{labels[r]}".encode()) - (1 << 63) for r, t in zip(row, table_, strict=True)]
                take = pa.array(row)
                packed = [band[r].tobytes() for r in range(len(x))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int64()), part.column("id").take(take), part.column("copies").take(take), pa.array(table_), part.column("dim").take(take), pa.array(packed, pa.binary()).take(take), pa.array([c.tobytes() for c in code], pa.binary()).take(take), pa.array(factor, pa.float64()).take(take), part.column("vec").take(take)],
                    ["bucket", "id", "copies", "tab", "dim", "bands", "code", "factor", "vec"],
                )

    return nodes.mapInArrow(run, "bucket long, id long, copies long, tab int, dim int, bands binary, code binary, factor double, vec binary")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def compare(t: pa.Table, threshold: float, turn: np.ndarray, vec_kind: str = "<f8") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, smallest linked id, links that first meet here) of the linked rows of one pair of blocks."""
    order = np.argsort(np.asarray(t.column("id")), kind="stable")
    t = t.take(pa.array(order))
    ids, mine = np.asarray(t.column("id")), np.asarray(t.column("_mine"))
    i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
    table_ = t.column("tab")[0].as_py()
    n = len(ids)
    stack = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(n, -1)
    unit = unit_vectors(t.column("vec").to_pylist(), t.column("dim")[0].as_py(), vec_kind)
    band, code = stack("bands", np.int32), stack("code", np.uint8)
    factor, copies = np.asarray(t.column("factor")), np.asarray(t.column("copies"))
    rows, columns = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    turned = unit[columns].astype(np.float32) @ turn
    lefts, rights = [], []
    for lo in range(0, len(rows), 256):
        part = rows[lo : lo + 256]
        estimate, width = estimates(code[part], factor[part], turned)
        r, c = np.nonzero(estimate + width[:, None] >= threshold)
        left, right = part[r], columns[c]
        if i == j:
            left, right = left[left < right], right[left < right]
        for k in range(0, len(left), 50_000):  # exact, in double precision
            a, b = left[k : k + 50_000], right[k : k + 50_000]
            linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            lefts.append(a[linked])
            rights.append(b[linked])
    a = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    b = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    fresh = np.ones(len(a), bool)
    for earlier in range(table_):
        fresh &= band[a, earlier] != band[b, earlier]
    links = np.zeros(n, np.int64)
    np.add.at(links, a[fresh], copies[b[fresh]])
    np.add.at(links, b[fresh], copies[a[fresh]])
    root = ids[_roots(n, a, b)]
    out = np.zeros(n, bool)
    out[a] = out[b] = True
    return ids[out], root[out], links[out]


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``df``."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vec"), F.col(label_column).cast("string").alias("label"))
    kind = _kind(rows)
    ready = cut(_prepared(rows, kind), "vectors")
    nodes = cut(ready.groupBy("label", "dim", "key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "nodes")
    most = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 0
    bits, tables = tables_for(most, threshold)
    placed = _placed(nodes, bits, tables, kind)
    placed = cut(placed, "placed")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    dealt = placed.join(sizes.select("bucket", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks")), "bucket")
    dealt = dealt.withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    sides = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "bucket", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_mine", "id", "copies", "tab", "dim", "bands", "code", "factor", "vec"
    )

    def run(group: pa.Table) -> pa.Table:
        out = compare(group, threshold, _turn(group.column("dim")[0].as_py()), kind)
        return pa.table(dict(zip(("id", "root", "links"), map(pa.array, out), strict=True)))

    found = cut(sides.groupBy("bucket", "_i", "_j").applyInArrow(run, "id long, root long, links long"), "found")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = cut(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "parts")
    named = nodes.select("label", "dim", "key", "id", "copies").join(counted, "id", "left").join(parts, "id", "left")
    named = named.select(
        "label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    # Rows that took part, by their vector; a hot vector is split by the adaptive skew join.
    linked = ready.select("label", "dim", "key", "id").join(named, ["label", "dim", "key"]).select("id", "n_links", "component_id")
    rest = _unusable(rows).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(rest)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def _unusable(rows: DataFrame) -> DataFrame:
    """Ids of the rows that cannot link."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    vec = F.col("vec").cast("array<double>")
    good = F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)
    return rows.where(F.col("id").isNull() | F.col("label").isNull() | F.col("vec").isNull() | ~F.coalesce(good, F.lit(False))).select("id")


_TURNS: dict[int, np.ndarray] = {}


def _turn(dimension: int) -> np.ndarray:
    if dimension not in _TURNS:
        _TURNS[dimension] = rotation(dimension)
    return _TURNS[dimension]
