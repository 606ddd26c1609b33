"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles.  Its sketch has ``COORDINATES`` bins:
in round i every shingle is thrown into a hashed bin with a value that orders rounds before
hashes; from round ``COORDINATES`` on, round i throws all shingles into bin
i - COORDINATES, so every bin fills after at most twice that many rounds, and long
documents need one or two.  Each coordinate of two sketches agrees with probability equal
to the sets' similarity, concentrated as if independent.

Documents with equal sets collapse first.  Bands of ``ROWS`` coordinates form buckets.
Work never pairs a bucket's members with each other at once:

1. star: each member is verified against its bucket's pivot, the smallest member;
2. rest: all that share a pivot are its family; members of a family that still belong to
   different components are compared in blocks, which give back links, not pairs.

Verification compares full sets (64-bit shingle hashes), in groups that share one text and
are split at ``GROUP_ROWS``, or in pairs of blocks of ``BLOCK_ROWS``.  A pair at similarity 0.8 shares no bucket with probability
(1 - 0.8^4)^24 = 3e-6.

Defined results: text without words (null, empty, blanks) has an empty set, links with nothing and is its
own component; fewer words than a shingle count as one shingle; rows that repeat an id are
each judged by their own text; a null id takes no part in links, has a null component and is kept;
ties cannot occur, as the smallest id is unique; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, mix64, text_batches
from .components import components

COORDINATES, ROWS = 96, 4
BANDS = COORDINATES // ROWS
GROUP_ROWS = 200
BLOCK_ROWS = 300
PERCENT = 80

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased.

    Words part at ASCII white space; bytes.lower and bytes.split do just that.
    """
    if not text:
        return np.zeros(0, np.uint64)
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix64(out * _ODD + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """(sets x coordinates) 16-bit sketch values; rows of empty sets mean nothing."""
    n = len(sets)
    filled = np.full(n * coordinates, _FULL, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    for i in range(2 * coordinates):
        if not len(values):
            break
        h = mix64(values + np.uint64((i + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32) if i < coordinates else np.full(len(h), i - coordinates, np.uint64)
        np.minimum.at(filled, owner * coordinates + bins.astype(np.int64), (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        open_ = (filled.reshape(n, coordinates) == _FULL).any(1)
        if not open_[owner].all():
            keep = open_[owner]
            values, owner = values[keep], owner[keep]
    return (mix64(filled) >> np.uint64(48)).astype(np.uint16).reshape(n, coordinates)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """(sketches x bands) 64-bit bucket keys."""
    packed = np.ascontiguousarray(sketch).view(np.uint64)
    return mix64(packed + np.arange(1, packed.shape[1] + 1, dtype=np.uint64) * _ODD).view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    if not len(s):
        return b""
    return int(np.bitwise_xor.reduce(mix64(s + _ODD))).to_bytes(8, "little") + int(np.add.reduce(mix64(s ^ _ODD))).to_bytes(8, "little")


def signatures(docs: DataFrame, words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n, set, sketch) of every whole text.  No shuffle."""

    def run(batches):
        for b in batches:
            texts = b.column(1)
            for lo, hi in text_batches(texts):
                sets = [shingle_set(t, words) for t in texts.slice(lo, hi - lo).to_pylist()]
                rows = sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in rows], pa.binary()),
                    ],
                    ["id", "n", "set", "sketch"],
                )

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, "id long, n long, set binary, sketch binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, id): the buckets of each node."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sketch = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, -1)
            keys = band_keys(sketch)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), keys.shape[1])))], ["key", "id"])

    return nodes.select("id", "sketch").mapInArrow(run, "key long, id long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` of their union.

    Pairs that share ``a`` meet in groups of about GROUP_ROWS, each with one copy of a's text.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("_slots"))
    slotted = pairs.join(sizes, "a").withColumn("_slot", F.pmod(F.xxhash64("b"), F.col("_slots")))
    members = slotted.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "_slot", "b", "text")
    pivots = slotted.select("a", "_slot").distinct().join(texts.select(F.col("id").alias("a"), "text"), "a")
    pivots = pivots.select(F.col("a").alias("pivot"), F.col("_slot").alias("pivot_slot"), F.col("text").alias("pivot_text"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a_ids, b_ids = [], []
        if left.num_rows and right.num_rows:
            first = [shingle_set(t, words) for t in right.column("pivot_text").to_pylist()]
            a = right.column("pivot")[0].as_py()
            for b, text in zip(left.column("b").to_pylist(), left.column("text").to_pylist(), strict=True):
                second = shingle_set(text, words)
                for one in first:
                    small, large = sorted((len(one), len(second)))
                    if not small or 100 * small < percent * large:
                        continue
                    common = len(np.intersect1d(one, second, assume_unique=True))
                    if 100 * common >= percent * (len(one) + len(second) - common):
                        a_ids.append(a)
                        b_ids.append(b)
                        break
        return pa.table({"a": pa.array(a_ids, pa.int64()), "b": pa.array(b_ids, pa.int64())})

    return members.groupBy("a", "_slot").cogroup(pivots.groupBy("pivot", "pivot_slot")).applyInArrow(compare, "a long, b long")


def common_counts(sets: list[np.ndarray], columns: int = 20_000) -> np.ndarray:
    """(sets x sets) sizes of all intersections, exact, by products of membership matrices.

    Hashes that one set alone holds cannot count and are dropped; the others come in
    slices of columns, which bounds memory.
    """
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    shared = often > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((n, n), np.float64)
    width = int(shared.sum())
    for lo in range(0, width, columns):
        part = slice(*np.searchsorted(column, [lo, lo + columns]))
        held = np.zeros((n, min(columns, width - lo)), np.float32)
        held[owner[part], column[part] - lo] = 1
        total += held @ held.T
    return total.astype(np.int64)


def across(families: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a family that are still in different components.

    ``families``: (pivot, id, component_id, home); ``home`` marks the pivot's own component.
    Members are dealt into blocks of about BLOCK_ROWS; blocks away from home meet each other
    and the home blocks, and each meeting is one group that compares full sets and gives
    back a spanning set of its links, so neither rows nor groups grow with the pairs.
    """
    sizes = families.groupBy("pivot").agg(
        F.ceil(F.count_if("home") / BLOCK_ROWS).cast("int").alias("_homes"), F.ceil(F.count_if(~F.col("home")) / BLOCK_ROWS).cast("int").alias("_aways")
    )
    dealt = families.join(sizes.where("_aways > 0"), "pivot")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at_home = dealt.where("home").withColumn("_i", block("_homes")).withColumn("_j", upto("_aways"))
    visiting = dealt.where("NOT home").withColumn("_j", block("_aways")).withColumn("_i", upto("_homes"))
    away = dealt.where("NOT home").withColumn("_mine", block("_aways")).withColumn("_other", upto("_aways"))
    away = away.withColumn("_i", F.least("_mine", "_other")).withColumn("_j", F.greatest("_mine", "_other"))
    fields = ["pivot", "_i", "_j", "id", "component_id"]
    meetings = at_home.select(F.lit(True).alias("_h"), *fields).union(visiting.select(F.lit(True), *fields)).union(away.select(F.lit(False), *fields))
    meetings = meetings.join(texts, "id")

    def compare(group: pa.Table) -> pa.Table:
        sets = [shingle_set(t, words) for t in group.column("text").to_pylist()]
        ids, part = np.asarray(group.column("id")), np.asarray(group.column("component_id"))
        size = np.array([len(x) for x in sets], np.int64)
        both = common_counts(sets)
        linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (part[:, None] != part[None, :])
        a, b = np.nonzero(np.triu(linked, 1))
        # One link per pair of components is enough.
        pairs = np.stack([np.minimum(part[a], part[b]), np.maximum(part[a], part[b])])
        _, first = np.unique(pairs, axis=1, return_index=True)
        return pa.table({"a": pa.array(ids[a[first]], pa.int64()), "b": pa.array(ids[b[first]], pa.int64())})

    return meetings.groupBy("_h", "pivot", "_i", "_j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``."""
    rows = cut(signatures(docs, words, id_column, text_column), "signatures")
    # One node per distinct set, named by its smallest id.
    nodes = cut(
        rows.where("n > 0 AND id IS NOT NULL").groupBy("set").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")), "nodes"
    )
    banded = buckets(nodes)
    shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("_n")).where("_n > 1").select("key", "pivot")
    shared = cut(banded.join(shared, "key"), "buckets")
    star = cut(shared.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "star")
    involved = shared.select("id").distinct()
    texts = cut(
        docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).join(involved, "id").dropDuplicates(["id", "text"]), "texts"
    )
    links = cut(verified(star, texts, words, percent), "links")
    parts = components(links)
    # Two members of a bucket are both in the family of its pivot.
    place = parts.withColumnRenamed("component_id", "_part")
    members = star.select(F.col("a").alias("pivot"), F.col("b").alias("id")).union(star.select("a", "a").distinct())
    members = members.join(place, "id", "left").select("pivot", "id", F.coalesce("_part", "id").alias("component_id"))
    at = place.select(F.col("id").alias("pivot"), F.col("_part").alias("_home"))
    families = members.join(at, "pivot", "left").withColumn("home", F.col("component_id") == F.coalesce("_home", "pivot"))
    families = cut(families.select("pivot", "id", "component_id", "home"), "families")
    more = across(families, texts, words, percent)
    parts = cut(components(links.union(more)), "parts")
    named = nodes.select("set", F.col("id").alias("node")).join(parts.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("set", F.coalesce("component_id", "node").alias("component_id"))
    found = rows.select("id", "n", "set").join(named, "set", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return found.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept")
    )
