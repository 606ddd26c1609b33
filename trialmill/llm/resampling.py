"""Importance resampling towards a target text collection, with bit-sliced exact weights.

Words and their runs are hashed into buckets.  A bucket's gain is the scaled log ratio of its smoothed
shares in the target and in the documents, a whole number.  A document's weight is the mean of its features'
gains.  The sums are taken on bit planes: the document's bucket counts become planes of one bit a
bucket, the gains become planes in two's complement (the last one counts negative), and
every pair of planes adds popcount(AND) times its power of two.  All of it is integer
arithmetic.  Hashed Gumbel noise on the weight draws without replacement in proportion to exp(weight / 1000).

The bucket counts and the gains have one entry a bucket and no more.  Scores are whole numbers between about
-50,000 and 70,000, so the table of scores by which ranks are found has that many rows at most;
a rank is the rows above the score plus the place among equal scores, and copies of one id, however
many, are counted and not sorted.

Defined results: null and empty texts have no feature, weight 0 and are never drawn; a null
id is hashed as an empty one and comes last among ties; rows that repeat an id are
documents each, and equal ones take neighbouring ranks; with fewer than ``100 / percent`` eligible
documents none is drawn; without target texts the gains follow the documents alone; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

BUCKETS = 10_000
SCALE = 1_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Documents whose planes stand in memory together.
PLANE_ROWS = 64
#: Bytes of a text that are split into words at a time.
STRETCH = 1_000_000
#: Equal rows that one explode writes.
COPIES = 65_536

# A-Z become a-z; ASCII characters that are neither letters nor digits become blanks.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes):
    """Words of a text in stretches, none cut in two."""
    if len(text) <= STRETCH:
        yield text.translate(_PLAIN).split()
        return
    text, at = text.translate(_PLAIN), 0
    while at < len(text):
        end = text.find(b" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(text: bytes | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every run of 1 to ``longest`` words)."""
    n, parts, carry = 0, [], []
    for words in words_of(text or b""):
        n += len(words)
        parts.append(np.fromiter(map(crc32, words), np.int64, len(words)))
        if longest > 1:
            joined = carry + words
            for size in range(2, longest + 1):
                # runs that end in this stretch
                first = max(0, len(carry) - size + 1)
                runs = [b" ".join(joined[i : i + size]) for i in range(first, len(joined) - size + 1)]
                parts.append(np.fromiter(map(crc32, runs), np.int64, len(runs)))
            carry = joined[len(joined) - min(longest - 1, len(joined)) :]
    found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return n, found % buckets


def bucket_counts(df: DataFrame, text_column: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one row a bucket and task is summed by Spark."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, 0):
            for text in b.column(0).to_pylist():
                total += np.bincount(features(text, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = df.select(F.col(text_column).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares), target over source, a bucket."""
    size = float(len(source))
    s_all, t_all = float(source.sum()) + size, float(target.sum()) + size
    return np.array([math.floor(scale * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def gain_planes(gains: np.ndarray) -> np.ndarray:
    """Two's complement planes of the gains; the last one holds the signs."""
    width = max(int(np.abs(gains).max(initial=0)).bit_length(), 1) + 1
    return _planes(((gains[None, :] >> np.arange(width)[:, None]) & 1).astype(np.uint8))


def plane_sums(counts: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sum of count * gain of each row of ``counts``, from planes alone."""
    total = np.zeros(len(counts), np.int64)
    most = counts.max(axis=1, initial=0)
    signs = len(gains) - 1
    for i in range(int(most.max(initial=0)).bit_length()):
        rows = np.flatnonzero(most >> i)
        plane = _planes(((counts[rows] >> i) & 1).astype(np.uint8))
        for j, gain in enumerate(gains):
            ones = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (i + j)
            total[rows] += -ones if j == signs else ones
    return total


def noise(key: str, seed: int, scale: int = SCALE) -> int:
    """Scaled Gumbel noise of a document."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, gains: np.ndarray, longest: int = 1, seed: int = SEED, scale: int = SCALE,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each document.  No shuffle."""
    buckets, planes = len(gains), gain_planes(gains)

    def run(batches):
        for b in slices(batches, 2):
            keys, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            words, sizes, sums = [], [], []
            for lo in range(0, len(texts), PLANE_ROWS):
                found = [features(t, longest, buckets) for t in texts[lo : lo + PLANE_ROWS]]
                row = np.repeat(np.arange(len(found)), [len(f) for _, f in found])
                counts = np.bincount(row * buckets + np.concatenate([f for _, f in found]), minlength=len(found) * buckets)
                counts = counts.reshape(len(found), buckets)
                if counts.max(initial=0) < 256:
                    counts = counts.astype(np.uint8)
                sums += plane_sums(counts, planes).tolist()
                words += [n for n, _ in found]
                sizes += [len(f) for _, f in found]
            weight = [s // n if n else 0 for s, n in zip(sums, sizes, strict=True)]
            score = [w + noise(k or "", seed, scale) for w, k in zip(weight, keys, strict=True)]
            columns = [pa.array(c, pa.int64()) for c in (words, sizes, weight, score)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(id_column).cast("string").alias("key"), F.col(text_column).cast("binary").alias("text"))
    schema = f"id {kind}, n_words long, n_features long, weight long, score long"
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_column: str = "doc_id") -> DataFrame:
    """Adds ``rank`` to the highest ``percent`` of the scores of documents with enough words; others have none."""
    names = [id_column, "n_features", "weight", "score"]
    fits = F.col("n_words") >= min_words
    per_score = cut(weighed.where(fits).groupBy("score").agg(F.count("*").alias("n")), "scores")
    wanted = percent * (per_score.agg(F.sum("n")).first()[0] or 0) // 100
    # One task: whole-number scores lie in a fixed range, so this table does not grow with the documents.
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = per_score.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above")).where(F.col("above") < wanted)
    least = places.agg(F.min("score")).first()[0]
    if least is None:
        return weighed.select(*names, F.lit(None).cast("long").alias("rank"))
    high = fits & (F.col("score") >= least)
    equal = weighed.where(high).groupBy(*names).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col(id_column).asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(places, "score")
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    size = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("block") * COPIES)
    # Copies of one row, if many, are written by many tasks.
    rows = blocks.repartition("score", id_column, "block").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), size)))
    rank = F.col("above") + F.col("before") + F.col("block") * COPIES + F.col("copy")
    drawn = rows.select(*names, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(weighed.where(~high).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = 1,
    buckets: int = BUCKETS, seed: int = SEED, scale: int = SCALE, id_column: str = "doc_id", text_column: str = "text",
    target_column: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn."""
    source = bucket_counts(docs, text_column, longest, buckets)
    gains = bucket_gains(source, bucket_counts(target, target_column, longest, buckets), scale)
    weighed = cut(weigh(docs, gains, longest, seed, scale, id_column, text_column), "weighed")
    return draw(weighed, percent, min_words, id_column)
