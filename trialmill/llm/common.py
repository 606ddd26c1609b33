"""Shared pieces of the operators: table access, scratch tables, whole-text batches."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmill.session import drop_path, shared_dir, shuffles_dropped

#: Bytes of text that one Python call handles at a time; a longer text is handled alone.
BATCH_BYTES = 2_000_000


#: Rows of one Arrow batch: rows hold whole texts, and a batch stands in memory on both sides of the pipe.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``ARROW_ROWS``; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    A lost executor then repeats no earlier stage, and every reader sees the same rows.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run, dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """As ``cut``, with the table remembered under its label; what was shuffled for it goes when it is written."""
        path = scratch(self.spark, label)
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        self.paths.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete the tables of these labels, or all."""
        for label in labels or list(self.paths):
            for path in self.paths.pop(label, []):
                drop_path(self.spark, path)


def crc_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_batches(column, limit: int = BATCH_BYTES):
    """Slices (from, to) of an Arrow string column with about ``limit`` bytes each."""
    n = len(column)
    start, held = 0, 0
    for i in range(n):
        size = len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < n:
        yield start, n


def slices(batches, column: int, limit: int = BATCH_BYTES):
    """The same rows in record batches of about ``limit`` bytes of text: what a task holds at a time."""
    for b in batches:
        for lo, hi in text_batches(b.column(column), limit):
            yield b.slice(lo, hi - lo)
