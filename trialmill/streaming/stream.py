"""Incremental forms: running summaries, exactly-once resume, policy learning, span scrubbing."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import run_summary
from ..operators.routing import policy_moments
from ..session import drop_path
from ..sources.datasets import SPAN_SCHEMA, dated_spans
from ..sources.trials import TRIAL_SCHEMA


def stream_source(spark: SparkSession, path: str, schema=TRIAL_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


# --- published tables -------------------------------------------------------------------

_PUBLISHED = "sequence long, source string, batch_id long, path string"
#: Versions that stay readable behind the newest one.
KEEP_VERSIONS = 3


def _source(checkpoint: str) -> str:
    """A short name of the query that writes: batch numbers are its own."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def published(spark: SparkSession, table: str) -> DataFrame:
    """The published versions of a table; empty where there is none yet."""
    try:
        return spark.read.schema(_PUBLISHED).json(f"{table}/published/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _PUBLISHED)


def publish(df: DataFrame, table: str, source: str, batch_id: int, keep: int = KEEP_VERSIONS) -> str:
    """Write a new version beside the others, then the entry that makes it the current one.

    A reader sees the version before or the new one, each whole.  A batch that was published before, as after a restart
    between its entry and the checkpoint, is not written again.  A version is deleted once ``keep`` newer ones are published.
    """
    spark = df.sparkSession
    known = published(spark, table).orderBy("sequence").collect()  # at most keep + 1 entries
    mine = [r for r in known if (r["source"], r["batch_id"]) == (source, batch_id)]
    if mine:
        return mine[-1]["path"]
    sequence = 1 + max((r["sequence"] for r in known), default=-1)
    path = f"{table}/versions/{sequence:012d}-{source}-{batch_id}"
    df.write.mode("overwrite").parquet(path)
    entry = spark.createDataFrame([(sequence, source, batch_id, path)], _PUBLISHED)
    entry.coalesce(1).write.mode("overwrite").json(f"{table}/published/{sequence:012d}")
    for old in known[: max(0, len(known) - keep)]:
        # the entry first: what is listed is always there
        drop_path(spark, f"{table}/published/{old['sequence']:012d}")
        drop_path(spark, old["path"])
    return path


def read_current(spark: SparkSession, table: str) -> DataFrame:
    """The newest published version."""
    newest = published(spark, table).orderBy(F.desc("sequence")).first()
    if newest is None:
        raise ValueError(f"nothing is published under {table} yet")
    return spark.read.parquet(newest["path"])


def stream_trials(trials: DataFrame, table: str, checkpoint: str, by: Sequence[str] = ("system", "variant")) -> StreamingQuery:
    """Running run summary: one state row per (system, variant), each batch published as a whole version of ``table``.

    Read it with ``read_current``.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        publish(batch, table, _source(checkpoint), batch_id)

    return (
        run_summary(trials, by)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )


def stream_resume(
    trials: DataFrame, output: str, checkpoint: str, keys: Sequence[str] = ("system", "variant", "problem_id")
) -> StreamingQuery:
    """Append each key once, across batches, restarts and lost checkpoints.

    A batch keeps the first of its rows per key that the output does not hold yet, in a folder of its own; a replayed
    batch replaces its folder.  What was seen is read from the output's key columns, so there is no state that grows
    with the keys, and a key may return at any time.  Null keys are keys like any other.
    """
    keys = list(keys)

    def append_new(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{_source(checkpoint)}-{batch_id}"
        # one column of all keys, in which nulls are equal: rows are dealt by it once, for the first of each key and for the join
        key = F.struct(*keys)
        rows = batch.withColumn("__key", key).dropDuplicates(["__key"])
        try:
            held = spark.read.schema(batch.schema.add("batch", "string")).parquet(output)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = None
        if held is not None:
            rows = rows.join(held.filter(F.col("batch") != folder).select(key.alias("__key")), "__key", "left_anti")
        rows.drop("__key").write.mode("overwrite").parquet(f"{output}/batch={folder}")

    return (
        trials.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(append_new)
        .start()
    )


# --- policy learning --------------------------------------------------------------------


def stream_policy(logged: DataFrame, state: str, checkpoint: str, enabled: bool = True) -> StreamingQuery:
    """Add each micro-batch's moments to a state table.

    A batch overwrites its own partition, so a replayed batch counts once.
    """

    def learn(batch: DataFrame, batch_id: int) -> None:
        if enabled:
            policy_moments(batch).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    return (
        logged.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(learn)
        .start()
    )


# --- spans ------------------------------------------------------------------------------


def stream_scrub(
    spans: DataFrame, base: str, checkpoint: str, patterns: Sequence[str] | None = None
) -> StreamingQuery:
    """Scrub spans on arrival and append them under year/month/day."""
    return (
        dated_spans(spans, patterns)
        .writeStream.format("json")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .partitionBy("year", "month", "day")
        .trigger(availableNow=True)
        .start(base)
    )


def span_source(spark: SparkSession, path: str) -> DataFrame:
    return stream_source(spark, path, SPAN_SCHEMA)
