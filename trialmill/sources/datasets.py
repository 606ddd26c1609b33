"""Dataset records, label tables, bandit text and trace spans on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.metrics import dataset_metadata, oracle_stats

DATASET_SCHEMA = (
    "id string, question string, answer string, template_id string, is_noop boolean, instance int, "
    "final_answer string, original_question string, original_answer string, variant string, canary string"
)
METADATA_SCHEMA = (
    "variant string, generated long, templates long, errors long, noop_records long, fields array<string>, canary string, "
    "generated_at string"
)
SPAN_SCHEMA = (
    "id string, name string, run_type string, parent_id string, start_time string, end_time string, error string, "
    "inputs map<string,string>, outputs map<string,string>, metadata map<string,string>"
)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines records; mixed answers stay text with a numeric twin ``final_number``."""
    rows = spark.read.schema(DATASET_SCHEMA).json(path)
    return rows.withColumn("final_number", F.col("final_answer").try_cast("double"))


def write_dataset(df: DataFrame, path: str, append: bool = False) -> None:
    df.drop("final_number").write.mode("append" if append else "overwrite").json(path)


def write_metadata(records: DataFrame, path: str) -> None:
    """One JSON document per variant and one for the whole: counts, field names, marker and time of writing."""
    fields = F.array(*[F.lit(c) for c in records.columns])
    documents = dataset_metadata(records).withColumns(
        {"fields": fields, "canary": F.lit(tx.CANARY), "generated_at": F.current_timestamp().cast("string")}
    )
    documents.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(path)


def load_problems(records: DataFrame, variants: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(problem_id, question, answer, template_id, variant) rows, the first ``limit`` by id."""
    rows = records if variants is None else records.filter(F.col("variant").isin(list(variants)))
    out = rows.select(
        F.col("id").alias("problem_id"), "question", F.col("final_answer").try_cast("double").cast("bigint").alias(
            "answer"), "template_id", "variant",
    )
    return out if limit is None else out.orderBy("problem_id", "variant").limit(limit)


def save_labels(labels: DataFrame, path: str) -> None:
    """Labels as a table partitioned by variant, with their counts beside them."""
    labels.write.mode("overwrite").partitionBy("variant").parquet(f"{path}/labels")
    saved = labels.sparkSession.read.parquet(f"{path}/labels")
    oracle_stats(saved).write.mode("overwrite").json(f"{path}/stats")


def load_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/labels"), spark.read.json(f"{path}/stats")


def write_bandit_text(examples: DataFrame, path: str, column: str = "example") -> None:
    """Multi-line examples, each followed by a blank line."""
    examples.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def read_bandit_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "example")


def dated_spans(spans: DataFrame, patterns: Sequence[str] | None = None) -> DataFrame:
    """Scrubbed spans with the date parts of their start, which name their folder, dealt out by day.

    A day lies in one task, so that a folder gets one file and not one from every task; a long day is cut by start and id.
    """
    cols = [c for c in ("inputs", "outputs", "metadata", "error") if c in spans.columns]
    start = F.col("start_time").cast("timestamp")
    dated = spans.withColumns(
        {
            "year": F.date_format(start, "yyyy"),
            "month": F.date_format(start, "MM"),
            "day": F.date_format(start, "dd"),
        }
    )
    # before the scrubbing, as the rows are read once more for the bounds
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dated.repartitionByRange(n, "year", "month", "day", *[c for c in ("start_time", "id") if c in spans.columns])
    return tx.scrub_credentials(dealt, cols) if patterns is None else tx.scrub_credentials(dealt, cols, patterns)


def write_spans(spans: DataFrame, base: str, patterns: Sequence[str] | None = None) -> None:
    dated_spans(spans, patterns).write.mode("append").partitionBy("year", "month", "day").json(base)


def read_spans(spark: SparkSession, base: str, schema: str = SPAN_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(base)
