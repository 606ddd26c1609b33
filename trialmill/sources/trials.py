"""Trial logs and pilot logs as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TRIAL_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("problem_id", _S), ("template_id", _S), ("variant", _S), ("question", _S), ("system", _S),
            ("ground_truth", _I), ("path_taken", _S), ("final_answer", _I), ("correct", _B), ("tokens_input", _I),
            ("tokens_output", _I), ("execution_time_ms", _D), ("iterations", _I), ("solver_feedback", _S),
            ("error_type", _S), ("self_corrected", _B), ("bandit_action", _S), ("bandit_probability", _D),
            ("timestamp", _S),
        ]
    ]
)
PILOT_SCHEMA = (
    "problem_id string, variant string, question string, expected_answer int, predicted_answer int, correct boolean, "
    "path_taken string, routing_prob double, latency_ms double, error string"
)
PATHS = ["fast", "slow", "baseline"]
_BAD = "_corrupt_record"


def _checked(rows: DataFrame) -> DataFrame:
    """Defaults for absent counters; an unknown path stops the job."""
    path = F.when(F.col("path_taken").isin(PATHS), F.col("path_taken")).otherwise(
        F.raise_error(F.concat(F.lit("unknown path_taken: "), F.coalesce("path_taken", F.lit("null"))))
    )
    return rows.withColumn("path_taken", path).fillna(
        {"tokens_input": 0, "tokens_output": 0, "execution_time_ms": 0.0, "iterations": 0, "self_corrected": False}
    )


def _named(path: Column) -> list[Column]:
    """system and variant of ``<system>/<variant>.jsonl``, a file or a folder of that name with part files."""
    ending = ".jsonl"
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    # cut at slashes: a pattern would be searched for from each letter of the path, for each line
    file = F.when(F.endswith(folder, F.lit(ending)), F.substring_index(F.substring_index(path, "/", -3), "/", 2)).otherwise(F.substring_index(path, "/", -2))
    name = F.substring_index(file, "/", -1)
    return [F.substring_index(file, "/", 1).alias("system"), F.left(name, F.length(name) - len(ending)).alias("variant")]


def _parsed(
    spark: SparkSession, root: str, systems: Sequence[str], variants: Sequence[str], layout: str, files_per_batch: int | None = None,
    stream: bool = False,
) -> DataFrame:
    """(line, system, variant, rec, bad) of every line that is not blank, of a table or a stream of files.

    Lines are read as text and parsed once with the whole schema, so what counts as
    malformed does not depend on the columns a query selects.  A record without
    ``problem_id`` is bad too.  The record comes out of a generator, as a filter on it would else be pushed below the
    parser together with a parser for each of its conditions.
    """
    schema = T.StructType([*TRIAL_SCHEMA.fields, T.StructField(_BAD, _S)])
    reader = spark.readStream if stream else spark.read
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if layout == "files":
        # one glob: combinations that do not exist are skipped
        names = "{" + ",".join(systems) + "}", "{" + ",".join(variants) + "}"
        lines = reader.text(f"{root}/{names[0]}/{names[1]}.jsonl").select("value", *_named(F.col("_metadata.file_path")))
    else:
        stored = T.StructType([T.StructField("value", _S), T.StructField("system", _S), T.StructField("variant", _S)])
        lines = reader.schema(stored).text(root)
        lines = lines.filter(F.col("system").isin(list(systems)) & F.col("variant").isin(list(variants)))
    # options keep the optimizer from narrowing the schema to the selected fields
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    rows = lines.filter(F.trim("value") != "").withColumn("rec", F.explode(F.array(F.from_json("value", schema, options))))
    bad = F.col("rec").isNull() | F.col(f"rec.{_BAD}").isNotNull() | F.col("rec.problem_id").isNull()
    return rows.withColumn("bad", bad)


def _fields(rows: DataFrame) -> DataFrame:
    own = [f.name for f in TRIAL_SCHEMA if f.name not in ("system", "variant")]
    record = rows.select("value", "system", "variant", *[F.col(f"rec.{c}").alias(c) for c in own])
    return record.select("value", *[f.name for f in TRIAL_SCHEMA])


def read_trials(
    spark: SparkSession,
    root: str,
    systems: Sequence[str] = tuple(lx.SYSTEMS),
    variants: Sequence[str] = tuple(lx.VARIANTS),
    layout: str = "table",
) -> DataFrame:
    """Trials of the known systems and variants.

    ``layout="files"`` reads ``<system>/<variant>.jsonl``; ``"table"`` the partitioned
    folders of ``write_trials``.  Blank lines are skipped.  Malformed lines, fields of the
    wrong type and records without ``problem_id`` are left to ``quarantined_trials``; every
    other line is here, whichever columns are selected.
    """
    rows = _parsed(spark, root, systems, variants, layout).filter(~F.col("bad"))
    return _checked(_fields(rows).drop("value"))


def stream_trial_log(
    spark: SparkSession,
    root: str,
    systems: Sequence[str] = tuple(lx.SYSTEMS),
    variants: Sequence[str] = tuple(lx.VARIANTS),
    layout: str = "table",
    files_per_batch: int | None = None,
    quarantine: bool = False,
) -> DataFrame:
    """The rows of ``read_trials``, or with ``quarantine`` those of ``quarantined_trials``, as files arrive.

    Batch and stream share one parser.  Folders of other systems and variants are never listed (``files``) or opened (``table``).
    """
    rows = _parsed(spark, root, systems, variants, layout, files_per_batch, stream=True)
    if quarantine:
        return _fields(rows.filter("bad")).withColumnRenamed("value", "line")
    return _checked(_fields(rows.filter(~F.col("bad"))).drop("value"))


def quarantined_trials(
    spark: SparkSession,
    root: str,
    systems: Sequence[str] = tuple(lx.SYSTEMS),
    variants: Sequence[str] = tuple(lx.VARIANTS),
    layout: str = "table",
) -> DataFrame:
    """The other lines, next to the fields that could be read from them."""
    rows = _parsed(spark, root, systems, variants, layout).filter("bad")
    return _fields(rows).withColumnRenamed("value", "line")


def write_trials(trials: DataFrame, root: str, append: bool = False) -> None:
    """Packed JSON lines under ``system=<s>/variant=<v>``; every task writes its own files, so none grows with the log."""
    writer = trials.write.mode("append" if append else "overwrite").option("compression", "gzip")
    writer.partitionBy("system", "variant").json(root)


def read_pilot_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PILOT_SCHEMA).json(path)


def pilot_as_trials(pilot: DataFrame, system: str = "bandit") -> DataFrame:
    """The narrower pilot log under the trial columns."""
    return pilot.select(
        "problem_id",
        "variant",
        "question",
        F.lit(system).alias("system"),
        F.col("expected_answer").alias("ground_truth"),
        F.col("predicted_answer").alias("final_answer"),
        "correct",
        "path_taken",
        F.col("routing_prob").alias("bandit_probability"),
        F.col("latency_ms").alias("execution_time_ms"),
        F.col("error").alias("error_type"),
    )


def union_logs(trials: DataFrame, pilot: DataFrame) -> DataFrame:
    return trials.unionByName(pilot_as_trials(pilot), allowMissingColumns=True)
