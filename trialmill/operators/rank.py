"""Rankings, cycles, attempt outcomes, splits, progress and round-robin assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio
from .pairs import latest_by_id, time_order
from .prefix import running

__all__ = [
    "rank_systems", "top_errors", "detect_cycles", "attempt_outcome", "latest_by_id", "split_first", "progress",
    "stratified_assign", "shared_ids",
]

# metric -> (column, descending, zero counts as worst, compare magnitudes)
RANKINGS = {
    "rrr": ("rrr", True, False, False),
    "drop": ("accuracy_drop", False, False, False),
    "resilience": ("total_drop", False, False, False),
    "p2_accuracy": ("p2_accuracy", True, False, False),
    "slope": ("decay_slope", False, False, True),
    "accuracy": ("accuracy", True, False, False),
    "correction": ("correction_success_rate", True, False, False),
    "efficiency": ("cost_per_correct_usd", False, True, False),
}


def rank_systems(summary: DataFrame, metric: str) -> DataFrame:
    """Rank the rows of a per-system summary (one row per system) by a named metric, names break ties."""
    column, descending, zero_last, magnitude = RANKINGS[metric]
    value = F.abs(F.col(column)) if magnitude else F.col(column)
    if zero_last:
        value = F.when(value > 0, value).otherwise(F.lit(float("inf")))
    order = Window.orderBy(value.desc() if descending else value.asc(), F.col("system"))
    return summary.select(
        F.row_number().over(order).alias("rank"), "system", F.col(column).alias("value"), F.lit(metric).alias("metric")
    )


def top_errors(breakdown: DataFrame, n: int, per_system: bool = True) -> DataFrame:
    """The n most frequent categories per system, or pooled over systems."""
    if per_system:
        order = Window.partitionBy("system").orderBy(F.desc("error_count"), "category")
        return (
            breakdown.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= n)
            .select("system", "rank", "category", "error_count")
        )
    pooled = breakdown.groupBy("category").agg(F.sum("error_count").alias("error_count"))
    return pooled.orderBy(F.desc("error_count"), "category").limit(n)


def detect_cycles(attempts: DataFrame) -> DataFrame:
    """Flag attempts whose code repeats an earlier attempt of the same problem.

    The first attempt per code comes from a combining aggregate.  It is matched back on
    the attempt number as well, so the join key is unique and a code repeated in a large
    share of the rows does not gather in one task.
    """
    hashed = attempts.withColumn("code_hash", F.md5(F.coalesce("code", F.lit(""))))
    first = hashed.groupBy("problem_id", "code_hash").agg(F.min("attempt").alias("attempt"))
    return (
        hashed.join(first.withColumn("__first", F.lit(True)), ["problem_id", "code_hash", "attempt"], "left")
        .withColumn("is_cycle", F.col("__first").isNull())
        .drop("__first")
    )


def attempt_outcome(attempts: DataFrame, max_retries: int = 5) -> DataFrame:
    """Where and why each problem's attempts end: success, then cycle, then the retry limit, else still open."""
    seen = detect_cycles(attempts)
    won = F.col("result") == "success"
    out = seen.groupBy("problem_id").agg(
        F.min(F.when(won, F.col("attempt"))).alias("won"),
        F.min(F.when(F.col("is_cycle"), F.col("attempt"))).alias("looped"),
        F.min(F.when(F.col("attempt") >= max_retries, F.col("attempt"))).alias("spent"),
        F.max("attempt").alias("last"),
    )
    end = F.least("won", "looped", "spent")
    outcome = (
        F.when(end.isNull(), "reflect")
        .when(F.col("won") == end, "success")
        .when(F.col("looped") == end, "cycle_detected")
        .otherwise("max_retries")
    )
    return out.select(
        "problem_id", outcome.alias("outcome"), F.coalesce(end, F.col("last")).alias("end_attempt"),
        F.col("last").alias("logged_attempts"),
    )


def split_first(df: DataFrame, n_train: int, n_test: int, order: Sequence[str] = ("problem_id",)) -> DataFrame:
    """The first ``n_train`` rows as train and the next ``n_test`` as test.

    Rows are ranked slice by slice, and slices beyond the asked rows are left out before the exchange: no task sorts all of a split.
    """
    ranked = running(df, [], order, rank="position", upto=n_train + n_test)
    return ranked.withColumn("split", F.when(F.col("position") <= n_train, "train").otherwise("test"))


def progress(
    trials: DataFrame, batch: int = 50, keys: Sequence[str] = ("system", "variant"),
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """Cumulative accuracy of each run after every ``batch`` problems and at its end, by time unless ordered otherwise."""
    by = [*time_order(trials, order), F.col("problem_id"), F.col("correct")]
    named = [f"__o{i}" for i in range(len(by))]
    hits = trials.select(*keys, *[o.alias(n) for o, n in zip(by, named)], F.col("correct").cast("int").alias("hit"))
    ranked = running(hits, keys, named, rank="done", sums={"correct_so_far": "hit"}, total="__n")
    marks = ranked.filter((F.col("done") % batch == 0) | (F.col("done") == F.col("__n")))
    return marks.select(
        *keys, "done", "correct_so_far", ratio(F.col("correct_so_far"), F.col("done")).alias("accuracy")
    )


def stratified_assign(
    slots: DataFrame, blocks: int = 10, group: str = "problem_id", order: Sequence[str | Column] = ("slot",)
) -> DataFrame:
    """Give the slots of each problem the name blocks 0, 1, ... in turn."""
    ranked = running(slots, [group], order, rank="position")
    return ranked.withColumn("block", ((F.col("position") - 1) % blocks).cast("int"))


def shared_ids(trials: DataFrame, first: str, second: str) -> DataFrame:
    """(variant, problem) keys that both systems ran."""
    keys = ["variant", "problem_id"]
    a = trials.filter(F.col("system") == first).select(*keys)
    return a.intersect(trials.filter(F.col("system") == second).select(*keys))
