"""Joins between systems: paired trials, oracle labels, error lookups, Pareto frontier, conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arithmetic as ar
from ..functions import cost as fc
from ..functions import lexicon as lx
from .prefix import running


#: Columns that order the records of a key when none are named; a log has one of them.
TIMES = ("timestamp", "ts")


def time_order(trials: DataFrame, order: Sequence[str | Column] = ()) -> list[Column]:
    """The given order, else the log's own time column."""
    named = list(order) or [c for c in TIMES if c in trials.columns]
    return [F.col(o) if isinstance(o, str) else o for o in named]


def latest_by_id(
    trials: DataFrame,
    keys: Sequence[str] = ("system", "variant", "problem_id"),
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """The last record of each key, by the log's time column unless ``order`` names others.

    ``row_number() = 1`` lets Spark keep one row per key and map task before the
    shuffle (WindowGroupLimit), so a key with many copies stays small.
    """
    # the content decides between records that the order leaves equal, so every run keeps the same one
    content = F.xxhash64(*[F.col(f.name) for f in trials.schema if not isinstance(f.dataType, T.MapType)])
    newest = Window.partitionBy(*keys).orderBy(*[o.desc() for o in time_order(trials, order)], content)
    return trials.withColumn("__rn", F.row_number().over(newest)).filter("__rn = 1").drop("__rn")


def side_by_side(
    trials: DataFrame,
    systems: dict[str, str],
    fields: Sequence[str],
    keys: Sequence[str] = ("variant", "problem_id"),
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """One row per key with the fields of every named system, in a single shuffle.

    Stands for an inner join of the systems on ``keys``; ``systems`` maps an output prefix
    to a system name.  Of several records of a system and key the last one counts, as a
    whole: its fields travel in one struct behind the order, and decide where the order ties.
    """
    last = [o.alias(f"__o{i}") for i, o in enumerate(time_order(trials, order))]
    record = F.struct(*last, *[F.col(f) for f in fields])
    wide = (
        trials.filter(F.col("system").isin(list(systems.values())))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("system") == name, record)).alias(f"__{prefix}") for prefix, name in systems.items()])
    )
    for prefix in systems:
        wide = wide.filter(F.col(f"__{prefix}").isNotNull())
    return wide.select(*keys, *[F.col(f"__{p}")[f].alias(f"{p}_{f}") for p in systems for f in fields])


def paired(
    trials: DataFrame, first: str, second: str, variant: str | None = None, order: Sequence[str | Column] = ()
) -> DataFrame:
    rows = trials if variant is None else trials.filter(F.col("variant") == variant)
    return side_by_side(rows, {"first": first, "second": second}, ["correct"], order=order)


def oracle_labels(trials: DataFrame, fast: str, slow: str, order: Sequence[str | Column] = ()) -> DataFrame:
    """Best action per (variant, problem); question data come from the fast side."""
    wide = side_by_side(trials, {"fast": fast, "slow": slow}, ["ground_truth", "final_answer", "correct"], order=order)
    return _labelled(wide, "fast", ["variant", "problem_id"])


def oracle_labels_global(trials: DataFrame, fast: str, slow: str, order: Sequence[str | Column] = ()) -> DataFrame:
    """Best action per problem across variants; question data come from the slow side."""
    fields = ["variant", "template_id", "ground_truth", "final_answer", "correct"]
    newest = ["variant", *time_order(trials, order)]
    wide = side_by_side(trials, {"fast": fast, "slow": slow}, fields, keys=["problem_id"], order=newest)
    wide = wide.withColumnsRenamed({"slow_variant": "variant", "slow_template_id": "template_id"})
    return _labelled(wide, "slow", ["problem_id", "variant", "template_id"])


def _labelled(wide: DataFrame, truth_side: str, keys: list[str]) -> DataFrame:
    fast, slow = F.col("fast_correct"), F.col("slow_correct")
    return wide.select(
        *keys,
        F.col(f"{truth_side}_ground_truth").alias("ground_truth"),
        F.col("fast_final_answer").alias("fast_answer"),
        "fast_correct",
        F.col("slow_final_answer").alias("slow_answer"),
        "slow_correct",
        fc.oracle_action(fast, slow).alias("action"),
        fc.action_name(fc.oracle_action(fast, slow)).alias("oracle_action"),
        fc.oracle_reason(fast, slow).alias("oracle_reason"),
    )


def unmatched(trials: DataFrame, fast: str, slow: str) -> DataFrame:
    """Problems of the slow side that the fast side never saw."""
    s = trials.filter(F.col("system") == slow).select("problem_id")
    f = trials.filter(F.col("system") == fast).select("problem_id")
    return s.join(f, "problem_id", "left_anti")


def oracle_accuracy(
    trials: DataFrame, system: str, fast: str, slow: str, order: Sequence[str | Column] = ()
) -> DataFrame:
    """Share of a system's problems, among those both baselines saw, that a perfect router solves."""
    wide = side_by_side(trials, {"own": system, "fast": fast, "slow": slow}, ["correct"], order=order)
    return wide.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("fast_correct") | F.col("slow_correct")).alias("oracle_correct"),
    ).withColumn("oracle_accuracy", F.col("oracle_correct") / F.col("n"))


# --- error categories ----------------------------------------------------------


def error_category(error_type: Column, correct: Column) -> Column:
    """Category of a failed trial; null for a correct one."""
    known = F.when(error_type.isin(lx.ERROR_CATEGORIES), error_type).otherwise(F.lit(lx.UNKNOWN_ERROR))
    blank = F.coalesce(error_type, F.lit("")) == ""
    return F.when(~correct, F.when(blank, F.lit(lx.WRONG_ANSWER)).otherwise(known))


def map_error_category(trials: DataFrame) -> DataFrame:
    return trials.withColumn("category", error_category(F.col("error_type"), F.col("correct")))


def error_diff(trials: DataFrame, first: str, second: str) -> DataFrame:
    """Failures per category of two systems; a category one of them lacks counts zero."""
    counts = (
        map_error_category(trials.filter(F.col("system").isin(first, second)))
        .filter(F.col("category").isNotNull())
        .groupBy("system", "category")
        .count()
    )
    left = counts.filter(F.col("system") == first).select("category", F.col("count").alias("count_first"))
    right = counts.filter(F.col("system") == second).select("category", F.col("count").alias("count_second"))
    return (
        left.join(right, "category", "full_outer")
        .fillna(0, ["count_first", "count_second"])
        .withColumn("difference", F.col("count_first") - F.col("count_second"))
    )


# --- Pareto frontier -------------------------------------------------------------


def pareto_frontier(points: DataFrame, cost: str, score: str) -> DataFrame:
    """Rows that no other row beats with a strictly lower cost and a strictly higher score.

    One best score per distinct cost, then a distributed running maximum over the
    cheaper costs: no pairwise comparison and no single-task window.
    """
    best = points.groupBy(cost).agg(F.max(score).alias("__best"))
    bars = running(best, [], [cost], best_before={"__bar": "__best"})
    # costs whose best row is dominated hold no survivor, so only the staircase is joined back
    stairs = bars.filter(F.col("__bar").isNull() | (F.col("__best") >= F.col("__bar"))).select(cost, "__bar")
    joined = points.join(stairs, cost)
    return joined.filter(F.col("__bar").isNull() | (F.col(score) >= F.col("__bar"))).drop("__bar")


# --- unit conversion ---------------------------------------------------------------


def unit_factors(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(lx.UNIT_FACTORS, "from_unit string, to_unit string, factor bigint")


def convert_units(quantities: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """(entity, value, unit) rows in every directly related unit: multiplied forward, floor-divided back.

    The default table has thirteen rows and is broadcast; a given one is joined as its size allows.
    """
    table = F.broadcast(unit_factors(quantities)) if factors is None else factors
    base = [c for c in quantities.columns if c not in ("val", "unit")]
    ahead = quantities.join(table, F.col("unit") == F.col("from_unit")).select(
        *base, F.col("to_unit").alias("unit"), ar.mul(F.col("val"), F.col("factor")).alias("val")
    )
    back = quantities.join(table, F.col("unit") == F.col("to_unit")).select(
        *base, F.col("from_unit").alias("unit"), ar.floor_div(F.col("val"), F.col("factor")).alias("val")
    )
    return ahead.union(back).distinct()
