"""The full analysis of a trial log in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import stats as st
from ..operators.pairs import latest_by_id
from ..session import cut_lineage

ROUTED = ["bandit", "random"]


def full_report(
    trials: DataFrame, first: str, second: str, intervals: bool = False, resamples: int = st.RESAMPLES,
    deduplicate: bool = True,
) -> dict[str, DataFrame]:
    """Accuracy, robustness, complexity, cost, errors, self-correction, routing and paired tests.

    With ``deduplicate`` the last record per key counts.  The log is read twice, whatever the number of tables: once into the
    counted cells that all tables follow from, kept as a small written table, and once for the pairs of the test.
    Intervals read it once more for what is resampled.
    """
    rows = latest_by_id(trials) if deduplicate else trials
    cells, each = cut_lineage(m.report_cells(rows)), m.CELL_ROWS
    report = {
        "accuracy": m.accuracy(cells, each),
        "robustness": m.robustness(cells, each),
        "complexity": m.complexity_decay(cells, each),
        "cost": m.cost_summary(cells, weight=each),
        "errors": m.error_breakdown(cells, weight=each),
        "self_correction": m.self_correction(cells, weight=each),
        "routing": m.routing_summary(cells.filter(F.col("system").isin(ROUTED)), weight=each),
    }
    if intervals:
        report = st.attach_intervals(rows, report, resamples)
    tests = st.mcnemar(rows.filter(F.col("variant").isin("base", "noop")), first, second)
    return {"trials": rows, **report, "significance": tests}


def headline(trials: DataFrame, reference: str) -> DataFrame:
    """How much accuracy each system keeps under distractors, and its paired test against a reference system."""
    kept = m.robustness(trials)
    base = trials.filter(F.col("variant") == "base").select("system", "problem_id", "correct")
    ref = base.filter(F.col("system") == reference).select("problem_id", F.col("correct").alias("__ref"))
    cells = (
        base.filter(F.col("system") != reference)
        .join(ref, "problem_id")
        .groupBy("system")
        .agg(
            F.count_if(F.col("correct") & ~F.col("__ref")).alias("n_sys1_only"),
            F.count_if(~F.col("correct") & F.col("__ref")).alias("n_sys2_only"),
        )
    )
    tests = st.mcnemar_of_counts(cells)
    return kept.join(tests.select("system", "statistic", "p_value", "significant"), "system", "left")
