"""Published counts give the published report."""

import pytest
from pyspark.sql import functions as F

from trialmill.operators import metrics as m
from trialmill.operators import stats as st
from trialmill.operators.pairs import latest_by_id
from trialmill.plans.report import full_report

SIZES = {"base": 2439, "p1": 1550, "p2": 566, "noop": 2439}
CORRECT = {
    "baseline_large": (1434, 803, 283, 1371),
    "baseline_small": (1088, 691, 207, 1012),
    "fixed_slow": (1939, 1024, 278, 1847),
    "bandit": (1598, 669, 140, 1563),
    "random": (1650, 662, 136, 1547),
}
# base and noop cells of fixed_slow against baseline_large: both, first only, second only, none
CELLS = {"base": (1173, 766, 261, 239), "noop": (1116, 731, 255, 337)}


@pytest.fixture(scope="module")
def trials(spark):
    rows = [
        (s, v, SIZES[v], CORRECT[s][i]) for s in CORRECT for i, v in enumerate(SIZES)
    ]
    plan = spark.createDataFrame(rows, "system string, variant string, n int, k int")
    numbered = plan.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    # fixed_slow is right on its first k problems, the large baseline on the shared ones and on the next c
    hit = F.col("i") <= F.col("k")
    for v, (a, b, c, _) in CELLS.items():
        here = (F.col("system") == "baseline_large") & (F.col("variant") == v)
        hit = F.when(here, (F.col("i") <= a) | ((F.col("i") > a + b) & (F.col("i") <= a + b + c))).otherwise(hit)
    return numbered.select(
        F.concat_ws("-", "variant", "i").alias("problem_id"),
        "system",
        "variant",
        hit.alias("correct"),
        F.lit("slow").alias("path_taken"),
        F.lit(None).cast("string").alias("error_type"),
        F.lit(1).alias("iterations"),
        F.lit(False).alias("self_corrected"),
        F.lit(300).alias("tokens_input"),
        F.lit(100).alias("tokens_output"),
        F.lit(5.0).alias("execution_time_ms"),
        F.lit(None).cast("double").alias("bandit_probability"),
        F.lit("2026-01-01").alias("ts"),
    ).persist()


def test_accuracy_and_robustness(trials):
    rob = {r["system"]: r for r in m.robustness(trials).collect()}
    kept = {s: round(r["rrr"], 3) for s, r in rob.items()}
    assert kept == {
        "bandit": 0.978, "baseline_large": 0.956, "fixed_slow": 0.953, "random": 0.938, "baseline_small": 0.930,
    }
    assert round(rob["fixed_slow"]["base_accuracy"] * 100, 2) == 79.50
    overall = {r["system"]: round(r["accuracy"] * 100, 2) for r in m.cost_summary(trials).collect()}
    assert overall == {
        "baseline_large": 55.63, "baseline_small": 42.87, "fixed_slow": 72.75, "bandit": 56.76, "random": 57.12,
    }


def test_decay(trials):
    decay = {r["system"]: round(r["per_tier_decay"] * 100, 2) for r in m.complexity_decay(trials).collect()}
    assert decay == {
        "fixed_slow": 15.19, "baseline_large": 4.40, "baseline_small": 4.02, "bandit": 20.39, "random": 21.81,
    }


def test_paired_test(trials):
    rows = {r["variant"]: r for r in st.mcnemar(trials, "fixed_slow", "baseline_large").collect()}
    assert round(rows["base"]["statistic"], 4) == 247.3379
    assert round(rows["noop"]["statistic"], 4) == 228.8286
    for v, cells in CELLS.items():
        got = tuple(rows[v][c] for c in ("n_both_correct", "n_sys1_only", "n_sys2_only", "n_both_wrong"))
        assert got == cells
        assert rows[v]["significant"]


def test_full_report(trials):
    report = full_report(trials, "fixed_slow", "baseline_large", intervals=True, resamples=400)
    rob = {r["system"]: r for r in report["robustness"].collect()}["fixed_slow"]
    assert rob["base_ci_lower"] < rob["base_accuracy"] < rob["base_ci_upper"]
    assert rob["drop_ci_lower"] < rob["accuracy_drop"] < rob["drop_ci_upper"]
    assert report["significance"].count() == 2
    report["trials"].unpersist()


def test_last_record_wins(spark):
    log = spark.createDataFrame(
        [("a", "base", "1", True, 1), ("a", "base", "1", False, 2), ("a", "base", "2", True, 1)],
        "system string, variant string, problem_id string, correct boolean, ts int",
    )
    got = {r["problem_id"]: r["correct"] for r in latest_by_id(log).collect()}
    assert got == {"1": False, "2": True}
