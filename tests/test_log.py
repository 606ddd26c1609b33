"""Logs as they come: retries, mistyped fields, null keys, shared ids, lost values."""

import json

import pytest
from pyspark.sql import functions as F

from trialmill.functions import text as tx
from trialmill.operators import corpus, ledger, metrics, pairs, rank, routing
from trialmill.plans.report import full_report
from trialmill.sources import trials as log

TRIAL = {"problem_id": "p1", "path_taken": "slow", "correct": True, "ground_truth": 3, "final_answer": 3}


def test_rows_do_not_depend_on_the_columns(spark, tmp_path):
    folder = tmp_path / "bandit"
    folder.mkdir()
    lines = [TRIAL, TRIAL | {"tokens_input": "many"}, {k: v for k, v in TRIAL.items() if k != "problem_id"}, TRIAL | {"problem_id": "p2"}]
    (folder / "base.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken")
    good = log.read_trials(spark, str(tmp_path), layout="files")
    bad = log.quarantined_trials(spark, str(tmp_path), layout="files")
    assert good.count() == 2 == len(good.select("problem_id").collect()) == len(good.collect()) == len(good.select("tokens_input").collect())
    assert bad.count() == 3 == len(bad.select("line").collect()) == len(bad.collect())


def test_report_over_a_log_with_retries(spark, tmp_path):
    rows = [
        TRIAL | {"system": s, "variant": v, "problem_id": str(i), "correct": (i + len(s)) % 3 > 0, "timestamp": "2024-01-02T00:00:00"}
        for s in ("fixed_slow", "baseline_large") for v in ("base", "noop", "p1", "p2") for i in range(6)
    ]
    early = [r | {"correct": not r["correct"], "timestamp": "2024-01-01T00:00:00"} for r in rows]
    df = spark.createDataFrame([json.dumps(r) for r in early + rows], "string").select(F.from_json("value", log.TRIAL_SCHEMA).alias("r")).select("r.*")
    log.write_trials(df, str(tmp_path / "log"))
    read = log.read_trials(spark, str(tmp_path / "log"))
    report = full_report(read, "fixed_slow", "baseline_large")
    total = report["accuracy"].filter("system = 'all'").first()
    assert (total["n"], total["n_correct"]) == (48, sum(r["correct"] for r in rows))
    assert rank.progress(pairs.latest_by_id(read), 3).count() == 16
    # the tables follow from the counted cells alone; only the pairs of the test read the log again
    for name, plain in (("robustness", metrics.robustness), ("complexity", metrics.complexity_decay), ("cost", metrics.cost_summary),
                        ("errors", metrics.error_breakdown), ("self_correction", metrics.self_correction)):
        scans = report[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "problem_id" not in scans and scans.count("Relation [") + scans.count("Relation[") == 1
        assert set(report[name].collect()) == set(plain(pairs.latest_by_id(read)).collect())
    assert report["significance"]._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 1


def test_cells_of_odd_rows(spark):
    """Null outcomes, paths, counts and probabilities: cells give what the rows give."""
    rows = [
        ("a", "base", None, True, None, 3, 1, 2.5, 0, None, True), ("a", None, "fast", None, "UNSAT", None, None, None, 4, 0.5, None),
        ("a", "noop", "slow", False, "", 1, 1, 1.0, 1, 0.25, False), (None, "p1", "fast", False, "odd", 2, 2, 2.0, 2, None, False),
    ]
    df = spark.createDataFrame(
        rows * 3, "system string, variant string, path_taken string, correct boolean, error_type string, tokens_input int, tokens_output int, "
        "execution_time_ms double, iterations int, bandit_probability double, self_corrected boolean",
    )
    cells = metrics.report_cells(df)
    for plain in (metrics.accuracy, metrics.robustness, metrics.complexity_decay, metrics.cost_summary, metrics.error_breakdown, metrics.self_correction, metrics.routing_summary):
        assert sorted(map(str, plain(cells, weight=metrics.CELL_ROWS).collect())) == sorted(map(str, plain(df).collect()))


def test_last_record_counts_as_a_whole(spark):
    rows = [("a", "v", "1", True, 5, 1), ("a", "v", "1", False, 7, 2), ("b", "v", "1", True, 9, 1), ("b", "v", "1", True, None, 3)]
    df = spark.createDataFrame(rows, "system string, variant string, problem_id string, correct boolean, final_answer int, ts int")
    got = pairs.side_by_side(df, {"x": "a", "y": "b"}, ["correct", "final_answer"]).first().asDict()
    assert got == {"variant": "v", "problem_id": "1", "x_correct": False, "x_final_answer": 7, "y_correct": True, "y_final_answer": None}
    assert pairs.paired(df, "a", "b").first()["first_correct"] is False
    tied = df.withColumn("ts", F.lit(1))
    assert {pairs.latest_by_id(tied.repartition(n)).filter("system = 'a'").first()["final_answer"] for n in (1, 3, 7)} in ({5}, {7})


def test_null_keys_are_no_totals(spark):
    df = spark.createDataFrame([(None, "base", True), ("s", None, False)], "system string, variant string, correct boolean")
    got = {(r["system"], r["variant"]): r["n"] for r in metrics.accuracy(df).collect()}
    assert got == {(None, "base"): 1, (None, "all"): 1, ("s", None): 1, ("s", "all"): 1, ("all", "all"): 2}


def test_system_without_tiers_scores_zero(spark):
    df = spark.createDataFrame([("s", "noop", True)], "system string, variant string, correct boolean")
    got = metrics.complexity_decay(df).first()
    assert got["system"] == "s" and got["base_accuracy"] == got["p2_accuracy"] == 0.0


def test_labels_match_on_both_keys(spark):
    labels = spark.createDataFrame([("base", "1", True, True), ("noop", "1", False, True)], "variant string, problem_id string, fast_correct boolean, slow_correct boolean")
    chosen = labels.select("variant", "problem_id", F.lit(0).alias("action"))
    assert routing.replay_policy(labels, chosen).first()["total"] == 2
    many = spark.range(400).select(F.lit("v").alias("variant"), F.col("id").cast("string").alias("problem_id"), F.lit(True).alias("fast_correct"), F.lit(True).alias("slow_correct"))
    both = routing.simulate_logging(many.union(many.withColumn("variant", F.lit("w"))))
    explored = both.groupBy("problem_id").agg(F.count_distinct("explored").alias("n")).filter("n = 2").count()
    assert explored > 0


def test_lost_values_stop_the_job(spark):
    rel = spark.createDataFrame([(1, "multiple", 2, 1, 5)], "problem_id long, kind string, entity long, other long, amount long")
    start = spark.createDataFrame([(1, 1, 4 * 10**18)], "problem_id long, entity long, val long")
    with pytest.raises(Exception, match="64 bits"):
        ledger.derive_relations(rel, start).collect()


def test_conflicting_problem_has_no_states(spark):
    initial = spark.createDataFrame([(1, 1, "x", 3), (1, 1, "x", 4), (2, 1, "x", 3)], "problem_id long, entity long, attr string, val long")
    ops = spark.createDataFrame([(1, 1, "x", 0, "add_to", 2), (2, 1, "x", 0, "add_to", 2)], "problem_id long, entity long, attr string, step long, op string, amount long")
    folded = ledger.fold_timeline(initial, ops, spark.createDataFrame([(1, 2), (2, 2)], "problem_id long, max_step long"))
    for states in (ledger.timeline(folded), ledger.persist(folded), ledger.final_value(folded)):
        assert {r["problem_id"] for r in states.collect()} == {2}
    assert {r["problem_id"] for r in ledger.hard_violations(folded, ops, spark.createDataFrame([(1, 2), (2, 2)], "problem_id long, max_step long")).collect()} == {1}


def test_distractor_counts_are_checked(spark):
    problems = spark.createDataFrame([("1", "How many apples?")], "id string, question string")
    for n in (0, 4):
        with pytest.raises(ValueError, match="distractors"):
            corpus.pick_distractors(problems, n)


def test_rules_keep_one_row_per_error(spark):
    df = spark.createDataFrame([(1, "RUNTIME", "Zero here"), (2, "OTHER", "fine"), (3, None, "zero")], "id int, error_type string, message string")
    rules = spark.createDataFrame([(2, None, "zero", "b"), (1, "RUNTIME", None, "a"), (3, "RUNTIME", None, "c")], "position int, error_type string, mentions string, text string")
    assert {r["id"]: r["advice"] for r in tx.annotate_errors(df, rules).collect()} == {1: ["a", "b", "c"], 2: [], 3: ["b"]}
    assert {r["id"]: r["advice"] for r in tx.annotate_errors(df, rules.limit(0)).collect()} == {1: [], 2: [], 3: []}
