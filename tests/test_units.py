"""Hand-checked cases."""

import pytest
from pyspark.sql import functions as F

from trialmill.functions import arithmetic as ar
from trialmill.functions import cost as fc
from trialmill.functions import text as tx
from trialmill.operators import checks, corpus, ledger, metrics, pairs, rank, routing


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_loss_and_regret(spark):
    for correct, action, want in [(True, 0, 0.1), (True, 1, 1.0), (False, 0, 10.1), (False, 1, 11.0)]:
        assert one(spark, fc.loss(F.col("c"), F.col("a")), c=correct, a=action) == pytest.approx(want)
    for f, s, a, want in [(True, True, 0, 0), (True, True, 1, 0.9), (False, True, 1, 0), (False, True, 0, 9.1)]:
        got = one(spark, fc.regret(F.col("a"), F.col("f"), F.col("s")), a=a, f=f, s=s)
        assert got == pytest.approx(want)


def test_answers(spark):
    marker = [("#### 42", "42"), ("#### 15.5", "15.5"), ("#### -10", "-10"), ("last number is 99", "99"), ("none", None),
              ("#### 1,234", "1"), ("1,234 apples", "1234")]
    for text, want in marker:
        assert one(spark, tx.answer_marker(F.col("t")), t=text) == want
    tagged = [("ANSWER: 42", 42), ("ANSWER: 12.7", 13), ("ANSWER: 12.5", 12), ("Total = 55", 55), ("which gives us 7", 7),
              ("no numbers", None)]
    for text, want in tagged:
        assert one(spark, tx.answer_tagged(F.col("t")), t=text) == want
    for text, want in [("so #### 5 and 6", 5), ("The Answer is: 8.", 8), ("a = 3\nthen 4 more", 3), ("1 and 2", 2)]:
        assert one(spark, tx.answer_cot(F.col("t")), t=text) == want
    assert one(spark, tx.answer_strict(F.col("t")), t="the answer is 3") is None


def test_features(spark):
    def feature(text, name):
        return one(spark, tx.explicit_features(F.col("t"))[name], t=text)

    assert feature("John has 5 apples.", "len_tokens") == 4
    assert feature("John has 5 apples.", "n_numbers") == 1
    assert feature("John has 5 apples.", "n_sentences") == 2
    assert feature("Half of them left", "has_fraction")
    assert feature("A rise of 20%.", "has_percentage")
    assert feature("It costs $25", "has_money")
    assert not feature("It costs much", "has_money")
    assert feature("How  many", "question_type") == "other"
    assert feature("How many?", "question_type") == "how_many"
    assert not tx_has_no(spark, "éno")
    assert feature("", "n_sentences") == 1 and feature("", "len_tokens") == 0


def tx_has_no(spark, text):
    return one(spark, tx.semantic_features(F.col("t"))["has_neg"], t=text)


def test_sparse_line(spark):
    vec = F.array(*[F.lit(v) for v in (0.0, 0.0, 1e-4, 0.0, 1.5, 0.0, -2.0, 1e-7)])
    line = one(spark, tx.format_warm_features(F.col("t"), vec), t="no")
    assert line == "|x pca_2:0.0000 pca_4:0.3000 pca_6:-0.4000 |e token_cnt:0.0050 has_neg:1 has_logic:0 has_quant:0"


def test_scrub_and_bullets(spark):
    key = "key-" + "a1" * 16
    nested = spark.range(1).select(
        F.create_map(F.lit("k"), F.array(F.lit(key), F.lit("plain"))).alias("m"),
        F.struct(F.lit("x " + key).alias("a"), F.lit(1).alias("b")).alias("s"),
    )
    row = tx.scrub_credentials(nested, ["m", "s"]).first()
    assert row["m"]["k"] == ["[REDACTED]", "plain"] and row["s"]["a"] == "x [REDACTED]" and row["s"]["b"] == 1
    assert one(spark, tx.extract_bullets(F.col("t")), t="x\n - a \n* b\n-c\n• d") == ["a", "b", "d"]


def test_code_block(spark):
    get = lambda t: one(spark, tx.extract_code_block(F.col("t")), t=t)
    assert get("a\n```\nplain\n```\n```ASP\n f(x). \n```") == "f(x)."
    assert get("Intro\n# head\nf(a, 1).\n**b**\ng(b).") == "f(a, 1).\ng(b)."
    assert get("  just words ") == "just words"


def test_arithmetic(spark):
    for a, b, q, r in [(7, 3, 2, 1), (-7, 3, -3, 2), (7, -3, -3, -2), (-7, -3, 2, -1)]:
        assert one(spark, ar.floor_div(F.col("a"), F.col("b")), a=a, b=b) == q
        assert one(spark, ar.floor_mod(F.col("a"), F.col("b")), a=a, b=b) == r
    value, error = ar.calc("div", F.col("a"), F.col("b"))
    assert one(spark, F.struct(value.alias("v"), error.alias("e")), a=1, b=0) == (None, "error_div_zero")
    assert one(spark, ar.power(F.col("a"), F.col("b")), a=-2, b=63) == -(2**63)
    value, error = ar.calc("mul", F.col("a"), F.col("b"))
    assert one(spark, F.struct(value.alias("v"), error.alias("e")), a=2**62, b=4) == (None, "error_overflow")
    assert one(spark, ar.decimal_mul(F.col("a"), F.col("b")), a=1250, b=-33) == -413


def test_conditions(spark):
    def check(text, **values):
        cols = {k: F.col(k).cast("double") for k in values}
        return one(spark, checks.template_condition(text, cols), **values)

    assert check("is_int(x)", x=5.0) and not check("is_int(x)", x=5.5)
    assert check("divides(a, b)", a=3, b=9) and not check("divides(a, b)", a=0, b=5)
    assert not check("a / b > 1", a=1, b=0)
    assert check("b == 0 or a / b > 1", a=1, b=0)
    assert check("1 < a <= 3 and not a == 2", a=3)
    for bad in ("__import__('os')", "x.y", "open(x)", "[x]"):
        with pytest.raises(ValueError):
            check(bad, x=1)


def test_oracle_cells(spark):
    labels = spark.createDataFrame(
        [("base", True, True), ("base", False, True), ("base", True, False), ("base", False, False)],
        "variant string, fast_correct boolean, slow_correct boolean",
    )
    row = metrics.oracle_stats(labels).filter("variant = 'overall'").first()
    assert (row["both_correct"], row["only_slow_correct"], row["only_fast_correct"], row["both_wrong"]) == (1, 1, 1, 1)
    many = spark.range(100).select(
        F.lit("base").alias("variant"),
        ((F.col("id") < 60) | (F.col("id") >= 85)).alias("fast_correct"),
        (F.col("id") < 70).alias("slow_correct"),
    )
    row = metrics.oracle_stats(many).filter("variant = 'overall'").first()
    assert row["fast_rate"] == pytest.approx(0.9) and row["oracle_accuracy"] == pytest.approx(0.85)
    best = routing.evaluate_oracle_policy(many).first()
    assert best["avg_regret"] == 0.0 and best["accuracy"] == pytest.approx(0.85)


def test_decision_metrics(spark):
    log = spark.createDataFrame(
        [(True, 0, True, True), (True, 0, None, None), (False, 0, False, True), (True, 1, True, True)],
        "correct boolean, action int, fast_correct boolean, slow_correct boolean",
    )
    row = metrics.decision_metrics(log).first()
    assert (row["accuracy"], row["fast_rate"], row["slow_rate"]) == (0.75, 0.75, 0.25)
    assert row["avg_regret"] == pytest.approx((0 + 9.1 + 0.9) / 3)


def test_votes(spark):
    rows = [("a", 1, 5), ("a", 2, 3), ("a", 3, 3), ("a", 4, 5), ("b", 1, None), ("c", 1, None), ("c", 2, 9)]
    samples = spark.createDataFrame(
        [(p, i, a, 1, 1) for p, i, a in rows],
        "problem_id string, sample_idx int, answer int, tokens_input int, tokens_output int",
    )
    got = {r["problem_id"]: (r["final_answer"], r["vote_count"], r["valid_votes"]) for r in metrics.majority_vote(samples).collect()}
    assert got == {"a": (5, 2, 4), "b": (None, 0, 0), "c": (9, 1, 1)}


def test_attempt_outcomes(spark):
    logs = {
        "won": ["x:fail", "y:success"], "loop": ["x:fail", "x:fail"], "loop_won": ["x:fail", "x:success"],
        "spent": ["a:f", "b:f", "c:f", "d:f", "e:f", "f:success"], "open": ["a:f"],
    }
    rows = [(p, i + 1, *a.split(":")) for p, steps in logs.items() for i, a in enumerate(steps)]
    attempts = spark.createDataFrame(rows, "problem_id string, attempt int, code string, result string")
    got = {r["problem_id"]: r["outcome"] for r in rank.attempt_outcome(attempts).collect()}
    assert got == {
        "won": "success", "loop": "cycle_detected", "loop_won": "success", "spent": "max_retries", "open": "reflect",
    }


def test_efficiency_rank_puts_free_systems_last(spark):
    costs = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", 1.0)], "system string, cost_per_correct_usd double")
    got = {r["system"]: r["rank"] for r in rank.rank_systems(costs, "efficiency").collect()}
    assert got == {"c": 1, "b": 2, "a": 3}


def test_exploration_and_routes(spark):
    scores = spark.createDataFrame([("p", [0.2, 0.5]), ("q", [0.3, 0.3])], "problem_id string, scores array<double>")
    pmf = {r["problem_id"]: r["p"] for r in scores.select("problem_id", routing.exploration_pmf(F.col("scores")).alias("p")).collect()}
    assert pmf["p"] == pytest.approx([1 - 1 / 5, 1 / 5]) and pmf["q"] == pytest.approx([0.5, 0.5])
    with pytest.raises(ValueError):
        routing.exploration_pmf(F.col("scores"), gamma=0)
    with pytest.raises(ValueError):
        routing.exploration_pmf(F.col("scores"), "epsilon", epsilon=2)
    fixed = routing.route(scores, "fixed_slow").first()
    assert fixed["path_taken"] == "slow" and fixed["routing_prob"] is None
    missing = routing.route(scores.withColumn("pmf", F.lit(None).cast("array<double>")), "argmax", pmf="pmf").first()
    assert (missing["path_taken"], missing["routing_prob"]) == ("slow", 1.0)
    tie = routing.route(scores.withColumn("pmf", F.array(F.lit(0.5), F.lit(0.5))), "argmax", pmf="pmf").first()
    assert tie["path_taken"] == "fast"


def test_end_position_forms(spark):
    text = "Tom has 3 pens. How many pens? Think well."
    df = spark.range(1).select(F.lit(text).alias("t"))
    exact = corpus.with_injection_point(df, "t", F.lit("end")).first()["injection_point"]
    assert text[:exact].rstrip() == "Tom has 3 pens."
    old = corpus.with_injection_point(df, "t", F.lit("end"), compat=True).first()["injection_point"]
    assert old == len(text) - len("How many pens?") - 1


def test_ledger_rules(spark):
    given = spark.createDataFrame([(1, "a", "pen", 10), (1, "b", "pen", 4)], "problem_id int, entity string, item string, val long")
    moves = spark.createDataFrame([(1, "a", "b", "pen", 3), (1, "a", "b", "pen", 5)], "problem_id int, src string, dst string, item string, amount long")
    got = {(r["entity"], r["val"]) for r in ledger.apply_transfer(moves, given).collect()}
    assert got == {("a", 7), ("a", 5), ("b", 7), ("b", 9)}
    empty = spark.createDataFrame([(1, "t", "g", "pen")], "problem_id int, target string, grp string, item string")
    members = spark.createDataFrame([(1, "h", "a")], "problem_id int, grp string, entity string")
    assert ledger.combine_group(empty, members, given).first()["val"] == 0


def test_relations_follow_chains_and_reject_cycles(spark):
    rel = spark.createDataFrame(
        [(1, "multiple", "b", "a", 3), (1, "percent", "c", "b", 50), (1, "multiple", "d", "c", 2)],
        "problem_id int, kind string, entity string, other string, amount long",
    )
    start = spark.createDataFrame([(1, "a", 5)], "problem_id int, entity string, val long")
    got = {r["entity"]: r["val"] for r in ledger.derive_relations(rel, start).collect()}
    assert got == {"a": 5, "b": 15, "c": 7, "d": 14}
    loop = spark.createDataFrame([(1, "multiple", "a", "a", 2)], rel.schema)
    with pytest.raises(RuntimeError):
        ledger.derive_relations(loop, start)


def test_pareto_ties(spark):
    pts = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 7), ("c", 2.0, 7), ("d", 2.0, 6), ("e", 3.0, 7)], "n string, c double, s int")
    got = {r["n"] for r in pairs.pareto_frontier(pts, "c", "s").collect()}
    assert got == {"a", "b", "c", "e"}
