"""Properties: partition counts, hot keys, brute-force timelines, bootstrap shape, reduction moments."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialmill.operators import ledger, metrics, pairs, prefix, rank, routing, stats
from trialmill.operators.prefix import running


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        ((F.col("id") * 7919) % 3000).alias("o"),
        (F.col("id") % 11).alias("v"),
    )
    return rows.persist()


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_running_matches_plain_windows(spark, skewed, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = running(skewed.repartition(parts), ["k"], ["o"], "r", {"s": "v"}, {"b": "v"}).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = skewed.toPandas().sort_values(["k", "o"])
    want["r"] = want.groupby("k").cumcount() + 1
    want["s"] = want.groupby("k")["v"].cumsum()
    want["b"] = want.groupby("k")["v"].transform(lambda x: x.cummax().shift())
    got, want = (x.sort_values(["k", "o"]).reset_index(drop=True)[["k", "o", "v", "r", "s", "b"]] for x in (got, want))
    np.testing.assert_array_equal(got.fillna(-1).to_numpy(), want.fillna(-1).to_numpy())


def test_running_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, o int")
    got = {(r["k"], r["o"], r["r"], r["n"]) for r in running(rows, ["k"], ["o"], rank="r", total="n").collect()}
    assert got == {(None, 1, 1, 2), (None, 2, 2, 2), ("a", 5, 1, 1)}


def test_running_spreads_a_hot_key(spark, skewed):
    """The hot group's slices are several, none holding all of it."""
    bounds = prefix._bounds(skewed, ["k", "o"], 16)
    sliced = skewed.groupBy("k", prefix._slice_of([F.col("k"), F.col("o")], bounds).alias("p")).count()
    hot = [r["count"] for r in sliced.filter("k = 'hot'").collect()]
    assert len(hot) > 3 and max(hot) < 500


def test_running_exchanges_rows_once(spark, skewed):
    got = running(skewed.select("k", "o", "v"), ["k"], ["o"], "r", {"s": "v"}, total="n")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # the rows' own exchange, and those of the few totals of cut groups
    assert final.count("hashpartitioning(__slice") <= 2 and "rangepartitioning" not in final and "Scan parquet" not in final


def test_running_over_kinds_of_columns(spark):
    rng = random.Random(2)
    words = ["", "a", "ab", "é", "z", None]
    rows = [
        (rng.choice(words), rng.choice([None, float("nan"), -0.5, 1e300, 2.0]), dt.datetime(2024, 3, 31, rng.randrange(24), rng.randrange(60), 0, rng.randrange(1000)),
         dt.date(2024, 1, rng.randrange(1, 28)), i) for i in range(900)
    ]
    df = spark.createDataFrame(rows, "w string, x double, t timestamp, d date, i long")
    for keys, order in ((["w"], ["t", "i"]), (["x", "w"], ["d", "i"]), ([], ["w", "x", "i"]), (["d"], [F.col("i") * -1])):
        got = {r["i"]: r["r"] for r in running(df, keys, order, rank="r").collect()}
        plain = Window.partitionBy(*keys).orderBy(*order)
        want = {r["i"]: r["r"] for r in df.withColumn("r", F.row_number().over(plain)).collect()}
        assert got == want
    assert running(df.limit(0), ["w"], ["i"], rank="r").count() == 0


def test_hot_groups_keep_whole_results(spark, skewed):
    attempts = skewed.select(
        F.col("k").alias("problem_id"), F.col("o").alias("attempt"), F.concat(F.lit("c"), F.col("v") % 2).alias("code"),
        F.lit("fail").alias("result"),
    )
    got = rank.detect_cycles(attempts)
    assert got.count() == 3000
    groups = attempts.select("problem_id", "code").distinct().count()
    assert got.filter(~F.col("is_cycle")).count() == groups
    latest = pairs.latest_by_id(skewed, ["k"], ["o"]).count()
    assert latest == skewed.select("k").distinct().count()
    blocks = rank.stratified_assign(skewed, group="k", order=["o"]).filter("k = 'hot'").groupBy("block").count()
    assert {r["count"] for r in blocks.collect()} == {100}


def test_split_first(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("problem_id"))
    split = rank.split_first(df, 100, 50)
    assert dict(split.dtypes)["position"] == "bigint"
    assert {(r["problem_id"], r["split"]) for r in split.collect()} == {(i, "train" if i < 100 else "test") for i in range(150)}
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and rank.split_first(df, 400, 300).count() == 500


def test_pareto_by_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.randint(0, 40) / 4, rng.randint(0, 60)) for i in range(400)]
    df = spark.createDataFrame(pts, "i int, c double, s int")
    want = {i for i, c, s in pts if not any(c2 < c and s2 > s for _, c2, s2 in pts)}
    assert {r["i"] for r in pairs.pareto_frontier(df, "c", "s").collect()} == want


# --- timelines ------------------------------------------------------------------------------


def simulate(initial, effects, max_step):
    """Set semantics of one problem: every effect on every value, frame rule for given chains."""
    values, touched = {}, {(e, a, t) for t, _, e, a, _ in effects}
    for e, a, v in initial:
        values.setdefault((e, a, 0), set()).add(v)
    given = {(e, a) for e, a, _ in initial}
    missing = set()
    for t in range(max_step + 1):
        for step, op, e, a, x in effects:
            if step != t:
                continue
            old = values.get((e, a, t), set())
            if op == "set_to":
                values.setdefault((e, a, t + 1), set()).add(x)
            elif not old:
                missing.add(t)
            for v in old if op != "set_to" else ():
                new = {"add_to": v + x, "sub_from": v - x, "mul_by": v * x}.get(op)
                values.setdefault((e, a, t + 1), set()).add(v // x if op == "div_by" else new)
        if t < max_step and max_step > 0:
            for (e, a, s), old in list(values.items()):
                if s == t and (e, a) in given and (e, a, t) not in touched:
                    values.setdefault((e, a, t + 1), set()).update(old)
    clash = {s for (_, _, s), vs in values.items() if len(vs) > 1}
    return values, clash, missing


@pytest.mark.parametrize("block", [3, 256])
def test_timeline_by_simulation(spark, monkeypatch, block):
    monkeypatch.setattr(ledger, "BLOCK", block)
    rng = random.Random(11)
    facts, ops, moves, horizon, want = [], [], [], [], {}
    for p in range(60):
        top = rng.choice([1, 4, 9])
        horizon.append((p, top))
        start = [(e, "x", rng.randint(-9, 20)) for e in ("a", "b") if rng.random() < 0.8]
        effects = []
        for _ in range(rng.randint(1, 6)):
            op = rng.choice(["add_to", "sub_from", "mul_by", "div_by", "set_to"])
            x = rng.choice([-3, -2, 1, 2, 3]) if op in ("mul_by", "div_by") else rng.randint(-4, 9)
            effects.append((rng.randint(0, top), op, rng.choice(["a", "b"]), "x", x))
        ops += [(p, e, a, t, op, x) for t, op, e, a, x in effects]
        if rng.random() < 0.4:
            t, x = rng.randint(0, top), rng.randint(1, 5)
            moves.append((p, "a", "b", "x", x, t))
            effects += [(t, "sub_from", "a", "x", x), (t, "add_to", "b", "x", x)]
        facts += [(p, e, a, v) for e, a, v in start]
        want[p] = simulate(start, set(effects), top)
    ops_df = spark.createDataFrame(ops, "problem_id int, entity string, attr string, step long, op string, amount long")
    moves_df = spark.createDataFrame(moves, "problem_id int, src string, dst string, item string, amount long, step long")
    start_df = spark.createDataFrame(facts, "problem_id int, entity string, attr string, val long")
    steps_df = spark.createDataFrame(horizon, "problem_id int, max_step long")
    run = ledger.fold_timeline(start_df, ops_df, steps_df, moves_df)
    broken = ledger.hard_violations(run, ops_df, steps_df, moves_df)
    got = {(r["problem_id"], r["rule"]): r["first_step"] for r in broken.collect()}
    expected = {}
    for p, (_, clash, missing) in want.items():
        if clash:
            expected[p, "two_values"] = min(clash)
        if missing:
            expected[p, "no_prior_state"] = min(missing)
    assert got == expected
    sound = {p for p, (_, clash, missing) in want.items() if not clash and not missing}
    assert 5 < len(sound) < 60
    states = {
        (r["problem_id"], r["entity"], r["attr"], r["step"]): r["val"] for r in ledger.persist(run, broken).collect()
    }
    assert states == {(p, *k): next(iter(v)) for p in sound for k, v in want[p][0].items()}


# --- statistics and models ------------------------------------------------------------------


def test_bootstrap_intervals(spark):
    df = spark.range(4000).select(
        (F.col("id") % 2).alias("g"), (F.col("id") % 5 < 3).alias("correct"), (F.col("id") % 100).cast("double").alias("v")
    )
    for r in stats.bootstrap_accuracy(df, ["g"], resamples=3000).collect():
        se = (r["point_estimate"] * (1 - r["point_estimate"]) / 2000) ** 0.5
        assert r["n_bootstrap"] == 3000
        assert r["std_error"] == pytest.approx(se, rel=0.1)
        assert r["ci_lower"] == pytest.approx(r["point_estimate"] - 1.96 * se, abs=3 * se / 5)
    for r in stats.bootstrap_mean(df, "v", ["g"], resamples=2000).collect():
        se = np.std(np.arange(r["g"], 100, 2)) / 2000**0.5
        assert r["point_estimate"] == pytest.approx(49 + r["g"])
        assert r["std_error"] == pytest.approx(se, rel=0.15)
    # draws depend on the data only, not on how it is partitioned
    once = {(r["g"], r["replicate"]): r["value"] for r in stats.mean_replicates(df.repartition(3), "v", ["g"], 50).collect()}
    again = {(r["g"], r["replicate"]): r["value"] for r in stats.mean_replicates(df.repartition(13), "v", ["g"], 50).collect()}
    assert once == pytest.approx(again)


def test_chi2_tail(spark):
    # upper-tail values of chi-square with one degree of freedom
    for x, p in [(3.841458820694124, 0.05), (6.6348966010212145, 0.01), (0.4549364231195724, 0.5)]:
        got = spark.range(1).select(stats.chi2_tail(F.lit(x)).alias("p")).first()["p"]
        assert got == pytest.approx(p, rel=1e-5)


def test_reduction_is_centred_and_white(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(base)], "id int, embedding array<double>")
    model = routing.pca_fit(df, 4)
    model.write().overwrite().save(str(tmp_path / "pca"))
    from pyspark.ml import PipelineModel

    for m in (model, PipelineModel.load(str(tmp_path / "pca"))):
        out = np.array([r["reduced"] for r in routing.pca_transform(df, m).collect()])
        np.testing.assert_allclose(out.mean(axis=0), 0, atol=1e-8)
        np.testing.assert_allclose(np.cov(out.T), np.eye(4), atol=1e-6)
    assert 0.5 < routing.variance_retained(model) <= 1.0
    with pytest.raises(ValueError):
        routing.pca_transform(df, None)


def test_doubly_robust_policy_learns_the_split(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    labels = spark.range(2000).select(
        F.col("id").cast("string").alias("problem_id"),
        F.lit("base").alias("variant"),
        (F.col("id") % 2 == 0).alias("fast_correct"),
        (F.col("id") % 10 > 0).alias("slow_correct"),
        array_to_vector(F.array((F.col("id") % 2).cast("double"))).alias("features"),
    )
    logged = routing.simulate_logging(labels)
    policy = routing.train_policy_dr(logged)
    policy.save(str(tmp_path / "policy"))
    chosen = routing.RoutingPolicy.load(str(tmp_path / "policy")).predict(logged)
    share = chosen.groupBy("fast_correct").agg(F.avg("policy_action").alias("slow")).collect()
    assert {r["fast_correct"]: r["slow"] for r in share} == {True: 0.0, False: 1.0}
    value = routing.replay_policy(labels, chosen.select("variant", "problem_id", F.col("policy_action").alias("action"))).first()
    always_slow = metrics.decision_metrics(
        labels.select(F.col("slow_correct").alias("correct"), F.lit(1).alias("action"), "fast_correct", "slow_correct")
    ).first()
    assert value["avg_loss"] < always_slow["avg_loss"]


def logged_problems(spark, informative):
    """Easy texts, which the fast path answers, are short and lie at one end of the first dimension."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        easy = bool(rng.random() < 0.6)
        shown = easy if informative else bool(rng.random() < 0.6)
        text = "How many? 3 and 4." if shown else "How much is half of it if nobody knows, because all of the years differ? " * 3
        vector = [float(x) for x in rng.normal(size=4) + [2.0 if shown else -2.0, 0, 0, 0]]
        rows.append(("base", str(i), text, vector, easy or bool(rng.random() < 0.1), bool(rng.random() < 0.95)))
    labels = spark.createDataFrame(rows, "variant string, problem_id string, question string, reduced array<double>, fast_correct boolean, slow_correct boolean")
    log = routing.routing_features(routing.simulate_logging(labels))
    return log.withColumn("logged_cost", F.col("logged_cost") * 10 + F.when(F.col("logged_action") == 0, 0.1).otherwise(1.0)).persist()


@pytest.mark.parametrize("informative", [True, False])
def test_policy_on_features(spark, informative):
    log = logged_problems(spark, informative)
    part = F.col("problem_id").cast("int") % 5
    learned = routing.train_policy_on_features(log.filter(part < 3), 16 + 4)
    policy = routing.safe_policy(learned, log.filter(part == 3))
    test = policy.predict(log.filter(part == 4))
    assert len(test.first()["features"]) == 20
    right = F.when(F.col("policy_action") == 0, F.col("fast_correct")).otherwise(F.col("slow_correct"))
    paid = F.when(right, 0.0).otherwise(10.0) + F.when(F.col("policy_action") == 0, 0.1).otherwise(1.0)
    slow = F.when(F.col("slow_correct"), 0.0).otherwise(10.0) + 1.0
    got = test.agg(F.avg(paid).alias("loss"), F.avg(slow).alias("slow"), F.avg("policy_action").alias("slow_rate")).first()
    if informative:
        assert policy.always is None and got["loss"] < got["slow"] - 0.2 and 0.2 < got["slow_rate"] < 0.6
    else:
        assert policy.always == 1 and got["loss"] == got["slow"]
    bound = routing.policy_gain_bound(log.filter(part == 4), learned).first()
    gap = learned.predict(log.filter(part == 4)).agg(F.avg(paid - slow)).first()[0]
    assert bound["lower"] <= gap <= bound["upper"]
    log.unpersist()


def test_moments_do_not_depend_on_partitions(spark):
    log = logged_problems(spark, True)
    one, many = (routing.fit_from_moments(routing.policy_moments(log.repartition(n)), 20, 1.0) for n in (1, 13))
    for a in (0, 1):
        np.testing.assert_allclose(one[a], many[a], rtol=1e-9, atol=1e-9)
    log.unpersist()
