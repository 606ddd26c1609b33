"""Routing queries: loss, regret, policy grids, logged decisions, replay and model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cost as fc
from ..functions.draws import uniform
from ..operators import metrics, pairs, routing
from ..session import cut_lineage
from .fixtures import cte, table, view
from .registry import add, rounded

L = cte("labels_v")


def labels(spark, sf):
    return pairs.oracle_labels(view(spark, sf, "trials"), "baseline_small", "fixed_slow")


# loss of an outcome and action as SQL: c is a correctness flag, a an action number
def _loss(c: str, a: str, alpha: str = "10e0", beta: str = "1e0") -> str:
    return f"((CASE WHEN {c} THEN 0e0 ELSE {alpha} END) + {beta} * (CASE WHEN {a} = 0 THEN 0.1e0 ELSE 1e0 END))"


_BEST = "CASE WHEN slow_correct AND NOT fast_correct THEN 1 ELSE 0 END"
_BEST_OK = f"CASE WHEN {_BEST} = 0 THEN fast_correct ELSE slow_correct END"
_LF, _LS, _LO = _loss("fast_correct", "0"), _loss("slow_correct", "1"), _loss(f"({_BEST_OK})", f"({_BEST})")

add(
    "b17_loss_reward",
    lambda s, d: view(s, d, "trials")
    .withColumn("action", F.when(F.col("path_taken") == "slow", 1).otherwise(0))
    .select(
        "system",
        "problem_id",
        fc.loss(F.col("correct"), F.col("action")).alias("loss"),
        fc.reward(F.col("correct"), F.col("action")).alias("reward"),
    ),
    f"""{cte("trials")} SELECT system, problem_id, {_loss("correct", "(CASE path_taken WHEN 'slow' THEN 1 ELSE 0 END)")} AS loss,
    -{_loss("correct", "(CASE path_taken WHEN 'slow' THEN 1 ELSE 0 END)")} AS reward FROM trials""",
)
add(
    "b18_oracle_action",
    lambda s, d: labels(s, d).select(
        "variant",
        "problem_id",
        fc.oracle_action(F.col("fast_correct"), F.col("slow_correct")).alias("action"),
        fc.oracle_reason(F.col("fast_correct"), F.col("slow_correct")).alias("reason"),
    ),
    f"""{L} SELECT variant, problem_id, {_BEST} AS action, oracle_reason AS reason FROM labels_v""",
)
add(
    "b19_regret",
    lambda s, d: rounded(
        labels(s, d).select(
            "variant",
            "problem_id",
            fc.regret(F.lit(0), F.col("fast_correct"), F.col("slow_correct")).alias("fast_regret"),
            fc.regret(F.lit(1), F.col("fast_correct"), F.col("slow_correct")).alias("slow_regret"),
        )
    ),
    f"""{L} SELECT variant, problem_id, round({_LF} - {_LO}, 9) AS fast_regret, round({_LS} - {_LO}, 9) AS slow_regret
    FROM labels_v""",
)
_GRID = f"""g AS (SELECT a AS alpha, b AS beta, r AS policy_fast_rate FROM (VALUES (5e0), (10e0), (15e0), (20e0)) x(a),
      (VALUES (0.5e0), (1e0), (2e0)) y(b), (VALUES (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.7e0)) z(r)),
    j AS (SELECT g.*, fast_correct, slow_correct, {_loss("fast_correct", "0", "alpha", "beta")} AS lf,
      {_loss("slow_correct", "1", "alpha", "beta")} AS ls,
      {_loss(f"({_BEST_OK})", f"({_BEST})", "alpha", "beta")} AS lo FROM labels_v, g),
    pol AS (SELECT alpha, beta, policy_fast_rate, count(*) AS total,
      avg(policy_fast_rate * CAST(fast_correct AS INT) + (1 - policy_fast_rate) * CAST(slow_correct AS INT)) AS accuracy,
      avg(policy_fast_rate * lf + (1 - policy_fast_rate) * ls) AS avg_loss,
      avg(policy_fast_rate * lf + (1 - policy_fast_rate) * ls - lo) AS avg_regret,
      (sum(ls) - sum(policy_fast_rate * lf + (1 - policy_fast_rate) * ls)) / sum(ls) AS cost_savings
      FROM j GROUP BY 1, 2, 3)"""
_POL = """alpha, beta, policy_fast_rate, total, round(accuracy, 7) AS accuracy, round(avg_loss, 7) AS avg_loss,
    round(avg_regret, 7) AS avg_regret, round(cost_savings, 7) AS cost_savings"""
add("d8_policy_grid", lambda s, d: rounded(routing.policy_grid(labels(s, d)), 7), f"{L}, {_GRID} SELECT {_POL} FROM pol")
add(
    "e15_evaluate_policy",
    lambda s, d: rounded(routing.evaluate_policy(labels(s, d), 0.5), 7),
    f"{L}, {_GRID} SELECT {_POL} FROM pol WHERE alpha = 10 AND beta = 1 AND policy_fast_rate = 0.5",
)
add(
    "e16_evaluate_oracle_policy",
    lambda s, d: rounded(routing.evaluate_oracle_policy(labels(s, d)), 7),
    f"""{L} SELECT count(*) AS total, round(avg(CAST(fast_correct OR slow_correct AS INT)), 7) AS accuracy,
    round(avg({_LO}), 7) AS avg_loss, 0e0 AS avg_regret, round(avg(1 - ({_BEST})), 7) AS fast_rate,
    round((sum({_LS}) - sum({_LO})) / sum({_LS}), 7) AS cost_savings FROM labels_v""",
)
add(
    "e17_tune_policy",
    lambda s, d: rounded(routing.tune_policy(labels(s, d)), 7),
    f"""{L}, {_GRID}, k AS (SELECT *, CAST(row_number() OVER (ORDER BY round(avg_loss, 7), alpha, beta, policy_fast_rate)
      AS INT) AS rank FROM pol) SELECT {_POL}, rank, rank = 1 AS is_best FROM k""",
)
add(
    "e13_oracle_stats",
    lambda s, d: metrics.oracle_stats(labels(s, d)),
    f"""{L} SELECT coalesce(variant, 'overall') AS variant, count(*) AS total,
    count(*) FILTER (fast_correct AND slow_correct) AS both_correct,
    count(*) FILTER (slow_correct AND NOT fast_correct) AS only_slow_correct,
    count(*) FILTER (fast_correct AND NOT slow_correct) AS only_fast_correct,
    count(*) FILTER (NOT fast_correct AND NOT slow_correct) AS both_wrong,
    count(*) FILTER (fast_correct OR NOT slow_correct) / count(*) AS fast_rate,
    count(*) FILTER (fast_correct OR slow_correct) / count(*) AS oracle_accuracy
    FROM labels_v GROUP BY ROLLUP (variant)""",
)
add(
    "e14_oracle_rates",
    lambda s, d: metrics.oracle_rates(labels(s, d)).withColumn(
        "by_variant",
        F.array_join(
            F.array_sort(
                F.transform(
                    F.map_entries("by_variant"),
                    lambda e: F.concat_ws(
                        ":", e["key"], *[e["value"][c] for c in ("total", "fast_correct", "slow_correct", "oracle_fast")]
                    ),
                )
            ),
            ",",
        ),
    ),
    f"""{L}, v AS (SELECT variant, count(*) AS n, count(*) FILTER (fast_correct) AS f, count(*) FILTER (slow_correct) AS s,
      count(*) FILTER (fast_correct OR NOT slow_correct) AS o FROM labels_v GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (fast_correct) / count(*) AS fast_accuracy,
    count(*) FILTER (slow_correct) / count(*) AS slow_accuracy,
    count(*) FILTER (fast_correct AND slow_correct) / count(*) AS both_correct_rate,
    count(*) FILTER (NOT fast_correct AND NOT slow_correct) / count(*) AS both_wrong_rate,
    count(*) FILTER (slow_correct AND NOT fast_correct) / count(*) AS only_slow_correct_rate,
    count(*) FILTER (fast_correct OR NOT slow_correct) / count(*) AS oracle_fast_rate,
    count(*) FILTER (slow_correct AND NOT fast_correct) / count(*) AS oracle_slow_rate,
    (SELECT string_agg(concat_ws(':', variant, n, f, s, o), ',' ORDER BY variant) FROM v) AS by_variant FROM labels_v""",
)

# decisions of the logged bandit run on problems with oracle labels
_DECIDED = f"""{L}, dec AS (SELECT l.variant, l.problem_id, l.fast_correct, l.slow_correct,
      CASE WHEN t.path_taken = 'fast' THEN 0 ELSE 1 END AS action FROM labels_v l JOIN trials t
      ON l.variant = t.variant AND l.problem_id = t.problem_id WHERE t.system = 'bandit'),
    run AS (SELECT *, CASE WHEN action = 0 THEN fast_correct ELSE slow_correct END AS correct FROM dec),
    met AS (SELECT count(*) AS total, avg(CAST(correct AS INT)) AS accuracy, avg({_loss("correct", "action")}) AS avg_loss,
      avg({_loss("correct", "action")} - {_LO}) AS avg_regret, avg(1 - action) AS fast_rate, avg(action) AS slow_rate FROM run)"""
_MET = """total, round(accuracy, 9) AS accuracy, round(avg_loss, 9) AS avg_loss, round(avg_regret, 9) AS avg_regret,
    round(fast_rate, 9) AS fast_rate, round(slow_rate, 9) AS slow_rate"""


def decisions(spark, sf):
    return (
        view(spark, sf, "trials")
        .filter(F.col("system") == "bandit")
        .select("variant", "problem_id", F.when(F.col("path_taken") == "fast", 0).otherwise(1).alias("action"))
    )


def _decision_log(s, d):
    t = view(s, d, "trials").filter(F.col("system") == "bandit")
    log = t.select("variant", "problem_id", "correct", F.when(F.col("path_taken") == "fast", 0).otherwise(1).alias("action"))
    return log.join(labels(s, d).select(*routing.LABEL_KEY, "fast_correct", "slow_correct"), list(routing.LABEL_KEY), "left")


add(
    "e18_decision_metrics",
    lambda s, d: rounded(metrics.decision_metrics(_decision_log(s, d))),
    f"""{L}, log AS (SELECT t.correct, CASE WHEN t.path_taken = 'fast' THEN 0 ELSE 1 END AS action, fast_correct, slow_correct
      FROM trials t LEFT JOIN labels_v l ON t.variant = l.variant AND t.problem_id = l.problem_id WHERE t.system = 'bandit'),
    r AS (SELECT *, CASE WHEN fast_correct IS NULL THEN NULL ELSE
      (CASE WHEN action = 0 THEN {_LF} ELSE {_LS} END) - {_LO} END AS regret FROM log)
    SELECT count(*) AS total, round(avg(CAST(correct AS INT)), 9) AS accuracy,
    round(avg({_loss("correct", "action")}), 9) AS avg_loss, round(avg(regret), 9) AS avg_regret,
    round(avg(1 - action), 9) AS fast_rate, round(avg(action), 9) AS slow_rate FROM r""",
)
add(
    "e19_cost_saved",
    lambda s, d: rounded(
        metrics.decision_metrics(_decision_log(s, d)).select(
            "fast_rate", "slow_rate", metrics.cost_saved(F.col("fast_rate"), F.col("slow_rate")).alias("cost_saved")
        )
    ),
    f"""{cte("trials")}, r AS (SELECT avg(CASE path_taken WHEN 'fast' THEN 1 ELSE 0 END) AS f FROM trials WHERE system = 'bandit')
    SELECT round(f, 9) AS fast_rate, round(1 - f, 9) AS slow_rate, round(1 - (f * 0.1e0 + (1 - f)), 9) AS cost_saved FROM r""",
)
add(
    "i9_replay_policy",
    lambda s, d: rounded(routing.replay_policy(labels(s, d), decisions(s, d))),
    f"{_DECIDED} SELECT {_MET}, round(1 - (fast_rate * 0.1e0 + slow_rate), 9) AS cost_saved FROM met",
)


# u(key, salt) of the draw functions
def _u(key: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(md5({key} || '-' || '{salt}'), 1, 8)) AS BIGINT) / 4294967296e0)"


_LOG = f"""lg AS (SELECT *, {_u("(variant || '/' || problem_id)", "log")} < 0.1 AS explored, {_BEST} AS best FROM labels_v),
    lg2 AS (SELECT *, CASE WHEN explored THEN 1 - best ELSE best END AS logged_action FROM lg),
    logged AS (SELECT *, CASE WHEN (CASE WHEN logged_action = 0 THEN fast_correct ELSE slow_correct END) THEN 0e0
      ELSE 1e0 END AS logged_cost, CASE WHEN explored THEN 0.1e0 ELSE 0.9e0 END AS propensity FROM lg2)"""
add(
    "i3_simulate_logging",
    lambda s, d: routing.simulate_logging(labels(s, d)).select(
        "variant", "problem_id", "explored", "logged_action", "logged_cost", "propensity"
    ),
    f"{L}, {_LOG} SELECT variant, problem_id, explored, logged_action, logged_cost, propensity FROM logged",
)


def _examples(s, d):
    log = routing.simulate_logging(labels(s, d))
    line = F.concat(F.lit("|x "), F.col("variant"), F.lit(":1"))
    return log.select(
        "variant",
        "problem_id",
        routing.bandit_example(line, F.col("logged_action"), F.col("logged_cost"), F.col("propensity")).alias("example"),
        routing.bandit_example(line).alias("unlabelled"),
        routing.bandit_example(
            line, F.col("logged_action"), F.col("logged_cost"), F.col("propensity"), online=True
        ).alias("online"),
    )


add(
    "i4_to_bandit_examples",
    _examples,
    f"""{L}, {_LOG}, t AS (SELECT *, concat('shared |x ', variant, ':1') AS head,
      concat(':', CAST(logged_cost AS VARCHAR), ':', CAST(propensity AS VARCHAR), ' ') AS tag FROM logged)
    SELECT variant, problem_id,
    concat(head, chr(10), CASE logged_action WHEN 0 THEN concat('0', tag) ELSE '' END, '|a fast', chr(10),
      CASE logged_action WHEN 1 THEN concat('1', tag) ELSE '' END, '|a slow') AS example,
    concat(head, chr(10), '|a fast', chr(10), '|a slow') AS unlabelled,
    concat(head, chr(10), CASE logged_action WHEN 0 THEN concat('0', tag) ELSE '' END, '|Action fast', chr(10),
      CASE logged_action WHEN 1 THEN concat('0', tag) ELSE '' END, '|Action slow') AS online FROM t""",
)

# predicted costs: shares of wrong answers per system and variant stand in for a model's scores
_SCORES = f"""{L}, sc AS (SELECT variant, avg(CASE WHEN fast_correct THEN 0 ELSE 1 END) AS fc,
      avg(CASE WHEN slow_correct THEN 0 ELSE 1 END) AS sc FROM labels_v GROUP BY 1),
    p AS (SELECT l.variant, problem_id, fc, sc, fc <= sc AS fast_best, 1 / (2 + 10 * abs(fc - sc)) AS other
      FROM labels_v l JOIN sc ON l.variant = sc.variant),
    pm AS (SELECT *, CASE WHEN fast_best THEN 1 - other ELSE other END AS p0 FROM p)"""


def scored(s, d):
    lab = labels(s, d)
    rates = lab.groupBy("variant").agg(
        F.avg((~F.col("fast_correct")).cast("int")).alias("fc"), F.avg((~F.col("slow_correct")).cast("int")).alias("sc")
    )
    return lab.join(rates, "variant").withColumn("scores", F.array("fc", "sc"))


add(
    "i6_exploration_pmf",
    lambda s, d: rounded(
        scored(s, d)
        .withColumn("p", routing.exploration_pmf(F.col("scores")))
        .withColumn("q", routing.exploration_pmf(F.col("scores"), "epsilon"))
        .select(
            "variant",
            "problem_id",
            F.get("p", 0).alias("squarecb_fast"),
            F.get("p", 1).alias("squarecb_slow"),
            F.get("q", 0).alias("epsilon_fast"),
            F.get("q", 1).alias("epsilon_slow"),
        )
    ),
    f"""{_SCORES} SELECT variant, problem_id, round(p0, 9) AS squarecb_fast, round(1 - p0, 9) AS squarecb_slow,
    CASE WHEN fast_best THEN 0.9e0 ELSE 0.1e0 END AS epsilon_fast,
    CASE WHEN fast_best THEN 0.1e0 ELSE 0.9e0 END AS epsilon_slow FROM pm""",
)


def _routes(s, d):
    rows = scored(s, d).withColumn("pmf", routing.exploration_pmf(F.col("scores"))).select("variant", "problem_id", "pmf")
    out = None
    for strategy in ("fixed_slow", "random", "sample", "argmax", "force_fast", "force_slow"):
        part = routing.route(rows, strategy, pmf="pmf").select(
            F.lit(strategy).alias("strategy"), "variant", "problem_id", "path_taken", "routing_prob"
        )
        out = part if out is None else out.union(part)
    return rounded(out)


_U = _u("problem_id", "route")
add(
    "i5_route",
    _routes,
    f"""{_SCORES}, r AS (SELECT *, {_U} AS u FROM pm), o AS (
    SELECT 'fixed_slow' AS strategy, variant, problem_id, 'slow' AS path_taken, CAST(NULL AS DOUBLE) AS routing_prob FROM r
    UNION ALL SELECT 'random', variant, problem_id, CASE WHEN u < 0.5 THEN 'fast' ELSE 'slow' END, 0.5 FROM r
    UNION ALL SELECT 'sample', variant, problem_id, CASE WHEN u < p0 THEN 'fast' ELSE 'slow' END,
      CASE WHEN u < p0 THEN p0 ELSE 1 - p0 END FROM r
    UNION ALL SELECT 'argmax', variant, problem_id, CASE WHEN p0 >= 0.5 THEN 'fast' ELSE 'slow' END, greatest(p0, 1 - p0) FROM r
    UNION ALL SELECT 'force_fast', variant, problem_id, 'fast', 1 FROM r
    UNION ALL SELECT 'force_slow', variant, problem_id, 'slow', 1 FROM r)
    SELECT strategy, variant, problem_id, path_taken, round(routing_prob, 9) AS routing_prob FROM o""",
)


def _logged_value(s, d):
    log = routing.simulate_logging(scored(s, d))
    chosen = log.withColumn("policy_action", F.when(F.col("fc") <= F.col("sc"), 0).otherwise(1))
    return rounded(routing.evaluate_logged_policy(chosen, fast_cost="fc", slow_cost="sc"))


add(
    "i8_evaluate_logged_policy",
    _logged_value,
    f"""{_SCORES}, {_LOG.replace("FROM labels_v", "FROM labels_v")}, e AS (SELECT g.*, pm.fc, pm.sc,
      CASE WHEN fast_best THEN 0 ELSE 1 END AS pa, CASE WHEN fast_best THEN pm.fc ELSE pm.sc END AS guess
      FROM logged g JOIN pm ON g.variant = pm.variant AND g.problem_id = pm.problem_id)
    SELECT count(*) AS n_examples, round(avg(logged_cost), 9) AS avg_loss,
    round(avg(CASE WHEN pa = logged_action THEN logged_cost / propensity ELSE 0 END), 9) AS ips, round(avg(guess), 9) AS dm,
    round(avg(guess + CASE WHEN pa = logged_action THEN (logged_cost - guess) / propensity ELSE 0 END), 9) AS dr FROM e""",
)


# --- model fits: rows and properties only --------------------------------------------------


COMPONENTS = 50


def _reduced(s, d, k=COMPONENTS):
    vectors = table(s, d, "embeddings")
    return routing.pca_transform(vectors, routing.pca_fit(vectors, k)), k


def _pca_fit(s, d):
    model = routing.pca_fit(table(s, d, "embeddings"), COMPONENTS)
    ratios = s.createDataFrame(
        [(i, float(r)) for i, r in enumerate(model.stages[1].explainedVariance)], "component int, variance_ratio double"
    )
    return ratios.withColumn("variance_retained", F.lit(routing.variance_retained(model)))


def _pca_moments(s, d):
    """What any correct fit fulfils: shares fall, stay within one, and belong to the data's total variance."""
    model = routing.pca_fit(table(s, d, "embeddings"), COMPONENTS)
    shares = [float(x) for x in model.stages[1].explainedVariance]
    total = float(sum(x * x for x in model.stages[0].std))
    falling = all(a >= b - 1e-12 for a, b in zip(shares, shares[1:]))
    row = (len(shares), falling, 0 < sum(shares) <= 1 + 1e-9, round(total, 4))
    return s.createDataFrame([row], "components int, falling boolean, within_one boolean, total_variance double")


def _pca_properties(s, d):
    """Each reduced component's moments, and its largest covariance with another one."""
    out, k = _reduced(s, d)
    parts = out.select(F.posexplode("reduced").alias("component", "v"), "reduced")
    with_all = parts.groupBy("component").agg(
        F.count("v").alias("n"), F.abs(F.round(F.avg("v"), 6)).alias("mean"), F.round(F.var_samp("v"), 6).alias("variance"),
        *[F.avg(F.col("v") * F.col("reduced")[i]).alias(f"__c{i}") for i in range(k)],
    )
    off = F.greatest(*[F.when(F.col("component") != i, F.abs(F.col(f"__c{i}"))).otherwise(F.lit(0.0)) for i in range(k)])
    return with_all.select("component", "n", "mean", "variance", (off < 1e-6).alias("uncorrelated"))


add("i1_pca_fit", _pca_fit)
add(
    "i1_pca_moments",
    _pca_moments,
    f"""WITH x AS (SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)
    SELECT {COMPONENTS} AS components, true AS falling, true AS within_one, round(sum(var), 4) AS total_variance
    FROM (SELECT i, var_samp(CAST(v AS DOUBLE)) AS var FROM x GROUP BY i)""",
)
# centred, whitened and uncorrelated components, whatever their sign
add(
    "i2_pca_transform",
    _pca_properties,
    f"""SELECT CAST(c AS INT) AS component, (SELECT count(*) FROM embeddings) AS n, 0e0 AS mean, 1e0 AS variance,
    true AS uncorrelated FROM range({COMPONENTS}) t(c)""",
)


def logged_features(s, d):
    """Logged decisions with text features and reduced vectors of their problems, and the part each is dealt to.

    A problem's question is the document, and its embedding the vector, that its number falls on.
    """
    docs, vectors = table(s, d, "documents"), _reduced(s, d)[0]
    n_docs, n_vecs = docs.count(), vectors.count()
    log = routing.simulate_logging(labels(s, d)).withColumns({
        "__doc": F.col("problem_id").cast("bigint") % n_docs, "__vec": F.col("problem_id").cast("bigint") % n_vecs,
    })
    paid = log.withColumn("logged_cost", F.col("logged_cost") * fc.ALPHA + fc.BETA * fc.action_cost(F.col("logged_action")))
    text = routing.routing_features(docs.select((F.col("doc_id") % n_docs).alias("__doc"), "text"), "text", None).select("__doc", F.col("features").alias("__words"))
    vecs = vectors.select((F.col("vec_id") % n_vecs).alias("__vec"), "reduced")
    squeezed = F.transform("reduced", lambda v: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), v)) / 5.0)
    onehot = F.array(*[(F.col("variant") == v).cast("double") for v in ("base", "p1", "p2")])
    joined = paid.join(text, "__doc").join(vecs, "__vec").withColumn("features", F.concat(onehot, "__words", squeezed))
    u = uniform(F.concat_ws("/", *routing.LABEL_KEY), "part")
    part = F.when(u < 0.6, "train").when(u < 0.8, "validate").otherwise("test")
    return joined.withColumn("part", part).drop("__doc", "__vec", "__words", "reduced")


#: variant, four counts, five flags, three question types, four semantic features, the reduced vector
WIDTH = 3 + 16 + COMPONENTS


def _policy(log):
    """Trained on one part and held to always-slow on another."""
    learned = routing.train_policy_on_features(log.filter("part = 'train'"), WIDTH)
    return learned, routing.safe_policy(learned, log.filter("part = 'validate'"))


def _dr(s, d):
    log = cut_lineage(logged_features(s, d))
    _, policy = _policy(log)
    chosen = policy.predict(log)
    value = routing.replay_policy(chosen, chosen.select("variant", "problem_id", F.col("policy_action").alias("action")))
    slow = chosen.agg(F.avg(fc.loss(F.col("slow_correct"), F.lit(1))).alias("always_slow_loss"))
    return rounded(value.crossJoin(slow), 6)


add("i7_train_policy_dr", _dr)
add(
    "i7_policy_beats_slow",
    lambda s, d: _dr(s, d).select(F.col("total"), (F.col("avg_loss") <= F.col("always_slow_loss") + 1e-6).alias("beats_slow")),
    f"{L} SELECT count(*) AS total, true AS beats_slow FROM labels_v",
)


def _held_out(s, d):
    """On rows the policy never saw: its true loss against always-slow, and whether the bound from the log holds the truth."""
    log = cut_lineage(logged_features(s, d))
    learned, policy = _policy(log)
    test = log.filter("part = 'test'")
    fast, slow = (fc.loss(F.col(c), F.lit(a)) for c, a in (("fast_correct", 0), ("slow_correct", 1)))
    taken = F.when(F.col("policy_action") == 0, fast).otherwise(slow)
    truth = policy.predict(test).agg(F.count("*").alias("n_test"), F.avg(taken).alias("loss"), F.avg(slow).alias("slow_loss"))
    unsafe = learned.predict(test).agg(F.avg(taken - slow).alias("gap"))
    bound = routing.policy_gain_bound(test, learned)
    parts = log.groupBy().agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "validate")], F.min(F.size("features")).alias("width"))
    both = truth.crossJoin(unsafe).crossJoin(bound).crossJoin(parts)  # one row each
    return both.select(
        "n_train", "n_validate", "n_test", F.col("width").cast("int").alias("n_features"), (F.col("loss") <= F.col("slow_loss") + 1e-9).alias("no_worse_than_slow"),
        F.col("gap").between(F.col("lower") - 1e-9, F.col("upper") + 1e-9).alias("bound_holds"),
    )


add(
    "i7_held_out_policy",
    _held_out,
    f"""{L}, p AS (SELECT {_u("(variant || '/' || problem_id)", "part")} AS u FROM labels_v)
    SELECT count(*) FILTER (u < 0.6) AS n_train, count(*) FILTER (u >= 0.6 AND u < 0.8) AS n_validate, count(*) FILTER (u >= 0.8) AS n_test,
      {WIDTH} AS n_features, true AS no_worse_than_slow, true AS bound_holds FROM p""",
)
