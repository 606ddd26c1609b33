"""Trial-log queries: accuracy, robustness, cost, errors, routing, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cost as fc
from ..functions import lexicon as lx
from ..operators import checks, metrics, pairs, rank
from .fixtures import cte, table, view
from .registry import add, rounded

T = cte("trials")


def trials(spark, sf):
    return view(spark, sf, "trials")


add(
    "c7_select_variant",
    lambda s, d: checks.select_variant(trials(s, d), "noop").select("system", "problem_id", "variant", "correct"),
    f"{T} SELECT system, problem_id, variant, correct FROM trials WHERE variant = 'noop'",
)

add(
    "d1_paired",
    lambda s, d: pairs.paired(trials(s, d), "fixed_slow", "baseline_large"),
    f"""{T} SELECT a.variant, a.problem_id, a.correct AS first_correct, b.correct AS second_correct
    FROM trials a JOIN trials b ON a.variant = b.variant AND a.problem_id = b.problem_id
    WHERE a.system = 'fixed_slow' AND b.system = 'baseline_large'""",
)

_D2 = """SELECT f.variant, f.problem_id, f.ground_truth, f.final_answer AS fast_answer, f.correct AS fast_correct,
    s.final_answer AS slow_answer, s.correct AS slow_correct,
    CASE WHEN s.correct AND NOT f.correct THEN 1 ELSE 0 END AS action,
    CASE WHEN s.correct AND NOT f.correct THEN 'slow' ELSE 'fast' END AS oracle_action,
    CASE WHEN f.correct AND s.correct THEN 'both_correct' WHEN s.correct THEN 'only_slow_correct'
         WHEN f.correct THEN 'only_fast_correct' ELSE 'both_wrong' END AS oracle_reason"""
add(
    "d2_oracle_labels",
    lambda s, d: pairs.oracle_labels(trials(s, d), "baseline_small", "fixed_slow"),
    f"""{T} {_D2} FROM trials f JOIN trials s ON f.variant = s.variant AND f.problem_id = s.problem_id
    WHERE f.system = 'baseline_small' AND s.system = 'fixed_slow'""",
)
add(
    "d3_oracle_labels_global",
    lambda s, d: pairs.oracle_labels_global(trials(s, d), "baseline_small", "fixed_slow"),
    f"""{T} {_D2.replace("f.variant,", "s.variant, s.template_id,").replace("f.ground_truth", "s.ground_truth")}
    FROM trials f JOIN trials s ON f.problem_id = s.problem_id
    WHERE f.system = 'baseline_small' AND s.system = 'fixed_slow'""",
)
add(
    "d3_unmatched",
    lambda s, d: pairs.unmatched(trials(s, d), "baseline_small", "fixed_slow"),
    f"""{T} SELECT problem_id FROM trials WHERE system = 'fixed_slow'
    AND problem_id NOT IN (SELECT problem_id FROM trials WHERE system = 'baseline_small')""",
)
add(
    "d4_oracle_accuracy",
    lambda s, d: pairs.oracle_accuracy(trials(s, d), "bandit", "baseline_small", "fixed_slow"),
    f"""{T} SELECT b.variant, count(*) AS n, count(*) FILTER (f.correct OR s.correct) AS oracle_correct,
    count(*) FILTER (f.correct OR s.correct) / count(*) AS oracle_accuracy
    FROM trials b JOIN trials f ON b.variant = f.variant AND b.problem_id = f.problem_id
    JOIN trials s ON b.variant = s.variant AND b.problem_id = s.problem_id
    WHERE b.system = 'bandit' AND f.system = 'baseline_small' AND s.system = 'fixed_slow' GROUP BY b.variant""",
)

_CAT = """cat AS (SELECT *, CASE WHEN correct THEN NULL WHEN error_type IS NULL OR error_type = '' THEN 'INCORRECT_ANSWER'
    WHEN error_type IN ('SYNTAX','GROUNDING','TIMEOUT','UNSAT','NO_ANSWER','AMBIGUOUS','RUNTIME','cycle_detected',
    'max_iterations') THEN error_type ELSE 'UNKNOWN' END AS category FROM trials)"""
add(
    "d5_error_diff",
    lambda s, d: pairs.error_diff(trials(s, d), "baseline_large", "fixed_slow"),
    f"""{T}, {_CAT}, a AS (SELECT category, count(*) AS n FROM cat WHERE system = 'baseline_large'
      AND category IS NOT NULL GROUP BY 1),
    b AS (SELECT category, count(*) AS n FROM cat WHERE system = 'fixed_slow' AND category IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS count_first,
      coalesce(b.n, 0) AS count_second, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference
    FROM a FULL OUTER JOIN b ON a.category = b.category""",
)
add(
    "d6_map_error_category",
    lambda s, d: pairs.map_error_category(trials(s, d)).select("system", "variant", "problem_id", "category"),
    f"{T}, {_CAT} SELECT system, variant, problem_id, category FROM cat",
)
add(
    "d7_pareto_frontier",
    lambda s, d: pairs.pareto_frontier(
        table(s, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size"
    ),
    """SELECT p_partkey, p_retailprice, p_size FROM part p WHERE NOT EXISTS (
    SELECT 1 FROM part q WHERE q.p_retailprice < p.p_retailprice AND q.p_size > p.p_size)""",
)
add(
    "d7_pareto_systems",
    lambda s, d: pairs.pareto_frontier(
        metrics.cost_summary(trials(s, d)).select("system", "cost_per_correct_usd", "accuracy"),
        "cost_per_correct_usd",
        "accuracy",
    ),
    f"""{T}, s AS (SELECT system, sum(tokens_input) AS i, sum(tokens_output) AS o, count(*) AS n,
      count(*) FILTER (correct) AS k FROM trials GROUP BY system),
    p AS (SELECT system, (i * (CASE WHEN system = 'baseline_small' THEN 0.15e0 ELSE 2.5e0 END)
      + o * (CASE WHEN system = 'baseline_small' THEN 0.6e0 ELSE 10.0e0 END)) / 1e6 / k AS cost_per_correct_usd,
      k / n AS accuracy FROM s)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.cost_per_correct_usd < p.cost_per_correct_usd
      AND q.accuracy > p.accuracy)""",
)
add(
    "d10_model_of_system",
    lambda s, d: trials(s, d).select(
        "problem_id", "system", "variant", fc.model_of_system(F.col("system")).alias("model")
    ),
    f"""{T} SELECT problem_id, system, variant,
    CASE WHEN system = 'baseline_small' THEN 'small' ELSE 'large' END AS model FROM trials""",
)
add(
    "b20_token_cost",
    lambda s, d: rounded(
        trials(s, d).select(
            "problem_id",
            "system",
            "variant",
            fc.token_cost(
                F.col("tokens_input"), F.col("tokens_output"), fc.model_of_system(F.col("system"))
            ).alias("cost_usd"),
        ),
        12,
    ),
    f"""{T} SELECT problem_id, system, variant, round(CASE WHEN system = 'baseline_small'
    THEN (tokens_input * 0.15e0 + tokens_output * 0.6e0) / 1e6
    ELSE (tokens_input * 2.5e0 + tokens_output * 10e0) / 1e6 END, 12) AS cost_usd FROM trials""",
)

add(
    "e1_accuracy",
    lambda s, d: metrics.accuracy(trials(s, d)),
    f"""{T} SELECT coalesce(system, 'all') AS system, coalesce(variant, 'all') AS variant, count(*) AS n,
    count(*) FILTER (correct) AS n_correct, count(*) FILTER (correct) / count(*) AS accuracy
    FROM trials GROUP BY ROLLUP (system, variant)""",
)
add(
    "e2_load_summary",
    lambda s, d: metrics.load_summary(trials(s, d)),
    f"""{T} SELECT coalesce(system, 'all') AS system, count(DISTINCT variant) AS n_variants, count(*) AS total_problems,
    count(*) FILTER (correct) AS total_correct, count(*) FILTER (correct) / count(*) AS accuracy
    FROM trials GROUP BY GROUPING SETS ((system), ())""",
)
_RUN = """count(*) AS total_problems, count(*) FILTER (correct) AS correct_count,
    count(*) - count(*) FILTER (correct) - count(error_type) AS incorrect_count, count(error_type) AS error_count,
    count(*) FILTER (correct) / count(*) AS accuracy, CAST(sum(tokens_input) AS BIGINT) AS total_tokens_input,
    CAST(sum(tokens_output) AS BIGINT) AS total_tokens_output,
    CAST(sum(tokens_input + tokens_output) AS DOUBLE) / count(*) AS avg_tokens_per_problem,
    CASE WHEN count(*) FILTER (correct) = 0 THEN 0 ELSE CAST(sum(tokens_input + tokens_output) AS DOUBLE)
      / count(*) FILTER (correct) END AS tokens_per_correct,
    sum(execution_time_ms) AS total_time_ms, sum(execution_time_ms) / count(*) AS avg_time_per_problem_ms,
    CAST(sum(iterations) AS DOUBLE) / count(*) AS avg_iterations,
    count(*) FILTER (self_corrected) / count(*) AS self_correction_rate,
    count(*) FILTER (path_taken = 'fast') AS fast_path_count, count(*) FILTER (path_taken = 'slow') AS slow_path_count,
    coalesce(avg(CAST(correct AS INT)) FILTER (path_taken = 'fast'), 0e0) AS fast_path_accuracy,
    coalesce(avg(CAST(correct AS INT)) FILTER (path_taken = 'slow'), 0e0) AS slow_path_accuracy"""
add(
    "e3_run_summary",
    lambda s, d: metrics.run_summary(trials(s, d)),
    f"{T} SELECT system, variant, {_RUN} FROM trials GROUP BY system, variant",
)
_ROB = """rob AS (SELECT system, count(*) FILTER (variant = 'base') AS n_base, count(*) FILTER (variant = 'noop') AS n_noop,
    avg(CAST(correct AS INT)) FILTER (variant = 'base') AS b, avg(CAST(correct AS INT)) FILTER (variant = 'noop') AS n
    FROM trials GROUP BY system),
    robust AS (SELECT system, n_base, n_noop, b AS base_accuracy, n AS noop_accuracy, b - n AS accuracy_drop,
    (b - n) / b * 100 AS accuracy_drop_pct, n / b AS rrr FROM rob)"""
add(
    "e4_robustness",
    lambda s, d: metrics.robustness(trials(s, d)),
    f"{T}, {_ROB} SELECT * FROM robust",
)
_DECAY = """tiers AS (SELECT system, avg(CAST(correct AS INT)) FILTER (variant = 'base') AS b,
      avg(CAST(correct AS INT)) FILTER (variant = 'p1') AS p1, avg(CAST(correct AS INT)) FILTER (variant = 'p2') AS p2
      FROM trials GROUP BY system),
    pts AS (SELECT system, x, CASE x WHEN 0 THEN b WHEN 1 THEN p1 ELSE p2 END AS y
      FROM tiers, (VALUES (0), (1), (2)) v(x)),
    line AS (SELECT system, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM pts GROUP BY system),
    decay AS (SELECT t.system, b AS base_accuracy, p1 AS p1_accuracy, p2 AS p2_accuracy, b - p1 AS base_to_p1_drop,
      p1 - p2 AS p1_to_p2_drop, b - p2 AS total_drop, (b - p2) / 2 AS per_tier_decay, (b - p2) / b * 100 AS decay_pct,
      slope AS decay_slope, r2 AS decay_r_squared FROM tiers t JOIN line l ON t.system = l.system)"""
_ROUND_DECAY = """SELECT system, round(base_accuracy, 9) AS base_accuracy, round(p1_accuracy, 9) AS p1_accuracy,
    round(p2_accuracy, 9) AS p2_accuracy, round(base_to_p1_drop, 9) AS base_to_p1_drop,
    round(p1_to_p2_drop, 9) AS p1_to_p2_drop, round(total_drop, 9) AS total_drop,
    round(per_tier_decay, 9) AS per_tier_decay, round(decay_pct, 9) AS decay_pct, round(decay_slope, 9) AS decay_slope,
    round(decay_r_squared, 9) AS decay_r_squared FROM decay"""
add(
    "e5_complexity_decay",
    lambda s, d: rounded(metrics.complexity_decay(trials(s, d))),
    f"{T}, {_DECAY} {_ROUND_DECAY}",
)
_COST = """cost AS (SELECT system, count(*) AS n, count(*) FILTER (correct) AS k, CAST(sum(tokens_input) AS BIGINT) AS i,
      CAST(sum(tokens_output) AS BIGINT) AS o, sum(execution_time_ms) AS ms FROM trials GROUP BY system),
    priced AS (SELECT *, (i * (CASE WHEN system = 'baseline_small' THEN 0.15e0 ELSE 2.5e0 END)
      + o * (CASE WHEN system = 'baseline_small' THEN 0.6e0 ELSE 10.0e0 END)) / 1e6 AS usd FROM cost)"""
_COST_OUT = """SELECT system, n AS n_problems, k AS n_correct, k / n AS accuracy, i + o AS total_tokens,
    i AS total_input_tokens, o AS total_output_tokens, (i + o) / n AS avg_tokens_per_problem, i / n AS avg_input_tokens,
    o / n AS avg_output_tokens, ms AS total_time_ms, ms / n AS avg_time_per_problem_ms,
    round(usd, 9) AS estimated_cost_usd, round(usd / n, 9) AS cost_per_problem_usd,
    round(CASE WHEN k = 0 THEN 0 ELSE usd / k END, 9) AS cost_per_correct_usd,
    CASE WHEN k = 0 THEN 0 ELSE (i + o) / k END AS tokens_per_correct, i + o > 0 AS has_cost FROM priced"""


def _money(df):
    return df.withColumns(
        {c: F.round(c, 9) for c in ("estimated_cost_usd", "cost_per_problem_usd", "cost_per_correct_usd")}
    )


add("e6_cost_summary", lambda s, d: _money(metrics.cost_summary(trials(s, d))), f"{T}, {_COST} {_COST_OUT}")
add(
    "e6_cost_summary_variant",
    lambda s, d: _money(metrics.cost_summary(trials(s, d), "base")),
    f"{T}, {_COST.replace('FROM trials GROUP', chr(70) + 'ROM trials WHERE variant = ' + repr('base') + ' GROUP')} {_COST_OUT}",
)


def _breakdown(keys):
    on = " AND ".join(f"c.{k} = t.{k}" for k in keys)
    cols = ", ".join(f"c.{k}" for k in keys)
    by = ", ".join(keys)
    return f"""{T}, {_CAT}, t AS (SELECT {by}, count(*) AS n, count(category) AS bad FROM cat GROUP BY {by}),
    c AS (SELECT {by}, category, count(*) AS k FROM cat WHERE category IS NOT NULL GROUP BY {by}, category)
    SELECT {cols}, category, k AS error_count, n AS total_problems, bad AS total_errors, k / n AS share,
    bad / n AS error_rate, (n - bad) / n AS accuracy FROM c JOIN t ON {on}"""


add("e7_error_breakdown", lambda s, d: metrics.error_breakdown(trials(s, d)), _breakdown(["system"]))
add(
    "e7_error_breakdown_by_variant",
    lambda s, d: metrics.error_breakdown(trials(s, d), ["system", "variant"]),
    _breakdown(["system", "variant"]),
)
_CATS = sorted([*lx.ERROR_CATEGORIES, lx.WRONG_ANSWER, lx.UNKNOWN_ERROR])
add(
    "e8_error_matrix",
    lambda s, d: metrics.error_matrix(trials(s, d)),
    f"{T}, {_CAT} SELECT system, "
    + ", ".join(f"count(*) FILTER (category = '{c}') / count(*) * 100 AS {c}" for c in _CATS)
    + " FROM cat GROUP BY system",
)
_IT = "r AS (SELECT *, CASE WHEN iterations > 0 THEN iterations ELSE 1 END AS rounds FROM trials)"
add(
    "e9_self_correction",
    lambda s, d: metrics.self_correction(trials(s, d)),
    f"""{T}, {_IT} SELECT system, count(*) AS total_problems, count(*) FILTER (rounds = 1) AS single_iteration,
    count(*) FILTER (rounds <> 1) AS multi_iteration, count(*) FILTER (self_corrected) AS self_corrected,
    avg(rounds) AS avg_iterations, max(rounds) AS max_iterations,
    count(*) FILTER (rounds <> 1 AND correct) AS multi_iter_correct,
    count(*) FILTER (rounds <> 1 AND NOT correct) AS multi_iter_incorrect,
    coalesce(avg(CAST(correct AS INT)) FILTER (rounds <> 1), 0e0) AS correction_success_rate,
    count(*) FILTER (rounds <> 1) / count(*) AS reflection_usage_rate, avg(CAST(correct AS INT)) AS accuracy,
    coalesce(avg(CAST(correct AS INT)) FILTER (rounds = 1), 0e0) AS first_try_accuracy FROM r GROUP BY system""",
)
add(
    "e10_iteration_histogram",
    lambda s, d: metrics.iteration_histogram(trials(s, d)),
    f"{T}, {_IT} SELECT system, rounds AS iterations, count(*) AS n FROM r GROUP BY system, rounds",
)


def _routing(keys):
    return f"""SELECT {keys}, count(*) AS total_problems, count(*) FILTER (path_taken = 'fast') AS fast_path_count,
    count(*) FILTER (path_taken = 'slow') AS slow_path_count,
    count(*) FILTER (path_taken = 'fast') / count(*) AS fast_path_ratio,
    count(*) FILTER (path_taken = 'fast' AND correct) AS fast_correct,
    count(*) FILTER (path_taken = 'slow' AND correct) AS slow_correct,
    coalesce(avg(CAST(correct AS INT)) FILTER (path_taken = 'fast'), 0e0) AS fast_path_accuracy,
    coalesce(avg(CAST(correct AS INT)) FILTER (path_taken = 'slow'), 0e0) AS slow_path_accuracy,
    coalesce(avg(CAST(correct AS INT)) FILTER (path_taken = 'slow'), 0e0)
      - coalesce(avg(CAST(correct AS INT)) FILTER (path_taken = 'fast'), 0e0) AS accuracy_gap,
    count(*) FILTER (path_taken IN ('fast', 'slow') AND correct) / count(*) AS overall_accuracy,
    round(coalesce(avg(bandit_probability), 0e0), 9) AS avg_probability FROM trials GROUP BY {keys}"""


add(
    "e11_routing_summary",
    lambda s, d: metrics.routing_summary(trials(s, d)).withColumn("avg_probability", F.round("avg_probability", 9)),
    f"{T} {_routing('system')}",
)
add(
    "e12_routing_comparison",
    lambda s, d: rounded(metrics.routing_comparison(trials(s, d), "bandit", "random")),
    f"""{T}, r AS ({_routing("system, variant")}), p AS (SELECT variant,
      max(overall_accuracy) FILTER (system = 'bandit') AS a, max(overall_accuracy) FILTER (system = 'random') AS b
      FROM r GROUP BY variant)
    SELECT count(*) AS n_variants, round(avg(a), 9) AS accuracy_first, round(avg(b), 9) AS accuracy_second,
    round(avg(a) - avg(b), 9) AS difference, abs(avg(a) - avg(b)) > 0.02 AS significant FROM p""",
)
add(
    "e20_majority_vote",
    lambda s, d: metrics.majority_vote(view(s, d, "vote_samples")),
    f"""{cte("vote_samples")}, v AS (SELECT problem_id, answer, count(*) AS votes, min(sample_idx) AS seen
      FROM vote_samples WHERE answer IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, seen) AS rn FROM v),
    t AS (SELECT problem_id, count(answer) AS valid_votes, count(*) AS k_samples,
      CAST(sum(tokens_input) AS BIGINT) AS tokens_input, CAST(sum(tokens_output) AS BIGINT) AS tokens_output
      FROM vote_samples GROUP BY 1)
    SELECT t.problem_id, w.answer AS final_answer, coalesce(w.votes, 0) AS vote_count, valid_votes, k_samples,
    tokens_input, tokens_output FROM t LEFT JOIN w ON t.problem_id = w.problem_id AND w.rn = 1""",
)
add(
    "e23_project_cost",
    lambda s, d: rounded(metrics.project_cost(trials(s, d), 13396)),
    f"""{T}, a AS (SELECT avg(tokens_input) AS i, avg(tokens_output) AS o FROM trials),
    c AS (SELECT i, o, (i * 2.5e0 + o * 10e0) / 1e6 * 13396 AS l, (i * 0.15e0 + o * 0.6e0) / 1e6 * 13396 AS s,
      (i * 3.5e0 * 2.5e0 + o * 2e0 * 10e0) / 1e6 * 13396 AS v FROM a)
    SELECT round(i, 9) AS avg_input, round(o, 9) AS avg_output, round(l, 9) AS large_total,
    round(s, 9) AS small_total, round(v, 9) AS verified_total, round(l + s + v * 3, 9) AS total_estimate FROM c""",
)
add(
    "e24_pilot_summary",
    lambda s, d: rounded(metrics.pilot_summary(trials(s, d).filter(F.col("system") == "bandit"))),
    f"""{T} SELECT coalesce(variant, 'overall') AS variant, count(*) AS total, count(*) FILTER (correct) AS correct,
    round(100 * avg(CAST(correct AS INT)), 9) AS accuracy_pct, count(*) FILTER (path_taken = 'fast') AS fast,
    round(100 * (count(*) FILTER (path_taken = 'fast') / count(*)), 9) AS fast_pct,
    count(*) FILTER (path_taken = 'slow') AS slow,
    round(100 - 100 * (count(*) FILTER (path_taken = 'fast') / count(*)), 9) AS slow_pct
    FROM trials WHERE system = 'bandit' GROUP BY ROLLUP (variant)""",
)
add(
    "e27_hypothesis_checks",
    lambda s, d: rounded(metrics.hypothesis_checks(trials(s, d), "fixed_slow", "baseline_large")),
    f"""{T}, {_ROB}, x AS (SELECT (max(base_accuracy) FILTER (system = 'fixed_slow')
      - max(base_accuracy) FILTER (system = 'baseline_large')) * 100 AS gain,
      max(rrr) FILTER (system = 'fixed_slow') AS rrr FROM robust)
    SELECT 'accuracy_gain' AS hypothesis, 15e0 AS target, round(gain, 9) AS result,
      CASE WHEN gain >= 15 THEN 'CONFIRMED' ELSE 'PARTIAL' END AS status FROM x
    UNION ALL SELECT 'noop_robustness', 0.98e0, round(rrr, 9),
      CASE WHEN rrr >= 0.98 THEN 'CONFIRMED' ELSE 'EXCEEDS_SOTA' END FROM x""",
)

# --- rankings and windows -----------------------------------------------------------------


def _ranked(s, d):
    t = trials(s, d)
    sources = {
        "rrr": metrics.robustness(t),
        "drop": metrics.robustness(t),
        "resilience": metrics.complexity_decay(t),
        "p2_accuracy": metrics.complexity_decay(t),
        "slope": metrics.complexity_decay(t),
        "accuracy": metrics.cost_summary(t),
        "correction": metrics.self_correction(t),
        "efficiency": metrics.cost_summary(t),
    }
    out = None
    for metric, summary in sources.items():
        part = rank.rank_systems(summary, metric).select("metric", "rank", "system")
        out = part if out is None else out.union(part)
    return out


add(
    "g1_rank_systems",
    _ranked,
    f"""{T}, {_ROB}, {_DECAY}, {_COST}, {_IT}, m AS (
    SELECT 'rrr' AS metric, system, -rrr AS v FROM robust UNION ALL SELECT 'drop', system, accuracy_drop FROM robust
    UNION ALL SELECT 'resilience', system, total_drop FROM decay UNION ALL SELECT 'p2_accuracy', system, -p2_accuracy FROM decay
    UNION ALL SELECT 'slope', system, abs(decay_slope) FROM decay UNION ALL SELECT 'accuracy', system, -(k / n) FROM priced
    UNION ALL SELECT 'correction', system, -coalesce(avg(CAST(correct AS INT)) FILTER (rounds <> 1), 0) FROM r GROUP BY system
    UNION ALL SELECT 'efficiency', system, CASE WHEN usd > 0 AND k > 0 THEN usd / k ELSE 1e300 END FROM priced)
    SELECT metric, CAST(row_number() OVER (PARTITION BY metric ORDER BY v, system) AS INT) AS rank, system FROM m""",
)
add(
    "g2_top_errors",
    lambda s, d: rank.top_errors(metrics.error_breakdown(trials(s, d)), 2),
    f"""{T}, {_CAT}, c AS (SELECT system, category, count(*) AS error_count FROM cat WHERE category IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT *, CAST(row_number() OVER (PARTITION BY system ORDER BY error_count DESC, category) AS INT) AS rank FROM c)
    SELECT system, rank, category, error_count FROM w WHERE rank <= 2""",
)
add(
    "g2_top_errors_pooled",
    lambda s, d: rank.top_errors(metrics.error_breakdown(trials(s, d)), 3, per_system=False),
    f"""{T}, {_CAT} SELECT category, count(*) AS error_count FROM cat WHERE category IS NOT NULL GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 3""",
)
_A = cte("attempts")
_CYC = """cyc AS (SELECT *, row_number() OVER (PARTITION BY problem_id, md5(code) ORDER BY attempt) > 1 AS is_cycle FROM attempts)"""
add(
    "g3_detect_cycles",
    lambda s, d: rank.detect_cycles(view(s, d, "attempts")).select("problem_id", "attempt", "code_hash", "is_cycle"),
    f"{_A}, {_CYC} SELECT problem_id, attempt, md5(code) AS code_hash, is_cycle FROM cyc",
)
add(
    "g4_attempt_outcome",
    lambda s, d: rank.attempt_outcome(view(s, d, "attempts")),
    f"""{_A}, {_CYC}, e AS (SELECT problem_id, attempt, CASE WHEN result = 'success' THEN 'success'
      WHEN is_cycle THEN 'cycle_detected' WHEN attempt >= 5 THEN 'max_retries' END AS why,
      max(attempt) OVER (PARTITION BY problem_id) AS last FROM cyc),
    f AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY why IS NULL, attempt) AS rn FROM e)
    SELECT problem_id, coalesce(why, 'reflect') AS outcome, CASE WHEN why IS NULL THEN last ELSE attempt END AS end_attempt,
    last AS logged_attempts FROM f WHERE rn = 1""",
)
_LATEST = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
add(
    "g5_latest_by_id",
    lambda s, d: pairs.latest_by_id(view(s, d, "raw"), order=_LATEST).select(
        "system", "variant", "problem_id", "draw", "l_shipdate", "l_partkey"
    ),
    f"""{cte("raw")}, w AS (SELECT *, row_number() OVER (PARTITION BY system, variant, problem_id ORDER BY
    l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM raw)
    SELECT system, variant, problem_id, draw, l_shipdate, l_partkey FROM w WHERE rn = 1""",
)
add(
    "g6_split_first",
    lambda s, d: rank.split_first(
        table(s, d, "orders").select(F.col("o_orderkey").alias("problem_id")), 1000, 200
    ).select("problem_id", "split"),
    """SELECT problem_id, CASE WHEN rn <= 1000 THEN 'train' ELSE 'test' END AS split FROM (
    SELECT o_orderkey AS problem_id, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) t WHERE rn <= 1200""",
)
add(
    "g7_progress",
    lambda s, d: rank.progress(trials(s, d)),
    f"""{T}, w AS (SELECT system, variant, row_number() OVER p AS done,
      CAST(sum(CAST(correct AS INT)) OVER p AS BIGINT) AS correct_so_far, count(*) OVER (PARTITION BY system, variant) AS n
      FROM trials WINDOW p AS (PARTITION BY system, variant ORDER BY ts, problem_id ROWS UNBOUNDED PRECEDING))
    SELECT system, variant, done, correct_so_far, correct_so_far / done AS accuracy FROM w
    WHERE done % 50 = 0 OR done = n""",
)
add(
    "g8_stratified_assign",
    lambda s, d: rank.stratified_assign(view(s, d, "slots")).select("problem_id", "slot", "position", "block"),
    f"""{cte("slots")}, w AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY slot) AS position FROM slots)
    SELECT problem_id, slot, position, CAST((position - 1) % 10 AS INT) AS block FROM w""",
)
add(
    "g9_shared_ids",
    lambda s, d: rank.shared_ids(trials(s, d), "bandit", "random"),
    f"""{T} SELECT variant, problem_id FROM trials WHERE system = 'bandit' INTERSECT
    SELECT variant, problem_id FROM trials WHERE system = 'random'""",
)
add(
    "g9_category_union",
    lambda s, d: pairs.map_error_category(trials(s, d))
    .filter(F.col("category").isNotNull())
    .select("category")
    .distinct(),
    f"{T}, {_CAT} SELECT DISTINCT category FROM cat WHERE category IS NOT NULL",
)
add(
    "c4_remaining",
    lambda s, d: checks.remaining(
        table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("problem_id")),
        trials(s, d).filter(F.col("system") == "bandit"),
        trials(s, d).filter(F.col("system") == "random"),
    ),
    f"""{T} SELECT CAST(o_orderkey AS VARCHAR) AS problem_id FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (
    SELECT problem_id FROM trials WHERE system IN ('bandit', 'random'))""",
)
