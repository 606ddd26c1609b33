"""Statistics queries: bootstrap, paired tests, effect sizes, intervals and the full report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, stats
from ..session import cut_lineage, scratch_path
from ..sources import trials as log
from . import report
from .fixtures import cte, view
from .q_metrics import _ROB, _money
from .q_routing import _u
from .registry import REGISTRY, add, rounded

T = cte("trials")
_TESTED = ["variant", "n_both_correct", "n_sys1_only", "n_sys2_only", "n_both_wrong", "statistic", "p_value", "significant"]
BY = ["system", "variant"]


def trials(spark, sf):
    return view(spark, sf, "trials")


add("f1_bootstrap_accuracy", lambda s, d: stats.bootstrap_accuracy(trials(s, d)))
add(
    "f2_bootstrap_mean",
    lambda s, d: stats.bootstrap_mean(
        trials(s, d).withColumn("tokens", F.col("tokens_input") + F.col("tokens_output")), "tokens", BY
    ),
)



def _banded(ci, moments, by):
    """An interval against the normal one: exact point, all resamples, ends within 0.3 standard errors."""
    both = ci.join(moments, by)
    near = lambda end, sign: F.abs(F.col(end) - (F.col("m") + sign * 1.959964 * F.col("se"))) <= 0.3 * F.col("se")
    return both.select(
        *by, F.round("point_estimate", 9).alias("point_estimate"), F.col("n_bootstrap").cast("int").alias("n_bootstrap"),
        near("ci_lower", -1).alias("lower_is_near"), near("ci_upper", 1).alias("upper_is_near"),
        (F.abs(F.col("std_error") / F.col("se") - 1) < 0.1).alias("error_is_near"),
    )


def _moments(df, value, by):
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.avg(v).alias("m"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("se"))


_BAND = f"{stats.RESAMPLES} AS n_bootstrap, true AS lower_is_near, true AS upper_is_near, true AS error_is_near"
add(
    "f1_accuracy_band",
    lambda s, d: _banded(stats.bootstrap_accuracy(trials(s, d)), _moments(trials(s, d), "correct", BY), BY),
    f"{T} SELECT system, variant, round(avg(CAST(correct AS DOUBLE)), 9) AS point_estimate, {_BAND} FROM trials GROUP BY 1, 2",
)


def _tokens(s, d):
    return trials(s, d).withColumn("tokens", F.col("tokens_input") + F.col("tokens_output"))


add(
    "f2_mean_band",
    lambda s, d: _banded(stats.bootstrap_mean(_tokens(s, d), "tokens", BY), _moments(_tokens(s, d), "tokens", BY), BY),
    f"{T} SELECT system, variant, round(avg(tokens_input + tokens_output), 9) AS point_estimate, {_BAND} FROM trials GROUP BY 1, 2",
)


def _difference_band(s, d):
    base, noop = (trials(s, d).filter(F.col("variant") == v) for v in ("base", "noop"))
    a, b = (_moments(x, "correct", ["system"]) for x in (base, noop))
    both = a.select("system", F.col("m").alias("m1"), F.col("se").alias("s1")).join(
        b.select("system", F.col("m").alias("m2"), F.col("se").alias("s2")), "system"
    )
    moments = both.select("system", (F.col("m1") - F.col("m2")).alias("m"), F.sqrt(F.pow("s1", F.lit(2)) + F.pow("s2", F.lit(2))).alias("se"))
    return _banded(stats.bootstrap_difference(base, noop, "correct", ["system"]), moments, ["system"])


add(
    "f3_difference_band",
    _difference_band,
    f"""{T} SELECT system, round(avg(CAST(correct AS DOUBLE)) FILTER (variant = 'base')
      - avg(CAST(correct AS DOUBLE)) FILTER (variant = 'noop'), 9) AS point_estimate, {_BAND} FROM trials GROUP BY 1""",
)

_STEPS = stats._POISSON_STEPS
_W = " + ".join(f"(CASE WHEN u >= {x!r} THEN 1 ELSE 0 END)" for x in _STEPS)
_KEYED = "concat_ws('/', system, variant, problem_id)"


def _draws(value: str, where: str = "true") -> str:
    u = f"(CAST(('0x' || substr(md5({_KEYED} || '-boot-' || b), 1, 8)) AS BIGINT) / 4294967296e0)"
    return f"""(SELECT system, variant, CAST(b AS INT) AS replicate, v, {_W} AS w FROM (
      SELECT system, variant, {value} AS v, b, {u} AS u FROM trials, range(20) r(b) WHERE {where}))"""


def keyed(df):
    return df.withColumn("key", F.concat_ws("/", "system", "variant", "problem_id"))


def _replicates(s, d):
    t = keyed(trials(s, d)).withColumn("tokens", F.col("tokens_input") + F.col("tokens_output"))
    return stats.portable_mean_replicates(t, "tokens", "key", BY)


add(
    "f2_mean_replicates",
    _replicates,
    f"""{T} SELECT system, variant, replicate, CAST(sum(w * v) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS value
    FROM {_draws("tokens_input + tokens_output")} GROUP BY 1, 2, 3""",
)
_INT = """SELECT system, variant, round(quantile_cont(value, 0.025), 9) AS ci_lower,
    round(quantile_cont(value, 0.975), 9) AS ci_upper, round(stddev_pop(value), 9) AS std_error, count(*) AS n_bootstrap"""
add(
    "f2_mean_interval",
    lambda s, d: rounded(stats._interval(_replicates(s, d), BY, 0.95).drop("point_estimate")),
    f"""{T}, m AS (SELECT system, variant, replicate, CAST(sum(w * v) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS value
    FROM {_draws("tokens_input + tokens_output")} GROUP BY 1, 2, 3) {_INT} FROM m GROUP BY 1, 2""",
)


def _difference(s, d):
    t = keyed(trials(s, d)).withColumn("hit", F.col("correct").cast("int"))
    parts = [
        stats.portable_mean_replicates(t.filter(F.col("variant") == v), "hit", "key", ["system"]) for v in ("base", "noop")
    ]
    return rounded(stats._interval(stats.replicate_difference(*parts, ["system"]), ["system"], 0.95).drop("point_estimate"))


def _side(v: str) -> str:
    return f"""(SELECT system, replicate, CAST(sum(w * v) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS value
      FROM {_draws("CAST(correct AS INT)", f"variant = '{v}'")} GROUP BY 1, 2)"""


add(
    "f3_difference_interval",
    _difference,
    f"""{T}, m AS (SELECT a.system, a.value - b.value AS value FROM {_side("base")} a JOIN {_side("noop")} b
      ON a.system = b.system AND a.replicate = b.replicate)
    {_INT.replace("variant, ", "")} FROM m GROUP BY 1""",
)
add(
    "f3_bootstrap_difference",
    lambda s, d: stats.bootstrap_difference(
        trials(s, d).filter("variant = 'base'"), trials(s, d).filter("variant = 'noop'"), "correct", ["system"]
    ),
)
_ERFC = """(t * exp(-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806
    + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))))"""
_MCN = """mc AS (SELECT a.variant, count(*) FILTER (a.correct AND b.correct) AS n_both_correct,
      count(*) FILTER (a.correct AND NOT b.correct) AS n_sys1_only,
      count(*) FILTER (NOT a.correct AND b.correct) AS n_sys2_only,
      count(*) FILTER (NOT a.correct AND NOT b.correct) AS n_both_wrong
      FROM trials a JOIN trials b ON a.variant = b.variant AND a.problem_id = b.problem_id
      WHERE a.system = 'fixed_slow' AND b.system = 'baseline_large' GROUP BY 1),
    st AS (SELECT *, CASE WHEN n_sys1_only + n_sys2_only = 0 THEN 0 ELSE power(abs(n_sys1_only - n_sys2_only) - 1e0, 2)
      / (n_sys1_only + n_sys2_only) END AS statistic FROM mc),
    zz AS (SELECT *, sqrt(statistic / 2) AS z, 1 / (1 + 0.5e0 * sqrt(statistic / 2)) AS t FROM st)"""
add(
    "f4_mcnemar",
    lambda s, d: rounded(stats.mcnemar(trials(s, d), "fixed_slow", "baseline_large")),
    f"""{T}, {_MCN} SELECT variant, n_both_correct, n_sys1_only, n_sys2_only, n_both_wrong,
    round(statistic, 9) AS statistic, round({_ERFC}, 9) AS p_value, statistic > 3.841458820694124 AS significant FROM zz""",
)


def _effects(s, d):
    acc = trials(s, d).groupBy("variant").agg(
        F.avg(F.when(F.col("system") == "fixed_slow", F.col("correct").cast("int"))).alias("p1"),
        F.avg(F.when(F.col("system") == "baseline_small", F.col("correct").cast("int"))).alias("p2"),
    )
    h = stats.cohens_h(F.col("p1"), F.col("p2"))
    return rounded(acc.select("variant", h.alias("cohens_h"), stats.effect_size(h).alias("interpretation")))


add(
    "f5_cohens_h",
    _effects,
    f"""{T}, a AS (SELECT variant, avg(CAST(correct AS INT)) FILTER (system = 'fixed_slow') AS p1,
      avg(CAST(correct AS INT)) FILTER (system = 'baseline_small') AS p2 FROM trials GROUP BY 1),
    h AS (SELECT variant, 2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)) AS h FROM a)
    SELECT variant, round(h, 9) AS cohens_h, CASE WHEN abs(h) < 0.2 THEN 'negligible' WHEN abs(h) < 0.5 THEN 'small'
    WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END AS interpretation FROM h""",
)


def _overlaps(s, d):
    """Whether each system's base interval meets its distractor interval."""
    ci = stats._interval(_replicates(s, d).filter(F.col("variant").isin("base", "noop")), BY, 0.95)
    both = ci.groupBy("system").agg(
        *[
            F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}")
            for v in ("base", "noop")
            for c in ("ci_lower", "ci_upper")
        ]
    )
    return both.select(
        "system",
        stats.ci_overlap(
            F.col("base_ci_lower"), F.col("base_ci_upper"), F.col("noop_ci_lower"), F.col("noop_ci_upper")
        ).alias("overlap"),
    )


add(
    "f6_ci_overlap",
    _overlaps,
    f"""{T}, m AS (SELECT system, variant, replicate, CAST(sum(w * v) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS value
      FROM {_draws("tokens_input + tokens_output")} GROUP BY 1, 2, 3),
    c AS (SELECT system, variant, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM m GROUP BY 1, 2)
    SELECT a.system, a.lo <= b.hi AND b.lo <= a.hi AS overlap FROM c a JOIN c b ON a.system = b.system
    WHERE a.variant = 'base' AND b.variant = 'noop'""",
)
add(
    "f7_improvement_factor",
    lambda s, d: metrics.robustness(trials(s, d)).select(
        "system", metrics.improvement_factor(F.col("rrr")).alias("improvement_factor")
    ),
    f"{T}, {_ROB} SELECT system, rrr / 0.35e0 AS improvement_factor FROM robust",
)


def _log(s, d):
    """The trials as a written log, which is what its tables read."""
    return cut_lineage(trials(s, d))


def _with_intervals(s, d):
    t = _log(s, d)
    tables = {"robustness": metrics.robustness(t), "complexity": metrics.complexity_decay(t), "cost": metrics.cost_summary(t),
              "self_correction": metrics.self_correction(t), "routing": metrics.routing_summary(t)}
    out = stats.attach_intervals(t, tables)
    wide = out["robustness"]
    for name in ("complexity", "cost", "self_correction", "routing"):
        cis = [c for c in out[name].columns if "_ci_" in c]
        wide = wide.join(out[name].select("system", *[F.col(c).alias(f"{name}_{c}") for c in cis]), "system")
    return wide


add("f8_attach_intervals", _with_intervals)

# every interval of the five tables: table, prefix, the value resampled, and the rows that count
_BANDS = [
    ("robustness", "base", "correct", "variant = 'base'"),
    ("robustness", "noop", "correct", "variant = 'noop'"),
    ("complexity", "base", "correct", "variant = 'base'"),
    ("complexity", "p1", "correct", "variant = 'p1'"),
    ("complexity", "p2", "correct", "variant = 'p2'"),
    ("cost", "tokens", "tokens_input + tokens_output", "true"),
    ("cost", "time", "execution_time_ms", "true"),
    ("self_correction", "correction", "correct", "iterations > 1"),
    ("routing", "fast", "correct", "path_taken = 'fast'"),
    ("routing", "slow", "correct", "path_taken = 'slow'"),
]


def _interval_bands(s, d):
    """Each interval of each table next to the normal one: its ends within 0.3 standard errors and one row's weight."""
    t = _log(s, d)
    tables = {"robustness": metrics.robustness(t), "complexity": metrics.complexity_decay(t), "cost": metrics.cost_summary(t),
              "self_correction": metrics.self_correction(t), "routing": metrics.routing_summary(t)}
    out = stats.attach_intervals(t, tables)
    ends = reduce(DataFrame.unionByName, [
        out[name].select(F.lit(name).alias("table"), F.lit(p).alias("metric"), "system", F.col(f"{p}_ci_lower").alias("lo"), F.col(f"{p}_ci_upper").alias("hi"))
        for name, p, _, _ in _BANDS
    ])
    values = F.array(*[
        F.struct(F.lit(name).alias("table"), F.lit(p).alias("metric"), F.when(F.expr(rows), F.expr(f"CAST({value} AS DOUBLE)")).alias("v"))
        for name, p, value, rows in _BANDS
    ])
    v = F.col("v")
    moments = t.select("system", F.inline(values)).filter("v is not null").groupBy("table", "metric", "system").agg(
        F.avg(v).alias("m"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("se"), F.count(v).alias("n"), F.max(F.abs(v)).alias("top")
    )
    slack = 0.3 * F.col("se") + F.col("top") / F.col("n")
    near = lambda end, sign: F.abs(F.col(end) - (F.col("m") + sign * 1.959964 * F.col("se"))) <= slack
    return moments.join(ends, ["table", "metric", "system"]).select(
        "table", "metric", "system", F.round("m", 6).alias("value"), near("lo", -1).alias("lower_is_near"), near("hi", 1).alias("upper_is_near")
    )


add(
    "f8_interval_bands",
    _interval_bands,
    f"{T} " + " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", '{p}' AS metric, system, round(avg(CAST({value} AS DOUBLE)), 6) AS value, true AS lower_is_near, true AS upper_is_near
        FROM trials WHERE {rows} GROUP BY 3""" for name, p, value, rows in _BANDS
    ),
)


def _intervals_hold(s, d):
    """Each interval of the robustness table lies around its own metric."""
    t = trials(s, d)
    r = stats.attach_intervals(t, {"robustness": metrics.robustness(t)})["robustness"]
    held = lambda lo, x, hi: (F.col(lo) <= F.col(x)) & (F.col(x) <= F.col(hi))
    return r.select(
        "system", "n_base", "n_noop", held("base_ci_lower", "base_accuracy", "base_ci_upper").alias("base_held"),
        held("noop_ci_lower", "noop_accuracy", "noop_ci_upper").alias("noop_held"),
        held("drop_ci_lower", "accuracy_drop", "drop_ci_upper").alias("drop_held"),
    )


add(
    "f8_intervals_hold",
    _intervals_hold,
    f"{T}, {_ROB} SELECT system, n_base, n_noop, true AS base_held, true AS noop_held, true AS drop_held FROM robust",
)


def _full(s, d):
    """Every table of the report as (table, row) with the row in JSON."""
    tables = report.full_report(trials(s, d), "fixed_slow", "baseline_large")
    out = None
    for name, df in tables.items():
        if name == "trials":
            continue
        part = df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
        out = part if out is None else out.union(part)
    return out


add("e26_full_report", _full)


def _report_table(name, tidy=lambda df: df):
    return lambda s, d: tidy(report.full_report(trials(s, d), "fixed_slow", "baseline_large")[name])


# every table of the report, which follows from one aggregate, next to the SQL of the table on its own
for _name, _query, _tidy, _where in [
    ("accuracy", "e1_accuracy", lambda df: df, "true"),
    ("robustness", "e4_robustness", lambda df: df, "true"),
    ("complexity", "e5_complexity_decay", rounded, "true"),
    ("cost", "e6_cost_summary", _money, "true"),
    ("errors", "e7_error_breakdown", lambda df: df, "true"),
    ("self_correction", "e9_self_correction", lambda df: df, "true"),
    ("routing", "e11_routing_summary", lambda df: df.withColumn("avg_probability", F.round("avg_probability", 9)), "system IN ('bandit', 'random')"),
    ("significance", "f4_mcnemar", lambda df: rounded(df.select(*_TESTED)), "variant IN ('base', 'noop')"),
]:
    add(f"e26_table_{_name}", _report_table(_name, _tidy), f"SELECT * FROM ({REGISTRY[_query].sql}) r WHERE {_where}")


def _from_log(s, d):
    """From log files to the report: every record was first logged with the opposite outcome, a day earlier."""
    rows = trials(s, d).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).drop("ts")
    # both records from one row, so that the rows are made once
    both = rows.withColumn("early", F.explode(F.array(F.lit(True), F.lit(False)))).withColumns(
        {"correct": F.col("correct") != F.col("early"), "timestamp": F.concat(F.when(F.col("early"), "0").otherwise(""), "timestamp")}
    )
    root = scratch_path(s, "retried")
    log.write_trials(both.drop("early"), root)
    return report.full_report(log.read_trials(s, root), "fixed_slow", "baseline_large")


_LOG_SQL = f"""SELECT 'accuracy' AS tab, system, variant, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k FROM (
      SELECT CASE WHEN grouping(system) = 1 THEN 'all' ELSE system END AS system,
        CASE WHEN grouping(variant) = 1 THEN 'all' ELSE variant END AS variant, count(*) AS n,
        count(*) FILTER (correct) AS k FROM trials GROUP BY ROLLUP (system, variant))
    UNION ALL SELECT 'significance', '', variant, n_sys1_only, n_sys2_only FROM mc WHERE variant IN ('base', 'noop')
    UNION ALL SELECT 'errors', system, '', count(*) FILTER (NOT correct), 0 FROM trials GROUP BY system
    UNION ALL SELECT 'robustness', system, '', n_base, n_noop FROM robust"""


def _log_tables(s, d):
    r = _from_log(s, d)
    zero, blank = F.lit(0).cast("long"), F.lit("")
    tables = [
        r["accuracy"].select(F.lit("accuracy").alias("tab"), "system", "variant", "n", F.col("n_correct").alias("k")),
        r["significance"].select(F.lit("significance"), blank, "variant", "n_sys1_only", "n_sys2_only"),
        r["errors"].groupBy("system").agg(F.sum("error_count").alias("n")).select(F.lit("errors"), "system", blank, "n", zero),
        r["robustness"].select(F.lit("robustness"), "system", blank, "n_base", "n_noop"),
    ]
    return reduce(DataFrame.union, tables)


add("e26_report_from_log", _log_tables, f"{T}, {_ROB}, {_MCN} {_LOG_SQL}")
add(
    "e26_headline",
    lambda s, d: rounded(report.headline(trials(s, d), "baseline_large")),
    f"""{T}, {_ROB}, mc AS (SELECT a.system, count(*) FILTER (a.correct AND NOT b.correct) AS x,
      count(*) FILTER (NOT a.correct AND b.correct) AS y FROM trials a JOIN trials b ON a.problem_id = b.problem_id
      WHERE a.variant = 'base' AND b.variant = 'base' AND b.system = 'baseline_large' AND a.system <> 'baseline_large' GROUP BY 1),
    st AS (SELECT *, power(abs(x - y) - 1e0, 2) / (x + y) AS statistic FROM mc),
    zz AS (SELECT *, sqrt(statistic / 2) AS z, 1 / (1 + 0.5e0 * sqrt(statistic / 2)) AS t FROM st)
    SELECT r.system, n_base, n_noop, round(base_accuracy, 9) AS base_accuracy, round(noop_accuracy, 9) AS noop_accuracy,
    round(accuracy_drop, 9) AS accuracy_drop, round(accuracy_drop_pct, 9) AS accuracy_drop_pct, round(rrr, 9) AS rrr,
    round(statistic, 9) AS statistic, round({_ERFC}, 9) AS p_value, statistic > 3.841458820694124 AS significant
    FROM robust r LEFT JOIN zz ON r.system = zz.system""",
)
