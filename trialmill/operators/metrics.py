"""Aggregates over trial logs, label tables, vote samples and name lists.

Each metric is one conditional aggregation: counts and sums are kept whole and
divided once, so the result does not depend on how rows were partitioned.  Totals roll up the
per-group rows, not the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cost as fc
from ..functions import lexicon as lx
from .checks import record_errors
from .pairs import map_error_category


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0.0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def _n(condition: Column, weight: str | None = None) -> Column:
    """How many rows fulfil a condition; with a weight a row stands for that many."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("long"))


def _rows(weight: str | None = None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("long"))


#: Column of ``report_cells`` that counts a cell's trials.
CELL_ROWS = "rows"


def report_cells(trials: DataFrame) -> DataFrame:
    """The log as counted cells from which every table of a report follows: one aggregate, one scan.

    A cell is a system, variant, path, outcome, error category and whether one round was enough; their number does not grow with
    the log.  Pass the cells with ``weight=CELL_ROWS`` to the summaries below.
    """
    rounds = _rounds()
    return (
        map_error_category(trials)
        .groupBy("system", "variant", "path_taken", "correct", "category", "self_corrected", (rounds == 1).alias("single"))
        .agg(
            _rows().alias(CELL_ROWS),
            *[F.sum(c).alias(c) for c in ("tokens_input", "tokens_output", "execution_time_ms")],
            F.sum(rounds).alias("rounds"), F.max(rounds).alias("max_rounds"),
            F.sum("bandit_probability").alias("probabilities"), F.count("bandit_probability").alias("n_probabilities"),
        )
    )


def _total_marks(*keys: str) -> list[Column]:
    """For the aggregation of a rollup: which keys a row sums over."""
    return [F.grouping(k).alias(f"__all_{k}") for k in keys]


def _or_total(key: str, label: str) -> Column:
    """A rollup key with its totals labelled; a key that is null in the data stays null."""
    return F.when(F.col(f"__all_{key}") == 1, F.lit(label)).otherwise(F.col(key).cast("string")).alias(key)


def accuracy(trials: DataFrame, weight: str | None = None) -> DataFrame:
    """Per (system, variant), per system and overall; ``all`` marks a total, a null key stays null."""
    return (
        trials.groupBy("system", "variant")
        .agg(_rows(weight).alias("n"), _n(F.col("correct"), weight).alias("k"))
        .rollup("system", "variant")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("n_correct"), *_total_marks("system", "variant"))
        .select(
            _or_total("system", "all"),
            _or_total("variant", "all"),
            "n",
            "n_correct",
            ratio(F.col("n_correct"), F.col("n")).alias("accuracy"),
        )
    )


def load_summary(trials: DataFrame) -> DataFrame:
    """Problem counts and accuracy of every system with the number of variants and the grand total."""
    out = trials.groupBy("system", "variant").agg(_rows().alias("n"), _n(F.col("correct")).alias("k"))
    return (
        out.rollup("system")
        .agg(
            F.count_distinct("variant").alias("n_variants"),
            F.sum("n").alias("total_problems"),
            F.sum("k").alias("total_correct"),
            *_total_marks("system"),
        )
        .select(
            _or_total("system", "all"),
            "n_variants",
            "total_problems",
            "total_correct",
            ratio(F.col("total_correct"), F.col("total_problems")).alias("accuracy"),
        )
    )


def run_summary(trials: DataFrame, by: Sequence[str] = ("system", "variant")) -> DataFrame:
    fast, slow, ok = F.col("path_taken") == "fast", F.col("path_taken") == "slow", F.col("correct")
    tokens = F.col("total_tokens_input") + F.col("total_tokens_output")
    total = F.col("total_problems")
    return (
        trials.groupBy(*by)
        .agg(
            _rows().alias("total_problems"),
            _n(ok).alias("correct_count"),
            F.count("error_type").alias("error_count"),
            F.sum("tokens_input").alias("total_tokens_input"),
            F.sum("tokens_output").alias("total_tokens_output"),
            F.sum("execution_time_ms").alias("total_time_ms"),
            F.sum("iterations").alias("__iterations"),
            _n(F.col("self_corrected")).alias("__self_corrected"),
            _n(fast).alias("fast_path_count"),
            _n(slow).alias("slow_path_count"),
            _n(fast & ok).alias("__fast_ok"),
            _n(slow & ok).alias("__slow_ok"),
        )
        .select(
            *by,
            "total_problems",
            "correct_count",
            # a correct row that carries an error is subtracted twice, so this can fall below zero
            (total - F.col("correct_count") - F.col("error_count")).alias("incorrect_count"),
            "error_count",
            ratio(F.col("correct_count"), total).alias("accuracy"),
            "total_tokens_input",
            "total_tokens_output",
            ratio(tokens, total).alias("avg_tokens_per_problem"),
            ratio(tokens, F.col("correct_count")).alias("tokens_per_correct"),
            "total_time_ms",
            ratio(F.col("total_time_ms"), total).alias("avg_time_per_problem_ms"),
            ratio(F.col("__iterations"), total).alias("avg_iterations"),
            ratio(F.col("__self_corrected"), total).alias("self_correction_rate"),
            "fast_path_count",
            "slow_path_count",
            ratio(F.col("__fast_ok"), F.col("fast_path_count")).alias("fast_path_accuracy"),
            ratio(F.col("__slow_ok"), F.col("slow_path_count")).alias("slow_path_accuracy"),
        )
    )


def _tier_counts(trials: DataFrame, tiers: Sequence[str], weight: str | None = None) -> DataFrame:
    aggs = []
    for t in tiers:
        here = F.col("variant") == t
        aggs += [_n(here, weight).alias(f"n_{t}"), _n(here & F.col("correct"), weight).alias(f"k_{t}")]
    # no filter on the tiers: a system without any of them scores zero, as in ``robustness``
    return trials.groupBy("system").agg(*aggs)


def robustness(trials: DataFrame, weight: str | None = None) -> DataFrame:
    """Accuracy kept under distractors; a system that lacks either side scores zero throughout."""
    tiers = _tier_counts(trials, ["base", "noop"], weight)
    both = (F.col("n_base") > 0) & (F.col("n_noop") > 0)
    base = F.when(both, ratio(F.col("k_base"), F.col("n_base"))).otherwise(F.lit(0.0))
    noop = F.when(both, ratio(F.col("k_noop"), F.col("n_noop"))).otherwise(F.lit(0.0))
    return tiers.select(
        "system",
        F.when(both, F.col("n_base")).otherwise(F.lit(0)).alias("n_base"),
        F.when(both, F.col("n_noop")).otherwise(F.lit(0)).alias("n_noop"),
        base.alias("base_accuracy"),
        noop.alias("noop_accuracy"),
        (base - noop).alias("accuracy_drop"),
        (ratio(base - noop, base) * 100).alias("accuracy_drop_pct"),
        ratio(noop, base).alias("rrr"),
    )


def improvement_factor(rrr: Column, literature_rrr: float = lx.LITERATURE_RRR) -> Column:
    return rrr / F.lit(literature_rrr)


def complexity_decay(trials: DataFrame, weight: str | None = None) -> DataFrame:
    """Accuracy over the three complexity tiers with the least-squares line through them."""
    tiers = _tier_counts(trials, ["base", "p1", "p2"], weight)
    acc = tiers.select(
        "system", *[ratio(F.col(f"k_{t}"), F.col(f"n_{t}")).alias(f"{t}_accuracy") for t in ("base", "p1", "p2")]
    )
    b, p1, p2 = F.col("base_accuracy"), F.col("p1_accuracy"), F.col("p2_accuracy")
    mean = (b + p1 + p2) / 3
    spread = F.pow(b - mean, 2) + F.pow(p1 - mean, 2) + F.pow(p2 - mean, 2)
    flat = (b == p1) & (p1 == p2)
    return acc.select(
        "system",
        "base_accuracy",
        "p1_accuracy",
        "p2_accuracy",
        (b - p1).alias("base_to_p1_drop"),
        (p1 - p2).alias("p1_to_p2_drop"),
        (b - p2).alias("total_drop"),
        ((b - p2) / 2).alias("per_tier_decay"),
        (ratio(b - p2, b) * 100).alias("decay_pct"),
        # tiers sit at x = 0, 1, 2: slope = (y2 - y0) / 2, Sxx = 2
        F.when(flat, F.lit(0.0)).otherwise((p2 - b) / 2).alias("decay_slope"),
        F.when(flat, F.lit(1.0)).otherwise(F.try_divide(F.pow(p2 - b, 2), 2 * spread)).alias("decay_r_squared"),
    )


def cost_summary(trials: DataFrame, variant: str | None = None, prices=None, models=None, weight: str | None = None) -> DataFrame:
    rows = trials if variant is None else trials.filter(F.col("variant") == variant)
    tokens = F.col("total_input_tokens") + F.col("total_output_tokens")
    n, k = F.col("n_problems"), F.col("n_correct")
    money = F.col("estimated_cost_usd")
    return (
        rows.groupBy("system")
        .agg(
            _rows(weight).alias("n_problems"),
            _n(F.col("correct"), weight).alias("n_correct"),
            F.sum("tokens_input").alias("total_input_tokens"),
            F.sum("tokens_output").alias("total_output_tokens"),
            F.sum("execution_time_ms").alias("total_time_ms"),
        )
        .withColumn(
            "estimated_cost_usd",
            fc.token_cost(
                F.col("total_input_tokens"),
                F.col("total_output_tokens"),
                fc.model_of_system(F.col("system"), models),
                prices,
            ),
        )
        .select(
            "system",
            "n_problems",
            "n_correct",
            ratio(k, n).alias("accuracy"),
            tokens.alias("total_tokens"),
            "total_input_tokens",
            "total_output_tokens",
            ratio(tokens, n).alias("avg_tokens_per_problem"),
            ratio(F.col("total_input_tokens"), n).alias("avg_input_tokens"),
            ratio(F.col("total_output_tokens"), n).alias("avg_output_tokens"),
            "total_time_ms",
            ratio(F.col("total_time_ms"), n).alias("avg_time_per_problem_ms"),
            money.alias("estimated_cost_usd"),
            ratio(money, n).alias("cost_per_problem_usd"),
            ratio(money, k).alias("cost_per_correct_usd"),
            ratio(tokens, k).alias("tokens_per_correct"),
            # logs without token counts price at zero, which is no saving
            (tokens > 0).alias("has_cost"),
        )
    )


def error_breakdown(trials: DataFrame, by: Sequence[str] = ("system",), weight: str | None = None) -> DataFrame:
    """Failures per category with their share of all problems of the group."""
    mapped = map_error_category(trials) if weight is None else trials
    counts = mapped.groupBy(*by, "category").agg(_rows(weight).alias("rows"))
    group = Window.partitionBy(*by)  # at most a dozen rows per group by now
    failed = F.sum(F.when(F.col("category").isNotNull(), F.col("rows")).otherwise(F.lit(0))).over(group)
    total = F.sum("rows").over(group)
    return (
        counts.withColumns({"total_problems": total, "total_errors": failed})
        .filter(F.col("category").isNotNull())
        .select(
            *by,
            "category",
            F.col("rows").alias("error_count"),
            "total_problems",
            "total_errors",
            ratio(F.col("rows"), F.col("total_problems")).alias("share"),
            ratio(F.col("total_errors"), F.col("total_problems")).alias("error_rate"),
            ratio(F.col("total_problems") - F.col("total_errors"), F.col("total_problems")).alias("accuracy"),
        )
    )


def error_matrix(trials: DataFrame) -> DataFrame:
    """System by category, in percent of all problems; one column per known category, in name order."""
    names = sorted([*lx.ERROR_CATEGORIES, lx.WRONG_ANSWER, lx.UNKNOWN_ERROR])
    counted = map_error_category(trials).groupBy("system").agg(
        _rows().alias("n"), *[_n(F.col("category") == c).alias(c) for c in names]
    )
    return counted.select("system", *[(ratio(F.col(c), F.col("n")) * 100).alias(c) for c in names])


def _rounds() -> Column:
    return F.when(F.col("iterations") > 0, F.col("iterations")).otherwise(F.lit(1))


def self_correction(trials: DataFrame, by: Sequence[str] = ("system",), weight: str | None = None) -> DataFrame:
    if weight is None:
        trials = trials.withColumn("rounds", _rounds()).withColumns({"single": F.col("rounds") == 1, "max_rounds": F.col("rounds")})
    single, ok = F.col("single"), F.col("correct")
    return (
        trials.groupBy(*by)
        .agg(
            _rows(weight).alias("total_problems"),
            _n(ok, weight).alias("n_correct"),
            _n(single, weight).alias("single_iteration"),
            _n(~single, weight).alias("multi_iteration"),
            _n(single & ok, weight).alias("single_iter_correct"),
            _n(~single & ok, weight).alias("multi_iter_correct"),
            _n(F.col("self_corrected"), weight).alias("self_corrected"),
            F.sum("rounds").alias("__rounds"),
            F.max("max_rounds").alias("max_iterations"),
        )
        .select(
            *by,
            "total_problems",
            "single_iteration",
            "multi_iteration",
            "self_corrected",
            ratio(F.col("__rounds"), F.col("total_problems")).alias("avg_iterations"),
            "max_iterations",
            "multi_iter_correct",
            (F.col("multi_iteration") - F.col("multi_iter_correct")).alias("multi_iter_incorrect"),
            ratio(F.col("multi_iter_correct"), F.col("multi_iteration")).alias("correction_success_rate"),
            ratio(F.col("multi_iteration"), F.col("total_problems")).alias("reflection_usage_rate"),
            ratio(F.col("n_correct"), F.col("total_problems")).alias("accuracy"),
            ratio(F.col("single_iter_correct"), F.col("single_iteration")).alias("first_try_accuracy"),
        )
    )


def iteration_histogram(trials: DataFrame, by: Sequence[str] = ("system",)) -> DataFrame:
    return trials.groupBy(*by, _rounds().alias("iterations")).agg(_rows().alias("n"))


def routing_summary(trials: DataFrame, by: Sequence[str] = ("system",), weight: str | None = None) -> DataFrame:
    """Path mix and accuracy; overall accuracy counts only routed rows as correct, over all rows."""
    fast, slow, ok = F.col("path_taken") == "fast", F.col("path_taken") == "slow", F.col("correct")
    n = F.col("total_problems")
    fast_acc = ratio(F.col("fast_correct"), F.col("fast_path_count"))
    slow_acc = ratio(F.col("slow_correct"), F.col("slow_path_count"))
    probability = F.avg("bandit_probability") if weight is None else F.try_divide(F.sum("probabilities"), F.sum("n_probabilities"))
    return (
        trials.groupBy(*by)
        .agg(
            _rows(weight).alias("total_problems"),
            _n(fast, weight).alias("fast_path_count"),
            _n(slow, weight).alias("slow_path_count"),
            _n(fast & ok, weight).alias("fast_correct"),
            _n(slow & ok, weight).alias("slow_correct"),
            F.coalesce(probability, F.lit(0.0)).alias("avg_probability"),
        )
        .select(
            *by,
            "total_problems",
            "fast_path_count",
            "slow_path_count",
            ratio(F.col("fast_path_count"), n).alias("fast_path_ratio"),
            "fast_correct",
            "slow_correct",
            fast_acc.alias("fast_path_accuracy"),
            slow_acc.alias("slow_path_accuracy"),
            (slow_acc - fast_acc).alias("accuracy_gap"),
            ratio(F.col("fast_correct") + F.col("slow_correct"), n).alias("overall_accuracy"),
            "avg_probability",
        )
    )


def routing_comparison(trials: DataFrame, first: str, second: str, threshold: float = 0.02) -> DataFrame:
    """Unweighted mean accuracy over the first system's variants, and whether the gap exceeds the threshold."""
    rows = routing_summary(trials.filter(F.col("system").isin(first, second)), ["system", "variant"])
    wide = rows.groupBy("variant").agg(
        F.max(F.when(F.col("system") == first, F.col("overall_accuracy"))).alias("a"),
        F.coalesce(F.max(F.when(F.col("system") == second, F.col("overall_accuracy"))), F.lit(0.0)).alias("b"),
    )
    means = wide.filter(F.col("a").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_variants"), F.avg("a").alias("accuracy_first"), F.avg("b").alias("accuracy_second")
    )
    diff = F.col("accuracy_first") - F.col("accuracy_second")
    return means.withColumn("difference", diff).withColumn("significant", F.abs(diff) > threshold)


# --- oracle labels -----------------------------------------------------------------


def _cells() -> dict[str, Column]:
    fast, slow = F.col("fast_correct"), F.col("slow_correct")
    return {
        "both_correct": _n(fast & slow),
        "only_slow_correct": _n(slow & ~fast),
        "only_fast_correct": _n(fast & ~slow),
        "both_wrong": _n(~fast & ~slow),
    }


def oracle_stats(labels: DataFrame) -> DataFrame:
    """The four outcome cells per variant and overall."""
    cells = _cells()
    n = F.col("total")
    return (
        labels.groupBy("variant")
        .agg(_rows().alias("total"), *[c.alias(k) for k, c in cells.items()])
        .rollup("variant")
        .agg(*[F.sum(c).alias(c) for c in ("total", *cells)], *_total_marks("variant"))
        .select(
            _or_total("variant", "overall"),
            "total",
            *cells,
            ratio(n - F.col("only_slow_correct"), n).alias("fast_rate"),
            ratio(n - F.col("both_wrong"), n).alias("oracle_accuracy"),
        )
    )


def oracle_rates(labels: DataFrame) -> DataFrame:
    """Overall rates in one row, with a map of counts per variant."""
    fast, slow = F.col("fast_correct"), F.col("slow_correct")
    per_variant = labels.groupBy("variant").agg(
        _rows().alias("total"),
        _n(fast).alias("fast_correct"),
        _n(slow).alias("slow_correct"),
        _n(~(slow & ~fast)).alias("oracle_fast"),
        _n(fast & slow).alias("both"),
        _n(~fast & ~slow).alias("none"),
    )
    counts = F.struct("total", "fast_correct", "slow_correct", "oracle_fast")
    n = F.sum("total")
    return per_variant.agg(
        n.alias("total"),
        ratio(F.sum("fast_correct"), n).alias("fast_accuracy"),
        ratio(F.sum("slow_correct"), n).alias("slow_accuracy"),
        ratio(F.sum("both"), n).alias("both_correct_rate"),
        ratio(F.sum("none"), n).alias("both_wrong_rate"),
        ratio(n - F.sum("oracle_fast"), n).alias("only_slow_correct_rate"),
        ratio(F.sum("oracle_fast"), n).alias("oracle_fast_rate"),
        ratio(n - F.sum("oracle_fast"), n).alias("oracle_slow_rate"),
        # one entry per variant, so the collected list is as short as the variant list
        F.map_from_entries(F.collect_list(F.struct("variant", counts))).alias("by_variant"),
    )


def decision_metrics(log: DataFrame, alpha: float = fc.ALPHA, beta: float = fc.BETA) -> DataFrame:
    """Mean loss, regret and path mix of logged decisions (action, correct, fast_correct?, slow_correct?)."""
    known = F.col("fast_correct").isNotNull() & F.col("slow_correct").isNotNull()
    gap = F.when(
        known, fc.regret(F.col("action"), F.col("fast_correct"), F.col("slow_correct"), alpha, beta)
    )
    fast = F.col("action") == fc.FAST
    out = log.agg(
        _rows().alias("total"),
        _n(F.col("correct")).alias("k"),
        _n(fast).alias("fast"),
        F.sum(fc.loss(F.col("correct"), F.col("action"), alpha, beta)).alias("loss"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("avg_regret"),
    )
    n = F.col("total")
    return out.select(
        "total",
        ratio(F.col("k"), n).alias("accuracy"),
        ratio(F.col("loss"), n).alias("avg_loss"),
        "avg_regret",
        ratio(F.col("fast"), n).alias("fast_rate"),
        ratio(n - F.col("fast"), n).alias("slow_rate"),
    )


def cost_saved(fast_rate: Column, slow_rate: Column) -> Column:
    return 1.0 - (fast_rate * fc.FAST_COST + slow_rate * fc.SLOW_COST)


# --- votes, solutions, names, pilots -------------------------------------------------


def majority_vote(samples: DataFrame) -> DataFrame:
    """The most frequent non-null answer per problem, the earliest sampled one on a tie."""
    per_answer = samples.groupBy("problem_id", "answer").agg(
        _rows().alias("votes"),
        F.min("sample_idx").alias("seen"),
        F.sum("tokens_input").alias("tokens_input"),
        F.sum("tokens_output").alias("tokens_output"),
    )
    # most votes first, then the smallest first index; null answers never win
    standing = F.when(
        F.col("answer").isNotNull(), F.struct("votes", (-F.col("seen")).alias("early"), "answer")
    )
    return (
        per_answer.groupBy("problem_id")
        .agg(
            F.max(standing).alias("top"),
            F.sum(F.when(F.col("answer").isNotNull(), F.col("votes")).otherwise(F.lit(0))).alias("valid_votes"),
            F.sum("votes").alias("k_samples"),
            F.sum("tokens_input").alias("tokens_input"),
            F.sum("tokens_output").alias("tokens_output"),
        )
        .select(
            "problem_id",
            F.col("top.answer").alias("final_answer"),
            F.coalesce("top.votes", F.lit(0)).alias("vote_count"),
            "valid_votes",
            "k_samples",
            "tokens_input",
            "tokens_output",
        )
    )


def answer_status(solutions: DataFrame, problems: DataFrame) -> DataFrame:
    """SAT for one distinct solution, AMBIGUOUS for several, NO_ANSWER for none."""
    found = solutions.groupBy("problem_id").agg(
        F.min("solution").alias("lo"), F.max("solution").alias("hi"), F.count("solution").alias("n")
    )
    status = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "NO_ANSWER")
        .when(F.col("lo") == F.col("hi"), "SAT")
        .otherwise("AMBIGUOUS")
    )
    return (
        problems.select("problem_id")
        .distinct()
        .join(found, "problem_id", "left")
        .select("problem_id", status.alias("status"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("answer"))
    )


def generation_stats(requested: DataFrame, records: DataFrame) -> DataFrame:
    """Templates, requested, generated, failed and invalid instances of a corpus job per variant."""
    asked = requested.groupBy("variant").agg(
        F.count_distinct("template_id").alias("templates_loaded"), F.sum("instances").alias("instances_requested")
    )
    made = records.groupBy("variant").agg(
        _rows().alias("instances_generated"), _n(F.size(record_errors()) > 0).alias("validation_errors")
    )
    return (
        asked.join(made, "variant", "left")
        .fillna(0)
        .withColumn("instances_failed", F.col("instances_requested") - F.col("instances_generated"))
    )


def pipeline_summary(stats: DataFrame) -> DataFrame:
    """Generation counts per variant with a row of totals."""
    counts = [f.name for f in stats.schema if f.name != "variant"]
    summed = stats.rollup("variant").agg(*[F.sum(c).alias(c) for c in counts], *_total_marks("variant"))
    return summed.select(_or_total("variant", "total"), *counts)


def dataset_metadata(records: DataFrame) -> DataFrame:
    """Record, template and validity counts per variant and overall."""
    bad = F.size(record_errors()) > 0
    base = records.withColumn("__bad", bad).groupBy("variant", "template_id").agg(
        _rows().alias("n"), _n(F.col("__bad")).alias("bad"), _n(F.col("is_noop")).alias("noop")
    )
    return (
        base.rollup("variant")
        .agg(
            F.sum("n").alias("generated"),
            F.count_distinct("template_id").alias("templates"),
            F.sum("bad").alias("errors"),
            F.sum("noop").alias("noop_records"),
            *_total_marks("variant"),
        )
        .select(_or_total("variant", "total"), "generated", "templates", "errors", "noop_records")
    )


def dimension_counts(names: DataFrame) -> DataFrame:
    """Entries and distinct names per block and in total."""
    per_name = names.groupBy("block", "name").agg(_rows().alias("n"))
    return per_name.rollup("block").agg(
        F.sum("n").alias("entries"), F.count_distinct("name").alias("distinct_names"), *_total_marks("block")
    ).select(_or_total("block", "total"), "entries", "distinct_names")


def project_cost(
    trials: DataFrame,
    n_problems: int,
    input_multiplier: float = 3.5,
    output_multiplier: float = 2.0,
    verified_runs: int = 3,
) -> DataFrame:
    """Dollars of a full run from the average tokens of a pilot: two baselines and the verified runs."""
    avg = trials.agg(
        F.sum("tokens_input").alias("i"), F.sum("tokens_output").alias("o"), _rows().alias("n")
    ).select(ratio(F.col("i"), F.col("n")).alias("avg_input"), ratio(F.col("o"), F.col("n")).alias("avg_output"))
    i, o = F.col("avg_input"), F.col("avg_output")

    def dollars(model: str, mi: float = 1.0, mo: float = 1.0) -> Column:
        pi, po = lx.PRICES[model]
        return (i * mi * pi + o * mo * po) / 1e6 * n_problems

    out = avg.select(
        "avg_input",
        "avg_output",
        dollars("large").alias("large_total"),
        dollars("small").alias("small_total"),
        dollars("large", input_multiplier, output_multiplier).alias("verified_total"),
    )
    return out.withColumn(
        "total_estimate", F.col("large_total") + F.col("small_total") + F.col("verified_total") * verified_runs
    )


def pilot_summary(log: DataFrame) -> DataFrame:
    """Accuracy and path mix in percent per variant and overall; error rows count as neither fast nor slow."""
    fast, slow = F.col("path_taken") == "fast", F.col("path_taken") == "slow"
    n = F.col("total")
    return (
        log.groupBy("variant")
        .agg(
            _rows().alias("total"), _n(F.col("correct")).alias("correct"), _n(fast).alias("fast"), _n(slow).alias("slow")
        )
        .rollup("variant")
        .agg(*[F.sum(c).alias(c) for c in ("total", "correct", "fast", "slow")], *_total_marks("variant"))
        .select(
            _or_total("variant", "overall"),
            "total",
            "correct",
            (ratio(F.col("correct"), n) * 100).alias("accuracy_pct"),
            "fast",
            (ratio(F.col("fast"), n) * 100).alias("fast_pct"),
            "slow",
            (100 - ratio(F.col("fast"), n) * 100).alias("slow_pct"),
        )
    )


def hypothesis_checks(
    trials: DataFrame, system: str, baseline: str, gain_target: float = 15.0, rrr_target: float = lx.TARGET_RRR
) -> DataFrame:
    """Whether a system gains enough base accuracy over a baseline and keeps it under distractors."""
    rows = robustness(trials.filter(F.col("system").isin(system, baseline)))
    one = rows.agg(
        F.coalesce(F.max(F.when(F.col("system") == system, F.col("base_accuracy"))), F.lit(0.0)).alias("own"),
        F.coalesce(F.max(F.when(F.col("system") == baseline, F.col("base_accuracy"))), F.lit(0.0)).alias("ref"),
        F.coalesce(F.max(F.when(F.col("system") == system, F.col("rrr"))), F.lit(0.0)).alias("rrr"),
    )
    gain = (F.col("own") - F.col("ref")) * 100
    checks = F.array(
        F.struct(
            F.lit("accuracy_gain").alias("hypothesis"),
            F.lit(gain_target).alias("target"),
            gain.alias("result"),
            F.when(gain >= gain_target, "CONFIRMED").otherwise("PARTIAL").alias("status"),
        ),
        F.struct(
            F.lit("noop_robustness").alias("hypothesis"),
            F.lit(rrr_target).alias("target"),
            F.col("rrr").alias("result"),
            F.when(F.col("rrr") >= rrr_target, "CONFIRMED").otherwise("EXCEEDS_SOTA").alias("status"),
        ),
    )
    return one.select(F.inline(checks))
