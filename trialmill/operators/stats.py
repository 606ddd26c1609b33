"""Bootstrap intervals, paired tests and effect sizes.

A resample of n booleans with k hits has a Binomial(n, k/n) number of hits, and the rows of
a numeric column are summed in random cells, which are resampled as wholes.  Both bootstraps therefore draw from
aggregates of bounded size: the shuffle holds groups x replicates, never rows x replicates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..session import cut_lineage
from .pairs import paired

RESAMPLES = 10_000
LEVEL = 0.95
_BLOCK = 500


def _seed(by: Sequence[str], seed: int, *extra: str) -> Column:
    return F.abs(F.xxhash64(F.lit(seed), *[F.col(c) for c in [*by, *extra]]) % F.lit(2**62))


# number of the row that carries the point estimate among the replicates of a group
POINT = -1


def _interval(replicates: DataFrame, by: Sequence[str], level: float) -> DataFrame:
    """Percentile interval (linear between order statistics) of the ``value`` of each group's replicates."""
    tail = (1 - level) / 2
    drawn = F.when(F.col("replicate") != POINT, F.col("value"))
    return replicates.groupBy(*by).agg(
        F.max(F.when(F.col("replicate") == POINT, F.col("value"))).alias("point_estimate"),
        F.percentile(drawn, F.lit(tail)).alias("ci_lower"),
        F.percentile(drawn, F.lit(1 - tail)).alias("ci_upper"),
        F.stddev_pop(drawn).alias("std_error"),
        F.count(drawn).alias("n_bootstrap"),
    )


def _binomial_means():
    # a closure travels to the workers by value, so they need numpy but not this package
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n, k, size = int(row["__n"]), int(row["__k"]), int(row["__size"])
                draws = np.random.default_rng(int(row["__seed"])).binomial(n, k / n, size)
                number, value = row["__start"] + np.arange(size), draws / n
                if row["__start"] == 0:
                    number, value = np.append(number, POINT), np.append(value, k / n)
                out = pd.DataFrame({"replicate": number, "value": value})
                for c in [c for c in pdf.columns if not c.startswith("__")]:
                    out[c] = row[c]
                yield out

    return run


def accuracy_replicates(
    trials: DataFrame, by: Sequence[str], resamples: int = RESAMPLES, seed: int = 42, hit: str = "correct"
) -> DataFrame:
    """Accuracy of each group's resamples; row ``POINT`` holds the accuracy itself."""
    counts = trials.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(hit)).alias("__k"))
    return _replicates_of_counts(counts, by, resamples, seed)


def _replicates_of_counts(counts: DataFrame, by: Sequence[str], resamples: int, seed: int) -> DataFrame:
    blocks = counts.filter("__n > 0").withColumn(
        "__start", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(_BLOCK)))
    )
    ready = blocks.withColumn("__size", F.least(F.lit(_BLOCK), F.lit(resamples) - F.col("__start"))).withColumn(
        "__seed", _seed(by, seed, "__start")
    )
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by)
    return ready.mapInPandas(_binomial_means(), f"{kinds}, replicate long, value double")


def bootstrap_accuracy(
    trials: DataFrame,
    by: Sequence[str] = ("system", "variant"),
    resamples: int = RESAMPLES,
    level: float = LEVEL,
    seed: int = 42,
    hit: str = "correct",
) -> DataFrame:
    """Percentile interval of the accuracy of each group."""
    return _interval(accuracy_replicates(trials, by, resamples, seed, hit), by, level)


#: Cells that the rows of a group are dealt into at random.  Cells are resampled as wholes: the interval's width has a
#: relative standard error of 1 / sqrt(2 * CELLS), 0.8 %, from the deal; resampling 10,000 times adds about as much.
CELLS = 8_192


def _dealt(by: list[str], value: str, cells: int):
    """Sums and counts of each group's cells, from its distinct values and how often they occur."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def scattered(x: np.ndarray) -> np.ndarray:
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            return x ^ (x >> np.uint64(31))

        def flush() -> Iterator[pd.DataFrame]:
            for key, (total, count) in held.items():
                at = np.flatnonzero(count)
                out = pd.DataFrame({"__cell": at, "__s": total[at], "__n": count[at].astype(np.int64)})
                for c, k in zip(by, key):
                    out[c] = k
                yield out
            held.clear()

        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                if key not in held and len(held) >= 64:  # bounds the vectors held at a time
                    yield from flush()
                total, count = held.setdefault(key, np.zeros((2, cells)))
                v, n, seed = part[value].to_numpy(float), part["__n"].to_numpy(np.int64), part["__seed"].to_numpy(np.uint64)
                # copies of a value go to cells one by one, or by one multinomial draw where they outnumber the cells
                few = n <= cells
                copy = np.arange(n[few].sum()) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
                at = scattered(np.repeat(seed[few], n[few]) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(cells)
                at = at.astype(np.int64)
                total += np.bincount(at, np.repeat(v[few], n[few]), cells)
                count += np.bincount(at, minlength=cells)
                for x, k, s in zip(v[~few], n[~few], seed[~few]):
                    dealt = np.random.default_rng(int(s)).multinomial(k, np.full(cells, 1 / cells))
                    total += dealt * x
                    count += dealt
        yield from flush()

    return run


def _weighted_means(by: list[str], cells: int, seed: int):
    # Poisson(1) weights by inversion of 16-bit draws
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))
    of_draw = np.searchsorted(steps, (np.arange(65_536) + 0.5) / 65_536).astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights: tuple[int, np.ndarray] = (-1, np.empty(0))
        for pdf in batches:
            for row in pdf.to_dict("records"):
                start, size = int(row["__start"]), int(row["__size"])
                if weights[0] != start:
                    # one matrix of Poisson weights (replicates x cells) serves all groups
                    weights = (start, of_draw[np.random.default_rng([seed, start]).integers(0, 65_536, (size, cells), np.uint16)])
                sums = np.zeros((cells, 2))
                at = np.asarray(row["__cells"], np.int64)
                sums[at, 0], sums[at, 1] = row["__sums"], row["__counts"]
                both = weights[1] @ sums
                number = start + np.arange(size)
                if start == 0:
                    number, both = np.append(number, POINT), np.vstack([both, sums.sum(axis=0)])
                mean = np.divide(both[:, 0], both[:, 1], out=np.full(len(both), np.nan), where=both[:, 1] > 0)
                out = pd.DataFrame({"replicate": number, "value": mean})
                for c in by:
                    out[c] = row[c]
                yield out

    return run


def mean_replicates(
    df: DataFrame, value: str, by: Sequence[str], resamples: int = RESAMPLES, seed: int = 42, cells: int = CELLS
) -> DataFrame:
    """Poisson-bootstrap means of a numeric column per group and replicate.

    Equal values are counted, and their copies are dealt at random into ``cells``, whose sums and counts
    suffice: replicates are a matrix of Poisson weights times the cells, one product a group and block of
    replicates.  Two rows share a cell, and so their weight, with a chance of 1 / cells; as the deal is random the
    variance stays unbiased.  The deal depends on group and value alone, the weights on the seed and the
    replicate, so a rerun of a lost task repeats both.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__seed", _seed(by, seed, value))
    )
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by)
    dealt = counts.mapInPandas(_dealt(by, value, cells), f"{kinds}, __cell int, __s double, __n long")
    summed = dealt.groupBy(*by, "__cell").agg(F.sum("__s").alias("s"), F.sum("__n").alias("n"))
    # at most ``cells`` entries a group
    groups = summed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__cell", "s", "n"))).alias("c"))
    starts = F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(_BLOCK))
    blocks = groups.select(
        *by, F.col("c.__cell").alias("__cells"), F.col("c.s").alias("__sums"), F.col("c.n").alias("__counts"), F.explode(starts).alias("__start")
    ).withColumn("__size", F.least(F.lit(_BLOCK), F.lit(resamples) - F.col("__start")))
    # the groups of a block of replicates meet where its weights are drawn
    ready = blocks.repartition(-(-resamples // _BLOCK), "__start").sortWithinPartitions("__start")
    means = ready.mapInPandas(_weighted_means(by, cells, seed), f"{kinds}, replicate long, value double")
    return means.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


# upper bounds of the cumulative Poisson(1) distribution
_POISSON_STEPS = []
_p = _c = float(np.exp(-1.0))
for _k in range(1, 14):
    _POISSON_STEPS.append(_c)
    _p /= _k
    _c += _p


def portable_mean_replicates(
    df: DataFrame, value: str, key: str, by: Sequence[str], resamples: int = 20
) -> DataFrame:
    """Poisson-bootstrap means from md5 draws, for few replicates that another engine should repeat.

    The replicate expansion is narrow: each task folds it into partial sums before the shuffle.
    """
    draws = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = uniform(F.col(key), "boot", F.col("replicate"))
    passed = [F.when(u >= F.lit(s), F.lit(1)).otherwise(F.lit(0)) for s in _POISSON_STEPS]
    weighted = draws.withColumn("__w", reduce(lambda a, b: a + b, passed))
    return weighted.groupBy(*by, "replicate").agg(
        F.try_divide(F.sum(F.col("__w") * F.col(value)).cast("double"), F.sum("__w").cast("double")).alias("value")
    )


def bootstrap_mean(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    resamples: int = RESAMPLES,
    level: float = LEVEL,
    seed: int = 42,
) -> DataFrame:
    return _interval(mean_replicates(df, value, by, resamples, seed), by, level)


def replicate_difference(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """Replicate-wise difference of two independently resampled means."""
    a = first.withColumnRenamed("value", "a")
    b = second.withColumnRenamed("value", "b")
    return a.join(b, [*by, "replicate"]).select(*by, "replicate", (F.col("a") - F.col("b")).alias("value"))


def bootstrap_difference(
    first: DataFrame,
    second: DataFrame,
    value: str,
    by: Sequence[str],
    resamples: int = RESAMPLES,
    level: float = LEVEL,
    seed: int = 42,
) -> DataFrame:
    """Interval of mean(first) - mean(second); booleans take the binomial form."""
    if first.schema[value].dataType.simpleString() == "boolean":
        a = accuracy_replicates(first, by, resamples, seed, hit=value)
        b = accuracy_replicates(second, by, resamples, seed + 1, hit=value)
    else:
        a = mean_replicates(first, value, by, resamples, seed)
        b = mean_replicates(second, value, by, resamples, seed + 1)
    return _interval(replicate_difference(a, b, by), by, level)


# --- paired test and effect size -------------------------------------------------------

# rational fit of erfc with a relative error below 1.2e-7
_ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223,
    0.17087277,
)
CHI2_95 = 3.841458820694124


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0."""
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(0.0)
    for c in reversed(_ERFC):
        poly = poly * t + F.lit(c)
    return t * F.exp(-z * z + poly)


def chi2_tail(statistic: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(statistic / 2))


def mcnemar_of_counts(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Continuity-corrected test from contingency counts n_sys1_only and n_sys2_only."""
    b, c = F.col("n_sys1_only"), F.col("n_sys2_only")
    stat = F.coalesce(
        F.try_divide(F.pow(F.abs(b - c).cast("double") - 1, 2), (b + c).cast("double")), F.lit(0.0)
    )
    return (
        cells.withColumn("statistic", stat)
        .withColumn("p_value", F.when(b + c == 0, F.lit(1.0)).otherwise(chi2_tail(F.col("statistic"))))
        .withColumn("significant", F.col("p_value") < alpha)
    )


def mcnemar(
    trials: DataFrame, first: str, second: str, variant: str | None = None, alpha: float = 0.05
) -> DataFrame:
    """Paired test per variant of two systems on the problems both saw."""
    x, y = F.col("first_correct"), F.col("second_correct")
    cells = paired(trials, first, second, variant).groupBy("variant").agg(
        F.count_if(x & y).alias("n_both_correct"),
        F.count_if(x & ~y).alias("n_sys1_only"),
        F.count_if(~x & y).alias("n_sys2_only"),
        F.count_if(~x & ~y).alias("n_both_wrong"),
    )
    return mcnemar_of_counts(cells, alpha)


def cohens_h(p1: Column, p2: Column) -> Column:
    def phi(p: Column) -> Column:
        return 2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))

    return phi(p1) - phi(p2)


def effect_size(h: Column) -> Column:
    size = F.abs(h)
    return (
        F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    )


def ci_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return ~((hi1 < lo2) | (hi2 < lo1))


def with_interval(summary: DataFrame, interval: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    """Attach a bootstrap interval to a metric table under prefixed names; a missing group stays null."""
    named = interval.select(
        *by, F.col("ci_lower").alias(f"{prefix}_ci_lower"), F.col("ci_upper").alias(f"{prefix}_ci_upper")
    )
    return summary.join(named, list(by), "left")


def attach_intervals(
    trials: DataFrame, summaries: dict[str, DataFrame], resamples: int = RESAMPLES, seed: int = 42
) -> dict[str, DataFrame]:
    """Intervals for the robustness, complexity, cost, self-correction and routing tables, where given."""
    by, out = ["system"], dict(summaries)
    variant, path = F.col("variant"), F.col("path_taken")
    # the rows that count for an accuracy; equal ones share their interval
    counted = {
        "base": variant == "base", "noop": variant == "noop", "p1": variant == "p1", "p2": variant == "p2",
        "correction": F.col("iterations") > 1, "fast": path == "fast", "slow": path == "slow",
    }
    used = {
        "robustness": ["base", "noop"], "complexity": ["base", "p1", "p2"], "self_correction": ["correction"], "routing": ["fast", "slow"],
    }
    wanted = sorted({name for table in used if table in out for name in used[table]})
    if wanted:
        # a drop is the difference of two accuracies resampled apart
        labels = {name: counted[name] for name in wanted} | ({"noop again": counted["noop"]} if "robustness" in out else {})
        marks = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in labels.items()]))
        counts = trials.select("system", "correct", F.explode(marks).alias("metric")).groupBy("system", "metric").agg(
            F.count(F.lit(1)).alias("__n"), F.count_if(F.col("correct")).alias("__k")
        )
        drawn = cut_lineage(_replicates_of_counts(counts, ["system", "metric"], resamples, seed))
        apart = drawn.filter(F.col("metric").isin("base", "noop again")).groupBy("system", "replicate").agg(
            *[F.max(F.when(F.col("metric") == name, F.col("value"))).alias(c) for name, c in (("base", "a"), ("noop again", "b"))]
        )
        drops = apart.select("system", F.lit("drop").alias("metric"), "replicate", (F.col("a") - F.col("b")).alias("value")).filter("value is not null")
        found = cut_lineage(_interval(drawn.filter("metric <> 'noop again'").unionByName(drops), ["system", "metric"], LEVEL))
        for table, names in used.items():
            for name in [*names, "drop"] if table == "robustness" else names:
                if table in out:
                    out[table] = with_interval(out[table], found.filter(F.col("metric") == name), by, name)
    if "cost" in out:
        # both columns in one pass over the log
        values = F.array(
            F.struct(F.lit("tokens").alias("metric"), (F.col("tokens_input") + F.col("tokens_output")).cast("double").alias("value")),
            F.struct(F.lit("time").alias("metric"), F.col("execution_time_ms").cast("double").alias("value")),
        )
        both = cut_lineage(bootstrap_mean(trials.select("system", F.inline(values)), "value", ["system", "metric"], resamples, seed=seed))
        tokens, times = (both.filter(F.col("metric") == m) for m in ("tokens", "time"))
        cost = with_interval(out["cost"], tokens, by, "tokens")
        # a system without any token has no token interval
        cost = cost.withColumns(
            {c: F.when(F.col("has_cost"), F.col(c)) for c in ("tokens_ci_lower", "tokens_ci_upper")}
        )
        out["cost"] = with_interval(cost, times, by, "time")
    return out
