"""Policy evaluation from oracle cells, logged decisions, route choice and model fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cost as fc
from ..functions import text as tx
from ..functions.draws import uniform
from .metrics import cost_saved, decision_metrics, ratio

ALPHA_GRID = [5.0, 10.0, 15.0, 20.0]
BETA_GRID = [0.5, 1.0, 2.0]
RATE_GRID = [0.3, 0.4, 0.5, 0.6, 0.7]


def outcome_cells(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Problem counts per (fast_correct, slow_correct): all that a context-free policy's loss depends on."""
    return labels.groupBy(*by, "fast_correct", "slow_correct").agg(F.count(F.lit(1)).alias("n"))


def _cell_losses(alpha: Column, beta: Column) -> dict[str, Column]:
    fast, slow = F.col("fast_correct"), F.col("slow_correct")
    best = fc.oracle_action(fast, slow)
    return {
        "lf": fc.loss(fast, F.lit(fc.FAST), alpha, beta),
        "ls": fc.loss(slow, F.lit(fc.SLOW), alpha, beta),
        "lo": fc.loss(fc.chosen_correct(best, fast, slow), best, alpha, beta),
    }


def policy_grid(
    labels: DataFrame,
    alphas: Sequence[float] = tuple(ALPHA_GRID),
    betas: Sequence[float] = tuple(BETA_GRID),
    rates: Sequence[float] = tuple(RATE_GRID),
) -> DataFrame:
    """Expected accuracy, loss, regret and savings of every (alpha, beta, fast rate) policy.

    The labels shrink to four counted cells before the grid is crossed in, so the
    cross join is 4 x grid rows whatever the size of the labels.
    """
    grid = labels.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    )
    grid = grid.select("alpha", F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"))
    grid = grid.select("alpha", "beta", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("policy_fast_rate"))
    cells = outcome_cells(labels).crossJoin(F.broadcast(grid))
    losses = _cell_losses(F.col("alpha"), F.col("beta"))
    rate = F.col("policy_fast_rate")
    expected = rate * F.col("lf") + (1 - rate) * F.col("ls")
    hit = rate * F.col("fast_correct").cast("int") + (1 - rate) * F.col("slow_correct").cast("int")
    n = F.col("n")
    summed = (
        cells.withColumns(losses)
        .groupBy("alpha", "beta", "policy_fast_rate")
        .agg(
            F.sum("n").alias("total"),
            F.sum(n * hit).alias("hits"),
            F.sum(n * expected).alias("loss"),
            F.sum(n * (expected - F.col("lo"))).alias("regret"),
            F.sum(n * F.col("ls")).alias("slow_loss"),
        )
    )
    return summed.select(
        "alpha",
        "beta",
        "policy_fast_rate",
        "total",
        ratio(F.col("hits"), F.col("total")).alias("accuracy"),
        ratio(F.col("loss"), F.col("total")).alias("avg_loss"),
        ratio(F.col("regret"), F.col("total")).alias("avg_regret"),
        ratio(F.col("slow_loss") - F.col("loss"), F.col("slow_loss")).alias("cost_savings"),
    )


def evaluate_policy(labels: DataFrame, rate: float, alpha: float = fc.ALPHA, beta: float = fc.BETA) -> DataFrame:
    return policy_grid(labels, [alpha], [beta], [rate])


def evaluate_oracle_policy(labels: DataFrame, alpha: float = fc.ALPHA, beta: float = fc.BETA) -> DataFrame:
    """The zero-regret optimum."""
    losses = _cell_losses(F.lit(float(alpha)), F.lit(float(beta)))
    fast, slow = F.col("fast_correct"), F.col("slow_correct")
    best = fc.oracle_action(fast, slow)
    n = F.col("n")
    summed = (
        outcome_cells(labels)
        .withColumns(losses)
        .agg(
            F.sum("n").alias("total"),
            F.sum(n * fc.chosen_correct(best, fast, slow).cast("int")).alias("hits"),
            F.sum(n * F.col("lo")).alias("loss"),
            F.sum(n * (best == fc.FAST).cast("int")).alias("fast"),
            F.sum(n * F.col("ls")).alias("slow_loss"),
        )
    )
    return summed.select(
        "total",
        ratio(F.col("hits"), F.col("total")).alias("accuracy"),
        ratio(F.col("loss"), F.col("total")).alias("avg_loss"),
        F.lit(0.0).alias("avg_regret"),
        ratio(F.col("fast"), F.col("total")).alias("fast_rate"),
        ratio(F.col("slow_loss") - F.col("loss"), F.col("slow_loss")).alias("cost_savings"),
    )


def tune_policy(
    labels: DataFrame,
    alphas: Sequence[float] = tuple(ALPHA_GRID),
    betas: Sequence[float] = tuple(BETA_GRID),
    rates: Sequence[float] = tuple(RATE_GRID),
    min_accuracy: float | None = None,
) -> DataFrame:
    """The grid by rising loss; ``is_best`` marks the winner.  ``min_accuracy`` optionally restricts it."""
    grid = policy_grid(labels, alphas, betas, rates)
    if min_accuracy is not None:
        grid = grid.filter(F.col("accuracy") >= min_accuracy)
    # rounding keeps equal losses equal whatever the order of summation; the grid has a few dozen rows
    order = [F.round("avg_loss", 9), "alpha", "beta", "policy_fast_rate"]
    return grid.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn(
        "is_best", F.col("rank") == 1
    )


# --- logged decisions ---------------------------------------------------------------


LABEL_KEY = ("variant", "problem_id")


def simulate_logging(labels: DataFrame, epsilon: float = 0.1, key: Sequence[str] = LABEL_KEY) -> DataFrame:
    """Log the oracle action, or the other one with probability epsilon, with its cost and propensity.

    Every label draws on its own whole key, so one problem's variants explore independently.
    """
    best = fc.oracle_action(F.col("fast_correct"), F.col("slow_correct"))
    explored = uniform(F.concat_ws("/", *key), "log") < epsilon
    action = F.when(explored, 1 - best).otherwise(best)
    right = fc.chosen_correct(F.col("logged_action"), F.col("fast_correct"), F.col("slow_correct"))
    return (
        labels.withColumn("explored", explored)
        .withColumn("logged_action", action)
        .withColumn("logged_cost", F.when(right, F.lit(0.0)).otherwise(F.lit(1.0)))
        .withColumn("propensity", F.when(explored, F.lit(epsilon)).otherwise(F.lit(1.0 - epsilon)))
    )


def bandit_example(
    features: Column, action: Column | None = None, cost: Column | None = None, propensity: Column | None = None,
    online: bool = False,
) -> Column:
    """A three-line example: shared features, fast line, slow line.

    The logged action's line carries ``index:cost:propensity``; the index is the
    action, or always 0 in the online form.  Without an action both lines are bare.
    """
    bare = ["|a fast", "|a slow"] if not online else ["|Action fast", "|Action slow"]
    lines = []
    for a, text in enumerate(bare):
        if action is None:
            lines.append(F.lit(text))
            continue
        label = F.format_string(f"%d:%s:%s {text}", F.lit(0 if online else a), cost.cast("string"),
                                propensity.cast("string"))
        lines.append(F.when(action == a, label).otherwise(F.lit(text)))
    return F.concat_ws("\n", F.concat(F.lit("shared "), features), *lines)


def exploration_pmf(scores: Column, algorithm: str = "squarecb", gamma: float = 10.0, epsilon: float = 0.2) -> Column:
    """Action probabilities from predicted costs; the lowest cost is the best action, the lower index on ties."""
    k = F.size(scores)
    best = F.array_position(scores, F.array_min(scores)) - 1
    if algorithm == "epsilon":
        if not 0 <= epsilon <= 1:
            raise ValueError("epsilon must lie in [0, 1]")
        share = F.lit(epsilon) / k
        return F.transform(scores, lambda _, i: F.when(i == best, share + (1 - epsilon)).otherwise(share))
    if algorithm == "squarecb":
        if gamma <= 0:
            raise ValueError("gamma must be positive")
        low = F.array_min(scores)
        others = F.transform(
            scores, lambda s, i: F.when(i == best, F.lit(0.0)).otherwise(1 / (k + gamma * (s - low)))
        )
        rest = F.lit(1.0) - F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        return F.transform(others, lambda p, i: F.when(i == best, rest).otherwise(p))
    raise ValueError(f"unknown exploration algorithm: {algorithm!r}")


def route(
    df: DataFrame, strategy: str, key: str = "problem_id", pmf: str | None = None, fast_probability: float = 0.5
) -> DataFrame:
    """Choose a path per row; the probability is that of the taken path.

    ``fixed_slow`` has no probability.  A missing or empty pmf falls back to slow at 1.0.
    """
    u = uniform(F.col(key), "route")
    none = F.lit(None).cast("double")
    if strategy == "fixed_slow":
        action, prob = F.lit(fc.SLOW), none
    elif strategy in ("force_fast", "force_slow"):
        action, prob = F.lit(fc.FAST if strategy == "force_fast" else fc.SLOW), F.lit(1.0)
    elif strategy == "random":
        p = F.lit(float(fast_probability))
        action = F.when(u < p, F.lit(fc.FAST)).otherwise(F.lit(fc.SLOW))
        prob = F.when(u < p, p).otherwise(1 - p)
    elif strategy in ("sample", "argmax"):
        weights = F.col(pmf)
        usable = weights.isNotNull() & (F.size(weights) == 2)
        first = F.get(weights, 0)
        if strategy == "sample":
            picked = F.when(u < first, F.lit(fc.FAST)).otherwise(F.lit(fc.SLOW))
        else:
            picked = (F.array_position(weights, F.array_max(weights)) - 1).cast("int")
        action = F.when(usable, picked).otherwise(F.lit(fc.SLOW))
        prob = F.when(usable, F.when(picked == fc.FAST, first).otherwise(F.get(weights, 1))).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown routing strategy: {strategy!r}")
    return df.withColumn("action", action).withColumn("path_taken", fc.action_name(action)).withColumn(
        "routing_prob", prob
    )


def evaluate_logged_policy(
    logged: DataFrame, policy_action: str = "policy_action", fast_cost: str | None = None, slow_cost: str | None = None
) -> DataFrame:
    """Average loss of the log and the policy's value: importance-weighted, and direct and doubly robust
    where predicted costs are given."""
    same = F.col(policy_action) == F.col("logged_action")
    c, p = F.col("logged_cost"), F.col("propensity")
    aggs = [
        F.count(F.lit(1)).alias("n_examples"),
        F.avg("logged_cost").alias("avg_loss"),
        F.avg(F.when(same, c / p).otherwise(F.lit(0.0))).alias("ips"),
    ]
    if fast_cost and slow_cost:
        guess = F.when(F.col(policy_action) == fc.FAST, F.col(fast_cost)).otherwise(F.col(slow_cost))
        aggs += [
            F.avg(guess).alias("dm"),
            F.avg(guess + F.when(same, (c - guess) / p).otherwise(F.lit(0.0))).alias("dr"),
        ]
    return logged.agg(*aggs)


def replay_policy(labels: DataFrame, decisions: DataFrame, key: Sequence[str] = LABEL_KEY) -> DataFrame:
    """Decision metrics and saved cost of chosen actions on labelled problems, matched on the labels' whole key."""
    chosen = labels.select(*key, "fast_correct", "slow_correct").join(decisions.select(*key, "action"), list(key))
    log = chosen.withColumn(
        "correct", fc.chosen_correct(F.col("action"), F.col("fast_correct"), F.col("slow_correct"))
    )
    return decision_metrics(log).withColumn("cost_saved", cost_saved(F.col("fast_rate"), F.col("slow_rate")))


# --- model fits -----------------------------------------------------------------------


def pca_fit(df: DataFrame, k: int = 50, column: str = "embedding", whiten: bool = True) -> PipelineModel:
    """Centred (and whitened) principal components of an array column.

    Spark sums the d x d moments per partition; only that matrix reaches the driver.
    """
    vectors = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("__raw"))
    centre = StandardScaler(inputCol="__raw", outputCol="__centred", withMean=True, withStd=False)
    pca = PCA(k=k, inputCol="__centred", outputCol="__rotated")
    model = Pipeline(stages=[centre, pca]).fit(vectors)
    scaler, components = model.stages
    total = float(sum(s * s for s in scaler.std))
    eigen = [max(float(r) * total, 1e-12) for r in components.explainedVariance]
    weights = [e**-0.5 for e in eigen] if whiten else [1.0] * len(eigen)
    scale = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="__rotated", outputCol="__reduced")
    return PipelineModel(stages=[scaler, components, scale])


def variance_retained(model: PipelineModel) -> float:
    return float(sum(model.stages[1].explainedVariance))


def pca_transform(df: DataFrame, model: PipelineModel | None, column: str = "embedding") -> DataFrame:
    if model is None:
        raise ValueError("fit the reduction first")
    raw = df.withColumn("__raw", array_to_vector(F.col(column).cast("array<double>")))
    out = model.transform(raw).withColumn("reduced", vector_to_array("__reduced"))
    return out.drop("__raw", "__centred", "__rotated", "__reduced")


class RoutingPolicy:
    """Predicted cost per action; the cheaper action wins, fast on a tie."""

    def __init__(self, models: Sequence[LinearRegressionModel]):
        self.models = list(models)

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        out = df
        for name, model in zip(("fast_cost", "slow_cost"), self.models):
            out = model.setFeaturesCol(features).setPredictionCol(name).transform(out)
        action = F.when(F.col("fast_cost") <= F.col("slow_cost"), F.lit(fc.FAST)).otherwise(F.lit(fc.SLOW))
        return out.withColumn("scores", F.array("fast_cost", "slow_cost")).withColumn("policy_action", action)

    def save(self, path: str) -> None:
        for name, model in zip(("fast", "slow"), self.models):
            model.write().overwrite().save(f"{path}/{name}")

    @classmethod
    def load(cls, path: str) -> RoutingPolicy:
        return cls([LinearRegressionModel.load(f"{path}/{name}") for name in ("fast", "slow")])


def train_policy_dr(
    logged: DataFrame, features: str = "features", passes: int = 20, l2: float = 1e-6
) -> RoutingPolicy:
    """Doubly robust warm start: fit costs per action on the log, correct them by the logged error over its
    propensity, and refit on every row."""

    def fit(rows: DataFrame, label: str) -> LinearRegressionModel:
        return LinearRegression(
            featuresCol=features, labelCol=label, regParam=l2, maxIter=passes, solver="auto"
        ).fit(rows)

    # four fits read these columns
    rows = logged.select(features, "logged_action", "logged_cost", "propensity").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        direct = RoutingPolicy([fit(rows.filter(F.col("logged_action") == a), "logged_cost") for a in (0, 1)])
        guessed = direct.predict(rows, features)
        models = []
        for a, name in enumerate(("fast_cost", "slow_cost")):
            fix = F.when(
                F.col("logged_action") == a, (F.col("logged_cost") - F.col(name)) / F.col("propensity")
            ).otherwise(F.lit(0.0))
            models.append(fit(guessed.withColumn("__target", F.col(name) + fix), "__target"))
    finally:
        rows.unpersist()
    return RoutingPolicy(models)


# --- linear policies by moments ---------------------------------------------------------


def _moments():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one matrix per action; it leaves the partition once, at its end
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for action, part in pdf.groupby("logged_action"):
                x = np.column_stack([np.ones(len(part)), np.stack(part["features"].to_numpy())])
                y = part["logged_cost"].to_numpy(dtype=float)
                full = np.column_stack([x.T @ x, x.T @ y])
                sums[int(action)] = sums.get(int(action), 0) + full
        for action, full in sums.items():
            i, j = np.indices(full.shape)
            yield pd.DataFrame({"action": action, "i": i.ravel(), "j": j.ravel(), "total": full.ravel()})

    return run


def policy_moments(logged: DataFrame) -> DataFrame:
    """Per action, the sums X'X and X'c (last column) of (features, logged_cost) with an intercept."""
    rows = logged.select(F.col("logged_action").cast("int"), "features", F.col("logged_cost").cast("double"))
    partial = rows.mapInPandas(_moments(), "action int, i int, j int, total double")
    return partial.groupBy("action", "i", "j").agg(F.sum("total").alias("total"))


def fit_from_moments(moments: DataFrame, width: int, l2: float = 1e-6) -> dict[int, np.ndarray]:
    """Ridge weights per action, intercept first.  The moments are (width+1) x (width+2) numbers per action."""
    summed = moments.groupBy("action", "i", "j").agg(F.sum("total").alias("total")).collect()
    out = {}
    for action in sorted({r["action"] for r in summed}):
        full = np.zeros((width + 1, width + 2))
        for r in summed:
            if r["action"] == action:
                full[r["i"], r["j"]] = r["total"]
        out[action] = np.linalg.solve(full[:, :-1] + l2 * np.eye(width + 1), full[:, -1])
    return out


def routing_features(df: DataFrame, question: str = "question", reduced: str | None = "reduced") -> DataFrame:
    """Add ``features``: explicit and semantic text features in the router's scaling, and the reduced embedding.

    Training and serving both call this.  Missing text counts as empty, a missing embedding as zeros where its width is known.
    """
    with_text = df.withColumn("__text", F.coalesce(question, F.lit("")))
    with_text = with_text.withColumn("__low", F.lower("__text"))
    text, low = F.col("__text"), F.col("__low")
    e, m = tx.explicit_features(text, low), tx.semantic_features(text, low)
    counts = [e["len_chars"] / 1000.0, e["len_tokens"] / 500.0, e["n_sentences"] / 100.0, e["n_numbers"] / 100.0]
    flags = [e[k] for k in ("has_fraction", "has_percentage", "has_money", "has_comparison", "has_time")]
    kinds = [e["question_type"] == k for k in ("how_many", "how_much", "what_is")]
    numbers = [*counts, *flags, *kinds, m["token_cnt"], m["has_neg"], m["has_logic"], m["has_quant"]]
    out = F.array(*[x.cast("double") for x in numbers])
    if reduced:
        out = F.concat(out, F.transform(reduced, lambda v: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), v.cast("double"))) / 5.0))
    return with_text.withColumn("features", out).drop("__text", "__low")


@dataclass(frozen=True)
class LinearPolicy:
    """Predicted cost per action, linear in ``features``; the cheaper action wins, fast on a tie.

    ``always`` names the one action of a policy that was not good enough to be used.
    """

    weights: tuple[tuple[float, ...], tuple[float, ...]]
    always: int | None = None

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        def cost(w: Sequence[float]) -> Column:
            products = F.zip_with(F.col(features), F.array(*[F.lit(float(x)) for x in w[1:]]), lambda x, y: x * y)
            return F.aggregate(products, F.lit(float(w[0])), lambda a, x: a + x)

        out = df.withColumns({"fast_cost": cost(self.weights[0]), "slow_cost": cost(self.weights[1])})
        cheaper = F.when(F.col("fast_cost") <= F.col("slow_cost"), F.lit(fc.FAST)).otherwise(F.lit(fc.SLOW))
        action = cheaper if self.always is None else F.lit(self.always)
        return out.withColumn("scores", F.array("fast_cost", "slow_cost")).withColumn("policy_action", action)


def train_policy_on_features(logged: DataFrame, width: int, l2: float = 1.0) -> LinearPolicy:
    """Doubly robust warm start by normal equations: one pass sums the logged costs' moments, a second one those of the
    corrected costs of both actions on every row.  Only (width + 1) x (width + 2) numbers an action leave the tasks."""
    direct = fit_from_moments(policy_moments(logged), width, l2)
    blank = np.zeros(width + 1)
    first = LinearPolicy(tuple(tuple(map(float, direct.get(a, blank))) for a in (fc.FAST, fc.SLOW)))
    rows = first.predict(logged)
    both = F.array(*[
        F.struct(
            F.lit(a).alias("action"),
            (F.col(c) + F.when(F.col("logged_action") == a, (F.col("logged_cost") - F.col(c)) / F.col("propensity")).otherwise(F.lit(0.0))).alias("target"),
        ) for a, c in ((fc.FAST, "fast_cost"), (fc.SLOW, "slow_cost"))
    ])
    corrected = rows.select("features", F.inline(both)).select("features", F.col("action").alias("logged_action"), F.col("target").alias("logged_cost"))
    found = fit_from_moments(policy_moments(corrected), width, l2)
    return LinearPolicy(tuple(tuple(map(float, found.get(a, blank))) for a in (fc.FAST, fc.SLOW)))


def policy_gain_bound(logged: DataFrame, policy: LinearPolicy, baseline: int = fc.SLOW, z: float = 3.0) -> DataFrame:
    """How much a policy's loss lies above always taking ``baseline``, on logged rows it was not trained on.

    Doubly robust per row, with its mean, standard error and ``z`` standard errors to either side.
    """
    rows = policy.predict(logged)
    cost = lambda a: F.when(a == fc.FAST, F.col("fast_cost")).otherwise(F.col("slow_cost"))

    def robust(a: Column) -> Column:
        guess = cost(a)
        return guess + F.when(F.col("logged_action") == a, (F.col("logged_cost") - guess) / F.col("propensity")).otherwise(F.lit(0.0))

    gap = robust(F.col("policy_action")) - robust(F.lit(baseline))
    found = rows.select(gap.alias("gap")).agg(
        F.count("gap").alias("n"), F.avg("gap").alias("difference"), F.coalesce(F.stddev_samp("gap") / F.sqrt(F.count("gap")), F.lit(0.0)).alias("std_error")
    )
    d, e = F.col("difference"), F.col("std_error")
    return found.select("n", "difference", "std_error", (d - z * e).alias("lower"), (d + z * e).alias("upper"))


def safe_policy(policy: LinearPolicy, validation: DataFrame, baseline: int = fc.SLOW, z: float = 3.0) -> LinearPolicy:
    """The policy, or always ``baseline`` where the validation rows do not show that it loses less."""
    bound = policy_gain_bound(validation, policy, baseline, z).first()
    better = bound["n"] > 0 and bound["upper"] < 0
    return policy if better else LinearPolicy(policy.weights, always=baseline)


def solve_problems(problems: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a user's solver over pending problems and grade it; the solver adds ``final_answer``."""
    from ..functions.text import grade

    return predict(problems).withColumn("correct", grade(F.col("final_answer"), F.col("ground_truth")))
