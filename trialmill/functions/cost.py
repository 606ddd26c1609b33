"""Routing loss, regret, oracle action and token prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as lx

FAST, SLOW = 0, 1
ALPHA, BETA = 10.0, 1.0
FAST_COST, SLOW_COST = 0.1, 1.0


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def action_cost(action: Column) -> Column:
    return F.when(action == FAST, F.lit(FAST_COST)).otherwise(F.lit(SLOW_COST))


def loss(correct: Column, action: Column, alpha: Column | float = ALPHA, beta: Column | float = BETA) -> Column:
    wrong = F.when(correct, F.lit(0.0)).otherwise(_lit(alpha))
    return wrong + _lit(beta) * action_cost(action)


def reward(correct: Column, action: Column, alpha: Column | float = ALPHA, beta: Column | float = BETA) -> Column:
    return -loss(correct, action, alpha, beta)


def oracle_action(fast_correct: Column, slow_correct: Column) -> Column:
    """Slow only where it alone is right."""
    return F.when(slow_correct & ~fast_correct, F.lit(SLOW)).otherwise(F.lit(FAST))


def action_name(action: Column) -> Column:
    return F.when(action == FAST, "fast").when(action == SLOW, "slow")


def oracle_reason(fast_correct: Column, slow_correct: Column) -> Column:
    return (
        F.when(fast_correct & slow_correct, "both_correct")
        .when(slow_correct, "only_slow_correct")
        .when(fast_correct, "only_fast_correct")
        .otherwise("both_wrong")
    )


def chosen_correct(action: Column, fast_correct: Column, slow_correct: Column) -> Column:
    return F.when(action == FAST, fast_correct).otherwise(slow_correct)


def regret(
    action: Column,
    fast_correct: Column,
    slow_correct: Column,
    alpha: Column | float = ALPHA,
    beta: Column | float = BETA,
) -> Column:
    best = oracle_action(fast_correct, slow_correct)
    return loss(chosen_correct(action, fast_correct, slow_correct), action, alpha, beta) - loss(
        chosen_correct(best, fast_correct, slow_correct), best, alpha, beta
    )


def token_cost(tokens_input: Column, tokens_output: Column, model: Column, prices=None) -> Column:
    """Dollars for a token count; models without a price use the default one."""
    table = prices or lx.PRICES
    default = table.get(lx.DEFAULT_MODEL, lx.PRICES[lx.DEFAULT_MODEL])

    def rate(side: int) -> Column:
        known = F.create_map(*[x for m, p in table.items() for x in (F.lit(m), F.lit(float(p[side])))])
        return F.coalesce(F.try_element_at(known, model), F.lit(float(default[side])))

    return (tokens_input * rate(0) + tokens_output * rate(1)) / F.lit(1e6)


MODEL_OF_SYSTEM = {
    "baseline_large": "large",
    "baseline_small": "small",
    "fixed_slow": "large",
    "bandit": "large",
    "random": "large",
}


def model_of_system(system: Column, mapping: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (mapping or MODEL_OF_SYSTEM).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), system)
