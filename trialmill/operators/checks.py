"""Record validation, answer range checks and template conditions."""

from __future__ import annotations

import ast
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ANSWER = 1_000_000


def record_errors() -> Column:
    """Names of the rules a dataset record breaks."""

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    value = F.col("final_answer").try_cast("double")
    return F.array_compact(
        F.array(
            *[F.when(blank(c), f"missing_{c}") for c in ("id", "question", "answer", "template_id")],
            F.when(~F.contains(F.coalesce(F.col("answer"), F.lit("")), F.lit("####")), "missing_marker"),
            F.when(value < 0, "negative_answer"),
        )
    )


def validate_records(records: DataFrame) -> DataFrame:
    return records.withColumn("errors", record_errors())


def validation_report(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A one-row count report and the offending records; the second can be as large as the input."""
    checked = validate_records(records)
    bad = F.size("errors") > 0
    report = checked.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~bad).alias("valid_records"),
        F.count_if(bad).alias("invalid_records"),
    )
    return report, checked.filter(bad).select("id", "errors")


def noop_invariant(base: DataFrame, noop: DataFrame) -> DataFrame:
    """Whether each distractor variant keeps the answer of its base problem."""
    b = base.select("template_id", "instance", F.col("final_answer").alias("base_answer"))
    n = noop.select("template_id", "instance", F.col("final_answer").alias("noop_answer"))
    return b.join(n, ["template_id", "instance"]).withColumn("holds", F.expr("base_answer <=> noop_answer"))


def remaining(problems: DataFrame, results: DataFrame, checkpoint_ids: DataFrame | None = None) -> DataFrame:
    """Problems with neither a result nor a checkpoint entry."""
    done = results.select("problem_id")
    if checkpoint_ids is not None:
        done = done.union(checkpoint_ids.select("problem_id"))
    return problems.join(done.distinct(), "problem_id", "left_anti")


def valid_answer(answer: Column) -> Column:
    """0 to one million; text that is no number passes, null does not."""
    value = answer.try_cast("double")
    return answer.isNotNull() & F.coalesce(value.between(0, MAX_ANSWER), F.lit(True))


def select_variant(trials: DataFrame, variant: str | None = None) -> DataFrame:
    return trials if variant is None else trials.filter(F.col("variant") == variant)


# --- template expressions -----------------------------------------------------


def _floor_mod(a: Column, b: Column) -> Column:
    return a - F.floor(F.try_divide(a, b)) * b


def _is_int(x: Column) -> Column:
    return x == F.floor(x)


def _strict(fn):
    """least and greatest skip nulls; a failed operand has to fail the whole call."""

    def call(*args: Column) -> Column:
        missing = reduce(lambda a, b: a | b, [a.isNull() for a in args])
        return F.when(~missing, fn(*args))

    return call


_CALLS = {
    "is_int": _is_int,
    "divides": lambda a, b: F.coalesce(_floor_mod(b, a) == 0, F.lit(False)),
    "int": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
    "float": lambda x: x.cast("double"),
    "abs": F.abs,
    "min": _strict(F.least),
    "max": _strict(F.greatest),
    "round": lambda x, n=None: F.bround(x, 0 if n is None else n),
}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    ast.Mod: _floor_mod,
    ast.Pow: F.pow,
}
_COMPARISONS = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def _and(a: Column, b: Column) -> Column:
    return F.when(~a, F.lit(False)).when(a, b)


def _or(a: Column, b: Column) -> Column:
    return F.when(a, F.lit(True)).when(~a, b)


def template_expression(text: str, variables: Mapping[str, Column]) -> Column:
    """A template condition or formula over numeric variables as one native column.

    Only the listed operators and helpers are accepted; an operation that has no
    value (division by zero) makes the whole expression null.
    """

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float)):
            return F.lit(node.value if isinstance(node.value, bool) else float(node.value))
        if isinstance(node, ast.Name) and node.id in variables:
            return variables[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~build(node.operand)
        if isinstance(node, ast.BoolOp):
            return reduce(_and if isinstance(node.op, ast.And) else _or, [build(v) for v in node.values])
        if isinstance(node, ast.Compare) and all(type(o) in _COMPARISONS for o in node.ops):
            sides = [build(n) for n in [node.left, *node.comparators]]
            parts = [_COMPARISONS[type(o)](a, b) for o, a, b in zip(node.ops, sides, sides[1:])]
            return reduce(_and, parts)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS:
            return _CALLS[node.func.id](*[build(a) for a in node.args])
        raise ValueError(f"not allowed in a template expression: {ast.unparse(node)!r}")

    return build(ast.parse(text.strip(), mode="eval").body)


def template_condition(text: str, variables: Mapping[str, Column]) -> Column:
    """A condition that is false wherever it cannot be evaluated."""
    return F.coalesce(template_expression(text, variables), F.lit(False))
