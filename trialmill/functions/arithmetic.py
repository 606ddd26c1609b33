"""Whole-number arithmetic with floor division, fixed point and ratios, as column expressions.

Every function returns null where the operation has no value; ``calc`` also names the reason.
Products that leave the 64-bit range are null as well, never wrapped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100


def _long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def _safe(b: Column | int) -> Column:
    return F.nullif(_long(b), _long(0))


def floor_mod(a: Column, b: Column | int) -> Column:
    """Remainder with the sign of the divisor."""
    d = _safe(b)
    r = _long(a) % d
    return F.when((r != 0) & ((r < 0) != (d < 0)), r + d).otherwise(r)


def floor_div(a: Column, b: Column | int) -> Column:
    """Quotient rounded toward minus infinity."""
    n, d = _long(a), _safe(b)
    q = F.call_function("div", n, d)
    r = n % d
    return F.when((r != 0) & ((r < 0) != (d < 0)), q - 1).otherwise(q)


def add(a: Column, b: Column | int) -> Column:
    return F.try_add(_long(a), _long(b))


def sub(a: Column, b: Column | int) -> Column:
    return F.try_subtract(_long(a), _long(b))


def mul(a: Column, b: Column | int) -> Column:
    return F.try_multiply(_long(a), _long(b))


def power(base: Column, exponent: Column | int) -> Column:
    b, e = _long(base), _long(exponent)
    small = F.when((b == 0) & (e > 0), _long(0)).when((b == 1) | (e == 0), _long(1))
    small = small.when(b == -1, F.when(e % 2 == 0, _long(1)).otherwise(_long(-1)))
    # |base| >= 2 leaves the range before the 64th factor
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(e, _long(64))).cast("int"))
    product = F.aggregate(steps, _long(1), lambda acc, _: F.try_multiply(acc, b))
    return F.when(e < 0, F.lit(None).cast("bigint")).otherwise(F.coalesce(small, product))


def flag(condition: Column) -> Column:
    return condition.cast("bigint")


_BINARY = {
    "add": add,
    "sub": sub,
    "mul": mul,
    "div": floor_div,
    "mod": floor_mod,
    "gt": lambda a, b: flag(a > b),
    "lt": lambda a, b: flag(a < b),
    "gte": lambda a, b: flag(a >= b),
    "lte": lambda a, b: flag(a <= b),
    "eq": lambda a, b: flag(a == b),
    "neq": lambda a, b: flag(a != b),
    "max": lambda a, b: F.greatest(_long(a), _long(b)),
    "min": lambda a, b: F.least(_long(a), _long(b)),
    "pow": power,
    "abs": lambda a, b: F.abs(_long(a)),
    "neg": lambda a, b: -_long(a),
}


def calc(op: str, a: Column, b: Column) -> tuple[Column, Column]:
    """The value of an operation and the error that stands in for it, one of them null."""
    value = _BINARY[op](a, b)
    known = {"div": (b == 0, "error_div_zero"), "mod": (b == 0, "error_mod_zero"), "pow": (b < 0, "error_neg_exp")}
    error = F.when(value.isNull() & a.isNotNull() & b.isNotNull(), F.lit("error_overflow"))
    if op in known:
        test, name = known[op]
        error = F.when(test, F.lit(name)).otherwise(error)
    return value, error


def decimal_mul(a: Column, b: Column) -> Column:
    return floor_div(mul(a, b), SCALE)


def decimal_div(a: Column, b: Column) -> Column:
    return floor_div(mul(a, SCALE), b)


def to_decimal(whole: Column, frac: Column) -> Column:
    return add(mul(whole, SCALE), frac)


def decimal_whole(scaled: Column) -> Column:
    return floor_div(scaled, SCALE)


def decimal_frac(scaled: Column) -> Column:
    return F.abs(_long(scaled)) % SCALE


def percent_of(percent: Column, whole: Column) -> Column:
    return floor_div(mul(percent, whole), 100)


def as_percent(part: Column, whole: Column) -> Column:
    return floor_div(mul(part, 100), whole)


def ratio_scale(value: Column, num: Column, den: Column) -> Column:
    return floor_div(mul(value, num), den)


def convert(value: Column, factor: Column) -> Column:
    return mul(value, factor)


def convert_div(value: Column, factor: Column) -> Column:
    return floor_div(value, factor)
