"""Ordered running totals that never place one group in one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole group to a single
task.  Here the rows, in the order of (keys, order), are cut into slices of about equal size.  The bounds come
from a bottom-k sample by hash, which merges task by task and has a fixed size.  Rows are exchanged once, by
(slice, keys), and scanned slice by slice; what earlier slices hold is added from a table that has at most two rows a slice,
as only groups that a bound cuts lie in several.  Nothing is written in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLICE = "__slice"
#: Slices for each shuffle partition, and rows of the sample for each slice.
SLICES_PER_PARTITION = 2
SAMPLE_PER_SLICE = 64


def _comparable(df: DataFrame, name: str) -> Column:
    """A column in a form whose values keep their order when they pass through the driver."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    return col.cast("string") if isinstance(kind, T.TimestampNTZType) else col


def _after(cols: list[Column], bound: Sequence) -> Column:
    """Whether a row comes after a bound in ascending order, nulls first."""
    out = F.lit(False)
    for col, value in reversed(list(zip(cols, bound))):
        if value is None:
            out = F.when(col.isNotNull(), F.lit(True)).otherwise(out)
        else:
            v = F.lit(value)
            out = F.when(col.isNull(), F.lit(False)).when(col > v, F.lit(True)).when(col == v, out).otherwise(F.lit(False))
    return out


def _bounds(df: DataFrame, names: list[str], slices: int) -> list[tuple]:
    """Rows that cut the sorted rows into slices; each slice ends with its bound."""
    cols = [_comparable(df, n).alias(f"c{i}") for i, n in enumerate(names)]
    sample = df.select(*cols).orderBy(F.xxhash64(*[f"c{i}" for i in range(len(names))])).limit(slices * SAMPLE_PER_SLICE)
    rows = sample.orderBy(*[f"c{i}" for i in range(len(names))]).collect()
    step = max(1, len(rows) // slices)
    found: list[tuple] = []
    for row in rows[step - 1 : len(rows) - 1 : step]:
        if not found or tuple(row) != found[-1]:
            found.append(tuple(row))
    return found


def _slice_of(cols: list[Column], bounds: list[tuple]) -> Column:
    """The number of bounds that a row comes after, by halving."""

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(_after(cols, bounds[middle]), within(middle + 1, hi)).otherwise(within(lo, middle))

    return within(0, len(bounds))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    rank: str | None = None,
    sums: dict[str, str] | None = None,
    best_before: dict[str, str] | None = None,
    total: str | None = None,
    upto: int | None = None,
) -> DataFrame:
    """Add a 1-based rank, inclusive running sums, exclusive running maxima and the row count of each group.

    ``sums`` and ``best_before`` map a new column to the source column.  ``order`` holds columns
    or expressions, ascending with nulls first, and must be a total order within a group for the result to be
    unique.  With ``upto``, which goes without keys, only the first rows come back, and slices beyond them are not exchanged.
    Keys and order must be repeatable, as they are read for the bounds, the totals and the rows.
    """
    sums, best_before, keys = sums or {}, best_before or {}, list(keys)
    if upto is not None and keys:
        raise ValueError("upto goes without keys")
    columns = df.columns
    named = [o if isinstance(o, str) else f"__order{i}" for i, o in enumerate(order)]
    df = df.withColumns({n: o for n, o in zip(named, order) if not isinstance(o, str)}) if any(n not in columns for n in named) else df
    names = [*keys, *[n for n in named if n not in keys]]
    slices = SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df, names, slices)
    cut = [_comparable(df, n) for n in names]
    sliced = df.withColumn(_SLICE, _slice_of(cut, bounds))

    local = Window.partitionBy(_SLICE, *keys).orderBy(*[F.col(n).asc_nulls_first() for n in named])
    upto_here = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)

    # a group lies in several slices only if a bound belongs to it
    shared = sliced
    if keys and bounds:
        places = [f"__key{i}" for i in range(len(keys))]
        kinds = df.select(*[_comparable(df, k).alias(p) for k, p in zip(keys, places)]).schema
        cut_groups = df.sparkSession.createDataFrame(sorted({b[: len(keys)] for b in bounds}, key=str), T.StructType([T.StructField(f.name, f.dataType) for f in kinds]))
        same = F.lit(True)
        for k, p in zip(keys, places):
            same = same & _comparable(df, k).eqNullSafe(F.col(p))
        shared = sliced.join(F.broadcast(cut_groups), same, "left_semi")
    per_slice = shared.groupBy(_SLICE, *keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(s).alias(f"__sum_{n}") for n, s in sums.items()],
        *[F.max(s).alias(f"__max_{n}") for n, s in best_before.items()],
    )
    if keys and not bounds:
        per_slice = per_slice.limit(0)
    # at most two rows a slice
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        F.col(_SLICE).alias("__off_slice"),
        *[F.col(k).alias(f"__off_key_{k}") for k in keys],
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off_n"),
        *([F.sum("__n").over(Window.partitionBy(*keys)).alias("__off_total")] if total else []),
        *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__off_{n}") for n in sums],
        *[F.max(f"__max_{n}").over(earlier).alias(f"__off_{n}") for n in best_before],
    )
    if upto is not None:
        full = [r[0] for r in offsets.filter(F.col("__off_n") >= upto).select("__off_slice").collect()]
        sliced = sliced.filter(F.col(_SLICE) < min(full)) if full else sliced

    out = sliced.withColumn("__local_rank", F.row_number().over(local).cast("long"))
    if total:
        out = out.withColumn("__local_n", F.count(F.lit(1)).over(Window.partitionBy(_SLICE, *keys)))
    for name, source in sums.items():
        out = out.withColumn(name, F.sum(source).over(upto_here))
    for name, source in best_before.items():
        out = out.withColumn(name, F.max(source).over(before))
    # null-safe: a null key is a group like any other
    same = F.col(_SLICE) == F.col("__off_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__off_key_{k}"))
    out = out.join(F.broadcast(offsets), same, "left")
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.coalesce(F.col(f"__off_{name}"), F.lit(0)))
    for name in best_before:
        out = out.withColumn(name, F.greatest(F.col(name), F.col(f"__off_{name}")))
    if rank:
        out = out.withColumn(rank, F.col("__local_rank") + F.coalesce("__off_n", F.lit(0)))
    if total:
        out = out.withColumn(total, F.coalesce("__off_total", "__local_n"))
    if upto is not None:
        out = out.filter(F.col("__local_rank") + F.coalesce("__off_n", F.lit(0)) <= upto)
    return out.select(*columns, *([rank] if rank else []), *sums, *best_before, *([total] if total else []))
