"""Deductive ledger rules as joins and aggregates over fact tables.

Every fact table carries ``problem_id`` and is a set, so rules end in ``distinct``.
A problem with more than one step is left to the timeline rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import arithmetic as ar
from ..session import cut_lineage

QUANTITY = ["problem_id", "entity", "item", "val"]
# fixed values: attributes that cannot be negative
PHYSICAL_ATTRIBUTES = [
    "count", "quantity", "amount", "items", "apples", "oranges", "dollars", "cents", "people", "distance", "weight",
]


def _static(facts: DataFrame, max_steps: DataFrame | None) -> DataFrame:
    if max_steps is None:
        return facts
    return facts.join(max_steps.filter("max_step > 0").select("problem_id").distinct(), "problem_id", "left_anti")


def entities(quantities: DataFrame, typed: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    parts = [t.select("problem_id", "entity") for t in (typed, quantities, attributes) if t is not None]
    return reduce(DataFrame.union, parts).distinct()


def items(quantities: DataFrame) -> DataFrame:
    return quantities.select("problem_id", "item").distinct()


def default_unit(plain: DataFrame, explicit: DataFrame) -> DataFrame:
    """Quantities with units: plain ones count in ``units`` unless the (entity, item) has another unit."""
    named = explicit.filter(F.col("unit") != "units").select("problem_id", "entity", "item").distinct()
    filled = plain.join(named, ["problem_id", "entity", "item"], "left_anti").withColumn("unit", F.lit("units"))
    return explicit.select(*QUANTITY, "unit").union(filled.select(*QUANTITY, "unit")).distinct()


def apply_transfer(transfers: DataFrame, given: DataFrame, max_steps: DataFrame | None = None) -> DataFrame:
    """Giver's and receiver's quantity after each transfer, each from the initial value."""
    moves = _static(transfers.select("problem_id", "src", "dst", "item", "amount").distinct(), max_steps)
    legs = moves.select(
        "problem_id",
        "item",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("entity"), (-F.col("amount")).alias("delta")),
                F.struct(F.col("dst").alias("entity"), F.col("amount").alias("delta")),
            )
        ).alias("leg"),
    ).select("problem_id", "item", "leg.entity", "leg.delta")
    return _shifted(legs.distinct(), given)


def _shifted(deltas: DataFrame, given: DataFrame) -> DataFrame:
    return (
        deltas.join(given.select(*QUANTITY), ["problem_id", "entity", "item"])
        .select("problem_id", "entity", "item", ar.add(F.col("val"), F.col("delta")).alias("val"))
        .distinct()
    )


def apply_consume(consumed: DataFrame, given: DataFrame, max_steps: DataFrame | None = None) -> DataFrame:
    deltas = consumed.select("problem_id", "entity", "item", (-F.col("amount")).alias("delta")).distinct()
    return _shifted(_static(deltas, max_steps), given)


def apply_produce(produced: DataFrame, given: DataFrame, max_steps: DataFrame | None = None) -> DataFrame:
    """Quantity after production; without an initial quantity the produced amount itself."""
    deltas = _static(
        produced.select("problem_id", "entity", "item", F.col("amount").alias("delta")).distinct(), max_steps
    )
    keys = ["problem_id", "entity", "item"]
    fresh = deltas.join(given.select(*keys).distinct(), keys, "left_anti")
    return _shifted(deltas, given).union(fresh.select(*keys, F.col("delta").alias("val"))).distinct()


def combine_pair(combines: DataFrame, quantities: DataFrame) -> DataFrame:
    q = quantities.select(*QUANTITY).distinct()
    first = q.select("problem_id", F.col("entity").alias("first"), "item", F.col("val").alias("v1"))
    second = q.select("problem_id", F.col("entity").alias("second"), "item", F.col("val").alias("v2"))
    return (
        combines.join(first, ["problem_id", "first", "item"])
        .join(second, ["problem_id", "second", "item"])
        .select("problem_id", "target", ar.add(F.col("v1"), F.col("v2")).alias("val"))
        .distinct()
    )


def combine_group(combines: DataFrame, members: DataFrame, quantities: DataFrame) -> DataFrame:
    """Sum over the distinct (value, entity) pairs of a group; an empty group sums to zero."""
    q = quantities.select(*QUANTITY).distinct()
    asked = combines.select("problem_id", "target", "grp", "item").distinct()
    needed = asked.select("problem_id", "grp", "item").distinct()
    sums = (
        needed.join(members.select("problem_id", "grp", "entity").distinct(), ["problem_id", "grp"])
        .join(q, ["problem_id", "entity", "item"])
        .groupBy("problem_id", "grp", "item")
        .agg(F.sum("val").alias("val"))
    )
    return (
        asked.join(sums, ["problem_id", "grp", "item"], "left")
        .select("problem_id", "target", F.coalesce("val", F.lit(0)).alias("val"))
        .distinct()
    )


def partition_equal(partitions: DataFrame, quantities: DataFrame) -> DataFrame:
    q = quantities.select("problem_id", F.col("entity").alias("source"), "item", "val")
    return (
        partitions.filter("parts > 0")
        .join(q, ["problem_id", "source", "item"])
        .select("problem_id", "target", ar.floor_div(F.col("val"), F.col("parts")).alias("val"))
        .distinct()
    )


def partition_ratio(partitions: DataFrame, quantities: DataFrame) -> DataFrame:
    q = quantities.select("problem_id", F.col("entity").alias("source"), "item", "val")
    share = ar.ratio_scale(F.col("val"), F.col("my_part"), F.col("total_parts"))
    return (
        partitions.filter("total_parts > 0")
        .join(q, ["problem_id", "source", "item"])
        .select("problem_id", "target", share.alias("val"))
        .distinct()
    )


def rate_totals(rates: DataFrame, durations: DataFrame, quantities: DataFrame) -> DataFrame:
    """Distance of a speed, cost of a price and total of any rate over a duration."""
    r = rates.select("problem_id", F.col("subject"), F.col("kind").alias("name"), "rate").distinct()
    timed = r.join(
        durations.select("problem_id", F.col("entity").alias("subject"), "duration").distinct(),
        ["problem_id", "subject"],
    ).select("problem_id", F.col("subject").alias("entity"), "name", ar.mul(F.col("rate"), F.col("duration")).alias("val"))
    distance = timed.filter(F.col("name") == "speed").select(
        "problem_id", F.lit("distance").alias("kind"), "entity", "name", "val"
    )
    total = timed.select("problem_id", F.lit("total").alias("kind"), "entity", "name", "val")
    priced = (
        r.filter(F.col("name") == "price")
        .select("problem_id", F.col("subject").alias("item"), "rate")
        .join(quantities.select(*QUANTITY).distinct(), ["problem_id", "item"])
        .select(
            "problem_id",
            F.lit("cost").alias("kind"),
            "entity",
            F.col("item").alias("name"),
            ar.mul(F.col("rate"), F.col("val")).alias("val"),
        )
    )
    return distance.union(total).union(priced).distinct()


#: Factors are held at this magnitude; from there on only the value zero has a product in 64 bits.
_FACTOR_LIMIT = 2**63 + 1
#: Relations followed one by one before chains of multiples are jumped along.
_SINGLE_ROUNDS = 8
#: Single links that are left to the jumps; longer chains are contracted first.
_CORE_LINKS = 20_000


def derive_relations(relations: DataFrame, values: DataFrame) -> DataFrame:
    """Values reachable through multiple/percent relations, to the fixpoint.

    Entities that one multiple alone gives a value are contracted first, round by round, and get their values last
    (``_contract``); what is moved for that follows the number of relations, however long the chains are.
    In what is left the first rounds follow one relation each.  What is still new then lies on long chains: factors of
    chains of 1, 2, 4, ... multiples are composed, and after k such rounds every value within 2^k multiples is known.
    A percentage rounds down at every relation and ends such a jump.
    Each round looks for values that are not known yet, with one anti join, and ends in a written table.

    A value that leaves 64 bits stops the job.  A chain without a cycle visits an entity once, so values that
    are new beyond as many relations as a problem has entities prove a cycle, which stops the job too.
    """
    key = ["problem_id", "entity", "val"]
    rel = cut_lineage(
        relations.select("problem_id", "kind", "entity", F.col("other").alias("__from"), "amount")
        .filter(F.col("kind").isin("multiple", "percent") & F.col("amount").isNotNull())
        .withColumn("amount", F.col("amount").cast("decimal(38,0)"))
        .withColumnRenamed("amount", "__factor")
    )
    given = cut_lineage(values.select(*key).distinct())
    nodes = cut_lineage(_nodes(rel, given))
    longest = nodes.groupBy("problem_id").count().agg(F.max("count")).first()[0] or 0
    rel, levels = _contract(rel, nodes)
    multiplied = (F.col("val").cast("decimal(38,0)") * F.col("__factor")).try_cast("bigint")
    result = F.when(F.col("kind") == "multiple", multiplied).otherwise(ar.percent_of(F.col("__factor").try_cast("bigint"), F.col("val")))
    where = F.concat_ws(" of problem ", F.col("entity").cast("string"), F.col("problem_id").cast("string"))
    found = [given]

    def named(step: DataFrame, value: Column) -> DataFrame:
        wrong = F.raise_error(F.concat(F.lit("derived value leaves 64 bits: entity "), where))
        return step.select("problem_id", "entity", F.when(value.isNull(), wrong).otherwise(value).alias("val"))

    def new(step: DataFrame, value: Column) -> DataFrame:
        """Values of a step that no table holds yet, kept as one more table."""
        fresh = cut_lineage(named(step, value).distinct().join(reduce(DataFrame.union, found), key, "left_anti"))
        found.append(fresh)
        if len(found) > 8:
            found[:] = [cut_lineage(reduce(DataFrame.union, found))]
        return fresh

    def after(links: DataFrame, start: DataFrame) -> DataFrame:
        return links.join(start.filter("val is not null").select("problem_id", F.col("entity").alias("__from"), "val"), ["problem_id", "__from"])

    def passed(n: int) -> None:
        if n > longest:
            raise RuntimeError("relations keep deriving new values: they form a cycle")

    fresh, steps, single = given, 0, 0
    while not fresh.isEmpty():
        passed(steps)
        if single < _SINGLE_ROUNDS:
            fresh, steps, single = new(after(rel, fresh), result), steps + 1, single + 1
            continue
        # all that follows from the fresh values by multiples alone, then one percentage
        jumps = rel.filter("kind = 'multiple'").select("problem_id", "entity", "__from", "__factor")
        grown, reach = fresh, 1
        while True:
            more = new(after(jumps, grown), multiplied)
            if more.isEmpty():
                break
            passed(steps + reach)
            grown, reach = cut_lineage(grown.union(more)), 2 * reach
            jumps = _doubled(jumps)
        fresh, steps, single = new(after(rel.filter("kind = 'percent'"), grown), result), steps + 1, 0
    # only a factor of zero makes different values of an entity equal
    merging = bool(levels) and not nodes.filter("alone AND __factor = 0").isEmpty()
    for n, gone in reversed(list(enumerate(levels))):
        known = reduce(DataFrame.union, found).filter(~_heads(n, "entity"))
        step = named(after(gone, known), multiplied)
        found.append(cut_lineage(step.distinct() if merging else step))
    return reduce(DataFrame.union, found)


def _nodes(rel: DataFrame, given: DataFrame) -> DataFrame:
    """One row per entity; ``alone`` are those whose values all come by one multiple, with its source and factor."""
    links = rel.select("problem_id", "entity", "__from", "__factor", (F.col("kind") == "multiple").alias("__plain"))
    none = [F.lit(None).cast(rel.schema[c].dataType).alias(c) for c in ("__from", "__factor")]
    both = links.union(given.select("problem_id", "entity", *none, F.lit(False).alias("__plain")))
    ends = [f(c).alias(f"__{name}{c}") for c in ("__from", "__factor") for name, f in (("min", F.min), ("max", F.max))]
    seen = both.groupBy("problem_id", "entity").agg(F.bool_and("__plain").alias("__plain"), *ends)
    # coins are hashes of names, so all sides must name an entity by the same type
    kinds = [{d.schema[c].dataType for d, c in sides} for sides in (
        [(rel, "problem_id"), (given, "problem_id")], [(rel, "entity"), (rel, "__from"), (given, "entity")],
    )]
    hashed = all(len(k) == 1 and isinstance(next(iter(k)), (T.IntegralType, T.StringType)) for k in kinds)
    one = "__plain AND __min__from = __max__from AND __min__factor = __max__factor AND __min__from <> entity AND problem_id IS NOT NULL"
    alone = F.coalesce(F.expr(one), F.lit(False)) if hashed else F.lit(False)
    named = seen.withColumn("alone", alone)
    held = [F.when(F.col("alone"), F.col(f"__min{c}")).alias(c) for c in ("__from", "__factor")]
    return named.select("problem_id", "entity", *held, "alone")


def _heads(n: int, name: str) -> Column:
    """The coin of an entity in a round."""
    return F.xxhash64(F.lit(n), F.col("problem_id"), F.col(name)).bitwiseAND(F.lit(1)) == 1


def _contract(rel: DataFrame, nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(relations left, links taken out in each round).

    In a round every entity throws a coin.  Of those with a single link, the ones with heads whose source has tails are
    taken out, a quarter in the mean, and links from them are led on to their source.  So no two
    neighbours go at once, a source is still there when its values are asked for, and the tables of all rounds together
    are four times the first one.  Sources of other relations stay.
    """
    others = cut_lineage(nodes.filter("NOT alone").select(F.col("problem_id").alias("__p"), F.col("entity").alias("__e")))
    same = F.col("problem_id").eqNullSafe(F.col("__p")) & F.col("entity").eqNullSafe(F.col("__e"))
    rest = cut_lineage(rel.join(others, same, "left_semi").distinct())
    links = nodes.filter("alone").drop("alone")
    if rest.isEmpty():
        links = links.withColumn("__stays", F.lit(False))
    else:
        read = rest.select("problem_id", F.col("__from").alias("entity"), F.lit(True).alias("__stays")).distinct()
        links = cut_lineage(links.join(read, ["problem_id", "entity"], "left").fillna(False, "__stays"))
    levels: list[DataFrame] = []
    while links.filter("NOT __stays").count() > _CORE_LINKS:
        n = len(levels)
        moves, out = _heads(n, "__from"), _heads(n, "entity") & ~F.col("__stays")
        gone = links.filter(~moves & out)
        over = gone.select("problem_id", F.col("entity").alias("__from"), F.col("__from").alias("__next"), F.col("__factor").alias("__more"))
        led = links.filter(moves).join(over, ["problem_id", "__from"], "left")
        factor = F.when(F.col("__more").isNull(), F.col("__factor")).otherwise(_held(F.col("__factor") * F.col("__more")))
        led = led.select("problem_id", "entity", F.coalesce("__next", "__from").alias("__from"), factor.alias("__factor"), "__stays")
        # a ring of single links has no value to start from
        links = cut_lineage(links.filter(~moves & ~out).union(led.filter("entity <> __from")))
        levels.append(gone)
    left = links.select("problem_id", F.lit("multiple").alias("kind"), "entity", "__from", "__factor")
    return left.union(rest.select(*left.columns)), levels


def _held(product: Column) -> Column:
    limit = F.lit(str(_FACTOR_LIMIT)).cast("decimal(38,0)")
    return F.greatest(-limit, F.least(limit, product)).cast("decimal(38,0)")


def _doubled(jumps: DataFrame) -> DataFrame:
    """Jumps of twice the length: factors multiplied, those beyond 64 bits held at the limit."""
    second = jumps.select("problem_id", F.col("__from").alias("__middle"), "entity", F.col("__factor").alias("__more"))
    first = jumps.withColumnRenamed("entity", "__middle")
    factor = _held(F.col("__factor") * F.col("__more")).alias("__factor")
    return cut_lineage(first.join(second, ["problem_id", "__middle"]).select("problem_id", "entity", "__from", factor).distinct())


def total_quantity(quantities: DataFrame) -> DataFrame:
    """Per item, the sum over distinct (value, entity) pairs."""
    q = quantities.select(*QUANTITY).distinct()
    return q.groupBy("problem_id", "item").agg(F.sum("val").alias("total"))


def counts(quantities: DataFrame) -> DataFrame:
    return quantities.groupBy("problem_id").agg(
        F.count_distinct("entity").alias("entity_count"), F.count_distinct("item").alias("item_count")
    )


def has_item(quantities: DataFrame) -> DataFrame:
    return quantities.filter("val > 0").select("problem_id", "entity", "item").distinct()


def negative_quantities(quantities: DataFrame, abstract_items: DataFrame | None = None) -> DataFrame:
    """Quantities below zero of items that are not abstract."""
    low = quantities.select(*QUANTITY).filter("val < 0")
    if abstract_items is not None:
        low = low.join(abstract_items.select("problem_id", "item").distinct(), ["problem_id", "item"], "left_anti")
    return low.select(*QUANTITY).distinct()


def solutions(
    targets: DataFrame,
    values: DataFrame | None = None,
    final_answers: DataFrame | None = None,
    quantities: DataFrame | None = None,
    finals: DataFrame | None = None,
) -> DataFrame:
    """Solutions a problem derives from its target (kind value, qty or final; names a and b) or final answer."""
    parts = []
    if values is not None:
        v = values.select("problem_id", F.col("entity").alias("a"), "val")
        parts.append(targets.filter("kind = 'value'").join(v, ["problem_id", "a"]))
    if quantities is not None:
        q = quantities.select("problem_id", F.col("entity").alias("a"), F.col("item").alias("b"), "val")
        parts.append(targets.filter("kind = 'qty'").join(q, ["problem_id", "a", "b"]))
    if finals is not None:
        f = finals.select("problem_id", F.col("entity").alias("a"), F.col("attr").alias("b"), "val")
        parts.append(targets.filter("kind = 'final'").join(f, ["problem_id", "a", "b"]))
    if final_answers is not None:
        parts.append(final_answers)
    rows = [p.select("problem_id", F.col("val").alias("solution")) for p in parts]
    return reduce(DataFrame.union, rows).distinct()


# --- timelines -----------------------------------------------------------------------

CHAIN = ["problem_id", "entity", "attr"]
# steps folded in one row, and maps composed in one row
BLOCK = 256


def step_table(max_steps: DataFrame) -> DataFrame:
    """Steps 0..max_step per problem with their neighbours and how many steps lie before and after.

    ``t1`` is before ``t2`` exactly when ``t1 < t2``, so the order needs no table of pairs.
    """
    m = F.col("max_step")
    return max_steps.select("problem_id", "max_step", F.explode(F.sequence(F.lit(0), m.cast("int"))).alias("step")).select(
        "problem_id",
        "step",
        F.when(F.col("step") > 0, F.col("step") - 1).alias("previous"),
        F.when(F.col("step") < m, F.col("step") + 1).alias("next"),
        F.col("step").alias("n_before"),
        (m - F.col("step")).cast("int").alias("n_after"),
        (F.col("step") == 0).alias("is_first"),
        (F.col("step") == m).alias("is_last"),
    )


def _effects(ops: DataFrame, transfers: DataFrame | None) -> DataFrame:
    """Operations and both legs of transfers as (kind, amount) effects on a chain."""
    signed = F.when(F.col("op") == "sub_from", -F.col("amount")).otherwise(F.col("amount"))
    kind = F.when(F.col("op").isin("add_to", "sub_from"), "add").otherwise(F.col("op"))
    out = ops.select(*CHAIN, F.col("step").cast("bigint"), kind.alias("kind"), signed.cast("bigint").alias("amount"))
    if transfers is not None:
        t = transfers.withColumn("step", F.col("step").cast("bigint"))
        legs = [
            t.select("problem_id", F.col(side).alias("entity"), F.col("item").alias("attr"), "step",
                     F.lit("add").alias("kind"), (sign * F.col("amount")).cast("bigint").alias("amount"))
            for side, sign in (("src", -1), ("dst", 1))
        ]
        out = out.union(legs[0]).union(legs[1])
    return out


def _step_extremes(effects: DataFrame) -> DataFrame:
    """All effects on one chain and step, reduced to their extremes.

    Every effect is monotone in its amount (divisors of one sign at a time), so the
    results agree for all amounts exactly when they agree for the smallest and the
    largest: the reduction is exact, has a fixed size and combines before the shuffle.
    """
    kind, a = F.col("kind"), F.col("amount")
    picks = {
        "add": kind == "add",
        "mul": kind == "mul_by",
        "pos": (kind == "div_by") & (a > 0),
        "neg": (kind == "div_by") & (a < 0),
        "put": kind == "set_to",
    }
    aggs = []
    for name, test in picks.items():
        aggs += [F.min(F.when(test, a)).alias(f"{name}_lo"), F.max(F.when(test, a)).alias(f"{name}_hi")]
    return effects.groupBy(*CHAIN, "step").agg(
        *aggs,
        F.max((kind == "div_by") & (a == 0)).alias("div_zero"),
        F.max(kind != "set_to").alias("needs_prior"),
    )


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _advance(state: Column, s: Column, persistent: Column) -> Column:
    """State of a chain after the effects of one step."""
    ready = state["has"] & ((state["at"] == s["step"]) | persistent)

    def with_prior(p: Column) -> Column:
        prior, avail = p["val"], p["avail"]
        results = F.array_distinct(
            F.array_compact(
                F.array(
                    ar.add(prior, s["add_lo"]),
                    ar.add(prior, s["add_hi"]),
                    ar.mul(prior, s["mul_lo"]),
                    ar.mul(prior, s["mul_hi"]),
                    ar.floor_div(prior, s["pos_lo"]),
                    ar.floor_div(prior, s["pos_hi"]),
                    ar.floor_div(prior, s["neg_lo"]),
                    ar.floor_div(prior, s["neg_hi"]),
                    s["put_lo"],
                    s["put_hi"],
                )
            )
        )

        def close(r: Column) -> Column:
            conflict = F.size(r) > 1
            applied = (avail & s["needs_prior"]) | s["put_lo"].isNotNull()
            segment = F.struct(
                state["at"].alias("lo"),
                F.when(persistent, F.greatest(s["step"], state["at"])).otherwise(state["at"]).alias("hi"),
                state["val"].alias("val"),
            )
            broken = F.array_compact(
                F.array(
                    F.when(
                        s["needs_prior"] & ~avail,
                        F.struct(F.lit("no_prior_state").alias("rule"), s["step"].alias("step")),
                    ),
                    F.when(conflict, F.struct(F.lit("two_values").alias("rule"), (s["step"] + 1).alias("step"))),
                    F.when(
                        avail & s["div_zero"], F.struct(F.lit("error_div_zero").alias("rule"), s["step"].alias("step"))
                    ),
                )
            )
            return F.struct(
                (s["step"] + 1).alias("at"),
                F.when(applied & ~conflict, F.get(r, 0)).alias("val"),
                applied.alias("has"),
                F.when(state["has"], F.array_append(state["out"], segment)).otherwise(state["out"]).alias("out"),
                F.concat(state["bad"], broken).alias("bad"),
            )

        return _let(results, close)

    prior = F.struct(F.when(ready, state["val"]).alias("val"), F.coalesce(ready, F.lit(False)).alias("avail"))
    return _let(prior, with_prior)


_SEGMENTS = "array<struct<lo:bigint,hi:bigint,val:bigint>>"
_BROKEN = "array<struct<rule:string,step:bigint>>"


def _chain_maps():
    """What stretches of a chain do to the state before them, as functions that compose.

    A stretch maps the state (has, val) at its first step to the state after its last one.  Three cases make up the map:
    no usable state (``u``), a state without a value (``n``), both constants, and a value x (``x``), a constant or a list of
    links.  A link is floor((a x + b) / d) with the interval of x on which no step on the way leaves 64 bits, or a step
    with several effects as it stands.  Sums, products and quotients melt into one link; a product after a quotient starts
    the next one, and a set_to makes everything before it constant.
    """
    # a closure travels to the workers by value, so they need pyarrow but not this package
    import json

    import pyarrow as pa

    low, high = -(2**63), 2**63 - 1
    lanes = ("add", "mul", "pos", "neg", "put")

    def apply(s, avail, val):
        """(has, val) after one step, the rule that ``_advance`` states in columns."""
        found = {v for v in (s["put_lo"], s["put_hi"]) if v is not None}
        if avail and val is not None:
            for lane in lanes[:4]:
                for v in (s[f"{lane}_lo"], s[f"{lane}_hi"]):
                    if v is not None:
                        r = val + v if lane == "add" else val * v if lane == "mul" else val // v
                        if low <= r <= high:
                            found.add(r)
        has = bool((avail and s["needs_prior"]) or s["put_lo"] is not None)
        return has, (found.pop() if has and len(found) == 1 else None)

    def inside(link, y_lo, y_hi):
        """The interval of x on which floor((a x + b) / d) lies between the bounds, cut with the link's own."""
        a, b, d, x_lo, x_hi = link
        lo, hi = d * y_lo - b, d * y_hi + d - 1 - b  # lo <= a x <= hi
        if a == 0:
            return (x_lo, x_hi) if lo <= 0 <= hi else (1, 0)
        if a < 0:
            lo, hi, a = -hi, -lo, -a
        return max(x_lo, -((-lo) // a)), min(x_hi, hi // a)

    def plain(a, b, d):
        """The link of a single sum, product or quotient: the result has to fit in 64 bits."""
        return [a, b, d, *inside([a, b, d, low, high], low, high)]

    def melted(first, link):
        """One link for two in a row, or None where a product follows a quotient."""
        (fa, fb, fd, _, _), (a, b, d, lo, hi) = first, link
        if fd == 1:
            out = [a * fa, a * fb + b, d]
        elif a == 1:  # floor((floor(p / fd) + b) / d) = floor((p + b fd) / (fd d))
            out = [fa, fb + b * fd, fd * d]
        elif a == 0:
            out = [0, b, d]
        else:
            return None
        lo, hi = inside(first, lo, hi)
        if lo > hi:
            return [0, 0, 1, 1, 0]
        # links are monotone: equal at both ends is equal everywhere, which keeps the numbers small
        ends = [(out[0] * x + out[1]) // out[2] for x in (lo, hi)]
        return [0, ends[0], 1, lo, hi] if ends[0] == ends[1] else [*out, lo, hi]

    def then(links, more):
        """The links of a stretch followed by those of the next one."""
        links = list(links)
        for link in more:
            both = melted(links[-1], link) if links and isinstance(links[-1], list) and isinstance(link, list) else None
            if both is None:
                links.append(link)
            else:
                links[-1] = both
        return links

    def value_of(links, x):
        for link in links:
            if isinstance(link, dict):
                x = apply(link, True, x)[1]
            elif x is not None:
                a, b, d, lo, hi = link
                x = (a * x + b) // d if lo <= x <= hi else None
        return x

    def run_step(summary, s, persistent):
        """The map of a stretch and one more step."""
        linked = summary is None or persistent or summary["end"] == s["step"]
        if summary is None:
            u, n, x = (False, None), (True, None), []
        else:
            u, n, x = summary["u"], summary["n"], summary["x"]
        out = {"first": s["step"] if summary is None else summary["first"], "end": s["step"] + 1}
        out["u"], out["n"] = (apply(s, linked and c[0], c[1]) for c in (u, n))
        if isinstance(x, tuple):
            out["x"] = apply(s, linked and x[0], x[1])
        elif not linked:
            out["x"] = apply(s, False, None)
        else:
            effects = {(k, s[f"{k}_{e}"]) for k in lanes for e in ("lo", "hi") if s[f"{k}_{e}"] is not None}
            if all(k == "put" for k, _ in effects):  # also a division by zero, which has no value
                out["x"] = (True, effects.pop()[1] if len(effects) == 1 else None)
            elif len(effects) > 1:
                out["x"] = then(x, [s])
            else:
                ((k, v),) = effects
                if k == "neg":  # floor(y / v) = floor(-y / -v)
                    out["x"] = then(x, [plain(-1, 0, -v)])
                else:
                    out["x"] = then(x, [plain(*{"add": (1, v, 1), "mul": (v, 0, 1), "pos": (1, 0, v)}[k])])
        return out

    def follow(summary, has, at, val, persistent):
        """(has, val) after a stretch that starts from a state."""
        if not (has and (persistent or at == summary["first"])):
            return summary["u"]
        if val is None:
            return summary["n"]
        x = summary["x"]
        return x if isinstance(x, tuple) else (True, value_of(x, val))

    def join(a, b, persistent):
        """The map of two stretches in a row."""
        out = {"first": a["first"], "end": b["end"]}
        for lane in ("u", "n"):
            out[lane] = follow(b, a[lane][0], a["end"], a[lane][1], persistent)
        if isinstance(a["x"], tuple):
            out["x"] = follow(b, a["x"][0], a["end"], a["x"][1], persistent)
        elif not (persistent or a["end"] == b["first"]):
            out["x"] = b["u"]
        else:
            out["x"] = b["x"] if isinstance(b["x"], tuple) else then(a["x"], b["x"])
        return out

    def dumped(summary):
        return None if summary is None else json.dumps(summary)

    def loaded(text):
        summary = json.loads(text)
        for lane in ("u", "n", "x"):
            # a constant is [has, val]; a list of links starts with a list or a step
            if lane != "x" or (len(summary[lane]) == 2 and isinstance(summary[lane][0], bool)):
                summary[lane] = tuple(summary[lane])
        return summary

    def slices(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 32):
                yield b.slice(lo, 32)

    def summaries_of_steps(batches):
        for b in slices(batches):
            out = []
            for steps, persistent in zip(b.column("steps").to_pylist(), b.column("persistent").to_pylist()):
                summary = None
                for s in steps:
                    summary = run_step(summary, s, persistent)
                out.append(dumped(summary))
            kept = b.drop_columns(["steps"])
            yield kept.append_column("summary", pa.array(out, pa.string()))

    def summaries_of_blocks(batches):
        for b in slices(batches):
            out = []
            for parts, persistent in zip(b.column("parts").to_pylist(), b.column("persistent").to_pylist()):
                summary = None
                for part in parts:
                    step = loaded(part["summary"])
                    summary = step if summary is None else join(summary, step, persistent)
                out.append(dumped(summary))
            yield b.drop_columns(["parts"]).append_column("summary", pa.array(out, pa.string()))

    def starts_of_parts(schema):
        def run(batches):
            for b in slices(batches):
                rows = []
                for row in b.to_pylist():
                    at, has, val = row["at"], row["has"], row["val"]
                    keys = {k: v for k, v in row.items() if k in schema.names}
                    for part in row["parts"]:
                        rows.append(keys | {"__block": part["block"], "at": at, "has": has, "val": val})
                        if part["summary"] is not None:
                            summary = loaded(part["summary"])
                            (has, val), at = follow(summary, has, at, val, row["persistent"]), summary["end"]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return run

    return summaries_of_steps, summaries_of_blocks, starts_of_parts


def _block_starts(blocks: DataFrame, width: int, levels: int) -> DataFrame:
    """The state before every block of the chains that have several: (chain, block, at, has, val).

    Maps of blocks are composed level by level, ``width`` at a time, all blocks of a level in parallel; then
    the states go down the same levels.  A row holds at most ``width`` maps, however long its chain, and the
    number of levels is the logarithm of the longest chain.
    """
    of_steps, of_blocks, starts_of = _chain_maps()
    keys = [*CHAIN, "persistent", "given_at", "given_has", "given_val", "__last"]
    schema = blocks.select(*CHAIN, "__block").schema
    maps = blocks.filter("__block < __last").select(*keys, "__block", "steps").mapInArrow(
        of_steps, blocks.select(*keys, "__block").schema.add("summary", "string")
    )
    # the last block needs no map, but a start
    ends = blocks.filter("__block = __last").select(*keys, "__block", F.lit(None).cast("string").alias("summary"))
    level = cut_lineage(maps.unionByName(ends))
    stack = []
    for _ in range(levels - 1):
        grouped = cut_lineage(
            level.groupBy(*keys, F.floor(F.col("__block") / width).cast("int").alias("__up")).agg(
                F.array_sort(F.collect_list(F.struct(F.col("__block").alias("block"), "summary"))).alias("parts")
            )
        )
        stack.append(grouped)
        ready = F.forall("parts", lambda p: p["summary"].isNotNull())
        up = grouped.select(*keys, F.col("__up").alias("__block"), "parts")
        whole = up.filter(ready).mapInArrow(of_blocks, up.drop("parts").schema.add("summary", "string"))
        level = whole.unionByName(up.filter(~ready).select(*keys, "__block", F.lit(None).cast("string").alias("summary")))
    state = ["at", "has", "val"]
    kinds = T.StructType([*schema.fields, *[T.StructField(n, k) for n, k in (("at", T.LongType()), ("has", T.BooleanType()), ("val", T.LongType()))]])
    started = starts_of(to_arrow_schema(kinds))
    given = [F.col(f"given_{c}").alias(c) for c in state]
    top = level.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__block").alias("block"), "summary"))).alias("parts"))
    starts = top.select(*CHAIN, "persistent", *given, "parts").mapInArrow(started, kinds)
    for grouped in reversed(stack):
        below = grouped.select(*CHAIN, "persistent", F.col("__up").alias("__block"), "parts").join(cut_lineage(starts), [*CHAIN, "__block"])
        starts = below.drop("__block").mapInArrow(started, kinds)
    return starts


def fold_timeline(
    initial: DataFrame, ops: DataFrame, max_steps: DataFrame, transfers: DataFrame | None = None, width: int | None = None
) -> DataFrame:
    """Run every (entity, attribute) chain through its steps.

    Rows of (chain, max_step, segments, broken): the state segments (first step, last step, value) and the rules
    broken in a block of ``width`` (``BLOCK``) steps.  ``initial`` holds (problem_id, entity, attr, val) at step 0.  Blocks of one chain
    are folded side by side: the state before each comes from composed maps, so the number of
    jobs follows the logarithm of the longest chain and no row holds more than ``width`` steps.
    """
    width = width or BLOCK
    effects = _effects(ops, transfers)
    horizon = max_steps.groupBy("problem_id").agg(F.max("max_step").cast("bigint").alias("max_step"))
    steps = _step_extremes(effects).join(horizon, "problem_id").filter("step between 0 and max_step")
    fields = [c for c in steps.columns if c not in (*CHAIN, "max_step")]
    blocks = (
        steps.withColumn("__block", F.floor(F.col("step") / width).cast("int"))
        .groupBy(*CHAIN, "__block")
        .agg(F.array_sort(F.collect_list(F.struct("step", *[f for f in fields if f != "step"]))).alias("steps"))
    )
    first = initial.groupBy(*CHAIN).agg(F.min("val").cast("bigint").alias("lo"), F.max("val").cast("bigint").alias("hi"))
    seeded = first.select(
        *CHAIN, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("val"), F.lit(True).alias("given"), (F.col("lo") != F.col("hi")).alias("split")
    )
    blocks = cut_lineage(blocks)
    last = blocks.groupBy(*CHAIN).agg(F.max("__block").alias("__last"))
    given, split = F.coalesce("given", F.lit(False)), F.coalesce("split", F.lit(False))
    chains = cut_lineage(
        seeded.join(effects.select(*CHAIN).distinct(), CHAIN, "full_outer").join(horizon, "problem_id", "left").join(last, CHAIN, "left").select(
            *CHAIN,
            F.coalesce("max_step", F.lit(0).cast("bigint")).alias("max_step"),
            (given & (F.coalesce("max_step", F.lit(0)) > 0)).alias("persistent"),
            F.lit(0).cast("bigint").alias("given_at"), given.alias("given_has"), F.col("val").alias("given_val"),
            split.alias("split"), "__last",
        )
    )
    work = blocks.join(chains.filter("__last is not null"), CHAIN)
    deepest = last.agg(F.max("__last")).first()[0] or 0
    state = ["at", "has", "val"]
    if deepest:
        levels, size = 1, width
        while size <= deepest:
            levels, size = levels + 1, size * width
        starts = _block_starts(work.filter("__last > 0"), width, levels)
        work = work.join(starts, [*CHAIN, "__block"], "left")
        before = {c: F.when(F.col("at").isNotNull(), F.col(c)).otherwise(F.col(f"given_{c}")) for c in state}
    else:
        before = {c: F.col(f"given_{c}") for c in state}
    none = [F.array().cast(_SEGMENTS).alias("out"), F.array().cast(_BROKEN).alias("bad")]
    opened = work.withColumn("state", F.struct(*[before[c].alias(c) for c in ("at", "val", "has")], *none))
    ran = opened.withColumn("state", F.aggregate("steps", F.col("state"), lambda acc, s: _advance(acc, s, F.col("persistent"))))

    def tail(at: Column, val: Column) -> Column:
        end = F.when(F.col("persistent"), F.greatest("max_step", at)).otherwise(at)
        return F.struct(at.alias("lo"), end.alias("hi"), val.alias("val"))

    closes = (F.col("__block") == F.col("__last")) & F.col("state.has")
    segments = F.when(closes, F.array_append("state.out", tail(F.col("state.at"), F.col("state.val")))).otherwise(F.col("state.out"))
    folded = ran.select(*CHAIN, "max_step", segments.alias("segments"), F.col("state.bad").alias("broken"))
    # what holds without any step: untouched states, and two values given for one
    rest = chains.filter("__last is null or split")
    untouched = F.col("__last").isNull() & F.col("given_has")
    still = rest.select(
        *CHAIN, "max_step",
        F.when(untouched, F.array(tail(F.col("given_at"), F.col("given_val")))).otherwise(F.array().cast(_SEGMENTS)).cast(_SEGMENTS).alias("segments"),
        F.when(F.col("split"), F.array(F.struct(F.lit("two_values").alias("rule"), F.lit(0).cast("bigint").alias("step"))))
        .otherwise(F.array().cast(_BROKEN)).cast(_BROKEN).alias("broken"),
    )
    return cut_lineage(folded.unionByName(still))


def hard_violations(
    folded: DataFrame, ops: DataFrame, max_steps: DataFrame, transfers: DataFrame | None = None
) -> DataFrame:
    """Broken hard rules per problem with the first step that breaks them: such problems have no model."""
    inner = folded.select("problem_id", F.inline("broken")).filter("rule <> 'error_div_zero'")
    used = ops.select("problem_id", F.col("step").cast("bigint").alias("step"))
    if transfers is not None:
        used = used.union(transfers.select("problem_id", F.col("step").cast("bigint").alias("step")))
    horizon = max_steps.groupBy("problem_id").agg(F.max("max_step").alias("max_step"))
    off = (
        used.groupBy("problem_id", "step")
        .agg(F.lit(1).alias("one"))
        .join(horizon, "problem_id", "left")
        .filter("step < 0 or step > coalesce(max_step, 0)")
        .select("problem_id", F.lit("bad_step").alias("rule"), "step")
    )
    return inner.union(off).groupBy("problem_id", "rule").agg(F.min("step").alias("first_step"))


def _sound(folded: DataFrame, violations: DataFrame | None) -> DataFrame:
    """Chains of problems that have a model: those that broke a hard rule while folding, or are named, have none."""
    hard = folded.filter(F.exists("broken", lambda r: r["rule"] != "error_div_zero")).select("problem_id")
    if violations is not None:
        hard = hard.union(violations.select("problem_id"))
    return folded.join(hard.distinct(), "problem_id", "left_anti")


def timeline(folded: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """States that an initial fact or an effect put in place, at their first step."""
    return (
        _sound(folded, violations)
        .select(*CHAIN, F.inline("segments"))
        .select(*CHAIN, F.col("lo").alias("step"), "val")
        .distinct()
    )


def persist(folded: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """States at every step, with unmodified ones carried forward."""
    return (
        _sound(folded, violations)
        .select(*CHAIN, F.inline("segments"))
        .select(*CHAIN, F.explode(F.sequence("lo", "hi")).alias("step"), "val")
    )


def final_value(folded: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """State at the last step of each problem."""
    return (
        _sound(folded, violations)
        .select(*CHAIN, "max_step", F.inline("segments"))
        .filter("max_step between lo and hi")
        .select(*CHAIN, "val")
        .distinct()
    )


def _cover(lo: Column, hi: Column) -> Column:
    """The aligned stretches (level, place) of 2^level steps that make up lo..hi: at most two a level."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        left = F.call_function("div", lo + size - 1, size)
        right = F.call_function("div", hi + 1, size)
        here = left < right
        first = here & (left % 2 == 1)
        last = here & (right % 2 == 1) & (left + left % 2 < right)
        return F.array(
            F.when(first, F.struct(k.alias("level"), left.alias("place"))), F.when(last, F.struct(k.alias("level"), (right - 1).alias("place")))
        )

    levels = F.sequence(F.lit(0), F.length(F.bin(hi + 1)))
    return F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull())


def soft_violation_spans(
    folded: DataFrame, transfers: DataFrame | None = None, physical: list[str] | None = None,
    violations: DataFrame | None = None,
) -> DataFrame:
    """Negative physical states and transfers larger than what the giver holds, as (rule, first step, last step).

    States are not blown up to steps.  A state's stretch of steps is made up of a few aligned stretches of 2^k steps and
    a transfer's step lies in one of each size, so the two meet in an equality join.
    """
    states = _sound(folded, violations).select(*CHAIN, F.inline("segments"))
    attrs = PHYSICAL_ATTRIBUTES if physical is None else physical
    low = states.filter(F.col("attr").isin(attrs) & (F.col("val") < 0)).select(
        "problem_id", F.lit("negative_value").alias("rule"), "entity", "attr", F.col("lo").alias("first_step"), F.col("hi").alias("last_step")
    )
    if transfers is None:
        return low.distinct()
    moves = transfers.select(
        "problem_id", F.col("src").alias("entity"), F.col("item").alias("attr"),
        F.col("step").cast("bigint").alias("step"), "amount",
    )
    # the largest transfer of a giver and step decides, so copies of it are not joined one by one
    largest = moves.filter("step >= 0").groupBy(*CHAIN, "step").agg(F.max("amount").alias("amount"))
    widest = states.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    # no stretch is larger than the longest state
    sizes = F.sequence(F.lit(0), F.lit(max(int(widest).bit_length() - 1, 0)))
    at = largest.select("*", F.explode(sizes).alias("level")).withColumn("place", F.expr("shiftright(step, level)"))
    covered = states.filter("val is not null").select(*CHAIN, "val", F.inline(_cover(F.col("lo"), F.col("hi"))))
    short = at.join(covered, [*CHAIN, "level", "place"]).filter("val < amount").select(
        "problem_id", F.lit("insufficient_amount").alias("rule"), "entity", "attr", F.col("step").alias("first_step"), F.col("step").alias("last_step")
    )
    return low.union(short).distinct()


def soft_violations(
    folded: DataFrame, transfers: DataFrame | None = None, physical: list[str] | None = None,
    violations: DataFrame | None = None,
) -> DataFrame:
    """``soft_violation_spans`` with one row for each step that breaks a rule."""
    spans = soft_violation_spans(folded, transfers, physical, violations)
    steps = F.sequence("first_step", "last_step")
    return spans.select("problem_id", "rule", "entity", "attr", F.explode(steps).alias("step")).distinct()
