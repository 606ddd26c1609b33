"""Ledger queries over fact tables drawn from the event log and the customer list."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, metrics, pairs
from .fixtures import cte, table, view
from .q_text import _fdiv
from .registry import add

G, LF = cte("given_quantity"), cte("ledger_facts")


def given(s, d):
    return view(s, d, "given_quantity")


def facts(s, d):
    return view(s, d, "ledger_facts")


add(
    "j1_entities",
    lambda s, d: ledger.entities(
        given(s, d), typed=view(s, d, "transfers").select("problem_id", F.col("dst").alias("entity"))
    ),
    f"{cte('given_quantity', 'transfers')} SELECT problem_id, entity FROM given_quantity UNION SELECT problem_id, dst FROM transfers",
)
add(
    "j1_items",
    lambda s, d: ledger.items(given(s, d)),
    f"{G} SELECT DISTINCT problem_id, item FROM given_quantity",
)


def _plain(s, d):
    return facts(s, d).select("problem_id", "entity", "item", F.col("amount").alias("val"))


def _explicit(s, d):
    unit = F.when(F.col("den") == 0, "units").when(F.col("den") < 3, "kg").otherwise("box")
    return facts(s, d).filter("num = den").select("problem_id", "entity", "item", F.col("amount").alias("val"), unit.alias("unit"))


add(
    "j2_default_unit",
    lambda s, d: ledger.default_unit(_plain(s, d), _explicit(s, d)),
    f"""{LF}, e AS (SELECT problem_id, entity, item, amount AS val, CASE WHEN den = 0 THEN 'units' WHEN den < 3 THEN 'kg'
      ELSE 'box' END AS unit FROM ledger_facts WHERE num = den)
    SELECT * FROM e UNION SELECT problem_id, entity, item, amount, 'units' FROM ledger_facts f WHERE NOT EXISTS (
      SELECT 1 FROM e WHERE e.problem_id = f.problem_id AND e.entity = f.entity AND e.item = f.item AND e.unit <> 'units')""",
)
add(
    "j3_apply_transfer",
    lambda s, d: ledger.apply_transfer(
        view(s, d, "transfers"),
        given(s, d),
        table(s, d, "events").select((F.col("user_id") % 30).alias("problem_id"), (F.col("user_id") % 30 % 5 - 3).alias("max_step")),
    ),
    f"""{cte("transfers", "given_quantity")}, t AS (SELECT * FROM transfers WHERE problem_id % 5 - 3 <= 0)
    SELECT t.problem_id, src AS entity, t.item, val - amount AS val FROM t JOIN given_quantity g
      ON t.problem_id = g.problem_id AND t.src = g.entity AND t.item = g.item
    UNION SELECT t.problem_id, dst, t.item, val + amount FROM t JOIN given_quantity g
      ON t.problem_id = g.problem_id AND t.dst = g.entity AND t.item = g.item""",
)
add(
    "j4_apply_consume",
    lambda s, d: ledger.apply_consume(facts(s, d), given(s, d)),
    f"""{cte("ledger_facts", "given_quantity")} SELECT DISTINCT f.problem_id, f.entity, f.item, val - amount AS val
    FROM ledger_facts f JOIN given_quantity g ON f.problem_id = g.problem_id AND f.entity = g.entity AND f.item = g.item""",
)
add(
    "j4_apply_produce",
    lambda s, d: ledger.apply_produce(facts(s, d).withColumn("entity", F.col("other")), given(s, d)),
    f"""{cte("ledger_facts", "given_quantity")}, p AS (SELECT DISTINCT problem_id, other AS entity, item, amount FROM ledger_facts)
    SELECT p.problem_id, p.entity, p.item, amount + coalesce(val, 0) AS val FROM p LEFT JOIN given_quantity g
      ON p.problem_id = g.problem_id AND p.entity = g.entity AND p.item = g.item GROUP BY ALL""",
)


def _pairs(s, d):
    return facts(s, d).select(
        "problem_id",
        F.concat(F.lit("t"), F.col("event_id")).alias("target"),
        F.col("entity").alias("first"),
        (F.col("problem_id") + F.col("num") * 30).alias("second"),
        "item",
    )


add(
    "j5_combine_pair",
    lambda s, d: ledger.combine_pair(_pairs(s, d), given(s, d)),
    f"""{cte("ledger_facts", "given_quantity")} SELECT DISTINCT f.problem_id, concat('t', event_id) AS target, a.val + b.val AS val
    FROM ledger_facts f JOIN given_quantity a ON f.problem_id = a.problem_id AND f.entity = a.entity AND f.item = a.item
    JOIN given_quantity b ON f.problem_id = b.problem_id AND f.problem_id + f.num * 30 = b.entity AND f.item = b.item""",
)


def _groups(s, d):
    f = facts(s, d)
    combines = f.select(
        "problem_id", F.concat("item", F.lit("-"), F.col("num")).alias("target"), F.col("num").alias("grp"), "item"
    )
    members = f.select("problem_id", F.col("den").alias("grp"), "entity")
    return ledger.combine_group(combines, members, _plain(s, d))


add(
    "j6_combine_group",
    _groups,
    f"""{LF}, m AS (SELECT DISTINCT problem_id, den AS grp, entity FROM ledger_facts),
    q AS (SELECT DISTINCT problem_id, entity, item, amount AS val FROM ledger_facts),
    c AS (SELECT DISTINCT problem_id, concat(item, '-', num) AS target, num AS grp, item FROM ledger_facts),
    s AS (SELECT m.problem_id, m.grp, q.item, sum(val) AS val FROM m JOIN q ON m.problem_id = q.problem_id AND m.entity = q.entity GROUP BY ALL)
    SELECT DISTINCT c.problem_id, target, CAST(coalesce(val, 0) AS BIGINT) AS val FROM c LEFT JOIN s
      ON c.problem_id = s.problem_id AND c.grp = s.grp AND c.item = s.item""",
)
add(
    "j7_partition_equal",
    lambda s, d: ledger.partition_equal(
        facts(s, d).select("problem_id", F.col("entity").alias("source"), F.col("other").alias("target"), "item", "parts"),
        given(s, d),
    ),
    f"""{cte("ledger_facts", "given_quantity")} SELECT DISTINCT f.problem_id, other AS target, {_fdiv("val", "parts")} AS val
    FROM ledger_facts f JOIN given_quantity g ON f.problem_id = g.problem_id AND f.entity = g.entity AND f.item = g.item WHERE parts > 0""",
)
add(
    "j7_partition_ratio",
    lambda s, d: ledger.partition_ratio(
        facts(s, d).select(
            "problem_id", F.col("entity").alias("source"), F.col("other").alias("target"), "item",
            F.col("num").alias("my_part"), F.col("den").alias("total_parts"),
        ),
        given(s, d),
    ),
    f"""{cte("ledger_facts", "given_quantity")} SELECT DISTINCT f.problem_id, other AS target, {_fdiv("val * num", "den")} AS val
    FROM ledger_facts f JOIN given_quantity g ON f.problem_id = g.problem_id AND f.entity = g.entity AND f.item = g.item WHERE den > 0""",
)


def _rates(s, d):
    f = facts(s, d)
    speeds = f.select(
        "problem_id", F.col("entity").cast("string").alias("subject"),
        F.when(F.col("num") < 2, "speed").otherwise("output").alias("kind"), F.col("parts").alias("rate"),
    )
    prices = f.select("problem_id", F.col("item").alias("subject"), F.lit("price").alias("kind"), F.col("den").alias("rate"))
    durations = f.select("problem_id", F.col("entity").cast("string").alias("entity"), F.col("num").alias("duration"))
    quantities = given(s, d).withColumn("entity", F.col("entity").cast("string"))
    return ledger.rate_totals(speeds.union(prices), durations, quantities)


add(
    "j8_rate_totals",
    _rates,
    f"""{cte("ledger_facts", "given_quantity")}, r AS (SELECT DISTINCT problem_id, CAST(entity AS VARCHAR) AS subject,
      CASE WHEN num < 2 THEN 'speed' ELSE 'output' END AS name, parts AS rate FROM ledger_facts),
    dd AS (SELECT DISTINCT problem_id, CAST(entity AS VARCHAR) AS entity, num AS duration FROM ledger_facts),
    td AS (SELECT r.problem_id, entity, name, rate * duration AS val FROM r JOIN dd ON r.problem_id = dd.problem_id AND subject = entity)
    SELECT problem_id, 'distance' AS kind, entity, name, val FROM td WHERE name = 'speed'
    UNION SELECT problem_id, 'total', entity, name, val FROM td
    UNION SELECT f.problem_id, 'cost', CAST(g.entity AS VARCHAR), f.item, den * val FROM
      (SELECT DISTINCT problem_id, item, den FROM ledger_facts) f JOIN given_quantity g
      ON f.problem_id = g.problem_id AND f.item = g.item""",
)
_REL = cte("relations", recursive=True)
_DERIVED = f"""{_REL}, dv(problem_id, entity, val) AS (SELECT problem_id, entity, val FROM root_values UNION
    SELECT r.problem_id, r.entity, CASE kind WHEN 'multiple' THEN dv.val * amount ELSE {_fdiv("amount * dv.val", "100")} END
    FROM relations r JOIN dv ON r.problem_id = dv.problem_id AND r.other = dv.entity)"""
add(
    "j9_derive_relations",
    lambda s, d: ledger.derive_relations(view(s, d, "relations"), view(s, d, "root_values")),
    f"{_DERIVED} SELECT problem_id, entity, CAST(val AS BIGINT) AS val FROM dv",
)
add(
    "j10_total_quantity",
    lambda s, d: ledger.total_quantity(_plain(s, d)),
    f"""{LF}, q AS (SELECT DISTINCT problem_id, entity, item, amount FROM ledger_facts)
    SELECT problem_id, item, CAST(sum(amount) AS BIGINT) AS total FROM q GROUP BY 1, 2""",
)
add(
    "j10_counts",
    lambda s, d: ledger.counts(given(s, d)),
    f"{G} SELECT problem_id, count(DISTINCT entity) AS entity_count, count(DISTINCT item) AS item_count FROM given_quantity GROUP BY 1",
)
add(
    "j10_has_item",
    lambda s, d: ledger.has_item(given(s, d)),
    f"{G} SELECT DISTINCT problem_id, entity, item FROM given_quantity WHERE val > 0",
)
_MOVED = """moved AS (SELECT t.problem_id, src AS entity, t.item, val - amount AS val FROM transfers t JOIN given_quantity g
      ON t.problem_id = g.problem_id AND t.src = g.entity AND t.item = g.item
    UNION SELECT t.problem_id, dst, t.item, val + amount FROM transfers t JOIN given_quantity g
      ON t.problem_id = g.problem_id AND t.dst = g.entity AND t.item = g.item)"""


def _consumed_twice(s, d):
    twice = facts(s, d).withColumn("amount", F.col("amount") * 2)
    return ledger.apply_consume(twice, given(s, d))


add(
    "j11_negative_quantities",
    lambda s, d: ledger.negative_quantities(
        _consumed_twice(s, d), facts(s, d).filter("num = 4 and item = 'click'").select("problem_id", "item")
    ),
    f"""{cte("ledger_facts", "given_quantity")} SELECT DISTINCT f.problem_id, f.entity, f.item, val - 2 * amount AS val
    FROM ledger_facts f JOIN given_quantity g ON f.problem_id = g.problem_id AND f.entity = g.entity AND f.item = g.item
    WHERE val < 2 * amount AND NOT EXISTS (SELECT 1 FROM ledger_facts x WHERE x.num = 4 AND x.item = 'click'
      AND x.problem_id = f.problem_id AND x.item = f.item)""",
)


def _targets(s, d):
    """A target per event: its value, its giver's quantity or its receiver's final state, by the event's parts."""
    f = facts(s, d)
    kind = F.when(F.col("parts") < 2, "value").when(F.col("parts") < 4, "qty").otherwise("final")
    return f.select(
        F.concat_ws("-", "problem_id", "parts").alias("problem_id"),
        kind.alias("kind"),
        F.col("entity").cast("string").alias("a"),
        F.col("item").alias("b"),
    ).distinct()


def _solutions(s, d):
    f = facts(s, d).withColumn("problem_id", F.concat_ws("-", "problem_id", "parts"))
    entity = F.col("entity").cast("string").alias("entity")
    values = f.filter("den = 5").select("problem_id", entity, F.col("num").alias("val"))
    quantities = f.filter("num = 3").select("problem_id", entity, "item", F.col("den").alias("val"))
    finals = f.filter("num = 2").select("problem_id", entity, F.col("item").alias("attr"), F.lit(7).cast("bigint").alias("val"))
    answers = f.filter("num = 0 and den = 0").select("problem_id", F.col("amount").alias("val"))
    return ledger.solutions(_targets(s, d), values, answers, quantities, finals)


_SOL = f"""{LF}, f AS (SELECT *, concat(problem_id, '-', parts) AS pid FROM ledger_facts),
    tg AS (SELECT DISTINCT pid, CASE WHEN parts < 2 THEN 'value' WHEN parts < 4 THEN 'qty' ELSE 'final' END AS kind, entity, item FROM f),
    sol AS (SELECT t.pid AS problem_id, v.num AS solution FROM tg t JOIN f v ON t.pid = v.pid AND t.entity = v.entity
        WHERE kind = 'value' AND den = 5
      UNION SELECT t.pid, q.den FROM tg t JOIN f q ON t.pid = q.pid AND t.entity = q.entity AND t.item = q.item WHERE kind = 'qty' AND num = 3
      UNION SELECT t.pid, 7 FROM tg t JOIN f q ON t.pid = q.pid AND t.entity = q.entity AND t.item = q.item WHERE kind = 'final' AND num = 2
      UNION SELECT pid, amount FROM f WHERE num = 0 AND den = 0)"""
add("j12_solutions", _solutions, f"{_SOL} SELECT problem_id, solution FROM sol")
add(
    "e25_answer_status",
    lambda s, d: metrics.answer_status(_solutions(s, d), _targets(s, d)),
    f"""{_SOL}, n AS (SELECT problem_id, count(DISTINCT solution) AS k, min(solution) AS v FROM sol GROUP BY 1)
    SELECT DISTINCT pid AS problem_id, CASE WHEN coalesce(k, 0) = 0 THEN 'NO_ANSWER' WHEN k = 1 THEN 'SAT' ELSE 'AMBIGUOUS' END
    AS status, CASE WHEN k = 1 THEN v END AS answer FROM tg LEFT JOIN n ON tg.pid = n.problem_id""",
)
add(
    "d9_convert_units",
    lambda s, d: pairs.convert_units(
        facts(s, d).select(
            "event_id",
            "entity",
            F.col("amount").alias("val"),
            F.element_at(
                F.array(*[F.lit(u) for u in ("feet", "pounds", "minutes", "hours", "dollars", "inches", "stones")]),
                (F.col("parts") + 1).cast("int"),
            ).alias("unit"),
        )
    ),
    f"""{LF}, q AS (SELECT event_id, entity, amount AS val, ['feet','pounds','minutes','hours','dollars','inches','stones'][parts + 1] AS unit
      FROM ledger_facts), u(f, t, k) AS (VALUES ('feet','inches',12),('yards','feet',3),('miles','feet',5280),
      ('meters','centimeters',100),('kilometers','meters',1000),('pounds','ounces',16),('kilograms','grams',1000),
      ('tons','pounds',2000),('hours','minutes',60),('minutes','seconds',60),('days','hours',24),('weeks','days',7),('dollars','cents',100))
    SELECT DISTINCT event_id, entity, t AS unit, val * k AS val FROM q JOIN u ON unit = f
    UNION SELECT event_id, entity, f, val // k FROM q JOIN u ON unit = t""",
)

# --- timelines ---------------------------------------------------------------------------------

_OPS = cte("horizon", "given_quantity", recursive=True)
add(
    "j13_step_table",
    lambda s, d: ledger.step_table(view(s, d, "horizon")),
    f"""{cte("horizon")} SELECT problem_id, CAST(t AS INT) AS step, CASE WHEN t > 0 THEN CAST(t - 1 AS INT) END AS previous,
    CASE WHEN t < max_step THEN CAST(t + 1 AS INT) END AS next, CAST(t AS INT) AS n_before,
    CAST(max_step - t AS INT) AS n_after, t = 0 AS is_first, t = max_step AS is_last
    FROM horizon, range(1000000) r(t) WHERE t <= max_step""",
)


def initial(s, d):
    return given(s, d).withColumnRenamed("item", "attr")


def ops_and_horizon(s, d):
    """The numbered operations and, from the same rows, the last step of each problem."""
    ops = view(s, d, "ops")
    return ops, ops.groupBy("problem_id").agg((F.max("step") + 1).alias("max_step"))


def folded(s, d):
    return ledger.fold_timeline(initial(s, d), *ops_and_horizon(s, d))


# states by direct recursion over steps; unmodified states persist to the last step
_AT = f"""{_OPS}, state_at(problem_id, entity, attr, step, val, derived) AS (
    SELECT problem_id, entity, item, 0::BIGINT, val, true FROM given_quantity UNION ALL
    SELECT a.problem_id, a.entity, a.attr, a.step + 1, CASE o.op WHEN 'add_to' THEN a.val + o.amount
      WHEN 'sub_from' THEN a.val - o.amount WHEN 'mul_by' THEN a.val * o.amount WHEN 'div_by' THEN {_fdiv("a.val", "o.amount")}
      WHEN 'set_to' THEN o.amount ELSE a.val END, o.op IS NOT NULL
    FROM state_at a JOIN horizon h ON a.problem_id = h.problem_id AND a.step < h.max_step
    LEFT JOIN ops o ON a.problem_id = o.problem_id AND a.entity = o.entity AND a.attr = o.attr AND a.step = o.step)"""
add(
    "j14_timeline",
    lambda s, d: ledger.timeline(folded(s, d)),
    f"{_AT} SELECT problem_id, entity, attr, step, CAST(val AS BIGINT) AS val FROM state_at WHERE derived",
)
add(
    "j15_persist",
    lambda s, d: ledger.persist(folded(s, d)),
    f"{_AT} SELECT problem_id, entity, attr, step, CAST(val AS BIGINT) AS val FROM state_at",
)
add(
    "j16_final_value",
    lambda s, d: ledger.final_value(folded(s, d)),
    f"""{_AT} SELECT a.problem_id, entity, attr, CAST(val AS BIGINT) AS val FROM state_at a JOIN horizon h
    ON a.problem_id = h.problem_id AND a.step = h.max_step""",
)


def _violations(s, d):
    ops, horizon = ops_and_horizon(s, d)
    moves = view(s, d, "transfers")
    # a horizon three steps short of the log leaves late operations outside it
    tight = horizon.withColumn("max_step", F.col("max_step") - 3)
    # only every second chain has a starting value
    start = initial(s, d).filter("entity % 2 = 0")
    run = ledger.fold_timeline(start, ops, tight, moves)
    return ledger.hard_violations(run, ops, tight, moves)


# full set semantics by recursion: every effect on every value of a step, without merging values
_SETS = f"""{cte("horizon", "given_quantity", "transfers", recursive=True)},
    hz AS (SELECT problem_id, max_step - 3 AS max_step FROM horizon),
    fx AS (SELECT problem_id, entity, attr, step, op, amount FROM ops
      UNION SELECT problem_id, src, item, step, 'sub_from', amount FROM transfers
      UNION SELECT problem_id, dst, item, step, 'add_to', amount FROM transfers),
    fxv AS (SELECT fx.* FROM fx JOIN hz ON fx.problem_id = hz.problem_id AND fx.step BETWEEN 0 AND hz.max_step),
    ex AS (SELECT problem_id, entity, attr, step, bool_or(op <> 'set_to') AS needs, bool_or(op = 'set_to') AS puts FROM fxv GROUP BY ALL),
    chains AS (SELECT DISTINCT problem_id, entity, attr FROM fxv),
    start AS (SELECT problem_id, entity, item AS attr, val FROM given_quantity WHERE entity % 2 = 0),
    has(problem_id, entity, attr, step, alive, keep) AS (
      SELECT c.problem_id, c.entity, c.attr, 0::BIGINT, s.val IS NOT NULL, s.val IS NOT NULL FROM chains c LEFT JOIN start s
        ON c.problem_id = s.problem_id AND c.entity = s.entity AND c.attr = s.attr
      UNION ALL SELECT h.problem_id, h.entity, h.attr, h.step + 1,
        CASE WHEN e.step IS NULL THEN h.alive AND h.keep ELSE e.puts OR h.alive END, h.keep
      FROM has h JOIN hz ON h.problem_id = hz.problem_id AND h.step <= hz.max_step
      LEFT JOIN ex e ON h.problem_id = e.problem_id AND h.entity = e.entity AND h.attr = e.attr AND h.step = e.step),
    miss AS (SELECT h.problem_id, h.step FROM has h JOIN ex e ON h.problem_id = e.problem_id AND h.entity = e.entity
      AND h.attr = e.attr AND h.step = e.step WHERE e.needs AND NOT h.alive),
    vals(problem_id, entity, attr, step, val) AS (
      SELECT problem_id, entity, attr, 0::BIGINT, val FROM start
      UNION SELECT f.problem_id, f.entity, f.attr, f.step + 1, f.amount FROM fxv f WHERE f.op = 'set_to'
      UNION SELECT v.problem_id, v.entity, v.attr, v.step + 1, CASE f.op WHEN 'add_to' THEN v.val + f.amount
        WHEN 'sub_from' THEN v.val - f.amount WHEN 'mul_by' THEN v.val * f.amount WHEN 'div_by' THEN {_fdiv("v.val", "f.amount")}
        ELSE v.val END
      FROM vals v JOIN hz ON v.problem_id = hz.problem_id AND v.step <= hz.max_step
      LEFT JOIN fxv f ON v.problem_id = f.problem_id AND v.entity = f.entity AND v.attr = f.attr AND v.step = f.step AND f.op <> 'set_to'
      WHERE (f.op IS NOT NULL OR (NOT EXISTS (SELECT 1 FROM ex e WHERE e.problem_id = v.problem_id AND e.entity = v.entity
          AND e.attr = v.attr AND e.step = v.step) AND v.entity % 2 = 0 AND v.step < hz.max_step))),
    two AS (SELECT problem_id, step FROM vals GROUP BY problem_id, entity, attr, step HAVING count(DISTINCT val) > 1)"""
add(
    "j17_hard_violations",
    _violations,
    f"""{_SETS} SELECT problem_id, rule, min(step) AS first_step FROM (
      SELECT problem_id, 'two_values' AS rule, step FROM two UNION ALL SELECT problem_id, 'no_prior_state', step FROM miss
      UNION ALL SELECT fx.problem_id, 'bad_step', fx.step FROM fx JOIN hz ON fx.problem_id = hz.problem_id
        AND (fx.step < 0 OR fx.step > hz.max_step)) x GROUP BY 1, 2""",
)


def _single_moves(s, d):
    """One transfer per problem: each event moves its amount between two holders."""
    e = table(s, d, "events")
    amount = F.round(F.col("value") * 100).cast("bigint")
    moves = e.select(
        F.col("event_id").alias("problem_id"), F.lit(0).alias("step"), F.col("user_id").alias("src"),
        ((F.col("user_id") * 7 + 1) % 150 + 100000).alias("dst"), F.col("event_type").alias("item"), amount.alias("amount"),
    )
    start = moves.select(
        "problem_id", F.explode(F.array("src", "dst")).alias("entity"), F.col("item").alias("attr"),
        (F.col("src") * 100 % 3000).alias("val"),
    )
    horizon = moves.select("problem_id", F.lit(2).cast("bigint").alias("max_step"))
    empty = view(s, d, "ops").filter("step < 0")
    run = ledger.fold_timeline(start, empty, horizon, moves)
    return run, moves, ["click", "purchase"], ledger.hard_violations(run, empty, horizon, moves)


add(
    "j18_soft_violation_spans",
    lambda s, d: ledger.soft_violation_spans(*_single_moves(s, d)),
    """WITH m AS (SELECT event_id AS problem_id, user_id AS src, event_type AS item, CAST(round(value * 100) AS BIGINT) AS amount,
      user_id * 100 % 3000 AS val FROM events)
    SELECT problem_id, 'insufficient_amount' AS rule, src AS entity, item AS attr, CAST(0 AS BIGINT) AS first_step,
      CAST(0 AS BIGINT) AS last_step FROM m WHERE val < amount
    UNION ALL SELECT problem_id, 'negative_value', src, item, 1, 2 FROM m WHERE val < amount AND item IN ('click', 'purchase')""",
)
add(
    "j18_soft_violations",
    lambda s, d: ledger.soft_violations(*_single_moves(s, d)),
    """WITH m AS (SELECT event_id AS problem_id, user_id AS src, event_type AS item, CAST(round(value * 100) AS BIGINT) AS amount,
      user_id * 100 % 3000 AS val FROM events)
    SELECT problem_id, 'insufficient_amount' AS rule, src AS entity, item AS attr, CAST(0 AS BIGINT) AS step FROM m WHERE val < amount
    UNION ALL SELECT problem_id, 'negative_value', src, item, CAST(t AS BIGINT) FROM m, range(1, 3) r(t)
      WHERE val < amount AND item IN ('click', 'purchase')""",
)


# --- long chains --------------------------------------------------------------------------------


def _long_relations(s, d):
    """Every order is worth as much as the one before it, or as much below zero; the first one's value is given."""
    orders = table(s, d, "orders").select(
        (F.col("o_custkey") * 0).alias("problem_id"), F.lit("multiple").alias("kind"), F.col("o_orderkey").alias("entity"),
        (F.col("o_orderkey") - 1).alias("other"), F.when(F.col("o_custkey") % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).cast("bigint").alias("amount"),
    )
    first = orders.agg(F.min("problem_id").alias("problem_id"), (F.min("entity") - 1).alias("entity"), F.lit(750).cast("bigint").alias("val"))
    return ledger.derive_relations(orders, first)


add(
    "j9_long_chain",
    _long_relations,
    """SELECT 0 AS problem_id, o_orderkey AS entity, CAST(750 * CASE WHEN sum(o_custkey % 2) OVER (ORDER BY o_orderkey) % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS val
    FROM orders UNION ALL SELECT 0, min(o_orderkey) - 1, 750 FROM orders""",
)


def _long_fold(s, d):
    """All events of a type as one chain of operations, one a step."""
    e = table(s, d, "events")
    kind = F.when(F.col("event_id") % 977 == 0, "set_to").when(F.col("event_id") % 3 == 0, "add_to").when(F.col("event_id") % 3 == 1, "sub_from")
    cents = F.round(F.col("value") * 100).cast("bigint")
    ops = e.select(
        F.col("event_type").alias("problem_id"), F.lit(1).alias("entity"), F.lit("worth").alias("attr"), F.col("event_id").alias("step"),
        kind.otherwise(F.when(F.col("event_id") % 2 == 0, "mul_by").otherwise("div_by")).alias("op"),
        F.when((F.col("event_id") % 977 != 0) & (F.col("event_id") % 3 == 2), F.lit(1)).otherwise(cents).cast("bigint").alias("amount"),
    )
    start = ops.select("problem_id", "entity", "attr").distinct().withColumn("val", F.lit(500).cast("bigint"))
    return ledger.fold_timeline(start, ops, ops.groupBy("problem_id").agg((F.max("step") + 1).alias("max_step")))


add(
    "j14_long_chain",
    lambda s, d: ledger.timeline(_long_fold(s, d)).drop("entity", "attr"),
    """WITH o AS (SELECT event_type AS problem_id, event_id AS step, event_id % 977 = 0 AS put, CAST(round(value * 100) AS BIGINT) AS x,
      CASE WHEN event_id % 977 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN -1 ELSE 0 END AS sign FROM events),
    g AS (SELECT *, sum(CASE WHEN put THEN 1 ELSE 0 END) OVER (PARTITION BY problem_id ORDER BY step) AS part FROM o)
    SELECT problem_id, step + 1 AS step, CAST(CASE WHEN part = 0 THEN 500 ELSE first(x) OVER w END + sum(sign * x) OVER w AS BIGINT) AS val
    FROM g WINDOW w AS (PARTITION BY problem_id, part ORDER BY step)
    UNION ALL SELECT DISTINCT problem_id, 0, 500 FROM o""",
)
