"""Long chains: composed timelines, interval joins and relations followed by jumps."""

import random

import pytest
from pyspark.sql import functions as F

from trialmill.operators import ledger

LOW, HIGH = -(2**63), 2**63 - 1
OPS = "problem_id int, entity string, attr string, step long, op string, amount long"


def walk(start, steps):
    """Values after each step of a chain with one operation a step; None once a value leaves 64 bits, until it is set anew."""
    out, val = [], start
    for op, x in steps:
        if op == "set_to":
            val = x
        elif val is not None:
            val = val + x if op == "add_to" else val - x if op == "sub_from" else val * x if op == "mul_by" else val // x
            val = val if LOW <= val <= HIGH else None
        out.append(val)
    return out


@pytest.mark.parametrize("width", [2, 3, 7])
def test_long_chains_by_simulation(spark, width):
    rng = random.Random(width)
    facts, ops, want = [], [], {}
    styles = [
        ["add_to", "sub_from"], ["add_to", "mul_by"], ["mul_by", "div_by"], ["add_to", "sub_from", "mul_by", "div_by"],
        ["add_to", "mul_by", "div_by", "set_to"], ["div_by"],
    ]
    for p in range(36):
        style, n = styles[p % len(styles)], rng.choice([1, 2, 9, 60, 150])
        steps = []
        for _ in range(n):
            op = rng.choices(style, [0.05 if k == "set_to" else 1 for k in style])[0]
            small = rng.choice([-3, -2, -1, 1, 2, 3] if op != "mul_by" else [-2, -1, 0, 1, 1, 2, 3])
            steps.append((op, small if op in ("mul_by", "div_by") else rng.choice([rng.randint(-50, 50), rng.randint(-(2**61), 2**61)])))
        start = rng.choice([0, 5, -7, rng.randint(LOW // 2, HIGH // 2)])
        facts.append((p, "e", "x", start))
        ops += [(p, "e", "x", t, op, x) for t, (op, x) in enumerate(steps)]
        want |= {(p, t + 1): v for t, v in enumerate(walk(start, steps))} | {(p, 0): start}
    horizon = spark.createDataFrame([(p, 200) for p in range(36)], "problem_id int, max_step long")
    run = ledger.fold_timeline(
        spark.createDataFrame(facts, "problem_id int, entity string, attr string, val long"), spark.createDataFrame(ops, OPS), horizon, width=width
    )
    got = {(r["problem_id"], r["step"]): r["val"] for r in ledger.timeline(run).collect()}
    assert got == want
    ends = {r["problem_id"]: r["val"] for r in ledger.final_value(run).collect()}
    assert ends == {p: want[p, max(t for q, t in want if q == p)] for p in range(36)}


def test_gaps_and_conflicts_across_blocks(spark):
    """Chains without a given value need their state at the very step before; several effects a step may disagree."""
    rng = random.Random(4)
    ops, facts = [], []
    for p in range(80):
        if p % 2:
            facts.append((p, "e", "x", rng.randint(0, 5)))
        for t in sorted(rng.sample(range(40), rng.randint(1, 30))):
            for _ in range(rng.choice([1, 1, 1, 2])):
                op = rng.choice(["add_to", "mul_by", "div_by", "set_to"])
                ops.append((p, "e", "x", t, op, rng.choice([0, 1, 2]) if op != "div_by" else rng.choice([1, 2])))
    start = spark.createDataFrame(facts, "problem_id int, entity string, attr string, val long")
    log, horizon = spark.createDataFrame(ops, OPS), spark.createDataFrame([(p, 41) for p in range(80)], "problem_id int, max_step long")
    results = []
    for width in (2, 5, 256):
        run = ledger.fold_timeline(start, log, horizon, width=width)
        states = {tuple(r) for r in run.select("problem_id", F.inline("segments")).distinct().collect()}
        broken = {tuple(r) for r in run.select("problem_id", F.inline("broken")).distinct().collect()}
        results.append((states, broken))
    assert results[0] == results[1] == results[2]
    assert {"two_values", "no_prior_state"} <= {r[1] for r in results[0][1]}


def test_jobs_do_not_grow_with_the_chain(spark):
    def jobs(n):
        start = spark.createDataFrame([(1, "e", "x", 3)], "problem_id int, entity string, attr string, val long")
        ops = spark.range(n).select(
            F.lit(1).alias("problem_id"), F.lit("e").alias("entity"), F.lit("x").alias("attr"), F.col("id").alias("step"),
            F.lit("add_to").alias("op"), F.lit(1).cast("long").alias("amount"),
        )
        group = f"chain of {n}"
        spark.sparkContext.setJobGroup(group, group)
        run = ledger.fold_timeline(start, ops, ops.groupBy("problem_id").agg((F.max("step") + 1).alias("max_step")))
        assert ledger.final_value(run).first()["val"] == 3 + n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(60_000) <= jobs(600) + 2


def test_spans_by_brute_force(spark):
    rng = random.Random(3)
    facts, moves, ops = [], [], []
    for p in range(40):
        facts += [(p, e, "apples", rng.randint(0, 30)) for e in ("a", "b")]
        for t in sorted(rng.sample(range(60), 6)):
            ops.append((p, rng.choice("ab"), "apples", t, rng.choice(["add_to", "sub_from"]), rng.randint(0, 20)))
    start = spark.createDataFrame(facts, "problem_id int, entity string, attr string, val long")
    log, horizon = spark.createDataFrame(ops, OPS), spark.createDataFrame([(p, 64) for p in range(40)], "problem_id int, max_step long")
    run = ledger.fold_timeline(start, log, horizon)
    # transfers that the timeline knows nothing of meet states of any length
    moves = [(p, rng.choice("ab"), "z", "apples", rng.randint(0, 40), rng.randint(-1, 70)) for p in range(40) for _ in range(12)]
    moved = spark.createDataFrame(moves, "problem_id int, src string, dst string, item string, amount long, step long")
    states = {(r["problem_id"], r["entity"], r["step"]): r["val"] for r in ledger.persist(run).collect()}
    want = {(p, "negative_value", e, t) for (p, e, t), v in states.items() if v < 0}
    want |= {(p, "insufficient_amount", e, t) for p, e, _, _, x, t in moves if (p, e, t) in states and states[p, e, t] < x}
    got = [(r["problem_id"], r["rule"], r["entity"], r["step"]) for r in ledger.soft_violations(run, moved).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    spans = ledger.soft_violation_spans(run, moved)
    assert {(r["problem_id"], r["rule"], r["entity"], t) for r in spans.collect() for t in range(r["first_step"], r["last_step"] + 1)} == want
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(first_step" not in plan and "sequence(lo" not in plan


@pytest.mark.parametrize("single", [0, 2, 8])
def test_relations_by_brute_force(spark, monkeypatch, single):
    monkeypatch.setattr(ledger, "_SINGLE_ROUNDS", single)
    rng = random.Random(6)
    rel, given = [], []
    for p in range(6):
        n = 30
        for e in range(1, n):
            for _ in range(rng.choice([1, 1, 2])):
                kind = rng.choices(["multiple", "percent"], [5, 1])[0]
                rel.append((p, kind, e, rng.randrange(max(0, e - 3), e), rng.choice([-1, 0, 1, 1, 1]) if kind == "multiple" else rng.choice([50, 100, 150])))
        given += [(p, 0, 40 + p), (p, 0, 41), (p, 7, 5), (p, 9, None)]
    want = {(p, e, v) for p, e, v in given}
    work = [w for w in want if w[2] is not None]
    while work:
        p, e, v = work.pop()
        for q, kind, to, other, x in rel:
            if q == p and other == e:
                made = (p, to, v * x if kind == "multiple" else x * v // 100)
                if made not in want:
                    want.add(made)
                    work.append(made)
    rel_df = spark.createDataFrame(rel, "problem_id int, kind string, entity int, other int, amount long")
    got = ledger.derive_relations(rel_df, spark.createDataFrame(given, "problem_id int, entity int, val long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_relations_of_ten_thousand_links(spark):
    links = spark.range(1, 10_001).select(
        F.lit(1).alias("problem_id"), F.lit("multiple").alias("kind"), F.col("id").alias("entity"), (F.col("id") - 1).alias("other"),
        F.when(F.col("id") % 2 == 0, -1).otherwise(1).cast("long").alias("amount"),
    )
    start = spark.createDataFrame([(1, 0, 12)], "problem_id int, entity long, val long")
    got = ledger.derive_relations(links, start)
    assert got.count() == 10_001
    assert got.filter("entity = 10000").first()["val"] == 12
    # factors beyond 64 bits are fine for the value zero only
    doubled = links.withColumn("amount", F.lit(2).cast("long"))
    assert ledger.derive_relations(doubled, start.withColumn("val", F.lit(0).cast("long"))).filter("val = 0").count() == 10_001
    with pytest.raises(Exception, match="64 bits"):
        ledger.derive_relations(doubled, start)
    ring = links.unionByName(links.limit(1).selectExpr("problem_id", "kind", "0L AS entity", "100L AS other", "1L AS amount"))
    assert ledger.derive_relations(ring.filter("entity <= 100"), start).count() > 100  # a ring of units ends


@pytest.mark.parametrize("links", [10, 60])
def test_contracted_relations_by_brute_force(spark, monkeypatch, links):
    """Trees of single links with zeros, rings, percentages, entities of several sources and given values inside."""
    monkeypatch.setattr(ledger, "_CORE_LINKS", links, raising=False)
    rng = random.Random(11)
    rel, given = [], []
    for p in range(5):
        for e in range(1, 60):
            kind = rng.choices(["multiple", "percent"], [15, 1])[0]
            for _ in range(rng.choices([1, 2], [12, 1])[0]):
                rel.append((p, kind, e, rng.randrange(max(0, e - 4), e), rng.choice([-1, 0, 1, 1, 1, 1]) if kind == "multiple" else 50))
        rel += [(p, "multiple", 70 + i, 70 + (i + 1) % 9, 1) for i in range(9)]  # a ring that no value reaches
        rel += [(p, "multiple", 90, 70, 3), (p, "multiple", 80, 80, 2), (p, "multiple", None, 5, 1), (p, "multiple", 91, None, 1)]
        rel += [(p, "multiple", 100 + i, 100 + (i + 1) % 9, 1) for i in range(9)]  # and one with a given value
        given += [(p, 0, 40 + p), (p, 0, 41), (p, 20, 5), (p, 30, None), (p, 104, 6)]
    want = {(p, e, v) for p, e, v in given}
    work = [w for w in want if w[2] is not None]
    while work:
        p, e, v = work.pop()
        for q, kind, to, other, x in rel:
            if q == p and e is not None and other == e:
                made = (p, to, v * x if kind == "multiple" else x * v // 100)
                if made not in want:
                    want.add(made)
                    work.append(made)
    rel_df = spark.createDataFrame(rel + rel[:30], "problem_id int, kind string, entity int, other int, amount long")
    got = ledger.derive_relations(rel_df, spark.createDataFrame(given, "problem_id int, entity int, val long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_contracting_moves_as_much_as_there_are_links(spark, monkeypatch):
    """The tables written for a chain grow with it and not with its length times the rounds of jumps."""
    monkeypatch.setattr(ledger, "_CORE_LINKS", 100, raising=False)
    kept, rows = ledger.cut_lineage, []

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ledger, "cut_lineage", counted)
    links = spark.range(1, 8_001).select(
        F.lit(1).alias("problem_id"), F.lit("multiple").alias("kind"), F.col("id").alias("entity"), (F.col("id") - 1).alias("other"),
        F.lit(1).cast("long").alias("amount"),
    )
    got = ledger.derive_relations(links, spark.createDataFrame([(1, 0, 12)], "problem_id int, entity long, val long"))
    assert got.filter("val = 12").count() == 8_001
    assert sum(rows) < 9 * 8_000


def test_factors_beyond_64_bits_stay_beyond(spark, monkeypatch):
    """A product of -2^64 is not held at -2^63, which is a value."""
    monkeypatch.setattr(ledger, "_SINGLE_ROUNDS", 0)
    links = [(1, "multiple", 1, 0, 2**32), (1, "multiple", 2, 1, -(2**32))]
    rel = spark.createDataFrame(links, "problem_id int, kind string, entity int, other int, amount long")
    with pytest.raises(Exception, match="64 bits"):
        ledger.derive_relations(rel, spark.createDataFrame([(1, 0, 1)], "problem_id int, entity int, val long")).collect()
