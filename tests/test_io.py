"""Files, quarantine, corpus jobs, restarts and plan shapes."""

import json
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.functions import lexicon as lx
from trialmill.functions import text as tx
from trialmill.operators import checks, corpus, pairs, routing, templates
from trialmill.operators.templates import Template, Variable
from trialmill.plans.fixtures import table, view
from trialmill.plans.q_corpus import TEMPLATES
from trialmill.sources import datasets
from trialmill.sources import trials as log
from trialmill.streaming import stream

SF = "/root/testdata/sf0.001"
TRIAL = {"problem_id": "p1", "path_taken": "slow", "correct": True, "ground_truth": 3, "final_answer": 3}


def test_trial_files_and_quarantine(spark, tmp_path):
    folder = tmp_path / "bandit"
    folder.mkdir()
    lines = [json.dumps(TRIAL), "", "{broken", json.dumps(TRIAL | {"problem_id": "p2", "tokens_input": 7})]
    (folder / "base.jsonl").write_text("\n".join(lines))
    (tmp_path / "stranger").mkdir()
    (tmp_path / "stranger" / "base.jsonl").write_text(json.dumps(TRIAL))
    rows = log.read_trials(spark, str(tmp_path), layout="files").collect()
    assert {(r["system"], r["variant"], r["problem_id"], r["tokens_input"]) for r in rows} == {
        ("bandit", "base", "p1", 0), ("bandit", "base", "p2", 7),
    }
    assert [r["line"] for r in log.quarantined_trials(spark, str(tmp_path), layout="files").collect()] == ["{broken"]
    (folder / "noop.jsonl").write_text(json.dumps(TRIAL | {"path_taken": "sideways"}))
    with pytest.raises(Exception, match="unknown path_taken"):
        log.read_trials(spark, str(tmp_path), layout="files").collect()


def test_stream_and_batch_share_a_parser(spark, tmp_path):
    for system in ("bandit", "random"):
        folder = tmp_path / "files" / system
        folder.mkdir(parents=True)
        for variant in ("base", "p1"):
            lines = [json.dumps(TRIAL | {"problem_id": f"{system}{i}"}) for i in range(5)]
            (folder / f"{variant}.jsonl").write_text("\n".join([*lines, "", "{broken", json.dumps({"path_taken": "slow"})]))
    log.write_trials(log.read_trials(spark, str(tmp_path / "files"), layout="files"), str(tmp_path / "table"))
    for layout, bad in (("files", 4), ("table", 0)):
        root = str(tmp_path / layout)
        for quarantine, read in ((False, log.read_trials), (True, log.quarantined_trials)):
            out = str(tmp_path / f"{layout}-{quarantine}")
            rows = log.stream_trial_log(spark, root, ["bandit"], ["base", "p1"], layout, 1, quarantine)
            query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start(out)
            query.awaitTermination()
            got = spark.read.schema(rows.schema).parquet(out)
            want = read(spark, root, ["bandit"], ["base", "p1"], layout)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            assert got.count() == (bad if quarantine else 10)
            if layout == "files":  # files of the other system are never read
                assert sum(p["numInputRows"] for p in query.recentProgress) == 2 * 8


def write_template(folder, name, question, answer=""):
    (folder / f"{name}.json").write_text(json.dumps(
        {"question": "q", "answer": "a", "id_orig": 1, "question_annotated": question, "answer_annotated": answer}))


def test_templates_from_files(spark, tmp_path):
    write_template(
        tmp_path, "0001",
        "{name,Ann} saw {n,3} birds and {f_text,half} of {m,8} fish at {place,home}.\n\n#init:\n- $n = range(2, 10, 2)\n"
        "- $m = [8, 16]\n- name = sample(names)\n- f = sample(fractions)\n\n#conditions:\n- n > 4\n\n#answer: n + m",
        "It is {n + m}.",
    )
    (tmp_path / "0002.json").write_text("{not json")
    parsed, bad = templates.read_templates(spark, str(tmp_path), "p1")
    assert bad.count() == 1
    t = parsed.first()
    assert t["template_id"] == "p1_0001" and t["conditions"] == ["n > 4"] and t["formula"] == "n + m"
    kinds = {v["name"]: (v["kind"], v["lo"], v["hi"], v["step"], v["collection"], v["default"]) for v in t["variables"]}
    assert kinds["n"] == ("range", 2, 10, 2, None, "3") and kinds["m"][4] == "[8, 16]" and kinds["place"][5] == "home"
    instances = templates.instance_table(parsed, 40)
    records = templates.build_variant(instances, templates.compile_templates(parsed), "p1")
    rows = records.collect()
    assert len(rows) == 40 and templates.unmet(instances, records).count() == 0
    for r in rows:
        assert " birds" in r["question"] and r["answer"].endswith(f"#### {r['final_answer']}")
        assert "{" not in r["question"] and "fish at home." in r["question"]
        assert any(w in r["question"] for w in lx.SAMPLE_COLLECTIONS["fractions"])
    assert records.select("question").distinct().count() > 10


def compiled(spark, *rows):
    return templates.compile_templates(templates.template_rows(spark, rows))


def test_instances_without_a_fit(spark):
    x = Variable("x", "range", 1, 5)
    odd = [
        Template("never", "{x}", [x], "x", ["x > 9"]),
        Template("no_formula", "{x}", [x], ""),
        Template("not_allowed", "{x}", [x], "__import__('os')"),
        Template("unknown", "{x}", [x], "x + z"),
        Template("zero", "{x}", [x], "x / (x - x)"),
        Template("text", "{w}", [Variable("w", "sample", items=["a", "b"])], "w + 1"),
        Template("negative", "{x}", [x], "-x"),
    ]
    fine = Template("fine", "{x} {w, none} {x +} {y,7} {x * 2}", [x], "x", ["not x == 3 or x > 4"])
    parsed = templates.template_rows(spark, [*odd, fine])
    ready = templates.compile_templates(parsed)
    instances = templates.instance_table(parsed, 1_005)
    records = templates.build_variant(instances, ready, "base").collect()
    assert {r["template_id"] for r in records} == {"fine"} and len(records) == 1_005
    assert all(r["question"] == f"{r['final_answer']} none x + 7 {2 * int(r['final_answer'])}" and r["final_answer"] != "3" for r in records)
    failed = templates.unmet(instances, templates.build_variant(instances, ready, "base"))
    assert failed.groupBy("template_id").count().count() == 7
    errors = {r["template_id"] for r in ready.filter("error is not null").collect()}
    assert errors == {"not_allowed", "unknown"}


def test_compiled_steps_agree_with_python(spark):
    rng = np.random.default_rng(2)
    names = ["a", "b", "c"]
    formulas = [
        "a + b * c", "(a - b) ** 2", "a // b + a % b", "abs(a - b) / c", "min(a, b, c) + max(a, b)", "round(a / c, 1)", "int(a / c)",
        "float(a) - 2.5", "a - -b", "round(a / b)",
    ]
    conditions = ["a < b <= c", "not a == b and c != 1", "a > 5 or b > 5", "divides(a, b)", "is_int(a / b)", "a >= b or a / (a - b) < 0", "True"]
    rows, want = [], {}
    for i in range(60):
        f, c = formulas[i % len(formulas)], conditions[i % len(conditions)]
        values = {n: int(v) for n, v in zip(names, rng.integers(1, 12, 3))}
        rows.append(Template(f"t{i}", "{a}", [Variable(n, "range", v, v) for n, v in values.items()], f, [c]))
        scope = values | {"is_int": lambda x: x == int(x), "divides": lambda x, y: y % x == 0}
        try:
            answer = eval(f, {"__builtins__": {}}, scope | {"abs": abs, "min": min, "max": max, "round": round, "int": int, "float": float})
            holds = eval(c, {"__builtins__": {}}, scope)
        except ZeroDivisionError:
            holds = False
        if holds and 0 <= answer <= checks.MAX_ANSWER:
            want[f"t{i}"] = float(answer)
    parsed = templates.template_rows(spark, rows)
    made = templates.generate_instances(templates.instance_table(parsed, 1), templates.compile_templates(parsed), attempts=1)
    got = {r["template_id"]: r["final_answer"] for r in made.collect() if r["attempt"] is not None}
    assert got == pytest.approx(want) and len(want) > 20


def test_plan_does_not_grow_with_the_templates(spark):
    def plan(n):
        rows = [Template(f"t{i}", f"{{x}} things {i}", [Variable("x", "range", 1, 9)], f"x + {i}", [f"x > {i % 5}"]) for i in range(n)]
        parsed = templates.template_rows(spark, rows)
        made = templates.build_variant(templates.instance_table(parsed, 3), templates.compile_templates(parsed), "base")
        text = made._jdf.queryExecution().analyzed().toString()
        return len(re.sub(r"#\d+L?", "", text)), made

    few, many = plan(4), plan(400)
    assert many[0] <= few[0] * 1.02
    assert many[1].count() == 1_200


def test_corpus_job(spark, tmp_path):
    parsed = {v: templates.template_rows(spark, rows) for v, rows in (("base", TEMPLATES), ("p1", TEMPLATES[:2]))}
    out = str(tmp_path)
    parts = corpus.build_corpus(spark, parsed, out, ["p1", "noop"], instances=6)
    assert list(parts) == ["base", "p1", "noop"]
    stats = corpus.corpus_stats(spark, parts, out)
    got = {r["variant"]: r.asDict() for r in stats.collect()}
    assert got["base"]["instances_generated"] == got["noop"]["instances_generated"] == 24
    assert got["p1"]["templates_loaded"] == 2 and all(r["validation_errors"] == r["instances_failed"] == 0 for r in got.values())
    assert spark.read.json(f"{out}/summary").filter("variant = 'total'").first()["instances_generated"] == 60
    base, noop = (datasets.read_dataset(spark, parts[v].path) for v in ("base", "noop"))
    assert checks.noop_invariant(base, noop).filter("not holds").count() == 0
    assert noop.filter("question = original_question").count() == 0
    assert base.first()["canary"] == tx.CANARY
    ready = templates.compile_templates(parsed["base"])
    again = templates.build_variant(templates.instance_table(parsed["base"], 6).repartition(5), ready, "base")
    assert {r["question"] for r in again.collect()} == {r["question"] for r in base.collect()}


def written(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*") if f.is_file()}


def test_corpus_job_goes_on_where_it_stopped(spark, tmp_path):
    parsed = {v: templates.template_rows(spark, TEMPLATES[:2]) for v in ("base", "p1", "p2")}
    out = str(tmp_path)
    first = corpus.build_corpus(spark, parsed, out, ["base", "p2"], instances=4)
    before = written(tmp_path)
    every = corpus.build_corpus(spark, parsed, out, instances=4)
    after = written(tmp_path)
    assert before.items() <= after.items() and first.items() <= every.items()
    # the same rows in another order are the same input; nothing is written
    shuffled = {v: t.orderBy(F.desc("template_id")) for v, t in parsed.items()}
    assert corpus.build_corpus(spark, shuffled, out, instances=4) == every
    assert written(tmp_path) == after
    # other inputs go beside the first ones, and only what depends on them is built
    changed = parsed | {"base": templates.template_rows(spark, TEMPLATES[1:3])}
    other = corpus.build_corpus(spark, changed, out, instances=4)
    assert other["p1"] == every["p1"] and other["base"].path != every["base"].path and other["noop"].path != every["noop"].path
    assert after.items() <= written(tmp_path).items()
    # a part that lost records is built again, and so is one whose entry was not committed
    for f in Path(every["p1"].path).glob("part-*"):
        f.write_text("")
    for f in Path(corpus._manifest_path(out, "p2", every["p2"].fingerprint)).glob("*"):
        f.write_text("")
    assert corpus.build_corpus(spark, parsed, out, instances=4) == every
    assert corpus.read_corpus(spark, every).groupBy("variant").count().count() == 4
    with pytest.raises(ValueError, match="unknown variants"):
        corpus.build_corpus(spark, parsed, out, ["p3"])


def test_names_run_out_quietly(spark):
    names = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1), ("A", 1)], "name string, block int")
    slots = spark.createDataFrame([(p, i) for p in (1, 2) for i in range(5)], "problem_id int, slot int")
    rows = corpus.assign_names(slots, names, blocks=2).collect()
    for p in (1, 2):
        given = [r["name"] for r in rows if r["problem_id"] == p]
        assert sorted(x for x in given if x) == ["A", "B", "C"] and given.count(None) == 2


def test_policy_state_survives_a_replay(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(a), float(x @ [1, 2] + a), [float(v) for v in x]) for a, x in zip(rng.integers(0, 2, 200), rng.normal(size=(200, 2)))]
    logged = spark.createDataFrame(rows, "logged_action int, logged_cost double, features array<double>")
    logged.repartition(3).write.json(str(tmp_path / "in"))
    for attempt in ("first", "replayed"):  # a fresh checkpoint replays the same batch numbers
        source = stream.stream_source(spark, str(tmp_path / "in"), logged.schema, 2)
        stream.stream_policy(source, str(tmp_path / "state"), str(tmp_path / attempt)).awaitTermination()
    weights = routing.fit_from_moments(spark.read.parquet(str(tmp_path / "state")).drop("batch_id"), 2)
    whole = routing.fit_from_moments(routing.policy_moments(logged), 2)
    for a in (0, 1):
        np.testing.assert_allclose(weights[a], whole[a], atol=1e-8)
        np.testing.assert_allclose(weights[a], [a, 1, 2], atol=1e-5)


def test_readers_always_see_a_whole_version(spark, tmp_path):
    table = str(tmp_path / "summary")
    with pytest.raises(ValueError, match="published"):
        stream.read_current(spark, table)
    first = spark.range(5).toDF("n")
    stream.publish(first, table, "a", 0)
    reader = stream.read_current(spark, table)
    seen = []
    for batch in range(1, 7):
        # what a reader holds stays readable while the next versions come in
        path = stream.publish(spark.range(10 * batch).toDF("n"), table, "a", batch)
        if batch <= stream.KEEP_VERSIONS:
            seen.append(reader.count())
        assert stream.read_current(spark, table).count() == 10 * batch
        # a batch published before is not written again
        assert stream.publish(first, table, "a", batch) == path
    assert set(seen) == {5}
    # a version that is written but not published is not read
    spark.range(3).toDF("n").write.parquet(f"{table}/versions/999999999999-a-9")
    assert stream.read_current(spark, table).count() == 60
    # another query starts its numbers anew and goes behind the last version
    stream.publish(first, table, "b", 0)
    assert stream.read_current(spark, table).count() == 5
    assert len(list((tmp_path / "summary" / "published").iterdir())) == stream.KEEP_VERSIONS + 1
    assert len(list((tmp_path / "summary" / "versions").iterdir())) == stream.KEEP_VERSIONS + 2


def test_resume_keeps_no_state(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(300).select(
        F.when(F.col("id") % 50 > 0, (F.col("id") % 200).cast("string")).alias("problem_id"), F.lit("s").alias("system"),
        F.lit("base").alias("variant"), F.lit(True).alias("correct"),
    )
    for run, part in enumerate((rows.filter("problem_id < '15'"), rows, rows.limit(100))):
        part.repartition(3).write.mode("append").json(source)
        checkpoint = str(tmp_path / ("lost" if run == 2 else "check"))  # the last run starts without its checkpoint
        query = stream.stream_resume(stream.stream_source(spark, source, rows.schema, 2), out, checkpoint)
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]
    got = spark.read.parquet(out)
    assert got.count() == got.select("problem_id").distinct().count() == rows.select("problem_id").distinct().count()


# --- plans -------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_variant_filter_prunes_partitions(spark, tmp_path):
    t = view(spark, SF, "trials").select("system", "variant", "problem_id", "correct", "path_taken")
    log.write_trials(t, str(tmp_path))
    text = plan(checks.select_variant(spark.read.schema(t.schema).json(str(tmp_path)), "noop"))
    assert "PartitionFilters: [isnotnull(variant" in text


def test_text_operators_stay_out_of_python(spark):
    docs = table(spark, SF, "documents")
    for df in (tx.with_explicit_features(docs), tx.with_semantic_features(docs), tx.with_topics(docs),
               docs.select(tx.answer_cot(F.col("text")), tx.extract_code_block(F.col("text")))):
        assert "Python" not in plan(df) and "EvalPython" not in plan(df)
    assert plan(tx.with_topics(docs)).count("lower(text") <= 2


def test_latest_record_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(pairs.latest_by_id(view(spark, SF, "raw"), order=["l_shipdate", "l_linenumber"]))


def test_pairs_take_one_shuffle(spark):
    t = spark.range(10).selectExpr("'a' system", "'base' variant", "id problem_id", "id > 3 correct")
    text = plan(pairs.paired(t, "a", "b"))
    assert text.split("===")[0].count("Exchange\n") + text.count("hashpartitioning") <= 3 and "SortMergeJoin" not in text
