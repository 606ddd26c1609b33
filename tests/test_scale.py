"""Shapes that must hold as tables grow: files a folder, where rows are worked on, what is read twice."""

import gzip
import re
from pathlib import Path

from pyspark.sql import functions as F

from trialmill.operators import templates
from trialmill.operators.templates import Template, Variable
from trialmill.plans import q_io, q_stats
from trialmill.sources import datasets
from trialmill.sources import trials as log
from trialmill.streaming import stream

SF = "/root/testdata/sf0.001"


def span_table(spark, day):
    return spark.range(400).repartition(8).select(
        F.col("id").cast("string").alias("id"), F.lit("x").alias("name"),
        F.date_format(F.timestamp_seconds(1704067200 + day * 86400 + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"),
        F.create_map(F.lit("text"), F.concat(F.lit("span "), F.col("id").cast("string"))).alias("inputs"),
    )


def test_a_day_is_written_by_few_tasks(spark, tmp_path):
    days, long_day = str(tmp_path / "days"), str(tmp_path / "long")
    datasets.write_spans(span_table(spark, F.col("id") % 20), days)
    assert len(list((tmp_path / "days").rglob("*.json"))) <= 20 + 8
    datasets.write_spans(span_table(spark, F.lit(0)), long_day)
    assert len(list((tmp_path / "long").rglob("*.json"))) > 4
    for path in (days, long_day):
        back = datasets.read_spans(spark, path)
        assert sorted(int(r["id"]) for r in back.collect()) == list(range(400))


def test_instances_stay_in_their_tasks(spark, tmp_path):
    """The planner takes exploded instances for few; sent to the templates, one task would make all instances of a template."""
    parsed = templates.template_rows(spark, [Template("t", "{x} and {y}", [Variable("x", "range", 1, 99), Variable("y", "range", 1, 99)], "x + y", ["divides(7, x)", "y > x"])])
    instances, compiled = templates.instance_table(parsed, 20_000), templates.compile_templates(parsed)
    for name, made in (
        ("variant", templates.build_variant(instances, compiled, "base")),
        ("drawn", templates.generate_instances(instances, compiled)),
        ("sampled", templates.sample_variables(instances, compiled)),
    ):
        made.select("instance").write.parquet(str(tmp_path / name))
        assert len(list((tmp_path / name).glob("*.parquet"))) > 4
    rows = templates.generate_instances(instances, compiled).select("attempt", "variables", "final_answer").collect()
    assert len(rows) == 20_000 and max(r["attempt"] for r in rows if r["attempt"] is not None) > 20
    for r in rows:
        if r["attempt"] is not None:
            x, y = int(r["variables"]["x"]), int(r["variables"]["y"])
            assert x % 7 == 0 and y > x and r["final_answer"] == x + y


def test_logs_are_written_packed_and_read_back(spark, tmp_path):
    rows = q_io.trial_records(spark, SF)
    log.write_trials(rows, str(tmp_path / "log"))
    log.write_trials(rows.limit(5), str(tmp_path / "log"), append=True)
    files = [f for f in (tmp_path / "log").rglob("part-*")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert log.read_trials(spark, str(tmp_path / "log")).count() == rows.count() + 5


def test_every_folder_of_the_file_log_has_its_odd_lines(spark):
    root = Path(q_io._files(spark, SF))
    lines = {}
    for f in root.rglob("part-*"):
        assert f.name.endswith(".txt.gz")
        lines.setdefault(f.parent, []).extend(gzip.decompress(f.read_bytes()).decode().split("\n")[:-1])
    trials = q_io.trial_records(spark, SF)
    assert len(lines) == trials.select("system", "variant").distinct().count()
    assert all(sum(x in ("", "{broken") for x in held) == 2 and len(held) > 4 for held in lines.values())
    assert sum(map(len, lines.values())) == trials.count() + 4 * len(lines)


def test_arrivals_follow_the_tasks_of_the_session(spark):
    root, files = q_io._arrivals(spark, spark.range(1000), 4)
    assert files == 8 == len(list(Path(root).glob("part-*.json.gz")))


def test_resume_takes_nulls_as_keys(spark, tmp_path):
    schema = "system string, variant string, problem_id string, n int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [("a", None, "1", 1), ("a", None, "1", 1), (None, None, None, 2), ("a", "", "1", 3)]
    for more in (first, [*first, ("b", None, "1", 4), (None, None, "1", 5)]):
        spark.createDataFrame(more, schema).write.mode("append").json(source)
        stream.stream_resume(stream.stream_source(spark, source, spark.createDataFrame([], schema).schema), out, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]


def test_overlap_draws_only_what_it_compares(spark):
    plan = q_stats._overlaps(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # nothing else reaches the replicates
    assert "variant#" in plan and re.search(r"Filter .* IN \(base,noop\)|Filter .*= base\).*= noop\)", plan.split("Generate")[1])
