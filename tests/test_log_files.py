"""The log of ``<system>/<variant>.jsonl``: files written, lines parsed, names taken from paths."""

import json
from pathlib import Path

import pytest
from trialmill.plans import q_io
from trialmill.sources import trials as log

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("layout", ["files", "table"])
@pytest.mark.parametrize("read", [log.read_trials, log.quarantined_trials])
def test_a_line_is_parsed_once(spark, tmp_path, read, layout):
    folder = tmp_path / ("bandit" if layout == "files" else "system=bandit/variant=base")
    folder.mkdir(parents=True)
    (folder / "base.jsonl").write_text(json.dumps({"problem_id": "1", "path_taken": "slow"}) + "\n")
    rows = read(spark, str(tmp_path), ["bandit"], ["base"], layout)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_a_folder_gets_few_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        root = Path(q_io._files(spark, SF))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [f.parent for f in root.rglob("part-*")]
    folders = set(held)
    # one with the rows, others with the odd lines
    assert len(folders) > 8 and len(held) <= 2 * len(folders)


def test_names_of_files_and_folders(spark, tmp_path):
    line = json.dumps({"problem_id": "1", "path_taken": "slow"})
    made = {"a/x.jsonl": ("a", "x"), "b/x.jsonl/part-0.txt": ("b", "x"), "c/x.jsonl/part.jsonl": ("c", "x"), "d.jsonl.d/y.jsonl": ("d.jsonl.d", "y"), "a/z.jsonl.jsonl": ("a", "z.jsonl")}
    for path in made:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(line)
    rows = log.read_trials(spark, str(tmp_path), ["a", "b", "c", "d.jsonl.d"], ["x", "y", "z.jsonl"], "files").collect()
    assert sorted((r["system"], r["variant"]) for r in rows) == sorted(made.values())
