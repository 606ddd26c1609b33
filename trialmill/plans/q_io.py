"""Source, sink and streaming queries: each writes rows of the bundled tables to scratch space and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import routing
from ..session import drop_path, scratch_path, shuffles_dropped
from ..sources import datasets, trials as log
from ..streaming import stream
from .fixtures import cte, table, view
from .q_metrics import _RUN
from .q_routing import _LOG, L, labels
from .q_text import _PATTERNS, _scrub_sql
from .registry import add, rounded

T = cte("trials")
_COLS = (
    "problem_id, template_id, variant, system, ground_truth, path_taken, final_answer, correct, tokens_input, "
    "tokens_output, execution_time_ms, iterations, error_type, self_corrected, bandit_probability"
)
COLS = _COLS.split(", ")


def trial_records(s, d):
    return view(s, d, "trials").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).select(
        *COLS, "timestamp"
    )


def _written(s, d):
    root = scratch_path(s, "trials")
    log.write_trials(trial_records(s, d), root)
    return root


_BACK = f"{T} SELECT {_COLS}, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM trials"
add("a1_read_trials", lambda s, d: log.read_trials(s, _written(s, d)).select(*COLS, "timestamp"), _BACK)


def _files(s, d):
    """The log in the layout ``<system>/<variant>.jsonl``: each file with a blank line, a broken one, one mistyped and one
    without an id."""
    root, records = scratch_path(s, "files"), scratch_path(s, "records")
    rows = trial_records(s, d)
    # a folder's rows meet in a few tasks, or every task writes a file for every folder
    files = max(1, int(s.conf.get("spark.sql.shuffle.partitions")) // (len(lx.SYSTEMS) * len(lx.VARIANTS)))
    with shuffles_dropped(s):
        # the narrow rows are dealt, not the lines, when nothing that was shuffled for them is left
        rows.write.parquet(records)
        dealt = s.read.schema(rows.schema).parquet(records).repartition("system", "variant", F.pmod(F.xxhash64("problem_id"), F.lit(files)))
        lines = dealt.withColumn("question", F.concat(F.lit("How many? "), F.repeat("problem_id", F.lit(40))))
        good = lines.select("system", "variant", F.to_json(F.struct("*")).alias("value"))
        # one folder a file; the reader takes the last two parts of the path
        named = good.select(F.col("system").alias("s"), F.concat("variant", F.lit(".jsonl")).alias("f"), "value")
        named.write.partitionBy("s", "f").option("compression", "gzip").text(root)
    drop_path(s, records)
    odd = F.array(
        F.lit(""), F.lit("{broken"), F.lit('{"problem_id": "x", "path_taken": "slow", "tokens_input": "many"}'), F.lit('{"path_taken": "slow"}')
    )
    # the folders by their names: the rows are not made or read a second time
    folders = s.read.format("binaryFile").load(root).select("s", "f").distinct()
    extra = folders.select("s", "f", F.explode(odd).alias("value"))
    extra.write.mode("append").partitionBy("s", "f").option("compression", "gzip").text(root)
    return root


def _file_log(s, d, read):
    """Partition folders ``s=<system>/f=<variant>.jsonl`` under the names of the plain layout."""
    return read(s, _files(s, d), [f"s={x}" for x in lx.SYSTEMS], [f"f={x}" for x in lx.VARIANTS], "files")


def _plain(df):
    return df.withColumn("system", F.substring_index("system", "=", -1)).withColumn("variant", F.substring_index("variant", "=", -1))


add(
    "a1_read_trial_files",
    lambda s, d: _plain(_file_log(s, d, log.read_trials)).select(*COLS, "timestamp", F.length("question").alias("question_length")),
    f"""{T} SELECT {_COLS}, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 10 + 40 * length(problem_id) AS question_length
    FROM trials""",
)


def _streamed(s, d):
    """The same files as a stream, a few at a time, with one system left out; each batch appended to a table."""
    out, check = scratch_path(s, "streamed"), scratch_path(s, "check")
    root = _files(s, d)
    kept = [f"s={x}" for x in lx.SYSTEMS if x != "random"]
    rows = log.stream_trial_log(s, root, kept, [f"f={x}" for x in lx.VARIANTS], "files", files_per_batch=7)
    rows.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    return s.read.parquet(out)


add(
    "a1_stream_trial_files",
    lambda s, d: _plain(_streamed(s, d)).select(*COLS, "timestamp", F.length("question").alias("question_length")),
    f"""{T} SELECT {_COLS}, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 10 + 40 * length(problem_id) AS question_length
    FROM trials WHERE system <> 'random'""",
)
add(
    "a1_quarantined_trials",
    lambda s, d: _plain(_file_log(s, d, log.quarantined_trials)).groupBy("system", "variant").agg(
        F.count("*").alias("n_bad"), F.count("problem_id").alias("n_with_id"), F.count_if(F.col("line") == "{broken").alias("n_broken")),
    f"""{T} SELECT system, variant, 3 AS n_bad, 1 AS n_with_id, 1 AS n_broken FROM trials GROUP BY 1, 2""",
)


def _appended(s, d):
    """Two writes, the second appending the distractor variant."""
    root, rows = scratch_path(s, "trials"), trial_records(s, d)
    log.write_trials(rows.filter("variant <> 'noop'"), root)
    log.write_trials(rows.filter("variant = 'noop'"), root, append=True)
    return log.read_trials(s, root).select(*COLS, "timestamp")


add("a2_write_trials", _appended, _BACK)


def _dataset(s, d, append):
    path = scratch_path(s, "dataset")
    p = view(s, d, "problems").withColumn("instance", F.col("instance").cast("int")).withColumn("variant", F.lit("base"))
    records = tx.attach_canary(p.withColumn("is_noop", F.lit(False)))
    if append:
        datasets.write_dataset(records.filter("instance % 2 = 0"), path)
        datasets.write_dataset(records.filter("instance % 2 = 1"), path, append=True)
    else:
        datasets.write_dataset(records, path)
    return datasets.read_dataset(s, path).select("id", "question", "answer", "final_answer", "final_number", "instance", "canary")


_DATA = f"""{cte("problems")} SELECT id, question, answer, final_answer, CAST(final_answer AS DOUBLE) AS final_number,
    CAST(instance AS INT) AS instance, '{tx.CANARY}' AS canary FROM problems"""
add("a3_read_dataset", lambda s, d: _dataset(s, d, False), _DATA)
add("a4_write_dataset", lambda s, d: _dataset(s, d, True), _DATA)


def _pilot(s, d):
    path = scratch_path(s, "pilot")
    t = trial_records(s, d)
    routed = t.filter("system = 'bandit'").select(
        "problem_id", "variant", F.concat(F.lit("Problem "), "problem_id").alias("question"),
        F.col("ground_truth").alias("expected_answer"), F.col("final_answer").alias("predicted_answer"), "correct",
        "path_taken", F.col("bandit_probability").alias("routing_prob"), F.col("execution_time_ms").alias("latency_ms"),
        F.col("error_type").alias("error"),
    )
    routed.write.json(path)
    both = log.union_logs(t.filter("system = 'random'"), log.read_pilot_log(s, path))
    return both.select("system", "problem_id", "variant", "final_answer", "correct", "path_taken", "bandit_probability",
                       "execution_time_ms", "error_type", "tokens_input")


add(
    "a6_read_pilot_log",
    _pilot,
    f"""{T} SELECT system, problem_id, variant, final_answer, correct, path_taken, bandit_probability, execution_time_ms,
    error_type, CASE WHEN system = 'random' THEN tokens_input END AS tokens_input FROM trials WHERE system IN ('random', 'bandit')""",
)


def _labels(s, d):
    path = scratch_path(s, "labels")
    datasets.save_labels(labels(s, d), path)
    rows, stats = datasets.load_labels(s, path)
    total = stats.filter("variant = 'overall'").select(F.col("total").alias("saved_total"))
    return rows.select("variant", "problem_id", "oracle_action", "oracle_reason").crossJoin(F.broadcast(total))


add(
    "a7_labels_round_trip",
    _labels,
    f"""{L} SELECT variant, problem_id, oracle_action, oracle_reason, (SELECT count(*) FROM labels_v) AS saved_total FROM labels_v""",
)


def _bandit_text(s, d):
    path = scratch_path(s, "examples")
    logged = routing.simulate_logging(labels(s, d))
    line = F.concat(F.lit("|x "), F.col("problem_id"), F.lit(":1"))
    examples = routing.bandit_example(line, F.col("logged_action"), F.col("logged_cost"), F.col("propensity"))
    datasets.write_bandit_text(logged.select(examples.alias("example")), path)
    return datasets.read_bandit_text(s, path)


add(
    "a8_write_bandit_text",
    _bandit_text,
    f"""{L}, {_LOG} SELECT concat('shared |x ', problem_id, ':1', chr(10), CASE logged_action WHEN 0 THEN concat('0:',
      CAST(logged_cost AS VARCHAR), ':', CAST(propensity AS VARCHAR), ' ') ELSE '' END, '|a fast', chr(10),
    CASE logged_action WHEN 1 THEN concat('1:', CAST(logged_cost AS VARCHAR), ':', CAST(propensity AS VARCHAR), ' ') ELSE '' END,
      '|a slow') AS example FROM logged""",
)


def spans(s, d):
    """Conversation turns as trace spans, dated by their number."""
    c = table(s, d, "conversations")
    # wall-clock time, so the session's time zone does not matter
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, conv_id * 43200 + turn * 60)")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("role").alias("name"),
        F.lit("chain").alias("run_type"),
        F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", F.col("turn") - 1)).alias("parent_id"),
        F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"),
        F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss").alias("end_time"),
        F.create_map(F.lit("text"), F.concat(F.lit('token = "abc123" key-'), F.md5("text"), F.lit(" "), F.col("text"))).alias(
            "inputs"
        ),
        F.create_map(F.lit("text"), F.col("text")).alias("outputs"),
    )


def _span_rows(df):
    return df.select(
        "id", "parent_id", "start_time", F.md5(F.col("inputs")["text"]).alias("input"), F.md5(F.col("outputs")["text"]).alias("output"),
        F.concat_ws("/", *[F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("year", 4), ("month", 2), ("day", 2))]).alias("folder"),
    )


_SPANS = f"""WITH c AS (SELECT *, make_timestamp((1704067200 + conv_id * 43200 + turn * 60) * 1000000) AS at_ FROM conversations)
    SELECT concat(conv_id, '-', turn) AS id, CASE WHEN turn > 0 THEN concat(conv_id, '-', turn - 1) END AS parent_id,
    strftime(at_, '%Y-%m-%dT%H:%M:%S') AS start_time,
    md5({_scrub_sql("concat('token = " + chr(34) + "abc123" + chr(34) + " key-', md5(text), ' ', text)")}) AS input,
    md5({_scrub_sql("text")}) AS output, strftime(at_, '%Y/%m/%d') AS folder FROM c"""


def _spans_back(s, d):
    base = scratch_path(s, "spans")
    datasets.write_spans(spans(s, d), base, _PATTERNS)
    return _span_rows(datasets.read_spans(s, base))


add("a10_write_spans", _spans_back, _SPANS)
add(
    "a11_read_spans",
    lambda s, d: _spans_back(s, d).groupBy("folder").agg(F.count(F.lit(1)).alias("n")),
    f"WITH sp AS ({_SPANS}) SELECT folder, count(*) AS n FROM sp GROUP BY 1",
)

# --- streams ------------------------------------------------------------------------------------


def _arrivals(s, rows, least):
    """Rows as JSON files, and how many there are: so many at least, more where the session deals rows to more tasks."""
    root, files = scratch_path(s, "arrivals"), max(least, int(s.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(files).write.option("compression", "gzip").json(root)
    return root, files


def _running(s, d):
    """The log arrives in two halves."""
    (root, files), out, check = _arrivals(s, trial_records(s, d), 4), scratch_path(s, "running"), scratch_path(s, "check")
    source = stream.stream_source(s, root, files_per_batch=(files + 1) // 2)
    stream.stream_trials(source, out, check).awaitTermination()
    return stream.read_current(s, out)


add("k1_stream_trials", _running, f"{T} SELECT system, variant, {_RUN} FROM trials GROUP BY system, variant")


def _resumed(s, d):
    """A first run sees part of the log; a restart sees the rest and a full second copy."""
    root, out, check = scratch_path(s, "arrivals"), scratch_path(s, "resumed"), scratch_path(s, "check")
    rows = trial_records(s, d)
    rows.filter("variant = 'base'").write.option("compression", "gzip").json(root)
    for more in (None, rows):
        if more is not None:
            more.write.mode("append").option("compression", "gzip").json(root)
        stream.stream_resume(stream.stream_source(s, root), out, check).awaitTermination()
    return s.read.parquet(out).select("system", "variant", "problem_id", "correct")


add("k2_stream_resume", _resumed, f"{T} SELECT system, variant, problem_id, correct FROM trials")


def _learned(s, d):
    state, check = scratch_path(s, "moments"), scratch_path(s, "check")
    logged = routing.simulate_logging(labels(s, d))
    features = F.array((F.col("variant") == "base").cast("double"), F.length("problem_id").cast("double"))
    rows = logged.select("logged_action", "logged_cost", features.alias("features"))
    root, files = _arrivals(s, rows, 4)
    source = stream.stream_source(s, root, "logged_action int, logged_cost double, features array<double>", (files + 1) // 2)
    stream.stream_policy(source, state, check).awaitTermination()
    kept = s.read.parquet(state).groupBy("action", "i", "j").agg(F.sum("total").alias("total"))
    return rounded(kept, 6)


add(
    "k3_stream_policy",
    _learned,
    f"""{L}, {_LOG}, x AS (SELECT logged_action AS action, [1e0, CASE WHEN variant = 'base' THEN 1e0 ELSE 0e0 END,
      CAST(length(problem_id) AS DOUBLE)] AS v, logged_cost AS c FROM logged)
    SELECT action, CAST(i AS INT) AS i, CAST(j AS INT) AS j, sum(v[i + 1] * CASE WHEN j = 3 THEN c ELSE v[j + 1] END) AS total
    FROM x, range(3) a(i), range(4) b(j) GROUP BY 1, 2, 3""",
)


def _scrubbed(s, d):
    (root, _), out, check = _arrivals(s, spans(s, d), 3), scratch_path(s, "spans"), scratch_path(s, "check")
    stream.stream_scrub(stream.span_source(s, root), out, check, _PATTERNS).awaitTermination()
    return _span_rows(datasets.read_spans(s, out))


add("k4_stream_scrub", _scrubbed, _SPANS)
