"""Views that shape the bundled star-schema tables into trial logs, corpora and fact tables.

Each view is one SQL text that both engines accept.  ``{name}`` marks an input
table: Spark binds it to a DataFrame, the oracle to the registered view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import running
from ..session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_RAW = """
raw AS (
  SELECT CAST(o.o_orderkey AS VARCHAR(20)) AS problem_id,
         CAST(o.o_custkey % 100 AS VARCHAR(10)) AS template_id,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'base' WHEN '2-HIGH' THEN 'p1'
              WHEN '3-MEDIUM' THEN 'p2' ELSE 'noop' END AS variant,
         CASE (l.l_linenumber - 1) % 5 WHEN 0 THEN 'baseline_large' WHEN 1 THEN 'baseline_small'
              WHEN 2 THEN 'fixed_slow' WHEN 3 THEN 'bandit' ELSE 'random' END AS system,
         (l.l_partkey * 7 + l.l_suppkey * 13 + l.l_orderkey) % 100 AS draw,
         l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_linestatus, l.l_quantity,
         l.l_extendedprice, l.l_shipdate
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey)"""

_TRIALS = """
dedup AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY system, variant, problem_id
      ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM raw),
thr AS (
  SELECT * FROM (VALUES
   ('baseline_large',59,52,50,56),('baseline_small',45,45,37,41),('fixed_slow',80,66,49,76),
   ('bandit',66,43,25,64),('random',68,43,24,63)) AS t(sys,b,p1,p2,n)),
scored AS (
  SELECT d.*, draw < CASE variant WHEN 'base' THEN b WHEN 'p1' THEN p1 WHEN 'p2' THEN p2 ELSE n END AS correct,
         CASE WHEN system IN ('baseline_large','baseline_small') THEN 'baseline'
              WHEN system = 'fixed_slow' OR l_linestatus = 'O' THEN 'slow' ELSE 'fast' END AS path_taken
  FROM dedup d JOIN thr ON d.system = thr.sys WHERE rn = 1),
trials AS (
  SELECT problem_id, template_id, variant, system, path_taken, correct,
         CAST(FLOOR(l_quantity) AS INT) AS ground_truth,
         CAST(CASE WHEN correct THEN FLOOR(l_quantity) WHEN l_partkey % 10 = 0 THEN NULL
              ELSE FLOOR(l_quantity) + 1 + l_partkey % 5 END AS INT) AS final_answer,
         CAST(50 + l_partkey % 400 AS INT) AS tokens_input,
         CAST(20 + l_suppkey % 300 AS INT) AS tokens_output,
         FLOOR(l_extendedprice) * 1.0E0 AS execution_time_ms,
         CAST(CASE WHEN path_taken = 'slow' THEN 1 + l_partkey % 5 ELSE 0 END AS INT) AS iterations,
         CASE WHEN correct THEN NULL WHEN path_taken = 'slow' AND l_suppkey % 3 = 0 THEN 'cycle_detected'
              WHEN l_suppkey % 11 = 0 THEN 'UNSAT' WHEN l_suppkey % 13 = 0 THEN 'TIMEOUT'
              WHEN l_suppkey % 17 = 0 THEN 'MAX_RETRIES: TIMEOUT' END AS error_type,
         path_taken = 'slow' AND l_partkey % 5 > 0 AND correct AS self_corrected,
         CASE WHEN system IN ('bandit','random') THEN (50 + (l_linenumber * 7) % 50) / 100.0E0 END
           AS bandit_probability,
         l_shipdate AS ts
  FROM scored)"""

_LABELS = """
labels_v AS (
  SELECT f.variant, f.problem_id, f.ground_truth, f.final_answer AS fast_answer, f.correct AS fast_correct,
         s.final_answer AS slow_answer, s.correct AS slow_correct,
         CASE WHEN s.correct AND NOT f.correct THEN 'slow' ELSE 'fast' END AS oracle_action,
         CASE WHEN f.correct AND s.correct THEN 'both_correct' WHEN s.correct THEN 'only_slow_correct'
              WHEN f.correct THEN 'only_fast_correct' ELSE 'both_wrong' END AS oracle_reason
  FROM trials f JOIN trials s ON f.variant = s.variant AND f.problem_id = s.problem_id
  WHERE f.system = 'baseline_small' AND s.system = 'fixed_slow')"""

_RESPONSES = """
responses AS (
  SELECT o_orderkey AS id, n AS expected,
       CASE o_orderkey % 6 WHEN 0 THEN concat('First 3 then 4. #### ', CAST(n AS VARCHAR(20)))
            WHEN 1 THEN concat('We see the answer is: ', CAST(n AS VARCHAR(20)))
            WHEN 2 THEN concat('total = ', CAST(n AS VARCHAR(20)))
            WHEN 3 THEN concat('Steps. ANSWER: ', CAST(n AS VARCHAR(20)), '.5')
            WHEN 4 THEN concat('#### ', CAST(n AS VARCHAR(20)), ',250 units')
            ELSE 'I cannot solve this problem.' END AS response
  FROM (SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) % 2000 - 500 AS n FROM {orders}) t)"""

_PROBLEMS = """
problems AS (
  SELECT concat('base_', CAST(o_custkey % 100 AS VARCHAR(10)), '_', CAST(o_orderkey AS VARCHAR(20))) AS id,
       CAST(o_custkey % 100 AS VARCHAR(10)) AS template_id, o_orderkey AS instance,
       concat('A shop has ', CAST(a AS VARCHAR(20)), ' apples. ',
              CASE WHEN o_orderkey % 3 = 0 THEN 'Rain falls all day. ' ELSE '' END,
              'It sells ', CAST(b AS VARCHAR(20)), ' of them. How many apples are left?') AS question,
       CASE WHEN o_orderkey % 41 = 0 THEN 'no marker' ELSE concat(CAST(a AS VARCHAR(20)), ' - ',
              CAST(b AS VARCHAR(20)), '
#### ', CAST(a - b AS VARCHAR(20))) END AS answer,
       CAST(a - b AS VARCHAR(20)) AS final_answer
  FROM (SELECT o_orderkey, o_custkey, CAST(FLOOR(o_totalprice) AS BIGINT) % 97 + 5 AS a, o_custkey % 23 AS b
        FROM {orders}) t)"""

_VOTES = """
vote_samples AS (
  SELECT concat(CAST(user_id AS VARCHAR(20)), '-', CAST(EXTRACT(DAY FROM ts) AS VARCHAR(4))) AS problem_id,
       ROW_NUMBER() OVER (PARTITION BY user_id, EXTRACT(DAY FROM ts) ORDER BY ts, event_id) AS sample_idx,
       CASE WHEN event_type <> 'error' THEN CAST(FLOOR(value / 25) AS INT) END AS answer,
       CAST(event_id % 300 + 20 AS INT) AS tokens_input, CAST(event_id % 90 + 5 AS INT) AS tokens_output
  FROM {events})"""

_ATTEMPTS = """
attempts AS (
  SELECT user_id AS problem_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
       props AS code, CASE event_type WHEN 'purchase' THEN 'success' ELSE event_type END AS result, ts
  FROM {events})"""

_OPS = """
ops AS (
  SELECT user_id % 30 AS problem_id, user_id AS entity, event_type AS attr,
       ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS step,
       CASE event_id % 5 WHEN 0 THEN 'add_to' WHEN 1 THEN 'sub_from' WHEN 2 THEN 'mul_by' WHEN 3 THEN 'div_by'
            ELSE 'set_to' END AS op,
       CASE event_id % 5 WHEN 2 THEN event_id % 3 + 1 WHEN 3 THEN event_id % 4 + 1
            ELSE CAST(ROUND(value * 100) AS BIGINT) END AS amount
  FROM {events}),
horizon AS (SELECT problem_id, MAX(step) + 1 AS max_step FROM ops GROUP BY problem_id)"""

_TRANSFERS = """
transfers AS (
  SELECT user_id % 30 AS problem_id, user_id AS src, (user_id * 7 + 1) % 150 AS dst, event_type AS item,
       CAST(ROUND(value * 100) AS BIGINT) AS amount, event_id % 499 AS step
  FROM {events})"""

_GIVEN = """
given_quantity AS (
  SELECT user_id % 30 AS problem_id, user_id AS entity, event_type AS item,
         MAX(CAST(ROUND(value * 100) AS BIGINT)) AS val
  FROM {events} GROUP BY 1, 2, 3)"""

_RELATIONS = """
links AS (
  SELECT c_custkey % 10 AS problem_id, (c_custkey - c_custkey % 10) / 10 AS node, c_nationkey FROM {customer}),
relations AS (
  SELECT problem_id, CASE WHEN CAST(node AS BIGINT) % 2 = 0 THEN 'multiple' ELSE 'percent' END AS kind,
         CAST(node AS BIGINT) AS entity, CAST(FLOOR(node / 2) AS BIGINT) AS other,
         CASE WHEN CAST(node AS BIGINT) % 2 = 0 THEN 1 + c_nationkey % 3 ELSE 50 + c_nationkey * 10 END AS amount
  FROM links WHERE node > 1),
root_values AS (
  SELECT problem_id, CAST(node AS BIGINT) AS entity, CAST(100 + problem_id AS BIGINT) AS val
  FROM links WHERE node = 1)"""

_STAFF = """
ledger_facts AS (
  SELECT user_id % 30 AS problem_id, user_id AS entity, event_type AS item, event_id,
         CAST(ROUND(value * 100) AS BIGINT) AS amount, event_id % 7 AS parts, event_id % 5 AS num, event_id % 6 AS den,
         (user_id * 7 + 1) % 150 AS other
  FROM {events})"""

_NAMES = """
names AS (
  SELECT CASE WHEN c_custkey % 7 = 0 THEN 'Sam' ELSE c_name END AS name, CAST(c_nationkey % 10 AS INT) AS block
  FROM {customer})"""

_SLOTS = """
slots AS (
  SELECT o_custkey AS problem_id, o_orderkey AS slot FROM {orders})"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), _RAW),
    "trials": (("raw",), _TRIALS),
    "labels_v": (("trials",), _LABELS),
    "responses": ((), _RESPONSES),
    "problems": ((), _PROBLEMS),
    "vote_samples": ((), _VOTES),
    "attempts": ((), _ATTEMPTS),
    "ops": ((), _OPS),
    "horizon": (("ops",), ""),
    "transfers": ((), _TRANSFERS),
    "given_quantity": ((), _GIVEN),
    "relations": ((), _RELATIONS),
    "root_values": (("relations",), ""),
    "ledger_facts": ((), _STAFF),
    "names": ((), _NAMES),
    "slots": ((), _SLOTS),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for dep in _closure(VIEWS[name][0]):
            if dep not in ordered:
                ordered.append(dep)
        if name not in ordered:
            ordered.append(name)
    return ordered


def cte(*names: str, recursive: bool = False) -> str:
    """``WITH ...`` text that defines the named views for the oracle."""
    texts = [VIEWS[n][1].strip() for n in _closure(names) if VIEWS[n][1]]
    body = ",\n".join(texts)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + re.sub(r"\{(\w+)\}", r"\1", body)


# tables with costly rows or large joins and windows on top
_HEAVY = {"documents", "conversations", "embeddings", "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in _HEAVY else df


# views that number the events of a user: key columns of the numbering and what follows from the number ``n``
_NUMBERED = {
    "vote_samples": (
        ["user_id", "day"],
        """SELECT concat(CAST(user_id AS VARCHAR(20)), '-', CAST(day AS VARCHAR(4))) AS problem_id, n AS sample_idx,
           CASE WHEN event_type <> 'error' THEN CAST(FLOOR(value / 25) AS INT) END AS answer,
           CAST(event_id % 300 + 20 AS INT) AS tokens_input, CAST(event_id % 90 + 5 AS INT) AS tokens_output FROM {e}""",
    ),
    "attempts": (
        ["user_id"],
        """SELECT user_id AS problem_id, n AS attempt, props AS code,
           CASE event_type WHEN 'purchase' THEN 'success' ELSE event_type END AS result, ts FROM {e}""",
    ),
    "ops": (
        ["user_id", "event_type"],
        """SELECT user_id % 30 AS problem_id, user_id AS entity, event_type AS attr, n - 1 AS step,
           CASE event_id % 5 WHEN 0 THEN 'add_to' WHEN 1 THEN 'sub_from' WHEN 2 THEN 'mul_by' WHEN 3 THEN 'div_by'
                ELSE 'set_to' END AS op,
           CASE event_id % 5 WHEN 2 THEN event_id % 3 + 1 WHEN 3 THEN event_id % 4 + 1
                ELSE CAST(ROUND(value * 100) AS BIGINT) END AS amount FROM {e}""",
    ),
}


def _numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The SQL views' ``ROW_NUMBER`` by distributed rank: one user may hold a third of the events."""
    keys, text = _NUMBERED[name]
    events = table(spark, sf_dir, "events").selectExpr("*", "EXTRACT(DAY FROM ts) AS day")
    return spark.sql(text, e=running(events, keys, ["ts", "event_id"], rank="n"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the parquet tables of ``sf_dir``."""
    if name in _NUMBERED:
        return _numbered(spark, sf_dir, name)
    if name == "horizon":
        return _numbered(spark, sf_dir, "ops").groupBy("problem_id").agg((F.max("step") + 1).alias("max_step"))
    texts = [VIEWS[n][1].strip() for n in _closure((name,)) if VIEWS[n][1]]
    body = ",\n".join(texts)
    inputs = {t: table(spark, sf_dir, t) for t in sorted(set(re.findall(r"\{(\w+)\}", body)))}
    return spark.sql(f"WITH {body} SELECT * FROM {name}", **inputs)
