"""Corpus queries: sampling, generation, rendering, names, distractors and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, corpus, metrics, templates
from ..operators.distractors import SENTENCES
from ..operators.templates import Template, Variable
from ..session import scratch_path, spread
from .fixtures import cte, table, view
from .q_text import _topics_sql, lx, objects_sql
from .registry import add

TEMPLATES = [
    Template(
        "t1",
        "{name} has {x} pens and buys {y} more. How many pens?",
        [Variable("x", "range", 5, 60), Variable("y", "range", 1, 40), Variable("name", "sample", items=["names"])],
        "x + y",
    ),
    Template(
        "t2",
        "{n} boxes share {x} pens equally. How many per box?",
        [Variable("x", "range", 10, 90), Variable("n", "range", 2, 9)],
        "x / n",
        ["divides(n, x)"],
    ),
    Template(
        "t3",
        "A bag of {x} loses {p} percent. How many stay?",
        [Variable("x", "range", 10, 200, 10), Variable("p", "sample", items=[10, 20, 50])],
        "x - x * p / 100",
        ["is_int(x * p / 100)"],
    ),
    Template(
        "t4",
        "{x} birds leave from {y}. How many stay?",
        [Variable("x", "range", 1, 50), Variable("y", "range", 1, 50)],
        "y - x",
        ["y > x"],
        "{y} - {x} = {y - x}",
    ),
]
SEED = 42


def compiled(s):
    return templates.compile_templates(templates.template_rows(s, TEMPLATES))


def instances(s, d):
    """Every part is an instance of every template."""
    ids = F.array(*[F.lit(t.template_id) for t in TEMPLATES])
    parts = spread(table(s, d, "part").select("p_partkey"))
    return parts.select(F.explode(ids).alias("template_id"), F.col("p_partkey").alias("instance"))


def _u(key: str, *salt: str) -> str:
    parts = " || '-' || ".join([key, *salt])
    return f"(CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT) / 4294967296e0)"


def _at(n: int, var: str) -> str:
    return f"floor({_u('key', repr(var), 'CAST(a AS VARCHAR)')} * {n})"


_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in templates.DEFAULT_NAMES) + "]"
_INST = f"""WITH ins AS (SELECT t AS template_id, p_partkey AS instance, '{SEED}/' || t || '/' || p_partkey AS key
      FROM part, (VALUES ('t1'), ('t2'), ('t3'), ('t4')) v(t))"""
_X = f"""CASE template_id WHEN 't1' THEN 5 + {_at(56, "x")} WHEN 't2' THEN 10 + {_at(81, "x")}
    WHEN 't3' THEN 10 + 10 * {_at(20, "x")} ELSE 1 + {_at(50, "x")} END"""
_Y = f"""CASE template_id WHEN 't1' THEN 1 + {_at(40, "y")} WHEN 't2' THEN 2 + {_at(8, "n")}
    WHEN 't3' THEN [10, 20, 50][CAST({_at(3, "p")} AS INT) + 1] ELSE 1 + {_at(50, "y")} END"""
_DRAWN = f"""dr AS (SELECT *, {_X} AS x, {_Y} AS y, {_NAME_LIST}[CAST({_at(10, "name")} AS INT) + 1] AS name FROM tries),
    ok AS (SELECT *, CASE template_id WHEN 't1' THEN true WHEN 't2' THEN x % y = 0 WHEN 't3' THEN x * y % 100 = 0
      ELSE y > x END AS fits, CASE template_id WHEN 't1' THEN x + y WHEN 't2' THEN x / y WHEN 't3' THEN x - x * y / 100
      ELSE y - x END AS answer FROM dr)"""
_GEN = f"""{_INST}, tries AS (SELECT *, r.a FROM ins, range(500) r(a)), {_DRAWN},
    gen AS (SELECT template_id, instance, arg_min(x, a) AS x, arg_min(y, a) AS y, arg_min(name, a) AS name,
      arg_min(answer, a) AS answer, CAST(min(a) AS INT) AS attempt FROM ok WHERE fits GROUP BY 1, 2)"""


def generated(s, d):
    return templates.generate_instances(instances(s, d), compiled(s), SEED)


def _shown(df):
    pairs = F.transform(F.map_entries("variables"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.withColumn("variables", F.array_join(F.array_sort(pairs), ","))


_VARS = """CASE template_id WHEN 't1' THEN concat('name=', name, ',x=', CAST(x AS BIGINT), ',y=', CAST(y AS BIGINT))
    WHEN 't2' THEN concat('n=', CAST(y AS BIGINT), ',x=', CAST(x AS BIGINT))
    WHEN 't3' THEN concat('p=', CAST(y AS BIGINT), ',x=', CAST(x AS BIGINT))
    ELSE concat('x=', CAST(x AS BIGINT), ',y=', CAST(y AS BIGINT)) END"""
add(
    "h2_sample_variables",
    lambda s, d: _shown(templates.sample_variables(instances(s, d), compiled(s), SEED)),
    f"{_INST}, tries AS (SELECT *, 0 AS a FROM ins), {_DRAWN} SELECT template_id, instance, {_VARS} AS variables FROM ok",
)
add(
    "h3_generate_instances",
    lambda s, d: _shown(generated(s, d)).drop("drawn"),
    f"{_GEN} SELECT template_id, instance, attempt, {_VARS} AS variables, CAST(answer AS DOUBLE) AS final_answer FROM gen",
)
_N = {v: f"CAST({v} AS BIGINT)" for v in ("x", "y", "answer")}
_RENDER = f"""ren AS (SELECT template_id, instance, CASE template_id
    WHEN 't1' THEN concat(name, ' has ', {_N["x"]}, ' pens and buys ', {_N["y"]}, ' more. How many pens?')
    WHEN 't2' THEN concat({_N["y"]}, ' boxes share ', {_N["x"]}, ' pens equally. How many per box?')
    WHEN 't3' THEN concat('A bag of ', {_N["x"]}, ' loses ', {_N["y"]}, ' percent. How many stay?')
    ELSE concat({_N["x"]}, ' birds leave from ', {_N["y"]}, '. How many stay?') END AS question,
    CASE template_id WHEN 't4' THEN concat({_N["y"]}, ' - ', {_N["x"]}, ' = ', {_N["answer"]}, chr(10), '#### ', {_N["answer"]})
    ELSE concat('#### ', {_N["answer"]}) END AS answer, CAST({_N["answer"]} AS VARCHAR) AS final_answer FROM gen)"""
add(
    "h4_render",
    lambda s, d: templates.render(generated(s, d), compiled(s)).select("template_id", "instance", "question", "answer"),
    f"{_GEN}, {_RENDER} SELECT template_id, instance, question, answer FROM ren",
)


def base(s, d):
    return templates.build_variant(instances(s, d), compiled(s), "base", SEED)


add(
    "h9_build_base",
    lambda s, d: base(s, d).select("id", "question", "answer", "final_answer", "variant"),
    f"""{_GEN}, {_RENDER} SELECT concat('base_', template_id, '_', printf('%04d', instance)) AS id, question, answer,
    final_answer, 'base' AS variant FROM ren""",
)


def _stats(s, d):
    inst = instances(s, d)
    asked = inst.groupBy("template_id").agg(F.count(F.lit(1)).alias("instances")).withColumn("variant", F.lit("base"))
    return metrics.generation_stats(asked, base(s, d))


add(
    "e21_generation_stats",
    _stats,
    f"""{_GEN} SELECT 'base' AS variant, (SELECT count(DISTINCT template_id) FROM ins) AS templates_loaded,
    (SELECT count(*) FROM ins) AS instances_requested, count(*) AS instances_generated, CAST(0 AS BIGINT) AS validation_errors,
    (SELECT count(*) FROM ins) - count(*) AS instances_failed FROM gen""",
)

# --- names --------------------------------------------------------------------------------------


def _named(s, d):
    return corpus.assign_names(view(s, d, "slots"), view(s, d, "names"))


add(
    "h5_assign_names",
    lambda s, d: _named(s, d).select("problem_id", "slot", "position", "block", "name"),
    f"""{cte("slots", "names")}, o AS (SELECT name, min(block) % 10 AS block FROM names GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY name) - 1 AS idx, count(*) OVER (PARTITION BY block) AS size FROM o),
    dk AS (SELECT block, idx AS turn, size, row_number() OVER (ORDER BY idx, block) AS position FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY slot) AS position FROM slots),
    m AS (SELECT p.problem_id, p.slot, p.position, dk.block, size, turn,
      CAST(floor({_u("CAST(p.problem_id AS VARCHAR)", "CAST(dk.block AS VARCHAR)")} * size) AS BIGINT) AS start
      FROM p LEFT JOIN dk ON p.position = dk.position)
    SELECT m.problem_id, slot, position, CAST(m.block AS INT) AS block, name FROM m LEFT JOIN r
      ON m.block = r.block AND (start + turn) % m.size = r.idx""",
)

# --- distractors --------------------------------------------------------------------------------

P = cte("problems")


def problems(s, d):
    return spread(view(s, d, "problems"))


_FLAT = [(t, i, r, x.replace("'", "''")) for t in sorted(SENTENCES) for i, (r, x) in enumerate(SENTENCES[t])]
_DIM = "dim(topic, pos, rule, sentence) AS (VALUES " + ", ".join(f"('{t}', {i}, '{r}', '{x}')" for t, i, r, x in _FLAT) + ")"
_PICKS = f"""{_DIM}, base AS (SELECT *, {_topics_sql(lx.TOPIC_WORDS, "question")} AS topics, {objects_sql("question")} AS objects,
      list_max(list_transform(regexp_extract_all(question, '\\b([0-9]+)\\b', 1), lambda x: CAST(x AS BIGINT))) AS q FROM problems),
    opts AS (SELECT id, list(struct_pack(rule := rule, sentence := sentence) ORDER BY topic, pos) AS o
      FROM base JOIN dim ON contains(',' || topics || ',', ',' || topic || ',') GROUP BY id),
    ch AS (SELECT b.*, i, o[CAST(floor({_u("b.id", "'42'", "'sentence'", "CAST(i AS VARCHAR)")} * len(o)) AS INT) + 1] AS c,
      {_u("b.id", "'42'", "'number'", "CAST(i AS VARCHAR)")} AS un,
      objects[CAST(floor({_u("b.id", "'42'", "'object'", "CAST(i AS VARCHAR)")} * len(objects)) AS INT) + 1] AS noun
      FROM base b JOIN opts ON b.id = opts.id, range(3) r(i)),
    rg AS (SELECT *, CASE c.rule WHEN 'smaller' THEN 1 WHEN 'percentage' THEN 5 WHEN 'time' THEN 1 ELSE 2 END AS lo,
      CASE c.rule WHEN 'smaller' THEN greatest(2, least(q - 1, q // 2)) WHEN 'percentage' THEN 95 WHEN 'time' THEN 12 ELSE 50 END AS hi FROM ch),
    ds AS (SELECT id, i, replace(replace(c.sentence, '{{N}}', CAST(lo + CAST(floor(un * (hi - lo + 1)) AS BIGINT) AS VARCHAR)),
      '{{object}}', noun) AS sentence FROM rg),
    dl AS (SELECT id, list(sentence ORDER BY i) AS d FROM ds GROUP BY id)"""
add(
    "h6_pick_distractors",
    lambda s, d: corpus.pick_distractors(problems(s, d), 3).select("id", F.array_join("distractors", "|").alias("distractors")),
    f"{P}, {_PICKS} SELECT id, array_to_string(d, '|') AS distractors FROM dl",
)

# the sentence split without lookbehind: a sentinel marks the gap after a terminator
_SPLIT = r"string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _sum_first(k: str) -> str:
    return f"coalesce(list_sum(list_transform(list_slice(ss, 1, {k}), lambda s: length(s) + 1)), 0)"


_ASK = "regexp_matches(lower(s), '^(how|what|when|where|who|which|if)')"


def _point(position: str) -> str:
    """Insertion point in text t with sentences ss."""
    last = "(len(ss) - list_position(list_reverse(list_transform(ss, lambda s: " + _ASK + ")), true))"
    return f"""CAST(CASE {position} WHEN 'start' THEN CASE WHEN len(ss) > 1 THEN length(ss[1]) + 1 ELSE 0 END
      WHEN 'end' THEN CASE WHEN len(list_filter(ss, lambda s: {_ASK})) > 0 THEN greatest(0, {_sum_first(last)} - 1)
        WHEN len(ss) > 1 THEN length(t) - length(ss[-1]) ELSE length(t) END
      ELSE CASE WHEN len(ss) > 2 THEN {_sum_first("len(ss) // 2")} ELSE length(t) // 2 END END AS BIGINT)"""


def _insert(source: str, name: str, i: int) -> str:
    return f"""{name}a AS (SELECT *, {_SPLIT.format("t")} AS ss FROM {source}), {name}b AS (SELECT *, {_point(f"pos[{i + 1}]")} AS at_ FROM {name}a),
    {name} AS (SELECT id, pos, d, concat(regexp_replace(substr(t, 1, at_), '\\s+$', ''), ' ', d[{i + 1}], ' ',
      regexp_replace(substr(t, at_ + 1), '^\\s+', '')) AS t FROM {name}b)"""


def _places(n: int) -> str:
    names = ["middle", "start", "end"][:n]
    tagged = ", ".join(f"struct_pack(u := {_u('p.id', repr('42'), repr('place'), repr(x))}, p := '{x}')" for x in names)
    return f"list_transform(list_sort([{tagged}]), lambda z: z.p)"


def _injected(n: int) -> str:
    steps = [f"s0 AS (SELECT p.id, {_places(n)} AS pos, d, question AS t FROM problems p JOIN dl ON p.id = dl.id)"]
    steps += [_insert(f"s{i}", f"s{i + 1}", i) for i in range(n)]
    return ", ".join(steps)


def _inject(s, d, n):
    out = corpus.inject(corpus.pick_distractors(problems(s, d), n), n)
    return out.select("id", F.array_join("injection_positions", ",").alias("positions"), "modified_question")


for _n in (1, 3):
    add(
        f"h7_inject_{_n}",
        lambda s, d, n=_n: _inject(s, d, n),
        f"""{P}, {_PICKS}, {_injected(_n)} SELECT id, array_to_string(pos, ',') AS positions,
        trim(t) AS modified_question FROM s{_n}""",
    )


def noop(s, d):
    return corpus.build_noop(problems(s, d))


add(
    "h8_build_noop",
    lambda s, d: noop(s, d).select(
        "id", "question", "answer", "template_id", "is_noop", "instance", "final_answer", "original_question", "base_id"
    ),
    f"""{P}, {_PICKS}, {_injected(1)} SELECT concat('noop_', template_id, '_', printf('%04d', instance)) AS id,
    trim(t) AS question, answer, template_id, true AS is_noop, instance, final_answer, p.question AS original_question,
    p.id AS base_id FROM problems p JOIN s1 ON p.id = s1.id""",
)
add(
    "c3_noop_invariant",
    lambda s, d: checks.noop_invariant(
        problems(s, d), noop(s, d).withColumn("final_answer", F.when(F.col("instance") % 7 > 0, F.col("final_answer")))
    ).select("template_id", "instance", "holds"),
    f"""{P} SELECT template_id, instance, final_answer IS NOT DISTINCT FROM CASE WHEN instance % 7 > 0 THEN final_answer END AS holds
    FROM problems""",
)
add(
    "d11_noop_lineage",
    lambda s, d: corpus.noop_lineage(problems(s, d), noop(s, d)).select("id", "base_id", "base_question", "base_answer"),
    f"""{P} SELECT concat('noop_', template_id, '_', printf('%04d', instance)) AS id, id AS base_id, question AS base_question,
    answer AS base_answer FROM problems""",
)
add(
    "h1_parse_templates",
    lambda s, d: _parsed(s, d),
    """SELECT concat('p1_part', p_partkey) AS template_id, concat('A ', p_type, ' costs {x,3}. {who} buys {n,2}.') AS question_template,
    'x:range:1:' || p_size || ':1;who:sample:::;n:literal:::' AS variables, 'x > ' || p_size % 9 || '|n < 5' AS conditions,
    'x * n' AS formula FROM part""",
)


def _parsed(s, d):
    """Parts worded as annotated template files, parsed back into their pieces."""
    p = table(s, d, "part")
    annotated = F.concat(
        F.lit("A "), "p_type", F.lit(" costs {x,3}. {who} buys {n,2}.\n\n#init:\n- $x = range(1, "),
        F.col("p_size").cast("string"), F.lit(")\n- who = sample(names)\n\n#conditions:\n- x > "),
        (F.col("p_size") % 9).cast("string"), F.lit("\n- n < 5\n\n#answer: x * n"),
    )
    raw = p.select(
        F.concat(F.lit("/templates/part"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("file"),
        annotated.alias("question_annotated"), F.lit(None).cast("string").alias("answer_annotated"),
        F.col("p_name").alias("question"), F.col("p_brand").alias("answer"),
    )
    shown = F.transform(
        "variables",
        lambda v: F.concat_ws(":", v["name"], v["kind"], *[F.coalesce(v[c].cast("string"), F.lit("")) for c in ("lo", "hi", "step")]),
    )
    return templates.parse_templates(raw, "p1").select(
        "template_id", "question_template", F.array_join(shown, ";").alias("variables"),
        F.array_join("conditions", "|").alias("conditions"), "formula",
    )


# --- template files and the whole corpus --------------------------------------------------------

_BRANDS = """brands AS (SELECT replace(p_brand, '#', '_') AS brand, max(p_size) + 30 AS hi, count(*) % 9 AS low, count(*) AS n
    FROM part GROUP BY 1)"""
_ANNOTATED = {
    "base": "A shop has {x,50} {kind} kits. {name,Ann} takes {y,2}. How many kits are left?\n\n#init:\n- $x = range(1, @hi@)\n"
    "- $y = range(1, 50)\n- name = sample(names)\n- kind = ['@brand@']\n\n#conditions:\n- x > y + @low@\n\n#answer: x - y",
    "p1": "{name,Ann} packs {x,3} bags. Each holds {n,2} pens and {y,4} cards. How many things are packed?\n\n#init:\n- $x = range(2, @hi@, 2)\n"
    "- $n = [2, 3, 5]\n- $y = range(1, 9)\n- name = sample(names)\n\n#conditions:\n- x * (n + y) < 400 or y == 1\n\n#answer: x * (n + y)",
    "p2": "{x,9} birds sit on {n,3} trees. Then {y,4} more come to each. How many are on a tree?\n\n#init:\n- $x = range(10, @hi@)\n"
    "- $n = range(2, 9)\n- $y = range(1, 9)\n\n#conditions:\n- divides(n, x)\n- not x == @low@\n\n#answer: x / n + y",
}
_SOLUTIONS = {"base": "{x} - {y} = {x - y}.", "p1": "", "p2": "{x / n} + {y}\n#### {x / n + y}"}


def _brands(s, d):
    p = table(s, d, "part").groupBy(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"))
    return p.agg((F.max("p_size") + 30).alias("hi"), (F.count("*") % 9).alias("low"), F.count("*").alias("n"))


def _template_files(s, d, variant, bad=False):
    """A folder of template files, one a brand, each a folder of one part file as Spark writes it."""
    root, brands = scratch_path(s, f"templates-{variant}"), _brands(s, d)
    text = F.lit(_ANNOTATED[variant])
    for c in ("hi", "low", "brand"):
        text = F.replace(text, F.lit(f"@{c}@"), F.col(c).cast("string"))
    document = F.struct(
        F.concat(F.lit("of "), "brand").alias("question"), F.lit("given").alias("answer"), F.col("n").alias("id_orig"),
        text.alias("question_annotated"), F.lit(_SOLUTIONS[variant]).alias("answer_annotated"),
    )
    files = brands.select(F.concat("brand", F.lit(".json")).alias("f"), F.to_json(document).alias("value"))
    if bad:
        broken = F.when(F.col("n") % 2 == 0, F.concat(F.lit("{broken "), "brand")).otherwise(F.to_json(F.struct(F.col("brand").alias("question"))))
        files = files.unionByName(brands.select(F.concat(F.lit("odd_"), "brand", F.lit(".json")).alias("f"), broken.alias("value")))
    files.write.partitionBy("f").text(root)
    return root


def _read_back(s, d):
    parsed, bad = templates.read_templates(s, _template_files(s, d, "p1", bad=True), "p1")
    shown = F.transform(
        "variables",
        lambda v: F.concat_ws(":", v["name"], v["kind"], *[F.coalesce(v[c].cast("string"), F.lit("")) for c in ("lo", "hi", "step", "collection", "default")]),
    )
    steps = templates.compile_templates(parsed).select("template_id", F.size("steps").alias("n_steps"), "error")
    good = parsed.join(steps, "template_id").select(
        "template_id", "question_template", F.array_join(shown, ";").alias("variables"), F.array_join("conditions", "|").alias("conditions"),
        "formula", "original_question", "n_steps", "error",
    )
    stem = F.regexp_extract("file", r"f=([^/]+)\.json/", 1)
    nothing = F.lit(None).cast("string")
    odd = bad.select(
        stem.alias("template_id"), F.trim(F.regexp_replace("content", r"\s+$", "")).alias("question_template"), *[nothing.alias(c) for c in ("variables", "conditions", "formula", "original_question")],
        F.lit(None).cast("int").alias("n_steps"), F.lit("bad file").alias("error"),
    )
    return good.unionByName(odd)


add(
    "h1_read_templates",
    _read_back,
    f"""WITH {_BRANDS} SELECT concat('p1_', brand) AS template_id,
      '{_ANNOTATED["p1"].partition(chr(10))[0]}' AS question_template,
      concat('name:sample::::names:Ann;x:range:2:', hi, ':2::3;n:sample::::[2, 3, 5]:2;y:range:1:9:1::4') AS variables,
      'x * (n + y) < 400 or y == 1' AS conditions, 'x * (n + y)' AS formula, concat('of ', brand) AS original_question,
      CAST(10 AS INT) AS n_steps, NULL AS error FROM brands
    UNION ALL SELECT concat('odd_', brand), CASE WHEN n % 2 = 0 THEN concat(chr(123), 'broken ', brand) END, NULL, NULL, NULL, NULL, NULL, 'bad file' FROM brands""",
)


def _corpus(s, d):
    """A job that is stopped after one variant, then asked for all."""
    output = scratch_path(s, "corpus")
    parsed = {v: templates.read_templates(s, _template_files(s, d, v), v)[0] for v in _ANNOTATED}
    n = max(1, table(s, d, "part").count() // 40)
    corpus.build_corpus(s, parsed, output, ["p1"], instances=n, seed=SEED)
    return corpus.read_corpus(s, corpus.build_corpus(s, parsed, output, instances=n, seed=SEED))


def _variant_sql(v: str, seed: int, draws: dict[str, str], fits: str, answer: str, question: str, solution: str) -> str:
    drawn = ", ".join(f"{x} AS {n}" for n, x in draws.items())
    firsts = ", ".join(f"arg_min({n}, a) AS {n}" for n in draws)
    return f"""{v}_d AS (SELECT *, {drawn} FROM (SELECT concat('{v}_', brand) AS template_id, i AS instance, brand, hi, low, a,
        concat('{seed}/{v}_', brand, '/', i) AS key FROM brands, range(greatest(1, (SELECT count(*) FROM part) // 40)) r(i), range(500) s(a))),
      {v}_f AS (SELECT template_id, instance, any_value(brand) AS brand, {firsts} FROM {v}_d WHERE {fits} GROUP BY 1, 2),
      {v}_r AS (SELECT concat('{v}_', template_id, '_', printf('%04d', instance)) AS id, {question} AS question, {solution} AS answer, template_id,
        instance, CAST({answer} AS VARCHAR) AS final_answer, concat('of ', brand) AS original_question FROM {v}_f)"""


def _draw_sql(lo: str, n: str, var: str, step: str = "1") -> str:
    return f"CAST({lo} + {step} * floor({_u('key', repr(var), 'CAST(a AS VARCHAR)')} * ({n})) AS BIGINT)"


_WHO = f"{_NAME_LIST}[CAST({_at(10, 'name')} AS INT) + 1]"
_CORPUS_SQL = ", ".join([
    _BRANDS,
    _variant_sql(
        "base", SEED, {"x": _draw_sql("1", "hi", "x"), "y": _draw_sql("1", "50", "y"), "name": _WHO}, "x > y + low", "x - y",
        "concat('A shop has ', x, ' ', brand, ' kits. ', name, ' takes ', y, '. How many kits are left?')",
        "concat(x, ' - ', y, ' = ', x - y, '.', chr(10), '#### ', x - y)",
    ),
    _variant_sql(
        "p1", SEED + 1000, {"x": _draw_sql("2", "(hi - 2) // 2 + 1", "x", "2"), "n": f"[2, 3, 5][CAST({_at(3, 'n')} AS INT) + 1]", "y": _draw_sql("1", "9", "y"), "name": _WHO},
        "x * (n + y) < 400 OR y = 1", "x * (n + y)",
        "concat(name, ' packs ', x, ' bags. Each holds ', n, ' pens and ', y, ' cards. How many things are packed?')",
        "concat('#### ', x * (n + y))",
    ),
    _variant_sql(
        "p2", SEED + 2000, {"x": _draw_sql("10", "hi - 9", "x"), "n": _draw_sql("2", "8", "n"), "y": _draw_sql("1", "9", "y")}, "x % n = 0 AND x <> low", "x // n + y",
        "concat(x, ' birds sit on ', n, ' trees. Then ', y, ' more come to each. How many are on a tree?')",
        "concat(x // n, ' + ', y, chr(10), '#### ', x // n + y)",
    ),
])
_CORPUS_COLUMNS = ["id", "question", "answer", "template_id", "instance", "final_answer", "original_question", "variant", "is_noop", "canary"]
add(
    "h9_build_corpus",
    lambda s, d: _corpus(s, d).select(*_CORPUS_COLUMNS),
    f"""WITH {_CORPUS_SQL}, problems AS (SELECT * FROM base_r), {_PICKS}, {_injected(1)}, every AS (
      SELECT *, 'base' AS variant, false AS is_noop FROM base_r UNION ALL SELECT *, 'p1', false FROM p1_r UNION ALL SELECT *, 'p2', false FROM p2_r
      UNION ALL SELECT concat('noop_', template_id, '_', printf('%04d', instance)), trim(t), answer, template_id, instance, final_answer,
        p.question, 'noop', true FROM problems p JOIN s1 ON p.id = s1.id)
    SELECT id, question, answer, template_id, CAST(instance AS INT) AS instance, final_answer, original_question, variant, is_noop,
      '{corpus.tx.CANARY}' AS canary FROM every""",
)
