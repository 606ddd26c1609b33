"""Corpus jobs: names, distractors and the restartable build of all variants.

The parallel axis is a DataFrame of (template_id, instance) rows.  Every draw is a
function of that key, so a row is produced by its own task alone, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.draws import choose, pick, uniform
from ..sources.datasets import read_dataset, write_dataset
from .distractors import SENTENCES
from .metrics import generation_stats, pipeline_summary
from .prefix import running
from .templates import ATTEMPTS, DEFAULT_NAMES, build_variant, compile_templates, instance_table

DISTRACTORS = (1, 2, 3)


# --- names -----------------------------------------------------------------------------


def _deal(sizes: dict[int, int], position: Column) -> Column:
    """(block, turn, size) of a position in the deck of blocks of the given sizes.

    The deck runs turn by turn through the blocks that still have names; between two
    neighbouring sizes the set of such blocks is fixed, so a position is found by division.
    """
    out, dealt, level = None, 0, 0
    for size in sorted(set(sizes.values())):
        active = sorted(b for b, n in sizes.items() if n >= size)
        at = position - 1 - dealt
        spot = F.pmod(at, F.lit(len(active))).cast("int")
        card = F.struct(
            F.get(F.array(*[F.lit(b) for b in active]), spot).alias("block"),
            (F.floor(at / len(active)) + level).alias("turn"),
            F.get(F.array(*[F.lit(sizes[b]) for b in active]), spot).alias("size"),
        )
        dealt += (size - level) * len(active)
        level = size
        out = F.when(position <= dealt, card) if out is None else out.when(position <= dealt, card)
    return out


def assign_names(slots: DataFrame, names: DataFrame, blocks: int = 10) -> DataFrame:
    """A different name for every slot of a problem, the blocks taking turns.

    Names are dealt turn by turn, so an exhausted block is skipped and a slot beyond the
    last name has none.  Each problem starts at its own hashed place in every block.
    Only the block sizes reach the driver; positions, which repeat in every problem, are
    resolved by arithmetic and never joined on.
    """
    once = names.groupBy("name").agg((F.min("block") % blocks).cast("int").alias("block"))
    ranked = running(once, ["block"], ["name"], rank="__rank").withColumn("__idx", F.col("__rank") - 1)
    sizes = {r["block"]: r["count"] for r in ranked.groupBy("block").count().collect()}
    placed = running(slots, ["problem_id"], ["slot"], rank="position").withColumn(
        "__card", _deal(sizes, F.col("position"))
    )
    block, size = F.col("__card.block"), F.col("__card.size")
    spot = placed.withColumn("block", block).withColumn(
        "__idx", (pick(size, F.col("problem_id"), block) + F.col("__card.turn")) % size
    )
    return spot.join(ranked.select("block", "__idx", "name"), ["block", "__idx"], "left").select(
        *slots.columns, "position", "block", "name"
    )


# --- distractors -----------------------------------------------------------------------


def distractor_table(spark: SparkSession) -> DataFrame:
    rows = [(topic, i, rule, text) for topic, entries in SENTENCES.items() for i, (rule, text) in enumerate(entries)]
    return spark.createDataFrame(rows, "topic string, position int, rule string, sentence string")


def _options(topics: Column, table: dict[str, list[tuple[str, str]]]) -> Column:
    groups = F.create_map(
        *[
            x
            for topic, entries in table.items()
            for x in (
                F.lit(topic),
                F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("sentence")) for r, s in entries]),
            )
        ]
    )
    found = F.flatten(F.array_compact(F.transform(topics, lambda t: F.try_element_at(groups, t))))
    fallback = F.try_element_at(groups, F.lit(lx.FALLBACK_TOPIC))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def distractor_number(rule: Column, quantity: Column, key: Column, *salt: object) -> Column:
    """A whole number in the range its rule allows."""
    # for quantities up to two the upper bound stays 2
    upper = F.greatest(F.lit(2), F.least(quantity - 1, F.floor(quantity / 2)))
    low = F.when(rule == "smaller", 1).when(rule == "percentage", 5).when(rule == "time", 1).otherwise(2)
    high = F.when(rule == "smaller", upper).when(rule == "percentage", 95).when(rule == "time", 12).otherwise(50)
    return (low + F.floor(uniform(key, *salt) * (high - low + 1))).cast("bigint")


def _distractor_count(n: int) -> int:
    if n not in DISTRACTORS:
        raise ValueError(f"a question takes {DISTRACTORS[0]} to {DISTRACTORS[-1]} distractors, not {n}")
    return n


def pick_distractors(
    problems: DataFrame,
    n: int = 1,
    key: str = "id",
    question: str = "question",
    seed: int = 42,
    table: dict[str, list[tuple[str, str]]] | None = None,
) -> DataFrame:
    """Add ``distractors``: one to three filled sentences on the topics of the question."""
    _distractor_count(n)
    prepared = problems.withColumn("__low", F.lower(F.col(question))).withColumns(
        {
            "__options": _options(tx.topics_of_lowered(F.col("__low"), lx.TOPIC_WORDS), table or SENTENCES),
            "__objects": tx.extract_objects(F.col(question)),
            "__quantity": tx.max_quantity(F.col(question)),
        }
    )
    k = F.col(key)
    for i in range(n):
        prepared = prepared.withColumn(f"__pick{i}", choose(F.col("__options"), k, seed, "sentence", i))

    def filled(i: int) -> Column:
        choice = F.col(f"__pick{i}")
        number = distractor_number(choice["rule"], F.col("__quantity"), k, seed, "number", i)
        noun = choose(F.col("__objects"), k, seed, "object", i)
        with_number = F.replace(choice["sentence"], F.lit("{N}"), number.cast("string"))
        return F.replace(with_number, F.lit("{object}"), noun)

    out = prepared.withColumn("distractors", F.array(*[filled(i) for i in range(n)]))
    return out.drop("__low", "__options", "__objects", "__quantity", *[f"__pick{i}" for i in range(n)])


_QUESTION_STARTS = ["how", "what", "when", "where", "who", "which", "if"]


def _point(text: Column, lengths: Column, asks: Column, position: Column, compat: bool) -> Column:
    count, total = F.size(lengths), F.char_length(text)

    def length_of_first(n: Column) -> Column:
        return F.aggregate(F.slice(lengths, 1, n), F.lit(0), lambda a, x: a + x + 1)

    start = F.when(count > 1, F.get(lengths, 0) + 1).otherwise(F.lit(0))
    half = F.floor(count / 2).cast("int")
    middle = F.when(count > 2, length_of_first(half)).otherwise(F.floor(total / 2).cast("int"))
    last_ask = count - F.array_position(F.reverse(asks), True).cast("int")  # zero-based when one asks
    at = (total - F.get(lengths, last_ask)) if compat else length_of_first(last_ask)
    end = (
        F.when(F.array_contains(asks, True), F.greatest(F.lit(0), at - 1))
        .when(count > 1, total - F.get(lengths, count - 1))
        .otherwise(total)
    )
    return F.when(position == "start", start).when(position == "end", end).otherwise(middle).cast("int")


def with_injection_point(
    df: DataFrame, text: str, position: Column, out: str = "injection_point", compat: bool = False
) -> DataFrame:
    """Add the number of characters before the place named start, middle or end.

    ``compat`` measures the end place from the end of the text by the length of the
    question sentence, which is off whenever another sentence follows it.
    """
    opening = "^(" + "|".join(_QUESTION_STARTS) + ")"
    # each step is read several times by the next, so each is its own projection
    return (
        df.withColumn("__sentences", F.split(text, r"(?<=[.!?])\s+"))
        .withColumn("__lengths", F.transform("__sentences", lambda s: F.char_length(s)))
        .withColumn("__asks", F.transform("__sentences", lambda s: F.regexp_like(F.lower(s), F.lit(opening))))
        .withColumn(out, _point(F.col(text), F.col("__lengths"), F.col("__asks"), position, compat))
        .drop("__sentences", "__lengths", "__asks")
    )


def insertion_order(key: Column, n: int, seed: int = 42) -> Column:
    """A shuffled subset of the three places; a single insertion is always in the middle."""
    places = ["middle", "start", "end"][: _distractor_count(n)]
    tagged = F.array(*[F.struct(uniform(key, seed, "place", p).alias("u"), F.lit(p).alias("p")) for p in places])
    return F.transform(F.array_sort(tagged), lambda x: x["p"])


def inject(
    problems: DataFrame, n: int = 1, key: str = "id", question: str = "question", seed: int = 42, compat: bool = False
) -> DataFrame:
    """Insert the first ``n`` distractors into the question text, one after the other."""
    _distractor_count(n)
    out = problems.withColumn("injection_positions", insertion_order(F.col(key), n, seed)).withColumn(
        "modified_question", F.col(question)
    )
    for i in range(n):
        text = F.col("modified_question")
        out = with_injection_point(out, "modified_question", F.get("injection_positions", i), "__at", compat)
        head = F.regexp_replace(F.substring(text, F.lit(1), F.col("__at")), r"(?U)\s+$", "")
        tail = F.regexp_replace(F.substring(text, F.col("__at") + 1, F.char_length(text)), r"(?U)^\s+", "")
        out = out.withColumn(
            "modified_question", F.concat(head, F.lit(" "), F.get("distractors", i), F.lit(" "), tail)
        )
    return out.withColumn("modified_question", tx.strip(F.col("modified_question"))).drop("__at")


def build_noop(base: DataFrame, n: int = 1, seed: int = 42, compat: bool = False) -> DataFrame:
    """Distractor variant of base records: same answer, template and instance; new id and lineage columns."""
    picked = inject(pick_distractors(base, n, seed=seed), n, seed=seed, compat=compat)
    return picked.select(
        tx.record_id(F.lit("noop"), F.col("template_id"), F.col("instance")).alias("id"),
        F.col("modified_question").alias("question"),
        "answer",
        "template_id",
        F.lit(True).alias("is_noop"),
        "instance",
        "final_answer",
        F.col("question").alias("original_question"),
        F.col("answer").alias("original_answer"),
        F.lit("noop").alias("variant"),
        F.col("id").alias("base_id"),
        "distractors",
        "injection_positions",
    )


def noop_lineage(base: DataFrame, noop: DataFrame) -> DataFrame:
    """Distractor records next to the base record they came from."""
    b = base.select(
        "template_id", "instance", F.col("id").alias("base_id"), F.col("question").alias("base_question"),
        F.col("answer").alias("base_answer"),
    )
    return noop.drop("base_id").join(b, ["template_id", "instance"])


# --- whole corpus ----------------------------------------------------------------------

#: Parts of a corpus and the parts they are made from, in the order in which they are built.
GRAPH: dict[str, tuple[str, ...]] = {"base": (), "p1": (), "p2": (), "noop": ("base",)}
_MANIFEST = "part string, fingerprint string, path string, seed long, templates long, requested long, rows long"


@dataclass(frozen=True)
class Part:
    """A finished part: where its records lie and what they were made from."""

    part: str
    fingerprint: str
    path: str
    seed: int
    templates: int
    requested: int
    rows: int


def _hash(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:16]


def _content(df: DataFrame) -> str:
    """A fingerprint of a table's rows, whatever their order: count and two sums of row hashes."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    sums = [F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")) for salt in (1, 2)]
    return _hash(*df.agg(F.count(F.lit(1)), *sums).first())


def _manifest_path(output: str, name: str, fingerprint: str) -> str:
    return f"{output}/manifest/{name}-{fingerprint}"


def finished(spark: SparkSession, output: str, name: str, fingerprint: str) -> Part | None:
    """The manifest entry of a part made from these inputs, if its records are all still there."""
    try:
        entry = spark.read.schema(_MANIFEST).json(_manifest_path(output, name, fingerprint)).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if entry is None:  # written, but not committed
        return None
    part = Part(**entry.asDict())
    there = spark.read.text(part.path).count()  # one line a record
    return part if there == part.rows else None


def build_corpus(
    spark: SparkSession,
    templates: dict[str, DataFrame],
    output: str,
    variants: Sequence[str] = tuple(GRAPH),
    instances: int = 50,
    distractors: int = 1,
    seed: int = 42,
    names: Sequence[str] = tuple(DEFAULT_NAMES),
    attempts: int = ATTEMPTS,
) -> dict[str, Part]:
    """Build every asked variant, and what it is made from, under ``output``; return the parts.

    ``templates`` holds the parsed templates of each template variant.  A part's records go to a folder
    named by the fingerprint of its inputs: template rows or base part, seed, instances, names, draws.
    Its manifest entry is written last.  A part whose entry is there and whose records count as the entry
    says is not built again, so a stopped job goes on at the part where it stopped, and a job
    with other inputs leaves the finished parts of the first in place.
    """
    unknown = set(variants) - set(GRAPH)
    if unknown:
        raise ValueError(f"unknown variants {sorted(unknown)}, choose from {list(GRAPH)}")
    wanted = set(variants) | {need for v in variants for need in GRAPH[v]}
    done: dict[str, Part] = {}
    for i, name in enumerate(GRAPH):
        if name not in wanted:
            continue
        # a variant's seed does not depend on which others are built
        own_seed = seed + i * 1000
        if GRAPH[name]:
            sources = [done[need] for need in GRAPH[name]]
            made_from = _hash(*[s.fingerprint for s in sources], distractors, sorted(SENTENCES.items()))
        else:
            made_from = _content(templates[name])
        fingerprint = _hash(name, made_from, own_seed if not GRAPH[name] else seed, instances, *names, attempts)
        found = finished(spark, output, name, fingerprint)
        done[name] = found or _build(spark, name, output, fingerprint, templates.get(name), done, own_seed, instances, distractors, seed, names, attempts)
    return done


def _build(
    spark: SparkSession, name: str, output: str, fingerprint: str, parsed: DataFrame | None, done: dict[str, Part],
    own_seed: int, instances: int, distractors: int, seed: int, names: Sequence[str], attempts: int,
) -> Part:
    path = f"{output}/{name}/{fingerprint}"
    if GRAPH[name]:
        base = done[GRAPH[name][0]]
        records = build_noop(read_dataset(spark, base.path), distractors, seed).drop("base_id", "distractors", "injection_positions")
        n_templates, requested, own_seed = base.templates, base.rows, seed
    else:
        compiled = compile_templates(parsed)
        records = build_variant(instance_table(parsed, instances), compiled, name, own_seed, names, attempts)
        n_templates = parsed.count()
        requested = n_templates * instances
    write_dataset(tx.attach_canary(records), path)
    part = Part(name, fingerprint, path, own_seed, n_templates, requested, spark.read.text(path).count())
    entry = spark.createDataFrame([tuple(vars(part).values())], _MANIFEST)
    entry.coalesce(1).write.mode("overwrite").json(_manifest_path(output, name, fingerprint))
    return part


def read_corpus(spark: SparkSession, parts: dict[str, Part]) -> DataFrame:
    """The records of all parts."""
    return read_dataset(spark, [p.path for p in parts.values()])


def corpus_stats(spark: SparkSession, parts: dict[str, Part], output: str | None = None) -> DataFrame:
    """Generation counts of each part; with ``output`` also written there with a row of totals."""
    asked = spark.createDataFrame([(p.part, p.templates, p.requested) for p in parts.values()], "variant string, n long, requested long")
    # each template asks for the same number of instances
    per_template = asked.select(
        "variant", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("template_id"), (F.col("requested") / F.col("n")).alias("instances")
    )
    stats = generation_stats(per_template, read_corpus(spark, parts)).withColumns(
        {c: F.col(c).cast("long") for c in ("instances_requested", "instances_failed")}
    )
    if output is not None:
        pipeline_summary(stats).write.mode("overwrite").json(f"{output}/summary")
    return stats
