"""Problem templates as rows: reading, compiling, sampling, generating and rendering.

A template is data.  Conditions, formula and the expressions inside texts are compiled once, per
template row, to steps over numbered registers; the first registers hold the variables.  Instances
join their template and fold its steps with ``aggregate``, so the plan is the same for four
templates and for four million, and nothing of them passes through the driver.

Every draw is a function of (seed, template, instance, variable, attempt): a lost task redraws the same values.

Defined results: a file that is no JSON document or has no annotated question goes to the bad files.  A condition or
formula that cannot be compiled has no value, so no draw of its template fits; ``error`` of the compiled
row says why.  A text expression without a value shows its default.  An instance whose template
is missing is dropped, as there is nothing to draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.draws import pick
from ..session import cut_lineage
from .checks import MAX_ANSWER

# default number of draws an instance is given
ATTEMPTS = 500
DEFAULT_NAMES = ["Ada", "Bela", "Chidi", "Dara", "Emre", "Farah", "Goran", "Hana", "Imani", "Jun"]


@dataclass
class Variable:
    """range: (lo, hi, step), hi included; sample: items; literal: default."""

    name: str
    kind: str
    lo: int = 0
    hi: int = 0
    step: int = 1
    items: list = field(default_factory=list)
    default: str | None = None
    numeric: bool = False


@dataclass
class Template:
    template_id: str
    question: str
    variables: list[Variable]
    formula: str
    conditions: list[str] = field(default_factory=list)
    answer: str = ""
    original_question: str = ""
    original_answer: str = ""


# --- reading ---------------------------------------------------------------------------

_FILE_SCHEMA = (
    "question string, answer string, id_orig bigint, question_annotated string, answer_annotated string, "
    "_corrupt_record string"
)
_VARIABLE_TYPE = (
    "array<struct<name:string,kind:string,lo:bigint,hi:bigint,step:bigint,collection:string,default:string,"
    "numeric:boolean>>"
)
PARSED_SCHEMA = (
    f"template_id string, question_template string, answer_template string, variables {_VARIABLE_TYPE}, "
    "conditions array<string>, formula string, original_question string, original_answer string"
)


def read_templates(spark: SparkSession, path: str, variant: str) -> tuple[DataFrame, DataFrame]:
    """Parsed templates of a folder with one JSON document each, and the files that are no valid template.

    A template is named by its file, ``<name>.json``, which may also be a folder of part files as Spark writes them.
    """
    raw = (
        spark.read.schema(_FILE_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    bad = F.col("_corrupt_record").isNotNull() | F.col("question_annotated").isNull()
    parsed = parse_templates(raw.filter(~bad).drop("_corrupt_record"), variant)
    return parsed, raw.filter(bad).select("file", F.col("_corrupt_record").alias("content"))


def parse_templates(raw: DataFrame, variant: str) -> DataFrame:
    """Split annotated questions into text, variables, conditions and formula."""
    # The section marks and assignments of the template file format.
    annotated = F.col("question_annotated")
    pieces = F.split(annotated, "\n\n#init:", 2)
    block = F.coalesce(F.get(pieces, 1), F.lit(""))
    init = F.regexp_extract(block, r"(?s)^\s*(.*?)(?=#conditions:|#answer:|$)", 1)
    cond = F.regexp_extract(block, r"(?s)#conditions:\s*(.*?)(?=#answer:|$)", 1)
    formula = tx.strip(F.regexp_extract(block, r"(?s)#answer:\s*(.+?)$", 1))

    def dashed(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n"), tx.strip), lambda x: x.startswith("-"))
        return F.transform(lines, lambda x: tx.strip(F.substring(x, F.lit(2), F.char_length(x))))

    placeholders = F.transform(
        F.regexp_extract_all(F.get(pieces, 0), F.lit(r"\{([^}]+)\}"), F.lit(1)), lambda x: F.split(x, ",", 3)
    )
    named = F.array_distinct(
        F.transform(
            placeholders, lambda p: F.struct(tx.strip(F.get(p, 0)).alias("name"), tx.strip(F.get(p, 1)).alias("default"))
        )
    )
    assigned = F.transform(
        F.filter(dashed(init), lambda x: F.contains(x, F.lit("="))),
        lambda x: F.struct(
            F.regexp_extract(x, r"^\s*\$?(\w+)\s*=", 1).alias("name"),
            x.startswith("$").alias("dollar"),
            tx.strip(F.regexp_extract(x, r"(?s)=(.*)$", 1)).alias("rhs"),
        ),
    )
    rng = r"^range\s*\(\s*(\d+)\s*,\s*(\d+)(?:\s*,\s*(\d+))?\s*\)"

    def variable(p: Column) -> Column:
        a = F.get(F.filter(F.col("__assigned"), lambda x: x["name"] == p["name"]), 0)
        rhs = a["rhs"]
        is_range = F.coalesce(F.regexp_like(rhs, F.lit(rng)), F.lit(False))
        sample = F.nullif(F.regexp_extract(rhs, r"^sample\s*\(\s*(.+?)\s*\)", 1), F.lit(""))
        collection = F.coalesce(sample, F.when(rhs.startswith("["), rhs))
        kind = F.when(is_range, "range").when(collection.isNotNull(), "sample").otherwise("literal")
        return F.struct(
            p["name"].alias("name"),
            kind.alias("kind"),
            F.when(is_range, F.regexp_extract(rhs, rng, 1).try_cast("bigint")).alias("lo"),
            F.when(is_range, F.regexp_extract(rhs, rng, 2).try_cast("bigint")).alias("hi"),
            F.when(
                is_range, F.coalesce(F.nullif(F.regexp_extract(rhs, rng, 3), F.lit("")).try_cast("bigint"), F.lit(1))
            ).alias("step"),
            collection.alias("collection"),
            p["default"].alias("default"),
            (is_range | F.coalesce(a["dollar"], p["default"].try_cast("double").isNotNull())).alias("numeric"),
        )

    stem = F.regexp_extract(F.col("file"), r"([^/=]+?)\.json(?:/[^/]*)?$", 1)
    return (
        raw.withColumn("__assigned", assigned)
        .withColumn("__named", named)
        .select(
            F.concat_ws("_", F.lit(variant), stem).alias("template_id"),
            tx.strip(F.get(pieces, 0)).alias("question_template"),
            F.coalesce("answer_annotated", F.lit("")).alias("answer_template"),
            F.transform("__named", variable).cast(_VARIABLE_TYPE).alias("variables"),
            dashed(cond).alias("conditions"),
            formula.alias("formula"),
            F.coalesce("question", F.lit("")).alias("original_question"),
            F.coalesce("answer", F.lit("")).alias("original_answer"),
            tx.detect_template_topics(F.get(pieces, 0)).alias("topics"),
        )
    )


def template_rows(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """Templates written in code as parsed rows."""
    rows = []
    for t in templates:
        variables = []
        for v in t.variables:
            collection = None if v.kind != "sample" else "names" if v.items == ["names"] else repr(v.items)
            variables.append((v.name, v.kind, v.lo, v.hi, v.step, collection, v.default, v.numeric))
        rows.append((t.template_id, t.question, t.answer, variables, t.conditions, t.formula, t.original_question, t.original_answer))
    return spark.createDataFrame(rows, PARSED_SCHEMA)


# --- compiling -------------------------------------------------------------------------

_STEPS = "array<struct<op:string,a:int,b:int,number:double>>"
_PIECES = "array<struct<text:string,variable:int,word:boolean,register:int,fallback:string>>"
COMPILED_SCHEMA = (
    "template_id string, "
    "draws array<struct<name:string,lo:double,step:double,size:int,names:boolean,"
    "items:array<struct<number:double,shown:string,word:string>>>>, "
    f"steps {_STEPS}, slots {_STEPS}, question_pieces {_PIECES}, answer_pieces {_PIECES}, "
    "original_question string, original_answer string, error string"
)


def _compiler(collections: dict, schema: pa.Schema):
    # a closure travels to the workers by value, so they need pyarrow but not this package
    import ast
    import re

    binary = {
        ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.FloorDiv: "floor_div", ast.Mod: "mod",
        ast.Pow: "pow",
    }
    compared = {ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Eq: "eq", ast.NotEq: "ne"}
    one, two = {"is_int", "int", "abs"}, {"divides"}

    def items_of(collection: str) -> list | None:
        """(number, shown, word) of each item; None stands for the pool of names."""
        if collection.startswith("["):
            found = re.findall(r"'([^']*)'|\"([^\"]*)\"|(-?\d+(?:\.\d+)?)", collection)
            texts = any(not n for _, _, n in found)
            return [(float(n) if n else None, (a or b or n) if texts else None, None) for a, b, n in found]
        known = collections.get(collection)
        if isinstance(known, dict):
            return [(float(x), None, w) for w, x in known.items()]
        if known is not None:
            numbers = all(isinstance(x, (int, float)) for x in known)
            return [(float(x), None, None) if numbers else (None, str(x), None) for x in known]
        if collection == "names" or collection.startswith("names_"):
            return None
        return [(None, collection, None)]

    def draw_of(v: dict) -> dict | None:
        out = {"name": v["name"], "lo": None, "step": None, "size": 1, "names": False, "items": None}
        items = None
        if v["kind"] == "range":
            lo, hi, step = v["lo"] or 0, v["hi"] or 0, v["step"] or 1
            return out | {"lo": float(lo), "step": float(step), "size": max((hi - lo) // step + 1, 1)}
        if v["kind"] == "sample":
            items = items_of(v["collection"] or "[]")
            if items is None:
                return out | {"names": True}
            items = items or [(None, "", None)]
        elif v["default"] is not None:
            try:
                items = [(float(v["default"]), None, None)] if v["numeric"] else [(None, v["default"], None)]
            except ValueError:
                items = [(None, v["default"], None)]
        elif "name" in v["name"].lower():
            return out | {"names": True}
        else:
            return None
        keys = ("number", "shown", "word")
        return out | {"size": len(items), "items": [dict(zip(keys, i)) for i in items]}

    class Program:
        """Steps over registers; each returns the register it fills."""

        def __init__(self, names: list[str], words: set[str]):
            self.at = {n: i for i, n in reversed(list(enumerate(names)))}
            self.words, self.first, self.steps = words, len(names), []

        def put(self, op: str, a: int = 0, b: int = 0, number: float | None = None) -> int:
            self.steps.append({"op": op, "a": a, "b": b, "number": number})
            return self.first + len(self.steps) - 1

        def fold(self, op: str, parts: list[int]) -> int:
            out = parts[0]
            for p in parts[1:]:
                out = self.put(op, out, p)
            return out

        def text(self, text: str) -> int:
            return self.node(ast.parse(text.strip(), mode="eval").body)

        def node(self, n) -> int:
            if isinstance(n, ast.Constant) and isinstance(n.value, (bool, int, float)):
                return self.put("number", number=float(n.value))
            if isinstance(n, ast.Name) and n.id in self.at:
                return self.at[n.id]
            if isinstance(n, ast.Name) and n.id in self.words:
                return self.put("missing")
            if isinstance(n, ast.BinOp) and type(n.op) in binary:
                return self.put(binary[type(n.op)], self.node(n.left), self.node(n.right))
            if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.Not)):
                return self.put("neg" if isinstance(n.op, ast.USub) else "not", self.node(n.operand))
            if isinstance(n, ast.BoolOp):
                return self.fold("and" if isinstance(n.op, ast.And) else "or", [self.node(v) for v in n.values])
            if isinstance(n, ast.Compare) and all(type(o) in compared for o in n.ops):
                sides = [self.node(s) for s in [n.left, *n.comparators]]
                return self.fold("and", [self.put(compared[type(o)], a, b) for o, a, b in zip(n.ops, sides, sides[1:])])
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
                name, count = n.func.id, len(n.args)
                if name == "round" and count in (1, 2):
                    digits = ast.literal_eval(n.args[1]) if count == 2 else 0
                    return self.put("round", self.node(n.args[0]), number=10.0 ** int(digits))
                if name == "float" and count == 1:
                    return self.node(n.args[0])
                if name in ("min", "max") and count > 1:
                    return self.fold(name, [self.node(a) for a in n.args])
                if (name in one and count == 1) or (name in two and count == 2):
                    args = [self.node(a) for a in n.args]
                    return self.put(name, args[0], args[-1])
            raise ValueError(f"not allowed in a template expression: {ast.unparse(n)!r}")

    def pieces_of(template: str, program: Program) -> list[dict]:
        out, at = [], 0
        blank = {"text": None, "variable": None, "word": False, "register": None, "fallback": None}
        for m in re.finditer(r"\{([^}]+)\}", template):
            out.append(blank | {"text": template[at : m.start()]})
            name, _, default = (x.strip() for x in m.group(1).partition(","))
            fallback = default.split(",")[0].strip() or name
            if name in program.at:
                out.append(blank | {"variable": program.at[name], "fallback": fallback})
            elif name in program.words:
                out.append(blank | {"variable": program.at[name[: -len("_text")]], "word": True, "fallback": fallback})
            else:
                mark = len(program.steps)
                try:
                    out.append(blank | {"register": program.text(name), "fallback": fallback})
                except (ValueError, SyntaxError):
                    del program.steps[mark:]
                    out.append(blank | {"text": fallback})
            at = m.end()
        out.append(blank | {"text": template[at:]})
        return [p for p in out if p["text"] != ""]

    def compiled(row: dict) -> dict:
        draws = [d for d in map(draw_of, row["variables"] or []) if d is not None]
        names = [d["name"] for d in draws]
        words = {f"{d['name']}_text" for d in draws if d["items"] and d["items"][0]["word"] is not None}
        program, errors = Program(names, words), []

        def value(text: str) -> int:
            mark = len(program.steps)
            try:
                return program.text(text)
            except (ValueError, SyntaxError, RecursionError) as e:
                del program.steps[mark:]
                errors.append(str(e))
                return program.put("missing")

        ok = program.fold("and", [value(c) for c in row["conditions"] or []] or [program.put("number", number=1.0)])
        program.put("keep", ok, value(row["formula"]) if row["formula"] else program.put("missing"))
        shown = Program(names, words)
        return {
            "template_id": row["template_id"], "draws": draws, "steps": program.steps,
            "question_pieces": pieces_of(row["question_template"] or "", shown),
            "answer_pieces": pieces_of(row["answer_template"] or "", shown), "slots": shown.steps,
            "original_question": row["original_question"], "original_answer": row["original_answer"],
            "error": "; ".join(errors) or None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([compiled(r) for r in b.to_pylist()], schema=schema)

    return run


def compile_templates(parsed: DataFrame) -> DataFrame:
    """Parsed templates as draws, steps and text pieces; a row's ``error`` names what could not be compiled."""
    kinds = T.StructType.fromDDL(COMPILED_SCHEMA)
    fields = [c.name for c in T.StructType.fromDDL(PARSED_SCHEMA)]
    return parsed.select(*fields).mapInArrow(_compiler(lx.SAMPLE_COLLECTIONS, to_arrow_schema(kinds)), kinds)


# --- sampling and evaluating -----------------------------------------------------------

#: Compiled templates up to this many rows are sent to the instances; more are joined by key.
_SENT_TEMPLATES = 10_000


def _with_template(instances: DataFrame, compiled: DataFrame) -> DataFrame:
    """Instances next to their compiled template, each left in the task that holds it.

    Instances come out of ``explode``, so the planner takes them for few and would send them to the templates: a task
    for each template then does all its draws.
    """
    rows = cut_lineage(compiled)
    few = rows.limit(_SENT_TEMPLATES + 1).count() <= _SENT_TEMPLATES
    return instances.join(F.broadcast(rows) if few else rows.hint("merge"), "template_id")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def show(value: Column) -> Column:
    """Text of a number that prints whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(2.0**53))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _instance_key(seed: int) -> Column:
    return F.concat_ws("/", F.lit(str(seed)), F.col("template_id"), F.col("instance").cast("string"))


def _drawn(attempt: Column, seed: int, names: Sequence[str], numbers: bool = False) -> Column:
    """(name, number, shown, word) of each variable of the row's template, or the ``numbers`` alone."""
    key, pool = _instance_key(seed), F.array(*[F.lit(n) for n in names]).cast("array<string>")
    nothing = F.lit(None).cast("string")

    def one(v: Column) -> Column:
        size = F.when(v["names"], F.lit(len(names))).otherwise(v["size"])

        def at(i: Column) -> Column:
            item = F.get(v["items"], i)
            number = F.when(v["lo"].isNotNull(), v["lo"] + v["step"] * i).otherwise(item["number"])
            if numbers:
                return number
            text = F.when(v["names"], F.get(pool, i)).otherwise(item["shown"])
            return F.struct(v["name"].alias("name"), number.alias("number"), F.coalesce(text, show(number)).alias("shown"),
                            F.coalesce(item["word"], nothing).alias("word"))

        return let(pick(size, key, v["name"], attempt), at)

    return F.transform("draws", one)


def _truth(condition: Column) -> Column:
    return condition.cast("double")


def _step(regs: Column, s: Column) -> Column:
    """The value of one step; null where the operation has none."""
    a, b, op = F.get(regs, s["a"]), F.get(regs, s["b"]), s["op"]
    whole = F.floor(F.try_divide(a, b)).cast("double")
    present = a.isNotNull() & b.isNotNull()
    # divides(a, b): a is the divisor
    rest = b - F.floor(F.try_divide(b, a)) * a
    cases = {
        "number": s["number"],
        "add": a + b,
        "sub": a - b,
        "mul": a * b,
        "div": F.try_divide(a, b),
        "gt": _truth(a > b),
        "lt": _truth(a < b),
        "ge": _truth(a >= b),
        "le": _truth(a <= b),
        "eq": _truth(a == b),
        "ne": _truth(a != b),
        "and": F.when(a == 0, F.lit(0.0)).when(a.isNotNull(), b),
        "or": F.when(a != 0, a).when(a == 0, b),
        "not": F.when(a == 0, F.lit(1.0)).when(a.isNotNull(), F.lit(0.0)),
        "neg": -a,
        "keep": F.when(a != 0, b),
        "mod": a - whole * b,
        "floor_div": whole,
        "divides": F.coalesce(_truth(rest == 0), F.lit(0.0)),
        "is_int": _truth(a == F.floor(a)),
        "int": F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double"),
        "abs": F.abs(a),
        "min": F.when(present, F.least(a, b)),
        "max": F.when(present, F.greatest(a, b)),
        "pow": F.pow(a, b),
        "round": F.try_divide(F.bround(a * s["number"], 0), s["number"]),
    }
    names = sorted(cases)

    def chosen(lo: int, hi: int) -> Column:
        """The case among names[lo:hi], found by halving: five comparisons a step and not one for each operation."""
        if hi - lo == 1:
            return F.when(op == names[lo], cases[names[lo]])
        middle = (lo + hi) // 2
        return F.when(op < names[middle], chosen(lo, middle)).otherwise(chosen(middle, hi))

    return chosen(0, len(names))


def _registers(steps: Column, numbers: Column) -> Column:
    """All registers after the steps: the variables' numbers first."""
    return F.aggregate(steps, numbers, lambda regs, s: F.array_append(regs, _step(regs, s)))


def _numbers(drawn: Column) -> Column:
    return F.transform(drawn, lambda d: d["number"])


def _as_map(drawn: Column) -> Column:
    worded = F.filter(drawn, lambda d: d["word"].isNotNull())
    entries = F.concat(
        F.transform(drawn, lambda d: F.struct(d["name"].alias("key"), d["shown"].alias("value"))),
        F.transform(worded, lambda d: F.struct(F.concat(d["name"], F.lit("_text")).alias("key"), d["word"].alias("value"))),
    )

    def firsts(all_: Column) -> Column:
        # a variable that is named twice keeps its first draw
        keys = F.transform(all_, lambda x: x["key"])
        return let(keys, lambda k: F.map_from_entries(F.filter(all_, lambda e, i: F.array_position(k, e["key"]) == i + 1)))

    return let(entries, firsts)


def sample_variables(
    instances: DataFrame, compiled: DataFrame, seed: int = 42, names: Sequence[str] = tuple(DEFAULT_NAMES),
    attempt: Column | None = None,
) -> DataFrame:
    """Add ``variables`` (name to text) drawn for each (template_id, instance) row."""
    at = F.lit(0) if attempt is None else attempt
    joined = _with_template(instances, compiled)
    return joined.select(*instances.columns, let(_drawn(at, seed, names), _as_map).alias("variables"))


_FOUND = "struct<attempt:int,drawn:array<struct<name:string,number:double,shown:string,word:string>>,answer:double>"


def _attempted(joined: DataFrame, seed: int, names: Sequence[str], attempts: int) -> DataFrame:
    """Add ``found``: the first attempt whose conditions and answer range hold, or null."""

    def answer_of(numbers: Column) -> Column:
        return F.element_at(_registers(F.col("steps"), numbers), -1)

    def fitting(attempt: Column) -> Column:
        answer = answer_of(_drawn(attempt, seed, names, numbers=True))
        return let(answer, lambda x: F.when(x.between(0, MAX_ANSWER), attempt))

    def found(attempt: Column) -> Column:
        def with_draw(drawn: Column) -> Column:
            made = F.struct(attempt.alias("attempt"), drawn.alias("drawn"), answer_of(_numbers(drawn)).alias("answer"))
            return F.when(attempt.isNotNull(), made).cast(_FOUND)

        return let(_drawn(attempt, seed, names), with_draw)

    # coalesce evaluates an attempt only if no earlier one was found; the number alone is carried, as a fold copies what it carries
    # at every element, and the draw that fits is made once more
    first = F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), F.lit(None).cast("int"), lambda n, a: F.coalesce(n, fitting(a)))
    first = let(first, found)
    # an outer explode of zero or one row: later filters and projections read its output instead of searching again
    return joined.select("*", F.explode_outer(F.filter(F.array(first), lambda x: x.isNotNull())).alias("found"))


def generate_instances(
    instances: DataFrame, compiled: DataFrame, seed: int = 42, names: Sequence[str] = tuple(DEFAULT_NAMES),
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """Draw each instance until its conditions and answer range hold, at most ``attempts`` times.

    ``attempt``, ``drawn``, ``variables`` and ``final_answer`` are null where no draw fits.
    """
    made = _attempted(_with_template(instances, compiled), seed, names, attempts)
    return made.select(*instances.columns, *_result())


def _result() -> list[Column]:
    found = F.col("found")
    return [
        found["attempt"].alias("attempt"), found["drawn"].alias("drawn"), _as_map(found["drawn"]).alias("variables"),
        found["answer"].alias("final_answer"),
    ]


def _filled(pieces: str, regs: Column, drawn: Column) -> Column:
    def piece(p: Column) -> Column:
        d = F.get(drawn, p["variable"])
        from_variable = F.when(p["word"], d["word"]).otherwise(d["shown"])
        value = F.when(p["register"].isNotNull(), show(F.get(regs, p["register"]))).otherwise(from_variable)
        return F.coalesce(p["text"], value, p["fallback"])

    return F.array_join(F.transform(pieces, piece), "")


def _rendered(joined: DataFrame) -> DataFrame:
    drawn, final = F.col("drawn"), show(F.col("final_answer"))
    texts = let(
        _registers(F.col("slots"), _numbers(drawn)),
        lambda regs: F.struct(
            _filled("question_pieces", regs, drawn).alias("question"), _filled("answer_pieces", regs, drawn).alias("body")
        ),
    )
    body = F.col("__texts.body")
    answer = (
        F.when(F.size("answer_pieces") == 0, F.concat(F.lit("#### "), final))
        .when(F.contains(body, F.lit("####")), body)
        .otherwise(F.concat(body, F.lit("\n#### "), final))
    )
    return joined.withColumn("__texts", texts).withColumns({"question": F.col("__texts.question"), "answer": answer}).drop("__texts")


def render(generated: DataFrame, compiled: DataFrame) -> DataFrame:
    """Question and answer text of generated instances; the answer ends in a marker line."""
    return _rendered(_with_template(generated, compiled)).select(*generated.columns, "question", "answer")


def build_variant(
    instances: DataFrame, compiled: DataFrame, variant: str, seed: int = 42,
    names: Sequence[str] = tuple(DEFAULT_NAMES), attempts: int = ATTEMPTS,
) -> DataFrame:
    """Dataset records of one template variant; instances no draw could satisfy have none."""
    made = _attempted(_with_template(instances.select("template_id", "instance"), compiled), seed, names, attempts)
    fits = made.filter(F.col("found").isNotNull()).select(*[c for c in made.columns if c != "found"], *_result())
    return _rendered(fits).select(
        tx.record_id(F.lit(variant), F.col("template_id"), F.col("instance")).alias("id"),
        "question",
        "answer",
        "template_id",
        F.lit(False).alias("is_noop"),
        "instance",
        show(F.col("final_answer")).alias("final_answer"),
        F.coalesce("original_question", F.lit("")).alias("original_question"),
        F.coalesce("original_answer", F.lit("")).alias("original_answer"),
        F.lit(variant).alias("variant"),
    )


def unmet(instances: DataFrame, records: DataFrame) -> DataFrame:
    """Instances without a record: no draw fitted, or their template is missing."""
    return instances.select("template_id", "instance").join(records.select("template_id", "instance"), ["template_id", "instance"], "left_anti")


# instances that one row is blown up to
_BLOCK = 1_000


def instance_table(templates: DataFrame, n: int) -> DataFrame:
    """Instances 0 to n - 1 of every template, in blocks that are spread over the tasks."""
    blocks = templates.select("template_id", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // _BLOCK))).alias("block"))
    # a number, as blocks are small and would be gathered in a few tasks before they are blown up
    spread = blocks.repartition(int(templates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("block") * _BLOCK
    last = F.least(first + _BLOCK - 1, F.lit(n - 1))
    return spread.select("template_id", F.explode(F.sequence(first, last)).alias("instance"))
