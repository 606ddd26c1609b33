"""Secret scans by assignment-aware lexing.

Two passes over each whole text.  The base pass finds three kinds of span by pattern
(``assign``, ``access``, ``hex``).  The lexing pass reads source and configuration syntax:
it collects name-literal pairs (``name = "literal"``, ``name: literal``, ``"name": "literal"``,
XML and command-line forms), carries literals through plain references and concatenations (``a = "x"``,
``b = a + "y"``), and scores each literal by how sensitive the names are that it reaches, by
its length and by its randomness.  Literals that score ``LEAST_SCORE`` or more become
``lexed`` spans.  Base spans always stay.

Defined results: null text is empty and has no spans; positions count code points, end
exclusive; a literal that reaches several names is reported once; no span crosses rows; other columns
are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "lexed")
LEAST_SCORE = 1.0
MASK = "[secret]"

# The three base patterns.  Runs that are too short fail as a whole.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_HINT = re.compile(r"(?ai)passw|secret|token|api_?key")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Name parts and how much they say; parts are split at case changes, underscores, dots and dashes.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.5, "auth": 0.6, "bearer": 0.8, "key": 0.45,
    "access": 0.4, "signing": 0.5, "client": 0.1, "salt": 0.5, "session": 0.4, "cookie": 0.4, "dsn": 0.5,
}
#: Literals that stand in for a value.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|none|null|true|false|todo|changeme|your[-_ ].*|example.*|<.*>|\$\{.*\}|\{\{.*\}\})$")

# A run of name characters is read once, from its first valid start (``_AFTER``: in the run where a match ended),
# so names of any length take linear time.  A quoted name starts at its quote; dashes of options belong to the run.
_ASSIGNED = r"""(?x)
    (?: (?<![\w$])(?P<q>["'])(?P<quoted>[A-Za-z_][\w.-]*+)(?P=q)
      | %s(?:[.-]|(?:(?<=[\w$])|(?![A-Za-z_]))\w)*+(?P<plain>[A-Za-z_][\w.-]*+)
    )
    [\x20\t]* (?: := | => | (?<![=!<>])=(?!=) | : ) [\x20\t]*
    (?P<value>
        (?: "(?:[^"\\\n]|\\.)*" | '(?:[^'\\\n]|\\.)*' | [A-Za-z_][\w.]*(?=[\x20\t]*\+) )
        (?: [\x20\t]*\+[\x20\t]* (?: "(?:[^"\\\n]|\\.)*" | '(?:[^'\\\n]|\\.)*' | [A-Za-z_][\w.]* ) )*
      | [^\s"'<>;,(){}\[\]]+
    )
    """
_PAIR, _AFTER = re.compile(_ASSIGNED % r"(?<![\w.-])"), re.compile(_ASSIGNED % "")
_TAG = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)>(?P<value>[^<>\n]{4,}+)</(?P=name)>")
_OPERAND = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z_][\w.]*)""")
_NAME = re.compile(r"[A-Za-z_][\w.]*\Z")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base patterns, by start and then kind."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def name_weight(name: str) -> float:
    """How sensitive a name is: the most telling of its parts, a little more for a second one."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    weights = sorted((SENSITIVE.get(p, 0.0) for p in parts + joined), reverse=True)
    return min(1.0, weights[0] + 0.5 * (weights[1] if len(weights) > 1 else 0.0)) if weights else 0.0


def literal_weight(literal: str) -> float:
    """0 for placeholders and short or plain words, up to 1 for long mixed strings."""
    if len(literal) < 8 or PLACEHOLDERS.match(literal) or " " in literal:
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
    return min(1.0, entropy / 4.0) * (0.4 if classes == 1 else 0.8 if classes == 2 else 1.0)


def _assignments(text: str):
    at = 0
    while m := (at and _AFTER.match(text, at)) or _PAIR.search(text, at):
        yield m
        at = m.end()


def pairs(text: str):
    """(name, operands, bare) of each assignment; an operand is (start, end) of a literal or a name.

    A bare word is the name of an earlier value if there is one, and else a literal.
    """
    if "=" not in text and ":" not in text and "</" not in text:
        return
    for m in _assignments(text):
        name = m["quoted"] or m["plain"]
        value, at = m["value"], m.start("value")
        if value[0] in "\"'" or "+" in value:
            operands = []
            for o in _OPERAND.finditer(value):
                if o[3] is not None:
                    operands.append(o[3])
                else:
                    g = 1 if o[1] is not None else 2
                    operands.append((at + o.start(g), at + o.end(g)))
            yield name, operands, False
        elif _NAME.match(value) and not any(c.isdigit() for c in value):
            yield name, [value, (at, at + len(value))], True
        else:
            yield name, [(at, at + len(value))], False
    for m in _TAG.finditer(text):
        yield m["name"], [(m.start("value"), m.end("value"))], False


def lexed_spans(text: str, least: float = LEAST_SCORE) -> list[tuple[str, int, int]]:
    """Literals whose sensitive targets and own shape together reach ``least``.

    A later assignment to a name replaces what the name held, as a program would.  Values
    link to the earlier values that they are made of, and weights go down these links once,
    so time and memory are linear in the operands.
    """
    held: dict[str, int] = {}  # name -> its value
    weights: list[float] = []
    made_of: list[list] = []  # per value: literals as (start, end), earlier values by number
    for name, operands, bare in pairs(text):
        parts = []
        for o in operands:
            if isinstance(o, tuple):
                parts.append(o)
            elif o in held:
                parts.append(held[o])
                if bare:
                    break
        held[name] = len(weights)
        weights.append(name_weight(name))
        made_of.append(parts)
    reach: dict[tuple[int, int], float] = {}
    for k in range(len(weights) - 1, -1, -1):
        for part in made_of[k]:
            if isinstance(part, tuple):
                reach[part] = max(reach.get(part, 0.0), weights[k])
            else:
                weights[part] = max(weights[part], weights[k])
    found = []
    for (start, end), weight in reach.items():
        if weight and weight + literal_weight(text[start:end]) >= least + 0.3 and literal_weight(text[start:end]) > 0.3:
            found.append(("lexed", start, end))
    return sorted(found, key=lambda s: s[1:])


def all_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start and then kind."""
    text = text or ""
    base = base_spans(text)
    every = sorted([*base, *lexed_spans(text)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return base, every


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str | None) -> str | None:
    """The text with every span replaced; overlapping spans are joined first."""
    if not text:
        return text
    _, spans = all_spans(text)
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per whole text: span counts, the digest of the base spans and all spans.  No shuffle."""

    def run(batches):
        for b in slices(batches, 1):
            counts = {k: [] for k in KINDS}
            digest, every = [], []
            for text in b.column(1).to_pylist():
                base, spans = all_spans(text)
                seen = Counter(k for k, _, _ in spans)
                for k in KINDS:
                    counts[k].append(seen[k])
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                every.append(written(spans))
            arrays = [b.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digest, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string"
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def mask_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows and columns with every span in the text masked."""
    names = docs.columns
    at = names.index(text_column)

    def run(batches):
        for b in slices(batches, at):
            columns = b.columns
            columns[at] = pa.array([masked(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
