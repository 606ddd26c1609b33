"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(token | context) = P(class | context) * P(token | class).  The class part is a log-linear
model over hashed features of the tokens before: the previous word, a skip over it to the word
before, the pair of their classes, the class three back together with the last very frequent word, and
a bias.  It is trained on all training documents: each task runs gradient steps over its
rows from the shared weights and sends its change, and changes are averaged per feature,
weighted by how often the task saw it.  The inner part is the add-one share within
the class.

Classes follow the company words keep: the most frequent words and the end mark have
classes of their own; every other word goes with the frequent word that it follows more often
than chance would have it.  Words outside the ``TOP`` most frequent (by summed counts, whole counts at a
time) share the statistics of their last three bytes.  Which words these are does not depend on how the rows are
dealt to tasks; the averaged gradient steps do, as each task steps through its own rows.

What grows with the corpus stays distributed: counts are a table; a document's rare tokens
(each below a 1/TOP share of all tokens, so no key is hot) are joined to it by hash.  Broadcast
are TOP words, the class table and the weights, all of fixed size.

Tokens are words parted at ASCII white space, A-Z lower-cased, then one end mark per
document; they are counted by their 64-bit hash.

Defined results: null text is empty and has the end mark alone; with no training document N = 0
and V = 0; repeated rows are scored each; a null id counts as given by ``training``; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, text_batches

TOP = 65_536
ANCHORS = 15
CLASSES = 2 * ANCHORS + 2
TAILS = 8_192
HASHED = 8_192
ROUNDS = 2
STEP = 0.15
BATCH = 8_192
END = b""
_END_CLASS, _OTHER_CLASS = ANCHORS, CLASSES - 1
# Rows of the weight table: previous word, skipped-to word, class pair, class and anchor, bias.
_PAIR = 2 * HASHED
_FAR = _PAIR + CLASSES * CLASSES
_BIAS = _FAR + CLASSES * (ANCHORS + 1)
ROWS = _BIAS + 1
#: Exponents within which ``CLASSES`` exponentials can be summed as they are.
_EXP = 80
#: Distinct tokens a task counts before it sends what it has; sums do not depend on it.
HELD_TOKENS = 400_000


def tokens_of(text: str | None) -> list[bytes]:
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


def _hash(word: bytes) -> int:
    return xxh3_64_intdigest(word) - (1 << 63)


def _tail(word: bytes) -> int:
    return zlib.crc32(word[-3:]) & (TAILS - 1)


def _hashes(words: list[bytes]) -> np.ndarray:
    """``_hash`` of each word."""
    return (np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


def _tails(words: list[bytes]) -> np.ndarray:
    """``_tail`` of each word."""
    crc = zlib.crc32
    return np.fromiter([crc(w[-3:]) for w in words], np.uint32, len(words)).astype(np.int32) & (TAILS - 1)


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens_of`` all texts in a row, and how many each text has."""
    lower = pc.ascii_lower(texts.cast(pa.string()).fill_null(""))
    # With no white space before it and some after it, a text parts into its words and the empty end mark.
    lists = pc.ascii_split_whitespace(pc.ascii_ltrim_whitespace(pc.binary_join_element_wise(lower, "", " ")))
    return lists.flatten().cast(pa.binary()), np.asarray(lists.value_lengths()).astype(np.int64)


def _listed(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def counted(docs: DataFrame, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(h, n, tail) per token of all rows, and (h, word): which word a hash stands for, once a task or more."""

    def flush(held: pa.Table) -> pa.RecordBatch:
        words = _listed(held.column("word").combine_chunks())
        columns = [
            pa.array(_hashes(words), pa.int64()),
            held.column("n").combine_chunks(),
            pa.array(_tails(words), pa.int32()),
            held.column("word").combine_chunks(),
        ]
        return pa.RecordBatch.from_arrays(columns, ["h", "n", "tail", "word"])

    def summed(parts: list[pa.Table]) -> pa.Table:
        total = pa.TableGroupBy(pa.concat_tables(parts), "word", use_threads=False).aggregate([("n", "sum")])
        return total.rename_columns({"n_sum": "n"})

    def run(batches):
        held: list[pa.Table] = []
        for b in batches:
            for lo, hi in text_batches(b.column(0)):
                found = split_tokens(b.column(0).slice(lo, hi - lo))[0].value_counts()
                held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                if sum(map(len, held)) >= 2 * HELD_TOKENS:
                    held = [summed(held)]
                    if len(held[0]) >= HELD_TOKENS:
                        yield flush(held.pop())
        if held:
            yield flush(summed(held))

    partial = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "h long, n long, tail int, word binary")
    partial = cut(partial, "partial")
    counts = cut(partial.groupBy("h").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")), "counts")
    return counts, partial.select("h", "word")


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The tokens of the highest counts, whole counts at a time, as far as they are at most ``limit``.

    The lowest count that fits is read from the counts of counts, so no tokens are sorted.
    """
    # Few rows: k distinct counts take k (k + 1) / 2 tokens of text.
    of_count = counts.groupBy("n").agg(F.count("*").alias("tokens"))
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = of_count.select("n", F.sum("tokens").over(upto).alias("held")).where(F.col("held") <= limit).agg(F.min("n")).first()[0]
    return counts.limit(0) if least is None else counts.where(F.col("n") >= least)


@dataclass
class Model:
    words: dict[bytes, int] = field(default_factory=dict)  # frequent words, by falling count
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n: int = 0
    v: int = 0
    unit_class: np.ndarray = field(default_factory=lambda: np.full(TOP + TAILS, _OTHER_CLASS, np.int8))
    class_n: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    class_v: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, CLASSES), np.float32))
    _named: tuple[dict, pa.Array] | None = None

    def units(self, words: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each token (a frequent word, or the tail of a rare one), and where the rare ones stand."""
        if self._named is None or self._named[0] is not self.words:
            self._named = (self.words, pa.array(list(self.words), pa.binary()))
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        ids = np.array(pc.index_in(words, self._named[1]).fill_null(-1))
        rare = np.flatnonzero(ids < 0)
        ids[rare] = TOP + _tails(_listed(words.take(pa.array(rare))))
        return ids, rare

    def inner_logs(self) -> np.ndarray:
        """log10 of the share's denominator per class; classes of one word have share 1."""
        out = np.log10(self.class_n + self.class_v + 1)
        out[: ANCHORS + 1] = np.nan
        return out


def anchors_before(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens, where their document starts, and the last very frequent word before each."""
    n = len(classes)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(first, at, 0))
    seen = np.where((classes < ANCHORS), at, -1)
    last = np.r_[-1, np.maximum.accumulate(seen)[:-1]] if n else seen
    return at, start, np.where(last >= start, classes[np.maximum(last, 0)], ANCHORS)


def features(classes: np.ndarray, units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(4 x tokens) rows of the weight table, from the tokens before each; ``first`` marks documents' first tokens."""
    at, start, anchor = anchors_before(classes, first)
    back = []
    for k in (1, 2, 3):
        inside = at - k >= start
        source = np.maximum(at - k, 0)
        back.append((np.where(inside, units[source], 0), np.where(inside, classes[source], _END_CLASS).astype(np.int64)))
    (u1, k1), (u2, k2), (_, k3) = back
    mixed = lambda u, salt: ((u.astype(np.uint32) * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(16)) % HASHED
    return np.stack([mixed(u1, 0), HASHED + mixed(u2, 77_777), _PAIR + k1 * CLASSES + k2, _FAR + k3 * (ANCHORS + 1) + anchor]).astype(np.int32)


def _sums(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Summed weights of a batch of feature rows, brought to where sums of their exponentials stay in 32-bit floats."""
    z = weights.take(rows[0], 0)
    for r in rows[1:]:
        z += weights.take(r, 0)
    z += weights[_BIAS]
    if not (z.min(initial=0) > -_EXP and z.max(initial=0) < _EXP):
        z -= z.max(1, keepdims=True)
    return z


def class_logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes for a batch of feature rows."""
    z = _sums(weights, rows)
    z -= np.log(_row_sums(np.exp(z)))[:, None]
    return z


def _row_sums(z: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", z)


def class_shares(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the classes for a batch of feature rows."""
    z = _sums(weights, rows)
    np.exp(z, out=z)
    z /= _row_sums(z)[:, None]
    return z


def own_logs(weights: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log probability of each token's own class."""
    z = _sums(weights, rows)
    own = z[np.arange(len(classes)), classes]
    np.exp(z, out=z)
    return own - np.log(_row_sums(z))


def train(weights: np.ndarray, stream, step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Gradient steps over (rows, classes) batches; returns new weights and how often each row was seen."""
    weights = weights.copy()
    size = np.full(ROWS, 1e-3, np.float32)  # squared gradients so far, per row
    seen = np.zeros(ROWS, np.int64)
    for rows, classes in stream:
        for lo in range(0, len(classes), BATCH):
            r, k = rows[:, lo : lo + BATCH], classes[lo : lo + BATCH]
            g = class_shares(weights, r)
            g[np.arange(len(k)), k] -= 1
            for part in r.astype(np.uint16):  # ROWS are fewer than 2^16, and two bytes are sorted by radix
                order = np.argsort(part, kind="stable")
                ordered = part[order]
                starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                # Two neighbouring columns at a time: complex numbers are added part by part.
                total = np.add.reduceat(g.take(order, 0).view(np.complex64), starts, axis=0).view(np.float32)
                at = ordered[starts]
                often = np.diff(np.r_[starts, len(ordered)])
                size[at] += np.einsum("ij,ij->i", total, total) / often
                total *= (step / np.sqrt(size[at] * often)).astype(np.float32)[:, None]
                weights[at] -= total
                seen[at] += often
            bias = g.sum(0)
            size[_BIAS] += float((bias * bias).sum()) / len(k)
            weights[_BIAS] -= step / np.sqrt(size[_BIAS] * len(k)) * bias
            seen[_BIAS] += len(k)
    return weights, seen


def _batches_of(b: pa.RecordBatch, column: int):
    """Tokens of about a batch of text, with the first token of each document marked."""
    texts = b.column(column)
    for lo, hi in text_batches(texts, 1_000_000):
        words, sizes = split_tokens(texts.slice(lo, hi - lo))
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(words), bool)
        first[starts] = True
        yield lo, hi, words, starts, first


def company(docs: DataFrame, shared, text_column: str) -> np.ndarray:
    """(units x anchors + 1) how often each unit occurs with each last frequent word before it."""

    def run(batches):
        m: Model = shared.value
        total = np.zeros((TOP + TAILS) * (ANCHORS + 1), np.int64)
        held, n = [], 0
        for b in batches:
            for _, _, words, _, first in _batches_of(b, 0):
                units, _ = m.units(words)
                anchor = anchors_before(m.unit_class[units], first)[2]
                held.append(units * (ANCHORS + 1) + anchor)
                n += len(words)
                if n >= len(total):
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros((TOP + TAILS) * (ANCHORS + 1), np.int64)
    found = cells.toArrow()  # at most (TOP + TAILS) * (ANCHORS + 1) rows of two numbers
    out[np.asarray(found.column("cell"))] = np.asarray(found.column("n"))
    return out.reshape(-1, ANCHORS + 1)


def classes_from(table: np.ndarray, model: Model) -> np.ndarray:
    """Class of every unit: its own for anchors and the end mark, else by the anchor most over-represented before it."""
    out = np.full(len(table), _OTHER_CLASS, np.int8)
    seen = table[:, :ANCHORS].astype(float)
    expected = (seen.sum(1, keepdims=True) + 1) * (seen.sum(0) + 1) / (seen.sum() + ANCHORS)
    # Log-likelihood style weight: lift that is supported by counts.
    lift = (seen + 0.5) / (expected + 0.5)
    has = seen.sum(1) > 0
    out[has] = ANCHORS + 1 + lift[has].argmax(1)
    order = [i for w, i in model.words.items() if w != END][:ANCHORS]
    out[order] = np.arange(len(order))
    if END in model.words:
        out[model.words[END]] = _END_CLASS
    return out


def fit(docs: DataFrame, text_column: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table (h, n) of token counts, from all rows of ``docs``."""
    spark = docs.sparkSession
    counts, names = counted(docs, text_column)
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()[0]
    model = Model(n=totals["n"] or 0, v=totals["v"])
    # Fixed number of rows: the TOP most frequent tokens by summed counts.
    top = cut(most_frequent(counts, TOP).select("h", "n"), "top")
    named = names.join(F.broadcast(top), "h").groupBy("h", "n").agg(F.min("word").alias("word")).collect()
    top = sorted(((r["n"], bytes(r["word"])) for r in named), key=lambda r: (-r[0], r[1]))
    model.words = {w: i for i, (_, w) in enumerate(top)}
    model.counts = np.array([n for n, _ in top], np.int64)
    if not model.n:
        return model, counts.select("h", "n")
    # Provisional classes name the anchors, so that company can be counted.
    model.unit_class = classes_from(np.zeros((TOP + TAILS, ANCHORS + 1), np.int64), model)
    table = company(docs, spark.sparkContext.broadcast(model), text_column)
    model.unit_class = classes_from(table, model)
    unit_n = table.sum(1)
    model.class_n = np.bincount(model.unit_class, weights=unit_n, minlength=CLASSES)
    # Distinct tokens per class: frequent ones one by one, rare ones by tail.
    model.class_v = np.bincount(model.unit_class[: len(top)], minlength=CLASSES).astype(float)
    by_tail = np.zeros(TAILS, np.int64)
    for r in counts.groupBy("tail").agg(F.count("*").alias("v")).collect():  # at most TAILS rows
        by_tail[r["tail"]] = r["v"]
    np.subtract.at(by_tail, [_tail(w) for w in model.words], 1)
    np.add.at(model.class_v, model.unit_class[TOP:], by_tail)
    model.weights[_BIAS] = np.log((model.class_n + 1) / (model.class_n.sum() + CLASSES))
    for r in range(ROUNDS):
        model.weights = _round(docs, spark.sparkContext.broadcast(model), text_column, r)
    return model, counts.select("h", "n")


def _round(docs: DataFrame, shared, text_column: str, number: int) -> np.ndarray:
    """One round: tasks train on their part of the rows, their changes are averaged by use."""
    block = 512

    def run(batches):
        m: Model = shared.value

        def stream():
            for b in batches:
                for _, _, words, _, first in _batches_of(b, 0):
                    units, _ = m.units(words)
                    classes = m.unit_class[units].astype(np.int64)
                    yield features(classes, units, first), classes

        after, seen = train(m.weights, stream())
        change = after - m.weights
        for lo in range(0, ROWS, block):
            if seen[lo : lo + block].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lo], pa.int32()), pa.array([change[lo : lo + block].astype(np.float16).tobytes()], pa.binary()), pa.array([seen[lo : lo + block].astype(np.int64).tobytes()], pa.binary())],
                    ["lo", "change", "seen"],
                )

    def add(group: pa.Table) -> pa.Table:
        total, weight = 0.0, 0
        for change, seen in zip(group.column("change").to_pylist(), group.column("seen").to_pylist(), strict=True):
            often = np.frombuffer(seen, np.int64)
            total = total + np.frombuffer(change, np.float16).reshape(len(often), -1).astype(np.float64) * often[:, None]
            weight = weight + often
        mean = (total / np.maximum(weight, 1)[:, None]).astype(np.float32)
        return pa.table({"lo": pa.array([group.column("lo")[0].as_py()], pa.int32()), "change": pa.array([mean.tobytes()], pa.binary())})

    # Each round takes its own part of the rows, so all rows are used once.
    part = docs.where(F.pmod(F.xxhash64(text_column), F.lit(ROUNDS)) == number) if ROUNDS > 1 else docs
    changes = part.select(F.col(text_column).alias("text")).mapInArrow(run, "lo int, change binary, seen binary")
    weights = shared.value.weights.copy()
    for r in changes.groupBy("lo").applyInArrow(add, "lo int, change binary").collect():  # ROWS rows in all
        change = np.frombuffer(r["change"], np.float32).reshape(-1, CLASSES)
        weights[r["lo"] : r["lo"] + len(change)] += change
    return weights


def score(docs: DataFrame, model: Model, counts: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    base_total = np.log10(model.n + model.v + 1)
    kept = keep or []

    def run(batches):
        m: Model = shared.value
        top_log = np.log10(m.counts + 1) if len(m.counts) else np.zeros(1)
        inner = m.inner_logs()
        single = np.isnan(inner)
        for b in batches:
            for lo, hi, words, starts, first in _batches_of(b, 1):
                units, rare = m.units(words)
                classes = m.unit_class[units].astype(np.int64)
                rows = features(classes, units, first)
                value = np.empty(len(words))
                for k in range(0, len(words), BATCH):
                    value[k : k + BATCH] = own_logs(m.weights, rows[:, k : k + BATCH], classes[k : k + BATCH])
                value /= np.log(10)
                known = np.where(units < TOP, top_log[np.minimum(units, len(top_log) - 1)], 0.0)
                value += np.where(single[classes], 0.0, known - inner[classes])
                sizes = np.diff(np.r_[starts, len(words)])
                doc = np.repeat(np.arange(len(starts)), sizes)
                is_known = np.ones(len(words), np.int64)
                is_known[rare] = 0
                # Each document's rare tokens, and how often it has each.
                h, of = _hashes(_listed(words.take(pa.array(rare)))), doc[rare]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                each = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)])
                upto = pa.array(np.searchsorted(of[each], np.arange(len(starts) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(c).slice(lo, hi - lo) for c in (0, *range(2, b.num_columns))],
                        pa.array(sizes.astype(np.int64)),
                        pa.array(np.add.reduceat(is_known, starts)),
                        pa.array(np.add.reduceat(known, starts) - sizes * base_total),
                        pa.array(np.add.reduceat(value, starts)),
                        pa.ListArray.from_arrays(upto, pa.array(h[each])),
                        pa.ListArray.from_arrays(upto, pa.array(np.diff(np.r_[each, len(h)]).astype(np.int32))),
                    ],
                    names,
                )

    names = ["id", *[f"k{i}" for i in range(len(kept))], "n_tokens", "n_known", "base", "score", "rare", "times"]
    fields = [f"id {kind}", *[f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]]
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)])
    scored = plain.mapInArrow(run, ", ".join(fields) + ", n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>")
    scored = cut(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    # A rare token's count is missing so far; it adds log10(count + 1) to both scores.
    each = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("uid", F.col("t.rare").alias("h"), F.col("t.times").alias("times"))
    found = each.join(counts, "h")
    sums = found.groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return (
        scored.drop("rare", "times")
        .join(sums, "uid", "left")
        .select(
            F.col("id").alias(id_column),
            *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(model.n).cast("long").alias("train_tokens"),
            (F.col("base") + more).alias("base_score"),
            (F.col("score") + more).alias("score"),
        )
    )
