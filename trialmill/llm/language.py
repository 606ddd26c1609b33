"""Language identification as a mixture of languages, fitted per document by expectation-maximisation.

Each language is a table of letter n-gram frequencies (orders 3 and 4 over UTF-8 bytes,
hashed).  A document's words are drawn from an unknown mixture of languages; the word's
likelihood under a language is that of its n-grams.  Expectation-maximisation estimates the
mixture, and languages join the document's set one at a time for as long as the
likelihood, less a penalty of half the logarithm of the number of words per language, grows.
The predicted language is the set's largest share.

Language tables are fitted on at most ``TRAIN_ROWS`` documents per language (those with the
smallest hash of the id), each at most ``TRAIN_CHARS`` characters long; counting runs in
tasks.  Prediction covers every whole text.

Defined results: null text and text without a letter give ``und`` and score 0; ties go to
the language that sorts first; with no labelled row at all every text is ``und``; rows with a null
language are not learned from; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, text_batches

TRAIN_ROWS = 1_500
TRAIN_CHARS = 100_000
BITS = 16
ROUNDS = 6
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
# Bytes that are no letters part words.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _words(texts: list[str | None]):
    """Folded bytes of all texts with blanks around, and the document of each byte."""
    raws = [(t or "").lower().encode() for t in texts]
    sizes = np.array([len(r) + 2 for r in raws], np.int64)
    joined = np.frombuffer(b"".join(b" " + r + b" " for r in raws), np.uint8)
    return _FOLD[joined], np.repeat(np.arange(len(raws)), sizes)


def _grams(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of letters, and the two hashed n-grams that end just after each (as columns of one table)."""
    b = folded.astype(np.uint32)
    n = len(b)
    at = np.flatnonzero(folded != 32)
    before, here, after = b[at - 1], b[at], b[at + 1]
    two_before = np.where(before == 32, 32, b[np.maximum(at - 2, 0)])
    three = (before << 16) | (here << 8) | after
    four = three | (two_before << 24)
    mask = np.uint32((1 << BITS) - 1)
    h3 = ((three * np.uint32(2654435761)) >> np.uint32(32 - BITS)) & mask
    h4 = (((four ^ (four >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(32 - BITS)) & mask
    assert n
    return at, np.stack([h3, h4 + np.uint32(1 << BITS)])


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (2 << BITS, languages) log frequencies


#: Tasks that count the sample's n-grams; the sample is bounded, the scan before it runs in its own tasks.
COUNT_TASKS = 8


def count_grams(docs: DataFrame, lang_column: str, text_column: str) -> dict[str, np.ndarray]:
    """n-gram counts per language, summed by (language, cell): at most one row a language and cell reaches the driver."""

    def run(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, grams = _grams(_words([text])[0])
                if lang not in found:
                    found[lang] = np.zeros(2 << BITS, np.int64)
                found[lang] += np.bincount(grams.ravel(), minlength=2 << BITS)
        for lang, table in found.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["lang", "cell", "n"])

    plain = docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    cells = plain.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    total: dict[str, np.ndarray] = {}
    langs = np.array(cells.column("lang").to_pylist(), object)
    at, n = np.asarray(cells.column("cell")), np.asarray(cells.column("n"))
    for lang in sorted(set(langs)):
        mine = langs == lang
        total[lang] = np.zeros(2 << BITS, np.int64)
        total[lang][at[mine]] = n[mine]
    return total


def fit(docs: DataFrame, usable, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Language tables from the bounded sample of labelled documents.

    The sample keeps, per language, the share of rows (by hash of the id) that gives about
    TRAIN_ROWS documents, so each language is heard however rare it is.
    """
    known = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & (F.length(text_column) <= TRAIN_CHARS) & usable)
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_column).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((2 << BITS, 0)))
    steps = 1_000_000
    keep = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, max(1, min(steps, steps * TRAIN_ROWS // n)))])
    sample = known.where(F.pmod(F.xxhash64(id_column, F.lit("lang")), F.lit(steps)) < keep[F.col(lang_column)])
    counts = count_grams(sample.select(lang_column, text_column).repartition(COUNT_TASKS), lang_column, text_column)
    # A language without any letter in its sample is not learned.
    languages = sorted(counts)
    logs = []
    for lang in languages:
        half = counts[lang].reshape(2, -1) + 0.5
        logs.append(np.log(half / half.sum(1, keepdims=True)).ravel())
    return Model(languages, np.stack(logs, 1).astype(np.float32) if logs else np.zeros((2 << BITS, 0)))


def _mixture(like: np.ndarray, starts: np.ndarray, docs_of: np.ndarray, n_words: np.ndarray, rounds: int = ROUNDS):
    """Shares (documents x languages) and log likelihood of each document, by expectation-maximisation."""
    shares = np.full((len(starts), like.shape[1]), 1.0 / like.shape[1], np.float32)
    for _ in range(rounds):
        joint = like * shares[docs_of]
        joint /= joint.sum(1, keepdims=True)
        shares = np.add.reduceat(joint, starts, axis=0) / n_words[:, None]
    total = (like * shares[docs_of]).sum(1)
    return shares, np.add.reduceat(np.log(np.maximum(total, 1e-30)), starts)


def mixtures(texts: list[str | None], model: Model) -> list[tuple[str, float, list[str]]]:
    """(largest language, its share, language set) of each text."""
    n = len(texts)
    out: list[tuple[str, float, list[str]]] = [(UNKNOWN, 0.0, [])] * n
    if not model.languages:
        return out
    letters = np.array([bool(t) and _LETTER.search(t) is not None for t in texts])
    if not letters.any():
        return out
    folded, doc_of = _words(texts)
    at, grams = _grams(folded)
    if not len(at):
        return out
    per_letter = model.logs[grams[0]] + model.logs[grams[1]]
    first = np.flatnonzero(folded[at - 1] == 32)
    words = np.add.reduceat(per_letter, first, axis=0)
    word_doc = doc_of[at[first]]
    # Likelihoods relative to the best language of the word; half weight, as the two orders overlap.
    words = 0.5 * (words - words.max(1, keepdims=True))
    like = np.exp(np.maximum(words, -30.0)).astype(np.float32)
    starts = np.flatnonzero(np.r_[True, word_doc[1:] != word_doc[:-1]])
    which = word_doc[starts]
    n_words = np.diff(np.r_[starts, len(word_doc)])
    docs_of = np.repeat(np.arange(len(starts)), n_words)
    full, _ = _mixture(like, starts, docs_of, n_words)
    order = np.argsort(-full, axis=1, kind="stable")
    best_value = np.full(len(starts), -np.inf)
    chosen = np.ones(len(starts), np.int64)
    top_share = np.zeros(len(starts))
    top_lang = order[:, 0].copy()
    open_ = np.arange(len(starts))
    for k in range(1, len(model.languages) + 1):
        # Only documents whose set may still grow are fitted again.
        rows = np.concatenate([np.arange(starts[i], starts[i] + n_words[i]) for i in open_]) if len(open_) < len(starts) else np.arange(len(docs_of))
        sub_n = n_words[open_]
        sub_of = np.repeat(np.arange(len(open_)), sub_n)
        sub_starts = np.r_[0, np.cumsum(sub_n)[:-1]]
        part = np.take_along_axis(like[rows], order[open_, :k][sub_of], axis=1)
        shares, value = _mixture(part, sub_starts, sub_of, sub_n, ROUNDS if k > 1 else 1)
        value = value - 0.5 * k * np.log(sub_n + 1)
        better = value > best_value[open_]
        took = open_[better]
        best_value[took], chosen[took] = value[better], k
        top_share[took] = shares[better].max(1)
        top_lang[took] = order[took, shares[better].argmax(1)]
        open_ = took
        if not len(open_):
            break
    # Score: the share in the chosen set, weighed by the share that the free mixture gives.
    confidence = np.sqrt(np.clip(top_share * full[np.arange(len(starts)), top_lang], 0, 1))
    for j, d in enumerate(which):
        if letters[d]:
            out[d] = (model.languages[top_lang[j]], float(confidence[j]), [model.languages[i] for i in order[j, : chosen[j]]])
    for d in np.flatnonzero(letters):
        if not out[d][2]:
            out[d] = (model.languages[0], 1.0 / len(model.languages), [model.languages[0]])
    return out


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, lang_set) of every whole text, with the columns of ``keep``.  No shuffle."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2^(BITS + 1) numbers a language
    kept = [c for c in (keep or []) if c != id_column]
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(1)
            for lo, hi in text_batches(texts, BATCH_BYTES // 4):
                found = mixtures(texts.slice(lo, hi - lo).to_pylist(), m)
                arrays = [b.column(0).slice(lo, hi - lo), *[b.column(2 + i).slice(lo, hi - lo) for i in range(len(kept))]]
                arrays += [pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", *[f"_k{i}" for i in range(len(kept))], "_pred", "_score", "_set"])

    plain = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)])
    fields = [f"_id {kind}", *[f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)], "_pred string", "_score double", "_set array<string>"]
    out = plain.mapInArrow(run, ", ".join(fields))
    return out.select(F.col("_id").alias(id_column), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_set").alias("lang_set"))
