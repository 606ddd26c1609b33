"""Toxicity by compression distance between two zstandard dictionaries.

The method as published trains both dictionaries with zstandard, each on text of its own
class.  Here the toxic one is a raw list of the stretches that are typical of toxic training
texts, and the ordinary one is the end of a trained dictionary, at the same length: held out,
this does far better (figures in the README).  Toxic words that ordinary texts use more than
a thirtieth as often are not in the list.  Only where no stretch is typical (few toxic labels,
say) are both dictionaries trained, on windows of their own class at one full size.  A text is cut into windows of whole words;
each window is compressed with either dictionary, and the difference in length says which
one knows its words.  Window differences become four numbers per document, and a logistic
curve fitted on other training documents turns these into a score; that is the calibration.

A zstandard block of a few words would be stored raw, so every window is compressed behind
a short primer that both dictionaries hold: its match pays the block's fixed cost, and each
further match shows as saved bytes.

Training reads at most ``TRAIN_ROWS`` labelled documents (smallest hash of the id first)
of at most ``TRAIN_CHARS`` characters each.  Scoring
covers every whole text.

Defined results: null and empty texts get the score of a text without windows; without
any usable label (or with one class only) every score is the share of toxic labels, 0 if there are none; null
labels are unlabelled; a document labelled twice counts as often; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TRAIN_ROWS = 12_000
TRAIN_CHARS = 200_000
WINDOW = 40
GRAM = 6
DICTIONARY_BYTES = 16_384
THRESHOLD = 0.3
#: A typical stretch: so many toxic documents, so many standard deviations, so many times the ordinary rate.
LEAST_DOCUMENTS, LEAST_DEVIATIONS, LEAST_RATIO = 4, 4.0, 30.0

_PRIMER = bytes(random.Random(7).choices(range(128, 256), k=24))
_WINDOWS = re.compile(rb"(?s).{1,%d}(?=\s|\Z)|.{%d}" % (WINDOW - 1, WINDOW))
_BLANKS = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def clean(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode().translate(_BLANKS)


def _grams(raw: bytes) -> set[bytes]:
    out: set[bytes] = set()
    for word in set(raw.split()):
        word = b" " + word
        out.update(word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1)))
    return out


def typical_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Stretches of words that many toxic and hardly any ordinary texts hold, most frequent first."""
    of_toxic, of_ordinary = Counter(), Counter()
    for raw in toxic:
        of_toxic.update(_grams(raw))
    for raw in ordinary:
        of_ordinary.update(g for g in _grams(raw) if g in of_toxic)
    n1, n0 = len(toxic), len(ordinary)
    typical = set()
    for gram, a in of_toxic.items():
        b = of_ordinary[gram]
        share = (a + b) / (n1 + n0)
        spread = math.sqrt(n1 * share * (1 - share) * n0 / (n1 + n0)) or 1.0
        if a >= LEAST_DOCUMENTS and (a - n1 * share) / spread >= LEAST_DEVIATIONS and a / n1 >= LEAST_RATIO * (b + 0.5) / n0:
            typical.add(gram)
    found: Counter[bytes] = Counter()
    for raw in toxic:
        for word in raw.split():
            word = b" " + word
            held = bytearray(len(word))
            for i in range(max(1, len(word) - GRAM + 1)):
                if word[i : i + GRAM] in typical:
                    held[i : i + GRAM] = b"\x01" * len(word[i : i + GRAM])
            for m in re.finditer(rb"\x01+", bytes(held)):
                found[word[m.start() : m.end()]] += 1
    return [s for s, _ in sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)
    middle: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    base: float = 0.0
    trained: bool = False  # both dictionaries by zstandard, at full size


class Scorer:
    """The two compressors and the curve, built once in each task."""

    def __init__(self, model: Model):
        self.model = model
        window_log, hash_log, chain_log = (15, 12, 13) if model.trained else (14, 8, 11)
        settings = zstandard.ZstdCompressionParameters(
            window_log=window_log, hash_log=hash_log, chain_log=chain_log, min_match=6, strategy=5,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self._compress = []
        for content in (model.toxic, model.ordinary):
            d = zstandard.ZstdCompressionDict(content + _PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            self._compress.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=d).compress)

    def features(self, text: str | None) -> tuple[float, ...]:
        raw = clean(text)
        toxic, ordinary = self._compress
        windows = [_PRIMER + w for w in _WINDOWS.findall(raw) if len(w) >= GRAM]
        if not windows:
            return (0.0, 0.0, 0.0, 0.0)
        saved = np.fromiter(map(len, map(ordinary, windows)), np.float64, len(windows))
        saved -= np.fromiter(map(len, map(toxic, windows)), np.float64, len(windows))
        gain = np.maximum(saved, 0)
        root = math.sqrt(len(windows))
        return (float(saved.max()), float(gain.sum()) / root, float((saved >= 6).sum()) / root, math.log1p(len(windows)))

    def score(self, text: str | None) -> float:
        m = self.model
        if not m.weights:
            return m.base
        z = m.weights[-1] + sum(w * (f - a) / s for w, f, a, s in zip(m.weights, self.features(text), m.middle, m.scale, strict=False))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and intercept by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def dictionaries(rows: list[tuple[str | None, int]]) -> Model | None:
    """A model without a curve: what toxic texts typically hold, and what ordinary ones do."""
    toxic = [clean(t) for t, y in rows if y]
    ordinary = [clean(t) for t, y in rows if not y]
    if not toxic or not ordinary:
        return None
    content = b""
    for stretch in typical_stretches(toxic, ordinary):
        if len(content) + len(stretch) + 1 > DICTIONARY_BYTES:
            break
        content = b"\x00" + stretch + content  # the most frequent ends up nearest
    if not content:
        return Model(toxic=_trained(toxic, DICTIONARY_BYTES), ordinary=_trained(ordinary, DICTIONARY_BYTES), trained=True)
    return Model(toxic=content, ordinary=_trained(ordinary, max(4096, len(content)))[-len(content) :])


def _trained(raws: list[bytes], size: int) -> bytes:
    """A zstandard dictionary for windows of these texts."""
    windows = [w for raw in raws for w in _WINDOWS.findall(raw)]
    windows = random.Random(11).sample(windows, min(len(windows), 20_000))
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(windows)[-size:]


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """A model from labelled texts.

    The curve must not see texts that the dictionaries were trained on: two rows of three
    make dictionaries, the third one the curve.
    """
    if not rows:
        return Model()
    share = sum(y for _, y in rows) / len(rows)
    model = dictionaries([r for i, r in enumerate(rows) if i % 3 != 2])
    rest = rows[2::3]
    if model is None or len({y for _, y in rest}) < 2:
        return Model(base=share)
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t, _ in rest])
    y = np.array([float(v) for _, v in rest])
    middle, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights = [float(v) for v in _logistic((x - middle) / scale, y)]
    model.middle, model.scale, model.base = middle.tolist(), scale.tolist(), share
    return model


def training_rows(docs: DataFrame, labels: DataFrame, usable, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> list[tuple[str | None, int]]:
    """The bounded sample: at most TRAIN_ROWS labelled texts, by the hash of the id."""
    chosen = (
        labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & usable)
        .select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"), F.xxhash64(id_column).alias("h"))
        .orderBy("h", "id", "y")
        .limit(TRAIN_ROWS)
    )
    # At most TRAIN_ROWS ids, so the broadcast has a fixed bound.
    texts = docs.where(F.length(text_column) <= TRAIN_CHARS).select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    rows = texts.join(F.broadcast(chosen), "id").collect()
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["h"], r["id"], r["y"], r["t"]))[:TRAIN_ROWS]]


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every whole text.  No shuffle."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        scorer = Scorer(model) if model.weights else None
        for b in slices(batches, 1):
            out = [scorer.score(t) if scorer else model.base for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["id", "score"])

    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)
