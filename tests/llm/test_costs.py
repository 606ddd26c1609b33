"""What a token costs in the tasks, that the cheaper forms give the plain ones' results, and what op1 leaves of a text."""

import hashlib
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from trialmill.llm import bpe, maxent, suffixes


def calls_of(f):
    """Python functions that ``f`` enters."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_units_enter_no_python_function_for_each_token():
    words = [b"w%d" % (i % 700) for i in range(20_000)]
    model = maxent.Model(words={b"w%d" % i: i for i in range(500)})
    units, rare = model.units(words)
    assert calls_of(lambda: model.units(words)) < 100
    assert rare.tolist() == [i for i in range(20_000) if i % 700 >= 500]
    assert units.tolist() == [i % 700 if i % 700 < 500 else maxent.TOP + maxent._tail(words[i]) for i in range(20_000)]


def batch(rng, n):
    low = [0, maxent.HASHED, maxent._PAIR, maxent._FAR]
    high = [*low[1:], maxent._BIAS]
    return np.stack([rng.integers(a, b, n) for a, b in zip(low, high, strict=True)]).astype(np.int32), rng.integers(0, maxent.CLASSES, n)


def plain_logs(weights, rows):
    z = weights.astype(float)[rows].sum(0) + weights[maxent._BIAS]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@pytest.mark.parametrize("spread", [0.1, 3, 60, 300])  # the last two leave what 32-bit exponentials can hold
def test_class_logs_equal_the_plain_softmax(spread):
    rng = np.random.default_rng(3)
    weights = rng.normal(0, spread, (maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows, classes = batch(rng, 500)
    wanted = plain_logs(weights, rows)
    close = {"rtol": 1e-4, "atol": 1e-3}
    assert np.allclose(maxent.class_logits(weights, rows), wanted, **close)
    assert np.allclose(maxent.class_shares(weights, rows), np.exp(wanted), rtol=1e-2, atol=1e-4)
    assert np.allclose(maxent.own_logs(weights, rows, classes), wanted[np.arange(500), classes], **close)


def test_training_equals_plain_gradient_steps():
    rng = np.random.default_rng(4)
    data = [batch(rng, n) for n in (3_000, maxent.BATCH + 1_000)]
    weights = np.zeros((maxent.ROWS, maxent.CLASSES))
    size, seen = np.full(maxent.ROWS, 1e-3), np.zeros(maxent.ROWS, np.int64)
    for rows, classes in data:
        for lo in range(0, len(classes), maxent.BATCH):
            r, k = rows[:, lo : lo + maxent.BATCH], classes[lo : lo + maxent.BATCH]
            g = np.exp(plain_logs(weights, r)) - np.eye(maxent.CLASSES)[k]
            for part in [*r, np.full(len(k), maxent._BIAS)]:
                total, often = np.zeros_like(weights), np.bincount(part, minlength=maxent.ROWS)
                np.add.at(total, part, g)
                at = often > 0
                size[at] += (total[at] ** 2).sum(1) / often[at]
                weights[at] -= (maxent.STEP / np.sqrt(size[at] * often[at]))[:, None] * total[at]
                seen += often
    found, found_seen = maxent.train(np.zeros((maxent.ROWS, maxent.CLASSES), np.float32), data)
    assert (found_seen == seen).all()
    assert np.abs(found - weights).max() < 1e-3


def test_split_tokens_equal_plain_words():
    texts = ["", None, " ", "A b\tC\x0b\x0c\r\nd", " x", "x ", "Ä É\x1c\x85  z", "\x00 a\x00b", "Zz zz ZZ  zz"]
    words, sizes = maxent.split_tokens(pa.array(texts, pa.string()))
    plain = [maxent.tokens_of(t) for t in texts]
    assert sizes.tolist() == [len(p) for p in plain]
    assert words.to_pylist() == [w for p in plain for w in p]
    assert maxent.split_tokens(pa.array(texts, pa.large_string()))[0].equals(words)
    some = ["a", "bcd", "été", ""]
    assert maxent._hashes([w.encode() for w in some]).tolist() == [maxent._hash(w.encode()) for w in some]
    assert maxent._tails([w.encode() for w in some]).tolist() == [maxent._tail(w.encode()) for w in some]


def test_counts_and_rare_tokens(make_docs):
    # Words that occur once are more than ``TOP``, so none of them is frequent.
    texts = [" ".join(f"W{(i * k) % 37}" for k in range(i)) for i in range(40)] + [None, ""]
    texts += [" ".join(f"r{k}" for k in range(lo, lo + 7_000)) for lo in range(0, maxent.TOP + 7_000, 7_000)]
    docs = make_docs(list(enumerate(texts)))
    seen = Counter(w for t in texts for w in maxent.tokens_of(t))
    model, counts = maxent.fit(docs)
    assert {r["h"]: r["n"] for r in counts.collect()} == {maxent._hash(w): n for w, n in seen.items()}
    assert model.words.keys() == {w for w, n in seen.items() if n > 1}
    more = make_docs(list(enumerate([*texts, "r1 w1 R1 unseen r2 unseen"])))
    for r in maxent.score(more, model, counts).collect():
        words = maxent.tokens_of((texts + ["r1 w1 r1 unseen r2 unseen"])[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w in seen for w in words))
        assert r["base_score"] == pytest.approx(sum(np.log10((seen[w] + 1) / (model.n + model.v + 1)) for w in words))


BPE = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["the", " The", "'ll", "  ", "\n\n", "\t ", "<|endoftext|>", "é", "ß!", "12345", "日本", "\U0001f642", "\x00", "a" * 300, "b" * 63, " \n x", "\x1c", "\x85", "\xa0", " "]


class Counting:
    """A tokenizers library that remembers how many strings it was given."""

    def __init__(self, library):
        self.library, self.strings = library, 0

    def encode_batch_fast(self, strings, **options):
        self.strings += len(strings)
        return self.library.encode_batch_fast(strings, **options)


def test_new_words_go_to_the_library_many_in_a_string():
    encoder, plain = bpe.LibraryIds(BPE), Tokenizer.from_file(BPE)
    encoder._library = asked = Counting(encoder._library)
    words = [f"{'x' * (i % 5)}{i},ab{i % 97}" for i in range(2_000)]
    texts = [" ".join(words[lo : lo + 500]) for lo in range(0, 2_000, 250)]
    found = encoder.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.strings <= len(texts) + 2_000 // bpe.TOGETHER + 1
    assert calls_of(lambda: encoder.encode(texts)) < 1_000  # 4,000 words, all known


def test_library_ids_of_odd_texts_and_small_memories(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    monkeypatch.setattr(bpe, "GATHERED", 7)
    monkeypatch.setattr(bpe, "TOGETHER", 3)
    monkeypatch.setattr(bpe, "LONGEST", 250)
    rng, encoder, plain = random.Random(5), bpe.LibraryIds(BPE), Tokenizer.from_file(BPE)
    for _ in range(400):
        texts = ["".join(rng.choice([*BITS, " ", " ", f"w{rng.randrange(60)}", f" v{rng.randrange(60)}."]) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(6))]
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == want
    assert len(encoder._known.number) < 40 + 6 * 14 and not any(len(w) > bpe.REMEMBERED for w in encoder._known.number)


def test_repeated_bytes_return_what_is_left(make_docs):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, copied = prose(90), prose(200)
    texts = [prose(50) + shared + prose(40), shared + prose(70), copied, copied, prose(120), "", None, "é" + shared]
    rows = {r["doc_id"]: r for r in suffixes.repeated_bytes(make_docs(list(enumerate(texts))), 60).collect()}
    for i, t in enumerate(texts):
        raw, left, at = (t or "").encode(), b"", 0
        for s in rows[i]["spans"]:
            left, at = left + raw[at : s["start"]], s["end"]
        assert rows[i]["text"].encode() == left + raw[at:]
        assert rows[i]["kept_sha256"] == hashlib.sha256(left + raw[at:]).hexdigest()
    assert [shared in (rows[i]["text"]) for i in (0, 1, 7)] == [False] * 3 and rows[2]["text"] == rows[3]["text"] == "" and rows[4]["text"] == texts[4]
