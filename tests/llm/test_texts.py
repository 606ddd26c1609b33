"""Operators that judge each text alone: BPE, packing, secrets, toxicity, language."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialmill.llm import bpe, language, packing, secrets, toxicity
from trialmill.llm.common import crc_mod

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC = bpe.codec(PATH)
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["the", " The", "'ll", "  ", "\n\n", "\t ", "<|endoftext|>", "é", "ß!", "12345", "日本", "🙂", "\x00", "a" * 300, " \n x", "\x1c", "\x85", "\xa0"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text("abcdefgh .,'\n\t12é", max_size=12)), max_size=12))
def test_bpe_agrees_with_the_library(parts):
    text = "".join(parts)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    packed = CODEC.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert CODEC.decode(packed) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_pair_table_agrees_with_merging():
    random.seed(5)
    tokens = list(CODEC.vocab.items())
    for _ in range(300):
        (a, i), (b, j) = random.choice(tokens), random.choice(tokens)
        merged = LIBRARY.model.tokenize(a + b)
        assert CODEC.fits(i, j) == ([t.id for t in merged] == [i, j])


def test_bpe_rows(make_docs):
    texts = [None, "", "plain words", "plain words", "x" * 200_000]
    out = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(make_docs(enumerate(texts)), PATH).collect()}
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()) in out
    assert bpe.digests(make_docs([]), PATH).count() == 0
    encoded = bpe.encode(make_docs([(1, "round trip é")]), PATH)
    assert bpe.decode(encoded, PATH).collect()[0]["text"] == "round trip é"


def check_packing(rows, texts):
    ids = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, all_ids in ids.items():
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert len(parts) == -(-len(all_ids) // 2048)
        at = 0
        for k, p in enumerate(parts):
            assert p["start"] == at
            assert k == 0 or p["length"] == 2048
            assert p["ids_crc32"] == zlib.crc32(np.array(all_ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(all_ids)
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_bin)


def test_packing_rows(make_docs):
    random.seed(2)
    texts = [(i, " ".join(random.choices(["the", "of", "zebra", "stone"], k=random.randrange(1, 1500)))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, "word " * 7000)]
    rows = packing.pack_documents(make_docs(texts), PATH).collect()
    used = check_packing(rows, texts)
    # At most one sequence above the bound that no packing can beat.
    assert used <= packing.lower_bound(Counter(r["length"] for r in rows), 2048) + 1
    assert packing.pack_documents(make_docs([]), PATH).count() == 0
    repeated = packing.pack_documents(make_docs([(1, "same"), (1, "same"), (None, "same")]), PATH).collect()
    assert sorted(r["offset"] for r in repeated) == [0, 2, 4]


def test_packing_of_many_empty_texts(make_docs):
    random.seed(3)
    texts = [(i, " ".join(random.choices(["the", "of", "zebra", "stone"], k=random.randrange(1, 1500)))) for i in range(20)]
    texts += [(100 + i, (None, "")[i % 2]) for i in range(5_000)]
    rows = packing.pack_documents(make_docs(texts), PATH).collect()
    assert len(rows) == len(texts)
    assert check_packing(rows, texts) == packing.lower_bound(Counter(r["length"] for r in rows), 2048)
    # A dive itself takes bins of 2,048 pieces.
    dive = packing.complete_bins({1: 5_000, 700: 9, 1_500: 4}, 2048)
    assert sum(t * sum(b) for t, b in dive) == 5_000 + 9 * 700 + 4 * 1_500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_holds_every_piece(sizes):
    runs = packing.plan(Counter(sizes), 40)
    placed = Counter()
    for times, bin_ in runs:
        assert sum(bin_) <= 40
        for s in bin_:
            placed[s] += times
    assert placed == Counter(sizes)
    used = sum(t for t, _ in runs)
    assert packing.lower_bound(Counter(sizes), 40) <= used <= sum(t for t, _ in packing.best_fit(Counter(sizes), 40))


def test_plan_is_as_good_as_exhaustive_search():
    def smallest(items, bins=()):
        if not items:
            return len(bins)
        best = len(bins) + len(items)
        seen = set()
        for k, room in enumerate(bins):
            if room >= items[0] and room not in seen:
                seen.add(room)
                best = min(best, smallest(items[1:], (*bins[:k], room - items[0], *bins[k + 1 :])))
        return min(best, smallest(items[1:], (*bins, 20 - items[0])))

    random.seed(9)
    for _ in range(40):
        items = sorted((random.randrange(3, 15) for _ in range(8)), reverse=True)
        assert sum(t for t, _ in packing.plan(Counter(items), 20)) == smallest(items)


def brute_base(text):
    """Base spans, by hand-written scanning instead of patterns."""
    word = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    spans, i = [], 0
    while i < len(text):
        names = [n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[i : i + len(n)].lower() == n and text[i : i + len(n)].isascii()]
        end = None
        for n in names:
            at = i + len(n)
            for quote in ((1, 0) if text[at : at + 1] in ('"', "'") else (0,)):
                p = at + quote
                while text[p : p + 1] == " ":
                    p += 1
                if text[p : p + 1] not in (":", "=") or p >= len(text):
                    continue
                p += 1
                while text[p : p + 1] == " ":
                    p += 1
                p += text[p : p + 1] in ('"', "'") and p < len(text)
                q = p
                while q < len(text) and text[q] in word:
                    q += 1
                if q > p:
                    end = (p, q)
                    break
            if end:
                break
        if end:
            if end[1] - end[0] >= 12:
                spans.append(("assign", i, end[1]))
            i = end[1]
        else:
            i += 1
    for kind, alphabet, prefix, least in (("access", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 18), ("hex", "0123456789abcdef", "", 16)):
        i = 0
        while i < len(text):
            if text.startswith(prefix, i) and text[i] in alphabet:
                q = i + len(prefix)
                while q < len(text) and text[q] in alphabet:
                    q += 1
                if q - i >= least:
                    spans.append((kind, i, q))
                i = max(q, i + 1)
            else:
                i += 1
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(['password', 'API_key', 'apikey', '"', "'", ' = ', ':', '  ', 'abcdef0123456789', 'AKIA', 'ABCDEFGH12345678', 'é', 'Zz9/+', '\n', 'ſecret', 'token', '=']), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == brute_base(text)


def test_lexed_spans():
    text = 'seed = "hQ9x7Lm2Pz4v"\nDB_PASSWORD = seed\nname = "just some words"\n{"clientSecret": "Zk83nd72Hs0aQ"}\n<auth_token>9fK2mQ7xLp3w</auth_token>\npassword = "changeme"\nkey = "ab" + seed\n'
    found = {text[s:e] for _, s, e in secrets.lexed_spans(text)}
    assert found == {"hQ9x7Lm2Pz4v", "Zk83nd72Hs0aQ", "9fK2mQ7xLp3w"}


def test_lexed_spans_of_any_size():
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdefghABCDEFGH0123456789", k=n))
    key, parts, long_name = make(1_600), [make(16) for _ in range(300)], "x" * 300 + "_password"
    chain = "v = ''\n" + "".join(f'v = v + "{p}"\n' for p in parts) + "db_password = v\n"
    text = f"<privateKey>{key}</privateKey>\n{chain}{long_name} = 'hQ9x7Lm2Pz4v'\n"
    assert {text[s:e] for _, s, e in secrets.lexed_spans(text)} == {key, *parts, "hQ9x7Lm2Pz4v"}
    # Long runs of name characters, and values that grow by themselves, take linear time.
    assert secrets.lexed_spans("a." * 300_000 + "\n" + "v = v + v\n" * 20_000) == []


def test_secret_rows(make_docs):
    texts = [None, "", "token: abcdefghijkl é AKIA" + "Z" * 16 + " 0123456789abcdef", "é" * 50_000 + " secret=abcdefghijklmnop"]
    rows = {r["doc_id"]: r for r in secrets.scan(make_docs(enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert (rows[i]["n_assign"], rows[i]["n_access"], rows[i]["n_hex"]) == tuple(sum(k == w for k, _, _ in base) for w in ("assign", "access", "hex"))
        assert set(written.split(",")) - {""} <= set(rows[i]["spans"].split(","))
    masked = secrets.mask_secrets(make_docs(enumerate(texts)))
    assert masked.columns == make_docs([]).columns
    assert masked.where("doc_id = 2").collect()[0]["text"] == "[secret] é [secret] [secret]"
    assert secrets.scan(make_docs([])).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    return read("documents"), read("labels")


def test_language_held_out(tables, make_docs):
    docs, _ = tables
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod("doc_id", 4) == 2).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) > 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    two = docs.groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).where(F.col("lang").isin("en", "fr")).collect()
    cases = [(0, None), (1, ""), (2, "12 ++"), (3, "é"), (4, " ".join(r["text"] for r in two)), (None, "the of and"), (4, "the of and")]
    rows = language.identify(make_docs(cases), model).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[i][0]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3
    assert got[3][0]["lang_pred"] in model.languages
    assert {"en", "fr"} in [set(r["lang_set"]) for r in got[4]]
    assert got[None][0]["lang_pred"] == "en"
    nothing = language.fit(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(make_docs(cases), nothing).collect()} == {"und"}
    assert language.identify(make_docs([]), model).count() == 0


def test_gram_counts_by_brute_force(spark):
    rows = [("en", "The cat, the hat!"), ("fr", "été d'été"), ("en", "x 12 y"), ("en", ""), ("fr", "L'été"), ("fr", "日本")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string")
    size = 1 << language.BITS
    want = {lang: [0] * (2 * size) for lang in ("en", "fr")}
    for lang, text in rows:
        folded = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (" " + text.lower() + " ").encode()]
        for i, b in enumerate(folded):
            if b != 32:
                before, after = folded[i - 1], folded[i + 1]
                further = 32 if before == 32 else folded[i - 2]
                three = before << 16 | b << 8 | after
                four = three | further << 24
                want[lang][(three * 2654435761 % 2**32) >> (32 - language.BITS)] += 1
                want[lang][size + (((four ^ four >> 15) * 2246822519 % 2**32) >> (32 - language.BITS))] += 1
    for parts in (1, 8, 64):
        got = language.count_grams(docs.repartition(parts), "lang", "text")
        assert {k: v.tolist() for k, v in got.items()} == want
    assert language.count_grams(docs.limit(0), "lang", "text") == {}


def test_language_of_a_very_long_text(tables, make_docs):
    docs, _ = tables
    model = language.fit(docs, F.lit(True))
    rows = language.identify(make_docs([(1, "the house of the river and " * 60_000), (1, "the house of the river and"), (2, None)]), model).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in rows) == [(1, "en"), (1, "en"), (2, "und")]


def test_language_set_holds_more_than_four():
    rng = random.Random(8)
    words = {f"l{i}": ["".join(rng.choices(letters, k=6)) for _ in range(60)] for i, letters in enumerate(("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"))}
    half = [np.bincount(language._grams(language._words([" ".join(w)])[0])[1].ravel(), minlength=2 << language.BITS).reshape(2, -1) + 0.5 for w in words.values()]
    model = language.Model(list(words), np.stack([np.log(h / h.sum(1, keepdims=True)).ravel() for h in half], 1).astype(np.float32))
    mixed = [w for of in words.values() for w in of]
    (found, share, every), (one, _, alone) = language.mixtures([" ".join(mixed), " ".join(words["l2"])], model)
    assert set(every) == set(words) and found in words and share < 0.5
    assert (one, alone) == ("l2", ["l2"])


def test_mixture_shares_add_up():
    rng = np.random.default_rng(1)
    like = np.exp(-rng.random((30, 3))).astype(np.float32)
    shares, value = language._mixture(like, np.array([0, 12]), np.repeat([0, 1], [12, 18]), np.array([12, 18]), 200)
    assert np.allclose(shares.sum(1), 1, atol=1e-4)
    for d, part in enumerate((like[:12], like[12:])):
        for _ in range(200):
            other = rng.dirichlet(np.ones(3))
            assert np.log(part @ other).sum() <= value[d] + 1e-3


def test_toxicity_held_out(tables, make_docs):
    docs, labels = tables
    model = toxicity.fit(toxicity.training_rows(docs, labels, crc_mod("doc_id", 4) != 2))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(crc_mod("doc_id", 4) == 2).collect()
    toxic = [r["score"] for r in rows if r["toxic"]]
    clean = [r["score"] for r in rows if not r["toxic"]]
    ranked = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert ranked > 0.75
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs([(0, None), (1, ""), (2, "x" * 100_000)]), model).collect()}
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores.values())
    empty = toxicity.fit([])
    assert toxicity.score(make_docs([(0, "a")]), empty).collect()[0]["score"] == 0.0
    assert toxicity.score(make_docs([]), model).count() == 0


def test_toxicity_without_typical_stretches():
    """Two toxic texts are too few for a typical stretch; the texts are told apart all the same."""
    rng = random.Random(6)
    make = lambda words: " ".join(rng.choices(words, k=60))
    plain, rude = [[a + b + c for a in first for b in ("ander", "ilom", "ustra") for c in ("ten", "vok")] for first in (("b", "g", "m"), ("kr", "z", "x"))]
    rows = [(make(plain), 0) for _ in range(90)]
    for i in (3, 6, 5, 8):  # two for the dictionaries, two for the curve
        rows[i] = (make(rude), 1)
    model = toxicity.fit(rows)
    assert not toxicity.typical_stretches([toxicity.clean(rows[i][0]) for i in (3, 6)], [toxicity.clean(t) for t, y in rows if not y])
    scorer = toxicity.Scorer(model)
    assert min(scorer.score(make(rude)) for _ in range(20)) > max(scorer.score(make(plain)) for _ in range(20))


def test_library_ids_take_each_word_once():
    library, calls = bpe.LibraryIds(PATH), []
    ask = library._ids
    library._ids = lambda stretches: calls.extend(stretches) or ask(stretches)
    odd = ["", None, " ", "  a  b ", "one two two\n", "x　 y\x1c z", "two <|endoftext|> two", "don't  stop", "字字 \U0001f642 two"]
    plain = Tokenizer.from_file(PATH)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert [np.frombuffer(i, "<u4").tolist() for i in library.encode(odd) + library.encode(odd)] == want + want
    assert calls.count(" two") <= 1 + 2 * 3  # once as a word, else as the last stretch of texts with runs of white space
