"""Importance resampling, piece round trips and centroid clustering."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import difference, oracle
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from trialmill.llm import centroids, pieces, queries, resampling
from trialmill.plans.fixtures import TABLES

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODEC = pieces.codec(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = [
    "the", " The", "aaaa", "=====", "  ", " " * 37, "\n\n", "\t ", "<s>", "<0x41>", "▁", "▁▁ x", "é", "ß!", "12345", "日本語", "🙂👍", "\x00", "a" * 300,
    " \n x", "\x85", "\xa0", "́",
]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, sf)
    con = oracle(sf)
    cur = con.execute(queries.SQL[name])
    assert difference(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall()) is None
    assert "documents" in TABLES


# --- pieces ----------------------------------------------------------------------------


def agree(texts):
    packed = CODEC.encode_batch(texts)
    for text, ids in zip(texts, packed, strict=True):
        want = LIBRARY.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text[:80])
        assert CODEC.decode(ids).decode() == LIBRARY.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.text("abcdefgh .,'\n\t12é", max_size=12), st.text(max_size=5)), max_size=12), max_size=4))
def test_pieces_agree_with_the_library(texts):
    agree(["".join(t).encode("utf-8", "ignore").decode() for t in texts])


def test_pieces_of_long_words_and_blanks():
    rng = random.Random(4)
    agree([" " * n + w + " " * m for n in range(0, 120, 3) for w in ("", "a", "the", "日", "▁x") for m in (0, 1, 33)])
    agree(["".join(rng.choice(letters) for _ in range(5_000)) for letters in ("ab", "etaoinshr", "=-_.", "0123456789abcdef", "日本語中文字的", "aA \n")])
    agree([w * n for w in ("a", "=", "ab", "the", "日", " ", "  x") for n in (50, 3_000)])
    agree(["the cat " * 60_000])  # more than one stretch of words


def test_conflicting_merges_go_one_by_one():
    # Words whose merges open better pairs: all short strings over few letters of the vocabulary.
    rng = random.Random(8)
    pool = [p for p in CODEC.ids if 1 < len(p) < 5]
    agree(["".join(rng.choices(rng.sample(pool, 3), k=12)) for _ in range(4_000)])


def test_memory_is_bounded():
    small = pieces.PieceCodec(PATH)
    small._memory.limit = 50
    texts = [f"word{i} again {i % 7}" for i in range(400)]
    for lo in range(0, 400, 20):
        got = small.encode_batch(texts[lo : lo + 20])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == LIBRARY.encode(texts[lo : lo + 20])
    assert len(small._memory.young) < 50 + 60


def test_decode_of_any_ids():
    rng = random.Random(9)
    for _ in range(400):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randrange(1, 12))]
        assert CODEC.decode(np.array(ids, "<u4").tobytes()).decode() == LIBRARY.decode(ids), ids


def test_piece_rows(make_docs):
    texts = [None, "", " ", "plain words", "plain words", "x" * 200_000, "日" * 3_000]
    rows = [*enumerate(texts), (None, "no id"), (3, "the same id")]
    out = Counter(tuple(r) for r in pieces.digests(make_docs(rows), PATH).collect())
    want = Counter()
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[i, len(ids), digest, hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()] += 1
    assert out == want
    assert pieces.digests(make_docs([]), PATH).count() == 0
    encoded = pieces.encode(make_docs([(1, " round  trip é\n")]), PATH)
    assert pieces.decode(encoded, PATH).collect()[0]["text"] == " round  trip é\n"


# --- resampling ------------------------------------------------------------------------


def plain_features(text, longest=1):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in lowered).split(" ")
    words = [w for w in words if w]
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute_resampling(docs, target, percent=10, longest=1):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text, longest)[1])
    for text in target:
        t.update(plain_features(text, longest)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        words, found = plain_features(text, longest)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, words, len(found), weight, score, None])
    eligible = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2], r[3]))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[5] = rank
    return Counter((r[0], r[2], r[3], r[4], r[5]) for r in rows)


def sample_docs(rng, n):
    vocabulary = ["alpha", "Beta", "gamma", "été", "日本", "x1", "ÀB", "z"]
    docs = [(i, " ,".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, ".,!"), (None, "alpha " * 30), (None, "alpha " * 30), (3, "beta " * 40), (n + 3, "word " * 70_000 + "Alpha " * 300)]
    return docs + [(n + 4, "alpha beta gamma " * 20)] * 30  # a row that repeats


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (1, 60), (3, 25)])
def test_resampling(make_docs, longest, percent, monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", 1_000)
    monkeypatch.setattr(resampling, "COPIES", 7)
    rng = random.Random(longest)
    docs = sample_docs(rng, 150)
    target = ["alpha alpha été", None, "gamma", ""]
    got = resampling.resample(make_docs(docs), make_docs(enumerate(target)), percent, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resampling(docs, target, percent, longest)


def test_resampling_of_little(make_docs):
    docs = [(1, "few words"), (2, None)]
    for target in ([], ["few"]):
        got = resampling.resample(make_docs(docs), make_docs(enumerate(target)))
        assert Counter(tuple(r) for r in got.collect()) == brute_resampling(docs, target)
    assert resampling.resample(make_docs([]), make_docs([(1, "a")])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 20_000), st.integers(1, 40))
def test_plane_sums_are_exact(seed, most, buckets):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, rng.integers(1, 1_000_000), (5, buckets))
    gains = rng.integers(-most, most + 1, buckets)
    assert resampling.plane_sums(counts, resampling.gain_planes(gains)).tolist() == (counts @ gains).tolist()


def test_partitions_do_not_matter(make_docs):
    docs = make_docs(sample_docs(random.Random(1), 80))
    target = make_docs([(1, "alpha été")])
    results = [Counter(tuple(r) for r in resampling.resample(docs.repartition(n), target).collect()) for n in (1, 8, 64)]
    assert results[0] == results[1] == results[2]


# --- centroids -------------------------------------------------------------------------

VECTORS = T.StructType(
    [T.StructField(n, k) for n, k in (("vec_id", T.LongType()), ("embedding", T.ArrayType(T.DoubleType())), ("cluster", T.IntegerType()), ("id", T.StringType()))]
)


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)


def brute_clustering(rows, k=40, rounds=5):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    if not kept:
        return Counter()
    # rows that repeat an id go by their stored coefficients
    stored = lambda v: centroids._packed(centroids.transform(np.array([v])))[0]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), stored(r[1]))
    middle = [v for _, v in sorted(kept, key=key)[:k]]

    def assigned():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle)))
        return out

    for _ in range(rounds):
        found = assigned()
        for j in range(len(middle)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                middle[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assigned()
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True))


def vector_rows(rng, n, spread=1.0):
    rows = [(i, [rng.gauss(i % 5, spread) for _ in range(64)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (None, [0.25] * 64), (0, [1.5] * 64), (n + 2, [0.0] * 64)]
    rows += [(n + 3, None), (n + 4, []), (n + 5, [1.0] * 63), (n + 6, [1.0] * 65), (n + 7, [None] + [1.0] * 63), (n + 8, [float("nan")] + [1.0] * 63)]
    return rows + [(n + 9, [float("-inf")] * 64), (n + 10, [-0.001] * 64)]


@pytest.mark.parametrize(("n", "spread"), [(300, 1.0), (300, 0.01), (30, 1.0), (400, 900.0)])
def test_clustering(spark, n, spread):
    rows = vector_rows(random.Random(n), n, spread)
    got = centroids.cluster(make_vectors(spark, rows).repartition(5))
    assert Counter(tuple(r) for r in got.collect()) == brute_clustering(rows)


def test_clustering_of_repeats_ties_and_nothing(spark):
    # Whole-number grids have many ties, and repeated vectors leave centroids empty.
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(2)) / 256] * 32 + [0.0] * 32) for i in range(200)]
    got = centroids.cluster(make_vectors(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_clustering(rows)
    for rows in ([], [(1, None)], [(1, [1e300] * 64)]):
        assert centroids.cluster(make_vectors(spark, rows)).collect() == []
    large = [(i, [rng.uniform(-5e5, 5e5) for _ in range(64)]) for i in range(60)]
    got = centroids.cluster(make_vectors(spark, large))
    assert Counter(tuple(r) for r in got.collect()) == brute_clustering(large)


def test_search_drops_no_nearest_centroid():
    rng = np.random.default_rng(3)
    for high in (2, 40, 3_000, 1 << 20, 1 << 27):
        v, c = rng.integers(-high, high, (80, 64)), rng.integers(-high, high, (40, 64))
        c[7] = c[3]
        v[:3] = c[3]
        number, distance = centroids.nearest(centroids.transform(v), centroids.transform(c))
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
        assert number.tolist() == [row.index(min(row)) for row in exact]
        assert distance.tolist() == [min(row) for row in exact]


def test_transform_is_orthogonal():
    assert (centroids.WALSH @ centroids.WALSH.T == 64 * np.eye(64)).all()
    changes = (np.diff(centroids.WALSH, axis=1) != 0).sum(axis=1)
    assert changes.tolist() == list(range(64))
    x = list(range(-30, 34))
    assert centroids.inverse([int(c) for c in centroids.transform(np.array([x]))[0]]) == x
