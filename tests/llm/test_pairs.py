"""Operators that compare rows: repeated passages, near duplicates, vectors, search, language model, pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from trialmill.llm import knn, maxent, minhash, suffixes, vectors
from trialmill.llm.components import components


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(n))


# Repeated passages


def brute_cover(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        held = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                held[i : i + length] = b"\x01" * length
        rest = bytes(x for x, h in zip(r, held, strict=True) if not h)
        spans = sum(h and (not i or not held[i - 1]) for i, h in enumerate(held))
        out.append((len(r), sum(held), spans, hashlib.sha256(rest).hexdigest()))
    return out


def passages(rng):
    shared = [prose(rng, 40) for _ in range(4)]
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(30)]
    for i in range(0, 30, 2):
        s = rng.choice(shared)
        texts[i] = texts[i] + s[rng.randrange(0, 50) :] + prose(rng, 5)
    texts += [shared[0] + shared[1], shared[0] + shared[1], "ab" * 400, "é" * 300, "é" * 301, None, "", "short", texts[3] + texts[3]]
    return texts


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_repeated_bytes(make_docs, group_rows):
    texts = passages(random.Random(4))
    rows = suffixes.repeated_bytes(make_docs(enumerate(texts)), 60, group_rows=group_rows).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_cover(texts, 60)


def test_repeats_of_long_and_sliced_texts(monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 500)
    rng = random.Random(8)
    long = prose(rng, 900).encode()
    owner, place, _ = suffixes.anchors([long, b"x", long[100:1500]], 60)
    assert len(set(zip(owner.tolist(), place.tolist(), strict=True))) == len(owner)
    for i, raw in ((0, long), (2, long[100:1500])):
        mine = sorted(place[owner == i])
        assert all(b - a <= 31 for a, b in zip(mine, mine[1:], strict=False))  # every window holds an anchor
        assert all(0 <= p <= len(raw) - 30 for p in mine)
    inner = set((place[owner == 0] - 100).tolist())
    assert set(place[owner == 2].tolist()) <= inner


def test_interval_tree_finds_all_maximal_repeats():
    rng = random.Random(3)
    for _ in range(60):
        sides = [("".join(rng.choices("ab", k=6)).encode(), "".join(rng.choices("ab", k=6)).encode()) for _ in range(rng.randrange(2, 9))]
        left, right = [s[0] for s in sides], [s[1] for s in sides]
        need = rng.randrange(1, 8)
        expected = {}
        for i in range(len(sides)):
            for j in range(i + 1, len(sides)):
                a, b = suffixes.common(left[i], left[j]), suffixes.common(right[i], right[j])
                if a + b >= need:
                    expected[a, b] = expected.get((a, b), set()) | {i, j}
        found = {}
        for a, b, places in suffixes.maximal_repeats(left, right, need):
            found.setdefault((a, b), []).append(set(places))
        assert set(found) == set(expected)
        for key, places in expected.items():
            assert set().union(*found[key]) >= places
        best = suffixes.reach(left, right, need)
        for i in range(len(sides)):
            mine = [k for k, p in expected.items() if i in p]
            pairs = [(suffixes.common(left[i], left[j]), suffixes.common(right[i], right[j])) for j in range(len(sides)) if j != i]
            pairs = [p for p in pairs if sum(p) >= need]
            assert best[i] == ((max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else None)
            assert bool(mine) >= bool(pairs)
        order = rng.sample(range(100), len(sides))
        best = suffixes.reach(left, right, need, order)
        for i in range(len(sides)):
            pairs = [(suffixes.common(left[i], left[j]), suffixes.common(right[i], right[j])) for j in range(len(sides)) if order[j] < order[i]]
            pairs = [p for p in pairs if sum(p) >= need]
            assert best[i] == ((max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else None)


def brute_first_copies(texts, length):
    """Texts without bytes that an earlier equal window covers, in the order of (text key, place); ids are the numbers."""
    raws = [(t or "").encode() for t in texts]
    order = sorted(range(len(raws)), key=lambda i: (hashlib.sha256(raws[i]).digest()[:16], i))
    seen, out, held_by_key = set(), {}, set()
    for i in order:
        raw = raws[i]
        if raw in held_by_key and len(raw) >= length:
            out[i] = ""
            continue
        held = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen and raw not in held_by_key:
                held[k : k + length] = b"\x01" * length
            seen.add(window)
        held_by_key.add(raw)
        out[i] = bytes(x for x, h in zip(raw, held, strict=True) if not h).decode("utf-8", "ignore")
    return [out[i] for i in range(len(raws))]


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_one_copy_of_a_passage_stays(make_docs, group_rows):
    texts = passages(random.Random(5)) + ["c" * 700 + "d", "x" + "c" * 90]
    left = suffixes.without_repeats(make_docs(enumerate(texts)), 60, group_rows=group_rows, keep_first=True).collect()
    got = {r["doc_id"]: r["text"] or "" for r in left}
    assert [got[i] for i in range(len(texts))] == brute_first_copies(texts, 60)


def test_repeated_rows_and_columns(make_docs, spark):
    docs = make_docs([(1, "a" * 90), (1, "a" * 90), (None, "b" * 80), (2, "plain")])
    left = suffixes.without_repeats(docs, 60)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, ""), (1, ""), (1, ""), (2, "plain")]
    # with one copy kept, rows of the smallest id keep their text up to the run's own repeats
    left = suffixes.without_repeats(make_docs([(2, "word list " * 3 + "q" * 40), (1, "word list " * 3 + "q" * 40), (1, "word list " * 3 + "q" * 40)]), 60, keep_first=True)
    assert sorted((r["doc_id"], len(r["text"])) for r in left.collect()) == [(1, 70), (1, 70), (2, 0)]
    assert suffixes.repeated_bytes(make_docs([]), 60).count() == 0


def test_repeat_groups_by_brute_force(make_docs):
    rng = random.Random(12)
    texts = passages(rng)[:34] + ["z" * 300]
    length = 60
    rows = suffixes.repeat_groups(make_docs(enumerate(texts)), length).collect()
    raws = {hashlib.sha256((t or "").encode()).digest()[:16]: (t or "").encode() for t in texts}
    groups, held = {}, {k: bytearray(len(r)) for k, r in raws.items()}
    for r in rows:
        for start in range(r["start"], r["start"] + r["span"]):
            groups.setdefault((r["anchor"], r["to_left"], r["size"], r["group"]), set()).add((bytes(r["key"]), start))
    for (_, _, size, _), places in groups.items():
        strings = {raws[k][s : s + size] for k, s in places}
        assert len(strings) == 1 and len(places) > 1 and size >= length
        for k, s in places:
            held[k][s : s + size] = b"\x01" * size
    seen = Counter(raw[i : i + length] for raw in raws.values() for i in range(len(raw) - length + 1))
    for k, raw in raws.items():
        want = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                want[i : i + length] = b"\x01" * length
        assert held[k] == want
    # every occurrence of a repeated window is in one group with all its others
    for window, n in seen.items():
        if n > 1:
            places = {(k, i) for k, raw in raws.items() for i in range(len(raw) - length + 1) if raw[i : i + length] == window}
            assert any(all(any(k2 == k and s <= i and i + length <= s + size for k2, s in g) for k, i in places) for (_, _, size, _), g in groups.items())
            break


def test_a_long_run_of_one_byte(make_docs):
    texts = ["a" * 3_000_000 + "b", "plain " * 30]
    rows = {r["doc_id"]: r for r in suffixes.repeated_bytes(make_docs(enumerate(texts))).collect()}
    assert (rows[0]["n_bytes"], rows[0]["n_removed"], rows[0]["n_spans"], rows[1]["n_removed"]) == (3_000_001, 3_000_000, 1, 0)


# Near duplicates


def brute_links(sets, percent):
    part = {i: i for i in sets}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                part[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(make_docs, words, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_ROWS", 3)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    rng = random.Random(6)
    texts = []
    for _ in range(8):
        base = prose(rng, rng.choice([3, 40, 120])).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(99))
            texts.append(" \n".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [None, "", " \t", "one", "One", "one two", texts[0], "w " * 30_000]
    rows = minhash.near_duplicates(make_docs(enumerate(texts)), words).collect()
    sets = {i: shingles(t, words) for i, t in enumerate(texts)}
    expected = brute_links(sets, 80)
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_odd_rows(make_docs):
    rows = minhash.near_duplicates(make_docs([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b c"), (None, None)]), 2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    assert minhash.near_duplicates(make_docs([]), 2).count() == 0


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    for size, shared in ((20, 16), (300, 200), (1000, 100)):
        agree = []
        for k in range(40):
            p = rng.permutation(pool)
            a, b = p[:size], np.concatenate([p[:shared], p[size : 2 * size - shared]])
            s = minhash.sketches([np.unique(a), np.unique(b)])
            agree.append((s[0] == s[1]).mean())
        true = shared / (2 * size - shared)
        assert abs(np.mean(agree) - true) < 4 * math.sqrt(true * (1 - true) / minhash.COORDINATES / 40) + 0.01


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    part = {i: i for pair in links for i in pair}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        part[max(x, y)] = min(x, y)
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == top(i) for i in part)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Vectors

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("bucket", T.StringType()), T.StructField("id", T.LongType())]
)


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "b", 1) for i, v, lab in rows], VECTORS)


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + 0.11 * rng.standard_normal(16)).astype(np.float32).tolist(), c % 3))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] + [1.0] * 15, 0), (205, rows[0][1], None), (206, rows[0][1][:8], 0), (207, [None] + [1.0] * 15, 0), (208, [], 0)]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(make_vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v, float) for i, v, lab in rows if i < 202 or i == 206}
    label = {i: lab for i, _, lab in rows}
    links = {i: [] for i in label}
    for i, a in good.items():
        for j, b in good.items():
            if i != j and label[i] == label[j] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i].append(j)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * sum(map(len, links.values()))
    assert all(got[i]["n_links"] <= len(links[i]) for i in got)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (202, 203, 204, 205, 206, 207, 208))
    assert got[200]["component_id"] == got[0]["component_id"]
    assert vectors.near_duplicates(make_vectors(spark, [])).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((400, 64))
    unit[200:] = unit[:200] + 0.3 * rng.standard_normal((200, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turn = vectors.rotation(64)
    code, factor = vectors.codes(unit, turn)
    estimate, width = vectors.estimates(code, factor, unit.astype(np.float32) @ turn)
    error = estimate - unit @ unit.T
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) <= width[:, None]).mean() > 0.999


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_ROWS", 3)
    monkeypatch.setattr(knn, "DATA_ROWS", 17)
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-20, 20, 6) / 16).astype(np.float32).tolist(), 0) for i in range(120)]
    rows += [(200, rows[20][1], 0), (201, None, 0), (220, [float("inf")] * 6, 0), (None, rows[0][1], 0), (240, rows[20][1][:3], 0)]
    got = {}
    for r in knn.top_k(make_vectors(spark, rows), lambda i: i % 20 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(np.array(v, float) * 64).astype(int) for i, v, _ in rows if i is not None and v and np.isfinite(v).all()}
    for q in [i for i in whole if i % 20 == 0]:
        ranked = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert 220 not in got and 240 not in got
    assert knn.top_k(make_vectors(spark, []), lambda i: i % 20 == 0).count() == 0


def test_floors_hold():
    rng = np.random.default_rng(4)
    data = rng.integers(-30, 30, (300, 4)).astype(float) + np.repeat(rng.integers(-200, 200, (6, 4)), 50, axis=0)
    pivots = data[::50]
    near = ((data[:, None] - pivots) ** 2).sum(2).argmin(1)
    far = np.linalg.norm(data - pivots[near], axis=1)
    cells = {c: (int((near == c).sum()), float(far[near == c].max())) for c in range(6)}
    floor = knn.floors(pivots, {c: f for c, (_, f) in cells.items()}, cells, 10)
    for i, x in enumerate(data):
        assert np.sort(np.delete(data @ x, i))[-10] >= floor[near[i]] - 1e-6


# Language model


def test_scores(make_docs):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["the cat", "sat on", "le chat", "est là", "x" + str(rng.randrange(50))], k=rng.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", "The  the the\nTHE", "word " * 40_000]
    docs = make_docs(enumerate(texts))
    train = docs.where("doc_id % 7 != 2")
    model, counts = maxent.fit(train)
    rows = {r["doc_id"]: r for r in maxent.score(docs, model, counts).collect()}
    seen = Counter(w for i, t in enumerate(texts) if i % 7 != 2 for w in maxent.tokens_of(t))
    n, v = sum(seen.values()), len(seen)
    for i, t in enumerate(texts):
        words = maxent.tokens_of(t)
        assert rows[i]["n_tokens"] == len(words) and rows[i]["train_tokens"] == n
        assert rows[i]["n_known"] == sum(seen[w] > 0 for w in words)
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words))
    held = [r for i, r in rows.items() if i % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # Class and word shares are probabilities: over all known words and one unknown per class they sum to at most one.
    units, _ = model.units(list(seen))
    classes = model.unit_class[units]
    inner = np.array([1.0 if k <= maxent.ANCHORS else (seen[w] + 1) / (model.class_n[k] + model.class_v[k] + 1) for w, k in zip(seen, classes, strict=True)])
    per_class = np.bincount(classes, weights=inner, minlength=maxent.CLASSES)
    assert (per_class <= 1 + 1e-9).all()
    nothing, none = maxent.fit(docs.where("false"))
    empty = {r["doc_id"]: r for r in maxent.score(docs, nothing, none).collect()}
    assert empty[0]["train_tokens"] == 0 and empty[0]["n_known"] == 0 and empty[0]["base_score"] == 0
    assert maxent.score(make_docs([]), model, counts).count() == 0


def test_named_words_do_not_depend_on_partitions(make_docs, monkeypatch):
    rng = random.Random(3)
    docs = make_docs([(i, " ".join(f"w{min(int(rng.expovariate(0.02)), 900)}" for _ in range(40))) for i in range(300)] + [(None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2")])
    models = [maxent.fit(docs.repartition(n))[0] for n in (1, 8, 64)]
    for m in models[1:]:
        assert m.words == models[0].words and (m.unit_class == models[0].unit_class).all()
        assert (m.counts == models[0].counts).all() and (m.class_v == models[0].class_v).all() and np.allclose(m.class_n, models[0].class_n)
    scores = []
    for m in models:
        m.weights = models[0].weights  # the one part that follows the tasks
        rows = maxent.score(docs, m, maxent.counted(docs)[0]).collect()
        scores.append(sorted((r["doc_id"] or -1, round(r["score"], 9), round(r["base_score"], 9)) for r in rows))
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 303
    # whole counts at a time, never more than the limit
    counts = maxent.counted(docs)[0]
    every = sorted((r["n"] for r in counts.collect()), reverse=True)
    for limit in (0, 1, 10, 100, 10_000):
        found = sorted((r["n"] for r in maxent.most_frequent(counts, limit).collect()), reverse=True)
        assert len(found) <= limit and found == every[: len(found)] and (len(found) == len(every) or every[len(found)] not in found)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    rows = np.stack([rng.integers(0, 50, 40), rng.integers(maxent.HASHED, maxent.HASHED + 50, 40), rng.integers(maxent._PAIR, maxent._FAR, 40), rng.integers(maxent._FAR, maxent._BIAS, 40)]).astype(np.int32)
    classes = rng.integers(0, maxent.CLASSES, 40)
    weights = np.zeros((maxent.ROWS, maxent.CLASSES), np.float32)
    before = maxent.class_logits(weights, rows)[np.arange(40), classes].sum()
    after, seen = maxent.train(weights, [(rows, classes)] * 50)
    assert maxent.class_logits(after, rows)[np.arange(40), classes].sum() > before + 10
    assert seen[maxent._BIAS] == 2000


# Pipeline


def test_pipeline_stages(spark, make_docs):
    rng = random.Random(3)
    word = ["the", "of", "and", "house", "water", "stone"]
    body = lambda n: " ".join(rng.choice(word) + str(rng.randrange(3000)) for _ in range(n))
    base, passage = body(150), body(80)
    rows = [(1, base), (2, base.replace("stone", "rock", 1)), (3, base), (4, "1234 ++"), (5, None), (6, body(30) + passage), (7, passage + body(30)), (8, "my api_key = 'abcd1234efgh5678' " + body(40)), (8, "my api_key = 'abcd1234efgh5678'"), (9, "le chat")]
    docs = spark.createDataFrame([(i, t, "en" if i < 9 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = _kept(spark, stage(spark, docs, ""))
        out[name] = docs.collect()
    for name in list(out)[:-1]:
        assert set(out[name][0].asDict()) == set(corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in out["language"]} == {1, 2, 3, 6, 7, 8, 9}
    assert {r["doc_id"] for r in out["near_duplicates"]} == {1, 6, 7, 8, 9}
    cut = {r["doc_id"]: r["text"] for r in out["repeated_passages"]}
    assert (passage in cut[6]) != (passage in cut[7]) and cut[1] == base  # one copy stays
    assert all(passage in cut[i] or passage[10:-10] not in cut[i] for i in (6, 7))
    assert all("abcd1234efgh5678" not in r["text"] and r["n_chars"] == len(r["text"]) for r in out["secrets"])
    assert {r["doc_id"] for r in out["packing"]} == {1, 6, 7, 8, 9}
    empty = _kept(spark, make_docs([]).selectExpr("doc_id", "text", "'' lang", "'' source", "0L n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        empty = _kept(spark, stage(spark, empty, ""))
        assert empty.count() == 0


def _kept(spark, df):
    return corpus_pipeline.cut(df, "stage")
