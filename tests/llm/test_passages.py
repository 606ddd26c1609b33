"""Repeated passages of a second, shorter length, found in the same pass."""

import random
from collections import Counter

import pytest
from trialmill.llm import queries, suffixes


@pytest.mark.parametrize("group_rows", [100_000, 2])
def test_passages_between_the_two_lengths_are_counted(make_docs, group_rows):
    rng = random.Random(10)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    middle, long = [prose(45) for _ in range(3)], prose(90)
    texts = [prose(rng.randrange(80)) + rng.choice(middle)[rng.randrange(4) :] + prose(rng.randrange(80)) for _ in range(24)]
    texts += [prose(30) + long[rng.randrange(40) :] + middle[0] + prose(20) for _ in range(6)]
    texts += [middle[1], middle[1], long, long, "z" * 400, "é" * 90, prose(50) + "z" * 45, "", None, prose(200), long + prose(9) + long]
    rows = {r["doc_id"]: r for r in suffixes.repeated_bytes(make_docs(list(enumerate(texts))), 60, group_rows=group_rows, shorter=40).collect()}
    raws = [(t or "").encode() for t in texts]
    for length, spans in ((60, "spans"), (40, "passages")):
        seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
        for k, raw in enumerate(raws):
            held = bytearray(len(raw))
            for i in range(len(raw) - length + 1):
                if seen[raw[i : i + length]] > 1:
                    held[i : i + length] = b"\x01" * length
            mine = bytearray(len(raw))
            for s in rows[k][spans]:
                mine[s["start"] : s["end"]] = b"\x01" * (s["end"] - s["start"])
            assert mine == held, (k, length)
            count = sum(h and (not i or not held[i - 1]) for i, h in enumerate(held))
            names = ("n_removed", "n_spans") if length == 60 else ("n_passage_bytes", "n_passages")
            assert [rows[k][n] for n in names] == [sum(held), count]
    assert any(r["n_passages"] and not r["n_removed"] for r in rows.values())


def test_op1_reports_passages_of_fifty_words(spark, tmp_path, make_docs):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = words(52)  # 311 bytes
    texts = [words(30) + " " + passage + " " + words(20), passage + " " + words(40), words(100), words(200)]
    make_docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op1_suffix_array_repeats(spark, str(tmp_path)).collect()}
    assert [rows[i]["n_removed"] for i in range(4)] == [0] * 4  # the contract's 400 bytes
    assert all(len(passage) <= rows[i]["n_passage_bytes"] <= len(passage) + 4 and rows[i]["n_passages"] == 1 for i in (0, 1))
    assert [rows[i]["n_passage_bytes"] for i in (2, 3)] == [0, 0]


def test_places_of_a_deep_tree_are_put_in_once_a_doubling():
    rng = random.Random(12)
    n = 300
    # each context shares one byte more with the last: as many intervals around each other as there are contexts
    right = [b"a" * i + b"b" * (n - i) for i in range(n)]
    left = [bytes(rng.choices(b"ab", k=40)) for _ in range(n)]
    assert len(list(suffixes.neighbours(left, right))) <= 2 * n
    needs = [n // 2, 60]
    common = suffixes.common
    for need, found in zip(needs, suffixes.reaches(left, right, needs), strict=True):
        for i in range(n):
            pairs = [(common(left[i], left[j]), common(right[i], right[j])) for j in range(n) if j != i]
            pairs = [p for p in pairs if sum(p) >= need]
            assert found[i] == ((max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else None)


def test_neighbours_of_sides_of_unequal_length():
    rng = random.Random(13)
    for _ in range(200):
        sides = {(bytes(rng.choices(b"\0ab", k=rng.randrange(7))), bytes(rng.choices(b"\0ab", k=rng.randrange(7)))) for _ in range(rng.randrange(1, 12))}
        left, right = [s[0] for s in sides], [s[1] for s in sides]
        needs = [rng.randrange(3, 8), rng.randrange(1, 4)]
        for need, found in zip(needs, suffixes.reaches(left, right, needs), strict=True):
            for i in range(len(left)):
                pairs = [(suffixes.common(left[i], left[j]), suffixes.common(right[i], right[j])) for j in range(len(left)) if j != i]
                pairs = [p for p in pairs if sum(p) >= need]
                assert found[i] == ((max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else None)
