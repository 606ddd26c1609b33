"""Anchors with too many contexts to collect: what the driver has to hold for them."""

import random

from trialmill.llm import suffixes


def _texts():
    """A passage in many surroundings, whole and with changes near its ends."""
    rng = random.Random(21)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(110)
    texts = []
    for _ in range(60):
        start, end = rng.choice([0, 0, 9, 23, 37]), rng.choice([110, 110, 104, 88, 71])
        texts.append(prose(rng.randrange(30, 60)) + passage[start:end] + prose(rng.randrange(30, 60)))
    return texts


def _jobs(spark, docs, group_rows):
    """Rows of ``repeated_bytes`` and the number of jobs that made them."""
    name = f"large-groups-{group_rows}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        rows = suffixes.repeated_bytes(docs, 60, group_rows=group_rows, shorter=40).drop("spans", "passages").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sorted(map(tuple, rows)), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_large_groups_take_few_jobs(spark, make_docs):
    docs = make_docs(list(enumerate(_texts())))
    usual, few = _jobs(spark, docs, 100_000)
    large, more = _jobs(spark, docs, 2)
    assert large == usual and any(r[2] for r in large)
    assert more - few <= 40, (few, more)

