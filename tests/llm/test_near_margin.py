"""Linked pairs whose estimate is far below the threshold are linked all the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexalloc.llm import common, near_dups, sketches

#: Shingle size, percent, words changed, and seeds whose pair is at the threshold, shares buckets, and
#: has an estimate more than 0.07 below it.
CASES = [(5, 80, 180, 4, (125, 667, 711, 838)), (3, 85, 185, 5, (1236, 1616, 2218))]


def pair(seed, size, n, k):
    a = [f"w{seed}x{i}" for i in range(n + size - 1)]
    b = list(a)
    for j in range(k):
        b[size + j * (len(a) - 2 * size) // k + 1] = f"c{seed}y{j}"
    return " ".join(a), " ".join(b)


def documents(spark, case):
    size, _, n, k, seeds = case
    return spark.createDataFrame([(2 * s + i, t) for s in seeds for i, t in enumerate(pair(s, size, n, k))], "doc_id long, text string")


@pytest.mark.parametrize("case", CASES)
def test_pairs_far_below_their_similarity(spark, case):
    got = {r.doc_id: r.component_id for r in near_dups.group(documents(spark, case), case[0], case[1]).collect()}
    assert got == {2 * s + i: 2 * s for s in case[4] for i in (0, 1)}


@pytest.mark.parametrize("large", [2, 48])
@pytest.mark.parametrize("case", CASES)
def test_leftover_pairs_far_below_their_similarity(spark, monkeypatch, case, large):
    monkeypatch.setattr(near_dups, "LARGE", large)
    size, percent, _, _, seeds = case
    docs = documents(spark, case)
    feats = near_dups.features(docs, size, "doc_id", "text")
    entries = near_dups.bands(feats).withColumn("component", F.col("id"))
    shared = entries.groupBy("key").count().where("count > 1").select("key")
    payload = near_dups.payloads(docs, feats.select("id", F.col("id").alias("doc"), "h", "class"), size, "doc_id", "text")
    rest = near_dups.leftover(entries.join(shared, "key"), payload, percent, common.Workspace(spark, "t")).collect()
    assert {(r.a, r.c, r.sure) for r in rest} == {(2 * s + 1, 2 * s, large == 2) for s in seeds}


def test_margin_follows_the_threshold():
    for size, percent, n, k, seeds in CASES:
        assert near_dups.least_estimate(percent) == pytest.approx(percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / 240))
        sets = sketches.Sets(size)
        for s in seeds:
            a, b = (sets.of(t.encode()) for t in pair(s, size, n, k))
            estimate = sketches.estimate(sketches.registers(a), sketches.registers(b), len(a), len(b))
            assert sketches.linked(a, b, percent) and near_dups.least_estimate(percent) < estimate < percent / 100 - 0.07
