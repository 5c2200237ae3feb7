"""The queries without SQL see every row: their results against brute force on keys of any size."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexalloc.operators import agreement
from hexalloc.plans import catalog
from hexalloc.sources import sinks

#: Keys that leave small needs (remainders by 41), far beyond any prefix of small tables.
CUSTOMERS = [(6152, 0, 900.0), (41 * 5000 + 3, 0, 7000.0), (2, 0, 3000.0), (41 * 900 + 1, 3, 500.0), (41 * 801 + 2, 3, 9000.0)]
SUPPLIERS = [(425, 80.0), (25, 125.0), (403, 90.0), (1028, 41.0)]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("star"))
    spark.createDataFrame(CUSTOMERS, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{where}/customer.parquet")
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_acctbal double").write.parquet(f"{where}/supplier.parquet")
    return where


def scenarios():
    """Name, cells, centres, priority, need, stock and distances of each scenario."""
    for nation in (0, 3):
        cells = sorted(c for c, n, _ in CUSTOMERS if n == nation)
        centres = sorted(s for s, _ in SUPPLIERS if s % 25 == nation)
        balance, held = {c: b for c, _, b in CUSTOMERS}, dict(SUPPLIERS)
        priority = [math.floor((balance[c] + 1000) / 11000 * 10000) / 10000 for c in cells]
        dist = [[(c * 13 % 101 * 37 + s * 911) % 6000 + 200 for s in centres] for c in cells]
        yield f"n{nation}", cells, centres, priority, [c % 41 for c in cells], [math.floor(held[s] / 40) for s in centres], dist


def rows_of(df):
    return {(r.scenario, r.cell, r.centre): r.units for r in df.collect()}


def test_greedy_plan_of_all_rows(spark, star):
    want = {}
    for name, cells, centres, priority, need, stock, dist in scenarios():
        left = list(stock)
        for i in sorted(range(len(cells)), key=lambda i: (-priority[i], i)):
            lacking = need[i]
            for j in sorted(range(len(centres)), key=lambda j: (dist[i][j], j)):
                send = min(lacking, left[j]) if dist[i][j] <= 5000 else 0
                if send > 0:
                    want[name, cells[i], centres[j]] = send
                    lacking -= send
                    left[j] -= send
    got = rows_of(catalog.QUERIES["greedy_plan"](spark, star))
    assert got == want and any(c > 6000 for _, c, _ in got) and any(s > 400 for _, _, s in got)


def test_exact_plan_of_all_rows(spark, star):
    got = {r.scenario: r for r in catalog.QUERIES["exact_plan"](spark, star).collect()}
    assert got.keys() == {"n0", "n3"}
    for name, cells, centres, priority, need, stock, dist in scenarios():
        n, m = len(cells), len(centres)
        top = max(range(n), key=lambda i: (priority[i], -i))  # a fifth of up to five cells is one
        floor = 0.25 * min(sum(stock), sum(need))
        best = (-math.inf, None)
        for flat in itertools.product(*(range(min(need[i], stock[j]) + 1 if dist[i][j] <= 5000 else 1) for i in range(n) for j in range(m))):
            x = np.array(flat).reshape(n, m)
            if (x.sum(0) <= stock).all() and (x.sum(1) <= need).all():
                worth = sum((priority[i] - 0.001 * dist[i][j] / 5000) * x[i, j] for i in range(n) for j in range(m))
                best = max(best, (worth - max(0.0, floor - x[top].sum()), worth, int(x.sum())))
        assert (got[name].objective, got[name].delivered) == (pytest.approx(best[1], abs=1e-4), best[2])


def test_rounded_plan_of_all_rows(spark, star):
    got = rows_of(catalog.QUERIES["rounded_plan"](spark, star))
    want = {}
    for name, cells, centres, _, need, stock, _ in scenarios():
        share = {(i, j): min(stock[j] / len(cells), need[i] / len(centres)) for i in range(len(cells)) for j in range(len(centres))}
        out = {k: math.floor(v) for k, v in share.items()}
        budget = math.floor(sum(share.values()) + 1e-9) - sum(out.values())
        for i, j in sorted(share, key=lambda k: (out[k] - share[k], k)):
            if budget and share[i, j] > out[i, j] and sum(out[i, b] for b in range(len(centres))) < need[i] and sum(out[a, j] for a in range(len(cells))) < stock[j]:
                out[i, j] += 1
                budget -= 1
        want |= {(name, cells[i], centres[j]): v for (i, j), v in out.items() if v}
    assert got == want


def test_resampling_of_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.c_mktsegment, r.c_acctbal, r.c_acctbal + r.c_custkey * 7919 % 5000) for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    got = {r.who: r for r in catalog.QUERIES["bootstrap_permutation"](spark, sf).collect()}
    assert got.keys() == {w for w, _, _ in rows}
    mid = lambda v: [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]
    for who, r in got.items():
        a, b = (mid([x[k] for x in rows if x[0] == who]) for k in (1, 2))
        assert r.n == len(a) and r.rho == pytest.approx(np.corrcoef(a, b)[0, 1])
        assert r.draws == 10_000 and r.p * 10_001 == pytest.approx(round(r.p * 10_001)) and r.p >= 1 / 10_001


def test_blocks_shrink_with_the_group(spark, monkeypatch):
    seen, mid = [], agreement._mid
    monkeypatch.setattr(agreement, "BLOCK_VALUES", 100)
    monkeypatch.setattr(agreement, "_mid", lambda x: seen.append(x.size) or mid(x))
    pdf = pd.DataFrame({"g": "a", "x": np.arange(30.0), "y": np.arange(30.0) % 7})
    applied = {}

    class Frame:  # hands the group's function out instead of shipping it
        schema = spark.createDataFrame(pdf).schema
        select = groupBy = withColumnRenamed = lambda self, *_: self

        def applyInPandas(self, f, _):
            applied["f"] = f
            return self

    agreement.resampled(Frame(), "g", "x", "y", draws=25)
    out = applied["f"](pdf)
    assert max(seen) <= 100 and out["draws"].tolist() == [25]


def test_shares_of_many_cells_add_up(spark):
    """Each of them is far below what four digits tell."""
    plan = spark.range(7000).selectExpr("'a' AS scenario", "id AS cell", "cast(id % 7 AS double) AS units").where("units > 0")
    doc = json.loads(sinks.scenario_document(plan.groupBy("scenario").agg(F.sum("units").alias("objective")), plan).first().document)
    assert len(doc["cells"]) == 6000 and sum(c["share_of_stock"] for c in doc["cells"]) == pytest.approx(1, abs=5e-4)
    assert [c["share_of_stock"] for c in doc["cells"][:6]] == [round(k / 21000, 7) for k in range(1, 7)]
