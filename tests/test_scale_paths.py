"""Results don't depend on which way a large group or table takes."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hexalloc.functions import ranks
from hexalloc.operators import agreement, allocation, index, joins, montecarlo, pairwise, validation
from hexalloc.stages import once


@pytest.mark.parametrize("small", [200_000, 5])
def test_kendall_against_all_pairs(spark, small, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(g, float(r.integers(0, k)), float(r.integers(0, 9))) for g, n, k in (("a", 60, 7), ("b", 90, 1000), ("c", 3, 2), ("d", 1, 2)) for _ in range(n)]
    rows += [("e", 1.0, float(i)) for i in range(5)] + [("a", None, 1.0), ("b", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {x.g: x.tau for x in agreement.kendall(df, "x", "y", ["g"], small=small).collect()}
    for g in "abcde":
        mine = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]
        pairs = list(itertools.combinations(mine, 2))
        s = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for a, b in pairs)
        nx, ny = (sum(a[k] != b[k] for a, b in pairs) for k in (0, 1))
        assert got[g] == (pytest.approx(s / np.sqrt(nx * ny)) if nx and ny else None)
    whole = agreement.kendall(df.where("g = 'b'"), "x", "y", small=small).collect()
    assert [x.tau for x in whole] == [pytest.approx(got["b"])]


@pytest.mark.parametrize("small", [200_000, 5])
def test_highest_fifth_by_value_and_key(spark, small):
    r = np.random.default_rng(5)
    for rows in ([(i, float(r.integers(0, 6)), int(r.integers(0, 3))) for i in range(83)], [(i, 1.0, 1) for i in range(11)], [(i, 1.0, 0) for i in range(3)], [(7, 2.0, 1)], [(1, None, 1), (2, 3.0, 1)]):
        df = spark.createDataFrame(rows, "cell long, p double, need int")
        got = {x.cell for x in index.top_quintile(df, "p", "need", "cell", small=small).where("top").collect()}
        eligible = sorted((x for x in rows if x[2] > 0 and x[1] is not None), key=lambda x: (-x[1], x[0]))
        assert got == {x[0] for x in eligible[: -(-len(eligible) // 5)]}


@pytest.mark.parametrize("small", [200_000, 5])
def test_single_centre_sums(spark, small):
    r = np.random.default_rng(6)
    rows = [(s, i, float(r.integers(0, 5)), int(r.integers(0, 9)), 70) for s in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "s string, cell long, priority double, need int, stock int")
    got = {(x.s, x.cell): (x.units, x.serving_order) for x in allocation.single_centre(df, ["s"], small=small).collect()}
    for s in ("a", "b"):
        left, order = 70, 0
        for _, c, _, n, _ in sorted((x for x in rows if x[0] == s), key=lambda x: (-x[2], x[1])):
            units = min(n, left)
            left -= units
            order += units > 0
            assert got[s, c] == (units, order if units else None)


def test_order_statistics_where_brackets_fail(spark, monkeypatch):
    values = [float(x) for x in np.random.default_rng(7).permutation(np.repeat(np.arange(60), 7))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    real = F.percentile_approx
    calls = []

    def wrong(column, shares, accuracy):
        calls.append(1)
        return real(column, F.array(F.lit(0.9), F.lit(0.95)) if len(calls) % 3 else shares, accuracy)

    monkeypatch.setattr(ranks.F, "percentile_approx", wrong)
    for k in (5, 419):
        assert ranks.order_statistic(df, "v", k, len(values), 20) == sorted(values)[k]


@pytest.mark.parametrize("edges,circle", [
    ([(i, i + 1) for i in range(300)], False),
    ([(i, i + 1) for i in range(300)] + [(300, 0)], True),
    ([(1, 2), (2, 3), (3, 1), (9, 1), (3, 12)], True),
    ([(a, b) for a in range(6) for b in range(6) if a < b], False),
    ([(a, b) for a in range(5) for b in range(5) if a != b], True),
    ([(1, 1)], True),
    ([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], False),
    ([], False),
])
def test_circles_of_any_length(spark, edges, circle):
    ids = {x for e in edges for x in e} | {99}
    df = spark.createDataFrame([(i, [b for a, b in edges if a == i]) for i in ids], "id long, depends_on array<long>")
    assert validation.has_cycle(df) is circle


def test_weights_converge(spark):
    """Also where power iteration itself would take thousands of steps."""
    r = np.random.default_rng(8)
    for n in (3, 5, 7):
        a = np.exp(r.normal(0, 2.5, (n, n)))
        a = np.triu(a, 1) + np.tril(1 / a.T, -1) + np.eye(n)
        whole = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n)], "i int, j int, a double")
        values, vectors = np.linalg.eig(a)
        w = np.abs(vectors[:, np.argmax(values.real)].real)
        got = {x.i: x.w for x in pairwise.weights_sql(spark, whole).collect()}
        assert [got[i] for i in range(n)] == pytest.approx(list(w / w.sum()), abs=1e-9)


def test_draws_as_arrays_and_row_by_row(spark):
    """Both ways of the Monte Carlo give the same summary."""
    r = np.random.default_rng(9)
    rows = [(i, m, *(None if r.random() < 0.05 else float(x) for x in r.uniform(0, 1, 4).round(2))) for m in montecarlo.ALTERNATIVES for i in range(70)]
    norm = spark.createDataFrame(rows, "cell long, method string, heat_n double, people_n double, lack_n double, far_n double")
    inner, outer = {"lack": 0.5, "far": 0.5}, {"hazard": 1 / 3, "exposure": 1 / 3, "vulnerability": 1 / 3}
    draws = montecarlo.draws_table(spark, montecarlo.draw_weights(inner, outer, 90), list(inner), list(outer))
    run = lambda most: montecarlo.drawn_summary(norm, draws, "cell", {"hazard": "heat", "exposure": "people"}, "vulnerability", list(inner), index.FLOORS, 70, most=most)
    a, b = run(200_000), run(10)
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_tables_are_made_once(spark, tmp_path):
    """Until the files that they were made from change."""
    spark.range(3).write.parquet(f"{tmp_path}/in")
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/in")

    read = lambda: once(spark, "t", [f"{tmp_path}/in"], make).count()
    assert (read(), read(), len(made)) == (3, 3, 1)
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/in")
    assert (read(), len(made)) == (5, 2)


def test_draws_apart_and_in_one_task(spark):
    """Both ways make the same draws; ranks of a resample are those of its values."""
    r = np.random.default_rng(10)
    rows = [("ties", float(r.integers(0, 5)), float(r.integers(0, 4))) for _ in range(40)] + [("plain", float(i), float(i * 7 % 31) + i) for i in range(31)]
    rows += [("flat", 1.0, float(i)) for i in range(5)] + [("two", 1.0, 2.0), ("two", 2.0, 1.0), ("none", None, 1.0), (None, 1.0, 2.0), (None, 3.0, 2.5), (None, 2.0, 4.0), ("plain", None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    a, b = ({x.g: tuple(x)[1:] for x in agreement.resampled(df, "g", "x", "y", draws=1200, apart=apart).collect()} for apart in (True, False))
    assert a.keys() == b.keys() == {"ties", "plain", "flat", "two", None} and repr(sorted(a.items(), key=str)) == repr(sorted(b.items(), key=str))
    assert a["flat"][0] == 5 and a["two"][5] == 0 and a["plain"][5] == 1200
    x, y = (np.array([v[k] for v in sorted(rows[:40], key=lambda v: v[1:])]) for k in (1, 2))
    got = agreement._drawn(np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1], 50, [3], 7)[0]
    pick = np.random.default_rng([3, 0]).integers(0, 40, (50, 40))
    assert got == pytest.approx(agreement._rows_corr(agreement._mid(x[pick]), agreement._mid(y[pick])))


def test_ranks_travel_to_their_ranges(spark):
    """Of many cells too: ranges of any length, ranks beyond two bytes, ties and nothing at all."""
    r = np.random.default_rng(11)
    for values in (r.integers(0, 2**24, 500), np.arange(3), np.full(9, 65_536), np.empty(0, int)):
        got = montecarlo.unpacked(pa.py_buffer(montecarlo.packed(values.astype(np.int32))), len(values))
        assert got.tolist() == values.tolist()
    assert montecarlo.BROADCAST_CELLS >= 900_000
    rows = [(i, m, float(r.integers(0, 4)) / 4, float(r.integers(0, 3)) / 3, 0.5, float(r.integers(0, 2))) for m in montecarlo.ALTERNATIVES for i in range(53)]
    norm = spark.createDataFrame(rows, "cell long, method string, heat_n double, people_n double, lack_n double, far_n double")
    inner, outer = {"lack": 0.5, "far": 0.5}, {"hazard": 1 / 3, "exposure": 1 / 3, "vulnerability": 1 / 3}
    draws = montecarlo.draws_table(spark, montecarlo.draw_weights(inner, outer, 31), list(inner), list(outer))
    run = lambda **how: sorted(map(tuple, montecarlo.drawn_summary(norm, draws, "cell", {"hazard": "heat", "exposure": "people"}, "vulnerability", list(inner), index.FLOORS, 53, **how).collect()))
    assert run(range_cells=7) == run(range_cells=53) == run(most=10)


def test_stability_of_places_takes_ranks_as_arrays(spark):
    """Also with as many cells as 1 GB of tables has; no row stands for one draw of one cell."""
    from hexalloc.plans import catalog

    plan = catalog.QUERIES["place_stability"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and montecarlo.BROADCAST_CELLS > 900_000


def test_stability_of_places_makes_no_ranks(spark):
    """Draws are counted where they are made; neither ranks nor priorities travel or are sorted."""
    from hexalloc.plans import catalog

    plan = catalog.QUERIES["place_stability"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ranks#" not in plan and "median" not in plan and "hits#" in plan


def test_stability_alone_equals_the_summary(spark):
    """With ties at the border, cells without a value, any ranges, and draw by draw."""
    r = np.random.default_rng(12)
    inner, outer = {"lack": 0.5, "far": 0.5}, {"hazard": 1 / 3, "exposure": 1 / 3, "vulnerability": 1 / 3}
    draws = montecarlo.draws_table(spark, montecarlo.draw_weights(inner, outer, 30), list(inner), list(outer))
    for n, steps in ((53, 4), (40, 2), (1, 3)):
        some = lambda: None if r.random() < 0.1 else float(r.integers(0, steps)) / steps
        norm = spark.createDataFrame([(i, m, some(), some(), some(), some()) for m in montecarlo.ALTERNATIVES for i in range(n)], "cell long, method string, heat_n double, people_n double, lack_n double, far_n double")
        given = norm, draws, "cell", {"hazard": "heat", "exposure": "people"}, "vulnerability", list(inner), index.FLOORS, n
        want = sorted(map(tuple, montecarlo.drawn_summary(*given).select("cell", "p_top20", "stability").collect()))
        for how in ({}, {"range_cells": 7}, {"most": 0}):
            assert sorted(map(tuple, montecarlo.drawn_stability(*given, **how).collect())) == want


def test_few_sites_are_compared_with_every_point(spark):
    """As those in the cubes around are, at the date line, at poles and beside each other."""
    points = spark.createDataFrame([(k, lon, lat) for k, (lon, lat) in enumerate([(179.9995, 10.0), (-179.9995, 10.0), (0.0, 89.9999), (180.0, 89.9999), (67.2, 24.83), (67.2001, 24.8301), (67.3, 24.9)])], "cell long, lon double, lat double")
    sites = points.selectExpr("cell AS site", "lon AS site_lon", "lat AS site_lat")
    few, many = (sorted(map(tuple, joins.within(points, sites, 400.0, few_sites=k).collect())) for k in (10, 0))
    assert few == many and len(few) == 13
