import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hexalloc.functions import geometry, numeric, ranks, text
from hexalloc.operators import joins
from hexalloc.plans import catalog, tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_rounding_is_half_even(spark):
    r = one(spark, a=numeric.rint_to(F.lit(0.125), 2), b=numeric.rint_to(F.lit(0.375), 2))
    assert (r.a, r.b) == (0.12, 0.38)


def test_clip_keeps_nulls(spark):
    r = one(spark, a=numeric.clip(F.lit(None).cast("double"), 0, 1), b=numeric.clip(F.lit(3.0), 0, 1))
    assert r.a is None and r.b == 1.0


def test_geometric_mean(spark):
    parts = {"h": F.lit(0.25), "v": F.lit(1.0)}
    assert one(spark, a=numeric.weighted_geometric_mean(parts, {"h": 0.5, "v": 0.5})).a == pytest.approx(0.5)
    assert one(spark, a=numeric.weighted_geometric_mean(parts | {"h": F.lit(0.0)}, {"h": 0.5, "v": 0.5})).a == 0
    with pytest.raises(ValueError):
        numeric.weighted_geometric_mean(parts, {"h": 0.5, "v": 0.6})


def test_utm_distance_of_a_published_pair(spark):
    a = [F.lit(x) for x in (67.15035562276603, 24.860397636028395, 67.18, 24.845)]
    assert one(spark, d=numeric.utm_distance_m(*a, 42, 1.3)).d == pytest.approx(4482.01369825369, abs=1e-6)
    assert one(spark, d=numeric.ellipsoidal_m(*a, 1.3)).d == pytest.approx(4482.0137, rel=5e-4)
    with pytest.raises(ValueError):
        numeric.utm_distance_m(*a, 42, 0.9)


def test_scaled_numbers_and_masks(spark):
    mask = numeric.qa_mask([0, 1, 2, 3, 4])
    assert mask == 31
    v = lambda dn, qa: one(spark, a=numeric.scaled_dn(F.lit(dn), F.lit(qa), mask, 0.00341802, 149.0)).a
    assert v(44000.0, 64) == pytest.approx(26.243, abs=1e-3)
    assert v(44000.0, 8) is None and v(0.0, 64) is None


def test_fisher_is_undefined_at_the_ends(spark):
    for rho, n in ((0.5, 3), (1.0, 10), (-1.0, 10)):
        low, high = numeric.fisher_interval(F.lit(rho), F.lit(n))
        r = one(spark, a=low, b=high)
        assert r.a is None and r.b is None


def test_text(spark):
    r = one(spark, a=text.slug(F.lit("  Ab--c é D ")), b=text.squeeze(F.lit(" a \n b ")), c=text.cause_of(F.lit("x -- the floor asks for 3 units (this is y)")), d=text.cause_of(F.lit("x -- too far (this is y)")), e=text.units(F.lit(1234)), f=text.percent(F.lit(0.256)), g=text.scenario_id(F.lit("water"), F.lit(0.25), F.lit(5000.0)))
    assert (r.a, r.b) == ("ab-c-d", "a b")
    assert r.c == "their whole estimated need is smaller than the floor" and r.d == "too far"
    assert (r.e, r.f, r.g) == ("1,234 units", "26%", "water-25pct-5000m")


@pytest.mark.parametrize("small", [200_000, 3])
def test_ranks_of_ties_and_nulls(spark, small):
    v = [5.0, 1.0, 5.0, None, 9.0, 1.0, 5.0]
    df = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    got = ranks.with_ranks(df, "v", rank="r", mid="m", share="s", small=small).orderBy("i").collect()
    assert [x.r for x in got] == [2, 5, 2, None, 1, 5, 2]
    assert [x.m for x in got] == [3, 5.5, 3, None, 1, 5.5, 3]
    assert [x.s for x in got] == pytest.approx([0.6, 0.1, 0.6, None, 1.0, 0.1, 0.6])


def test_ranks_over_ranges_equal_a_window(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(g), float(round(x, 2))) for g, x in zip(rng.integers(0, 3, 3000), rng.normal(size=3000))], "g int, v double")
    df = df.withColumn("want", F.expr("rank() over (partition by g order by v desc)"))
    assert ranks.with_ranks(df, "v", rank="r", groups=["g"], small=10).where("r != want").count() == 0


def test_percentiles_by_narrowing(spark):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=4000), np.repeat([1.0, 2.0, 3.0], 1500), rng.integers(0, 50, 4000).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        got = ranks.percentiles(df, {"v": [0.0, 0.05, 0.5, 0.95, 1.0]}, exact_rows=200)["v"]
        assert got == pytest.approx(np.percentile(x, [0, 5, 50, 95, 100]).tolist(), abs=1e-12)


def test_percentiles_of_nothing(spark):
    assert ranks.percentiles(spark.createDataFrame([(None,)], "v double"), {"v": [0.5]}) == {"v": [None]}


def test_nearest_rank(spark):
    a = F.array(*(F.lit(x) for x in range(1, 1001)))
    assert one(spark, a=ranks.nearest_rank(a, 0.05)).a == int(np.percentile(np.arange(1, 1001), 5, method="nearest"))


def ring(points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_geometry(spark):
    square = ring([(0, 0), (4, 0), (4, 4), (0, 4)])
    r = one(spark, a=geometry.area(square), c=geometry.centroid(square), inside=geometry.contains(square, F.lit(1.0), F.lit(3.9)), out=geometry.contains(square, F.lit(5.0), F.lit(1.0)))
    assert r.a == 16 and (r.c.x, r.c.y) == (2, 2) and r.inside and not r.out
    assert geometry.clip_ring([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (6, 2), (6, 6), (2, 6)])
    hexagon = one(spark, a=geometry.area(geometry.hexagon_ring(F.lit(2), F.lit(-1), 10.0))).a
    assert hexagon == pytest.approx(3 * math.sqrt(3) / 2 * 100)


def test_hexagons_hold_their_centres(spark):
    df = spark.range(-5, 6).crossJoin(spark.range(-5, 6).withColumnRenamed("id", "r")).withColumnRenamed("id", "q")
    x, y = geometry.hexagon_centre(F.col("q"), F.col("r"), 7.0)
    q, r = geometry.hexagon(x + 0.3, y - 0.2, 7.0)
    assert df.where((q != F.col("q")) | (r != F.col("r"))).count() == 0


def test_lines_and_rings():
    assert geometry.simplify_line([(0, 0), (1, 0.1), (2, 0), (2, 5)], 0.5) == [(0, 0), (2, 0), (2, 5)]
    rings = geometry.stitch([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)]])
    assert len(rings) == 1 and rings[0][0] == rings[0][-1] and len(rings[0]) == 4
    for bad in ([], [[(0, 0), (1, 0)]]):
        with pytest.raises(ValueError):
            geometry.stitch(bad)


def test_pairs_are_made_in_many_tasks_of_projected_points(spark):
    """One small file is not one task, and no pair projects its ends anew."""
    sf = "/root/testdata/sf0.01"
    df = catalog.QUERIES["utm_distance"](spark, sf)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sinh" in line.lower() for line in plan.split("\n")[: plan.split("\n").index(next(x for x in plan.split("\n") if "Join" in x))])
    got = {(r.cell, r.facility): r.distance_m for r in df.where("cell % 211 = 5 and facility % 17 = 3").collect()}
    c, f = tables.cells(spark, sf), tables.facilities(spark, sf)
    d = numeric.utm_distance_m(F.col("lon"), F.col("lat"), F.col("site_lon"), F.col("site_lat"), 42, 1.3)
    want = {(r.cell, r.facility): r.d for r in c.where("cell % 211 = 5").crossJoin(f.where("facility % 17 = 3")).select("cell", "facility", F.round(d, 3).alias("d")).collect()}
    assert got.keys() == want.keys() and len(got) > 10 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_rounding_by_scale(spark):
    row = one(spark, a=numeric.round_half_up(F.lit(2.0005), 3), b=numeric.round_half_up(F.lit(0.1234499), 3), c=numeric.round_half_up(F.lit(None).cast("double"), 3), d=numeric.round_half_up(F.lit(7.5), 0))
    assert (row.a, row.b, row.c, row.d) == (2.001, 0.123, None, 8.0)


def test_many_sites_go_in_parts_that_make_small_files(spark, tmp_path):
    """All pairs, once each, with the key of a site as a number of a dictionary and not written out for each pair."""
    sites = spark.range(0, 120_000, 4, 3).select(F.when(F.col("id") != 44, F.col("id") * 1_000_003).alias("facility"), F.rand(7).alias("fx"))
    points = spark.range(0, 41, 1, 3).withColumnRenamed("id", "cell")
    joins.all_pairs(points, sites, "facility", 100_000).write.parquet(str(tmp_path / "pairs"))
    back = spark.read.parquet(str(tmp_path / "pairs"))
    got = back.groupBy("facility").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell").alias("cells"), F.countDistinct("fx").alias("fx"))
    assert got.count() == 30_000 and got.where("n != 41 or cells != 41 or fx != 1").count() == 0
    found = [pq.ParquetFile(f).metadata for f in (tmp_path / "pairs").glob("*.parquet")]
    assert found and sum(m.num_rows for m in found) == 41 * 30_000
    key = [m.row_group(g).column(1) for m in found for g in range(m.num_row_groups)]
    assert sum(c.total_uncompressed_size for c in key) < 4 * 41 * 30_000
