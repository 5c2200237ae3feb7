import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexalloc.functions import numeric
from hexalloc.operators import agreement, allocation, index, joins, montecarlo, normalise, pairwise, reports, validation, zonal
from hexalloc.sources import readers, sinks
from hexalloc.streaming import composite


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize("method", list(normalise.METHODS))
def test_normalised_values(spark, method):
    df = spark.createDataFrame([(float(x),) for x in [1, 5, 5, 5, 9]], "v double")
    got = values(normalise.normalise(df, {"v": 1}, method).orderBy("v"), "v_n")
    assert got[0] == 0 and got[-1] == 1 and len(set(got[1:4])) == 1
    flipped = values(normalise.normalise(df, {"v": -1}, method).orderBy("v"), "v_n")
    assert flipped == pytest.approx([1 - x for x in got])
    with pytest.raises(ValueError):
        normalise.normalise(df, {"v": 0}, method)
    with pytest.raises(ValueError):
        normalise.normalise(df, {"v": 1}, "other")


def test_outliers_are_clipped(spark):
    df = spark.createDataFrame([(float(x),) for x in [-1000, *range(1, 100), 1000]], "v double")
    got = values(normalise.robust_minmax(df, {"v": 1}).orderBy("v"), "v_n")
    assert got[0] == 0 and got[-1] == 1 and max(np.diff(got)) < 0.05


MODEL = index.Model(
    (index.Indicator("h", "hazard", "hot"), index.Indicator("e", "exposure", "many", transform="log1p", structural_zero=True), index.Indicator("v", "vulnerability", "bare"), index.Indicator("w", "vulnerability", "far")),
    index.Weights({"hazard": 1 / 3, "exposure": 1 / 3, "vulnerability": 1 / 3}, {"hazard": {"h": 1.0}, "exposure": {"e": 1.0}, "vulnerability": {"v": 0.5, "w": 0.5}}),
)


def test_composite(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal()), int(rng.integers(0, 9)), float(rng.normal()), None) for i in range(60)]
    df = spark.createDataFrame(rows, "cell int, h double, e long, v double, w double")
    out = index.composite(df, MODEL).orderBy("cell").collect()
    assert all(r.model_incomplete for r in out)
    zero = [r for r in out if r.e == 0]
    assert zero and all(r.priority == 0 and r.intensity is None for r in zero)
    best = sorted(out, key=lambda r: -r.priority)
    assert best[0]["rank"] == 1 and all(a["rank"] <= b["rank"] for a, b in zip(best, best[1:]))
    assert all(1 <= len(r.top_reasons) <= 3 for r in out)


def test_joins(spark):
    base = spark.createDataFrame([(1,), (2,)], "cell int")
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "cell int, a double")
    with pytest.raises(joins.JoinError):
        joins.assemble(base, {"x": (twice, ["a"])}, "cell")
    with pytest.raises(joins.JoinError):
        joins.assemble(base, {"x": (twice.limit(1), ["b"])}, "cell")
    with pytest.raises(joins.JoinError):
        joins.must_match(base, twice.limit(1), "cell")


def great_circle(a, b):
    u, v = np.radians(a), np.radians(b)
    h = np.sin((v[1] - u[1]) / 2) ** 2 + np.cos(u[1]) * np.cos(v[1]) * np.sin((v[0] - u[0]) / 2) ** 2
    return 2 * 6_371_008.8 * np.arcsin(np.sqrt(min(h, 1.0)))


def globe(n, seed):
    """Points everywhere, some close to the date line, the poles, and one another."""
    r = np.random.default_rng(seed)
    out = [(float(r.uniform(-180, 180)), float(np.degrees(np.arcsin(r.uniform(-1, 1))))) for _ in range(n)]
    out += [(lon, lat) for lon in (179.9995, -179.9995, 180.0, -180.0, 0.0) for lat in (10.0, 80.0, 89.9999, -89.9999, -60.0)]
    return out + [(10.0 + k * 1e-4, 60.0 + k * 1e-4) for k in range(12)]


@pytest.mark.parametrize("side", [None, 500.0, 400_000.0])
def test_nearest_on_the_whole_globe(spark, side):
    points, sites = globe(40, 1), globe(300, 2)
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "cell int, lon double, lat double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)], "site int, site_lon double, site_lat double")
    out = joins.nearest(p, s, "cell", "site", side_m=side)
    got = {r.cell: r for r in out.collect()}
    assert got.keys() == set(range(len(points)))
    for i, x in enumerate(points):
        assert got[i].distance_m == pytest.approx(min(great_circle(x, y) for y in sites), abs=1e-3)
    # However many rounds there were, a round adds a scan of what it has written.
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len(lines) < 60 and sum("Scan ExistingRDD" in x for x in lines) >= 1


def test_nearest_of_far_points(spark):
    """A crowd of sites far away from everybody."""
    sites = [(i, 67.0 + (i % 20) * 0.001, 24.8 + i // 20 * 0.001) for i in range(300)]
    points = [(0, 67.0, 25.4), (1, 72.0, 24.8), (2, 97.0, 24.8), (3, -113.0, -24.8)]
    got = joins.nearest(spark.createDataFrame(points, "cell int, lon double, lat double"), spark.createDataFrame(sites, "site int, site_lon double, site_lat double"), "cell", "site")
    for r in got.collect():
        assert r.distance_m == pytest.approx(min(great_circle(points[r.cell][1:], y[1:]) for y in sites), abs=1e-3)


@pytest.mark.parametrize("radius", [400.0, 60_000.0, 2_500_000.0, 21_000_000.0])
def test_within_on_the_whole_globe(spark, radius):
    points, sites = globe(30, 3), globe(40, 4)
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "cell int, lon double, lat double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)], "site int, site_lon double, site_lat double")
    got = sorted((r.cell, r.site) for r in joins.within(p, s, radius).select("cell", "site").collect())
    assert got == sorted((i, j) for i, x in enumerate(points) for j, y in enumerate(sites) if great_circle(x, y) <= radius) and got


def test_dense_ranges_in_many_tasks(spark):
    """A single file of points is not a single task; both ways give the same pairs."""
    rng = np.random.default_rng(12)
    make = lambda n, names: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.uniform([67.15, 24.81], [67.17, 24.83], (n, 2)))], names)
    p, s = make(70, "cell int, lon double, lat double").coalesce(1), make(90, "site int, site_lon double, site_lat double").coalesce(1)
    a, b = (joins.within(p, s, 400.0, broadcast_sites=few) for few in (1000, 0))
    assert a.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and a.columns == b.columns
    all_of = p.crossJoin(s).withColumn("distance_m", numeric.haversine_m(F.col("lon"), F.col("lat"), F.col("site_lon"), F.col("site_lat"))).where("distance_m <= 400")
    want = sorted(map(tuple, all_of.collect()))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == want and len(want) > 100


@pytest.mark.parametrize("few", [0, 5000])
def test_nearest_against_all_pairs(spark, few):
    rng = np.random.default_rng(3)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([60, 20], [70, 30], (80, 2)))]
    s = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([60, 20], [70, 30], (9, 2)))]
    got = joins.nearest(spark.createDataFrame(p, "cell int, lon double, lat double"), spark.createDataFrame(s, "site int, site_lon double, site_lat double"), "cell", "site", broadcast_sites=few).collect()

    def metres(a, b):
        la1, la2 = np.radians([a[2], b[2]])
        h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371008.8 * np.arcsin(np.sqrt(h))

    want = {a[0]: min((metres(a, b), b[0]) for b in s) for a in p}
    assert len(got) == len(p)
    for r in got:
        assert r.site == want[r.cell][1] and r.distance_m == pytest.approx(want[r.cell][0])


def test_zones(spark):
    df = spark.createDataFrame([(1, 10.0, 20), (1, 30.0, 20), (2, None, 0)], "zone int, value double, looks int")
    got = {r.zone: r for r in zonal.zone_statistics(df, share=0.9, pixel_area=1.0, zone_area=F.lit(8.0)).collect()}
    assert (got[1]["mean"], got[1].high, got[1].pixels) == (20.0, pytest.approx(28.0), 2)
    assert got[1].flags == "thin_pixel_coverage" and got[2].flags == "no_pixels|few_clear_looks"
    r = zonal.shares(spark.createDataFrame([(0, 3), (2, 3)], "people int, old int"), "people", ["old"]).orderBy("people").collect()
    assert (r[0].share_old, r[0].flags, r[1].share_old) == (None, "no_population", 1.0)


def test_agreement(spark):
    a = [1, 3, 2, 5, 4, 7, 6, 9, 8, 11, 10, 12]
    df = spark.createDataFrame([("g", float(i + 1), float(x)) for i, x in enumerate(a)], "g string, m double, e double")
    assert agreement.spearman(df, "m", "e").first().rho == pytest.approx(0.9650, abs=1e-4)
    assert agreement.kendall(df, "m", "e", ["g"]).first().tau == pytest.approx(0.8485, abs=1e-4)
    r = agreement.resampled(df, "g", "m", "e", draws=2000).first()
    assert r.rho == pytest.approx(0.9650, abs=1e-4) and r.p < 0.01 and r.low < r.rho <= r.high <= 1
    flat = spark.createDataFrame([("g", float(i), 1.0) for i in range(5)], "g string, m double, e double")
    assert agreement.spearman(flat, "m", "e").first().rho is None


def test_concordance(spark):
    rows = [(w, p, r) for w, order in (("a", [1, 2, 3]), ("b", [1, 2, 3])) for p, r in enumerate(order)]
    df = spark.createDataFrame(rows, "who string, place int, rank int")
    assert agreement.concordance(df, "who", "place", "rank").first().w == pytest.approx(1.0)
    rows = [(w, p, r) for w, order in (("a", [1, 2, 3]), ("b", [3, 2, 1])) for p, r in enumerate(order)]
    assert agreement.concordance(spark.createDataFrame(rows, "who string, place int, rank int"), "who", "place", "rank").first().w == pytest.approx(0.0)


def test_pairwise(spark):
    m = pairwise.matrix(spark.createDataFrame([(0, 1, 3.0), (0, 2, 5.0), (1, 2, 3.0)], "i int, j int, a double"))
    e = pairwise.evaluate(m)
    assert e["weights"] == pytest.approx([0.6369855717, 0.2582849944, 0.1047294339], abs=1e-9)
    assert e["lambda_max"] == pytest.approx(3.038511090558) and e["cr"] == pytest.approx(0.0331992, abs=1e-6)
    assert e["bracket"][0] <= e["lambda_max"] <= e["bracket"][1]
    assert pairwise.three_items(3, 5, 3) == pytest.approx(e["weights"])
    cyclic = pairwise.evaluate(pairwise.matrix(spark.createDataFrame([(0, 1, 5.0), (0, 2, 0.2), (1, 2, 5.0)], "i int, j int, a double")))
    assert cyclic["weights"] == pytest.approx([1 / 3] * 3) and cyclic["lambda_max"] == pytest.approx(6.2) and cyclic["cr"] > 1
    with pytest.raises(ValueError):
        pairwise.matrix(spark.createDataFrame([(0, 1, -1.0)], "i int, j int, a double"))


def test_draws_are_the_published_ones():
    rows = montecarlo.draw_weights({"a": 0.5, "b": 0.5}, {"x": 1 / 3, "y": 1 / 3, "z": 1 / 3}, 4)
    rng = np.random.default_rng(montecarlo.SEED)
    for r in rows:
        assert r[2:4] == pytest.approx(rng.dirichlet([25.0, 25.0])) and r[4:] == pytest.approx(rng.dirichlet([50 / 3] * 3))
    assert [r[1] for r in rows] == ["robust_minmax", "percentile_rank"] * 2


def test_centres(spark):
    rows = [("a", "clinic", " Yes"), ("b", "ambulance_standby", "no"), ("c", "office", "unknown")]
    good = spark.createDataFrame(rows, "name string, role string, can_hold_stock string")
    assert values(allocation.holders(good), "name") == ["a"]
    for bad in (("d", "shop", "yes"), ("d", "clinic", "maybe"), ("d", "ambulance_standby", "yes"), ("d", None, "yes")):
        with pytest.raises(ValueError, match="d: "):
            allocation.holders(spark.createDataFrame([*rows, bad], good.schema))


def test_validation(spark):
    df = spark.createDataFrame([(1.0, None), (5.0, 2.0)], "a double, b double")
    assert [(r.column, r.missing, r.share) for r in validation.missing_summary(df, ["a", "b"]).collect()] == [("a", 0, 0.0), ("b", 1, 50.0)]
    with pytest.raises(validation.CheckError):
        validation.enforce(validation.gates(df, {"a": (0, 4)}))
    f = spark.createDataFrame([(1, [2]), (2, [3]), (3, [])], "id int, depends_on array<int>")
    assert not validation.has_cycle(f)
    assert validation.has_cycle(f.union(spark.createDataFrame([(4, [5]), (5, [4])], f.schema)))


def test_place_without_cells_is_unscorable(spark):
    places = spark.createDataFrame([("near", 67.0, 24.0, 7), ("lost", 10.0, 10.0, 99)], "place string, place_lon double, place_lat double, home int")
    cells = spark.createDataFrame([(7, 67.5, 24.5, 0.5, 10), (8, 67.001, 24.0, 0.9, 30)], "cell int, lon double, lat double, priority double, people int")
    got = {r.place: r for r in reports.place_scores(places, cells).collect()}
    assert got["near"].n == 2 and got["near"].weighted_mean == pytest.approx(0.8) and got["lost"].n is None


def test_readers_and_sinks(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("name,lat\na,1.5\n,\nb,\n")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType())])
    assert [tuple(r) for r in readers.read_csv(spark, str(p), schema).collect()] == [("a", 1.5), ("b", None)]
    p.write_text("name,lon\na,1.5\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(p), schema)
    (tmp_path / "o.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "clinic", "name": "x"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"amenity": "hospital"}}, {"type": "node", "id": 3, "tags": {"amenity": "clinic"}}]}')
    got = readers.named_points(readers.read_osm(spark, str(tmp_path / "o.json")), "amenity", "^(hospital|clinic|doctors)$").orderBy("osm").collect()
    assert [(r.name, r.lat, r.osm) for r in got] == [("x", 1.0, "node/1"), ("(unnamed)", 3.0, "way/2")]
    (tmp_path / "g.json").write_text('{"type": "FeatureCollection", "features": [{"properties": {"h": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    assert readers.read_geojson(spark, str(tmp_path / "g.json"), T.StructType([T.StructField("h", T.StringType())])).first().coordinates[0][1] == [1.0, 0.0]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert [tuple(r) for r in sinks.upsert(old, spark.createDataFrame([("b", 3)], old.schema), "key").collect()] == [("a", 1), ("b", 3)]
    sinks.write_both(old, str(tmp_path / "both"))
    assert spark.read.csv(str(tmp_path / "both/csv"), header=True).count() == 2


def test_zip_source(spark, tmp_path):
    path = str(tmp_path / "x.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("tiles/a.txt", "a" * 1000)
        z.writestr("tiles/b.txt", "b")
    spark.dataSource.register(readers.ZipSource)
    got = spark.read.format("zip_members").option("contains", "a.txt").load(path).collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("tiles/a.txt", b"a" * 1000)]


def test_stream(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    rows = [(1, f"s{i}", float(dn), 0) for i, dn in enumerate([44000, 45000, 46000])]
    spark.createDataFrame(rows[:2], composite.SCHEMA).coalesce(1).write.parquet(str(src / "a"))
    run = lambda: composite.start(spark, str(src / "*"), store, [0], 0.00341802, 149.0, 2).awaitTermination()
    run()
    spark.createDataFrame(rows[2:], composite.SCHEMA).coalesce(1).write.parquet(str(src / "b"))
    run()
    r = composite.latest(spark, store).first()
    assert r.looks == 3 and r.value == pytest.approx(45000 * 0.00341802 + 149 - 273.15)


def test_ingest(tmp_path):
    from hexalloc.sources import ingest

    answers, waits = [(503, {"Retry-After": "7"}, iter(())), (202, {}, iter(())), (200, {}, iter([b"ab", b"c"]))], []
    get = lambda address: answers.pop(0)
    path = ingest.fetch("x://a", tmp_path, "d/a.txt", "CC0", open_=get, sleep=waits.append)
    assert path.read_bytes() == b"abc" and waits == [7, 8] and not list(tmp_path.rglob("*.part"))
    assert ingest.fetch("x://a", tmp_path, "d/a.txt", "CC0", open_=get) == path
    path.write_bytes(b"other")
    answers.append((200, {}, iter([b"abc"])))
    assert ingest.fetch("x://a", tmp_path, "d/a.txt", "CC0", open_=get).read_bytes() == b"abc"
    for status, expected in ((404, None), (200, "0" * 64)):
        answers.append((status, {}, iter([b"z"])))
        with pytest.raises(ingest.FetchError):
            ingest.fetch("x://b", tmp_path, "b.txt", "CC0", expected=expected, open_=get)
    with pytest.raises(ingest.FetchError):
        ingest.only_member(["a1", "a2"], "a")


def test_verify_files(spark, tmp_path):
    import hashlib

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.txt").write_bytes(b"a")
    (tmp_path / "raw/b.txt").write_bytes(b"b")
    rows = [("a.txt", hashlib.sha256(b"a").hexdigest(), 1), ("b.txt", "0" * 64, 1), ("c.txt", "0" * 64, 1)]
    got = readers.verify_files(spark, str(tmp_path / "raw"), spark.createDataFrame(rows, "key string, sha256 string, bytes long"))
    assert {(r.key, r.problem) for r in got.collect()} == {("b.txt", "another digest"), ("c.txt", "missing")}


def test_documents_and_lines(spark):
    report = spark.createDataFrame([("s", 1.5)], "scenario string, objective double")
    plan = spark.createDataFrame([("s", 1, 1, 3.0), ("s", 2, 1, 1.0)], "scenario string, cell long, centre long, units double")
    import json

    doc = json.loads(sinks.scenario_document(report, plan).first().document)
    assert doc["cells"] == [{"cell": 1, "share_of_stock": 0.75}, {"cell": 2, "share_of_stock": 0.25}]
    assert values(sinks.markdown(spark.createDataFrame([("a|b", None)], "x string, y int")), "value") == ["| a\\|b |  |"]


def test_solver_groups(spark):
    pairs = spark.createDataFrame([("s", c, p, n, j, 10.0, d) for c, p, n in ((1, 0.9, 10.0), (2, 0.8, 10.0)) for j, d in ((0, 1000.0), (1, 2000.0 if c == 1 else 6000.0))], "scenario string, cell long, priority double, need double, centre long, stock double, distance_m double")
    solved = allocation.solve(*allocation.of_pairs(pairs), "exact", 5000.0).cache()
    plan, report = allocation.plan_of(solved), allocation.report_of(solved)
    assert report.first().objective == pytest.approx(16.994) and report.first().reachable == 2
    assert {(r.cell, r.centre, r.units) for r in plan.collect()} == {(1, 1, 10.0), (2, 0, 10.0)}
    got = allocation.totals(plan).collect()
    assert sum(r.units for r in got) == 60
