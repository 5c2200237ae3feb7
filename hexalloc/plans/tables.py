"""The model's relations on a star schema: customers are cells, suppliers facilities, nations
places, events pixels.  Coordinates come from keys by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from ..operators.index import Indicator, Model, Weights
from ..stages import once

THIRD = 1 / 3
MODEL = Model(
    (
        Indicator("heat", "hazard", "The ground here gets hotter on summer afternoons"),
        Indicator("people", "exposure", "More people live in this area", transform="log1p", structural_zero=True),
        Indicator("lack_green", "vulnerability", "Little greenery or shade"),
        Indicator("dist_health", "vulnerability", "Further from the nearest clinic or hospital"),
        Indicator("dist_centre", "vulnerability", "Further from the nearest relief centre"),
    ),
    Weights(
        {"hazard": THIRD, "exposure": THIRD, "vulnerability": THIRD},
        {"hazard": {"heat": 1.0}, "exposure": {"people": 1.0}, "vulnerability": {"lack_green": THIRD, "dist_health": THIRD, "dist_centre": THIRD}},
    ),
)
CIRCUITY = 1.3


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinates(key, a: int, b: int):
    lon = F.lit(67.148) + (key * a % 10007).cast("double") / F.lit(10007.0) * F.lit(0.071)
    lat = F.lit(24.815) + (key * b % 10009).cast("double") / F.lit(10009.0) * F.lit(0.055)
    return lon, lat


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = coordinates(F.col("c_custkey"), 7919, 104729)
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), lon.alias("lon"), lat.alias("lat"))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = coordinates(F.col("s_suppkey"), 6997, 7919)
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("facility"), lon.alias("site_lon"), lat.alias("site_lat"), F.floor(F.greatest("s_acctbal", F.lit(0.0))).alias("stock"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = coordinates(F.col("n_nationkey").cast("long") + 1, 4001, 5003)
    return load(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), lon.alias("place_lon"), lat.alias("place_lat"), (F.col("n_nationkey").cast("long") * 37 + 1).alias("home"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell, heat, lack_green``: averages over a cell's order lines, summed up by order first.
    Sums are of whole hundredths, so they don't depend on the order of rows."""
    hundredths = lambda c: F.sum(F.rint(F.col(c) * 100).cast("long"))
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(hundredths("l_extendedprice").alias("e"), hundredths("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    by_cell = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy(F.col("o_custkey").alias("cell"))
    return by_cell.agg((F.sum("e") / F.sum("n") / 100).alias("heat"), (F.sum("d") / F.sum("n") / 100).alias("lack_green"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell, people``: pending orders; cells without any have 0 (where joined)."""
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("cell")).agg(F.count(F.lit(1)).alias("people"))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = joins.nearest(cells(spark, sf_dir), facilities(spark, sf_dir), "cell", "facility")
    return near.select("cell", F.round(F.col("distance_m") * CIRCUITY, 3).alias("dist_health"))


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells' table with all layers."""
    # Layers are grouped by cell; the cells' own keys are looked at.
    layers = {"measures": (measures(spark, sf_dir), ["heat", "lack_green"]), "people": (people(spark, sf_dir), ["people"]), "health": (health(spark, sf_dir), ["dist_health"])}
    out = joins.assemble(cells(spark, sf_dir), layers, "cell", ("dist_centre",), grouped=tuple(layers))
    return out.withColumn("people", F.coalesce("people", F.lit(0)))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once for all queries over the same files."""
    return once(spark, "indicators", [f"{sf_dir}/{n}.parquet" for n in ("customer", "orders", "lineitem", "supplier")], lambda: assembled(spark, sf_dir))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("pixel"), F.to_date("ts").alias("scene"), (F.col("value") * 100).alias("dn"), F.col("event_id").alias("qa"), "event_type", "ts", "event_id")


SQL_CELLS = """cells AS (SELECT c_custkey AS cell,
  CAST(67.148 AS DOUBLE) + CAST(c_custkey * 7919 % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.071 AS DOUBLE) AS lon,
  CAST(24.815 AS DOUBLE) + CAST(c_custkey * 104729 % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE) * CAST(0.055 AS DOUBLE) AS lat FROM customer)"""
SQL_FACILITIES = """facilities AS (SELECT s_suppkey AS facility,
  CAST(67.148 AS DOUBLE) + CAST(s_suppkey * 6997 % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.071 AS DOUBLE) AS site_lon,
  CAST(24.815 AS DOUBLE) + CAST(s_suppkey * 7919 % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE) * CAST(0.055 AS DOUBLE) AS site_lat,
  CAST(floor(greatest(s_acctbal, 0.0)) AS BIGINT) AS stock FROM supplier)"""
SQL_PLACES = """places AS (SELECT n_name AS place, CAST(n_nationkey AS BIGINT) * 37 + 1 AS home,
  CAST(67.148 AS DOUBLE) + CAST((CAST(n_nationkey AS BIGINT) + 1) * 4001 % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.071 AS DOUBLE) AS place_lon,
  CAST(24.815 AS DOUBLE) + CAST((CAST(n_nationkey AS BIGINT) + 1) * 5003 % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE) * CAST(0.055 AS DOUBLE) AS place_lat FROM nation)"""


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


SQL_INDICATORS = f"""{SQL_CELLS}, {SQL_FACILITIES},
measures AS (SELECT o_custkey AS cell, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / count(*) / 100 AS heat, sum(CAST(round(l_discount * 100) AS BIGINT))::DOUBLE / count(*) / 100 AS lack_green FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
peopled AS (SELECT o_custkey AS cell, count(*) AS people FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
health AS (SELECT cell, round(min({sql_haversine('lon', 'lat', 'site_lon', 'site_lat')}) * CAST(1.3 AS DOUBLE), 3) AS dist_health FROM cells CROSS JOIN facilities GROUP BY 1),
ind AS (SELECT c.cell, c.lon, c.lat, m.heat, m.lack_green, coalesce(p.people, 0) AS people, h.dist_health, CAST(NULL AS DOUBLE) AS dist_centre
  FROM cells c LEFT JOIN measures m USING (cell) LEFT JOIN peopled p USING (cell) LEFT JOIN health h USING (cell))"""


def sql_robust(column: str, source: str, transform: str = "{}") -> str:
    """Scaled to 0..1 between the 5th and 95th percentile, as a scalar of ``source``."""
    v = transform.format(column)
    low, high = (f"(SELECT quantile_cont({v}, {q}) FROM {source})" for q in ("0.05", "0.95"))
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {high} - {low} <= 1e-12 * greatest(1.0, abs({high}), abs({low})) THEN 0.0 ELSE (least(greatest({v}, {low}), {high}) - {low}) / ({high} - {low}) END"


SQL_NORMAL = f"""{SQL_INDICATORS},
norm AS (SELECT cell, lon, lat, people, {sql_robust('heat', 'ind')} AS heat_n,
  CASE WHEN people = 0 THEN 0.0 ELSE {sql_robust('people', 'ind', 'ln(1 + {})')} END AS people_n,
  {sql_robust('lack_green', 'ind')} AS lack_green_n, {sql_robust('dist_health', 'ind')} AS dist_health_n FROM ind)"""


def sql_priority(eh: str = "1.0/3", ee: str = "1.0/3", ev: str = "1.0/3", name: str = "prio", source: str = "norm") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN least(hazard, exposure, vulnerability) <= 0 THEN 0.0
  ELSE exp(CAST({eh} AS DOUBLE) * ln(hazard) + CAST({ee} AS DOUBLE) * ln(exposure) + CAST({ev} AS DOUBLE) * ln(vulnerability)) END AS priority
  FROM (SELECT *, greatest(coalesce(heat_n, 0.0), 0.01) AS hazard, coalesce(people_n, 0.0) AS exposure,
    greatest(0.5 * coalesce(lack_green_n, 0.0) + 0.5 * coalesce(dist_health_n, 0.0), 0.01) AS vulnerability FROM {source}) s)"""


SQL_PRIORITY = f"""{SQL_NORMAL}, {sql_priority()},
ranked AS (SELECT *, rank() OVER (ORDER BY round(priority, 12) DESC) AS rank FROM prio)"""
