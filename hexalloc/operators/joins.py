"""Joins: one-to-one assembly, nearest site, distance ranges, members and consistency.

Spatial joins go over cubes: points of the globe are put into cubes of space, a side of which is
as long as the distance sought, and joined with the cubes around them.  So no side is crossed with
the other, and neither the date line nor the poles are special.  Only a side whose rows have been
counted is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EARTH_RADIUS_M, haversine_m
from ..stages import kept

#: Sites that may be broadcast, by count: to be compared with every point, and with those around them;
#: sites of a range that are compared with every point, as looking around makes 27 rows of each.
BROADCAST_SITES, BROADCAST_RANGE, FEW_SITES = 256, 500_000, 64
#: Sites that a cube should hold, and how much cubes widen from round to round.
SITES_A_CUBE, WIDER = 2.0, 4.0


class JoinError(ValueError):
    pass


def repeated_keys(tables: dict[str, DataFrame], key: str) -> list[tuple]:
    """Some keys that stand twice in a table, as (table, key), from one pass over all."""
    keys = reduce(DataFrame.unionAll, (df.select(F.lit(name).alias("table"), key) for name, df in tables.items()))
    return [tuple(r) for r in keys.groupBy("table", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table", key).limit(3).collect()]


def assert_unique(df: DataFrame, key: str, what: str) -> None:
    if bad := repeated_keys({what: df}, key):
        raise JoinError(f"key {key} repeats, for example {bad}")


def assemble(base: DataFrame, layers: dict[str, tuple[DataFrame, list[str]]], key: str, pending: tuple[str, ...] = (), grouped: tuple[str, ...] = ()) -> DataFrame:
    """Left-joins layers one to one, picking their columns; ``pending`` columns are all null.

    Keys must be unique on both sides, so the number of rows can't change.  ``grouped`` names the
    layers (and "base") that were grouped by their key, which need no look."""
    for name, (layer, columns) in layers.items():
        if absent := [c for c in [key, *columns] if c not in layer.columns]:
            raise JoinError(f"layer {name} lacks {absent}")
    look = {n: df for n, df in {"base": base, **{f"layer {n}": v[0] for n, v in layers.items()}}.items() if n.removeprefix("layer ") not in grouped}
    if look and (bad := repeated_keys(look, key)):
        raise JoinError(f"key {key} repeats, for example {bad}")
    out = base
    for layer, columns in layers.values():
        out = out.join(layer.select(key, *columns), key, "left")
    return out.withColumns({c: F.lit(None).cast("double") for c in pending})


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every key of the left must be found."""
    lost = left.join(right, key, "left_anti").select(key).limit(3).collect()
    if lost:
        raise JoinError(f"keys without a match: {[r[0] for r in lost]}")
    return left.join(right, key)


def unit(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """The place of a point of the globe in space, in radii."""
    u, v = F.radians(lon), F.radians(lat)
    return F.cos(v) * F.cos(u), F.cos(v) * F.sin(u), F.sin(v)


def cube(lon: Column, lat: Column, side_m: float) -> tuple[Column, Column, Column]:
    """The cube of space that a point of the globe lies in."""
    return tuple(F.floor(x * (EARTH_RADIUS_M / side_m)) for x in unit(lon, lat))


def dealt(df: DataFrame, tasks: int) -> DataFrame:
    """A table whose rows make many others each, over as many tasks: a small file is a single one."""
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))


def all_pairs(points: DataFrame, sites: DataFrame, site_key: str, broadcast_sites: int, task_pairs: int = 4_000_000, part_sites: int = 4_000) -> DataFrame:
    """Every point with every site: up to ``broadcast_sites`` sites (counted) go to all tasks, each of
    which makes about ``task_pairs`` pairs.

    Sites go in parts of about ``part_sites``, by a hash of their key, each with all points. In a file of
    pairs the same sites come again soon, so they are held as short numbers of a dictionary, where a pass
    over many sites for each point would write every key out."""
    n = sites.count()
    if n > broadcast_sites:
        return points.crossJoin(sites)
    tasks, parts = min(-(-points.count() * n // task_pairs), 10_000), max(-(-n // part_sites), 1)
    points = dealt(points, -(-tasks // parts))
    if parts == 1:
        return points.crossJoin(F.broadcast(sites))
    part = F.pmod(F.xxhash64(site_key), F.lit(parts))
    return reduce(DataFrame.unionAll, (points.crossJoin(F.broadcast(sites.where(part == i))) for i in range(parts)))


CUBE = ("__x", "__y", "__z")
#: Places in space and cosines of the latitude, of a point and of a site.
UNIT = ("__ux", "__uy", "__uz", "__uc", "__sx", "__sy", "__sz", "__sc")


def in_cubes(df: DataFrame, at: tuple[str, str], side_m: float, around: bool = False) -> DataFrame:
    """Adds a point's cube; with ``around``, a row for it and each of the 26 around it."""
    place = cube(F.col(at[0]), F.col(at[1]), side_m)
    if not around:
        return df.withColumns(dict(zip(CUBE, place)))
    steps = F.sequence(F.lit(-1), F.lit(1))
    for name, x in zip(CUBE, place):
        df = df.withColumn(name, x).withColumn("__step", F.explode(steps)).withColumn(name, F.col(name) + F.col("__step")).drop("__step")
    return df


def chord_m(distance_m: float) -> float:
    """The straight line under an arc of the globe."""
    return 2 * EARTH_RADIUS_M * math.sin(min(distance_m / (2 * EARTH_RADIUS_M), math.pi / 2))


def within(points: DataFrame, sites: DataFrame, radius_m: float, point: tuple[str, str] = ("lon", "lat"), site: tuple[str, str] = ("site_lon", "site_lat"), distance: Callable = haversine_m, broadcast_sites: int = BROADCAST_RANGE, few_sites: int = FEW_SITES) -> DataFrame:
    """Pairs of points and sites at most ``radius_m`` apart, with ``distance_m``, anywhere on the
    globe.  ``distance`` may differ from the great circle's by 1 %.

    Up to ``broadcast_sites`` sites (counted) go to all tasks, and points look into the cubes around
    them (a few sites are compared with every point); more sites are joined cube by cube.  The straight line through the globe, from places made
    once for each point, turns most pairs away before a distance is worked out."""
    side = chord_m(radius_m * 1.01) + 1e-3
    ends = (points, point, UNIT[:4]), (sites, site, UNIT[4:])
    points, sites = (df.withColumns(dict(zip(names, (*unit(F.col(at[0]), F.col(at[1])), F.cos(F.radians(F.col(at[1]))))))) for df, at, names in ends)
    n = sites.limit(broadcast_sites + 1).count()
    if n <= min(few_sites, broadcast_sites):
        pairs = dealt(points, min(-(-points.count() // 50_000), 10_000)).crossJoin(F.broadcast(sites))
    elif n <= broadcast_sites:
        tasks = min(-(-points.count() // 5_000), 10_000)
        pairs = in_cubes(dealt(points, tasks), point, side, around=True).join(F.broadcast(in_cubes(sites, site, side)), [*CUBE])
    else:
        pairs = in_cubes(points, point, side).join(in_cubes(sites, site, side, around=True), [*CUBE])
    apart = [F.col(a) - F.col(b) for a, b in zip(UNIT[:3], UNIT[4:7])]
    pairs = pairs.where(apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2] <= (side / EARTH_RADIUS_M) ** 2 * (1 + 1e-9))
    at = (F.col(point[0]), F.col(point[1]), F.col(site[0]), F.col(site[1]))
    d = haversine_m(*at, F.col(UNIT[3]), F.col(UNIT[7])) if distance is haversine_m else distance(*at)
    return pairs.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).drop(*CUBE, *UNIT)


def nearest(points: DataFrame, sites: DataFrame, key: str, site_key: str, point: tuple[str, str] = ("lon", "lat"), site: tuple[str, str] = ("site_lon", "site_lat"), carry: tuple[str, ...] = (), distance: Callable = haversine_m, broadcast_sites: int = BROADCAST_SITES, side_m: float | None = None) -> DataFrame:
    """The nearest site of each point: ``key, site_key, distance_m`` and ``carry``; the smaller
    site key wins a tie.  ``distance`` may differ from the great circle's by 1 %.

    Few sites (counted) are broadcast.  More go over cubes, at first of a side at which one holds
    a few sites: a point takes the nearest site of the cubes around it if none beyond can be nearer,
    and the points left try cubes four times as wide, until those around a point are all there are.
    Every round starts from rows that the round before has written.
    """
    sites = sites.select(site_key, *site, *carry)
    d = distance(F.col(point[0]), F.col(point[1]), F.col(site[0]), F.col(site[1]))
    best = F.min(F.struct(d.alias("distance_m"), F.col(site_key), *map(F.col, carry))).alias("b")
    found = lambda df: df.select(key, f"b.{site_key}", "b.distance_m", *(f"b.{c}" for c in carry))
    points = points.select(key, *point)
    n, west, east, south, north = sites.agg(F.count(F.lit(1)), F.min(site[0]), F.max(site[0]), F.min(site[1]), F.max(site[1])).first()
    if n <= broadcast_sites or not n:
        return found(points.crossJoin(F.broadcast(sites)).groupBy(key).agg(best))
    if side_m is None:
        metres = EARTH_RADIUS_M * math.pi / 180
        side_m = max(10.0, math.sqrt(max(east - west, 1e-4) * max(north - south, 1e-4) / n * SITES_A_CUBE) * metres)
    done = []
    while True:
        last = side_m >= 2 * EARTH_RADIUS_M
        got = in_cubes(points, point, side_m).join(in_cubes(sites, site, side_m, around=True), [*CUBE]).groupBy(key).agg(best)
        # What is not in the cubes around is at least a side away, as the crow would dig.
        sure = F.lit(True) if last else 2 * EARTH_RADIUS_M * F.sin(F.least(F.col("b.distance_m") * 1.02 / (2 * EARTH_RADIUS_M), F.lit(math.pi / 2))) <= side_m
        if last:
            done.append(found(got))
            break
        # Points without a sure site go on; they are known once the round is written.
        tried = kept(points.join(got, key, "left").withColumn("__sure", F.coalesce(sure, F.lit(False))))
        done.append(found(tried.where("__sure")))
        points = tried.where("not __sure").select(key, *point)
        if points.isEmpty():
            break
        side_m *= WIDER
    return reduce(DataFrame.unionByName, done)


def members(df: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known, and rows whose key isn't."""
    keys = known.select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def differences(left: DataFrame, right: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """Keys of one side alone, and keys whose values differ by more than the tolerance."""
    l = left.select(key, *(F.col(c).alias(f"{c}_l") for c in tolerances), F.lit(1).alias("__l"))
    r = right.select(key, *(F.col(c).alias(f"{c}_r") for c in tolerances), F.lit(1).alias("__r"))
    both = l.join(r, key, "full")
    off = [F.when((F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")) > t) | (F.col(f"{c}_l").isNull() != F.col(f"{c}_r").isNull()), F.lit(c)) for c, t in tolerances.items()]
    problem = F.when(F.col("__r").isNull(), "left only").when(F.col("__l").isNull(), "right only").otherwise(F.nullif(F.array_join(F.array_compact(F.array(*off)), ","), F.lit("")))
    return both.select(key, problem.alias("problem")).where("problem is not null")
