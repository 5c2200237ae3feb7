"""Pixels to zones: composites over scenes, statistics, sums and class shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric


def composite_pixels(pixels: DataFrame, gain: float, offset: float, bad_bits: list[int], least_looks: int, pixel: str = "pixel", dn: str = "dn", qa: str = "qa") -> DataFrame:
    """``pixel, value, looks``: median over scenes of clear observations; null where there are
    fewer than ``least_looks``."""
    value = numeric.scaled_dn(F.col(dn), F.col(qa), numeric.qa_mask(bad_bits), gain, offset)
    seen = pixels.select(pixel, value.alias("v")).groupBy(pixel).agg(F.median("v").alias("m"), F.count("v").alias("looks"))
    return seen.select(pixel, F.when(F.col("looks") >= least_looks, F.col("m")).alias("value"), "looks")


def zone_statistics(pixels: DataFrame, zone: str = "zone", value: str = "value", looks: str = "looks", share: float = 0.9, pixel_area: float = 1.0, zone_area: Column | None = None) -> DataFrame:
    """Mean, percentile, pixels, coverage (1 at most), median looks, and quality flags."""
    area = zone_area if zone_area is not None else F.lit(1.0)
    out = pixels.groupBy(zone).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(share)).alias("high"), F.count(value).alias("pixels"), F.median(looks).alias("clear_looks"))
    out = out.withColumn("coverage", F.least(F.col("pixels") * pixel_area / area, F.lit(1.0)))
    return out.withColumn("flags", quality_flags(F.col("pixels"), F.col("coverage"), F.col("clear_looks")))


def quality_flags(pixels: Column, coverage: Column, looks: Column, fallback: Column | None = None) -> Column:
    found = [F.when(pixels == 0, "no_pixels"), F.when((pixels > 0) & (coverage < 0.5), "thin_pixel_coverage"), F.when(looks < 10, "few_clear_looks")]
    if fallback is not None:
        found.append(F.when(fallback, "all_touched_fallback"))
    return F.array_join(F.array_compact(F.array(*found)), "|")


def zone_sums(pixels: DataFrame, zone: str = "zone", value: str = "value") -> DataFrame:
    """Sum and count of each zone; the row of the null zone holds what no zone owns, so the sums
    add up to the grand total."""
    return pixels.groupBy(zone).agg(F.sum(value).alias("total"), F.count(value).alias("pixels"))


def owner(candidates: DataFrame, pixel: str, zone: str, order: str) -> DataFrame:
    """One zone for each pixel: the last of those that claim it."""
    return candidates.groupBy(pixel).agg(F.max_by(zone, order).alias(zone))


def class_shares(pixels: DataFrame, classes: dict[str, list[int]], zone: str = "zone", code: str = "code") -> DataFrame:
    """Share of each class among pixels with a code other than 0; 0 without any."""
    real = F.col(code) != 0
    return pixels.groupBy(zone).agg(*(F.coalesce(F.avg(F.when(real, F.col(code).isin(codes).cast("int"))), F.lit(0.0)).alias(name) for name, codes in classes.items()), F.count_if(real).alias("coded"))


def shares(df: DataFrame, total: str, counts: list[str]) -> DataFrame:
    """``share_<count>``, 1 at most; null with a flag where the total is not above 0."""
    new = {f"share_{c}": F.when(F.col(total) > 0, F.round(F.least(F.col(c) / F.col(total), F.lit(1.0)), 5)) for c in counts}
    return df.withColumns(new | {"flags": F.when(F.col(total) > 0, "").otherwise("no_population")})


def density(count: Column, area: Column) -> Column:
    return F.when(area != 0, F.bround(count / area, 1)).otherwise(0.0)


def with_fallback(first: DataFrame, second: DataFrame, zones: DataFrame, zone: str = "zone") -> DataFrame:
    """Statistics of every zone: from pixels whose centre is inside, or else, flagged, from all that
    touch it."""
    found = first.where("pixels > 0").withColumn("fallback", F.lit(False))
    left = zones.select(zone).distinct().join(found, zone, "left_anti")
    other = left.join(second, zone, "left").withColumns({"fallback": F.lit(True), "pixels": F.coalesce("pixels", F.lit(0))})
    return found.unionByName(other.select(*found.columns))
