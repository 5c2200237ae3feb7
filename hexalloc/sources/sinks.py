"""Writers: CSV, Parquet beside CSV, GeoJSON features, tiled pixels, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """``single`` is for small results that a person opens."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_both(df: DataFrame, path: str) -> None:
    """The table as Parquet and as CSV, from one computation."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.sparkSession.read.parquet(f"{path}/parquet").write.mode("overwrite").csv(f"{path}/csv", header=True)


def feature(properties: list[str], coordinates: Column, kind: str = "Polygon") -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def write_features(df: DataFrame, properties: list[str], coordinates: Column, path: str, kind: str = "Polygon") -> None:
    """One feature a line, written in parallel."""
    df.select(feature(properties, coordinates, kind).alias("value")).write.mode("overwrite").text(path)


def write_tiles(pixels: DataFrame, path: str, tile: str = "tile") -> None:
    pixels.repartition(tile).write.mode("overwrite").partitionBy(tile).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries, and old ones whose key isn't among them, by key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti")).orderBy(key)


def markdown(df: DataFrame) -> DataFrame:
    """One line of a Markdown table for each row; the caller writes head and order."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def scenario_document(reports: DataFrame, plan: DataFrame) -> DataFrame:
    """One JSON document for each scenario, its cells by serving order and in shares alone.

    Shares have four digits, and one more for every tenfold of ten cells, so that those of any number
    of cells add up to 1 within 0.0005."""
    cells = plan.groupBy("scenario", "cell").agg(F.sum("units").alias("units"))
    whole = cells.groupBy("scenario").agg(F.sum("units").alias("total"), F.count(F.lit(1)).alias("n"))
    scale = F.pow(F.lit(10.0), 4 + F.greatest(F.ceil(F.log10("n")) - 1, F.lit(0)))
    cells = cells.join(whole, "scenario").withColumn("share_of_stock", F.floor(F.col("units") / F.col("total") * scale + 0.5) / scale)
    rows = cells.groupBy("scenario").agg(F.sort_array(F.collect_list(F.struct("cell", "share_of_stock"))).alias("cells"))
    return reports.join(rows, "scenario", "left").select("scenario", F.to_json(F.struct(*[c for c in reports.columns], "cells")).alias("document"))
