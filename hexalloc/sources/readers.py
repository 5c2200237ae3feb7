"""Readers: checked CSV, GeoJSON, OSM elements, manifests, ZIP members."""

from __future__ import annotations

import os
import struct as _struct
import urllib.request
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
OSM = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
        T.StructField("center", POINT), T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.ArrayType(POINT)),
        T.StructField("members", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("role", T.StringType()), T.StructField("geometry", T.ArrayType(POINT))]))),
    ]))),
])
MANIFEST = T.MapType(T.StringType(), T.StructType([T.StructField(n, t) for n, t in (("url", T.StringType()), ("sha256", T.StringType()), ("bytes", T.LongType()), ("downloaded", T.DateType()), ("licence", T.StringType()), ("note", T.StringType()))]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV whose header must be the schema's names in order; blank rows are dropped, empty fields
    are null."""
    header = spark.read.text(path).limit(1).collect()
    names = [c.strip() for c in header[0][0].lstrip("﻿").split(",")] if header else []
    if names != schema.names:
        raise ValueError(f"{path}: header {names} is not {schema.names}")
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="FAILFAST")
    return df.dropna("all")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null from here on, never NaN."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_geojson(spark: SparkSession, path: str, properties: T.StructType, depth: int = 3) -> DataFrame:
    """Properties and coordinates of every feature; ``depth``: arrays around the numbers (1: points)."""
    coordinates: T.DataType = T.DoubleType()
    for _ in range(depth):
        coordinates = T.ArrayType(coordinates)
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", coordinates)]))])
    doc = spark.read.json(path, schema=T.StructType([T.StructField("features", T.ArrayType(feature))]), multiLine=True, mode="FAILFAST")
    return doc.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """One row for each element; coordinates are the element's or its centre's."""
    e = spark.read.json(path, schema=OSM, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    return e.withColumns({"lat": F.coalesce("lat", "center.lat"), "lon": F.coalesce("lon", "center.lon")})


def named_points(elements: DataFrame, tag: str, pattern: str) -> DataFrame:
    """Elements with coordinates whose tag matches; a name, if need be a stand-in."""
    hit = elements.where(F.element_at("tags", F.lit(tag)).rlike(pattern) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return hit.select(F.coalesce(F.element_at("tags", F.lit("name:en")), F.element_at("tags", F.lit("name")), F.lit("(unnamed)")).alias("name"), F.element_at("tags", F.lit(tag)).alias(tag), "lat", "lon", F.concat_ws("/", "type", "id").alias("osm"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", MANIFEST)).alias("key", "e")).select("key", "e.*")


def verify_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``key, problem`` of files that are missing, not listed, or of another size or digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.regexp_replace("path", f"^.*?{folder.rstrip('/').split('/')[-1]}/", "")
    files = files.select(base.alias("key"), F.sha2("content", 256).alias("got"), F.col("length").alias("size"))
    both = manifest.select("key", "sha256", "bytes").join(files, "key", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("size") != F.col("bytes"), "another size").when(F.col("got") != F.col("sha256"), "another digest")
    return both.select("key", problem.alias("problem")).where("problem is not null")


class ZipMember(InputPartition):
    def __init__(self, path: str, name: str, offset: int, size: int, method: int):
        super().__init__(name)
        self.path, self.name, self.offset, self.size, self.method = path, name, offset, size, method


class ZipReader(DataSourceReader):
    """One partition for each wanted member; only its bytes are read."""

    def __init__(self, options):
        self.path, self.contains = options["path"], options.get("contains", "")

    def partitions(self):
        return [m for m in members_of(self.path) if self.contains in m.name] or [ZipMember(self.path, "", 0, 0, -1)]

    def read(self, partition):
        if partition.method >= 0:
            yield partition.name, extract(partition)


class ZipSource(DataSource):
    """``spark.read.format("zip_members").option("contains", ...).load(path)``"""

    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return "name string, content binary"

    def reader(self, schema):
        return ZipReader(self.options)


def ranged(path: str, first: int, size: int) -> bytes:
    """Some bytes of a file, or of an address that serves ranges; a negative start counts from the
    end."""
    if path.startswith(("http://", "https://")):
        asked = f"bytes={first}-{first + size - 1}" if first >= 0 else f"bytes={first}"
        with urllib.request.urlopen(urllib.request.Request(path, headers={"Range": asked})) as r:
            if r.status != 206:
                raise ValueError(f"{path} serves no ranges")
            return r.read()
    with open(path, "rb") as f:
        f.seek(max(first, -os.path.getsize(path)) if first < 0 else first, 2 if first < 0 else 0)
        return f.read(size)


def members_of(path: str, read=ranged) -> list[ZipMember]:
    """The central directory, found from the archive's end; only the directory is read."""
    tail = read(path, -65_557, 65_557)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError(f"{path} is no ZIP archive")
    count, length, start = _struct.unpack("<HII", tail[at + 10 : at + 20])
    directory, out, p = read(path, start, length), [], 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError(f"{path} has a broken directory")
        method, = _struct.unpack("<H", directory[p + 10 : p + 12])
        packed, _, n, extra, comment = _struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        offset, = _struct.unpack("<I", directory[p + 42 : p + 46])
        out.append(ZipMember(path, directory[p + 46 : p + 46 + n].decode(), offset, packed, method))
        p += 46 + n + extra + comment
    return out


def extract(m: ZipMember, read=ranged) -> bytes:
    n, extra = _struct.unpack("<HH", read(m.path, m.offset + 26, 4))
    data = read(m.path, m.offset + 30 + n + extra, m.size) if m.size else b""
    if m.method == 0:
        return data
    if m.method == 8:
        return zlib.decompress(data, -15)
    raise ValueError(f"{m.name}: compression {m.method} is not supported")
