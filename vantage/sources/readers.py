"""Scans: placemarks, road features, positional rows, tolerant CSV, length-prefixed packs, images by magic bytes, manifests."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import raster

MANIFEST = "file STRING, path STRING, url STRING, product STRING, crs STRING, bytes LONG, sha256 STRING, last_modified STRING, retrieved STRING"


def _unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, points ARRAY<STRUCT<lon, lat, z>>) of points and lines; of equal names the last in the file stays; a missing height is 0.

    A document is one row and its placemarks are found by pattern, so line breaks and attributes do not matter.
    """
    marks = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark\b.*?</Placemark>"), F.lit(0))).alias("n", "mark"))
    name = F.regexp_extract("mark", r"(?s)<name>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</name>", 1)
    text = F.regexp_extract("mark", r"(?s)<coordinates>(.*?)</coordinates>", 1)
    part = lambda c, i: F.coalesce(F.try_element_at(F.split(c, ","), F.lit(i)).try_cast("double"), F.lit(0.0) if i == 3 else F.lit(None))
    points = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda c: c != ""), lambda c: F.struct(part(c, 1).alias("lon"), part(c, 2).alias("lat"), part(c, 3).alias("z")))
    named = marks.select(_unescaped(name).alias("name"), points.alias("points"), "n").where((F.col("name") != "") & (F.size("points") > 0))
    return named.groupBy("name").agg(F.max_by("points", "n").alias("points"))


GEO = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(properties, fid, part, points ARRAY<ARRAY<DOUBLE>>): LineString and MultiLineString features, a row for each part."""
    f = spark.read.schema(GEO).option("multiLine", True).json(path).select(F.posexplode("features").alias("fid", "f"))
    line = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<DOUBLE>>")
    many = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    parts = F.when(F.col("f.geometry.type") == "LineString", F.array(line)).when(F.col("f.geometry.type") == "MultiLineString", many)
    return f.select("f.properties", "fid", F.posexplode(parts).alias("part", "points"))


def positional(json_text: Column, fields: list[str], types: list[str]) -> Column:
    """An array of rows, each a JSON array in the order of ``fields``, as an array of named structs; bad values become null."""
    rows = F.from_json(json_text, "ARRAY<ARRAY<STRING>>")
    return F.transform(rows, lambda r: F.struct(*[F.get(r, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(zip(fields, types, strict=True))]))


def read_csv_points(spark: SparkSession, path: str, lat: str, lon: str) -> DataFrame:
    """A CSV with header; rows whose coordinates are not numbers are left out."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.withColumns({lat: F.col(lat).try_cast("double"), lon: F.col(lon).try_cast("double")}).where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, payload) of files of entries: two little-endian 32-bit lengths, the name, the payload.  A cut-off entry ends its file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                at, out = 0, []
                while at + 8 <= len(data):
                    n, m = struct.unpack_from("<II", data, at)
                    if at + 8 + n + m > len(data):
                        break
                    out.append((path, data[at + 8 : at + 8 + n].decode("utf-8", "replace"), data[at + 8 + n : at + 8 + n + m]))
                    at += 8 + n + m
                yield pd.DataFrame(out, columns=["path", "name", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, payload binary")


def image_format(content: Column) -> Column:
    """Image format by magic bytes; null if none fits."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E47"), "png").when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp")
        .when(F.substring(head, 9, 8) == "66747970", "heic").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files under a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each file of either side with its status: ok, changed, missing or unlisted."""
    m = manifest.select("file", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha"))
    status = F.when(F.col("m_sha").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when((F.col("m_sha") == F.col("sha256")) & (F.col("m_bytes") == F.col("bytes")), "ok").otherwise("changed")
    return found.join(m, "file", "full").select("file", status.alias("status"))


def precache(files: DataFrame, size_cap: int) -> DataFrame:
    """One variant for each stem of <stem>-<width>.<ext>: the widest up to the cap, else the smallest."""
    stem = F.regexp_extract("file", r"^(.*?)(?:-(\d+))?\.\w+$", 1)
    width = F.coalesce(F.regexp_extract("file", r"-(\d+)\.\w+$", 1).try_cast("int"), F.lit(0))
    rows = files.withColumns({"stem": stem, "width": width})
    order = Window.partitionBy("stem").orderBy(F.col("width") > size_cap, F.when(F.col("width") <= size_cap, -F.col("width")).otherwise(F.col("width")), "file")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


TILE = "name string, west double, north double, dx double, dy double, row0 int, col0 int, rows int, cols int, z binary"


def read_raster_blocks(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, size: int = 512) -> DataFrame:
    """Blocks of the GeoTIFF files under a path (TILE; heights as 32-bit floats, nan for no data), those that meet ``bounds`` (west, south, east, north) only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                tile = raster.read_geotiff(bytes(data), file.rsplit("/", 1)[-1])
                part = tile.window(*bounds) if bounds else tile
                if part is None:
                    continue
                r0, c0 = round((part.north - tile.north) / tile.dy), round((part.west - tile.west) / tile.dx)
                rows, cols = part.z.shape
                for r in range(0, rows, size):
                    out = [(tile.name, tile.west, tile.north, tile.dx, tile.dy, r0 + r, c0 + c, *part.z[r : r + size, c : c + size].shape, part.z[r : r + size, c : c + size].astype("<f4").tobytes()) for c in range(0, cols, size)]
                    yield pd.DataFrame(out, columns=[f.split()[0] for f in TILE.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TILE)


def raster_cells(blocks: DataFrame) -> DataFrame:
    """(name, r, c, z) of all cells of blocks, null where there is no data."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                z = np.frombuffer(b.z, "<f4").astype(float)
                at = np.arange(len(z))
                yield pd.DataFrame({"name": b.name, "r": b.row0 + at // b.cols, "c": b.col0 + at % b.cols, "z": z})

    cells = blocks.mapInPandas(run, "name string, r long, c long, z double")
    return cells.withColumn("z", F.nanvl("z", F.lit(None)))


def read_point_cloud(spark: SparkSession, path: str, chunk: int = 5_000_000) -> DataFrame:
    """(file, x, y, z, cls, withheld) of the returns of uncompressed LAS files, ``chunk`` of them at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                first = 0
                while len((part := raster.read_las(bytes(data), first, chunk))["x"]):
                    yield pd.DataFrame({"file": file.rsplit("/", 1)[-1], **part})
                    first += chunk

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, x double, y double, z double, cls int, withheld boolean")


def mosaic(blocks: DataFrame, most_bytes: int = 256 << 20) -> raster.Mosaic:
    """The blocks as one mosaic, rasters in the order of their names, for a surface that all tasks get: an error beyond ``most_bytes``.

    Larger surfaces stay tables: their samples are joined with cells (``operators.joins.bilinear``).
    """
    size = blocks.agg(F.sum(F.length("z").cast("long"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the rasters have {size} bytes, more than {most_bytes}: join them as a table of cells")
    tiles = {}
    for name, own in blocks.toPandas().groupby("name", sort=True):
        first = own.iloc[0]
        r0, c0 = int(own["row0"].min()), int(own["col0"].min())
        z = np.full((int((own["row0"] + own["rows"]).max()) - r0, int((own["col0"] + own["cols"]).max()) - c0), np.nan)
        for b in own.itertuples():
            z[b.row0 - r0 : b.row0 - r0 + b.rows, b.col0 - c0 : b.col0 - c0 + b.cols] = np.frombuffer(b.z, "<f4").reshape(b.rows, b.cols)
        tiles[name] = raster.Tile(name, first["west"] + c0 * first["dx"], first["north"] + r0 * first["dy"], first["dx"], first["dy"], z)
    return raster.Mosaic(list(tiles.values()))
