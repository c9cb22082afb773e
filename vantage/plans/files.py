"""Queries that write files and scan them again: every source and sink on rows of the tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import readers, scratch, writers
from .views import table, view, with_views


def _text_file(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.text(path)


def _binary_files(spark: SparkSession, rows: DataFrame, name: str, content: str) -> str:
    """One file for each row, written where the row is: (name, content) -> the folder."""
    path = scratch.folder(spark)
    writers.write_files(rows, name, content, path)
    return path


def kml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as placemarks and scanned again: vertices and the sums of their azimuths and heights by name."""
    l = view(spark, sf_dir, "lines").groupBy("line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "az", "el", "km"))), lambda x: F.struct(x["az"].alias("lon"), x["el"].alias("lat"), x["km"].alias("z"))).alias("points"))
    path = scratch.folder(spark)
    writers.write_kml(l.select(F.concat(F.lit("a <line> & "), F.col("line_id").cast("string")).alias("name"), "points"), path)
    back = readers.read_kml(spark, path)
    total = lambda f: F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p[f]), 3)
    return back.select("name", F.size("points").cast("long").alias("vertices"), total("lon").alias("az"), total("z").alias("km"))


def geojson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road features of one or two parts from a GeoJSON document: vertices and the last coordinate of each part."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    point = lambda j: F.concat(F.lit("["), (F.col("n_nationkey") + j * 0.5).cast("string"), F.lit(","), (F.col("n_nationkey") * 2 - j).cast("double").cast("string"), F.lit("]"))
    line = lambda k: F.concat(F.lit("["), F.concat_ws(",", *[point(j) for j in range(k)]), F.lit("]"))
    many = F.col("n_nationkey") % 2 == 1
    geometry = F.when(many, F.concat(F.lit('{"type":"MultiLineString","coordinates":['), line(2), F.lit(","), line(3), F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"LineString","coordinates":'), line(4), F.lit("}")))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"name":"'), "n_name", F.lit('"},"geometry":'), geometry, F.lit("}"))
    path = scratch.folder(spark)
    _text_file(n.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", feature.alias("f")))), lambda x: x["f"]), ","), F.lit("]}")).alias("value")), path)
    out = readers.read_geojson_lines(spark, path)
    return out.select(F.col("properties")["name"].alias("name"), "part", F.size("points").cast("long").alias("vertices"), F.round(F.element_at("points", -1)[0], 6).alias("last_x"))


def positional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as positional JSON rows with some bad values, and read by a list of fields."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")).alias("balance"))
    rows = writers.positional_json(s, ["s_suppkey", "s_name", "balance"], ["s_suppkey"])
    path = scratch.folder(spark)
    rows.select(F.col("row").alias("value")).write.text(path)
    back = spark.read.text(path).select(F.explode(readers.positional(F.concat(F.lit("["), "value", F.lit("]")), ["id", "name", "balance"], ["bigint", "string", "double"])).alias("x"))
    return back.select("x.id", "x.name", F.round("x.balance", 2).alias("balance"))


def csv_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a quoted CSV of which rows without numeric coordinates are left out; names with quotes and commas survive."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('The "'), "c_mktsegment", F.lit('", no. '), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise((F.col("c_custkey") * 0.5).cast("string")).alias("lat"), F.when(F.col("c_custkey") % 9 != 0, (F.col("c_custkey") * 0.25).cast("string")).alias("lon"))
    path = scratch.folder(spark)
    writers.write_log_csv(c, path)
    back = readers.read_csv_points(spark, path, "lat", "lon")
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "name", "lat", "lon")


def pack_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of length-prefixed packs, one for each nation, the last entry of some cut off."""
    p = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name")

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        out = b"".join(struct.pack("<II", len(n.encode()), 4) + n.encode() + struct.pack("<I", k) for k, n in sorted(zip(f["s_suppkey"], f["s_name"], strict=True)))
        nation = int(f["s_nationkey"].iloc[0])
        return pd.DataFrame({"name": [f"pack-{nation}.bin"], "content": [out[:-2] if nation % 3 == 0 else out]})

    path = _binary_files(spark, p.groupBy("s_nationkey").applyInPandas(pack, "name string, content binary"), "name", "content")
    back = readers.read_packs(spark, path)
    total = sum((F.conv(F.hex(F.substring("payload", i + 1, 1)), 16, 10).cast("long") * 256**i for i in range(4)), F.lit(0).cast("long"))
    return back.select("name", total.alias("value"))


def image_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of image files by their first bytes."""
    heads = ["FFD8FFE000104A46494600", "89504E470D0A1A0A0000000D", "524946460000000057454250", "00000018667479706865696300", "49492A0008000000", "4D4D002A00000008", "474946383961"]
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in heads]), (F.col("n_nationkey") % len(heads) + 1).cast("int"))
    path = _binary_files(spark, table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".img")).alias("name"), head.alias("content")), "name", "content")
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", "([A-Z0-9_]+)[.]img$", 1).alias("name"), readers.image_format(F.col("content")).alias("format"))


def geotiff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster as a GeoTIFF of three bands for each block of columns, scanned again block by block: cells with data and their sum, by file."""
    r = view(spark, sf_dir, "raster").select(F.floor(F.col("c") / 20).alias("tile"), "r", "c", "z", (F.col("z") / 2).alias("half"), F.when(F.col("z") > 950, 1.0).otherwise(0.0).alias("high"))
    files = writers.geotiff(r, "tile", 0.01, -0.01, ["z", "half", "high"])
    path = _binary_files(spark, files.select(F.concat(F.lit("tile-"), F.col("tile").cast("string"), F.lit(".tif")).alias("name"), "file"), "name", "file")
    cells = readers.raster_cells(readers.read_raster_blocks(spark, path, size=16))
    return cells.groupBy("name").agg(F.count("z").alias("cells"), F.round(F.sum("z"), 1).alias("total"), F.round(F.max("z"), 2).alias("top"))


def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of the rasters: only blocks that meet its bounds are made, with rows and columns of the whole raster."""
    r = view(spark, sf_dir, "raster").select(F.lit(0).alias("tile"), "r", "c", "z")
    path = _binary_files(spark, writers.geotiff(r, "tile", 0.01, -0.01, ["z"]).select(F.lit("all.tif").alias("name"), "file"), "name", "file")
    cells = readers.raster_cells(readers.read_raster_blocks(spark, path, (0.0, -0.30001, 0.01999, -0.1), size=8))
    return cells.select("r", "c", F.round("z", 1).alias("z"))


def point_cloud_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of LAS files, read in chunks: noise and withheld ones left out, counted by class with their highest."""
    l = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")

    def las(f: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(f["s_suppkey"])
        head = bytearray(227)
        head[:4], head[24:26] = b"LASF", b"\x01\x02"
        struct.pack_into("<H", head, 94, 227)
        struct.pack_into("<IIBH", head, 96, 227, 0, 0, 20)
        struct.pack_into("<I", head, 107, len(keys))
        struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
        points = b"".join(struct.pack("<iiiHBBbBH", k, 2 * k, 10 * k, 0, 0, k % 8 | (128 if k % 13 == 0 else 0), 0, 0, 0) for k in keys)
        return pd.DataFrame({"name": [f"cloud-{f['s_nationkey'].iloc[0]}.las"], "content": [bytes(head) + points]})

    path = _binary_files(spark, l.groupBy("s_nationkey").applyInPandas(las, "name string, content binary"), "name", "content")
    p = readers.read_point_cloud(spark, path, chunk=3).where("NOT withheld AND cls <> 7")
    return p.groupBy("cls").agg(F.count("*").alias("n"), F.round(F.max("z"), 2).alias("top"), F.round(F.sum("x"), 2).alias("east"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as compact JSON arrays in the order of fields."""
    s = view(spark, sf_dir, "sources").select("source_id", "kind", F.when(F.col("source_id") % 4 != 0, F.col("nation")).alias("nation"))
    return s.select(writers.json_row(["source_id", "kind", "nation"]).alias("row"))


def mesh_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the raster in decimetres above 890, as 16-bit numbers."""
    return view(spark, sf_dir, "raster").select("r", "c", writers.quantised(F.col("z"), 890.0).cast("long").alias("dm"))


def precache_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variant of each picture for phones, and a version from all their names."""
    p = table(spark, sf_dir, "part").where("p_partkey < 400").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), ((F.col("p_size") + 3) * 100).cast("string"), F.lit(".jpg")).alias("file")).distinct()
    kept = readers.precache(p, 1600).select("file")
    version = kept.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("file")), ","), 256), 1, 12).alias("version"))
    return kept.crossJoin(F.broadcast(version))


def sighting_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON and as lines of text, empty fields left out of both."""
    s = view(spark, sf_dir, "sources").select(F.col("source_id").cast("string").alias("id"), F.when(F.col("source_id") % 2 == 0, F.col("kind")).alias("kind"), F.when(F.col("source_id") % 3 == 0, F.lit("")).otherwise(F.col("nation").cast("string")).alias("nation"))
    return s.select("id", writers.report_json(["id", "kind", "nation"]).alias("json"), writers.report_text(["id", "kind", "nation"]).alias("text"))


def columnar_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table stored in columns with its kind as folders, and read again by one of them: only its folder is scanned."""
    path = scratch.folder(spark)
    view(spark, sf_dir, "sources").write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).where("kind = 'tower'").select("source_id", "nation", F.round("km", 6).alias("km"))


def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from a template whose marks must stand there once each."""
    page = writers.template("<h1>{{title}}</h1><p>{{text}}</p>", {"{{title}}": "%1$s", "{{text}}": "%2$s has %3$d letters"})
    return table(spark, sf_dir, "nation").select(F.format_string(page, writers.xml_escape(F.col("n_name")), "n_name", F.length("n_name")).alias("page"))


def axis_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles from the labels of a beam table's axes: left and down negative, H and V zero."""
    labels = F.concat(F.when(F.col("p_size") > 0, (F.col("p_size") / 2).cast("string")).otherwise(""), F.element_at(F.array(*[F.lit(x) for x in ("L", "R", "U", "D")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    label = F.when(F.col("p_partkey") % 9 == 0, "H").when(F.col("p_partkey") % 9 == 1, "V").otherwise(labels)
    return table(spark, sf_dir, "part").select("p_partkey", geo.axis_angle(label).alias("angle"))


QUERIES = {
    f.__name__: f
    for f in (
        kml_round_trip, geojson_scan, positional_rows, csv_tolerant, pack_scan, image_formats, geotiff_round_trip, raster_window, point_cloud_chunks, json_rows, mesh_heights, precache_list, sighting_reports, columnar_archive,
        page_templates, axis_angles,
    )
}
ORACLES = {
    "kml_round_trip": "SELECT 'a <line> & ' || line_id AS name, count(*) AS vertices, round(sum(round(az, 6)), 3) AS az, round(sum(round(km, 1)), 3) AS km FROM v_lines GROUP BY line_id",
    "geojson_scan": "WITH f AS (SELECT n_nationkey, n_name, unnest(CASE WHEN n_nationkey % 2 = 1 THEN [2, 3] ELSE [4] END) AS k, unnest(CASE WHEN n_nationkey % 2 = 1 THEN [0, 1] ELSE [0] END) AS part FROM nation) SELECT n_name AS name, part, k::BIGINT AS vertices, round(n_nationkey + (k - 1) * 5e-1, 6) AS last_x FROM f",
    "positional_rows": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN round(s_acctbal, 2) END AS balance FROM supplier",
    "csv_tolerant": "SELECT c_custkey, 'The \"' || c_mktsegment || '\", no. ' || c_custkey AS name, c_custkey * 5e-1 AS lat, c_custkey * 25e-2 AS lon FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 9 <> 0",
    "pack_scan": "SELECT s_name AS name, s_suppkey AS value FROM supplier QUALIFY s_nationkey % 3 <> 0 OR row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) > 1",
    "image_formats": "SELECT n_name AS name, ['jpeg', 'png', 'webp', 'heic', 'tiff', 'tiff', NULL][n_nationkey % 7 + 1] AS format FROM nation",
    "geotiff_round_trip": "SELECT 'tile-' || c // 20 || '.tif' AS name, count(z) AS cells, round(sum(z::FLOAT::DOUBLE), 1) AS total, round(max(z::FLOAT::DOUBLE), 2) AS top FROM v_raster GROUP BY c // 20",
    "raster_window": "SELECT r, c, round(z, 1) AS z FROM v_raster WHERE r BETWEEN 10 AND 30 AND c BETWEEN 0 AND 1",
    "point_cloud_chunks": "SELECT (s_suppkey % 8)::INT AS cls, count(*) AS n, round(max(s_suppkey * 1e-1), 2) AS top, round(sum(s_suppkey * 1e-2 + 100), 2) AS east FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 8 <> 7 GROUP BY 1",
    "json_rows": "SELECT '[' || source_id || ',\"' || kind || '\",' || CASE WHEN source_id % 4 <> 0 THEN nation::VARCHAR ELSE 'null' END || ']' AS row FROM v_sources",
    "mesh_heights": "SELECT r, c, least(greatest(coalesce(round_even((z - 890) * 10, 0), 0), 0), 65535)::BIGINT AS dm FROM v_raster",
    "precache_list": "WITH p AS (SELECT DISTINCT replace(p_name, ' ', '_') AS stem, (p_size + 3) * 100 AS w FROM part WHERE p_partkey < 400), k AS (SELECT stem || '-' || w || '.jpg' AS file FROM p QUALIFY row_number() OVER (PARTITION BY stem ORDER BY w > 1600, CASE WHEN w <= 1600 THEN -w ELSE w END) = 1) SELECT file, substr(sha256((SELECT string_agg(file, ',' ORDER BY file) FROM k)), 1, 12) AS version FROM k",
    "sighting_reports": "WITH s AS (SELECT source_id::VARCHAR AS id, CASE WHEN source_id % 2 = 0 THEN kind END AS kind, CASE WHEN source_id % 3 = 0 THEN '' ELSE nation::VARCHAR END AS nation FROM v_sources) SELECT id, '{\"schema\":\"sighting/1\",\"id\":\"' || id || '\"' || CASE WHEN kind IS NULL THEN '' ELSE ',\"kind\":\"' || kind || '\"' END || ',\"nation\":\"' || nation || '\"}' AS json, 'id: ' || id || CASE WHEN kind IS NULL THEN '' ELSE chr(10) || 'kind: ' || kind END || CASE WHEN nation = '' THEN '' ELSE chr(10) || 'nation: ' || nation END AS text FROM s",
    "columnar_archive": "SELECT source_id, nation, round(km, 6) AS km FROM v_sources WHERE kind = 'tower'",
    "page_templates": "SELECT '<h1>' || n_name || '</h1><p>' || n_name || ' has ' || length(n_name) || ' letters</p>' AS page FROM nation",
    "axis_angles": "SELECT p_partkey, CASE WHEN p_partkey % 9 IN (0, 1) THEN 0e0 WHEN p_partkey % 4 IN (0, 3) THEN -p_size / 2e0 ELSE p_size / 2e0 END + 0e0 AS angle FROM part",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
