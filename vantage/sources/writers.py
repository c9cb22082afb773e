"""Sinks: placemark text, positional JSON, quoted CSV logs, quantised heights, report text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import raster


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def kml_placemarks(rows: DataFrame, name: str, points: str, colour: str = "ff0000ff") -> DataFrame:
    """(value) One Placemark element for each row of a name and an array of (lon, lat, z)."""
    text = F.array_join(F.transform(points, lambda p: F.format_string("%.6f,%.6f,%.1f", p["lon"], p["lat"], p["z"])), " ")
    shape = F.when(F.size(points) == 1, F.concat(F.lit("<Point><coordinates>"), text, F.lit("</coordinates></Point>"))).otherwise(F.concat(F.lit("<LineString><coordinates>"), text, F.lit("</coordinates></LineString>")))
    head = F.concat(F.lit("<Placemark><name>"), xml_escape(F.col(name)), F.lit(f"</name><Style><LineStyle><color>{colour}</color></LineStyle></Style>"))
    return rows.select(F.concat(head, shape, F.lit("</Placemark>")).alias("value"))


def write_kml(rows: DataFrame, path: str, name: str = "name", points: str = "points") -> None:
    """A folder of text parts, each a complete document, so any part can be read alone: placemarks are lines, streamed between head and tail."""
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], ["value"])
        yield line(head)
        yield from batches
        yield line(tail)

    kml_placemarks(rows, name, points).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_log_csv(rows: DataFrame, path: str) -> None:
    """Everything quoted, quotes doubled, nulls empty."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def json_row(columns: list[str]) -> Column:
    """A row as a JSON array in the order of ``columns``, nulls kept."""
    cell = lambda c: F.coalesce(F.to_json(F.array(F.col(c))), F.lit("[null]"))
    inner = [F.substring(cell(c), F.lit(2), F.length(cell(c)) - 2) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *inner), F.lit("]"))


def positional_json(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(row) each row as a JSON array, in the stated order: sorted by ranges over many tasks, so written parts follow each other."""
    return rows.orderBy(*order).select(json_row(columns).alias("row"))


def geotiff(cells: DataFrame, key: str, dx: float, dy: float, bands: list[str]) -> DataFrame:
    """(key, file) A GeoTIFF of the ``bands`` of each tile's cells (key, r, c, bands): a tile must fit in a task.  Cells that are missing have no data."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(f["r"].min()), int(f["c"].min())
        grid = np.full((len(bands), int(f["r"].max()) - r0 + 1, int(f["c"].max()) - c0 + 1), np.nan)
        for i, b in enumerate(bands):
            grid[i, f["r"] - r0, f["c"] - c0] = f[b]
        return pd.DataFrame({key: [f[key].iloc[0]], "file": [raster.write_geotiff(c0 * dx, r0 * dy, dx, dy, grid)]})

    return cells.groupBy(key).applyInPandas(one, f"{key} {cells.schema[key].dataType.simpleString()}, file binary")


def template(page: str, values: dict[str, str]) -> str:
    """``page`` with each mark replaced by its value; a mark that does not stand there exactly once is an error."""
    for mark, value in values.items():
        if page.count(mark) != 1:
            raise ValueError(f"{mark!r} stands {page.count(mark)} times, not once")
        page = page.replace(mark, value)
    return page


def quantised(height: Column, z0: float) -> Column:
    """Decimetres above z0 as an integer of 16 bits; nulls and lower values are 0."""
    return F.least(F.greatest(F.coalesce(F.bround((height - z0) * 10, 0), F.lit(0.0)), F.lit(0.0)), F.lit(65535.0)).cast("int")


def report_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(F.lit("sighting/1").alias("schema"), *columns))


def report_text(columns: list[str]) -> Column:
    """Lines of name: value; empty fields are dropped."""
    lines = F.array(*[F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def write_files(rows: DataFrame, name: str, content: str, path: str) -> None:
    """One file for each row, in a folder that driver and executors mount."""
    target = path.removeprefix("file://").removeprefix("file:")
    if "://" in target:
        raise ValueError("single files are written to a folder that all executors mount")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for f in frames:
            os.makedirs(target, exist_ok=True)
            for n, data in zip(f[name], f[content], strict=True):
                with open(os.path.join(target, n), "wb") as out:
                    out.write(data)
            yield pd.DataFrame({"n": [len(f)]})

    rows.select(name, content).mapInPandas(run, "n long").agg(F.sum("n")).collect()
