"""Written cut points, splits and column helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


#: tables of ``written`` that were not removed
_kept: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vantage-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, **measures: Column) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends here and a lost executor costs nothing that was done.

    ``measures``: aggregates of its rows, taken as they are written, so that no query of its own counts them; see ``measured``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vantage/{uuid.uuid4().hex}"
    _kept.append(path)
    seen = Observation() if measures else None
    (df.observe(seen, *(c.alias(name) for name, c in measures.items())) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vantage_path, out._vantage_measures = path, seen.get if seen else {}
    return out


def measured(df: DataFrame, name: str) -> int:
    """A measure that ``written`` took of its table; 0 where it had no rows."""
    return df._vantage_measures[name] or 0


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _kept:
        _kept.remove(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table of ``written`` that nothing will read again."""
    path = getattr(df, "_vantage_path", None)
    if path:
        _remove(df.sparkSession, path)


def written_so_far() -> frozenset[str]:
    return frozenset(_kept)


def clear_written(spark: SparkSession, since: frozenset[str], *keep: DataFrame) -> None:
    """Removes all tables that ``written`` made after ``since`` but those given: for a caller that has stored an operator's result."""
    wanted = since | {getattr(df, "_vantage_path", None) for df in keep}
    for path in [p for p in _kept if p not in wanted]:
        _remove(spark, path)


def row_name(columns: list[str]) -> str:
    """A column name that ``columns`` lack."""
    name = "_row"
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a unique number for each row, and that column's name."""
    name = row_name(docs.columns)
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at most go to Python: long texts must not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
