"""Training samples bounded by rows and by bytes: labelled rows chosen by a hash of their id."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written

MAX_BYTES = 48 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, where: Column | None = None) -> DataFrame:
    """(doc_id, label, text) of at most ``max_rows`` labelled documents, those with the lowest hash of doc_id.

    Repeated labels of one id count once, with the largest value; labels without a document and null labels are left out.  The
    sample's ids, and only they, are broadcast: their number is bounded by ``max_rows``.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")


def gathered(features: DataFrame, parts: list[str], max_bytes: int = MAX_BYTES) -> pa.Table:
    """The rows of ``features`` (doc_id and more; at most a sample's) on the driver, sorted by doc_id: those with the lowest hash of doc_id whose ``parts``, binary columns, have ``max_bytes`` in all."""
    features = written(features)
    place = F.xxhash64("doc_id")
    sizes = features.groupBy(place.alias("place")).agg(F.sum(sum((F.length(c) for c in parts), F.lit(0)).cast("long")).alias("size")).toArrow().sort_by("place")
    room, last = max_bytes, None
    for at, size in zip(sizes["place"].to_pylist(), sizes["size"].to_pylist(), strict=True):
        if size > room:
            break
        room, last = room - size, at
    table = features.where(place <= last if last is not None else F.lit(False)).toArrow().sort_by("doc_id")
    drop_written(features)
    return table
