"""Mixing sources to target weights by systematic sampling.

Sources share ``budget`` times all words by weight; a target stops at ``cap`` times its source's words and the excess goes to the
other sources by weight (water filling).  Every document of a source expects rate = target / source words copies.  Within a source,
documents stand in a fixed order: by size class, then by a hash of id and text.  The prefix sums of their expected copies plus one
random offset of the source tell how often each is taken: once for each integer that its step crosses, so floor(rate) or
ceil(rate) times.  Size classes in order make the sample follow the size distribution, so words come out near their target.

Prefix sums are counted in three levels (size class, slice of the hash, document), so a source that holds most rows is dealt over
many tasks; only tables of one row for each source and size class are summed in one window.

Defined results: null and empty texts have size 0 and are sampled like others; very long texts are counted whole; a source without
words has target 0; a null source is a source of its own, last in order; rows that repeat an id are rows of their own, in any order
if they tie; an empty table gives no rows; other columns, whatever their names, pass through ``emit`` and are ignored by ``mix``;
offsets come from ``seed`` and the source's name, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, written

WEIGHTS, BUDGET, CAP, SLICES = (3, 1, 2), 1.5, 2.0, 2


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; a null text has none."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(key, source_size, target) from (key, size); weights go round the sources in the keys' order.

    In the order of cap / weight, the capped sources are the first ones, as long as the level that would fill the rest still
    reaches a source's own cap; of the levels at the others, the first and largest holds for all of them.  All windows are over
    one row for each source.
    """
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * cap)
    before = Window.orderBy(F.col("ceiling") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("ceiling"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return sources.select("key", "source_size", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("weight") * common).alias("target"))


def _rows(docs: DataFrame, row: str) -> DataFrame:
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")))  # of the text too: rows without id, or of one id, are spread
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))  # null after all others
    rows = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), key.alias("key"), word_count(F.col("text")).alias("size"), digest.alias("digest"))
    size_class = F.expr("length(bin(size)) * 16 + shiftright(size, greatest(length(bin(size)) - 4, 0))")
    return rows.withColumns({"class": size_class, "slice": F.substring("digest", 1, SLICES), "place": F.substring("digest", SLICES + 1, 16)}).drop("digest")


def _copies(rows: DataFrame, weights, budget: float, cap: float, seed: int) -> DataFrame:
    """``rows`` with source_size, target and the number of copies."""
    cells = rows.groupBy("key", "class", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    classes = cells.groupBy("key", "class").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    in_source = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("key", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.select("key", "class", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("class_start"))
    begun = cells.select("key", "class", "slice", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("slice_start"))
    begun = begun.join(starts.join(source_targets(classes, weights, budget, cap), "key"), ["key", "class"])
    in_slice = Window.partitionBy("key", "class", "slice").orderBy("place", "id")
    placed = rows.withColumn("nth", F.row_number().over(in_slice)).join(begun, ["key", "class", "slice"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = placed.withColumns({"rate": rate, "offset": offset, "at": F.col("class_start") + F.col("slice_start") + F.col("nth")})
    crossed = F.floor(F.col("rate") * F.col("at") + F.col("offset")) - F.floor(F.col("rate") * (F.col("at") - 1) + F.col("offset"))
    return placed.select("row", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the document, repeats counted), copies of every row."""
    out = _copies(written(_rows(docs, "doc_id")), weights, budget, cap, seed)
    return out.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def emit(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = 1) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as it is taken.  Texts are counted once and move once, when taken rows are fetched."""
    keyed, row = numbered(docs)
    taken = _copies(written(_rows(keyed, row)), weights, budget, cap, seed).where("copies > 0")
    each = taken.select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(row)
    return keyed.join(each.hint("merge"), row).drop(row)
