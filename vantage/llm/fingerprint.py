"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is its words (runs of other characters than ASCII white space, cut after ``MAX_WORD`` characters).  Of the ``K``-word
windows, those are anchors whose smallest inner ``S``-word hash stands at an edge: a property of the window alone, so equal
passages give equal anchors wherever they stand.  All anchors of a text are kept, with the numbers of their first words; none is
left out, however long the text is.  The fingerprint lists them in text order, each as its distance from the one before (2 hexadecimal
digits, ``ff`` for more) and its hash (32 bits, 8 digits).

Likeness is the share of common anchor hashes among all of both texts.  Matching by position counts the anchors that both texts have
at the same place, and those that follow their forerunner at the same distance, so that a passage that moved as a whole still counts.

The edited text of a row ends with the beginning of the next row by descending (doc_id, text), the last being followed by the first.
Rows are dealt by ranges of doc_id, each with the last row before its range, so the text is shuffled once and no order is global.
Ranges are cut at ``QUANTILES`` quantiles of doc_id first and evenly between them, so outlying ids do not crowd the others; only one
row for each of ``MAX_RANGES`` ranges at most is broadcast.

Defined results: a null text is an empty text; a text without words has an empty fingerprint, and two empty ones are alike (1),
an empty and another not (0); a text of fewer than K words has one anchor, its whole word sequence; a row without doc_id has no
next row and counts it as empty; rows that repeat an id follow each other by text, those of equal id and text in any order; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, MAX_WORD, QUANTILES, MAX_RANGES, RANGE_ROWS = 6, 2, 32, 1024, 1 << 20, 4096
_NONE = "array<struct<at:int,hash:bigint>>"


def _inner(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the hashes of all S-word windows and of the whole word sequence."""
    hashes = F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{MAX_WORD}}}"), F.lit(0)), lambda x: F.xxhash64(x))
    df = df.withColumn(f"_{out}_w", hashes)
    w = F.col(f"_{out}_w")
    pairs = F.when(F.size(w) >= S, F.transform(F.sequence(F.lit(1), F.size(w) - (S - 1)), lambda i: F.xxhash64(*[F.get(w, i - 1 + j) for j in range(S)]))).otherwise(F.array().cast("array<bigint>"))
    whole = F.when((F.size(w) > 0) & (F.size(w) < K), F.xxhash64(w))
    return df.withColumns({f"_{out}_s": pairs, f"_{out}_one": whole}).drop(f"_{out}_w")


def _short(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: (at, hash) of each closed syncmer in text order, ``at`` the number of its first word from 1."""
    df = _inner(df, text, out)
    s, one = F.col(f"_{out}_s"), F.col(f"_{out}_one")
    last = K - S

    def anchor(i):
        edge = F.least(F.get(s, i - 1), F.get(s, i - 1 + last))
        closed = edge <= F.least(*[F.get(s, i - 1 + j) for j in range(1, last)])
        return F.when(closed, F.struct(i.alias("at"), _short(F.xxhash64(*[F.get(s, i - 1 + j) for j in range(0, last + 1, S)])).alias("hash")))

    found = F.filter(F.transform(F.sequence(F.lit(1), F.size(s) - last), anchor), lambda x: x.isNotNull())
    single = F.array(F.struct(F.lit(1).alias("at"), _short(one).alias("hash")))
    return df.withColumn(out, F.when(F.size(s) > last, found).when(one.isNotNull(), single).otherwise(F.array().cast(_NONE))).drop(f"_{out}_s", f"_{out}_one")


def hashes(anchors: Column) -> Column:
    return F.array_distinct(anchors["hash"])


def places(anchors: Column) -> Column:
    """One number for each anchor's hash and place."""
    return F.transform(anchors, lambda x: F.shiftleft(x["hash"], 31).bitwiseXOR(x["at"].cast("long")))


def steps(anchors: Column) -> Column:
    """One number for each anchor but the first, of its hash and its distance from the one before."""
    each = F.transform(F.sequence(F.lit(2), F.size(anchors)), lambda i: F.xxhash64(F.get(anchors, i - 1)["hash"], F.get(anchors, i - 1)["at"] - F.get(anchors, i - 2)["at"]))
    return F.when(F.size(anchors) > 1, each).otherwise(F.array().cast("array<bigint>"))


def share(a: Column, b: Column) -> Column:
    """Common elements of two arrays by all of both, 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def likeness(a: Column, b: Column) -> Column:
    """Of two anchor arrays."""
    return share(hashes(a), hashes(b))


def as_text(anchors: Column) -> Column:
    one = F.transform(anchors, lambda x, i: F.concat(F.lpad(F.lower(F.hex(F.least(F.lit(255), x["at"] - F.when(i > 0, F.get(anchors, i - 1)["at"]).otherwise(0)))), 2, "0"), F.lower(F.lpad(F.hex(x["hash"]), 8, "0"))))
    return F.array_join(one, "")


def _ranges(known: DataFrame) -> tuple[Column, int]:
    """The range of each doc_id as one number, growing with it, and the highest id; ranges hold about ``RANGE_ROWS`` rows where ids are even between quantiles."""
    high, count = known.agg(F.max("doc_id"), F.count("*")).first()
    if not count:
        return F.lit(0), 0
    cuts = max(1, min(QUANTILES, count // RANGE_ROWS))
    bounds = known.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts)], 20 * QUANTILES)).first()[0]
    bounds = sorted(set(bounds))
    pieces = max(1, min(MAX_RANGES, count // RANGE_ROWS) // len(bounds))
    widths = [max(1, -(-(after - low) // pieces)) for low, after in zip(bounds, [*bounds[1:], high + 1], strict=True)]
    at = F.greatest(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id"))), F.lit(1))
    low, width = (F.element_at(F.array(*[F.lit(x) for x in xs]), at).cast("long") for xs in (bounds, widths))
    inner = F.least(F.greatest(F.floor(F.col("doc_id").cast("decimal(20,0)") - low) / width, F.lit(0)), F.lit(pieces)).cast("long")
    return at * (pieces + 1) + inner, high


def _ring(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the next row's text by descending (doc_id, text)."""
    known = docs.where(F.col("doc_id").isNotNull())
    at, high = _ranges(known)
    ranged = known.withColumn("range", at)
    lasts = ranged.groupBy("range").agg(F.max("doc_id").alias("last"))
    before = F.coalesce(F.lag("last").over(Window.orderBy("range")), F.lit(high))
    borders = F.broadcast(lasts.select("range", before.alias("doc_id")))
    edge = known.join(borders, "doc_id").select("doc_id", "text", "range").withColumn("border", F.lit(True))
    order = Window.partitionBy("range").orderBy(F.desc("border"), "doc_id", "text")
    both = ranged.withColumn("border", F.lit(False)).unionByName(edge).withColumn("next_text", F.lag("text").over(order)).where("NOT border").drop("range", "border")
    return both.unionByName(docs.where(F.col("doc_id").isNull()).withColumn("next_text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row; then the shares of anchors that match by place and by distance."""
    ring = _ring(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    ring = with_anchors(with_anchors(ring.withColumn("edited", edited), "text", "own"), "next_text", "next")
    ring = with_anchors(ring, "edited", "changed")
    own, changed, after = F.col("own"), F.col("changed"), F.col("next")
    return ring.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, after).alias("near_next"),
        share(places(own), places(changed)).alias("same_place_edited"),
        share(steps(own), steps(after)).alias("same_steps_next"),
    )
