"""MinHash near-duplicate detection by a multi-index Hamming join.

A document's set holds its distinct k-word shingles.  Its signature has ``SYMBOLS`` symbols of 16 bits, one for each MinHash
function; two documents of similarity J differ in a symbol with probability 1 - J.  The signature is split into ``CHUNKS``
chunks.  If two signatures differ in fewer than ``2 * CHUNKS`` symbols, then, by the pigeonhole principle, some chunk has one
error at most; so every chunk is indexed once for each symbol that may be wrong (left out), and *all* pairs within distance
``2 * CHUNKS - 1`` meet in some bucket.  For pairs at J = 0.8, where 9.6 of 48 symbols differ on average, the chance of more than
23 differing symbols is below 1e-5.

Rows have keys of their own, so ids may repeat.  Rows of equal word sequences form one class beforehand and only a class's first row
takes part, so groups of exact copies cost one row each.  Links are found on the full sets, never on signatures alone:

1. Each document of a bucket is compared with the bucket's centre; the centre's set travels once for every ``STAR`` documents.
2. Where a bucket then still holds several components, its documents are compared with each other in one task: pairs of different
   components, near by signature, by their sets.  A link joins two components at once, so a bucket gives fewer links than it has
   components; documents that are near but below the limit give no row at all.  Buckets of the same members count once, of the
   buckets that two documents share only the first compares them, and a large bucket is dealt into blocks by rows and by set size.

Components come from minimum labels with pointer jumping on tables in the shared folder; nothing is gathered on the driver.  Each query
adds to the driver's memory, so what decides on the next step (numbers of rows, largest keys, whether a label changed) is measured as a
table is written, and what holds for all rounds once.  Where a table with one row for each key meets rows of which a key may hold a large
part, the keys of more than a ``HOT_SHARE``-th of all rows (so fewer than ``HOT_SHARE`` keys) are broadcast and the others shuffled.

Defined results: a null or empty text, or one without words, has an empty set and stays alone; a text of fewer than ``k`` words has
one shingle, its whole sequence; very long texts are taken whole; rows that repeat an id are rows of their own, those that repeat a
text too fall into one class; a row without id takes part, comes after all others, and is kept if its component has no id and it is
its first row; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import clear_written, drop_written, measured, written, written_so_far
from .textkernel import distinct_per_row, mix, sequence_keys, shingles, slices, words

SYMBOLS, CHUNKS = 48, 12
DISTANCE = 2 * CHUNKS - 1
STAR, HOT_SHARE = 64, 1000
_WIDTH, _BLOCK, _GROUP, _GROUP_SHINGLES = SYMBOLS // CHUNKS, 1024, 8192, 1 << 22
_LAST = (1 << 63) - 1
_rng = np.random.default_rng(48)
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def _signatures(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((rows, SYMBOLS), np.uint16)
    count = np.bincount(row, minlength=rows)
    some = np.flatnonzero(count)
    if len(some):
        first = np.concatenate([[0], np.cumsum(count[some])])[:-1]
        for j in range(SYMBOLS):
            low = np.minimum.reduceat(mix(h ^ _B[j]) if j % 8 == 0 else h * _A[j] + _B[j], first)
            out[some, j] = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _described(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(2)):
                w = words(data, off)
                h, row = shingles(w, k)
                _, _, n = distinct_per_row(h, row, hi - lo)
                a, b = sequence_keys(w)
                sig = _signatures(h, row, hi - lo)
                offsets = np.arange(hi - lo + 1, dtype=np.int32) * (2 * SYMBOLS)
                binary = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), binary],
                    ["row_key", "doc_id", "n_shingles", "k1", "k2", "sig"],
                )

    return run


def _sets(k: int):
    """(rep, set): the distinct shingle hashes of each row, in order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                h, _, n = distinct_per_row(*shingles(words(data, off), k), hi - lo)
                offsets = np.concatenate([[0], np.cumsum(8 * n)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), binary], ["rep", "set"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk and each of its symbols that may be wrong."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        raw = batch.column(1)
        for lo in range(0, len(ids), 4096):
            own = ids[lo : lo + 4096]
            sig = np.frombuffer(b"".join(raw.slice(lo, len(own)).to_pylist()), np.uint16).reshape(-1, CHUNKS, _WIDTH).astype(np.int64)
            keys = []
            for wrong in range(_WIDTH):
                a, b, c = (sig[:, :, j] for j in range(_WIDTH) if j != wrong)
                keys.append(((np.arange(CHUNKS) * _WIDTH + wrong) << 48) | (a << 32) | (b << 16) | c)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys, 1).ravel()), pa.array(np.repeat(own, SYMBOLS))], ["bucket", "rep"])


@F.arrow_udf(T.IntegerType())
def _distance(x: pa.Array, y: pa.Array) -> pa.Array:
    a, b = (np.frombuffer(b"".join(z.to_pylist()), np.uint16).reshape(-1, SYMBOLS) for z in (x, y))
    return pa.array((a != b).sum(1).astype(np.int32))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common set of two sorted sets, neither empty."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = _common(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int, most: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``size`` the number of ``left``'s rows with it: ``most`` at most, of ``total``."""
    if most * HOT_SHARE <= total:
        return left.join(right.drop(size), on)
    hot = right.where(F.col(size) * HOT_SHARE > total)
    frequent = left.join(F.broadcast(hot.drop(size)), on)
    others = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(size) * HOT_SHARE <= total).drop(size), on)
    return frequent.unionByName(others)


def components(edges: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(node, label) of all ends of ``edges`` (a, b): the smallest label of a node that can be reached.

    A node's own label is {its rank in ``first`` (node, rank), or itself; itself}.  Nodes must not be null.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), rows=F.count("*"))
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    ranked = nodes.join(first, "node") if first is not None else nodes.withColumn("rank", F.col("node"))
    labels = written(ranked.select("node", "degree", F.struct("rank", "node").alias("label")), rows=F.count("*"), most=F.max("degree"))
    total, count, most = measured(both, "rows"), measured(labels, "rows"), measured(labels, "most")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("b"), "label", "degree"), ["b"], "degree", total, most).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        less = written(labels.join(near, "node").select("node", "degree", F.col("label").alias("old"), F.least("label", "other").alias("label")))
        heads = less.groupBy(F.col("label.node").alias("head")).agg(F.count("*").alias("n"))
        jump = written(heads.join(labels.select(F.col("node").alias("head"), F.col("label").alias("next")), "head"), most=F.max("n"))
        jumped = spread_join(less.withColumn("head", F.col("label.node")), jump, ["head"], "n", count, measured(jump, "most"))
        now = written(jumped.select("node", "degree", F.least("label", "next").alias("label"), "old"), changed=F.count(F.when(F.expr("label < old"), 1)))
        for table in (labels, less, jump):
            drop_written(table)
        labels = now
        if not measured(now, "changed"):
            drop_written(both)
            return now.select("node", "label")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row_key, doc_id, n_shingles, component_id (smallest id reachable over links), kept, first.

    ``kept``: whether the row has its component's id; ``first``: whether it is the one row that stands for its component.  ``row_col``:
    a column of unique numbers, for a table that has one and gives the same at each reading; else rows are numbered.
    """
    before = written_so_far()
    row_key = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    texts = docs.select(row_key.alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts if row_col else written(texts)
    described = written(texts.mapInArrow(_described(k), "row_key long, doc_id long, n_shingles long, k1 long, k2 long, sig binary"), rows=F.count("*"))
    head = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), F.col("row_key").alias("rep")))
    reps = described.where("n_shingles > 0").groupBy("k1", "k2").agg(head.alias("head"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    reps = written(reps.select("k1", "k2", "head.rank", "head.rep", "sig", "n", "rows"), rows=F.count("*"))
    keys = written(_shared_buckets(reps))
    wanted = keys.select(F.col("rep").alias("row_key")).distinct()
    sets = written(texts.select("row_key", "text").join(wanted.hint("shuffle_hash"), "row_key", "left_semi").mapInArrow(_sets(k), "rep long, set binary"))
    if not row_col:
        drop_written(texts)
    ranks = reps.select(F.col("rep").alias("node"), "rank")
    edges = written(_star_links(_within(_stars(keys), reps), sets, percent))
    labels = components(edges, ranks)
    mixed = written(_mixed(keys, reps, labels), rows=F.count("*"))
    if measured(mixed, "rows"):
        more = written(_crossed(mixed, reps, sets, percent), rows=F.count("*"))
        if measured(more, "rows"):
            labels = components(edges.unionByName(more), ranks)
    classes = written(reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "rows", F.coalesce("label", F.struct("rank", F.col("rep").alias("node"))).alias("label")), most=F.max("rows"))
    clear_written(docs.sparkSession, before, described, classes)
    rows = described.select("row_key", "doc_id", "n_shingles", "k1", "k2")
    joined = spread_join(rows.where("n_shingles > 0"), classes, ["k1", "k2"], "rows", measured(described, "rows"), measured(classes, "most")).drop("k1", "k2")
    alone = rows.where("n_shingles = 0").drop("k1", "k2").withColumn("label", F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), F.col("row_key").alias("node")))
    out = joined.unionByName(alone)
    component, first = F.when(F.col("label.rank") < _LAST, F.col("label.rank")), F.col("row_key") == F.col("label.node")
    out = out.select("row_key", "doc_id", "n_shingles", component.alias("component_id"), first.alias("first"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first"))).select("row_key", "doc_id", "n_shingles", "component_id", "kept", "first")


def _shared_buckets(reps: DataFrame) -> DataFrame:
    """(bucket, rep, centre) of buckets that hold two classes or more."""
    keys = reps.select("rep", "sig").mapInArrow(_buckets, "bucket long, rep long")
    shared = written(keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("centre")).where("n > 1"), most=F.max("n"))
    return spread_join(keys, shared, ["bucket"], "n", SYMBOLS * measured(reps, "rows"), measured(shared, "most"))


def _stars(keys: DataFrame) -> DataFrame:
    """Each document with the smallest of its bucket."""
    return keys.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()


def _within(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of a signature distance up to the limit, with the number of pairs of ``a``."""
    pairs = written(pairs, rows=F.count("*"))
    degree = pairs.groupBy("a").agg(F.count("*").alias("n"))
    sig = reps.select("rep", "sig")
    centres = written(degree.join(sig.toDF("a", "sa"), "a").withColumn("stars", F.col("n")), most=F.max("n"))
    both = spread_join(pairs, centres, ["a"], "stars", measured(pairs, "rows"), measured(centres, "most")).join(sig.toDF("b", "sb"), "b").withColumn("apart", _distance("sa", "sb"))
    return written(both.where(F.col("apart") <= DISTANCE).select("a", "b", "n"))


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b, n): each centre's set goes to a group for every ``STAR`` of its n pairs, and is compared there."""
    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).alias("part"), "b")
    centres = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("rep", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")
    others = dealt.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "part", "b", "set")
    rows = centres.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, part, b, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = np.frombuffer(own, np.uint64)
                if b is None:
                    group, centre = (a, part), own
                elif group == (a, part) and _similar(centre, own, percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _mixed(keys: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, rep, comp, blocks) of buckets that hold more than one component, of those with the same members the first; blocks: how many it is dealt into."""
    state = reps.select("rep", "n").join(labels.select(F.col("node").alias("rep"), F.col("label.node").alias("comp")), "rep", "left").select("rep", "n", F.coalesce("comp", "rep").alias("comp"))
    own = written(keys.select("bucket", "rep").join(state, "rep"), rows=F.count("*"))
    blocks = F.greatest(F.ceil(F.count("*") / _GROUP), F.ceil(F.sum("n") / _GROUP_SHINGLES))
    members = [F.bit_xor(F.xxhash64("rep")).alias("m1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("m2"), F.count("*").alias("size")]
    found = own.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), blocks.alias("blocks"), *members).where("low < high")
    once = written(found.groupBy("m1", "m2", "size").agg(F.min("bucket").alias("bucket"), F.first("blocks").alias("blocks")).select("bucket", "blocks", "size"), most=F.max("size"))
    return spread_join(own, once, ["bucket"], "size", measured(own, "rows"), measured(once, "most")).select("bucket", "rep", "comp", "blocks")


def _crossed(mixed: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between a bucket's documents of different components, enough to join all that links join.

    A bucket of many documents is dealt into blocks, and each pair of blocks is a group of its own, so no task holds a whole bucket.
    """
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    dealt = mixed.select("bucket", "rep", "comp", block.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    group = F.when((F.col("own") == 0) & (F.col("other") == 0), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    slot = F.shiftright("bucket", 48).cast("int")
    both = reps.select("rep", "sig").join(sets, "rep")
    rows = dealt.select(group.alias("group"), "rep", "comp", side.alias("side"), slot.alias("slot")).join(both, "rep").select("group", "rep", "comp", "side", "slot", "sig", "set")
    return rows.repartition("group").sortWithinPartitions("group", "comp").mapInArrow(_met(percent), "a long, b long").distinct()


def _near_in_group(comp: np.ndarray, side: np.ndarray, slot: int, sig: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of near rows of different components, nearest first in a block; rows are sorted by component, and the largest is not compared with itself.

    Of the buckets that two documents share, only the first gives the pair; of blocks, those of different sides (-1: all).
    ``label`` tells which rows are joined by now.
    """
    chunk, wrong = divmod(slot, _WIDTH)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(comp)) + 1, [len(comp)]])
    large = int(np.argmax(np.diff(cuts)))
    rest = np.concatenate([np.arange(cuts[large]), np.arange(cuts[large + 1], len(comp))])
    order = np.concatenate([rest, np.arange(cuts[large], cuts[large + 1])])
    for x in range(0, len(rest), _BLOCK):
        for y in range(x, len(comp), _BLOCK):
            i, j = rest[x : x + _BLOCK], order[y : y + _BLOCK]
            if (label[i] == label[i[0]]).all() and (label[j] == label[i[0]]).all():
                continue
            apart = np.zeros((len(i), len(j)), np.uint8)
            for c in range(SYMBOLS):
                apart += sig[i, c][:, None] != sig[j, c][None, :]
            p, q = np.nonzero((apart <= DISTANCE) & (label[i][:, None] != label[j][None, :]))
            nearest = np.argsort(apart[p, q], kind="stable")
            p, q = p[nearest], q[nearest]
            for at in range(0, len(p), 1 << 14):
                u, v = i[p[at : at + (1 << 14)]], j[q[at : at + (1 << 14)]]
                errors = (sig[u] != sig[v]).reshape(-1, CHUNKS, _WIDTH).sum(2)
                here = ~(errors[:, :chunk] < 2).any(1) & ((errors[:, chunk] == 1) | (wrong == 0)) & ((side[u] < 0) | (side[u] != side[v]))
                yield u[here], v[here]


def _met_in_group(rep: np.ndarray, comp: np.ndarray, side: np.ndarray, slot: int, sig: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    label, out = comp.copy(), []
    for u, v in _near_in_group(comp, side, slot, sig, label):
        for at in range(0, len(u), 256):
            apart = np.flatnonzero(label[u[at : at + 256]] != label[v[at : at + 256]]) + at
            for x, y in zip(u[apart].tolist(), v[apart].tolist(), strict=True):
                if label[x] != label[y] and _similar(sets[x], sets[y], percent):
                    out.append((int(rep[x]), int(rep[y])))
                    label[label == label[y]] = label[x]
    return out


def _met(percent: int):
    """Links of rows (group, rep, comp, side, slot, sig, set), sorted by group and component."""

    def compared(rows: pa.Table) -> pa.RecordBatch:
        group, rep, comp, side, slot = (rows[c].to_numpy() for c in ("group", "rep", "comp", "side", "slot"))
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"].slice(lo, hi - lo)]
            out += _met_in_group(rep[lo:hi], comp[lo:hi], side[lo:hi], int(slot[lo]), sig[lo:hi], sets, percent)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0] != batch.column(0)[-1]:  # all groups but the last are whole
                rows = pa.Table.from_batches(held)
                last = int(np.flatnonzero(np.diff(rows["group"].to_numpy()))[-1]) + 1
                yield compared(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield compared(pa.Table.from_batches(held))

    return run
