"""Language-model scores from a probabilistic suffix tree over bytes, with unigram word scores beside them.

A text is its words, ASCII lower case, each followed by a space, and an end symbol.  All training texts are counted whole: each
word, and each byte with the ``DEPTH`` bytes before it (those of earlier texts apart).  A context of 1 to ``DEPTH`` bytes is kept if
its next-byte distribution diverges from that of the context one byte shorter by more than chance explains (a likelihood-ratio test
with a penalty of ``PENALTY`` * log(count) for each next byte seen).  All that pass stay, so the model grows with the text.

The probability of a byte starts from the smoothed byte frequencies; each kept suffix of what stands before it, from the shortest to
the longest, then mixes its own counts with the probability so far: (n + w * p) / (total + w), w = ``WEIGHT`` * kinds of next bytes.
So the longest kept suffix speaks last, and every context's distribution adds up to 1.  Equal positions (the same byte after the
same ``DEPTH`` bytes) of a slice of texts are looked up once, by binary search in sorted arrays, and remembered for the next slices.

Contexts above a count that at most ``HOT_PAIRS`` pairs of context and next byte reach are sent to every task.  For the rarer ones
tasks have a bit table of ``BITS`` bits that tells which contexts may be kept (it may say yes too often, never no too often); the
positions it points at are joined with the table of rarer contexts.  As a longer suffix never is more frequent than a shorter one,
the join only carries on what the task began, so scores do not depend on the bound.

Word counts stay distributed in the same way: only words above a count that at most ``HOT_WORDS`` words reach are sent to every task;
the other words of a text are looked up by a join.

Defined results: a null or empty text has the end token only; very long texts are scored whole; rows that repeat an id are scored one
by one; without training texts the base is uniform, and so are the bytes; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, written
from .textkernel import LOWER, mix, slices, words

DEPTH, WEIGHT, PENALTY, HOT_WORDS, HOT_PAIRS, BITS = 6, 3.0, 0.25, 1 << 18, 4_500_000, 1 << 26
#: stands for the end of a text among word hashes, and before and after it among bytes
END_WORD, END = np.uint64(0), 10
_GRAM, _WORD = 0, 1
_FLUSH, _BUCKET_BITS, _REMEMBERED = 1 << 20, 11, 3_000_000


def _stream(data: np.ndarray, off: np.ndarray):
    """Words of the rows, and their byte stream: lower case, a space after each word, END after each row."""
    w = words(data, off)
    rows = len(off) - 1
    if not len(w.start):
        return w, np.full(rows, END, np.uint8), np.arange(rows + 1)
    word_of = np.repeat(np.arange(len(w.start)), w.length)
    place = np.arange(len(w.index)) + word_of + w.row[word_of]
    size = np.bincount(w.row, w.length + 1, rows).astype(np.int64) + 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.full(bounds[-1], 32, np.uint8)
    value = LOWER[data][w.index]
    out[place] = np.where(value == 0, 1, value)
    out[bounds[1:] - 1] = END
    w.index = w.within = w.begin = w.start[:0]  # a number for each byte, which nothing below reads
    return w, out, bounds


def _grams(stream: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte below the DEPTH bytes before it, the nearest on top; before a text stands END, and 0 before that."""
    if not len(stream):
        return np.zeros(0, np.int64)
    padded = np.zeros(DEPTH + len(stream) + 8, np.uint8)
    padded[DEPTH - 1], padded[DEPTH : DEPTH + len(stream)] = END, stream
    window = np.lib.stride_tricks.as_strided(padded[:8].view("<i8"), (len(stream),), (1,))  # the bytes from DEPTH before on, the last on top
    key = (window & ((1 << 8 * DEPTH) - 1)) << 8
    key |= stream
    for into in range(DEPTH - 1):  # of a text's first bytes only what its own beginning explains
        at = bounds[:-1] + into
        at = at[at < bounds[1:]]
        key[at] &= ~((1 << 8 * (DEPTH - into)) - 1) | 255
    return key


def _context(gram, depth: int):
    """The ``depth`` bytes before a gram's last."""
    return gram >> (8 * (DEPTH + 1 - depth))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
    return key[first], np.add.reduceat(n, first) if len(first) else n


class _Merger:
    """Adds up counts by key; what is held grows with the keys alone."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, _FLUSH

    def add(self, key: np.ndarray, n: np.ndarray):
        self.parts.append((key, n))
        self.size += len(key)
        if self.size > self.limit:
            self.merge()
            self.limit = 2 * self.size + _FLUSH

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        self.parts = [_merged(self.parts)] if self.parts else [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, keys, counts): counts of a task, packed by bucket of the key, so that they travel in few rows."""
    held = {_GRAM: _Merger(), _WORD: _Merger()}

    def packed(kind):
        key, n = held[kind].merge()
        held[kind] = _Merger()
        bucket = (mix(key.view(np.uint64)) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, n, bucket = key[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo in range(0, len(cuts), 256):
            own = cuts[lo : lo + 256]
            ends = [*cuts[lo + 1 : lo + 257], len(key)][: len(own)]
            blobs = [[x[i:j].tobytes() for i, j in zip(own, ends, strict=True)] for x in (key, n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(bucket[own]), *(pa.array(x, pa.binary()) for x in blobs)], ["kind", "bucket", "keys", "counts"])

    seen = 0
    for batch in batches:
        for lo, hi, data, off in slices(batch.column(0)):
            w, stream, bounds = _stream(data, off)
            seen += len(stream)
            found = {_GRAM: np.unique(_grams(stream, bounds), return_counts=True), _WORD: np.unique(w.hash.view(np.int64), return_counts=True)}
            found[_WORD] = (np.append(found[_WORD][0], 0), np.append(found[_WORD][1], hi - lo))
            for kind, (key, n) in found.items():
                held[kind].add(key, n)
                if held[kind].size > 2 * _FLUSH or seen > 1 << 30:  # counts travel as 32 bits
                    yield from packed(kind)
            seen = seen if seen <= 1 << 30 else 0
    for kind in held:
        yield from packed(kind)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {_GRAM: _Merger(), _WORD: _Merger()}
    for batch in batches:
        for kind, keys, counts in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            held[kind].add(np.frombuffer(keys.as_buffer(), np.int64).copy(), np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64))
    for kind in held:
        key, n = held[kind].merge()
        for lo in range(0, len(key), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), kind, np.int32)), pa.array(key[part]), pa.array(n[part])], ["kind", "key", "n"])


def counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n) of all words (hashed; 0 is the end) and packed bytes with what stands before them of the whole ``text`` column."""
    packed = texts.select("text").mapInArrow(_counts, "kind int, bucket int, keys binary, counts binary")
    return written(packed.repartition("kind", "bucket").mapInArrow(_added, "kind int, key long, n long"))


@dataclass
class SuffixTree:
    """The frequent kept contexts by depth, sorted: with totals and weights, and pairs (place of the context, next byte) with counts; ``maybe``: bits of the rarer."""

    root: np.ndarray
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    weights: list[np.ndarray]
    pairs: list[np.ndarray]
    counts: list[np.ndarray]
    maybe: np.ndarray | None
    #: what a worker remembers of this tree; goes when the tree goes
    memory: _Memory = field(default_factory=lambda: _Memory(), init=False)


@dataclass
class FittedModel:
    """The tree that tasks hold, and the table (depth, context, symbol, n) of the rarer kept contexts, if there are any."""

    tree: SuffixTree
    rare: DataFrame | None
    kept: int


def _contexts(grams: DataFrame) -> DataFrame:
    """(depth, context, symbol, n) of every context of 0 to DEPTH bytes; contexts do not reach beyond a text's beginning."""
    depth = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    rows = grams.select("n", F.col("key").bitwiseAND(255).cast("int").alias("symbol"), "key", depth)
    rows = rows.select("depth", F.expr(f"shiftright(key, 8 * ({DEPTH + 1} - depth))").alias("context"), "symbol", "n")
    rows = rows.withColumn("context", F.when(F.col("depth") == 0, 0).otherwise(F.col("context")))
    whole = (F.col("depth") == 0) | (F.col("context").bitwiseAND(255) > 0)
    return rows.where(whole).groupBy("depth", "context", "symbol").agg(F.sum("n").alias("n"))


def kept_contexts(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depth, context, symbol, n, total) of the contexts that pass the divergence test, and the same of the empty context."""
    rows = written(_contexts(counted.where(F.col("kind") == _GRAM)))
    total = rows.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    own = written(rows.join(total, ["depth", "context"]))
    parent = own.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("shorter"), "symbol", (F.col("n") / F.col("total")).alias("p"))
    shorter = F.when(F.col("depth") == 1, 0).otherwise(F.shiftright("context", 8))
    tested = own.where("depth > 0").withColumn("shorter", shorter).join(parent, ["depth", "shorter", "symbol"])
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("p"))) - PENALTY * F.first("kinds") * F.log(F.first("total"))
    passed = tested.groupBy("depth", "context").agg(gain.alias("gain")).where("gain > 0").select("depth", "context")
    columns = ["depth", "context", "symbol", "n", "total"]
    return own.join(passed, ["depth", "context"]).select(*columns), own.where("depth = 0").select(*columns)


def _bits(depth: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers of each context."""
    h = mix(context.astype(np.uint64) * np.uint64(8) + depth.astype(np.uint64))
    return (h & np.uint64(BITS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)


def _bit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.unique(np.concatenate(_bits(batch.column(0).to_numpy(), batch.column(1).to_numpy())))
        value = np.int64(1) << (bits & 31)
        word, first = np.unique(bits >> 5, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(value, first) if len(first) else value)], ["word", "bits"])


def fit(counted: DataFrame, hot_pairs: int = HOT_PAIRS) -> FittedModel:
    """Divergence tests on the counted contexts.  Only frequent contexts, of ``hot_pairs`` pairs at most, reach the driver."""
    kept, root = kept_contexts(counted)
    kept = written(kept)
    level = F.floor(F.log2("total")).cast("int")
    steps = kept.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()
    least, room = 64, hot_pairs
    for r in sorted(steps, key=lambda r: -r["level"]):
        if r["pairs"] > room:
            break
        least, room = r["level"], room - r["pairs"]
    hot = kept.where(level >= least).select(F.col("depth").cast("byte").alias("depth"), (F.col("context") * 256 + F.col("symbol")).alias("pair"), "n").toArrow()
    depth, pair, n = (hot[c].to_numpy() for c in ("depth", "pair", "n"))
    del hot
    contexts, totals, weights, pairs, counts = ([np.zeros(0, t)] for t in (np.int64, np.float32, np.float32, np.int32, np.float32))
    for d in range(1, DEPTH + 1):
        own = np.flatnonzero(depth == d)
        own = own[np.argsort(pair[own])]
        counts.append(n[own].astype(np.float32))
        context, first, kinds = np.unique(pair[own] >> 8, return_index=True, return_counts=True)
        contexts.append(context)
        pairs.append((np.repeat(np.arange(len(context)), kinds) << 8 | pair[own] & 255).astype(np.int32 if len(context) < 1 << 23 else np.int64))
        totals.append(np.add.reduceat(n[own], first).astype(np.float32) if len(first) else np.zeros(0, np.float32))
        weights.append((WEIGHT * kinds).astype(np.float32))
    of_byte = np.full(256, 0.5)
    for r in root.select("symbol", "n").toLocalIterator():  # 256 at most
        of_byte[r["symbol"]] += r["n"]
    rare, maybe = None, None
    if any(r["level"] < least for r in steps):
        rare = kept.where(level < least)
        words = rare.select("depth", "context").distinct().mapInArrow(_bit_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        maybe = np.zeros(BITS >> 5, np.uint32)
        maybe[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return FittedModel(SuffixTree(of_byte / of_byte.sum(), contexts, totals, weights, pairs, counts, maybe), rare, sum(r["pairs"] for r in steps))


def _probabilities(tree: SuffixTree, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each gram the probability of its last byte as far as the tree goes, and whether a rarer context may carry it on."""
    symbol = gram & 255
    p, more = tree.root[symbol], np.zeros(len(gram), bool)
    for d in range(1, DEPTH + 1):
        context = _context(gram, d)
        if tree.maybe is not None:
            one, two = _bits(np.full(len(gram), d), context)
            more |= ((tree.maybe[one >> 5] >> (one & 31).astype(np.uint32)) & (tree.maybe[two >> 5] >> (two & 31).astype(np.uint32)) & 1).astype(bool)
        known = tree.contexts[d]
        if not len(known):
            continue
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        hit = np.flatnonzero(known[at] == context)
        at = at[hit]
        pair = (at << 8 | symbol[hit]).astype(tree.pairs[d].dtype)
        place = np.minimum(np.searchsorted(tree.pairs[d], pair), len(tree.pairs[d]) - 1)
        n = np.where(tree.pairs[d][place] == pair, tree.counts[d][place], 0).astype(np.float64)
        w = tree.weights[d][at].astype(np.float64)
        p[hit] = (n + w * p[hit]) / (tree.totals[d][at] + w)
    return p, more


class _Memory:
    """What a worker found out about grams of earlier slices; at most ``_REMEMBERED`` of them, then it starts anew."""

    def __init__(self):
        self.known = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)]
        self.fresh: list[tuple] = []
        self.size = 0

    def probabilities(self, tree: SuffixTree, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of sorted grams, and whether a rarer context may carry them on."""
        known = self.known[0]
        at = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
        missed = np.flatnonzero(known[at] != gram) if len(known) else np.arange(len(gram))
        p, open_ = _probabilities(tree, gram[missed])
        p = np.log10(p)
        out, rare = (x[at] if len(known) else np.zeros(len(gram), x.dtype) for x in self.known[1:])
        out[missed], rare[missed] = p, open_
        self.fresh.append((gram[missed], p, open_))
        self.size += len(missed)
        if self.size > 100_000:
            del known
            self.remember()
        return out, rare

    def remember(self):
        """Puts the fresh grams, none of which is known, among the known ones: a column at a time, so that no second copy of all is held."""
        fresh = [np.concatenate(x) for x in zip(*self.fresh, strict=True)]
        key, first = np.unique(fresh[0], return_index=True)
        fresh = [key, *(x[first] for x in fresh[1:])]
        if len(self.known[0]) + self.size > _REMEMBERED:
            self.known = fresh
        else:
            at = np.searchsorted(self.known[0], key) + np.arange(len(key))
            old = np.ones(len(self.known[0]) + len(key), bool)
            old[at] = False
            for i, x in enumerate(fresh):
                both = np.empty(len(old), x.dtype)
                both[old], both[at] = self.known[i], x
                self.known[i] = both
        self.fresh, self.size = [], 0


def _tree_scores(tree: SuffixTree, stream: np.ndarray, bounds: np.ndarray):
    """log10 probability of each row without the positions of rarer contexts; of those (row, gram, times, p)."""
    rows = len(bounds) - 1
    gram = _grams(stream, bounds)
    order = np.argsort(gram)
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(bounds))[order]
    gram = gram[order]
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    size = np.diff(first, append=len(gram))
    gram = gram[first]
    log_p, more = tree.memory.probabilities(tree, gram)
    total = np.bincount(row, np.repeat(np.where(more, 0.0, log_p), size), rows)
    which = np.flatnonzero(more)
    far = np.flatnonzero(np.repeat(more, size)) if len(which) else which
    key, times = np.unique(row[far].astype(np.int64) * max(1, len(which)) + np.repeat(np.arange(len(which)), size[which]), return_counts=True)
    where, nth = np.divmod(key, max(1, len(which)))
    return total, where, gram[which[nth]], times, 10 ** log_p[which[nth]]


def _rare_scores(scored: DataFrame, rare: DataFrame) -> DataFrame:
    """(row_key, rest) of the positions that tasks left open."""
    open_ = scored.select("row_key", F.explode(F.arrays_zip("gram", "times", "p")).alias("x")).select("row_key", "x.gram", "x.times", "x.p")
    once = open_.groupBy("gram").agg(F.first("p").alias("p"))
    depth = F.explode(F.sequence(F.lit(1), F.lit(DEPTH))).alias("depth")
    asked = once.select("gram", depth).select("gram", "depth", F.expr(f"shiftright(gram, 8 * ({DEPTH + 1} - depth))").alias("context"), F.col("gram").bitwiseAND(255).cast("int").alias("symbol"))
    own = rare.groupBy("depth", "context").agg(F.first("total").alias("total"), F.count("*").alias("kinds"), F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("next"))
    found = asked.join(own, ["depth", "context"]).select("gram", F.struct("depth", F.coalesce(F.try_element_at("next", F.col("symbol")), F.lit(0)).alias("n"), "total", (WEIGHT * F.col("kinds")).alias("w")).alias("step"))
    steps = found.groupBy("gram").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    carried = F.aggregate(F.coalesce("steps", F.array()), F.col("p"), lambda p, x: (x["n"] + x["w"] * p) / (x["total"] + x["w"]))
    known = once.join(steps, "gram", "left").select("gram", F.log10(carried).alias("log_p"))
    return open_.select("row_key", "gram", "times").join(known, "gram").groupBy("row_key").agg(F.sum(F.col("times") * F.col("log_p")).alias("rest"))


def _lists(n: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def score(docs: DataFrame, counted: DataFrame, model: FittedModel, hot_words: int = HOT_WORDS, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row's whole text."""
    vocabulary = counted.where((F.col("kind") == _WORD) & (F.col("n") > 0)).select("key", "n")
    level = F.floor(F.log2("n")).cast("int")
    steps = vocabulary.groupBy(level.alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    all_tokens, kinds = sum(r["n"] for r in steps), sum(r["words"] for r in steps)
    least, room = 64, hot_words
    for r in sorted(steps, key=lambda r: -r["level"]):
        if r["words"] > room:
            break
        least, room = r["level"], room - r["words"]
    hot = vocabulary.where(level >= least).toArrow().sort_by("key")
    hot_key, hot_n = hot["key"].to_numpy(), hot["n"].to_numpy()
    below = all_tokens + 0.1 * (kinds + 1)
    # a worker reads a broadcast once for all its tasks and straight into place; what a function itself holds it would keep twice, as bytes and read
    sent = docs.sparkSession.sparkContext.broadcast((model.tree, hot_key, hot_n))
    del hot, hot_key, hot_n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hot_key, hot_n = sent.value
        task, number = TaskContext.get().partitionId(), 0
        hot_log = np.log10((hot_n + 0.1) / below)
        end = int(np.searchsorted(hot_key, 0))
        end_known = end < len(hot_key) and hot_key[end] == 0
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                w, stream, bounds = _stream(data, off)
                rows = hi - lo
                keys, back = np.unique(w.hash.view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(hot_key, keys), max(0, len(hot_key) - 1))
                hit = (hot_key[at] == keys) if len(hot_key) else np.zeros(len(keys), bool)
                value = np.where(hit, hot_log[at], 0.0)[back] if len(hot_key) else np.zeros(len(back))
                base, known = np.bincount(w.row, value, rows).astype(np.float64), np.bincount(w.row, hit[back], rows).astype(np.int64)
                base += hot_log[end] if end_known else 0
                known += int(end_known)
                cold = np.flatnonzero(~hit[back])
                cold_n = np.bincount(w.row[cold], minlength=rows) + (0 if end_known else 1)
                cold_key, cold_row = w.hash.view(np.int64)[cold], w.row[cold]
                if not end_known:
                    cold_key, cold_row = np.concatenate([cold_key, np.zeros(rows, np.int64)]), np.concatenate([cold_row, np.arange(rows)])
                    order = np.argsort(cold_row, kind="stable")
                    cold_key = cold_key[order]
                lists = _lists(cold_n, cold_key)
                total, where, gram, times, p = _tree_scores(tree, stream, bounds)
                far = np.bincount(where, minlength=rows)
                ident = (task << 40) + number + np.arange(rows)
                number += rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(ident), pa.array(w.count + 1), pa.array(known), pa.array(base), pa.array(total), lists, *(_lists(far, x) for x in (gram, times, p))],
                    ["doc_id", "row_key", "n_tokens", "hot_known", "hot_base", "score", "cold", "gram", "times", "p"],
                )

    scored = written(docs.select(F.col("doc_id").cast("long"), text_col).mapInArrow(run, "doc_id long, row_key long, n_tokens long, hot_known long, hot_base double, score double, cold array<long>, gram array<long>, times array<long>, p array<double>"))
    sent.destroy()
    rare = scored.select("row_key", F.explode("cold").alias("key")).groupBy("row_key", "key").agg(F.count("*").alias("times"))
    rare = rare.join(vocabulary.where(level < least), "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    rest = rare.groupBy("row_key").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + 0.1) / F.lit(below))).alias("rest_base"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known")
    )
    out = scored.drop("cold", "gram", "times", "p").join(rest, "row_key", "left")
    if model.rare is not None:
        out = out.join(_rare_scores(scored, model.rare), "row_key", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    known = F.col("hot_known") + F.coalesce("rest_known", F.lit(0))
    base = F.col("hot_base") + F.coalesce("rest_base", F.lit(0.0))
    return out.select("doc_id", "n_tokens", known.alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def model_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores all rows by a model of those whose crc32(doc_id as text) mod ``folds`` is not 0 (a null id: not trained on)."""
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(True))
    counted = counts(docs.where(~held_out))
    return score(docs, counted, fit(counted)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
