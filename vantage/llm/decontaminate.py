"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are word sequences: runs of letters and digits of any script, in lower case; in scripts that are written
without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) each letter is a word.  An item of m words may be changed by
b = floor(m * ``ERROR_SHARE``) word insertions, deletions or substitutions; items of fewer than ``MIN_EDITED`` words, too short to be
told from other phrases when changed, are searched unchanged (b = 0).  An item is split into b + 1 pieces, of which one at least is
unchanged in any such copy; an Aho-Corasick automaton finds all exact piece hits in a document's whole text, and Myers'
bit-parallel algorithm verifies the window around each hit for a semi-global match of at most b errors.

Items are the stated query set: they are read in blocks of ``BLOCK_WORDS`` words, each sent to all tasks in turn against all
documents, so what is broadcast is bounded whatever the number of items.

Defined results: null, empty and word-free texts match nothing, and items without words match no text; very long texts are searched
whole; equal items are reported each; a document that holds an item several times has one row for it, of its best match (fewest
errors, then first); rows that repeat an id are reported each; no documents or no items give no rows; other columns, whatever their
names, are ignored by ``matches`` and pass through ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import column_bytes

ERROR_SHARE, MIN_EDITED, BLOCK_WORDS = 0.2, 8, 200_000
#: letters of scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W_{_SINGLE}]+|[{_SINGLE}]")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def budget(m: int, share: float) -> int:
    return int(m * share) if m >= MIN_EDITED else 0


def pieces(m: int, b: int) -> list[tuple[int, int]]:
    """Word ranges of b + 1 pieces of an item of m words."""
    cuts = [m * i // (b + 1) for i in range(b + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def myers(masks: dict[str, int], m: int, text: list[str], b: int) -> tuple[int, int] | None:
    """(errors, end) of the best semi-global match of the pattern in ``text``, if of ``b`` errors at most."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, word in enumerate(text):
        eq = masks.get(word, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = (minus | ~(d0 | plus)) & full
        hm = plus & d0
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus = (hm | ~(d0 | hp)) & full
        minus = hp & d0
        if score <= b and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """Finds the approximate copies of a block of items in texts."""

    def __init__(self, items: list[tuple[int, list[str]]], share: float):
        self.items, self.share = items, share
        self.automaton = ahocorasick.Automaton()
        self.masks: list[dict[str, int]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(items):
            masks: dict[str, int] = {}
            for j, word in enumerate(item):
                masks[word] = masks.get(word, 0) | 1 << j
            self.masks.append(masks)
            for a, z in pieces(len(item), budget(len(item), share)):
                at.setdefault(" " + " ".join(item[a:z]) + " ", []).append((i, a))
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def find(self, content: str) -> dict[int, tuple[int, int]]:
        """Item number -> (errors, number of the match's last word) in a text."""
        if self.empty:
            return {}
        words = _words(content)
        text = " " + " ".join(words) + " "
        hits = list(self.automaton.iter(text))
        if not hits:
            return {}
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])  # of the space before each word
        found: dict[int, tuple[int, int]] = {}
        done: set[tuple[int, int]] = set()
        for end, (length, where) in hits:
            word = int(np.searchsorted(starts, end - length + 1))
            for i, a in where:
                m = len(self.items[i][1])
                b = budget(m, self.share)
                lo, hi = max(0, word - a - b), min(len(words), word - a + m + b)
                if (i, word - a) in done:
                    continue
                done.add((i, word - a))
                best = myers(self.masks[i], m, words[lo:hi], b)
                if best and (i not in found or (best[0], lo + best[1]) < found[i]):
                    found[i] = (best[0], lo + best[1])
        return found


def _texts(column) -> Iterator[str]:
    """The texts of an Arrow column one by one; a null is an empty one."""
    data, off = column_bytes(column)
    for a, b in zip(off[:-1], off[1:], strict=True):
        yield data[a:b].tobytes().decode("utf-8", "replace")


def _blocks(items: DataFrame, share: float, item_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for r in items.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(item_col, text_col).toLocalIterator():
        item = _words(r[1])
        if not item:
            continue
        block.append((r[0], item))
        size += len(item)
        if size >= BLOCK_WORDS:
            yield sorted(block)
            block, size = [], 0
    if block:
        yield sorted(block)


def matches(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, errors, item_words, end_word): every document and item that it holds with few enough errors."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("errors", "item_words", "end_word"))])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, share, "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, share)
            for batch in batches:
                rows = [(r, i, *hit) for r, text in enumerate(_texts(batch.column(1))) for i, hit in sorted(matcher.find(text).items())]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [[block[r[1]][0] for r in rows], [r[2] for r in rows], [len(block[r[1]][1]) for r in rows], [r[3] for r in rows]]
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], schema.names)

        out = out.unionByName(docs.select("doc_id", text_col).mapInArrow(run, schema))
    return out


def holds_item(items: DataFrame, share: float = ERROR_SHARE):
    """Column functions, one for each block of items: whether a text holds any of them."""
    out = []
    for block in _blocks(items, share, "item_id", "text"):

        def run(text: pa.Array, block=block, held: list = []) -> pa.Array:  # noqa: B006  a worker's matcher is built once
            if not held:
                held.append(Matcher(block, share))
            return pa.array([bool(held[0].find(x)) for x in _texts(text)], pa.bool_())

        out.append(_column_function(run))
    return out


def _column_function(run):
    def apply(text: pa.Array) -> pa.Array:
        return run(text)

    return F.arrow_udf(apply, T.BooleanType())


def clean(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for test in holds_item(items, share):
        docs = docs.where(~test(F.col(text_col)))
    return docs
