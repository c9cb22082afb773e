"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises all its substrings.  A text is parsed greedily into the longest
phrases that a language's automaton holds; a phrase costs as many bits as a pointer into that language's text, and the language
with the lowest cost wins.

Symbols do not depend on the languages at hand: a run of other characters than letters is one space, an ASCII letter is one symbol
(in lower case), and each UTF-8 byte of any other letter is two, its upper and its lower half.  So all letters of all scripts are
told apart with ``SYMBOLS`` symbols.

The automata are compiled into one transition table, and all texts of a slice are parsed in step, in lanes of ``LANE`` symbols.  A
lane begins in the state that the lane before it ends in: each is parsed from a fresh start first, and then again from the true
state until both parses are in the same state, from where on they are one.  So long texts are parsed as if at one go.

Labelled text is sampled: about ``SAMPLE_CHARS`` characters of each language, fewer if ``TOTAL_CHARS`` for all languages together would
be exceeded (this bounds the table that tasks hold), in pieces of ``PIECE`` of the rows with the lowest hash of doc_id.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled text every text is ``und``;
very long texts are parsed whole; equal costs go to the language that is first by code point; repeated rows get equal results; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import slices

SAMPLE_CHARS, TOTAL_CHARS, PIECE, LANE, SYMBOLS = 30_000, 400_000, 500, 256, 64
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
#: symbols: space, padding, 26 letters, 16 upper halves and 16 lower halves of bytes
_SPACE, _PAD, _LOWER, _HIGH, _LOW = 0, 1, 2, 28, 44


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # (state, symbol) -> next state * 4 + phrases that end
    root: np.ndarray
    bits: np.ndarray  # of a phrase


def _automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def _letters(points: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        out[far] = [chr(c).isalpha() for c in points[far].tolist()]
    return out


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, row of it, whether the row has a letter) of texts given as UTF-8 bytes with row offsets."""
    n = len(off) - 1
    text = data.tobytes().decode("utf-8", "replace").lower()
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    if starts[-1] != len(text):  # lower() may change lengths
        rows = [data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(off[:-1], off[1:], strict=True)]
        text = "".join(rows)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    letter = _letters(points)
    has = np.bincount(row[letter], minlength=n) > 0
    keep = letter.copy()  # of other characters the first of a run
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    keep[:1] = True
    points, row, letter = points[keep], row[keep], letter[keep]
    plain = (points >= 97) & (points <= 122) & letter
    wide = letter & ~plain
    size = np.where(wide, 2 * (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)), 1)
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.full(first[-1], _SPACE, np.uint8)
    out[first[:-1][plain]] = points[plain] - 97 + _LOWER
    raw = np.frombuffer("".join(map(chr, points[wide].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
    place = np.repeat(first[:-1][wide], size[wide] // 2) + 2 * (np.arange(len(raw)) - np.repeat(np.cumsum(size[wide] // 2) - size[wide] // 2, size[wide] // 2))
    out[place], out[place + 1] = _HIGH + (raw >> 4), _LOW + (raw & 15)
    return out, np.repeat(row, size), has


def fit(texts: dict[str, str]) -> LanguageModel:
    """Builds the model of labelled texts, language by language."""
    langs = sorted(x for x in texts if texts[x])
    tables, roots, sizes, at = [], [], [], 0
    for x in langs:
        data = np.frombuffer(texts[x].encode("utf-8", "replace"), np.uint8)
        codes, _, _ = symbols(data, np.array([0, len(data)]))
        step = _automaton(codes)
        dense = np.full((len(step), SYMBOLS), -1, np.int64)
        for s, d in enumerate(step):
            dense[s, list(d)] = list(d.values())
        known = dense[0] >= 0
        inside = (np.arange(len(step)) > 0).astype(np.int64)
        # a step that fails ends the phrase, if one is open; a symbol that the text lacks is a phrase of its own
        failed = (np.where(known, dense[0], 0) + at)[None, :] * 4 + inside[:, None] + ~known[None, :]
        out = np.where(dense >= 0, (dense + at) * 4, failed)
        out[:, _PAD] = (np.arange(len(step)) + at) * 4
        tables.append(out.astype(np.int32))
        roots.append(at)
        sizes.append(len(codes))
        at += len(step)
    bits = np.array([np.log2(max(2, n)) for n in sizes])
    return LanguageModel(langs, np.concatenate(tables) if tables else np.zeros((0, SYMBOLS), np.int32), np.array(roots, np.int64), bits)


def _phrases(model: LanguageModel, codes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Number of phrases by row and language; rows are runs of ``codes``."""
    size = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)])
    lanes = -(-size // LANE)
    owner = np.repeat(np.arange(n), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(lanes)])[:-1], lanes)
    at = first[owner] + nth * LANE
    end = np.minimum(at + LANE, first[owner + 1])
    grid = at[None, :] + np.arange(LANE)[:, None]
    grid = np.where(grid < end[None, :], np.append(codes, _PAD)[np.minimum(grid, len(codes))], _PAD).astype(np.int32)
    langs, width = len(model.langs), len(owner)
    flat = model.table.ravel()
    root = np.repeat(model.root[:, None], width, 1).astype(np.int32)
    long = bool((lanes > 1).any())
    states = np.zeros((LANE, langs, width), np.int32) if long else None
    counts = np.zeros((LANE + 1, langs, width), np.int16) if long else None
    state, total = root, np.zeros((langs, width), np.int64)
    for i in range(LANE):
        step = flat[state * np.int32(SYMBOLS) + grid[i]]
        total += step & 3
        state = step >> 2
        if long:
            states[i], counts[i + 1] = state, total
    if long:
        fresh, final, entry = total.copy(), state.copy(), root
        while True:
            before = np.where(nth[None, :] > 0, np.roll(final, 1, 1), root)
            lang, lane = np.nonzero(before != entry)
            if not len(lane):
                break
            entry = before
            now, seen = entry[lang, lane], np.zeros(len(lane), np.int64)
            total[lang, lane] = 0
            for i in range(LANE):  # until the parse from the true state and the fresh one agree
                step = flat[now * np.int32(SYMBOLS) + grid[i, lane]]
                seen += step & 3
                now = step >> 2
                same = now == states[i, lang, lane]
                if same.any():
                    x, y = lang[same], lane[same]
                    total[x, y] = seen[same] + fresh[x, y] - counts[i + 1, x, y]
                    final[x, y] = state[x, y]
                    lang, lane, now, seen = (z[~same] for z in (lang, lane, now, seen))
                    if not len(lane):
                        break
            total[lang, lane], final[lang, lane] = seen, now
        state = final
    last = np.append(nth[1:] == 0, True) if width else np.zeros(0, bool)
    total[:, last] += (state != root)[:, last]  # the phrase that the text's end leaves open
    return np.array([np.bincount(owner, t, n) for t in total]).reshape(langs, n).T


def _costs(model: LanguageModel, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits by language, whether it has a letter) of each text."""
    codes, row, has = symbols(data, off)
    return _phrases(model, codes, row, len(off) - 1) * model.bits, has


def _predicted(model: LanguageModel, column) -> tuple[list[str], np.ndarray]:
    n = len(column)
    best, score = np.full(n, -1), np.zeros(n)
    if model.langs:
        for lo, hi, data, off in slices(column):
            cost, has = _costs(model, data, off)
            low = cost.min(1)
            best[lo:hi] = np.where(has, cost.argmin(1), -1)
            score[lo:hi] = np.where(has, 1 / np.exp2(-np.minimum(cost - low[:, None], 1000)).sum(1), 0)
    names = [*model.langs, "und"]
    return [names[b] for b in best], score


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (share of the best language in the coding model's posterior) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _predicted(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    fields = [docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.select("doc_id", text_col).mapInArrow(run, T.StructType(fields))


def train(docs: DataFrame, where: Column | None = None, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Samples about ``sample_chars`` characters of each language, of many languages ``TOTAL_CHARS`` in all.

    Rows are taken where their hash falls below a share that is set for twice that much text; of these few rows the driver keeps
    the lowest hashes until the characters suffice.  Of a longer text a piece from a hashed place is taken, so that many texts
    have a part in the sample.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        rows = rows.where(where)
    sizes = {r["lang"]: (r["n"], r["chars"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.length("text"), F.lit(PIECE))).alias("chars")).toLocalIterator()}
    sample_chars = min(sample_chars, TOTAL_CHARS // max(1, len(sizes)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {x: min(1.0, max(2 * sample_chars / max(1, chars), 24 / n)) for x, (n, chars) in sizes.items()}
    if not share:
        return fit({})
    limit = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])
    at = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1).cast("int")
    picked = rows.where(place < limit[F.col("lang")]).select("lang", "doc_id", place.alias("place"), F.substring(F.col("text"), at, F.lit(PIECE)).alias("text"))
    pieces: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["place"], r["doc_id"] if r["doc_id"] is not None else -1, r["text"])):
        own = pieces.setdefault(r["lang"], [])
        if sum(map(len, own)) < sample_chars:
            own.append(r["text"])
    return fit({x: "\n".join(own) for x, own in _agreed(pieces).items()})


def _agreed(pieces: dict[str, list[str]]) -> dict[str, list[str]]:
    """The pieces that a model of the other half of the sample gives to their own language: passages in another language that stand
    in a labelled document must not teach it.  A language that would lose all its pieces keeps them."""
    kept: dict[str, list[str]] = {x: [] for x in pieces}
    for half in (0, 1):
        model = fit({x: "\n".join(own[1 - half :: 2]) for x, own in pieces.items()})
        for x, own in pieces.items():
            names, _ = _predicted(model, pa.array(own[half::2], pa.string()))
            kept[x] += [t for t, name in zip(own[half::2], names, strict=True) if name == x]
    return {x: kept[x] or pieces[x] for x in pieces}
