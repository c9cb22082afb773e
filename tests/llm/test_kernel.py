import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import textkernel as tk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té .!", max_size=40)), max_size=12)


def plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 64), st.integers(1, 5))
def test_words_and_shingles_equal_plain_python(texts, limit, k):
    words, sets, keys = [], [], []
    for lo, hi, data, off in tk.slices(pa.array(texts, pa.string()), limit):
        w = tk.words(data, off)
        low = tk.LOWER[data]
        words += [[bytes(low[w.start[i] : w.start[i] + w.length[i]]).decode() for i in range(w.first[r], w.first[r] + w.count[r])] for r in range(hi - lo)]
        h, _, n = tk.distinct_per_row(*tk.shingles(w, k), hi - lo)
        sets += [frozenset(x.tolist()) for x in np.split(h, np.cumsum(n)[:-1])]
        keys += list(zip(*(x.tolist() for x in tk.sequence_keys(w)), strict=True))
    expected = [plain(t) for t in texts]
    assert words == expected
    shingled = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []) for w in expected]
    assert [len(s) for s in sets] == [len(s) for s in shingled]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(shingled[i] & shingled[j])
            assert (keys[i] == keys[j]) == (expected[i] == expected[j])


def test_very_long_word():
    h = [tk.words(np.frombuffer(b"x" * n + b"y" + b"x" * 5000, np.uint8), np.array([0, n + 5001])).hash[0] for n in (10, 4106)]
    assert h[0] != h[1]
    w = tk.words(np.frombuffer(b"ab" * 4096, np.uint8), np.array([0, 8192]))
    assert len(w.hash) == 1


def test_sentences_and_case():
    data = np.frombuffer("Ab c. D\ne É!f".encode(), np.uint8)
    w = tk.words(data, np.array([0, len(data)]), tk.ALNUM)
    assert tk.sentences(data, w).tolist() == [0, 0, 1, 2, 2, 3]
    assert bytes(tk.fold_case(data)).decode() == "ab c. d\ne é!f"
