"""Each operator against a brute-force version and on the awkward inputs: nulls, empty and long texts, ties, repeats, empty tables."""

import dataclasses
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SF
from pyspark import SparkContext
from pyspark.sql import functions as F

from vantage.llm import decontaminate, fingerprint, html_text, language_id, licenses, lm_score, mixing, near_dup, quality, shared, toxicity

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [None, "", " \n ", "one", "one", LONG, "A b c d e", "a B c d e f", "née élan Ñandú 😀 x y", "."]


#: columns that no operator may read, under names that results and steps have
CLASH = "score size taken copies row key kept first n_shingles component_id errors label rank rep bucket edited next fingerprint sentence_ids licenses lang_pred html url".split()


@pytest.fixture
def docs_of(spark):
    """Documents from texts, ids from 0 (or given), with extra columns whose names clash with results."""

    def make(texts, sources=None, ids=None):
        ids = ids or range(len(texts))
        rows = [(i, t, "en", s, 7) for i, t, s in zip(ids, texts, sources or ["a"] * len(texts), strict=True)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return docs.select("*", *(F.lit("other").alias(c) for c in CLASH))

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# mixing


def test_mixing_targets_limits_and_reruns(spark, sample):
    first, again = (rows(mixing.mix(sample), "doc_id") for _ in range(2))
    assert {i: r.taken for i, r in first.items()} == {i: r.taken for i, r in again.items()}
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in sample.collect():
        x = first[r.doc_id]
        assert x.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and x.taken <= 2 * x.size and x.taken == x.size * x.copies
        b = by[r.source]
        b[0], b[1], b[2], b[3] = b[0] + x.size, b[1] + x.taken, x.target, max(b[3], x.size)
    total = sum(b[0] for b in by.values())
    assert sum(b[2] for b in by.values()) == pytest.approx(1.5 * total)
    for b in by.values():
        assert b[2] <= 2 * b[0] + 1e-6 and abs(b[1] - b[2]) <= 2 * b[3]


def test_water_filling_equals_iteration(spark):
    rng = random.Random(4)
    sizes = {f"s{i:02}": rng.choice([1, 5, 50, 1000]) * rng.randint(1, 9) for i in range(17)} | {None: 40}
    order = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        more = {s for s in order if s not in full and target[s] >= 2 * sizes[s]}
        if not more:
            break
        full |= more
    d = spark.createDataFrame([(i, " ".join(["x"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").collect()}
    assert got == pytest.approx(target)


def test_mixing_odd_rows_and_emission(spark, docs_of):
    d = docs_of(ODD, ["a", "b", None, "a", "b", "a", None, "b", "a", "b"], [0, 0, 1, 2, 3, 4, 5, 6, 7, 8])
    out = mixing.mix(d).collect()
    assert len(out) == len(ODD) and all(r.copies in (0, 1, 2) for r in out)
    emitted = mixing.emit(d)
    assert emitted.columns == d.columns and emitted.count() == sum(r.copies for r in out)
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.emit(d.limit(0)).count() == 0


# decontamination


def edit_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for j, p in enumerate(pattern):
            new.append(min(row[j] + (p != w), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_equals_brute_force(spark, docs_of):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(60)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(5, 30))] for _ in range(12)]
    texts = []
    for _ in range(80):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            copy = list(rng.choice(items))
            for _ in range(rng.randint(0, 7)):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice([[], ["zz"], [copy[i], "yy"]])
                copy = copy or ["x"]
            at = rng.randint(0, len(t))
            t[at:at] = copy
        texts.append(" ".join(t).upper() if rng.random() < 0.3 else ", ".join(t))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.errors for r in decontaminate.matches(docs_of(texts), bench).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            e = edit_distance(x, re.findall(r"\w+", t.lower()))
            if e <= (int(0.2 * len(x)) if len(x) >= decontaminate.MIN_EDITED else 0):
                expected[d, i] = e
    assert got == expected and len(got) > 20
    assert {r.doc_id for r in decontaminate.clean(docs_of(texts), bench).collect()} == set(range(80)) - {d for d, _ in expected}


def test_decontamination_of_short_accented_and_unspaced_items(spark, docs_of):
    """Items of one to eight words, with letters whose bytes hold 0x85 and 0xA0, and in scripts without spaces."""
    vocab = "voilà là-bas ątom née Ñandú élan año çа 😀zz ok".split()
    han = "中文评测数据集样本检查重复文本语言模型训练"
    rng = random.Random(12)
    cut = lambda t: re.findall(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0eff]|[^\W_\u3040-\u30ff\u3400-\u9fff\u0e00-\u0eff]+", t.lower())
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8)] + ["".join(rng.choice(han) for _ in range(n)) for n in (1, 3, 7, 8, 24)] + ["ภาษาไทย", "..", items_twice := "voilà voilà", items_twice]
    texts = [None, "", "…", *items, *(x.upper() + "!" for x in items), *(" ".join(rng.choice([*vocab, han[:5], han[3:9]]) for _ in range(rng.randint(1, 25))) for _ in range(60))]
    texts += [items[12][:10] + "错" + items[12][11:], items[12][:3] + "错" * 5 + items[12][8:], "voilÃ lÃ bas"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.errors for r in decontaminate.matches(docs_of(texts), bench).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            p = cut(x)
            if p and (e := edit_distance(p, cut(t or ""))) <= (int(0.2 * len(p)) if len(p) >= 8 else 0):
                expected[d, i] = e
    assert got == expected and len({i for _, i in got}) == len(items) - 1
    assert {r.doc_id for r in decontaminate.clean(docs_of(texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in expected}


def test_decontamination_odd(spark, docs_of):
    bench = spark.createDataFrame([(1, "née élan ñandú x y alpha beta gamma delta")], "item_id long, text string")
    d = docs_of([*ODD, "NÉE ÉLAN ÑANDÚ X Y ALPHA BETA GAMMA DELTA", LONG + " née élan ñandú x y alpha beta gamma delta"])
    assert sorted(r.doc_id for r in decontaminate.matches(d, bench).collect()) == [10, 11]
    assert decontaminate.matches(d.limit(0), bench).count() == 0 and decontaminate.matches(d, bench.limit(0)).count() == 0
    assert decontaminate.clean(d, bench.limit(0)).count() == 12


def test_decontamination_tries_every_window(spark, docs_of):
    item = [f"q{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    d = docs_of([" ".join(item[-5:] + item), " ".join(item[:5] + item), " ".join(item[-5:])])
    assert {r.doc_id: r.errors for r in decontaminate.matches(d, bench).collect()} == {0: 0, 1: 0}
    assert [r.doc_id for r in decontaminate.clean(d, bench).collect()] == [2]


# fingerprints


def brute_anchors(text):
    """(at, hash) of each closed syncmer."""
    import xxhash

    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p & (2**64 - 1)).to_bytes(8, "little"), seed)
        return seed

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    w = [h(x) for x in re.findall(r"[^\x20\x09-\x0D]{1,32}", text)]
    if not w:
        return []
    if len(w) < 6:
        return [(1, h(*w) >> 32)]
    s = [h(a, b) for a, b in zip(w[:-1], w[1:], strict=True)]
    inner = [[signed(x) for x in s[i : i + 5]] for i in range(len(s) - 4)]
    return [(i + 1, h(s[i], s[i + 2], s[i + 4]) >> 32) for i, x in enumerate(inner) if min(x[0], x[4]) <= min(x[1:4])]


def brute_text(anchors):
    return "".join(f"{min(255, at - before):02x}{x:08x}" for (at, x), before in zip(anchors, [0, *(at for at, _ in anchors)], strict=False))


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_fingerprints_equal_brute_force(spark, docs_of):
    texts = [t for t in ODD] + [f"{LONG[: 3000 + 17 * i]} tail {i}" for i in range(6)] + ["same text of these words here now"] * 2
    ids = [3, 50, 7, 900, 901, 10**12, -5, 0, 77, 78, *range(1000, 1006), 2000, 2000]
    got = defaultdict(list)
    for r in fingerprint.fingerprints(docs_of(texts, ids=ids)).collect():
        got[r.doc_id].append(r)
    order = sorted(range(len(ids)), key=lambda i: (-ids[i], texts[i] or ""))
    moves = lambda a: [(x, at - before) for (at, x), (before, _) in zip(a[1:], a[:-1], strict=True)]
    for n, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        a, b, c = brute_anchors(own), brute_anchors(edited), brute_anchors(after)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(r for r in got[ids[i]] if r.edited_sha256 == sha)
        assert r.n_chars == len(own) and r.fingerprint == brute_text(a) and r.edited_fingerprint == brute_text(b)
        only = lambda x: [h for _, h in x]
        assert r.near_edited == pytest.approx(jaccard(only(a), only(b))) and r.near_next == pytest.approx(jaccard(only(a), only(c)))
        assert r.same_place_edited == pytest.approx(jaccard(a, b)) and r.same_steps_next == pytest.approx(jaccard(moves(a), moves(c)))
    assert len(got[10**12][0].fingerprint) > 80_000  # no anchor of a long text is left out


def test_outlying_ids_do_not_crowd_the_others(spark, docs_of, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 4)
    monkeypatch.setattr(fingerprint, "QUANTILES", 8)
    d = docs_of([f"t{i}" for i in range(200)], ids=[*range(198), 10**18, -(10**18)])
    at, _ = fingerprint._ranges(d)
    sizes = [r["count"] for r in d.groupBy(at.alias("r")).count().collect()]
    assert sum(sizes) == 200 and max(sizes) <= 30
    ordered = [r.r for r in d.select("doc_id", at.alias("r")).orderBy("doc_id").collect()]
    assert ordered == sorted(ordered)


def test_fingerprints_over_many_ranges(spark, docs_of, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    texts = [f"a{i} b{i} c{i} d e f g{i}" for i in range(40)]
    ids = [i * 37 % 1009 for i in range(40)]
    got = rows(fingerprint.fingerprints(docs_of(texts, ids=ids)), "doc_id")
    by = sorted(zip(ids, texts, strict=True), reverse=True)
    for n, (i, t) in enumerate(by):
        k = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + by[(n + 1) % 40][1][:k]).encode()).hexdigest()
    none = spark.createDataFrame([(None, "x y z a b"), (None, None)], "doc_id long, text string")
    assert fingerprint.fingerprints(none).count() == 2 and fingerprint.fingerprints(none.limit(0)).count() == 0
    at = fingerprint.with_anchors(docs_of([LONG]), "text", "anchors").select(F.size("anchors"), F.get("anchors", F.lit(0))["at"]).first()
    assert at[0] > 8_000 and at[1] >= 1


# near duplicates


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_near_duplicates_equal_brute_force(spark, docs_of):
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy).title() if rng.random() < 0.2 else " \n".join(copy))
            if rng.random() < 0.3:
                base = copy  # chains
    got = rows(near_dup.near_duplicates(docs_of(texts), k=4), "doc_id")
    expected = brute_components(texts, 4, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_odd(spark, docs_of):
    d = docs_of(["a b c d e f"] * 50 + [None], ids=[*range(10, 60), 60])
    got = near_dup.near_duplicates(d).collect()
    assert sum(r.kept for r in got) == 2 and {r.component_id for r in got} == {10, 60}
    assert near_dup.near_duplicates(d.limit(0)).count() == 0
    twice = near_dup.near_duplicates(docs_of(["x y", "x y", None], ids=[1, 1, 1])).collect()
    assert len(twice) == 3
    null = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in near_dup.near_duplicates(null).collect()) == [(0, False), (4, True)]


def test_rows_that_repeat_ids(spark, docs_of):
    base = [f"q{i}" for i in range(60)]
    copy = base[:-2] + ["other", "end"]
    texts = ["a b c d e f", "a b c d e f", " ".join(base), " ".join(copy), "x y z", "x y z", "x y z", None, None]
    d = docs_of(texts, ids=[1, 5, 5, 8, 9, 9, None, None, 9])
    got = near_dup.near_duplicates(d, k=3).collect()
    assert Counter((r.doc_id, r.component_id, r.first) for r in got) == Counter(
        [(1, 1, True), (5, 1, False), (5, 5, True), (8, 5, False), (9, 9, True), (9, 9, False), (None, 9, False), (None, None, True), (9, 9, True)]
    )
    assert {(r.doc_id, r.component_id): r.kept for r in got if r.doc_id in (1, 5, 8)} == {(1, 1): True, (5, 1): False, (5, 5): True, (8, 5): False}


def test_documents_that_are_nearly_near_give_no_rows(spark, docs_of, monkeypatch):
    """Of n documents at a similarity of about 0.76 to each other none is linked, and no pair of them becomes a row."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        t = list(base)
        for j in rng.sample(range(0, 300, 6), 12):
            t[j] = f"own{i}x{j}"
        texts.append(" ".join(t))
    seen = []
    plain = near_dup._crossed
    monkeypatch.setattr(near_dup, "_crossed", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = near_dup.near_duplicates(docs_of(texts), k=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 3, 80)
    assert len({r.component_id for r in got}) == 60 and len(seen) == 1


def test_hot_keys_are_joined_like_others(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_SHARE", 4)
    base = [f"q{i}" for i in range(60)]
    texts = [" ".join(base[: 60 - i % 5] + [f"z{i}"] * (i % 5)) for i in range(30)] + ["a b c d"] * 40 + ["e f g h", "e f g h", None, ""]
    got = rows(near_dup.near_duplicates(docs_of(texts), k=3), "doc_id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts, 3, 80)


def test_blocks_of_a_large_bucket(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_dup, "_GROUP", 8)
    base = [f"q{i}" for i in range(60)]
    texts = [" ".join(base[: 60 - i % 9] + [f"z{i}"] * (i % 9)) for i in range(40)]
    got = rows(near_dup.near_duplicates(docs_of(texts), k=3), "doc_id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts, 3, 80)


def test_each_query_of_near_duplicates_writes_a_table(spark, docs_of, monkeypatch):
    """What decides on the next step is measured as tables are written: queries that only count fill the driver's memory."""

    def queries():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    tables, plain = [], near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda *a, **b: tables.append(plain(*a, **b)) or tables[-1])
    base = [f"q{i}" for i in range(60)]
    texts = [" ".join(base[: 60 - i % 9] + [f"z{i}"] * (i % 9)) for i in range(40)] + [None, "", "x y"]
    docs = docs_of(texts)
    for some in (docs, docs.limit(0)):
        some.collect()
        before = queries()
        tables.clear()
        found = near_dup.near_duplicates(some, k=3)
        assert 0 < queries() - before == len(tables)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == (brute_components(texts, 3, 80) if some is docs else {})


def test_measures_of_written_tables(spark):
    table = shared.written(spark.range(10).withColumn("n", F.col("id") % 4), rows=F.count("*"), most=F.max("n"), high=F.count(F.when(F.col("n") > 2, 1)))
    assert [shared.measured(table, x) for x in ("rows", "most", "high")] == [10, 3, 2] and table.count() == 10
    none = shared.written(table.where("n > 9").join(table.select("n"), "n"), rows=F.count("*"), most=F.max("n"))
    assert [shared.measured(none, x) for x in ("rows", "most")] == [0, 0] and none.isEmpty()


# classifiers


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(vocab) for _ in range(rng.randint(4, 9))) for _ in range(rng.randint(2, 8))]
        toxic, grade = int(rng.random() < 0.3), rng.choice([0, 1, 2])
        if toxic:
            j = rng.randrange(len(sentences))
            sentences[j] += " " + " ".join(rng.sample(["nasty", "vile", "rotten"], 2))
        mark = {0: "|| ||", 1: "so-so", 2: "Fine."}[grade]
        docs.append((i, ". ".join(sentences) + (" " + mark) * (len(sentences) // 2 + 2)))
        labels.append((i, grade, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_locates(spark, docs_of):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, where=F.col("doc_id") % 3 != 1)
    held = rows(toxicity.scores(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1"), "doc_id").values()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in held]) > 0.95
    scored = rows(toxicity.scores(docs, model), "doc_id")
    found = toxicity.offending_sentences(docs, model).collect()
    assert Counter((i, a, b) for i, r in scored.items() for a, b in zip(r.offending_start, r.offending_end, strict=True)) == Counter((r.doc_id, r.start_byte, r.end_byte) for r in found)
    assert found and np.mean([bool(re.search("nasty|vile|rotten", r.sentence)) for r in found]) > 0.9
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id].encode()[r.start_byte : r.end_byte].decode() == r.sentence for r in found)
    odd = rows(toxicity.scores(docs_of(ODD), model), "doc_id")
    assert odd[0].score == odd[1].score == odd[9].score == 0 and odd[3].score == odd[4].score and all(0 <= r.score <= 1 for r in odd.values())
    blank = toxicity.train(docs, labels.limit(0))
    assert toxicity.scores(docs, blank).agg(F.max("score")).first()[0] < 1e-6
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, nulls).bias == -50.0


def plain_toxicity(model, text):
    """1 minus the product over sentences of 1 - p, by a plain loop; a word that repeats the one before counts once."""
    import pyarrow as pa

    from vantage.llm.textkernel import column_bytes

    sentences, cut, before, end = [], True, None, 0
    for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or ""):
        cut, end = cut or bool(re.search(r"[\n.!?]", text[end : m.start()])), m.end()
        if m[0].lower() != before:  # a sentence of such words alone is none
            sentences += [[]] if cut else []
            sentences[-1].append(m[0])
            cut = False
        before = m[0].lower()
    clean = 1.0
    for own in sentences:
        features = [toxicity._features(*column_bytes(pa.array([w]))) for w in own]
        z = sum(float(model.weights[f.idx[0]]) + float(model.weights[f.pre[0]]) for f in features) + model.bias
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_equals_plain_loop(spark, docs_of):
    docs, labels = labelled(spark, n=200)
    model = toxicity.train(docs, labels)
    texts = [*ODD[:5], *ODD[6:], "Nasty vile! Word1 word2. rotten\nword3", "vile vile vile. word4", "a. b. c", *(r.text for r in docs.limit(30).collect())]
    got = rows(toxicity.scores(docs_of(texts * 2), model), "doc_id")
    for i, t in enumerate(texts * 2):
        assert got[i].score == pytest.approx(plain_toxicity(model, t), abs=1e-6), t
    assert toxicity.scores(docs_of(texts).limit(0), model).count() == 0


def test_training_is_bounded_by_bytes(spark):
    docs, labels = labelled(spark, n=120)
    from vantage.llm import training

    features = training.labelled_sample(docs, labels, "toxic", 100).select("doc_id", "label", F.col("text").cast("binary").alias("x"))
    table = training.gathered(features, ["x"], 5000)
    every = sorted(((r.p, len(r.x)) for r in features.select(F.xxhash64("doc_id").alias("p"), "x").collect()))
    fits = [sum(n for _, n in every[: k + 1]) <= 5000 for k in range(len(every))]
    assert 0 < len(table) == sum(fits) < 100 and features.count() == 100
    assert len(training.gathered(features, ["x"], 10)) == 0


def test_quality_equals_plain_loop(spark, docs_of):
    import pyarrow as pa

    from vantage.llm.textkernel import column_bytes

    docs, labels = labelled(spark, n=400)
    model = quality.train(docs, labels)
    texts = [*ODD[:5], *ODD[6:], "|| || so-so Fine.", "word1 word1 word1"]
    got = rows(quality.scores(docs_of(texts * 2), model, at_least=2), "doc_id")
    for i, t in enumerate(texts * 2):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if not ws:
            assert (got[i].expected_grade, got[i].tail_probability) == (0, 0)
            continue
        total, before = 0.0, None
        for w in ws:
            _, idx, shape = quality._features(*column_bytes(pa.array([f"{w} {w}" if before and before.lower() == w.lower() else w])))
            total += float(model.weights[idx[-1]]) + float(model.weights[shape[-1]])
            before = w
        score = total / len(ws) + float(model.weights[quality._SIZE - quality.LENGTHS + int(math.log2(len(ws)))])
        above = [1 / (1 + math.exp(t_j - score)) for t_j in model.thresholds]  # P(grade >= 1), P(grade >= 2)
        assert got[i].expected_grade == pytest.approx(sum(above), abs=1e-5) and got[i].tail_probability == pytest.approx(above[1], abs=1e-5)


def test_thresholds_follow_the_grades_where_texts_tell_nothing(spark):
    docs = spark.createDataFrame([(i, "same words in all of them") for i in range(400)], "doc_id long, text string")
    grades = [0] * 200 + [1] * 120 + [2] * 80
    model = quality.train(docs, spark.createDataFrame(list(enumerate(grades)), "doc_id long, quality int"))
    got = quality.scores(docs, model, at_least=1).first()
    assert got.tail_probability == pytest.approx(0.5, abs=0.04) and got.expected_grade == pytest.approx(280 / 400, abs=0.06)


def test_quality_is_ordinal(spark, docs_of):
    docs, labels = labelled(spark, n=1000)
    model = quality.train(docs, labels, where=F.col("doc_id") % 3 != 1)
    assert len(model.thresholds) == 2 and np.all(np.diff(model.thresholds) > 0)
    held = quality.scores(docs, model, at_least=2).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([abs(r.expected_grade - r.quality) < 0.5 for r in held]) > 0.9
    assert np.mean([(r.tail_probability >= 0.5) == (r.quality == 2) for r in held]) > 0.9
    odd = rows(quality.scores(docs_of(ODD), model), "doc_id")
    assert odd[0].tail_probability == odd[1].tail_probability == odd[2].tail_probability == 0 and odd[3] is not None
    assert quality.scores(docs, quality.train(docs, labels.limit(0))).count() == docs.count()
    assert quality.scores(docs.limit(0), model).count() == 0


def test_real_labels_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels, where=F.col("doc_id") % 4 != 0)
    held = quality.scores(docs, model).join(labels, "doc_id").where("doc_id % 4 = 0").collect()
    assert np.mean([(r.tail_probability >= 0.5) == (r.quality == 1) for r in held]) > 0.9


# language


def brute_phrases(corpus, text):
    n, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in corpus:
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


def plain_symbols(text):
    """One character for each symbol."""
    out = []
    for c in text.lower():
        if not c.isalpha():
            out += [" "] if not out or out[-1] != " " else []
        elif "a" <= c <= "z":
            out.append(c)
        else:
            out += [x for b in c.encode() for x in (f"{b >> 4:X}", chr(0x100 + (b & 15)))]
    return "".join(out)


def test_cross_parsing_equals_brute_force():
    import pyarrow as pa

    rng = random.Random(1)
    corpora = {x: "".join(rng.choice(a) for _ in range(400)) for x, a in (("p", "abcd "), ("q", "cdéñ "), ("r", "ae中文字 "))}
    model = language_id.fit(corpora)
    texts = ["".join(rng.choice("abcdé中i 1") for _ in range(rng.randint(1, 200))) for _ in range(40)]
    texts += ["".join(rng.choice("abcdé中文i ") for _ in range(12_000)), corpora["p"] * 40, corpora["r"] * 30, "zz" * 3000, "İstanbul ẞ", "a", "é"]
    from vantage.llm.textkernel import slices

    for _, _, data, off in slices(pa.array(texts)):
        cost, has = language_id._costs(model, data, off)
        for i, t in enumerate(texts):
            expected = [brute_phrases(plain_symbols(corpora[x]), plain_symbols(t)) for x in "pqr"]
            assert np.allclose(cost[i] / model.bits, expected) and has[i] == any(c.isalpha() for c in t)


def test_scripts_are_told_apart(spark, docs_of):
    rng = random.Random(5)
    words_of = {
        "zh": "我们 可以 研究 语言 模型 数据 质量 很好 学习 方法".split(), "ja": "私たち は 言語 モデル を 研究 する データ の 品質".split(), "ko": "우리는 언어 모델을 연구 합니다 데이터 품질 학습 방법".split(),
        "th": "เรา ศึกษา แบบ จำลอง ภาษา ข้อมูล คุณภาพ วิธี".split(), "ru": "мы изучаем языковые модели данные качество метод".split(), "el": "μελετάμε γλωσσικά μοντέλα δεδομένα ποιότητα μέθοδος".split(),
        "en": "we study language models data quality learning method".split(),
    }
    text = lambda x, n: " ".join(rng.choice(words_of[x]) for _ in range(n))
    model = language_id.fit({x: text(x, 400) for x in words_of})
    langs = list(words_of) * 3
    got = rows(language_id.predict(docs_of([text(x, 4 + 40 * (i // 7)) for i, x in enumerate(langs)]), model), "doc_id")
    assert [got[i].lang_pred for i in range(len(langs))] == langs
    twin = language_id.predict(docs_of(["zz qq"]), language_id.fit({"b": "aa bb cc", "a": "aa bb cc"})).first()
    assert twin.lang_pred == "a" and twin.score == pytest.approx(0.5)


def test_language_prediction(spark, sample, docs_of):
    model = language_id.train(sample, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = language_id.predict(sample, model).join(sample.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = rows(language_id.predict(docs_of(ODD), model), "doc_id")
    assert [odd[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and odd[0].score == 0 and odd[5].lang_pred in model.langs
    empty = language_id.train(sample.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs_of(ODD), empty).collect()} == {"und"}
    assert language_id.predict(sample.limit(0), model).count() == 0


# language model


def test_base_scores_equal_brute_force(spark, sample, monkeypatch):
    got = rows(lm_score.model_scores(sample), "doc_id")
    counts, total = Counter(), 0
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    docs = {r.doc_id: words(r.text) for r in sample.collect()}
    for i, w in docs.items():
        if fold(i):
            counts.update(w)
            counts[None] += 1
            total += len(w) + 1
    below = total + 0.1 * (len(counts) + 1)
    for i, w in docs.items():
        r = got[i]
        tokens = [*w, None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[t] > 0 for t in tokens), total, fold(i) == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / below) for t in tokens))
    counted = lm_score.counts(sample.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0))
    few = rows(lm_score.score(sample, counted, lm_score.fit(counted, 2000), hot_words=10), "doc_id")
    assert all(few[i].base_score == pytest.approx(got[i].base_score) and few[i].n_known == got[i].n_known and few[i].score == pytest.approx(got[i].score) for i in docs)


def plain_suffix_tree(texts):
    """log10 probability function of a plain suffix tree: counts by context string, the divergence test, mixing from short to long."""
    as_bytes = lambda t: [10, *" ".join([*words(t), ""]).encode(), 10]
    follow = defaultdict(Counter)
    for t in texts:
        s = as_bytes(t)
        for i in range(1, len(s)):
            for d in range(min(lm_score.DEPTH, i) + 1):
                follow[tuple(s[i - d : i])][s[i]] += 1
    kept = {}
    for c, own in follow.items():
        up, total = follow[c[1:]], sum(own.values())
        gain = sum(n * math.log(n / total / (up[x] / sum(up.values()))) for x, n in own.items()) - lm_score.PENALTY * len(own) * math.log(total)
        if c and gain > 0:
            kept[c] = (own, total, lm_score.WEIGHT * len(own))
    root = follow[()]

    def p(context, x):
        out = (root[x] + 0.5) / (sum(root.values()) + 128)
        for d in range(1, len(context) + 1):
            if context[-d:] in kept:
                own, total, w = kept[context[-d:]]
                out = (own[x] + w * out) / (total + w)
        return out

    def log_p(t):
        s = as_bytes(t)
        return sum(math.log10(p(tuple(s[max(0, i - lm_score.DEPTH) : i]), s[i])) for i in range(1, len(s)))

    return log_p, p, kept


@pytest.mark.parametrize("hot_pairs", [lm_score.HOT_PAIRS, 300, 0])
def test_suffix_tree_equals_plain_one(spark, docs_of, hot_pairs):
    rng = random.Random(8)
    vocab = "the cat sat on a mat Dog log née élan 😀 zz".split()
    texts = [*ODD[:5], *ODD[6:], *(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    texts += texts[-5:]
    docs = docs_of(texts)
    counted = lm_score.counts(docs.where("doc_id % 4 <> 0"))
    model = lm_score.fit(counted, hot_pairs)
    assert (model.rare is None) == (hot_pairs == lm_score.HOT_PAIRS)
    log_p, p, kept = plain_suffix_tree([t for i, t in enumerate(texts) if i % 4])
    assert model.kept == sum(len(own) for own, _, _ in kept.values()) > 300
    got = rows(lm_score.score(docs, counted, model), "doc_id")
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(log_p(t), rel=1e-5), t
    for context in [(), (10,), (32,), *list(kept)[::40]]:
        assert sum(p(context, x) for x in range(256)) == pytest.approx(1)


def test_every_context_that_passes_is_kept(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    _, _, kept = plain_suffix_tree([r.text for r in docs.collect()])
    model = lm_score.fit(lm_score.counts(docs), 1000)
    assert model.kept == sum(len(own) for own, _, _ in kept.values()) and len(kept) > 150_000


def test_contexts_help_on_unseen_words(spark, docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ba dul kin lo resh tor mi vex qua zed pho gi".split()) for _ in range(rng.randint(3, 5)))
    docs = docs_of([" ".join(word() for _ in range(40)) for _ in range(200)])
    counted = lm_score.counts(docs.where("doc_id % 4 <> 0"))
    model = lm_score.fit(counted)
    none = dataclasses.replace(model, tree=dataclasses.replace(model.tree, contexts=[np.zeros(0, np.int64)] * (lm_score.DEPTH + 1)))
    deep, flat = (lm_score.score(docs.where("doc_id % 4 = 0"), counted, m).agg(F.sum("score")).first()[0] for m in (model, none))
    assert deep > 0.6 * flat


def test_tasks_read_the_tree_once(spark, docs_of, monkeypatch):
    """A tree within the function goes as bytes, which a worker keeps beside the tree it reads from them."""
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    counted = lm_score.counts(docs)
    model = lm_score.fit(counted)
    assert sum(len(x) for x in model.tree.pairs) > 300_000
    sent, plain = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append((value, plain(self, value))) or sent[-1][1])
    assert lm_score.score(docs, counted, model).agg(F.sum("score")).first()[0] < 0
    assert sent and not any(isinstance(value, bytes) for value, _ in sent)
    assert not any(os.path.exists(b._path) for _, b in sent)


def test_memory_of_a_worker_grows_in_place():
    """Remembering more grams takes little beside what is remembered, and every gram keeps its own probability."""
    rng = np.random.default_rng(3)
    root = rng.random(256)
    none = [np.zeros(0, np.int64)] * (lm_score.DEPTH + 1)
    tree = lm_score.SuffixTree(root / root.sum(), none, none, none, none, none, None)
    grams = np.unique(rng.integers(256, 1 << 50, 1_500_000))
    parts = np.array_split(rng.permutation(grams), 15)
    tracemalloc.start()
    for part in parts[:-1]:
        tree.memory.probabilities(tree, np.sort(part))
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    for again in (parts[-1], np.concatenate([parts[0], parts[7]]), parts[-1]):
        gram = np.sort(again)
        log_p, more = tree.memory.probabilities(tree, gram)
        assert np.array_equal(log_p, np.log10(tree.root[gram & 255])) and not more.any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x.nbytes for x in tree.memory.known) > 1_300_000 * 17
    assert peak < 2.5 * held


def test_memory_belongs_to_its_tree(docs_of):
    model = lm_score.fit(lm_score.counts(docs_of(["the cat sat on the mat"] * 40)))
    bare = dataclasses.replace(model.tree, contexts=[np.zeros(0, np.int64)] * (lm_score.DEPTH + 1))
    text = np.random.default_rng(4).choice(np.frombuffer(b"acehmnost ", np.uint8), 200_000)
    _, stream, bounds = lm_score._stream(text, np.array([0, len(text)]))
    deep, flat = ([lm_score._tree_scores(t, stream, bounds)[0][0] for _ in range(2)] for t in (model.tree, bare))
    assert deep == pytest.approx([deep[0]] * 2) and flat == pytest.approx([np.log10(model.tree.root[stream]).sum()] * 2) and abs(deep[0] - flat[0]) > 1


def test_language_model_odd(spark, docs_of):
    got = lm_score.model_scores(docs_of(ODD)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert lm_score.model_scores(docs_of(ODD).limit(0)).count() == 0
    one = lm_score.model_scores(docs_of(["only held out"], ids=[next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)])).first()
    assert one.train_tokens == 0 and one.n_known == 0 and math.isfinite(one.score)


# pages

PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href=x>Home</a></li></ul></nav></header><div id="cookie-notice">We use cookies, ok?</div>
<main><article><header><h2>Title &amp; more</h2></header><p>First <b>bold</b> paragraph&nbsp;here,<br>with a break, and enough words to count as prose.
<p>Second &lt;p&gt; one, unclosed; it also has punctuation, and commas.<ul><li>Point one</li><li>Point <a href=y>two</a></ul>
<aside>Related stuff</aside><div class="share social"><a href=z>Share</a></div><p>Ok.</article>
<section class="comments"><p>A reader says, this is a very long comment, with commas, and more, and more words than the article.</p></section></main>
<form><label>Mail</label><input></form><div class="ad banner">Buy, buy, buy!</div><footer>&copy; us</footer><!-- <p>gone</p> --></body></html>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst bold paragraph here, with a break, and enough words to count as prose.\n\nSecond <p> one, unclosed; it also has punctuation, and commas.\n\nPoint one\n\nPoint two\n\nOk."
    plain = "<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div id=c><p>Some real text, that is long enough, of course.</p><p>And a second part, which is also long.</p></div><div><a href=q>link one</a> <a href=r>link two</a></div></body>"
    assert html_text.main_text(plain) == "Some real text, that is long enough, of course.\n\nAnd a second part, which is also long."
    for bad in (None, "", "<", "<p", "<p><b><i>", "<!-- x", "<script>", "no tags", "&am", "<a href='x", "</p></p>", "<p>" * 3000):
        assert isinstance(html_text.main_text(bad), str)
    assert html_text.main_text("<p>cut off &amp") == "cut off &"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (3, "v", "<article><p>" + LONG + "</p></article>")], "page_id long, url string, html string")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) == len(LONG)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_path_scores_equal_plain_ones():
    reader = html_text._Reader("<body><nav><a href=x>A b</a></nav><div><p>One, two. Three.</p><p>Four; five</p></div><ul class=x><li>six</li><li><a href=y>seven</a> 8</li></ul><p>Nine.</p></body>").read()
    found = reader.blocks
    way = lambda e: (*way(e.parent), e.tag) if e.parent else ()
    assert [(way(b.element), b.text, b.links) for b in found] == [
        (("body", "nav"), "A b", 3), (("body", "div", "p"), "One, two. Three.", 0), (("body", "div", "p"), "Four; five", 0), (("body", "ul", "li"), "six", 0), (("body", "ul", "li"), "seven 8", 5), (("body", "p"), "Nine.", 0),
    ]
    ratio = {}
    for p in {way(b.element) for b in found}:
        own = [b for b in found if way(b.element) == p]
        chars, marks, links = sum(len(b.text) for b in own), sum(len(re.findall("[.,;:!?]", b.text)) for b in own), sum(b.links for b in own)
        ratio[p] = math.log(1 + chars / len(own)) * (1 + math.log(1 + marks / len(own))) * (1 - links / chars)
    line = [ratio[way(b.element)] for b in found]
    smooth = [(line[0] * 2 + line[1]) / 3, *((line[i - 1] + 2 * line[i] + line[i + 1]) / 4 for i in range(1, 5)), (line[4] + line[5] * 2) / 3]
    got = html_text.path_scores(found)
    for p in ratio:
        own = [math.sqrt(line[i] * smooth[i]) for i, b in enumerate(found) if way(b.element) == p]
        assert got[next(b.element.path for b in found if way(b.element) == p)] == pytest.approx(sum(own) / len(own))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>T</h1><p>Long text, that has many words. Yes.</p><p><a href=x>See the full report</a></p><p class='related-work'>Others did this, too.</p></article>", "T|Long text, that has many words. Yes.|See the full report|Others did this, too."),
        ("<body><div class=widgets-page><p>Some prose, here.</p><p>More prose, there.</p></div>", "Some prose, here.|More prose, there."),
        ("<body><div class='layout no-sidebar'><div class=content><p>Some long prose, here it is, with commas.</p><ul><li>one</li><li>two</li></ul><table><tr><td>a<td>b</table></div></div><div class=sidebar><p>Bla, bla bla.</p></div>", "Some long prose, here it is, with commas.|one|two|a|b"),
        ("<div id='post-with-comments'><p>Prose, that stays. All of it.</p><div class='comment-list'><p>A comment, that goes. All of it.</p></div></div>", "Prose, that stays. All of it."),
        ("<form action=x><div><p>A page in a form, as some have. Really.</p></div><div class='share-buttons'>Share, share.</div></form>", "A page in a form, as some have. Really."),
        ("<main><p>Prose, of course. And more.</p><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul><p>End, at last.</p></main>", "Prose, of course. And more.|End, at last."),
        ("<article><p title='a > b'>Tom &amp; Jerry&nbsp;&lt;3, yes</p><p data-x=\"it's\">Don't, please. O&#39;K</p></article>", "Tom & Jerry <3, yes|Don't, please. O'K"),
        ("<article><p class=ad>Buy, buy.</p><p>A <b>b</b>\n c, d.<br>e</p><aside>No, no.</aside><blockquote>Said he, she said.</blockquote></article><footer>Us, we.</footer>", "A b c, d. e|Said he, she said."),
    ],
)
def test_main_text_of_ordinary_pages(page, text):
    assert html_text.main_text(page) == text.replace("|", "\n\n")


def test_hostile_pages_take_linear_time():
    import time

    pages = ["<div>" * 100_000 + "x, y." + "</div>" * 100_000, "<a x=\"1" + " <a b" * 100_000, "<p>" + "<x class='ad'>" * 100_000 + "hello", "<b><i></p>" * 100_000 + "hello", "<p>abc, def. " * 100_000, "<" * 200_000, "<li><p>" * 100_000 + "a.",
             "<a href=x>" * 100_000 + "<div>b" * 1000, "<table><tr><td>" * 50_000 + "c", "<!--" * 100_000, "<p x='" * 100_000, "&amp" * 100_000, "<script>" * 100_000]
    for page in pages:
        began = time.perf_counter()
        assert isinstance(html_text.main_text(page), str)
        assert time.perf_counter() - began < 8, page[:30]


# licences


def test_license_rules(spark, docs_of):
    bsd = [licenses.SENTENCES[i][0] for i in ("bsd-redistribution", "bsd-no-endorsement")]
    texts = [*ODD, "Text. Released under the MIT License. More", "LICENSED under   the apache license, version 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nx", bsd[0] + "\nsource.\n" + bsd[1], bsd[1] + "\n" + bsd[0], "licensed"]
    got = rows(licenses.scan(docs_of(texts)), "doc_id")
    assert {i: r.licenses for i, r in got.items()} == {10: "MIT", 11: "Apache-2.0 Apache-2.0-header", 12: "BSD-3-Clause", 13: ""}
    assert got[10].first_sentence == 2 and got[13].sentence_ids == "bsd-no-endorsement bsd-redistribution"
    assert licenses.scan(docs_of(texts).limit(0)).count() == 0


def test_licenses_wrapped_over_lines(docs_of):
    import textwrap

    full = {i: s[-1] for i, s in licenses.SENTENCES.items()}
    wrap = lambda ids, width, mark: "\n".join(mark + x for i in ids for x in textwrap.wrap(full[i], width, break_long_words=False))
    texts = [
        wrap(["mit-condition", "as-is"], 70, ""), wrap(["gpl-free", "gpl-warranty"], 60, " * "), wrap(["bsd-redistribution", "bsd-no-endorsement"], 1, "# "),
        "This project is\r\nlicensed under the MIT License.", "The software is provided \"as is\"\n\n" + full["as-is"][30:],
    ]
    got = rows(licenses.scan(docs_of(texts)), "doc_id")
    assert {i: r.licenses for i, r in got.items()} == {0: "MIT-text", 1: "GPL-3.0-or-later", 2: "BSD-3-Clause", 3: "MIT"}
    assert got[3].sentence_ids == "mit-notice" and got[3].first_sentence == 1


#: headers as they stand in source files, and the licences that they name; written down apart from the operator's tables
HEADERS = [
    ("# Copyright 2024 Someone\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n", "Apache-2.0 Apache-2.0-header"),
    ("/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including without limitation the rights\n"
     " * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n * copies of the Software, and to permit persons to whom the Software is\n * furnished to do so, subject to the following conditions:\n *\n * The above copyright notice and this permission notice shall be included in\n"
     " * all copies or substantial portions of the Software.\n */", "MIT-grant"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;\n", "GPL-2.0"), ("-- SPDX-License-Identifier: MIT\n", "MIT"),
    ("This is licensed under the MIT License.", "MIT"),
    ("; This Source Code Form is subject to the terms of the Mozilla Public\n; License, v. 2.0. If a copy of the MPL was not distributed with this file,\n; You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0 MPL-2.0-header"),
    (" * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.", "GPL-2.0-or-later"),
    ("This program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU Affero General Public License as published by the Free\nSoftware Foundation, either version 3 of the License, or (at your option) any\nlater version.", "AGPL-3.0-or-later"),
    ("Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list\nof conditions and the following disclaimer in the documentation and/or other\nmaterials provided with the distribution.", "BSD-2-Clause-text"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC-text"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense-text"), ("Text under CC0. To the extent possible under law, the author(s) have dedicated all copyright and\nrelated and neighboring rights to this software to the public domain worldwide.", "CC0-1.0-waiver"),
    ("Released under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", "BSL-1.0"), ("This program is licensed under the EUPL 1.2", "EUPL-1.2"), ("All rights reserved.", None),
]


def test_licence_headers_of_source_files(docs_of):
    got = rows(licenses.scan(docs_of([t for t, _ in HEADERS] * 2)), "doc_id")
    for i, (_, expected) in enumerate(HEADERS * 2):
        assert (got[i].licenses if i in got else None) == expected, (i, expected)
    assert len(licenses.NAMES) >= 25


# pipeline


ODD_ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "a"), (5, "alpha beta gamma delta epsilon zeta", "b"), (5, "one two three four five six seven", "a"), (8, "one two three four five six seven", None),
    (9, "la la la la la la la", "b"), (9, "la la la la la la la", "b"), (None, "no id here at all my friend", "a"), (None, None, None), (10, "", "a"), (11, None, "b"), (12, LONG, "a"), (12, LONG + " x", "b"),
]


@pytest.fixture
def odd_docs(spark):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ODD_ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", F.lit(1).alias("_row"), F.lit("x").alias("copies"), F.lit("y").alias("first"))


def held(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_pipeline_stages_on_odd_rows(spark, odd_docs):
    import corpus_pipeline as cp

    stages = dict(cp.STAGES)
    everything = Counter(ODD_ROWS)
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, odd_docs, SF).columns == odd_docs.columns and stage(spark, odd_docs.limit(0), SF).count() == 0, name
    assert held(stages["toxicity"](spark, odd_docs.withColumn("doc_id", F.col("doc_id") + 10**9), SF)).total() == len(ODD_ROWS)  # no labels: all stay
    once = held(stages["near_dedup"](spark, odd_docs, SF))
    expected = [r for r in ODD_ROWS if r[0] not in (8, 9) and r != ODD_ROWS[1] and r != ODD_ROWS[11]] + [ODD_ROWS[4]]
    assert once == Counter(expected)
    assert held(stages["decontamination"](spark, odd_docs, SF)) == everything
    mixed = held(stages["mixing"](spark, odd_docs, SF))
    assert set(mixed) <= set(everything) and all(n <= 2 * everything[r] for r, n in mixed.items())
    left = held(stages["quality"](spark, spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd_docs, allowMissingColumns=True), SF))
    assert not any(t is None or not t.strip() for _, t, _ in left) and left[9, "la la la la la la la", "b"] in (0, 2)
    assert labels.count() and items.count()


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "mixing"]
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = {r.doc_id: r.text for r in docs.collect()}
    tox = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()}
    stages = [f for _, f in cp.STAGES]
    now = cp.written(stages[0](spark, docs, SF))
    expected = {i: t for i, t in expected.items() if tox[i] < toxicity.THRESHOLD}
    assert {r.doc_id for r in now.collect()} == set(expected) and now.columns == docs.columns
    good = {r.doc_id: r.tail_probability for r in quality.scores(now, quality.train(now, labels)).collect()}
    now = cp.written(stages[1](spark, now, SF))
    expected = {i: t for i, t in expected.items() if good[i] >= quality.SELECT_AT}
    assert {r.doc_id for r in now.collect()} == set(expected)
    ids = sorted(expected)
    comp = brute_components([expected[i] for i in ids], 5, 80)
    now = cp.written(stages[2](spark, now, SF))
    expected = {i: expected[i] for n, i in enumerate(ids) if comp[n][1] == n}
    assert {r.doc_id for r in now.collect()} == set(expected)
    now = cp.written(stages[3](spark, now, SF))
    bench = [re.findall(r"[^\W_]+", r.text.lower()) for r in items.collect()]
    expected = {i: t for i, t in expected.items() if not any(e <= int(0.2 * len(b)) for e, b in zip(best_matches(bench, re.findall(r"[^\W_]+", t.lower())), bench, strict=True))}
    assert {r.doc_id for r in now.collect()} == set(expected) and all(len(b) >= 8 for b in bench)
    import duckdb

    from vantage.llm.queries import OP1_SQL

    con = duckdb.connect()
    con.register("documents", now.toPandas())
    copies = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({OP1_SQL}) WHERE copies > 0").fetchall()}
    assert Counter(r.doc_id for r in stages[4](spark, now, SF).collect()) == Counter(copies)
    whole = cp.run(spark, SF)
    assert Counter(r.doc_id for r in whole.collect()) == Counter(copies) and whole.columns == docs.columns


def best_matches(patterns, text):
    """Errors of the best semi-global match of each pattern: one row of the table for each word, all patterns at once."""
    width = max(map(len, patterns))
    number = {w: i for i, w in enumerate({w for p in patterns for w in p})}
    table = np.full((len(patterns), width), -1)
    for i, p in enumerate(patterns):
        table[i, : len(p)] = [number[w] for w in p]
    place = np.arange(width + 1)
    row = np.repeat(place[None, :], len(patterns), 0)
    ends = np.array([len(p) for p in patterns])
    best = row[np.arange(len(patterns)), ends].copy()
    for w in text:
        new = np.zeros_like(row)
        new[:, 1:] = np.minimum(row[:, :-1] + (table != number.get(w, -2)), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - place, axis=1) + place
        best = np.minimum(best, row[np.arange(len(patterns)), ends])
    return best.tolist()
