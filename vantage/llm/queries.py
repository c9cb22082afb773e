"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html_text, language_id, licenses, lm_score, mixing, near_dup, quality, toxicity
from .shared import bounded_batches, documents, fold

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS key, len({_WORDS.format('text')}) AS size, md5(concat_ws(':', doc_id::VARCHAR, text)) AS digest FROM documents),
r AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class, substr(digest, 1, 2) AS slice, substr(digest, 3, 16) AS place FROM d),
a AS (SELECT doc_id, key, size, row_number() OVER (PARTITION BY key ORDER BY class, slice, place, doc_id) AS pos FROM r),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS ceiling FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY ceiling / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT key, source_size, CASE WHEN level * weight >= ceiling THEN ceiling
      ELSE weight * (SELECT max(level) FROM l WHERE level * weight < ceiling) END AS target FROM l),
c AS (SELECT a.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('1:' || key), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM a JOIN t USING (key))
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * n)::BIGINT AS taken, n AS copies
FROM (SELECT *, (floor(rate * pos + u) - floor(rate * (pos - 1) + u))::BIGINT AS n FROM c)
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.scores(docs, quality.train(docs, labels))
    return scored.withColumn("kept", F.col("tail_probability") >= quality.SELECT_AT)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 5) == 0
    model = language_id.train(docs, where=~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.model_scores(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def _op9_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in sorted(licenses.known_sentences().items()))
    hits = ", ".join(f"CASE WHEN regexp_matches(' ' || ids || ' ', '{licenses.pattern(*ids)}') THEN '{name}' END" for name, *ids in licenses._by_name(licenses.RULES))
    return f"""
WITH k(s, id) AS (VALUES {known}),
c AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(translate(text, '{_UP}', '{_LOW}'), '(?m)^[\\x20\\x09]*[;!]+', '', 'g'), '([.!?;])[\\x20\\x09\\x0B-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)) AS cut FROM documents),
u AS (SELECT doc_id, unnest(cut) AS s, unnest(range(1, len(cut) + 1)) AS pos FROM c),
m AS (SELECT u.doc_id, u.pos, k.id FROM u JOIN k ON k.s = regexp_replace(trim(regexp_replace(u.s, '[^a-z0-9.+]+', ' ', 'g')), '[. ]+$', '')),
g AS (SELECT doc_id, string_agg(id, ' ' ORDER BY pos) AS ids, min(pos) AS first_sentence FROM m GROUP BY doc_id)
SELECT doc_id, ids AS sentence_ids, first_sentence, array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ' ') AS licenses FROM g
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold(F.col("doc_id"), 3) == 1
    scored = toxicity.scores(docs, toxicity.train(docs, labels, where=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending_start", "offending_end")


OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UP}', '{_LOW}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(root) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""

QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_decontaminate, op3_fingerprints, op4_quality, op5_html_text, op6_near_duplicates, op7_language_id, op8_lm_score, op9_licenses, op10_toxicity)
}
ORACLES = {"op1_mix_sources": OP1_SQL, "op6_near_duplicates": OP6_SQL, "op9_licenses": _op9_sql()}
