"""Queries over the tables of a folder, one for each operator."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bbit_minhash, best_fit, block_anchors, pivot_index, pivotal_mix, suffix_family, token_blocks, toxicity, voronoi_knn, word_lm

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # workers import this package from where the driver has it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lm.scored(table(spark, sf_dir, "documents"), order=5)


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.groups(table(spark, sf_dir, "documents"), threshold=0.5)


def op3_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.repeated_spans(table(spark, sf_dir, "documents"), min_words=50)


def op4_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.repeated_spans(table(spark, sf_dir, "documents"), min_words=50)


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.encode(table(spark, sf_dir, "documents"))


def op6_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.copies(table(spark, sf_dir, "documents"), alpha=0.7)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.packed(table(spark, sf_dir, "documents"), capacity=2048)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a search: every 50th vector asks, all answer
    return voronoi_knn.neighbours(table(spark, sf_dir, "embeddings"), k=10, every=50)


# what SQL can say of operators whose full result it can't express


def lm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_ngram_lm(spark, sf_dir).select("doc_id", "n_words")


def token_blocks_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.decoded(op5_token_blocks(spark, sf_dir))


def mix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source its documents, the copies that its weight asks for, and whether it got them to less than one."""
    got = op7_pivotal_mix(spark, sf_dir).groupBy("source").agg(F.sum("copies").alias("got"))
    asked = pivotal_mix.expected(table(spark, sf_dir, "documents"), alpha=0.7).withColumn("asked", F.col("n") * F.col("expected"))
    return asked.join(got, "source").select("source", "n", F.round("asked", 4).alias("asked"), (F.abs(F.col("got") - F.col("asked")) < 1).alias("met"))


def packing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the words in its pieces, and the fullest bin that any lies in, against the capacity."""
    pieces = op8_best_fit(spark, sf_dir)
    fill = pieces.groupBy("bin_id").agg(F.sum("n_words").alias("fill"))
    return pieces.join(fill, "bin_id").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), (F.max("fill") <= 2048).alias("fits"))


#: white space as Unicode has it, which separates words in all operators
_SPACE = "[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_WORDS = f"list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '')"

#: every window of 50 words, the least occurrence of its text, and runs of windows that repeat one original
_REPEATS = f"""
    WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    one AS (SELECT doc_id, len(w) AS n, min(w) AS w FROM d WHERE len(w) >= 50 GROUP BY ALL),
    p AS (SELECT doc_id, n, pos, array_to_string(w[pos + 1 : pos + 50], ' ') AS words FROM (SELECT doc_id, n, w, unnest(range(n - 49)) AS pos FROM one)),
    f AS (SELECT *, first_value({{'d': doc_id, 'n': n, 'p': pos}}) OVER (PARTITION BY words ORDER BY doc_id, n, pos) AS r FROM p),
    h AS (SELECT doc_id, n, pos, r.d AS ref, r.p - pos AS shift FROM f WHERE (doc_id, n, pos) <> (r.d, r.n, r.p)),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, n, ref, shift ORDER BY pos) AS island FROM h)
    SELECT doc_id, n::BIGINT AS n_words, min(pos)::BIGINT AS start_word, (max(pos) - min(pos) + 50)::BIGINT AS length,
        ref AS ref_doc_id, (min(pos) + shift)::BIGINT AS ref_start_word
    FROM i GROUP BY doc_id, n, ref, shift, island"""

#: exact Jaccard similarities; the operator estimates them, so the two may differ by pairs that lie near the threshold
_NEAR = f"""
    WITH RECURSIVE t AS (SELECT doc_id, lower(min(text)) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id),
    w AS (SELECT doc_id, list_filter(list_transform({_WORDS}, lambda x: regexp_replace(x, '[^\\pL\\pN]', '', 'g')), lambda x: x <> '') AS w FROM t),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS k FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    near AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.5 * (x.n + y.n - shared)),
    reached(doc_id, least) AS (SELECT DISTINCT a, a FROM near UNION SELECT near.b, r.least FROM reached r JOIN near ON near.a = r.doc_id)
    SELECT doc_id, min(least) AS group_id, doc_id = min(least) AS keep FROM reached GROUP BY doc_id"""

_VECTORS = "v AS (SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id)"


def queries() -> dict[str, Query]:
    found = (
        op1_ngram_lm, op2_bbit_minhash, op3_block_anchors, op4_suffix_family, op5_token_blocks,
        op6_pivot_index, op7_pivotal_mix, op8_best_fit, op9_toxicity, op10_voronoi_knn,
    )
    beside = (lm_words, token_blocks_text, mix_totals, packing_words)
    return {f.__name__: f for f in (*found, *beside)}


def oracle_sql() -> dict[str, str]:
    return {
        "lm_words": f"SELECT doc_id, len({_WORDS})::BIGINT AS n_words FROM documents",
        "token_blocks_text": "SELECT doc_id, text FROM documents",
        "mix_totals": """
    WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), m AS (SELECT max(n / n ** 0.7) AS scale FROM s)
    SELECT source, n, round(n ** 0.7 * scale, 4) AS asked, true AS met FROM s, m""",
        "packing_words": f"SELECT doc_id, len({_WORDS})::BIGINT AS n_words, true AS fits FROM documents WHERE len({_WORDS}) > 0",
        "op2_bbit_minhash": _NEAR,
        "op3_block_anchors": _REPEATS,
        "op4_suffix_family": _REPEATS,
        "op6_pivot_index": f"""
    WITH RECURSIVE {_VECTORS},
    u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.95),
    reached(vec_id, least) AS (SELECT vec_id, vec_id FROM u UNION SELECT p.b, r.least FROM reached r JOIN p ON p.a = r.vec_id)
    SELECT vec_id, min(least) AS class_id, (SELECT count(*) FROM p WHERE p.a = reached.vec_id) AS links FROM reached GROUP BY vec_id""",
        "op10_voronoi_knn": f"""
    WITH {_VECTORS},
    p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM p)
    SELECT query_id, neighbor_id, rank::INTEGER AS rank, round(d, 6) AS distance FROM r WHERE rank <= 10""",
    }
