"""A training-data pipeline: five stages over the documents of a folder.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last says in which training sequence each piece of each document lies. All take null ids, texts,
languages and sources, empty and very long texts, repeated rows, further columns of any name and empty tables; what
becomes of them is said at each stage. A word is what lies between Unicode white space, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import bbit_minhash, best_fit, pivotal_mix, suffix_family, toxicity
from folio.llm.common import forget, keep, scope
from folio.llm.queries import table

NEAR, REPEAT_WORDS, ALPHA, CAPACITY = 0.5, 50, 0.7, 2048


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the folder's labels, calls toxic go.

    Null and empty texts stay; a null or unknown language takes the common threshold; repeated rows go or stay together.
    """
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the least doc_id.

    Rows with a null doc_id or text, or a text without words, are in no group and stay. Of rows that repeat doc_id and text
    one stays, unless the doc_id is null.
    """
    return bbit_minhash.first_of_each(docs, NEAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first document only; a document that loses all its words goes.

    Rows with a null doc_id or text, and texts of fewer than 50 words, stay as they are; repeated rows lose the same words.
    """
    return suffix_family.without_repeats(docs, REPEAT_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources occur as their size to the power 0.7; each document stays at least once, small sources repeat.

    A null source is a source; a row with a null doc_id stays once; rows that repeat doc_id and source get equal copies.
    """
    return pivotal_mix.mixed(docs, alpha=ALPHA)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 words: bin_id, doc_id, start_word, n_words.

    Null and empty texts have no words to pack; a null doc_id is packed and stays null; repeated rows are packed each.
    """
    return best_fit.packed(docs, CAPACITY)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("packing", packing)]

#: Training, random rounding and bin packing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        with scope(spark):
            done = keep(stage(spark, docs, sf_dir), name, outside=True)
        if n:
            forget(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
