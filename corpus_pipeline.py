"""From raw documents to packed training sequences.

Each stage takes what the one before it kept, as Parquet that was written and
read again, and calls one operator of ``corpusloom.llm``.  All but the last give
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import langid, packing, shingle_join, suffix_dedup, toxicity
from corpusloom.llm.common import table, written
from corpusloom.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, with all their columns.

    The classifier learns from the labels of ``sf_dir``.  Null and empty texts get the score of
    a text without features; repeated rows share their fate; without labels of both classes all
    stay, unless all labels are toxic; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted, with all their columns.

    The model learns from the texts and languages of ``docs``.  Texts that are null or have no
    letter have no language and go; with no language to learn from all stay; repeated rows
    share their fate; an empty table stays empty.
    """
    return langid.identified_only(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Texts are linked at a similarity of 0.8 of their five-word shingles: candidates come from
    the SimHash trie join and from shared rare shingles, and all are checked exactly.  Null and
    blank texts are equal to each other; rows without a doc_id stay; of rows that repeat a kept
    doc_id one stays; an empty table stays empty.
    """
    return shingle_join.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 50-byte strings that start in a document with a smaller doc_id.

    Null text becomes empty; rows that share a doc_id don't take each other's bytes; rows
    without one come last; ``n_chars`` is counted anew; other columns, whatever their names,
    stay as they are; an empty table stays empty.
    """
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of a power of two, none across documents.

    A null or empty text has one id, the end of its document; repeated rows are packed each;
    columns other than doc_id and text are left out; an empty table gives no rows.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("packing", pack_sequences),
]

#: The stages hold trained models and tokenizer ids, which SQL can't express.  The tests compare near_duplicates,
#: repeated_passages and packing with brute force, and the two filters with their operators' own scores of each text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
