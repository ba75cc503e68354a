"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents, whatever further ones there are. Null and repeated ids, null and empty texts, and empty tables are
taken by every stage: a null text is an empty one, rows are never told apart or dropped by their id alone, and an empty
table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hopmine.llm import exact_dedup, mixing, ngram_join, piece_bpe, toxicity
from hopmine.llm.common import shared_folder
from hopmine.llm.entry import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the threshold; the model learns from this input's labelled rows outside the held-out third.

    Texts without words score 0 and stay. Without labels of both kinds nothing is rejected.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one text, white space aside, the one with most code points, then the smallest id (null last); of rows equal in both one.

    Null and empty texts are one text, of which one row stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the row with the smallest id (null last), then the smallest digest of its text.

    Rows that share an id, or have none, are told apart by their texts. Texts without words are one group.
    """
    return ngram_join.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the last row of a source's budget as a whole; texts without words are never taken. A null source is one."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of every row's ids and of the text that they decode to, one row a row."""
    return piece_bpe.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_exact_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: The learned filter and the hash banding have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet in the shared folder and read again.

    A stage's input is deleted once its output is written; the last stage's stays, since its rows are yet to be read.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}")
        docs = spark.read.parquet(path)
        if i:
            _remove(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
