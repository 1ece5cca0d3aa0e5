"""The corpus pipeline: raw documents in, a deduplicated, mixed and tokenised corpus out.

Each stage works on what the one before it kept. ``run`` writes every stage's result
as Parquet into the folder that the executors share (``spark.checkpoint.dir``) and rereads it, so that a lost
executor never costs more than the stage at hand. Ids are integers, as in the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, line_dedup, mixing, quality, simhash
from factloom.llm.common import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all columns.

    Null, empty and blank texts go; a null in another column, a repeated row or id and a clashing
    column name change nothing. A score equal to the threshold stays. Long texts are judged
    whole. An empty table stays empty.
    """
    return quality.classify(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have, with all columns; ``n_chars`` follows the text.

    Of ties the smaller id, then the smaller digest of the text, keeps its lines; repeated rows change
    alike. A document that loses everything goes; one with a null id or text, or an empty text, stays as it is. Clashing column names are
    left alone. Long texts are aligned whole. An empty table stays empty.
    """
    return line_dedup.line_dedup(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, with all columns.

    Of rows that share an id those with the least text digest stay, repeated ones together. A null
    id or text and a text without a word take no part and stay. Clashing column names are left alone. Long
    texts are read whole. An empty table stays empty.
    """
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of characters for every source, with all columns; a document comes as often as it was drawn.

    A null source is a source of its own, a null or empty text has no characters, and a source without characters
    goes. Null ids come first in the order, ties go by digest, and repeated rows are drawn one by one.
    Clashing column names are left alone. Long texts count in full. An empty table stays empty.
    """
    return mixing.mix_sources(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (``token_ids``, ``n_tokens``) in place of texts, beside the other columns.

    A null text has null ids, an empty one none; repeated rows are encoded alike; input columns of the
    two names are replaced. A text of any length is encoded whole. An empty table stays empty.
    """
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("near dedup", one_of_each),
    ("source mixing", mix),
    ("bpe encoding", tokenise),
]

#: The classifier and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table. Of the written stages only the last one's input is left, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    jvm, sc = spark._jvm, spark.sparkContext
    base = shared_folder(spark)
    written: list[str] = []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        for old in written:
            place = jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
        written = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
