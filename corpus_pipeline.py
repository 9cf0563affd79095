"""The corpus pipeline: quality, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import adaptive_quality, anchor_simhash, byte_bpe, chaining, es_mixing
from loamline.llm.queries import multilingual_tokenizer
from loamline.llm.storage import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents far outside what their language and source usually show.

    Short texts aren't junk as such, so the fixed base rule of the query is
    off. Every row is judged by itself, repeated and null ids included; rows
    without words (null, empty, blank texts) are kept, null languages and
    sources are groups of their own, long texts are measured whole. An empty
    table gives an empty one; other columns are carried along.
    """
    return adaptive_quality.without_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of texts with five-word Jaccard similarity of 0.8 or more.

    The smallest id stays, null ids last; rows are dropped by id and text, so
    another text of a repeated id stays, and of rows equal in both one stays.
    All texts without words are copies of one another. An empty table gives an
    empty one; other columns are carried along.
    """
    return anchor_simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more out of all documents but the first that has them.

    Documents come in the order of their ids, texts of one id by a hash. Rows
    with a null id and texts without such a passage (null, empty and short ones
    as well) come back as they are; a text of which nothing is left is dropped.
    An empty table gives an empty one; other columns are carried along.
    """
    return chaining.without_passages(docs, chaining.passages(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights.

    A null source is a source of its own; null and empty texts weigh nothing
    and are left out; rows equal in id, size and key share the decision. An
    empty table gives an empty one; other columns are carried along.
    """
    return es_mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that the mix takes (little-endian uint32), with digests of ids and decoded bytes.

    One row per row, whatever its id; a null text counts as empty. An empty
    table gives an empty one.
    """
    out = byte_bpe.encode(docs, *multilingual_tokenizer(), with_decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Sketches, fingerprints, chains and a tokeniser have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
