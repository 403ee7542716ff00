"""From raw documents to token ids: the corpus operators as one pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

Rows: null, empty and blank texts have no words and go in the first stage, whose
base rules ask for fifty. Rows with a null id are judged by quality alone: none is
taken for a copy, nor another for a copy of it. Of equal rows one stays after
near-duplicates; rows of one id with unlike texts all stay. Texts of any length go
through whole. Columns beyond those of documents are kept, whatever their names,
by all stages but the last, which returns ids alone: (doc_id, n_tokens, ids,
decoded_sha256). Empty tables give an empty result. A document that the mix takes
twice is two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import minhash, mixing, pii, quality, sentencepieces
from quire.llm.common import table, written

#: Words of a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5
MODEL = "piece_bpe_32k.model"

#: A Viterbi path over lines has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate go."""
    return quality.keep_good(docs, quality.fit_chain(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return minhash.one_of_each(docs, SHINGLE_WORDS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the tag of its kind."""
    return pii.mask_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the source mix takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids with the end id, and what they decode to."""
    import public_tokenizers

    rows = sentencepieces.encode_documents(docs, public_tokenizers.path(MODEL))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", good_quality),
    ("minhash_dedup", one_of_each),
    ("personal_data", without_personal_data),
    ("source_mix", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
