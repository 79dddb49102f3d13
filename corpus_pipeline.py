"""Corpus pipeline: filter, deduplicate, mix and pack the documents.

Five stages, each applied to all that the one before kept. A stage takes (spark,
docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Results are written as Parquet and read again between the stages.

Columns of ``docs`` come back as they are, whatever they are called: an operator sees the id,
text and source beside the whole row in one column under a private name. Null and empty texts are the empty
text, null ids are ids of their own, repeated rows are judged alike, and an empty table passes
through all stages as one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import minhash_forest, mixing, packing, quality_classifier, toxicity
from pathweave.llm.common import checkpointed, shared_dir, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


#: The whole row beside the columns that an operator reads.
ROW = "_pipeline_row"


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias(ROW), *columns)


def rows_of(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(ROW)[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; without usable labels, all. The empty text has no terms and stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return rows_of(toxicity.score(whole(docs, "doc_id", "text"), model).filter("predicted = 0"), docs)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; without usable labels, all. The empty text is scored as any other."""
    ensemble = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return rows_of(quality_classifier.score(whole(docs, "doc_id", "text"), ensemble).filter("predicted = 1"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id; texts without words all stay."""
    return rows_of(minhash_forest.drop_near_duplicates(whole(docs, "doc_id", "text")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each copy it takes; documents without words pass with their source's rate.

    Words are counted once: the mix reads them from the written rows.
    """
    counted = checkpointed(whole(docs, "doc_id", "source", mixing.word_count(F.col("text")).alias("_words")))
    return rows_of(mixing.emitted(mixing.mix_sources(counted, "_words")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the training sequences; an empty text is one piece of one token."""
    return packing.pack_documents(docs.select("doc_id", "text"), TOKENIZER).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Learned models, min-hashes and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
