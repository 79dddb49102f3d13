"""Labelled rows to learn from: folds by document id and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import no_name_clash


def in_fold(doc_id: Column, of: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(of)) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, of: int, held_out: int, most: int,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of labelled documents outside the held-out fold, ``most`` or so at most, chosen by a hash of the id.

    Only ids and labels are sampled; as ``most`` bounds them, they are broadcast.
    Labels that repeat an id count as their largest; null ids and labels teach nothing.
    """
    known = (labels.select(F.col("doc_id").alias("k"), F.col(target).cast("int").alias("y")).dropna()
             .filter(~in_fold(F.col("k"), of, held_out)).groupBy("k").agg(F.max("y").alias("y")))
    share = min(1.0, most / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(sample), "k").select("text", "y")


def with_fold(df: DataFrame, of: int, held_out: int, doc_id: str = "doc_id") -> DataFrame:
    return no_name_clash(df, ["held_out"]).withColumn("held_out", in_fold(F.col(doc_id), of, held_out))
