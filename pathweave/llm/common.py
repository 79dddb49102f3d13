"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a scratch folder where a local session has none (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="pathweave-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark makes by shuffles alone: a broadcast would collect it in the driver,
    which holds several of them at once where they grow with the input and are still below Spark's limit."""
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``.

    A lambda variable is computed once, where a repeated expression inside a
    higher-order function would be computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def no_name_clash(df: DataFrame, outputs: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (compared as Spark compares names)."""
    low = {c.lower() for c in outputs}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside ``extra``: internal names then clash with nothing."""
    row = F.struct("*") if df.columns else F.struct(F.lit(0).alias("_"))
    return df.select(row.alias("row"), *extra)


def without_space(text: Column) -> Column:
    """``text`` without the six ASCII white-space characters."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \n\t\r\x0b\x0c", text)


def count_of(text: Column, pattern: str) -> Column:
    """Number of matches of a pattern, such as a class of characters."""
    return F.regexp_count(text, F.lit(pattern))
