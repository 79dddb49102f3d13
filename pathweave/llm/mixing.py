"""Mix sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, r = target
of the source / size of the source. Documents are put in order of size within
their source, their expected copies are prefix-summed, one random offset per
source is added, and a document is emitted once for each integer boundary that
its interval crosses. As the order follows the size, each stretch of like sizes
is taken at the rate r, so the words taken miss the target by about the size of
one document.

The prefix sum holds no source in one task: documents fall into cells (source,
size class, salt); only the counts of cells are summed across tasks, and
a row number within its cell places the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import WORD, checkpointed, no_name_clash, packed

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: A size class gets one more salt for so many documents of the whole input.
ROWS_PER_SALT = 2000
#: Fixed-point bits of the fraction of a copy.
BITS = 30
OUTPUTS = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hex_number(of: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(of), 1, digits), 16, 10).cast("bigint")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets of sources from their sizes: columns sn (source is null), sk (source), n, source_size.

    Weights repeat in order of the source name (code points, null last). A
    target stops at ``cap`` times the source's size; what is above is shared
    again by weight. The end of that sharing is target = min(cap * size,
    level * weight) with one level for all, found in order of cap / weight.
    """
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = (totals.withColumn("rn", F.row_number().over(Window.orderBy("sn", "sk")))
         .withColumn("w", pick).withColumn("most", F.col("source_size") * cap))
    below = Window.orderBy(F.col("most") / F.col("w"), "sn", "sk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(below), F.lit(0)))
                     / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0))))
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))).over(whole))
    return w.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")))


def mix_sources(docs: DataFrame, size: str, source: str = "source", tie: tuple[str, ...] = ("doc_id",),
                weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with source_size, target, copies (long) and taken = copies * size.

    ``size`` names a column of whole numbers (null: 0). Null sources are one
    source, the last. ``tie`` orders documents of equal size; rows equal in it
    share their copies in any order. Sources whose documents all have size 0
    pass once. Input columns named like an output are replaced; others stay.
    No document gets more than ``cap`` copies, as no target is above
    ``cap`` times its source's size. An empty table gives an empty table.
    """
    out = [c for c in OUTPUTS if c != size]
    tie_text = F.concat_ws("\x1f", *[F.coalesce(F.col(t).cast("string"), F.lit("\x1e")) for t in tie])
    n_words = F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint"))
    keys = [
        F.col(source).isNull().alias("sn"), F.coalesce(F.col(source), F.lit("")).alias("sk"),
        F.when(n_words <= 0, F.lit(-1)).otherwise(F.floor(F.log2(n_words.cast("double")) * 16)).cast("int").alias("klass"),
        _hex_number(tie_text, 8).alias("h"), n_words.alias("words"),
    ]
    narrow = checkpointed(docs.select(*keys))
    totals = narrow.groupBy("sn", "sk").agg(F.count("*").alias("n"), F.sum("words").alias("source_size"))
    salts = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // ROWS_PER_SALT
    salt = F.pmod(F.col("h"), F.lit(salts)).alias("salt")

    cells = narrow.select("sn", "sk", "klass", salt).groupBy("sn", "sk", "klass", "salt").agg(F.count("*").alias("n"))
    classes = cells.groupBy("sn", "sk", "klass").agg(F.sum("n").alias("n"))
    before = Window.unboundedPreceding, -1
    zero = F.lit(0).cast("bigint")
    classes = classes.select("sn", "sk", "klass", F.coalesce(
        F.sum("n").over(Window.partitionBy("sn", "sk").orderBy("klass").rowsBetween(*before)), zero).alias("class_at"))
    share = (source_targets(totals, weights, cap)
             .withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)))
             .select("sn", "sk", "source_size", "target",
                     F.floor("r").alias("whole"), F.round((F.col("r") - F.floor("r")) * 2**BITS).cast("bigint").alias("part"),
                     F.shiftright(_hex_number(F.concat(F.lit(seed + "/"), F.col("sk"), F.col("sn").cast("string")), 8), 2).alias("u")))
    cells = (cells.withColumn("at", F.coalesce(F.sum("n").over(
                 Window.partitionBy("sn", "sk", "klass").orderBy("salt").rowsBetween(*before)), zero))
             .join(classes, ["sn", "sk", "klass"]).join(share, ["sn", "sk"])
             .select("sn", "sk", "klass", "salt", (F.col("at") + F.col("class_at")).alias("base"),
                     "source_size", "target", "whole", "part", "u"))

    rows = packed(docs, *keys, tie_text.alias("t")).withColumn("salt", salt)
    place = Window.partitionBy("sn", "sk", "klass", "salt").orderBy("words", "h", "t")
    k = F.col("base") + F.col("k")
    crossed = F.shiftright(F.col("part") * k + F.col("u"), BITS) - F.shiftright(F.col("part") * (k - 1) + F.col("u"), BITS)
    rows = (rows.withColumn("k", F.row_number().over(place))
            .join(cells, ["sn", "sk", "klass", "salt"])
            .withColumn("copies", (F.col("whole") + crossed).cast("bigint")))
    keep = no_name_clash(docs, out).columns
    return rows.select(*[F.col("row")[c].alias(c) for c in keep], "source_size", "target", "copies",
                       (F.col("copies") * F.col("words")).alias("taken"))


def emitted(mixed: DataFrame) -> DataFrame:
    """One row per copy that ``mix_sources`` takes, numbered from 1 in ``copy``."""
    numbers = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    return mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(numbers))
