"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Statistics are column expressions. A forest of shallow trees is grown on a bounded
sample of labelled rows; every path from a root is a rule, a conjunction of bounds
on statistics. A logistic model with an L1 penalty gives most rules no weight, and the
rest compile into one column expression, so that scoring is a projection
without joins, shuffles or user functions.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import WORD, checkpointed, count_of, let, no_name_clash, without_space
from pathweave.llm.labelled import training_rows, with_fold
from pathweave.llm.quality_rules import STOP_WORDS, SYMBOL

TARGET, FOLDS, HELD_OUT = "quality", 3, 1
#: Labelled rows to learn from, at most (about), and the tasks that hold them once they are found.
MOST_TRAINING_ROWS, TRAINING_TASKS = 20_000, 6
TREES, DEPTH, PENALTY, SEED = 24, 3, 2e-3, 11
#: Weights below this are no rule.
LEAST_WEIGHT = 1e-6


def statistics(text: Column) -> Column:
    """Statistics of a text as one struct of doubles; null is the empty text, ratios over nothing are 0."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    def of(x: Column) -> Column:
        words, n = x["words"], F.size(x["words"])
        lines, k = x["lines"], F.size(x["lines"])
        chars = F.length(without_space(t))
        # each word with the next one, as 64-bit numbers
        pairs = F.transform(F.arrays_zip(F.slice(words, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(words, 2, n).alias("b")), lambda p: F.xxhash64(p["a"], p["b"]))
        return F.struct(
            F.log1p(n.cast("double")).alias("words"),
            share(chars, n).alias("word_length"),
            share(count_of(t, SYMBOL), n).alias("symbols"),
            share(count_of(t, r"\|"), n).alias("bars"),
            share(count_of(t, "[!?]"), n).alias("exclamations"),
            share(count_of(t, "[.,;:]"), n).alias("punctuation"),
            share(count_of(t, r"[{}\[\]()=_/\\@]"), n).alias("code_signs"),
            share(count_of(t, "[0-9]"), chars).alias("digits"),
            share(count_of(t, r"\p{Lu}"), chars).alias("capitals"),
            share(F.size(F.array_distinct(words)), n).alias("distinct_words"),
            share(F.size(F.array_distinct(pairs)), n - 1).alias("distinct_pairs"),
            share(F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))), n).alias("stop_words"),
            share(k - F.size(F.array_distinct(lines)), k).alias("repeated_lines"),
            share(n, k).alias("line_words"),
        )

    return let(F.struct(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)).alias("words"),
                        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines")), of)


STATISTICS = ("words word_length symbols bars exclamations punctuation code_signs digits capitals "
              "distinct_words distinct_pairs stop_words repeated_lines line_words").split()


class Bound(NamedTuple):
    statistic: str
    above: bool
    value: float

    def column(self) -> Column:
        s = F.col("statistics")[self.statistic]
        return s > self.value if self.above else s <= self.value


Conjunction = tuple[Bound, ...]


def tree_rules(tree: str, names: list[str]) -> list[Conjunction]:
    """The rules of a tree as Spark prints it: the bounds on the way to each of its nodes but the root."""
    rules, way = [], []
    for line in tree.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if found:
            depth = len(found[1])
            way = [x for x in way if x[0] < depth] + [(depth, Bound(names[int(found[2])], found[3] == ">", float(found[4])))]
            rules.append(tuple(b for _, b in way))
    return rules


def simplified(rule: Conjunction) -> Conjunction:
    """The same rule with the tightest bound for each statistic and side, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for b in rule:
        k = b.statistic, b.above
        tight[k] = b.value if k not in tight else (max if b.above else min)(tight[k], b.value)
    return tuple(Bound(*k, v) for k, v in sorted(tight.items()))


def holds(rule: Conjunction) -> Column:
    return reduce(lambda a, b: a & b, [b.column() for b in rule])


class Ensemble(NamedTuple):
    """Rules with weights; of no rules, the score is the share that the intercept stands for."""

    rules: tuple[tuple[Conjunction, float], ...]
    intercept: float

    def column(self) -> Column:
        """The score from the column ``statistics``."""
        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_TRAINING_ROWS,
        trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """An ensemble from labelled rows outside the held-out fold, about ``most`` of them at most.

    Without labels the score is 1; with one class only it is near that class.
    """
    train = training_rows(docs, labels, TARGET, FOLDS, HELD_OUT, most, doc_id, text)
    # the scan, the join and the statistics keep a task for each split; only the statistics of the rows found are dealt anew
    stats = train.select(F.col("y").cast("double").alias("y"), statistics(F.col("text")).alias("statistics"))
    stats = checkpointed(stats.repartition(TRAINING_TASKS, F.hash("statistics")))
    share = stats.agg(F.avg("y")).first()[0]
    if share is None:
        return Ensemble((), 30.0)
    if share in (0.0, 1.0):
        return Ensemble((), 6.0 if share else -6.0)
    # half of the weight to each class, so that rules of the rare one are found
    weight = F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    flat = VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(
        stats.select("y", weight.alias("w"), "statistics.*"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, seed=SEED,
                                    subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(flat)
    rules = list(dict.fromkeys(simplified(r) for t in forest.trees for r in tree_rules(t.toDebugString, STATISTICS)))
    names = [f"r{i}" for i in range(len(rules))]
    hits = checkpointed(stats.select("y", *[holds(r).cast("double").alias(n) for r, n in zip(rules, names, strict=True)]))
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(
        VectorAssembler(inputCols=names, outputCol="x").transform(hits).select("x", "y"))
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > LEAST_WEIGHT]
    return Ensemble(tuple(weights), float(lasso.intercept))


OUTPUTS = ["held_out", "score", "predicted"]


def score(docs: DataFrame, ensemble: Ensemble, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted.

    Each row is scored on its whole text, null as empty. Input columns named like an
    output are replaced, others stay; an empty table gives an empty table. Null ids are not held out.
    """
    rest = no_name_clash(docs, [c for c in OUTPUTS if c not in (doc_id, text)])
    # a generated column: filters on the score then stay above it, and it is computed once
    row = rest.select(F.struct("*").alias("row"), F.explode(F.array(statistics(F.col(text)))).alias("statistics"))
    out = row.withColumn("score", ensemble.column()).select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    return with_fold(out, FOLDS, HELD_OUT, doc_id)
