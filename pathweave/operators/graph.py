"""Connected components of links between values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pathweave.session import checkpoint_dir


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of ``links`` (a, b); the component is its smallest id.

    Each round points every id at the smallest of itself and its neighbours, follows the pointers
    to their ends by doubling and contracts the graph, which at least halves it. Minima are
    combined before their shuffle; each step is checkpointed, as rounds would else repeat all before them.
    """
    checkpoint_dir(links.sparkSession)
    left = links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct().checkpoint()
    rounds = []
    while not rounds or not left.isEmpty():
        to = left.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).checkpoint()
        while True:
            end = to.select(F.col("a").alias("to"), F.col("to").alias("end"))
            further = to.join(end, "to").select("a", "to", "end").checkpoint()
            done = further.where("to != end").isEmpty()
            to = further.select("a", F.col("end").alias("to"))
            if done:
                break
        rounds.append(to)
        for side in ("a", "b"):
            at = to.select(F.col("a").alias(side), F.col("to").alias("_to"))
            left = left.join(at, side).drop(side).withColumnRenamed("_to", side)
        left = left.select("a", "b").where("a != b").distinct().checkpoint()
    ids = reduce(lambda x, to: x.join(to.select(F.col("a").alias("at"), "to"), "at", "left").select(
        "id", F.coalesce("to", "at").alias("at")), rounds, rounds[0].select(F.col("a").alias("id"), F.col("a").alias("at")))
    return ids.withColumnRenamed("at", "component")
