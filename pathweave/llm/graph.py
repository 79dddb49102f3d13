"""Connected components of links between ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import checkpointed, merged


def _kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and read as rows of unknown number.

    A checkpoint keeps Spark's guess of its size, which for a join is the product of its sides: over the rounds
    the guess's digits would double with each join, until plans take the driver minutes.
    """
    rows = checkpointed(df)._jdf
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id in ``edges``; the component is its smallest id.

    Each round maps every id to the smallest among itself and its neighbours, follows
    that map to its end by doubling, and contracts the graph by it. As every id that is its
    own end has a neighbour that isn't, a round at least halves the ids of a component, and
    a long path costs the logarithm of its length.
    The minimum is pre-aggregated before it is shuffled, and the joins carry
    nothing above them that needs a key whole, so Spark can split a hub's edges. No join is a
    broadcast: the maps grow with the ids, and as many are joined at the end as there were rounds.
    Rows with a null end and loops are no links.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a != b")
    left = _kept(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps = []
    while not maps or not left.isEmpty():
        m = _kept(left.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        moved = True
        while moved:
            at = m.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
            on = _kept(m.join(merged(at), m["to"] == at["_a"]).select("a", F.col("_to").alias("to"), (F.col("to") != F.col("_to")).alias("moved")))
            m, moved = on.select("a", "to"), not on.filter("moved").isEmpty()
        maps.append(m)
        at = m.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
        for end in ("a", "b"):
            left = left.join(merged(at), left[end] == at["_a"]).select(F.col("_to").alias(end), "b" if end == "a" else "a")
        left = _kept(left.filter("a != b").distinct())

    def follow(labels: DataFrame, m: DataFrame) -> DataFrame:
        step = m.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
        return labels.join(merged(step), labels["to"] == step["_a"], "left").select("a", F.coalesce("_to", "to").alias("to"))

    return reduce(follow, maps).select(F.col("a").alias("id"), F.col("to").alias("component"))
