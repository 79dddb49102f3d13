"""Prefix trie of conversations by ROLLUP.

A turn's id stands for its role and text. Each conversation is cut into blocks of
``WIDTH`` positions, and a block is one row: the key of the node that the conversation has
reached before it, and one column of turn ids for each position. GROUP BY key, ROLLUP
(positions) then aggregates every prefix of the block together, and grouping_id tells its
depth. A key is the digest of the prior block's node, so one ROLLUP serves all blocks
of all conversations, however long they are.

Sums over subtrees are a second ROLLUP of the same form. A node is owned by its smallest
member; as that member owns the rest of its own path as well, each node counts once, in the rows of
its owner, and what the owner holds in later blocks is added to each of its earlier ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.llm.common import WORD, checkpointed

#: Positions of a block.
WIDTH = 8
#: Ids of one node are joined in stretches of 2**8 numbers.
ID_STRETCH_BITS = 8
POSITIONS = [f"t{k}" for k in range(WIDTH)]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id struct<id, words>) of rows (conv_id, turn, role, text); pos counts from 0 by turn.

    Null turns come first; equal turns go by role and text, and repeated rows each count. A null role or text is
    empty. Rows without a conv_id belong to no conversation and are left out. Further columns are dropped.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    spelled = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return said.select(
        "conv_id", (F.row_number().over(order) - 1).alias("pos"),
        F.struct(F.unhex(F.sha2(F.encode(spelled, "UTF-8"), 256)).alias("id"),
                 F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")).alias("turn_id"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: ids (conv_id, length) and turns (conv_id, pos, turn_id).

    Every conversation c starts with the first h turns of conversation c - c % 20 (fewer if it has fewer), h = crc32 of
    c as decimal text % 4, and goes on with its own turns after its first h. It may be left without a turn.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    c = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"),
                       F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(4)).alias("h"))
    opening = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_length"))
    c = checkpointed(c.join(opening, "base", "left").withColumn(
        "shared", F.least("h", F.coalesce("base_length", F.lit(0))).cast("bigint")))
    ids = c.select("conv_id", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    base = turns.filter("pos < 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "turn_id")
    head = c.filter("shared > 0").select("conv_id", "base", "shared").join(base, "base").filter("pos < shared")
    own = turns.join(c.select("conv_id", "h", "shared"), "conv_id").filter("pos >= h")
    return ids, head.select("conv_id", "pos", "turn_id").union(
        own.select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).cast("int"), "turn_id"))


def blocks(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, length, block, key, t0, t1, ...): every block that a conversation reaches, the empty one after its end included.

    Only the digests of a conversation's full blocks, 32 bytes for ``WIDTH`` turns, come together
    in one row to be chained into keys.
    """
    at = [F.max(F.when(F.pmod("pos", F.lit(WIDTH)) == k, F.col("turn_id"))).alias(t) for k, t in enumerate(POSITIONS)]
    wide = turns.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).cast("int").alias("block")).agg(*at)
    full = wide.filter(F.col(POSITIONS[-1]).isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("block", _digest([F.col(t)["id"] for t in POSITIONS]).alias("digest")))).alias("full"))
    chain = F.aggregate(F.coalesce("full", F.expr("array()")), F.array(_root()), lambda keys, b: F.concat(
        keys, F.array(_digest([F.element_at(keys, -1), b["digest"]]))))
    keys = ids.join(full, "conv_id", "left").select("conv_id", "length", F.posexplode(chain).alias("block", "key"))
    return keys.join(wide, ["conv_id", "block"], "left")


def _root() -> Column:
    return F.unhex(F.lit("00" * 32))


def _digest(parts: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _node(level: int) -> Column:
    """Id of the node ``level`` positions after ``key``, from the columns t0 to t(level - 1)."""
    if level == 0:
        return F.col("key")
    path = _digest([F.col(t)["id"] for t in POSITIONS[:level]])
    return _digest([F.col("key"), path])


def _by_level(of, level: Column) -> Column:
    return F.coalesce(*[F.when(level == d, of(d)) for d in range(WIDTH + 1)])


def _rollup(spark: SparkSession, rows: DataFrame, measures: str) -> DataFrame:
    """All prefixes of all blocks: key, block, t0..., level and the measures; prefixes beyond a row's own end are none."""
    cols = ", ".join(POSITIONS)
    g = spark.sql(f"SELECT key, block, {cols}, grouping_id() AS g, {measures} FROM {{rows}} "
                  f"GROUP BY key, block, ROLLUP({cols})", rows=rows)
    # grouping_id has one bit for each column rolled up
    g = g.withColumn("level", WIDTH - F.bit_count("g")).drop("g")
    there = _by_level(lambda d: F.lit(True) if d == 0 else F.col(POSITIONS[d - 1]).isNotNull(), F.col("level"))
    return g.filter(there).filter("level > 0 or block = 0")


def _hash_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One SHA-256 a node over its stretches, which come in order; only the hash's state is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for n, ids in zip(batch["node"], batch["ids"]):
            if n != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations ``ids`` (conv_id, length) with ``turns`` (conv_id, pos, turn_id).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Conversations without turns are members of the root alone; equal conversations share all their nodes. An
    empty table has no nodes, not even the root.
    """
    spark = ids.sparkSession
    rows = checkpointed(blocks(ids, turns))
    level = F.col("level")
    words = _by_level(lambda d: F.lit(0).cast("bigint") if d == 0 else F.col(POSITIONS[d - 1])["words"], level)
    nodes = checkpointed(_rollup(spark, rows, "min(conv_id) AS conv_id, count(*) AS n_convs").select(
        "key", "block", *POSITIONS, "conv_id", "n_convs", (F.col("block") * WIDTH + level).cast("bigint").alias("depth"),
        _by_level(_node, level).alias("node"), _by_level(lambda d: _node(d - 1) if d else F.lit(None), level).alias("parent"),
        ((F.col("n_convs") - 1) * words).alias("own_saved")))

    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
                         .withColumn("leaf", (F.col("n_children") == 0).cast("bigint")))
    mine = nodes.filter("own_saved > 0 or leaf > 0").select("key", "block", *POSITIONS, "own_saved", "leaf", "conv_id")
    held = mine.groupBy("conv_id", "block").agg(F.sum("own_saved").alias("own_saved"), F.sum("leaf").alias("leaf"))
    later = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    tails = (rows.join(held, ["conv_id", "block"], "left")
             .select("key", "block", *POSITIONS, *[F.sum(c).over(later).alias(c) for c in ("own_saved", "leaf")], "conv_id")
             .filter("own_saved > 0 or leaf > 0"))
    sums = _rollup(spark, mine.union(tails), "sum(own_saved) AS saved_tokens, sum(leaf) AS n_leaves").select(
        _by_level(_node, level).alias("node"), "saved_tokens", "n_leaves")

    last = rows.filter(F.col("block") == F.floor(F.col("length") / WIDTH)).select(
        "conv_id", _by_level(_node, F.pmod("length", F.lit(WIDTH))).alias("node"))
    stretch = F.shiftright("conv_id", ID_STRETCH_BITS).alias("stretch")
    ends = (last.groupBy("node", stretch).agg(F.array_join(F.transform(
                F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
            .repartition("node").sortWithinPartitions("node", "stretch").select(F.hex("node").alias("node"), "ids")
            .mapInPandas(_hash_ends, "node string, ends_sha256 string").select(F.unhex("node").alias("node"), "ends_sha256"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(sums, "node").join(ends, "node", "left").join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")))
