"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Documents of equal text are one indivisible group. Groups of at least 1/4096 of all
bytes are items of their own; the others fall by hash into 4096 cells, and a
cell is an item. So at most 8192 items stand for any number of documents.
Each item starts as a partial partition that has all its bytes in one part; the
two partial partitions of largest spread are combined, the fullest part of one with the
emptiest of the other, until one is left: its parts are the shards.

The bytes of items, their counts and places are what the driver holds. Spark digests the texts
once, sums groups (partially before the shuffle) and numbers documents within salts
of an item, so that a group that holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import checkpointed, no_name_clash

SHARDS = 16
#: Cells for groups below 1/CELLS of all bytes: so many hexadecimal digits of the digest, as 16**3 = 4096.
CELL_DIGITS = 3
CELLS = 16**CELL_DIGITS
#: An item gets one more salt for so many of its documents.
ROWS_PER_SALT = 2000
OUTPUTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def differencing(sizes: Sequence[int], ways: int) -> list[int]:
    """The part, 0 to ways - 1, of each item. Part 0 is the fullest; ties go by the items' order."""
    first = [(i,) for i in range(len(sizes))]  # parts are nested pairs, written out at the end
    heap = [(-size, i, (size,) + (0,) * (ways - 1), (first[i],) + ((),) * (ways - 1)) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for _ in range(len(sizes) - 1):
        _, i, a, a_parts = heapq.heappop(heap)
        _, k, b, b_parts = heapq.heappop(heap)
        joined = sorted(((x + y, -n) for n, (x, y) in enumerate(zip(a, reversed(b)))), reverse=True)
        parts = [(p, q) if p and q else p or q for p, q in zip(a_parts, reversed(b_parts))]
        sums = tuple(s for s, _ in joined)
        heapq.heappush(heap, (sums[-1] - sums[0], min(i, k), sums, tuple(parts[-n] for _, n in joined)))
    part_of = [0] * len(sizes)
    for part, tree in enumerate(heap[0][3] if heap else ()):
        left = [tree]
        while left:
            node = left.pop()
            if len(node) == 1:
                part_of[node[0]] = part
            else:
                left.extend(node)
    return part_of


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id",
          keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, law (``bytes``), shard, slot and grown_shard (null).

    ``keep`` names the input columns that come back (default: all); those named like an
    output are replaced. A null text has no bytes and groups with empty texts. Repeated
    rows each get a slot. Slots count from 0 within a shard without gaps, by item and salt, then
    by ``doc_id`` (nulls first; rows equal in it in any order). Shards may stay empty
    where there are fewer groups than shards; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    columns = no_name_clash(docs.select(*(docs.columns if keep is None else keep)), OUTPUTS).columns
    rows = checkpointed(docs.select(
        F.struct(F.lit(0).alias("_"), *columns).alias("row"), F.col(doc_id).alias("id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("crc"), F.sha2(body, 256).alias("group")))

    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    item = F.when(F.col("size") * CELLS >= total, F.col("group")).otherwise(F.substring("group", 1, CELL_DIGITS))
    items = groups.groupBy(item.alias("item")).agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    items.sort(key=lambda x: (-x["size"], x["item"]))

    places, filled = [], [0] * shards
    for it, part in zip(items, differencing([it["size"] for it in items], shards)):
        places.append((it["item"], part, filled[part], 1 + it["n"] // ROWS_PER_SALT))
        filled[part] += it["n"]
    places_of = spark.createDataFrame(places, "item string, shard int, item_at bigint, salts bigint")
    large = places_of.filter(F.length("item") > CELL_DIGITS).select(F.col("item").alias("own"))

    placed = (rows.join(F.broadcast(large), F.col("group") == F.col("own"), "left")
              .withColumn("item", F.coalesce("own", F.substring("group", 1, CELL_DIGITS)))
              .join(F.broadcast(places_of), "item")
              .withColumn("salt", F.pmod(F.xxhash64("id", "group"), F.col("salts")))
              .select("row", "id", "size", "crc", "shard", "item", "item_at", "salt"))
    salts = placed.groupBy("item", "item_at", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("item").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = salts.select("item", "salt", (F.col("item_at") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("at"))
    within = Window.partitionBy("item", "salt").orderBy("id")
    return (placed.withColumn("k", F.row_number().over(within)).join(salts, ["item", "salt"])
            .select(*[F.col("row")[c].alias(c) for c in columns], "size", F.col("crc").alias("text_crc32"),
                    F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("k") - 1).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(sharded: DataFrame, at: str) -> None:
    """One folder a shard, each document at its slot's place in a range of files."""
    files = sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
    files.write.partitionBy("shard").parquet(at)
