"""Exact metric range join of embeddings, for near duplicates by cosine.

For unit vectors a cosine of at least s is a distance of at most e = sqrt(2 - 2s).
Pivots cut the space into cells: a vector belongs to its nearest pivot p, and is
copied to the cell of a pivot q only if a vector of that cell can be within e.
Two bounds rule that out: the triangle inequality, d(x, q) - d(x, p) > 2e, and
the distance of x to the plane between p and q, > e. Copies go to cells of lower
number only, so each pair meets in one cell; cells then join independently.

Equal vectors are one class throughout. A cell with many members is cut into
blocks, and each pair of blocks is a task of its own, so no group of
near copies meets in one task. Tasks return a count of links and the smallest
member of the local component for each member, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import checkpointed
from pathweave.llm.graph import connected_components

MIN_COSINE = 0.98
#: Classes to a pivot, and the most pivots; pivots are chosen from so many vectors.
CLASSES_A_PIVOT, MOST_PIVOTS, PIVOT_SAMPLE = 4096, 256, 2048
#: Members of a block of a cell.
BLOCK = 1024


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of a list array of one length, scaled to length 1, in double precision."""
    x = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares then neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pivots(sample: list[list[float]], n: int) -> np.ndarray:
    """``n`` of the sample's vectors, each farthest from those before it."""
    x = _unit(pa.array(sample, pa.list_(pa.float64())))
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def distances(pivots: np.ndarray) -> np.ndarray:
    """Distances between unit vectors, by differences."""
    return np.array([np.linalg.norm(pivots - p, axis=1) for p in pivots]).reshape(len(pivots), len(pivots))


def cells_of(x: np.ndarray, pivots: np.ndarray, between: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and which cells below it its copies go to; ``between`` has the pivots' distances."""
    sims = x @ pivots.T
    own = sims.argmax(axis=1)
    at_own = sims[np.arange(len(x)), own][:, None]
    dist = np.sqrt(np.maximum(0, 2 - 2 * sims))
    nearest = np.sqrt(np.maximum(0, 2 - 2 * at_own))
    near = (dist - nearest <= 2 * reach) & (at_own - sims <= reach * between[own] + 1e-12)
    return own, near & (np.arange(len(pivots))[None, :] < own[:, None])


def local_components(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the smallest index in its component."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def settle(ids: np.ndarray, copies: np.ndarray, linked: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Table:
    """(rep, links, root) of the rows of a symmetric link matrix that have links: how many rows each links
    with, copies counted, and the smallest id of its component here."""
    some = np.flatnonzero(linked.any(axis=1))
    some = some[np.argsort(ids[some], kind="stable")]
    linked = linked[np.ix_(some, some)]
    mine = ids[some]
    return pa.table({"rep": pa.array(mine, kind), "links": pa.array(linked @ copies[some], pa.int64()),
                     "root": pa.array(mine[local_components(linked)], kind)})


def with_blocks(members: DataFrame, keys: list[str], block: int = BLOCK, member: str = "rep") -> DataFrame:
    """``members`` with the number of ``blocks`` of their group, by its size, and their own ``block``, by a hash."""
    n = members.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return members.join(n, keys).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))


def block_pairs(members: DataFrame) -> DataFrame:
    """Members of with_blocks once for each pair of blocks (lo, hi) that their own is in."""
    at = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return at.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 min_cosine: float = MIN_COSINE, classes_a_pivot: int = CLASSES_A_PIVOT, most_pivots: int = MOST_PIVOTS,
                 block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link where their labels are equal and their cosine, in double
    precision, is at least ``min_cosine``. Null, empty and zero vectors, those with
    null or non-finite components, and rows with a null label or id link with
    nothing: n_links 0, their own component, kept. Vectors of unlike length never
    link. Rows that repeat an id are vectors of their own. Further columns of
    ``vectors`` are dropped; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    e = F.col(embedding)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), e.alias("embedding"))
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
           & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("fit", fit)
    classes = checkpointed(rows.filter("fit").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dims", F.size("embedding")))

    reach = float(np.sqrt(2 - 2 * min_cosine)) + 1e-9
    parts = []
    for dims, n in classes.groupBy("dims").count().orderBy("dims").collect():  # one row per vector length
        mine = classes.filter(F.col("dims") == dims)
        wanted = min(most_pivots, -(-n // classes_a_pivot))
        sample = mine.select("embedding", "rep").orderBy(F.xxhash64("rep"), "rep").limit(PIVOT_SAMPLE).collect()
        pivots = spark.sparkContext.broadcast(_pivots([r[0] for r in sample], wanted))
        parts.append(_cells(mine, pivots, reach))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    members = checkpointed(members)

    def join_blocks(key: tuple, t: pa.Table) -> pa.Table:
        lo, hi = key[-2].as_py(), key[-1].as_py()
        t = t.combine_chunks()
        x = _unit(t["embedding"].combine_chunks())
        rep, n, native, own = (t[c].to_numpy() for c in ("rep", "n", "native", "block"))
        linked = x @ x.T >= min_cosine
        linked &= native[:, None] | native[None, :]
        if lo != hi:
            linked &= own[:, None] != own[None, :]
        np.fill_diagonal(linked, False)
        return settle(rep, n, linked)

    keys = ["dims", "label", "cell"]
    found = checkpointed(block_pairs(with_blocks(members, keys, block)).groupBy(*keys, "lo", "hi").applyInArrow(
        join_blocks, "rep bigint, links bigint, root bigint"))
    component = connected_components(found, "rep", "root")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    settled = (classes.join(links, "rep", "left").join(component, F.col("rep") == F.col("id"), "left")
               .select("label", "embedding", F.lit(True).alias("fit"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                       F.coalesce("component", "rep").alias("component")))
    n_links, component_id = F.coalesce("links", F.lit(0)).cast("bigint"), F.coalesce("component", "vec_id")
    return rows.join(settled, ["label", "embedding", "fit"], "left").select(
        "vec_id", n_links.alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))


def _cells(classes: DataFrame, pivots, reach: float) -> DataFrame:
    """The classes in their own cell (native) and, copied, in the cells that their links may reach."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = distances(pivots.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                own, copied = cells_of(_unit(batch.column("embedding")), pivots.value, between, reach)
                row, cell = np.nonzero(copied)
                rows = np.concatenate([np.arange(len(own)), row])
                columns = [c.take(pa.array(rows)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.concatenate([own, cell]).astype("int32")), pa.array(np.arange(len(rows)) < len(own))],
                    [*batch.schema.names, "cell", "native"])

    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(place, spec + ", cell int, native boolean")
