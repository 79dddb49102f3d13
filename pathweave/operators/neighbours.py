"""Users in feature space: the k nearest of each user, and clusters (catalogue C9).

``nearest`` is an exact k-nearest-neighbour join. Users with equal features are one class. Classes
fall into cells around pivots, and a query visits cells in order of the least distance at
which a member can lie (by the triangle inequality, and by the box of the members): one cell, then four, then
sixteen. Its k best so far are its search radius, which shrinks from round to round, and it stops where the next
cell begins beyond it. Tasks return the k best of a query and a cell, never pairs.

``clusters`` are Lloyd rounds in column expressions: an assignment is a projection, new centres are one
aggregate, and only the centres come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathweave.session import checkpoint_dir

#: Classes to a cell, and the most pivots: a bounded sample of classes, of which they are the first by a hash.
CELL, MOST_PIVOTS = 2048, 65_536
#: Queries of a block of a cell.
BLOCK = 4096
#: Distances are compared as whole millionths; equal ones go by id.
UNIT = 1e6


def standardised(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, x): features as doubles, null as 0, less their mean, by their standard deviation (0 where that is 0)."""
    values = df.select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    means = values.agg(*[f(c).alias(f"{c}_{n}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [(F.col(c) - means[f"{c}_m"]) / means[f"{c}_s"] if means[f"{c}_s"] else F.lit(0.0) for c in features]
    return values.select("key", F.array(*z).alias("x"))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by differences: equal vectors are at exactly 0."""
    square = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        square += np.subtract.outer(x, y) ** 2
    return np.sqrt(square)


BEST = "rep string, best array<struct<d:bigint,id:string>>"


def _search(k: int):
    """Best k of the members of a cell for each query there; a member brings its smallest k ids."""
    def search(queries: pa.Table, members: pa.Table) -> pa.Table:
        rep, radius = queries["rep"].to_pylist(), queries["radius"].to_numpy()
        out = []
        if len(members) and len(rep):
            x, y = _vectors(queries["x"].combine_chunks()), _vectors(members["x"].combine_chunks())
            ids = members["ids"].to_pylist()
            step = max(1, 2_000_000 // len(y))
            for at in range(0, len(x), step):
                whole = np.floor(_distances(x[at:at + step], y) * UNIT + 0.5).astype(np.int64)
                reach = radius[at:at + step]
                if len(y) >= k:
                    reach = np.minimum(reach, np.partition(whole, k - 1, axis=1)[:, k - 1])
                for row, most in zip(whole, reach):
                    found = sorted((int(row[j]), name) for j in np.flatnonzero(row <= most) for name in ids[j])[:k]
                    out.append([{"d": d, "id": name} for d, name in found])
        return pa.table({"rep": pa.array(rep[:len(out)], pa.string()),
                         "best": pa.array(out, pa.list_(pa.struct([("d", pa.int64()), ("id", pa.string())])))})
    return search


def least_distances(x: np.ndarray, away: np.ndarray, radii: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No member of a cell is nearer to a query: by its distance ``away`` from the pivot less the cell's radius, and
    by the box from ``low`` to ``high`` that holds the members, which one far member widens in its own direction only."""
    square = np.zeros(away.shape)
    for at, a, b in zip(x.T, low.T, high.T):
        square += np.maximum(0.0, np.maximum(a - at[:, None], at[:, None] - b)) ** 2
    return np.maximum(away - radii, np.sqrt(square))


def _route(pivots: np.ndarray, cells: np.ndarray, radii: np.ndarray, low: np.ndarray, high: np.ndarray, first: int, last: int):
    """Cells first to last of each query, in order of the least distance of a member, as far as its radius reaches."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = _vectors(batch.column("x"))
                away = _distances(x, pivots)
                least = least_distances(x, away, radii, low, high)
                order = np.lexsort((away, least))[:, first:last]
                reach = batch.column("radius").to_numpy()[:, None]
                go = np.floor(np.take_along_axis(least, order, axis=1) * UNIT) - 1 <= reach
                row, place = np.nonzero(go)
                taken = [batch.column(c).take(pa.array(row)) for c in ("rep", "x", "radius")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(cells[order[row, place]].astype("int32"))], ["rep", "x", "radius", "cell"])
    return route


def nearest(df: DataFrame, key: str, features: list[str], k: int = 5, cell: int = CELL, most_pivots: int = MOST_PIVOTS,
            block: int = BLOCK) -> DataFrame:
    """(key, rank, neighbour, distance): the ``k`` nearest others of each row by standardised ``features``.

    Keys are unique strings. Distances are rounded to millionths, equal ones go by key. Null features count as 0.
    With k others or fewer, a row has them all; an empty table gives none.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    vectors = standardised(df, key, features).checkpoint()
    # the row itself is among its class, so one more is found for each
    most = k + 1
    place = F.row_number().over(Window.partitionBy("x").orderBy("key"))
    classes = vectors.withColumn("place", place).where(F.col("place") <= most).groupBy("x").agg(
        F.array_sort(F.collect_list("key")).alias("ids")).withColumn("rep", F.col("ids")[0]).checkpoint()

    n = classes.count()
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(min(most_pivots, max(1, math.ceil(n / cell)))).select("x").collect()
    pivots = np.array([r[0] for r in chosen], dtype=np.float64).reshape(len(chosen), len(features))

    def place_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                away = _distances(_vectors(batch.column("x")), pivots)
                own = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype("int32")), pa.array(away[np.arange(len(own)), own])],
                                                 ["rep", "x", "ids", "cell", "away"])

    members = classes.select("rep", "x", "ids").mapInArrow(place_in, "rep string, x array<double>, ids array<string>, cell int, away double").checkpoint()
    ends = [F.array(*[f(F.col("x")[i]) for i in range(len(features))]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    filled = members.groupBy("cell").agg(F.max("away").alias("away"), *ends).orderBy("cell").collect()  # a row for each pivot
    cells = np.array([r["cell"] for r in filled], dtype=np.int64)
    low, high = (np.array([r[n] for r in filled], dtype=np.float64).reshape(len(filled), len(features)) for n in ("low", "high"))
    radii, centres = np.array([r["away"] for r in filled]), pivots[cells]

    best = classes.select("rep", F.array().cast("array<struct<d:bigint,id:string>>").alias("best"))
    everything = F.lit((1 << 62)).cast("bigint")
    first = 0
    while first < len(cells):
        last = min(len(cells), 4 * first + 1)
        reach = F.when(F.size("best") >= most, F.col("best")[most - 1]["d"]).otherwise(everything)
        asked = members.select("rep", "x").join(best, "rep").select("rep", "x", reach.alias("radius"))
        routed = asked.mapInArrow(_route(centres, cells, radii, low, high, first, last), "rep string, x array<double>, radius bigint, cell int").checkpoint()
        first = last
        if routed.isEmpty():
            break
        # a cell that many queries visit is searched in blocks of queries, each with the cell's members
        blocks = routed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        asked = routed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        there = members.select("cell", "x", "ids").join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = asked.select("cell", "block", "rep", "x", "radius").groupBy("cell", "block").cogroup(
            there.select("cell", "block", "x", "ids").groupBy("cell", "block")).applyInArrow(_search(most), BEST)
        best = best.unionByName(found).groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, most).alias("best")).checkpoint()

    known = classes.select("x", "rep").join(best, "rep").select("x", "best")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("key")), 1, k)
    out = vectors.join(known, "x").select("key", F.posexplode(others).alias("rank", "b"))
    return out.select(F.col("key").alias(key), (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("b.id").alias("neighbour"),
                      (F.col("b.d") / UNIT).alias("distance"))


# --------------------------------------------------------------------------- clusters
def _square(x: Column, centre: list[float]) -> Column:
    return sum(((x[i] - F.lit(float(c))) * (x[i] - F.lit(float(c))) for i, c in enumerate(centre)), F.lit(0.0))


def _millionths(square: Column) -> Column:
    return F.floor(square * UNIT + 0.5)


def far_centres(vectors: DataFrame, k: int) -> list[list[float]]:
    """k centres far apart: the vector farthest from the mean (the origin), then each time the one whose nearest
    centre is farthest; ties go to the smallest key. Each is one aggregate."""
    def farthest(square: Column) -> list[float]:
        return vectors.select("key", "x", _millionths(square).alias("d")).agg(F.min_by("x", F.struct(-F.col("d"), F.col("key")))).first()[0]

    x = F.col("x")
    first = farthest(sum((v * v for v in (x[i] for i in range(len(vectors.first()["x"])))), F.lit(0.0)))
    centres = [first]
    while len(centres) < k:
        near = [_square(x, c) for c in centres]
        centres.append(farthest(F.least(*near) if len(near) > 1 else near[0]))
    return centres


def clusters(df: DataFrame, key: str, features: list[str], k: int = 4, rounds: int = 8) -> DataFrame:
    """(key, cluster): Lloyd's clusters by standardised ``features``, from far-apart centres; cluster 0 has the first of these.

    Null features count as 0; ties between centres go to the first. ``rounds`` moves of the centres, fewer if they
    stay; a centre without members stays where it is. A round reads the stored vectors and ends in k rows.
    """
    checkpoint_dir(df.sparkSession)
    vectors = standardised(df, key, features).checkpoint()
    if vectors.isEmpty():
        return vectors.select(F.col("key").alias(key), F.lit(0).cast("bigint").alias("cluster"))

    def nearest_of(centres: list[list[float]]) -> Column:
        return F.array_min(F.array(*[F.struct(_millionths(_square(F.col("x"), c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]

    centres = far_centres(vectors, k)
    for _ in range(rounds):
        sums = vectors.select(nearest_of(centres).alias("cluster"), "x").groupBy("cluster").agg(
            *[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(len(features))]).collect()  # k rows
        moved = [next(([r[f"x{j}"] for j in range(len(features))] for r in sums if r["cluster"] == i), c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return vectors.select(F.col("key").alias(key), nearest_of(centres).cast("bigint").alias("cluster"))


def cluster_profiles(df: DataFrame, assigned: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Size and mean features of each cluster."""
    return df.join(assigned, key).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("users"), *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"avg_{c}") for c in features])
