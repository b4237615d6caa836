"""Problem 3: clusters of mutually similar vectors by grid density clustering.

Features (projections on drawn principal axes) are quantised into cells, cells are counted, and of the dense ones (two rows or more) the smallest row
stands for the cell.  Rows are joined to their cell's row, and cells to the dense cells beside them; a join holds only if the cosine of the two rows is high
enough, as a cell may hold rows of several clusters.  Minimum labels spread over these joins to a fixed point.  By the definition of the clusters a cluster's
smallest row is as similar to all its rows, and as different from all others, as any other row of it, so every cluster goes on as one row.  What the grids leave
apart is compared pair by pair in blocks, so no cluster depends on a grid's luck.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.llm.components import components
from disputo.llm.vectors import matrix, principal_axes, same_bucket, unit, usable_vectors
from disputo.runtime import cut

#: Rounds of grids and grids of a round: they turn clusters into few rows and so only save work; the exact pass finds what they leave.
ROUNDS, GRIDS = 3, 3
#: Axes of a grid: as many as keep the unrelated rows in a cell below CHANCE, at most as many as a number holds with three bits for each.
CHANCE, MOST_AXES = 4.0, 20
#: Cosine for which cells are made.
NEAR = 0.955
#: Rows of one block of the exact pass; rows of it compared at once.
BLOCK, _ROWS = 8192, 512


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _sum_vectors(grouped, size: int, *others: Column) -> DataFrame:
    """``s``, the sum of the group's vectors, by one aggregate that is combined on the map side."""
    summed = grouped.agg(*[F.sum(F.col("s")[i].cast("double")).alias(f"s{i}") for i in range(size)], *others)
    return summed.withColumn("s", F.array(*[F.col(f"s{i}") for i in range(size)])).drop(*[f"s{i}" for i in range(size)])


def _cells(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, variances: np.ndarray, n: int, seed: int) -> DataFrame:
    """(``id``, ``grid``, ``cell``): every row's cell in GRIDS grids, three bits for each axis."""
    random, width = np.random.default_rng(seed), 8 * sqrt(2 - 2 * NEAR) / sqrt(len(variances))
    usable = max(int((variances > (width / 20) ** 2).sum()), 1)
    grids = []
    for _ in range(GRIDS):
        chance, drawn = 1.0, []
        for axis in np.argsort(-variances[:usable] * random.uniform(0.3, 1.0, usable)):  # wide axes separate best
            if chance * n <= CHANCE or len(drawn) == MOST_AXES:
                break
            chance *= same_bucket(float(variances[axis]), width)
            drawn.append(axis)
        grids.append((axes[:, drawn], random.uniform(0, width, len(drawn))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(1))) if len(batch) else np.empty((0, len(mean)))
            for number, (turn, offsets) in enumerate(grids):
                cells = np.zeros(len(x), dtype=np.int64)
                for column in np.clip(np.floor(((x - mean) @ turn + offsets) / width).astype(np.int64) + 4, 0, 7).T:
                    cells = cells * 8 + column
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), number, dtype=np.int32)), pa.array(cells)], ["id", "grid", "cell"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "v").mapInArrow(run, f"id {kind}, grid int, cell long")


def _joins(rows: DataFrame, cells: DataFrame, least: float) -> DataFrame:
    """(``a``, ``b``): rows joined to the smallest row of one of their cells, and such rows of cells side by side, if their cosine is at least ``least``."""
    dense = cut(cells.groupBy("grid", "cell").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    within = cells.join(dense, ["grid", "cell"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # one step up on one axis leads to the next cell; the step down is the same pair seen from there
    place = F.sequence(F.lit(0), F.lit(MOST_AXES - 1))
    stepped = dense.withColumn("i", F.explode(place)).where("(shiftright(cell, 3 * i) & 7) < 7").select("grid", (F.col("cell") + F.expr("shiftleft(1L, 3 * i)")).alias("cell"), F.col("rep").alias("a"))
    beside = stepped.join(dense, ["grid", "cell"]).where("a <> rep").select("a", F.col("rep").alias("b"))
    pairs = within.union(beside).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    vectors = rows.select("id", "v")
    met = pairs.join(vectors.withColumnsRenamed({"id": "a", "v": "va"}), "a").join(vectors.withColumnsRenamed({"id": "b", "v": "vb"}), "b")
    return met.where(_dot("va", "vb") / F.sqrt(_dot("va", "va") * _dot("vb", "vb")) >= least).select("a", "b")


def close_pairs(rows: DataFrame, n: int, least: float) -> DataFrame:
    """(``a``, ``b``): all pairs of rows (id, v) with a cosine of at least ``least``, each once, by comparing every block with every block.

    Work grows with the square of the rows, a task holds two blocks.  Products in single precision propose, double precision decides.
    """
    parts = max(1, -(-n // BLOCK))
    kind = dict(rows.dtypes)["id"]
    placed = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = other.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v")

    def compare(table: pa.Table) -> pa.Table:
        ids, own = table.column("id").combine_chunks(), table.column("own").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        u = unit(matrix(table.column("v").combine_chunks()))
        single = u.astype(np.float32)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found = []
        for at in range(0, len(left), _ROWS):
            part = left[at : at + _ROWS]
            i, j = np.nonzero(single[part] @ single[right].T >= least - 1e-5)
            i, j = part[i], right[j]
            keep = i < j if x == y else np.ones(len(i), dtype=bool)
            i, j = i[keep], j[keep]
            keep = np.einsum("ij,ij->i", u[i], u[j]) >= least
            found.append(np.stack([i[keep], j[keep]]))
        i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j))})

    return blocks.groupBy("x", "y").applyInArrow(compare, f"a {kind}, b {kind}")


def similarity_clusters(df: DataFrame, key: str, vector: str, size: int, least: float = 0.8, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, vectors): members has ``id``, ``cluster_key`` (smallest id), ``n_members``, ``typicality`` (cosine with the cluster's mean direction).

    Clusters of one are included; unusable vectors (see usable_vectors) are not.  Made for collections in which rows of one cluster have
    cosine of at least ``least`` and rows of different clusters less; there the result is exact.  A cluster that holds a third of all rows
    costs its cells, not its pairs; clusters and single rows are compared with each other, which grows with the square of their number.
    """
    usable = cut(usable_vectors(df, key, vector, size))
    n, mean, axes, variances = principal_axes(usable, size)
    rows, links = usable.select("id", "v"), []
    for step in range(ROUNDS):
        met = _joins(rows, _cells(rows, mean, axes, variances, n, seed + step), least)
        # every row goes over to the smallest row it is joined to; only rows that are the smallest around them go on
        moved = cut(met.groupBy("a").agg(F.min("b").alias("b")))
        links.append(moved)
        rows = cut(rows.join(moved.select(F.col("a").alias("id")), "id", "left_anti"))
    links.append(close_pairs(rows, rows.count(), least))
    groups = components(reduce(DataFrame.union, links)).select(F.col("node").alias("id"), F.col("group_id").alias("label"))
    labels = cut(usable.select("id").join(groups, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    norm = F.sqrt(_dot("v", "v"))
    singles = usable.withColumn("norm", norm).select("id", F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias("s")).join(labels, "id")
    clusters = _sum_vectors(singles.groupBy("label"), size, F.count(F.lit(1)).alias("n_members")).withColumnRenamed("s", "total")
    members = singles.join(clusters, "label")
    typicality = _dot("s", "total") / F.sqrt(_dot("total", "total"))
    return members.select("id", F.col("label").alias("cluster_key"), "n_members", typicality.alias("typicality")), usable


def densest_members(df: DataFrame, members: DataFrame, key: str, vector: str, size: int, k: int = 3, features: int = 4, width: float = 0.1) -> DataFrame:
    """(``cluster_key``, ``n_members``, ``n_cell``, ``rank``, ``id``): the first k members (by id) of each cluster's densest cell.

    Cells quantise the first ``features`` numbers of the unit vectors by ``width``; of equally dense cells the one with the smaller numbers counts.
    Cells are counted by cluster in a combined aggregate; no cluster is gathered.
    """
    vectors = usable_vectors(df, key, vector, size).withColumn("norm", F.sqrt(_dot("v", "v")))
    cell = F.array(*[F.floor(F.col("v")[i].cast("double") / F.col("norm") / width).cast("int") for i in range(features)])
    placed = cut(vectors.select("id", cell.alias("cell")).join(members.select("id", "cluster_key", "n_members"), "id"))
    counted = placed.groupBy("cluster_key", "cell").agg(F.count(F.lit(1)).alias("n_cell"))
    negated = F.transform("cell", lambda c: -c)
    densest = counted.groupBy("cluster_key").agg(F.max(F.struct("n_cell", negated.alias("minus"), "cell")).alias("d")).select("cluster_key", "d.n_cell", "d.cell")
    order = W.partitionBy("cluster_key").orderBy("id")
    ranked = placed.join(densest, ["cluster_key", "cell"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("cluster_key", "n_members", "n_cell", "rank", "id")


def most_typical(members: DataFrame, k: int = 3) -> DataFrame:
    """(``cluster_key``, ``n_members``, ``rank``, ``id``, ``typicality``): each cluster's k members closest to its mean direction (ties: smaller id)."""
    order = W.partitionBy("cluster_key").orderBy(F.desc(F.round("typicality", 9)), "id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cluster_key", "n_members", "rank", "id", "typicality")
