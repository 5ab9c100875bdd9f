"""Cosine similarity, single-linkage clusters and centroids over DataFrames.

Every two vectors of a group are compared. The rows of a group are dealt to blocks
of bounded size; two blocks are a tile, which a Python worker compares by matrix
products. What these leave within rounding of the threshold is decided by the same
sum, in the order of the components, as ``dot``, so pairs and similarities are those
of a plain join.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

THRESHOLD, ISSUE_THRESHOLD = 0.7, 0.72
MAX_ROUNDS = 100
#: Bytes of a block's vectors as doubles (8,192 of length 64), rows of a block at least, rows of either side in a matrix product, products summed at once.
BLOCK_BYTES, _LEAST_ROWS, _SIDE, _AT_ONCE = 4 << 20, 64, 1024, 1 << 16


def dot(a: Column, b: Column) -> Column:
    """The product of two unit vectors in double precision; 0 if their lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def _joined_pairs(items: DataFrame, threshold: float, within: tuple[str, ...]) -> DataFrame:
    left = items.select(F.col("id").alias("a"), F.col("embedding").alias("va"), *within)
    right = items.select(F.col("id").alias("b"), F.col("embedding").alias("vb"), *[F.col(c).alias(f"_{c}") for c in within])
    on = F.col("a") < F.col("b")
    for c in within:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(right, on).select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity")).where(F.col("similarity") >= threshold)


def _tiles(items: DataFrame, within: tuple[str, ...], block_bytes: int) -> tuple[DataFrame, list[str]]:
    """Rows (id, embedding, block) once for each tile (i, j) of their block, and the columns that tell tiles apart.

    Rows of blocks i and j meet in tile (i, j) only, those of one block in (i, i).
    """
    element = items.schema["embedding"].dataType.elementType.simpleString()
    vector = F.col("embedding") if element in ("float", "double") else F.col("embedding").cast("array<double>")
    group = ["dim", *[f"g{k}" for k in range(len(within))]]
    rows = items.select("id", vector.alias("embedding"), F.size("embedding").alias("dim"), *[F.col(c).alias(g) for c, g in zip(within, group[1:], strict=True)])
    # A null in a vector makes its similarities null or, beside another length, 0.
    rows = rows.dropna(subset=["id"]).where((F.col("dim") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    for g in group[1:]:
        rows = rows.where(F.col(g).isNotNull())
    fit = F.greatest(F.lit(_LEAST_ROWS), F.floor(F.lit(block_bytes // 8) / F.col("dim")))
    # One row for each group of more than a block.
    large = rows.groupBy(group).agg(F.count("*").alias("n")).select(*group, F.ceil(F.col("n") / fit).cast("long").alias("blocks")).where("blocks > 1")
    dealt = rows.join(F.broadcast(large), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "embedding"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "embedding"), [*group, "i", "j"]


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Ids and vectors of a tile, the rows of its two sides, and whether these are the same."""
    table = pa.Table.from_batches(batches)
    block, i, j = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
    values = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table["id"].combine_chunks(), values.astype(np.float64).reshape(len(table), -1), np.flatnonzero(block == i), np.flatnonzero(block == j), i == j


def _near(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows whose product may reach the threshold, and whether it does for sure."""
    with np.errstate(all="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    finite = np.isfinite(norms)
    bound = 4 * vectors.shape[1] * np.finfo(np.float64).eps
    for s in range(0, len(left), _SIDE):
        p = left[s : s + _SIDE]
        for t in range(s if same else 0, len(right), _SIDE):
            q = right[t : t + _SIDE]
            rounding = bound * norms[p][finite[p]].max(initial=0.0) * norms[q][finite[q]].max(initial=0.0)
            with np.errstate(all="ignore"):
                products = vectors[p] @ vectors[q].T
            close = products >= threshold - rounding
            close[~finite[p]] = True
            close[:, ~finite[q]] = True
            if same and s == t:
                close = np.triu(close, 1)
            a, b = np.nonzero(close)
            sure = (products[a, b] >= threshold + rounding) & finite[p[a]] & finite[q[b]]
            yield p[a], q[b], sure


def _products(columns: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Like ``dot``, for the rows p and q of transposed vectors."""
    out = np.zeros(len(p))
    with np.errstate(all="ignore"):
        for s in range(0, len(p), _AT_ONCE):
            a, b, part = p[s : s + _AT_ONCE], q[s : s + _AT_ONCE], out[s : s + _AT_ONCE]
            for column in columns:
                part += column[a] * column[b]
    return out


def _reaches(similarity: np.ndarray, threshold: float) -> np.ndarray:
    return ~(similarity < threshold)  # NaN is above all numbers, as in Spark and SQL


def _pairs_of(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, left, right, same = _sides(batches)
        columns = np.ascontiguousarray(vectors.T)
        for p, q, _ in _near(vectors, left, right, same, threshold):
            similarity = _products(columns, p, q)
            keep = _reaches(similarity, threshold)
            if keep.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p[keep])), ids.take(pa.array(q[keep])), pa.array(similarity[keep])], ["p", "q", "similarity"])

    return run


def _united(roots: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``roots``, the least row of every row's set, with the sets of p and q made one."""
    while True:
        p, q = roots[p], roots[q]
        apart = p != q
        if not apart.any():
            return roots
        p, q = p[apart], q[apart]
        np.minimum.at(roots, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(further := roots[roots], roots):
            roots = further


def _links_of(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, left, right, same = _sides(batches)
        columns, roots = np.ascontiguousarray(vectors.T), np.arange(len(vectors))
        for p, q, sure in _near(vectors, left, right, same, threshold):
            apart = roots[p] != roots[q]
            p, q, sure = p[apart], q[apart], sure[apart]
            sure[~sure] = _reaches(_products(columns, p[~sure], q[~sure]), threshold)
            roots = _united(roots, p[sure], q[sure])
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(linked)), ids.take(pa.array(roots[linked]))], ["p", "q"])

    return run


def _compared(items: DataFrame, within: tuple[str, ...], run: Callable, block_bytes: int, *more: str) -> DataFrame:
    tiles, by = _tiles(items, within, block_bytes)
    kind = items.schema["id"].dataType
    found = tiles.groupBy(by).applyInArrow(run, StructType([StructField("p", kind), StructField("q", kind), *[StructField(c, DoubleType()) for c in more]]))
    return found.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *more)


def similar_pairs(items: DataFrame, threshold: float = THRESHOLD, within: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, similarity) for a < b of ``items(id, embedding)``; ``within`` columns must be equal."""
    if threshold <= 0:  # vectors of different lengths are similar, too
        return _joined_pairs(items, threshold, within)
    return _compared(items, within, _pairs_of(threshold), block_bytes, "similarity")


def similar_links(items: DataFrame, threshold: float = THRESHOLD, within: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b) that lead wherever ``similar_pairs`` lead: fewer of them in each tile than it has rows."""
    if threshold <= 0:
        return _joined_pairs(items, threshold, within).select("a", "b")
    return _compared(items, within, _links_of(threshold), block_bytes)


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.conf.get("spark.master", "")
        if not shared and master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or f"{tempfile.gettempdir()}/quarrylog-checkpoints")
    return df.checkpoint()


def components(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id that links lead to; items without links are their own.

    Every round all items of a label take the smallest label that any of them
    neighbours, and then that label's own; only linked items take part.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = checkpointed(pairs.select(ways.alias("way")).select("way.a", "way.b"))
    labels = checkpointed(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("cluster")))
    for _ in range(MAX_ROUNDS):
        own, near = labels.select(F.col("id").alias("a"), "cluster"), labels.select(F.col("id").alias("b"), F.col("cluster").alias("near"))
        stepped = links.join(own, "a").join(near, "b").groupBy("cluster").agg(F.min("near").alias("near")).select("cluster", F.least("cluster", "near").alias("next"))
        jump = stepped.select(F.col("cluster").alias("next"), F.col("next").alias("far"))
        moves = stepped.join(jump, "next").select("cluster", "far")
        labels = checkpointed(labels.join(moves, "cluster").select("id", F.col("far").alias("cluster"), (F.col("far") != F.col("cluster")).alias("moved")))
        if labels.where("moved").isEmpty():
            return items.select("id").join(labels.select("id", "cluster"), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
        labels = labels.drop("moved")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def cluster(items: DataFrame, threshold: float = THRESHOLD, within: tuple[str, ...] = ()) -> DataFrame:
    """(id, cluster, size): the cluster is named after its first member."""
    named = components(items, similar_links(items, threshold, within))
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size"))
    return named.join(sizes, "cluster").select("id", "cluster", "size")


def positions(named: DataFrame) -> DataFrame:
    """(position, cluster, size): clusters by size, the largest first, then by first member.

    Clusters are dealt to partitions in that order, so a position is a place in
    its partition after the clusters of those before.
    """
    order = (F.desc("size"), F.col("cluster").asc())
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size"))
    dealt = checkpointed(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # One row a partition.
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return placed.join(F.broadcast(before), "part").select((F.col("before") + F.col("place")).alias("position"), "cluster", "size")


def ordered(named: DataFrame) -> DataFrame:
    """(position, cluster, size, members): ``positions`` with the members in order."""
    members = named.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return positions(named).join(members, "cluster").select("position", "cluster", "size", "members")


def mean_similarity(items: DataFrame) -> DataFrame:
    """(cluster, mean): the mean cosine of all pairs of a cluster of unit vectors ``items(cluster, embedding)``.

    The squared length of the members' sum is their number and twice the sum of
    all products, so no pair is made.
    """
    flat = items.select("cluster", F.posexplode("embedding").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"))
    whole = flat.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("own"))
    sizes = items.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    return whole.join(sizes, "cluster").select("cluster", ((F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("mean"))


def centroids(items: DataFrame, by: str) -> DataFrame:
    """(by, pos, value): the normalised mean vector of every group, one row per dimension."""
    flat = items.select(by, F.posexplode("embedding").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norm = flat.groupBy(by).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return flat.join(norm, by).select(by, "pos", F.when(F.col("norm") > 0, F.col("mean") / F.col("norm")).otherwise(F.col("mean")).alias("value"))
