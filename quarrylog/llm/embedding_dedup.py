"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Vectors of one label link when their cosine, in double precision, is at least
``threshold``. Equal vectors of a label are one representative with a weight.
A rotation that balances binary codes is learned on about ``sample`` vectors
(iterative quantisation after PCA). The code is cut into ``tables`` substrings,
each an index of its own, whose width follows the number of rows of the largest
label. Of each pair the vector with the smaller id probes, the other is found.

Which keys of a table a vector probes is told by its margins, the distances of
its projections from the bits' borders: the key with the bits S turned over is
probed if the squared margins of S add up to at most a budget. On axes at right
angles the squared margins of the bits in which a pair differs never add up to
more than its squared distance, so some table holds the pair within a share of
2 - 2 * threshold: with that budget (``exact=True``) every link is found. Far less
does in practice, so by default the budget is learned from the data: the least
that finds all but one in 10,000 of pairs exactly at the threshold, made from the
sampled vectors by steps in random directions and in directions between sampled
vectors, with a margin of safety. It is large where vectors crowd and small
where they are spread. Candidates are reranked with the original vectors, so no
link is below the threshold.

Defined results: null vectors, zero vectors and vectors with null or non-finite
components, and vectors with a null label, link with nothing (n_links 0, own
component, kept); vectors of different lengths never link; repeated rows are
vectors of their own; a null vec_id has a null component; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Made, beside, components, discard, materialize, table

THRESHOLD, TABLES, SAMPLE = 0.98, 4, 20_000
#: Bits of a table's key at least and at most, simulated pairs, the share of them that may be missed, and the factor of safety.
_WIDTHS, _SIMULATED, _MISSED, _SAFETY = (8, 32), 20_000, 1e-4, 1.5


def learn_rotation(x: np.ndarray, dim: int, bits: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dim x bits) for balanced codes of unit vectors ``x``."""
    rng = np.random.default_rng(7)
    centre = x.mean(axis=0) if len(x) else np.zeros(dim)
    blocks, left = [], bits
    while left > 0:
        k = min(dim, left)
        if len(x) > k:
            v = x - centre
            axes = np.linalg.eigh(v.T @ v)[1][:, ::-1][:, :k]
            rotation = np.linalg.qr(rng.standard_normal((k, k)))[0]
            p = v @ axes
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(p @ rotation > 0, 1.0, -1.0).T @ p)
                rotation = (u @ w).T
            blocks.append(axes @ rotation)
        else:
            blocks.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :k])
        left -= k
    return centre, np.hstack(blocks)


def _unit(vectors: list) -> tuple[np.ndarray | None, float]:
    v = np.array(vectors, dtype=np.float64)
    norm = float(np.sqrt(v @ v)) if v.ndim == 1 and len(v) else 0.0
    return (v, norm) if np.isfinite(norm) and norm > 0 else (None, 0.0)


def _digests() -> Callable[[pd.DataFrame], Iterator[Made]]:
    """The valid vectors as doubles and their digests."""

    def run(batch: pd.DataFrame) -> Iterator[Made]:
        valid = [_unit(raw)[0] if raw is not None else None for raw in batch["embedding"]]
        raws = [None if v is None else v.tobytes() for v in valid]
        yield range(len(raws)), {"dim": [0 if v is None else len(v) for v in valid], "digest": [None if r is None else xxhash.xxh3_128_digest(r) for r in raws], "v": raws}

    return run


def key_width(rows: int) -> int:
    """Bits of a table's key: about two keys a row."""
    return int(np.clip(int(max(1, rows)).bit_length() + 1, *_WIDTHS))


def turned(squares: np.ndarray, budget: float) -> list[int]:
    """The sets of bits, as masks, whose squared margins add up to at most ``budget``, the empty one first."""
    masks, costs = [0], [0.0]
    for bit in np.argsort(squares, kind="stable").tolist():
        cost = float(squares[bit])
        if cost > budget:
            break
        more = [(m | 1 << bit, c + cost) for m, c in zip(masks, costs, strict=True) if c + cost <= budget]
        masks += [m for m, _ in more]
        costs += [c for _, c in more]
    return masks


def least_budgets(p: np.ndarray, q: np.ndarray, tables: int) -> np.ndarray:
    """Per pair of projections (rows of ``p`` probe for those of ``q``) the least budget that finds it."""
    differ = (p > 0) != (q > 0)
    return np.where(differ, p * p, 0.0).reshape(len(p), tables, -1).sum(axis=2).min(axis=1)


def learn_budget(x: np.ndarray, centre: np.ndarray, projection: np.ndarray, tables: int, threshold: float) -> float:
    """The budget that finds pairs at the threshold around the unit vectors ``x``."""
    dim = projection.shape[0]
    rng = np.random.default_rng(29)
    if not len(x):
        x = rng.standard_normal((256, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = x[rng.integers(0, len(x), _SIMULATED)]
    step = rng.standard_normal((_SIMULATED, dim))
    half = _SIMULATED // 2
    step[:half] = x[rng.integers(0, len(x), half)] - x[rng.integers(0, len(x), half)] + 1e-9 * step[:half]
    step -= (step * at).sum(axis=1, keepdims=True) * at
    norms = np.linalg.norm(step, axis=1, keepdims=True)
    partner = threshold * at + np.sqrt(1 - threshold**2) * step / np.where(norms > 0, norms, 1.0)
    return _SAFETY * float(np.quantile(least_budgets((at - centre) @ projection, (partner - centre) @ projection, tables), 1 - _MISSED))


def sure_budget(dim: int, bits: int, tables: int, threshold: float) -> float:
    """The budget that no link can exceed in all tables: of every ``dim`` bits the axes are at right angles."""
    return (2 - 2 * threshold) * -(-bits // dim) / tables + 1e-12


def _codes(shipped, bits: int, tables: int):
    """Per vector its key in every table, and the keys that it probes."""

    def factory() -> Callable[[pd.DataFrame], Iterator[Made]]:
        find, models = shipped.value

        def run(batch: pd.DataFrame) -> Iterator[Made]:
            width = bits // tables
            weights = 1 << np.arange(width, dtype=np.int64)
            keys, probes = [None] * len(batch), [None] * len(batch)
            for dim in batch["dim"].unique():
                if dim not in models:
                    models[dim] = find(np.empty((0, dim)), int(dim))
                at = np.flatnonzero((batch["dim"] == dim).to_numpy())
                x = np.frombuffer(b"".join(batch["v"].iloc[at]), dtype=np.float64).reshape(-1, dim)
                centre, projection, budget = models[dim]
                p = ((x / np.linalg.norm(x, axis=1, keepdims=True) - centre) @ projection).reshape(len(at), tables, width)
                own, squares = (p > 0) @ weights, p * p
                for k, row in enumerate(at.tolist()):
                    keys[row] = own[k]
                    probes[row] = [[int(own[k, t]) ^ m for m in turned(squares[k, t], budget)] for t in range(tables)]
            yield range(len(batch)), {"keys": keys, "probes": probes}

        return run

    return factory


class _Learner:
    """Centre, projection and budget of vectors of one length."""

    def __init__(self, bits: int, tables: int, threshold: float, exact: bool) -> None:
        self.bits, self.tables, self.threshold, self.exact = bits, tables, threshold, exact

    def __call__(self, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, float]:
        centre, projection = learn_rotation(x, dim, self.bits)
        sure = sure_budget(dim, self.bits, self.tables, self.threshold)
        return centre, projection, sure if self.exact else min(sure, learn_budget(x, centre, projection, self.tables, self.threshold))


def _rerank(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for dim in batch["dim"].unique():
                at = np.flatnonzero((batch["dim"] == dim).to_numpy())
                a, b = (np.frombuffer(b"".join(batch[c].iloc[at]), dtype=np.float64).reshape(-1, dim) for c in ("va", "vb"))
                cosine = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
                keep[at] = cosine >= threshold
            yield batch.loc[keep, ["a", "b"]]

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """``vectors``: vec_id, embedding, label. One row each: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    read = beside(source, lambda: _digests(), ["embedding"], "dim int, digest binary, v binary", keeps=["vec_id", "label"])
    named = F.col("label").isNotNull()
    if vectors.schema["label"].dataType.simpleString() in ("float", "double"):
        named = named & ~F.isnan("label")
    rows = materialize(read.select("vec_id", "label", "dim", F.when(named, F.col("digest")).alias("digest"), "v"), "vectors")
    valid = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    groups = materialize(valid.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "copies")

    most = groups.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    width = key_width(most)
    bits, find = width * tables, _Learner(width * tables, tables, threshold, exact)
    sizes = groups.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    models = {}
    if sizes:
        dim, n = sizes[0]["dim"], sizes[0]["n"]
        chosen = F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)
        drawn = valid.where((F.col("dim") == dim) & chosen).select("vec_id", "v").collect()  # about `sample` rows
        x = np.array([np.frombuffer(r["v"], dtype=np.float64) for r in sorted(drawn, key=lambda r: r["vec_id"])]).reshape(-1, dim)
        models[dim] = find(x / np.linalg.norm(x, axis=1, keepdims=True), dim)
    shipped = spark.sparkContext.broadcast((find, models))  # one dim x bits matrix

    heads = rows.join(groups.select("label", "dim", "digest", F.col("rep").alias("vec_id")), ["label", "dim", "digest", "vec_id"]).dropDuplicates(["vec_id", "digest"])
    heads = materialize(heads.select("vec_id", "label", "dim", "v"), "heads")
    coded = materialize(beside(heads, _codes(shipped, bits, tables), ["dim", "v"], "keys array<long>, probes array<array<long>>", keeps=["vec_id", "label", "dim"]), "codes")
    index = coded.select("label", "dim", F.col("vec_id").alias("b"), F.posexplode("keys").alias("t", "key"))
    probes = coded.select("label", "dim", F.col("vec_id").alias("a"), F.posexplode("probes").alias("t", "each")).select("label", "dim", "a", "t", F.explode("each").alias("key"))
    # A pair that several tables find is one candidate.
    found = materialize(probes.join(index, ["label", "dim", "t", "key"]).where("a < b").select("a", "b", "dim").distinct(), "candidates")
    discard(coded)

    at = lambda k: heads.select(F.col("vec_id").alias(k), F.col("v").alias(f"v{k}"))
    links = materialize(found.join(at("a"), "a").join(at("b"), "b").mapInPandas(_rerank(threshold), "a long, b long"), "links")
    discard(found, heads)

    weights = groups.select(F.col("rep").alias("other"), F.col("weight").alias("other_weight"))
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    degrees = both.join(weights, "other").groupBy("rep").agg(F.sum("other_weight").alias("linked"))
    classes = (
        groups.join(degrees, "rep", "left")
        .join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "dim", "digest", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    classes = materialize(classes, "classes")
    out = rows.select("vec_id", "label", "dim", "digest").join(classes, ["label", "dim", "digest"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    n_links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
