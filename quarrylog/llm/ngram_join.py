"""N-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

Documents are sets of distinct word shingles (see ``shingles``); two link when
100 * intersection >= percent * union. The join is exact:

* Documents with one and the same set are one representative, found by a
  128-bit digest in a partial aggregation, so a group of copies is one node.
* Size bands: sets of 32 * 4^c to 128 * 4^c shingles are cut by shingle hash
  into 4^c parts, in which both sets of a pair that could reach the next band
  are cut that band's way too. If two sets reach the threshold, so do their
  shares of some part, as the parts' intersections and unions add up.
* Prefix filter: under any one order of all shingles, two shares of a part that
  reach the threshold have a shingle in common among the first
  m - ceil(percent * m / 100) + 1 of each. Frequent shingles come last; how
  frequent is told by a fixed table of 65,536 counters over all documents.
* A tile is the documents of a band with a common prefix shingle. Tiles of
  frequent shingles are split by a salt that grows with the counter. Each
  document is compared with the first of its split, and these with the first of
  the tile; what links becomes components.
* In large tiles that still hold two components, each document is compared with
  a few neighbours in an order dealt by a hash, which joins most of what belongs
  together before all pairs are looked at.
* Tiles that still hold two components are joined whole. Only pairs of
  different components count whose sizes allow a link and whose parity bitmaps
  do, those of the part and those of the whole sets: of two sets, the bits in
  which the bitmaps differ are at most the shingles in which the sets differ,
  which bounds the overlap from above. Links inside a component can't change a
  component. A pair counts in one tile of a part only, that of its first common
  prefix shingle (and in small tiles), and not in a band that is neither's own;
  so a pair that shares a hundred tiles is about one candidate a part.
* Candidates meet wider bitmaps (as many bits as the size needs) and then the
  exact intersection of the sorted shingle arrays of the whole texts.

Defined results: null and empty texts and texts without words are empty sets
that link with nothing and are their own component; rows with a null doc_id
keep their n_shingles and get a null component; rows that repeat a doc_id are
one node that has each of their sets; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Made, beside, components, discard, materialize, slices, table
from .shingles import mix, shingle_hashes, shingle_set, word_hashes

PERCENT, WIDTH = 75, 5
_COUNTERS_LOG2 = 16
_LEAST_BITS, _MOST_BITS = 512, 1 << 16
_SET_SCHEMA = "n int, own int, digest binary, sig binary, whole array<long>, bits array<long>, sizes array<int>, tokens array<long>, salts array<int>, slots array<int>"
#: The smallest size of band 1, the ratio of one band's sizes to the next one's, and the bits of a part's bitmap.
_BAND_FROM, _BAND_RATIO, _PART_BITS = 128, 4, 128
#: Tiles of so many rows are first dealt into splits of about so many, where each row meets so many neighbours.
_LARGE_TILE, _SPLIT_ROWS, _NEIGHBOURS = 16, 64, 4
#: Tiles of fewer rows don't keep out pairs that another tile of the part has: they have few.
_SMALL_TILE = 8


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - _COUNTERS_LOG2)).astype(np.int64)


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bit h mod w of w bits is flipped by each hash h; w is two to four times the set's size."""
    w = int(np.clip(1 << (2 * len(shingles)).bit_length(), _LEAST_BITS, _MOST_BITS))
    ones = np.bincount((shingles & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little")


def fold(bitmap: np.ndarray, n_bytes: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, n_bytes), axis=0)


def may_link(na: int, a: np.ndarray, nb: int, b: np.ndarray, percent: int) -> bool:
    """Whether sizes and bitmaps leave room for a link."""
    k = min(len(a), len(b))
    differ = int(np.bitwise_count(fold(a, k) ^ fold(b, k)).sum())
    most = (na + nb - differ) // 2
    return 100 * min(most, na, nb) >= percent * (na + nb - min(most, na, nb))


def _count(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << _COUNTERS_LOG2, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(_bucket(shingle_hashes(word_hashes(text), width)), minlength=len(total))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": hit, "n": total[hit]})

    return run


def frequency_levels(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per counter: how far above the mean it is, in half powers of two, and into how many splits its tiles go."""
    counts = np.zeros(1 << _COUNTERS_LOG2)
    summed = texts.mapInPandas(_count(width), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # at most 65,536 rows
        counts[r["bucket"]] = r["n"]
    ratio = counts / max(1.0, counts.mean())
    level = np.floor(2 * np.log2(np.maximum(ratio, 1.0))).astype(np.uint8)
    return level, np.where(level > 0, np.minimum(np.ceil(4 * ratio), 1 << 20), 1).astype(np.int64)


def bands(n: int, percent: int) -> list[int]:
    """The band of a set of n shingles, and the next one if a partner may be in it."""
    band, start = 0, _BAND_FROM
    while n >= start:
        band, start = band + 1, start * _BAND_RATIO
    return [band, band + 1] if n * 100 >= start * percent else [band]


def _parts(x: np.ndarray, level: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one band: which shingles are prefixes, the part of each, and the parts' sizes and bitmaps."""
    k = _BAND_RATIO**band
    part = ((x >> np.uint64(24)) & np.uint64(k - 1)).astype(np.int64)
    sizes = np.bincount(part, minlength=k)
    order = np.lexsort((level, part))
    place = np.arange(len(x)) - (np.cumsum(sizes) - sizes)[part[order]]
    prefix = order[place < (sizes + (-percent * sizes // 100) + 1)[part[order]]]
    ones = np.bincount(part * _PART_BITS + (x & np.uint64(_PART_BITS - 1)).astype(np.int64), minlength=k * _PART_BITS) & 1
    return prefix, part[prefix], sizes, np.packbits(ones.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(shipped, width: int, percent: int):
    names = [c.split()[0] for c in _SET_SCHEMA.split(", ")]

    def factory():
        level, splits = shipped.value

        def describe(text: bytes | None) -> tuple:
            x = shingle_set(word_hashes(text), width)
            n = len(x)
            if not n:
                return 0, 0, None, None, [], [], [], [], [], []
            digest, bucket = xxhash.xxh3_128_digest(x.tobytes()), _bucket(x)
            of_digest, rank = int.from_bytes(digest[:7], "little"), level[bucket]
            tokens, salts, slots, sizes, bits, base, own = [], [], [], [], [], 0, 0
            for band in bands(n, percent):
                prefix, part, m, b = _parts(x, rank, band, percent)
                split = splits[bucket[prefix]]
                tokens.append(mix(x[prefix] ^ np.uint64(band * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64))
                salts.append(np.where(split > 1, of_digest % split, -1).astype(np.int32))
                slots.append((part + base).astype(np.int32))
                sizes.append(m.astype(np.int32))
                bits.append(b)
                base += len(m)
                own = own or base
            sig = parity_bitmap(x)
            whole = fold(sig, _LEAST_BITS // 8).view(np.int64)
            return n, own, digest, sig.tobytes(), whole, *map(np.concatenate, (bits, sizes, tokens, salts, slots))

        def run(frame: pd.DataFrame) -> Iterator[Made]:
            texts = frame["text"].tolist()
            for start in range(0, len(texts), 1000):
                rows = [describe(t) for t in texts[start : start + 1000]]
                yield range(start, start + len(rows)), dict(zip(names, zip(*rows, strict=True), strict=True))

        return run

    return factory


def _by_bitmap(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = (batch[c] for c in ("na", "sa", "nb", "sb"))
            keep = [may_link(na, np.frombuffer(a, np.uint8), nb, np.frombuffer(b, np.uint8), percent) for na, a, nb, b in zip(*columns, strict=True)]
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


def _arrays(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [shingle_set(word_hashes(t), width).tobytes() for t in batch["text"]]})

    return run


def _by_intersection(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for xa, xb in zip(batch["xa"], batch["xb"], strict=True):
                a, b = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


class _Verifier:
    """Candidates (a, b) to links (a, b): wide bitmaps, then sorted arrays of whole texts."""

    def __init__(self, texts: DataFrame, sets: DataFrame, width: int, percent: int) -> None:
        self.texts, self.width, self.percent = texts, width, percent
        self.sigs = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "sig")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        at = lambda k: self.sigs.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
        left = materialize(pairs.join(at("a"), "a").join(at("b"), "b").mapInPandas(_by_bitmap(self.percent), "a long, b long").distinct(), "candidates")
        needed = left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct()
        arrays = materialize(self.texts.join(needed, "doc_id", "left_semi").mapInPandas(_arrays(self.width), "doc_id long, x binary"), "arrays")
        on = lambda k: arrays.select(F.col("doc_id").alias(k), F.col("x").alias(f"x{k}"))
        links = materialize(left.join(on("a"), "a").join(on("b"), "b").mapInPandas(_by_intersection(self.percent), "a long, b long").distinct(), "links")
        discard(left, arrays)
        return links


def _sizes_fit(x: Column | str, y: Column | str, percent: int) -> Column:
    low, high = F.least(x, y), F.greatest(x, y)
    return low * 100 >= high * percent


def _room(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Whether sizes and bitmaps, of the part and of the whole sets, leave room for a link."""

    def overlap(size: str, words: list[str]) -> Column:
        both = x(size) + y(size)
        differ = sum((F.bit_count(x(w).bitwiseXOR(y(w))) for w in words), F.lit(0))
        return (both - differ) * (100 + percent) >= both * (2 * percent)

    fit = _sizes_fit(x("n"), y("n"), percent) & _sizes_fit(x("m"), y("m"), percent)
    return fit & overlap("m", ["b0", "b1"]) & overlap("n", [f"w{k}" for k in range(_LEAST_BITS // 64)])


def _few_of_tile(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents that a hash deals next to each other in a split of their tile; linear in its rows."""
    columns = [c for c in tiles.columns if c not in ("token", "size", "guest", "earlier")]
    dealt = tiles.select("token", "size", *columns).withColumn("place", F.xxhash64("token", "doc_id")).withColumn("split", F.pmod("place", F.ceil(F.col("size") / _SPLIT_ROWS)))
    order = Window.partitionBy("token", "split").orderBy("place", "doc_id")
    others = F.array(*[F.lag(F.struct(*columns), k).over(order) for k in range(1, _NEIGHBOURS + 1)])
    fits = lambda p: p.isNotNull() & (p["component"] != F.col("component")) & _room(F.col, lambda c: p[c], percent)
    near = dealt.withColumn("others", others).select("doc_id", F.explode(F.transform(F.filter("others", fits), lambda p: p["doc_id"])).alias("other"))
    return near.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"))


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(texts.select("text"), width))  # two tables of 65,536 numbers
    sets = materialize(beside(texts, _sets(levels, width, percent), ["text"], _SET_SCHEMA, keeps=["doc_id"]), "sets")
    verify = _Verifier(texts.where("doc_id IS NOT NULL"), sets, width, percent)

    reps = materialize(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    heads = sets.select("doc_id", "n", "own", "digest", "tokens", "salts", "slots").join(reps.select("digest", F.col("rep").alias("doc_id")), ["doc_id", "digest"])
    entries = heads.select("doc_id", "n", "own", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("salts").alias("salt"), F.col("slots").alias("slot"))))
    entries = entries.withColumn("guest", F.col("slot") >= F.col("own")).drop("own")
    split = Window.partitionBy("token", "salt")
    tiles = materialize(
        entries.select(
            "token", "salt", "doc_id", "n", "slot", "guest", F.min(F.struct("doc_id", "n")).over(split).alias("first"), F.count("*").over(split).alias("size"), F.min("guest").over(split).alias("guests")
        ).where("(size > 1 AND NOT guests) OR salt >= 0").drop("size", "guests"),
        "tiles",
    )

    # Stars: each document with the first of its split, and these with the first of their tile.
    firsts = tiles.where("salt >= 0 AND doc_id = first.doc_id").select("token", "doc_id", "n")
    tops = firsts.groupBy("token").agg(F.min(F.struct("doc_id", "n")).alias("first"))
    near = tiles.select("doc_id", "n", "first").union(firsts.join(tops, "token").select("doc_id", "n", "first"))
    stars = near.where((F.col("doc_id") != F.col("first.doc_id")) & _sizes_fit("n", "first.n", percent))
    links = verify(stars.select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    linked = components(links)

    # Tiles with more than one component left, and a document whose own band it is.
    named = tiles.select("token", "doc_id", "n", "slot", "guest").join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.select("token", "doc_id", "n", "slot", "guest", F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.min("guest").alias("guests"))
    parts = sets.where("n > 0").select("doc_id", "n", "digest", "whole", "sizes", "bits", "tokens", "slots").dropDuplicates(["doc_id", "digest"])
    slot, from_ = F.col("slot"), F.array_position("slots", F.col("slot"))
    open_tiles = materialize(
        named.join(mixed.where("lo < hi AND NOT guests").select("token", "size"), "token").join(parts, ["doc_id", "n"]).select(
            "token", "size", "doc_id", "component", "n", "guest", F.get("sizes", slot).alias("m"), F.get("bits", 2 * slot).alias("b0"), F.get("bits", 2 * slot + 1).alias("b1"),
            *[F.get("whole", F.lit(k)).alias(f"w{k}") for k in range(_LEAST_BITS // 64)],
            # The prefix shingles of the part that come before this one, in the one order of all. In a small tile a pair may count again.
            F.when(F.col("size") >= _SMALL_TILE, F.slice("tokens", from_.cast("int"), (F.array_position("tokens", F.col("token")) - from_).cast("int"))).alias("earlier"),
        ),
        "mixed",
    )
    discard(tiles)

    # Large tiles: each document with a few others of its tile, as dealt by a hash, before all are joined.
    dealt = verify(_few_of_tile(open_tiles.where(F.col("size") >= _LARGE_TILE), percent).distinct())
    links = links.union(dealt)
    linked = components(links)
    moved = linked.select(F.col("node").alias("doc_id"), F.col("component").alias("now"))
    x, y = (
        open_tiles.join(moved, "doc_id", "left").withColumn("component", F.coalesce("now", "component"))
        .select(*[F.col(c).alias(f"{side}_{c}") for c in open_tiles.columns if c != "size"])
        for side in "xy"
    )
    candidates = x.join(
        y,
        (F.col("x_token") == F.col("y_token")) & (F.col("x_component") < F.col("y_component")) & ~(F.col("x_guest") & F.col("y_guest"))
        & _room(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"), percent) & ~F.coalesce(F.arrays_overlap("x_earlier", "y_earlier"), F.lit(False)),
    ).select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"))
    more = verify(candidates.distinct())
    discard(open_tiles)
    final = components(links.union(more))

    classes = materialize(
        reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "classes"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        sets.select("doc_id", "n", "digest").join(classes, "digest", "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"))
