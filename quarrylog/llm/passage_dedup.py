"""Substring dedup: paragraph MinHash banding, exact Jaccard, removals by components.

Passages are repeated at any place of a line, and few texts mark paragraphs, so
a paragraph is cut by content: it is the ``length`` words that start at an
anchor, a word whose five-word hash is the least of ``spacing`` in a row. Equal
passages have equal anchors wherever they stand, and any length + spacing - 1 = 26
equal words hold a whole paragraph. Two passages of 50 words or more with separate
edits and a Jaccard similarity of at least 3/4 have so many equal words in a row.

Every paragraph gets a MinHash signature over its word shingles, cut into
bands; the number of bands is tuned so that a pair at the threshold collides
with probability ``recall``. Paragraphs of one digest are one node. Each node
of a band bucket is compared with the bucket's least, by the exact Jaccard
similarity of the shingles; buckets that still hold two components are joined
whole, pairs of different components only. Buckets all of whose paragraphs stand in
one and the same document are left out. A component is a class of paragraphs; it
counts if it stands in more than one document; what only repeats within one
document is left alone.

Paragraphs are seeds of passages: each place of a class is aligned with the class's
first place (of the smallest doc_id) and extended word by word to both sides, also
past edits of at most ``EDIT`` words that ``width`` equal words follow, as long as
the exact Jaccard similarity of the two sides holds. Passages of fewer than ``LEAST``
words don't count. The first places stay, the others are removals; overlapping ones
of a document are merged into spans. At most ``REACH`` words beyond the outer
paragraphs of a passage are looked at: its equal words end less than ``spacing``
words from a paragraph of it. Fewer than ``width`` words between an edit and the
end of a passage stay.

Defined results: null and empty texts have no paragraph; a text of fewer than
``LEAST`` words is one paragraph as a whole, so it is compared with other such
texts, and counts at any length; rows with a null doc_id are left alone; rows that
repeat a doc_id are one document; the spans don't depend on the rows' order or
partitions; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import Made, beside, components, discard, free_name, materialize, others, slices, table
from .shingles import mix, shingle_hashes, texts_hashes, word_hashes

LENGTH, SPACING, WIDTH, PERCENT, ROWS, RECALL = 12, 15, 5, 75, 2, 0.9
#: Words of a passage at least, words looked at beyond its outer paragraphs, and words of one edit.
LEAST, REACH, EDIT = 24, 64, 3
#: Rows of a split of a bucket, and the neighbours that a paragraph meets in it.
_SPLIT_ROWS, _NEIGHBOURS = 64, 4
_EDITS = sorted(((a, b) for a in range(EDIT + 1) for b in range(EDIT + 1) if a + b), key=lambda e: (max(e), abs(e[0] - e[1]), e))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tuned_bands(percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands that collide with probability ``recall`` at the threshold."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows)))


def anchors(shingles: np.ndarray, length: int, spacing: int, width: int) -> np.ndarray:
    """Starts of paragraphs: positions whose shingle is the least of ``spacing`` in a row."""
    last = len(shingles) - (length - width)  # starts of whole paragraphs
    if last <= 0:
        return np.empty(0, dtype=np.int64)
    h = mix(shingles[:last])
    if last <= spacing:
        return np.array([int(h.argmin())])
    # Least of every window by doubling: spans of 1, 2, 4 ... up to the spacing.
    packed = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(last, dtype=np.uint64)  # the position settles ties and is what we look for
    low, span = packed, 1
    while span * 2 <= spacing:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: last - spacing + 1], low[spacing - span : spacing - span + last - spacing + 1])
    return np.unique(low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchors_of(shingles: np.ndarray, begin: np.ndarray, starts: np.ndarray, spacing: int) -> np.ndarray:
    """The anchors of several texts whose shingles stand one after the other, from ``begin`` on, with over ``spacing`` starts each."""
    n = len(shingles) - spacing + 1
    if not len(begin) or n <= 0:
        return np.empty(0, dtype=np.int64)
    low, span = (mix(shingles) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(shingles), dtype=np.uint64), 1
    while span * 2 <= spacing:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[spacing - span : spacing - span + n])
    inside = np.zeros(len(shingles) + 1, dtype=np.int8)  # windows that don't reach into the next text
    inside[begin] += 1
    inside[begin + starts - spacing + 1] -= 1
    at = (low[np.cumsum(inside[:n], dtype=np.int8) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


class _Signer:
    def __init__(self, rows: int, bands: int) -> None:
        k = np.arange(1, rows * bands + 1, dtype=np.uint64)
        self.rows, self.bands, self.factors = rows, bands, mix(k) | np.uint64(1)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Band keys (paragraphs x bands) of paragraphs' shingles (paragraphs x shingles)."""
        out = np.empty((len(windows), self.bands), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for b in range(self.bands):
                key = np.full(len(windows), b + 1, dtype=np.uint64)
                for f in self.factors[b * self.rows : (b + 1) * self.rows]:
                    key = mix(key ^ ((windows * f) >> np.uint64(8)).min(axis=1))
                out[:, b] = key
        return out


def _digests(windows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((windows * mix(np.arange(1, windows.shape[1] + 1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)).view(np.int64)


#: Kinds of paragraphs: cut from a text, or a short text as a whole.
CUT, WHOLE = 0, 1
#: Bytes of texts that are hashed at once.
_TEXTS = 1 << 19


def _found_schema(bands: int) -> str:
    """``place`` is the start of a paragraph that is cut from a text, and less than 0 the size of a whole text."""
    keys = ", ".join(f"k{b} long" for b in range(bands))
    return f"doc_id long, place int, digest long, carrier boolean, d_span long, {keys}"


def _place(place: str, length: int) -> list[Column]:
    """Start, size and kind of a paragraph."""
    whole = F.col(place) < 0
    start, size = F.when(whole, 0).otherwise(F.col(place)), F.when(whole, -F.col(place)).otherwise(length)
    return [start.cast("long").alias("start"), size.cast("int").alias("size"), F.when(whole, WHOLE).otherwise(CUT).alias("kind")]


def _ranges(digest: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct digest one position, and the least and largest of its ids."""
    order = np.lexsort((ids, digest))
    ordered = digest[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    last = np.append(first[1:], len(order)) - 1
    return order[first], ids[order[first]], ids[order[last]]


def _pieces(texts: list[bytes | None], most: int = _TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about ``most`` bytes together."""
    first = held = 0
    for k, text in enumerate(texts):
        held += len(text or b"")
        if held >= most:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _paragraphs(length: int, spacing: int, width: int, signer: _Signer):
    reach = np.arange(length - width + 1)

    def frame(kind: int, size: int, ids: list, starts: list, windows: list) -> pd.DataFrame:
        w = np.concatenate(windows)
        digest, doc_ids = _digests(w), np.concatenate(ids)
        # One of a digest, of its least document, brings its band keys along, and the range of its documents in this batch.
        at, d_lo, d_hi = _ranges(digest, doc_ids)
        place = np.full(len(w), -size, dtype=np.int32) if kind == WHOLE else np.concatenate(starts).astype(np.int32)
        made = {"doc_id": doc_ids, "place": place, "digest": digest}
        for name, values in (("carrier", True), ("d_span", d_hi - d_lo), *((f"k{b}", k) for b, k in enumerate(signer.keys(w[at]).view(np.int64).T))):
            made[name] = np.zeros(len(w), dtype=bool if name == "carrier" else np.int64)
            made[name][at] = values
        return pd.DataFrame(made)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: dict[tuple[int, int], tuple[list, list, list]] = {}

            def add(kind: int, size: int, doc_ids: np.ndarray, at: np.ndarray, windows: np.ndarray) -> None:
                for held, new in zip(parts.setdefault((kind, size), ([], [], [])), (doc_ids, at, windows), strict=True):  # noqa: B023
                    held.append(new)

            ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for low, high in _pieces(texts):
                words, bounds = texts_hashes(texts[low:high])
                if not len(words):
                    continue
                # Of all texts in one go; those shingles that reach into the next text are never looked at.
                s = shingle_hashes(words, width)
                begin, n, doc_ids = bounds[:-1], np.diff(bounds), ids[low:high]
                starts = n - length + 1
                many = np.flatnonzero((n >= LEAST) & (starts > spacing))
                at = _anchors_of(s, begin[many], starts[many], spacing)
                of = many[np.searchsorted(begin[many], at, "right") - 1]
                if len(at):
                    add(CUT, length, doc_ids[of], at - begin[of], s[at[:, None] + reach])
                for k in np.flatnonzero((n > 0) & ((n < LEAST) | (starts <= spacing))).tolist():
                    own = shingle_hashes(words[bounds[k] : bounds[k + 1]], width)
                    if n[k] >= LEAST:
                        at = anchors(own, length, spacing, width)
                        add(CUT, length, np.full(len(at), doc_ids[k]), at, own[at[:, None] + reach])
                    else:
                        add(WHOLE, int(n[k]), doc_ids[k : k + 1], np.zeros(1, dtype=np.int64), own[None, :])
            for (kind, size), held in parts.items():
                yield frame(kind, size, *held)

    return run


def _contents(width: int):
    def described(windows: np.ndarray) -> pd.DataFrame:
        """Digest, sorted shingles, their number and a parity bitmap of paragraphs of one size."""
        x = np.sort(windows, axis=1)
        again = np.zeros(x.shape, dtype=bool)
        again[:, 1:] = x[:, 1:] == x[:, :-1]
        bit, once = x & np.uint64(127), ~again
        halves = [np.bitwise_xor.reduce(np.where(once & ((bit >> np.uint64(6)) == h), np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), axis=1).view(np.int64) for h in (0, 1)]
        raws = [row.tobytes() if whole else row[keep].tobytes() for row, keep, whole in zip(x, once, ~again.any(axis=1), strict=True)]
        return pd.DataFrame({"digest": _digests(windows), "x": raws, "n": once.sum(axis=1), "b0": halves[0], "b1": halves[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column("text").to_pylist(), batch.column("wanted")
            for low, high in _pieces(texts):
                words, bounds = texts_hashes(texts[low:high])
                lists = wanted.slice(low, high - low)
                at, size, digest = (lists.flatten().field(c).to_numpy() for c in ("start", "size", "digest"))
                of = np.repeat(np.arange(high - low), lists.value_lengths().to_numpy())
                # Shingles of all texts in one go; what reaches beyond its text is left out. Texts below the width are one shingle.
                s, n = shingle_hashes(words, width) if len(words) >= width else np.empty(0, dtype=np.uint64), np.diff(bounds)
                for wide in np.unique(size).tolist():
                    k = np.flatnonzero((size == wide) & (at + wide <= n[of]) & ((wide >= width) | (n[of] == wide)))
                    if not len(k):
                        continue
                    places = bounds[of[k]] + at[k]
                    if wide < width:
                        windows = np.stack([shingle_hashes(words[p : p + wide], width) for p in places.tolist()])
                    else:
                        windows = s[places[:, None] + np.arange(wide - width + 1)]
                    made = described(windows)
                    made = made[made["digest"] == digest[k]]  # of rows that share a doc_id the right one
                    yield pa.RecordBatch.from_pandas(made, schema, preserve_index=False)

    schema = to_arrow_schema(StructType.fromDDL(_CONTENTS))
    return run


_CONTENTS = "digest long, x binary, n int, b0 long, b1 long"


def _verified(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for xa, xb in zip(batch["xa"], batch["xb"], strict=True):
                a, b = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


def contents(digests: DataFrame, texts: DataFrame, width: int, length: int) -> DataFrame:
    """Of each digest its sorted shingles, their number and a parity bitmap, from the place (doc_id, place) where it stands."""
    w = F.struct(*_place("place", length)[:2], "digest").alias("w")
    wanted = digests.select("doc_id", w).groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    return materialize(texts.join(wanted, "doc_id").select("text", "wanted").mapInArrow(_contents(width), _CONTENTS).dropDuplicates(["digest"]), "contents")


def _links(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of digests whose paragraphs are similar enough."""
    on = lambda k: known.select(F.col("digest").alias(k), F.col("x").alias(f"x{k}"))
    return materialize(pairs.distinct().join(on("a"), "a").join(on("b"), "b").mapInPandas(_verified(percent), "a long, b long"), "links")


def _room(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Bits in which two parity bitmaps differ are at most the shingles in which the paragraphs do: a bound on the overlap."""
    both = x("n") + y("n")
    differ = F.bit_count(x("b0").bitwiseXOR(y("b0"))) + F.bit_count(x("b1").bitwiseXOR(y("b1")))
    return (both - differ) * (100 + percent) >= both * (2 * percent)


def _few_of_bucket(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of digests that a hash deals next to each other in a split of their bucket; linear in its rows."""
    sized = rest.withColumn("size", F.count("*").over(Window.partitionBy("key"))).withColumn("place", F.xxhash64("key", "digest"))
    order = Window.partitionBy("key", F.pmod("place", F.ceil(F.col("size") / _SPLIT_ROWS))).orderBy("place", "digest")
    others = F.array(*[F.lag(F.struct("digest", "component", "n", "b0", "b1"), k).over(order) for k in range(1, _NEIGHBOURS + 1)])
    fits = lambda p: p.isNotNull() & (p["component"] != F.col("component")) & _room(F.col, lambda c: p[c], percent)
    near = sized.withColumn("others", others).select("digest", F.explode(F.transform(F.filter("others", fits), lambda p: p["digest"])).alias("other"))
    return near.select(F.least("digest", "other").alias("a"), F.greatest("digest", "other").alias("b"))


def repeated_passages(docs: DataFrame, length: int = LENGTH, spacing: int = SPACING, width: int = WIDTH, percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """Spans of words that repeat across documents.

    One row per span: doc_id, start_word, end_word (exclusive), component_id
    (the smallest doc_id that shares a paragraph of the span), n_documents (of
    its widest class) and removed (false where the document is that smallest).
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signer = _Signer(rows, tuned_bands(percent, rows, recall))
    found = materialize(texts.mapInPandas(_paragraphs(length, spacing, width, signer), _found_schema(signer.bands)), "paragraphs")

    # Band buckets with several digests from several documents. Copies of a paragraph bring their keys once per
    # batch, with the range of all its documents there, so no key is hot through copies and the range of a bucket
    # is that of all places of its paragraphs; overlapping paragraphs of one document don't count.
    carried = found.where("carrier").withColumnRenamed("doc_id", "d_lo")
    entries = carried.select(F.explode(F.array(*[f"k{b}" for b in range(signer.bands)])).alias("key"), "digest", "d_lo", "d_span")
    bucket = Window.partitionBy("key")
    low, high = F.min("digest").over(bucket).alias("lo"), F.max("digest").over(bucket).alias("hi")
    seen = entries.select("key", "digest", low, high, F.min("d_lo").over(bucket).alias("d_lo"), F.max(F.col("d_lo") + F.col("d_span")).over(bucket).alias("d_hi"))
    buckets = materialize(seen.where("lo < hi AND d_lo < d_hi").select("key", "digest", "lo").distinct(), "buckets")
    stars = buckets.where("digest <> lo").select(F.col("lo").alias("a"), F.col("digest").alias("b"))
    # Digests of several documents or in a bucket, with their documents' range and any one place; the many others are
    # done with. Only longs are aggregated, and the small side of each join is hashed, so that nothing sorts all paragraphs.
    ranges = carried.groupBy("digest").agg(F.min("d_lo").alias("d_lo"), F.max(F.col("d_lo") + F.col("d_span")).alias("d_hi"), F.first("d_lo").alias("doc_id"), F.first("place").alias("place"))
    compared = buckets.select("digest").distinct().withColumn("compared", F.lit(True))
    digests = materialize(ranges.join(compared.hint("shuffle_hash"), "digest", "left").where("compared OR d_lo < d_hi"), "digests")
    known = contents(digests.where("compared"), texts, width, length)
    links = _links(stars, known, percent)
    named = buckets.join(components(links).withColumnRenamed("node", "digest"), "digest", "left").select("key", "digest", F.coalesce("component", "digest").alias("component"))
    left = named.groupBy("key").agg(F.min("component").alias("c_lo"), F.max("component").alias("c_hi")).where("c_lo < c_hi").select("key")
    # The least digest of a bucket has been compared with all others of it.
    least = buckets.groupBy("key").agg(F.min("lo").alias("lo"))
    rest = named.join(left, "key").join(least, "key").where("digest <> lo").select("key", "digest", "component")
    rest = materialize(rest.join(known.select("digest", "n", "b0", "b1"), "digest"), "rest")
    # First each meets a few others of its bucket, as dealt by a hash; then what is left is joined whole.
    links = links.union(_links(_few_of_bucket(rest, percent), known, percent))
    moved = components(links).select(F.col("node").alias("digest"), F.col("component").alias("now"))
    rest = rest.join(moved, "digest", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
    x, y = (rest.select(*[F.col(c).alias(f"{s}_{c}") for c in rest.columns]) for s in "xy")
    room = _room(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"), percent)
    more = x.join(y, (F.col("x_key") == F.col("y_key")) & (F.col("x_component") < F.col("y_component")) & room)
    links = links.union(_links(more.select(F.least("x_digest", "y_digest").alias("a"), F.greatest("x_digest", "y_digest").alias("b")), known, percent))

    classed = digests.join(components(links).withColumnRenamed("node", "digest"), "digest", "left").select("digest", "d_lo", "d_hi", F.coalesce("component", "digest").alias("class"))
    wide = classed.groupBy("class").agg(F.min("d_lo").alias("first"), F.max("d_hi").alias("last")).where("first < last").drop("last")
    classes = materialize(classed.select("digest", "class").join(wide, "class"), "classes")
    hits = found.select("digest", "doc_id", "place").join(classes.hint("shuffle_hash"), "digest")
    hits = materialize(hits.select("class", "first", "doc_id", *_place("place", length)), "hits")
    discard(found, buckets, known, digests, classes)
    # The first place of a class is in its smallest document.
    starts = hits.groupBy("class", "first", "doc_id").agg(F.min("start").alias("start"))
    counts = materialize(starts.groupBy("class").agg(F.count("*").alias("n_documents"), F.min(F.when(F.col("doc_id") == F.col("first"), F.col("start"))).alias("f_start")), "counts")
    places = hits.join(counts, "class").select("doc_id", "start", "size", "first", "f_start", "n_documents", "kind")
    spans = materialize(extended(places, texts, width, percent), "spans")
    discard(hits, counts)
    # Of a document: spans in order; one ends where the next one starts beyond its end.
    joined = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "first", "n_documents"))).alias("hits"))
    return joined.mapInPandas(_merged, "doc_id long, start_word long, end_word long, component_id long, n_documents long, removed boolean")


def extended(hits: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Passages around the places ``hits`` (doc_id, start, size, first, f_start, n_documents, kind), in both documents: doc_id, start, end, first, n_documents."""
    pairs = hits.where("doc_id <> first").groupBy("doc_id").agg(F.collect_set(F.struct("first", (F.col("start") - F.col("f_start")).alias("shift"), "start", "size", "n_documents", "kind")).alias("hits"))
    chains = materialize(pairs.mapInArrow(_chained, "doc_id long, first long, f_from long, f_to long, seeds array<long>, n_documents long"), "chains")
    # The words of the first place travel to the document; a stretch is read once however many documents repeat it.
    stretches = chains.select("first", "f_from", "f_to").distinct()
    wanted = stretches.groupBy("first").agg(F.collect_list(F.struct("f_from", "f_to")).alias("wanted")).withColumnRenamed("first", "doc_id")
    words = materialize(texts.join(wanted, "doc_id").mapInPandas(_stretches, "first long, f_from long, f_to long, words binary").groupBy("first", "f_from", "f_to").agg(F.min("words").alias("words")), "stretches")
    sides = chains.join(words, ["first", "f_from", "f_to"]).groupBy("doc_id").agg(F.collect_list(F.struct("first", "f_from", "seeds", "words", "n_documents")).alias("chains"))
    found = texts.join(sides, "doc_id").mapInArrow(_aligned(width, percent), "doc_id long, start long, end long, first long, n_documents long")
    return found.distinct()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of one document on one shift against one first document, cut where they stand far apart."""
    for batch in batches:
        hits = batch.column("hits")
        row = np.repeat(np.arange(batch.num_rows), hits.value_lengths().to_numpy())
        if not len(row):
            continue
        h = {name: hits.flatten().field(name).to_numpy() for name in ("first", "shift", "start", "size", "n_documents", "kind")}
        order = np.lexsort((h["kind"], h["size"], h["start"], h["shift"], h["first"], row))
        row, h = row[order], {name: values[order] for name, values in h.items()}
        at = h["start"] - h["shift"]
        other = np.ones(len(row), dtype=bool)
        other[1:] = (row[1:] != row[:-1]) | (h["first"][1:] != h["first"][:-1]) | (h["shift"][1:] != h["shift"][:-1])
        # The largest end so far, of one shift and first document: the ends of each such group lie above those of the ones before.
        above = np.cumsum(other) << 32
        end = np.maximum.accumulate(above + at + h["size"]) - above
        begins = np.flatnonzero(other | np.concatenate(([True], at[1:] > end[:-1] + REACH)))
        ends = np.append(begins[1:], len(row)) - 1
        seeds = np.column_stack((h["start"], at, h["size"], h["kind"])).astype(np.int64).ravel()
        columns = {
            "doc_id": batch.column("doc_id").to_numpy()[row[begins]],
            "first": h["first"][begins],
            "f_from": np.maximum(0, at[begins] - REACH),
            "f_to": end[ends] + REACH,
            "seeds": pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)) * 4, pa.int32()), pa.array(seeds)),
            "n_documents": np.maximum.reduceat(h["n_documents"], begins),
        }
        yield pa.RecordBatch.from_pydict({name: values if name == "seeds" else pa.array(values, pa.int64()) for name, values in columns.items()})


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches, 100):
        rows = []
        for doc_id, text, wanted in zip(batch["doc_id"], batch["text"], batch["wanted"], strict=True):
            w = (word_hashes(text) >> np.uint64(32)).astype("<u4")
            rows.extend((doc_id, x["f_from"], x["f_to"], w[x["f_from"] : x["f_to"]].tobytes()) for x in wanted)
        yield pd.DataFrame(rows, columns=["first", "f_from", "f_to", "words"])


def _reach(x: np.ndarray, y: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Lengths of both sides that agree from their start on, one for each edit passed."""
    i = j = 0
    ends = []
    while True:
        run = min(len(x) - i, len(y) - j)
        if run:
            differ = x[i : i + run] != y[j : j + run]
            at = int(differ.argmax())
            run = at if differ[at] else run
        i, j = i + run, j + run
        ends.append((i, j))
        p, q = x[i : i + EDIT + width].tolist(), y[j : j + EDIT + width].tolist()
        most_a, most_b = len(p) - width, len(q) - width
        for a, b in _EDITS:
            if a <= most_a and b <= most_b and p[a] == q[b] and p[a : a + width] == q[b : b + width]:
                i, j = i + a, j + b
                break
        else:
            return ends


def _core(x: np.ndarray, y: np.ndarray, width: int) -> tuple[int, int] | None:
    """Where the first ``width`` equal words stand in two places, which may be a few words apart."""
    if len(x) >= width and np.array_equal(x[:width], y[:width]):
        return 0, 0
    p, q = x.tolist(), y.tolist()
    for shift in sorted(range(width - len(q), len(p) - width + 1), key=abs):
        run = 0
        for i in range(max(0, shift), min(len(p), len(q) + shift)):
            run = run + 1 if p[i] == q[i - shift] else 0
            if run == width:
                return i - width + 1, i - shift - width + 1
    return None


def _set(words: np.ndarray, shingles: np.ndarray, a: int, b: int, width: int) -> set[int]:
    """The shingles of the words from a to b; ``shingles`` are those of all the words."""
    if b - a < width:
        return set(shingle_hashes(words[a:b].astype(np.uint64), width).tolist())
    return set(shingles[a : b - width + 1].tolist())


def passage(d: np.ndarray, d_shingles: np.ndarray, f: np.ndarray, f_shingles: np.ndarray, start: int, at: int, size: int, width: int, percent: int) -> tuple[int, int, int, int]:
    """The widest similar passage around the place ``start`` of d and ``at`` of f: its bounds in both."""

    def alike(a: int, b: int, fa: int, fb: int) -> bool:
        if np.array_equal(d[a:b], f[fa:fb]):
            return True
        x, y = _set(d, d_shingles, a, b, width), _set(f, f_shingles, fa, fb, width)
        common = len(x & y)
        return 100 * common >= percent * (len(x) + len(y) - common)

    core = _core(d[start : start + size], f[at : at + size], width)
    if core is None:
        return start, start + size, at, at + size  # linked through others
    s, t = start + core[0], at + core[1]
    right = [(s + i, t + j) for i, j in _reach(d[s:], f[t:], width)]
    left = [(s - i, t - j) for i, j in _reach(d[:s][::-1], f[:t][::-1], width)]
    while True:
        (a, fa), (b, fb) = left[-1], right[-1]
        if alike(a, b, fa, fb):
            return (a, b, fa, fb) if b - a >= size - 2 * EDIT else (start, start + size, at, at + size)
        # Give up the outer piece that is the shorter one.
        short_left = len(left) > 1 and (len(right) == 1 or left[-2][0] - a <= b - right[-2][0])
        (left if short_left else right).pop()


def _goes_on(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, x_end: np.ndarray, y_end: np.ndarray, step: int, width: int) -> np.ndarray:
    """Whether ``width`` equal words follow an edit at i of x and j of y, to the right (``step`` 1) or left (-1), before the ends."""
    out = np.zeros(len(i), dtype=bool)
    room_x, room_y = (x_end - i) * step - width, (y_end - j) * step - width
    for a, b in _EDITS:
        live = np.flatnonzero((a <= room_x) & (b <= room_y) & ~out)
        for k in range(width):
            live = live[x[i[live] + step * (a + k)] == y[j[live] + step * (b + k)]]
        out[live] = True
    return out


def _runs(d: np.ndarray, f: np.ndarray, s: np.ndarray, t: np.ndarray, d_from: np.ndarray, d_to: np.ndarray, f_from: np.ndarray, f_to: np.ndarray, chain: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of seeds at s of d and t of f: the equal words around t in f, and whether the passage is just these, without an edit.

    ``d_from`` to ``f_to`` bound each chain's document and stretch; the seeds of a chain, its number in ``chain``, have one shift.
    """
    shift = np.zeros(len(f_from), dtype=np.int64)
    shift[chain] = s - t
    beside = np.arange(len(f)) + np.repeat(shift, f_to - f_from)
    differ = np.flatnonzero(d[np.clip(beside, 0, len(d) - 1)] != f) if len(d) else np.arange(len(f))
    at = np.searchsorted(differ, t)
    low, high = np.maximum(f_from, d_from - shift)[chain], np.minimum(f_to, d_to - shift)[chain]
    left = np.maximum(low, np.concatenate(([0], differ + 1))[at])
    right = np.minimum(high, np.append(differ, len(f))[at])
    plain = right - t >= width
    # Seeds of one run end at the same edits.
    k = np.flatnonzero(plain)
    if len(k):
        new = np.concatenate(([True], (chain[k][1:] != chain[k][:-1]) | (left[k][1:] != left[k][:-1])))
        r = k[new]
        c = chain[r]
        on = _goes_on(d, f, right[r] + shift[c], right[r], d_to[c], f_to[c], 1, width)
        on |= _goes_on(d, f, left[r] + shift[c] - 1, left[r] - 1, d_from[c] - 1, f_from[c] - 1, -1, width)
        plain[k] = ~on[np.cumsum(new) - 1]
    return left, right, plain


def _aligned(width: int, percent: int):
    def aligned(piece: pa.RecordBatch) -> pa.RecordBatch:
        """Equal passages without edits are found for all chains at once, others one by one."""
        words, bounds = texts_hashes(piece.column("text").to_pylist())
        d = (words >> np.uint64(32)).astype("<u4")
        lists = piece.column("chains")
        chains = lists.flatten()
        first, base, n_documents = (chains.field(c).to_numpy() for c in ("first", "f_from", "n_documents"))
        doc = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy())
        stretches = chains.field("words").to_pylist()
        f = np.frombuffer(b"".join(stretches), "<u4")
        f_to = np.cumsum([len(x) // 4 for x in stretches], dtype=np.int64)
        f_from = np.concatenate(([0], f_to[:-1]))
        seeds = chains.field("seeds").flatten().to_numpy().reshape(-1, 4)
        of = np.repeat(np.arange(len(chains)), chains.field("seeds").value_lengths().to_numpy() // 4)
        s, t = bounds[doc[of]] + seeds[:, 0], f_from[of] + seeds[:, 1] - base[of]
        left, right, plain = _runs(d, f, s, t, bounds[doc], bounds[doc + 1], f_from, f_to, of, width)
        # The shingles of all texts and chains in one go; those that reach into the next one are never looked at.
        d_shingles, f_shingles = shingle_hashes(d.astype(np.uint64), width), shingle_hashes(f.astype(np.uint64), width)
        begins, f_begins, f_ends, docs, bases = bounds.tolist(), f_from.tolist(), f_to.tolist(), doc.tolist(), base.tolist()
        made, last, done = [], -1, 0
        for c, (start, at, size, kind), run, a, b in zip(of.tolist(), seeds.tolist(), plain.tolist(), (left - t).tolist(), (right - t).tolist(), strict=True):
            if c != last:
                last, done = c, 0
            if start + size <= done:
                continue  # inside the passage of the place before
            if run:
                a, b = (a, b) if b - a >= size - 2 * EDIT else (0, size)
                a, b, fa, fb = start + a, start + b, at + a, at + b
            else:
                # Of a long document only the words beside the chain.
                low, high, f_low, f_high = begins[docs[c]], begins[docs[c] + 1], f_begins[c], f_ends[c]
                cut = max(0, start - (at - bases[c]) - EDIT * REACH)
                low, high = min(low + cut, high), min(low + cut + (f_high - f_low) + 2 * EDIT * REACH, high)
                a, b, fa, fb = passage(d[low:high], d_shingles[low:high], f[f_low:f_high], f_shingles[f_low:f_high], start - cut, at - bases[c], size, width, percent)
                a, b, fa, fb = a + cut, b + cut, fa + bases[c], fb + bases[c]
            if kind == CUT and b - a < LEAST:
                continue
            done = b
            made.append((c, a, b, fa, fb))
        c, a, b, fa, fb = np.array(made, dtype=np.int64).reshape(-1, 5).T
        columns = {
            "doc_id": np.concatenate((piece.column("doc_id").to_numpy()[doc[c]], first[c])),
            "start": np.concatenate((a, fa)),
            "end": np.concatenate((b, fb)),
            "first": np.tile(first[c], 2),
            "n_documents": np.tile(n_documents[c], 2),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                yield aligned(batch.slice(at, 200))

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, hits in zip(batch["doc_id"], batch["hits"], strict=True):
            spans: list[list] = []
            last: dict[bool, list] = {}
            for h in hits:
                removed = h["first"] != doc_id
                s = last.get(removed)
                if s and h["start"] <= s[1]:
                    s[1], s[2], s[3] = max(s[1], h["end"]), min(s[2], h["first"]), max(s[3], h["n_documents"])
                else:
                    last[removed] = [h["start"], h["end"], h["first"], h["n_documents"], removed]
                    spans.append(last[removed])
            rows.extend((doc_id, *s) for s in spans)
        yield pd.DataFrame(rows, columns=["doc_id", "start_word", "end_word", "component_id", "n_documents", "removed"])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given ranges of words and the white space after them."""
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a < len(words):
            start, end = words[a][0], words[b][0] if b < len(words) else len(raw)
            out.append(raw[at : max(at, start)])
            at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()


def _cut(tag: str) -> Callable[[pd.DataFrame], Iterator[Made]]:
    def cut(batch: pd.DataFrame) -> Iterator[Made]:
        texts = [t if t is None or s is None else cut_words(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(batch["text"], batch[tag], strict=True)]
        yield range(len(texts)), {"text": texts}

    return cut


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the removed spans of ``repeated_passages`` cut out of their texts; other columns of any type pass."""
    tag, rest = free_name("spans", docs), others(docs, "text")
    spans = passages.where("removed").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias(tag))
    joined = docs.where("doc_id IS NOT NULL").join(spans, "doc_id", "left").select(*rest, "text", tag)
    without = docs.where("doc_id IS NULL").select(*rest, "text", F.lit(None).cast(spans.schema[tag].dataType).alias(tag))
    return beside(joined.union(without), lambda: _cut(tag), ["text", tag], "text string", keeps=rest)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
