"""Packing documents into token windows by best-fit decreasing.

A document is its token ids and then one end id. Overlong documents are first
cut into full windows; what is left of each document is one piece. Pieces of
one length are interchangeable, so best-fit decreasing needs only the number of
pieces of each length - a table of at most ``window`` rows, whatever the corpus
size. It is run over that table: a segment tree indexed by remaining capacity
finds the tightest open window, and whole ranges of windows are filled at once.
The outcome, per length a list of placements (window range, offset), is then
joined to the pieces by their rank among the pieces of their length. Ranks come
from per-partition counters, so a length that a third of all pieces share is
never gathered in one task.

Defined results: null or empty text is a document of the end id only; an empty
table packs into nothing; repeated rows are packed each on their own; a null
doc_id is kept as it is; other columns are ignored. The string of a special
token in a text is that token, as the vocabulary's own encoder has it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Made, beside, materialize, table

WINDOW = 2048
END_ID = 1
PIECES = "start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    """Token ids of a byte-level BPE vocabulary file.

    Texts of Latin letters and common signs go through a faster engine over the
    same ranks; the two agree there. Any other text, and one with the string of a
    special token, takes the vocabulary's own encoder, as the engines' Unicode
    tables may differ.
    """

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self._full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        back = {c: b for b, c in self._alphabet().items()}
        vocabulary, special = model["vocab"], {t.content for t in self._full.get_added_tokens_decoder().values()}
        ranks = {bytes(back[c] for c in token): rank for token, rank in vocabulary.items() if token not in special}
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._odd = regex.compile("|".join([r"[^\x00-\x7e¡-ɏ‐-‧€]", *map(regex.escape, sorted(special))]))

    @staticmethod
    def _alphabet() -> dict[int, str]:
        """The printable stand-in of every byte in such vocabulary files."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def ids(self, text: str) -> list[int]:
        if self._odd.search(text):
            return self._full.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def _pieces(window: int, path: str):
    def factory() -> Callable[[pd.DataFrame], Iterator[Made]]:
        import zlib

        from pyspark import TaskContext

        tokenizer, part = ByteTokenizer(path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        names = [c.split()[0] for c in PIECES.split(", ")]

        def cut(batch: pd.DataFrame) -> Iterator[Made]:
            at, rows = [], []
            for k, text in enumerate(batch["text"]):
                ids = np.array([*tokenizer.ids(text or ""), END_ID], dtype="<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    at.append(k)
                    rows.append((start, n, zlib.crc32(piece.tobytes()), len(ids), part, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            if rows:
                yield at, dict(zip(names, zip(*rows, strict=True), strict=True))

        return cut

    return factory


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document into pieces; ``nth`` counts the pieces of a length within a partition."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return beside(source, _pieces(window, path or vocabulary_path()), ["text"], PIECES, keeps=["doc_id"])


class _Capacities:
    """Segment tree over remaining capacities 0..window: the smallest one >= need with an open window."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]

    def _mark(self, r: int) -> None:
        i = r + self.size
        self.any[i] = bool(self.ranges[r])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def push(self, r: int, first: int, count: int, used: int) -> None:
        if r and count:
            self.ranges[r].append((first, count, used))
            self._mark(r)

    def pop(self, need: int) -> tuple[int, int, int, int] | None:
        i = need + self.size
        if not self.any[i]:
            while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        r = i - self.size
        found = self.ranges[r].pop()
        self._mark(r)
        return (r, *found)


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements for ``counts[length]`` pieces, and the number of windows.

    A placement ``(length, rank, upto, first, each, offset)`` puts the pieces of
    that length with ranks rank..upto-1, ``each`` per window, into the windows
    from ``first`` on, starting at ``offset``.
    """
    tree, placed, windows = _Capacities(window), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = tree.pop(length)
            if found:
                room, first, count, used = found
            else:
                room, first, used = window, windows, 0
                count = -(-left // (window // length))
                windows += count
            each = room // length
            full = min(count, left // each)
            if full:
                placed.append((length, rank, rank + full * each, first, each, used))
                tree.push(room - each * length, first, full, used + each * length)
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if left and count:  # fewer than `each` are left: one window more
                placed.append((length, rank, rank + left, first, left, used))
                tree.push(room - left * length, first, 1, used + left * length)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            tree.push(room, first, count, used)
    return placed, windows


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, window, path, id_col, text_col), "pieces")
    tally = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= window rows
    placed, _ = best_fit_decreasing(counts, window)
    bases = tally.selectExpr("part", "length", "sum(n) OVER (PARTITION BY length ORDER BY part ROWS UNBOUNDED PRECEDING) - n AS base")
    plan = spark.createDataFrame(placed or [(0, 0, 0, 0, 1, 0)], "length int, low long, upto long, first long, each long, at long")
    # Placements of a length are few (their number depends on the window, not on the corpus).
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    step = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "plan_length")), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("upto")))
        .select(
            "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
            (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.pmod(step, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
