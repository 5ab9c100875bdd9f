"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Every token is predicted from the two tokens on either side: the embeddings of
the four, one table per side and distance, are added and passed through a tanh
layer; a two-level softmax gives the token's class and its place in the class.
The vocabulary holds the most frequent words of the whole corpus and grows with
it: at least ``classes`` ** 2 entries, and every word that occurs ``least_count``
times, up to ``most_classes`` ** 2, which bounds what is sent to a task. The rest
is hashed into a few shared entries; a third level is the word's share of its
entry, from its count over all documents, so every word has a probability of its
own and those of all words add up to one. The network is trained in numpy,
data-parallel: each partition starts from the current weights, learns from every
document it holds (every position is a target; a larger ``stride`` takes one in
so many) and its weights are averaged, by the tokens learned from, over the
partitions; so scores depend a little on how the rows are dealt to partitions.
The score of a document is the sum of the conditional log-probabilities of all
its tokens.

Defined results: words are the runs of bytes other than ASCII white space, A-Z
lower-cased; null and empty texts have no token, score 0 and a null mean;
sentence ends of the window are a padding entry; repeated rows are scored each
on their own and a null doc_id stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Made, beside, discard, materialize, table


@dataclass(frozen=True)
class Settings:
    classes: int = 32  # vocabulary: classes * classes entries at least
    most_classes: int = 256  # as many squared at most
    least_count: int = 4000  # a word of so many occurrences gets an entry while there is room
    shared: int = 64  # entries for words outside the list
    dims: int = 24
    reach: int = 2
    stride: int = 1  # 1: every position is a training target
    rounds: int = 1
    rate: float = 0.5
    batch: int = 1024

    @property
    def size(self) -> int:
        return self.classes * self.classes


def outside(word: bytes) -> int:
    """The code of a word that isn't in the list."""
    return -1 - (xxhash.xxh3_64_intdigest(word) >> 1)


class Vocabulary(dict):
    """Word -> entry; words outside the list share the last entries by hash."""

    def __init__(self, words: list[bytes], s: Settings) -> None:
        super().__init__({w: k for k, w in enumerate(words)})
        self.first, self.shared, self.known = s.size - s.shared, s.shared, len(words)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            for key in list(self)[self.known :]:
                del self[key]
        value = self[word] = outside(word)
        return value

    def codes(self, text: bytes | None) -> np.ndarray:
        """Per word its entry, or -1 - hash outside the list."""
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < 0, self.first + (-1 - codes) % self.shared, codes)


_AVERAGED = 8  # partitions whose weights a task averages
_MOST_WORDS = 300_000  # words that a task holds before it hands them on


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from collections import Counter

    seen: Counter = Counter()

    def counted() -> pd.DataFrame:
        return pd.DataFrame({"word": list(seen), "code": [outside(w) for w in seen], "n": list(seen.values())})

    for batch in batches:
        for text in batch["text"]:
            if text:
                seen.update(text.lower().split())
        if len(seen) > _MOST_WORDS:
            yield counted()
            seen.clear()
    yield counted()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, code, n) of every word of all texts; ``code`` is that of a word outside the list."""
    return materialize(texts.mapInPandas(_count_words, "word binary, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n")), "words")


def vocabulary(texts: DataFrame, s: Settings, counts: DataFrame | None = None) -> list[bytes]:
    """The most frequent words of all texts, by count and then by bytes."""
    counts = word_counts(texts) if counts is None else counts
    frequent = counts.where(F.col("n") >= s.least_count).count()
    room = min(max(frequent, s.size - s.shared), max(s.classes, s.most_classes) ** 2 - s.shared)
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(room).collect()]  # at most most_classes ** 2


def grown(s: Settings, words: list[bytes]) -> Settings:
    """Settings whose vocabulary has room for ``words``."""
    return replace(s, classes=max(s.classes, math.isqrt(max(0, len(words) + s.shared - 1)) + 1))


def initial(s: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "emb": draw(2 * s.reach, s.size + 1, s.dims), "bias": np.zeros(s.dims, np.float32),
        "major": draw(s.dims, s.classes), "major_bias": np.zeros(s.classes, np.float32),
        "minor": draw(s.dims, s.classes), "minor_bias": draw(s.classes, s.classes),
    }


def _context(ids: np.ndarray, at: np.ndarray, s: Settings) -> np.ndarray:
    padded = np.concatenate((np.full(s.reach, s.size, np.int32), ids, np.full(s.reach, s.size, np.int32)))
    offsets = [*range(-s.reach, 0), *range(1, s.reach + 1)]
    return np.stack([padded[at + s.reach + o] for o in offsets])


def _hidden(w: dict, context: np.ndarray) -> np.ndarray:
    total = w["emb"][0].take(context[0], axis=0)
    total += w["bias"]
    for k in range(1, len(context)):
        total += w["emb"][k].take(context[k], axis=0)
    return np.tanh(total, out=total)


def _logits(w: dict, hidden: np.ndarray, major: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = hidden @ w["major"], hidden @ w["minor"]
    a += w["major_bias"]
    b += w["minor_bias"].take(major, axis=0)
    return a, b


def _exponents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | np.float32]:
    """exp(x - top) and its sums by row; ``top`` is the largest of all, or of each row if that leaves a row too small."""
    top = x.max()
    e = np.exp(x - top)
    total = e @ np.ones(x.shape[1], np.float32)
    if total.min() < 1e-25:
        top = x.max(axis=1, keepdims=True)
        e = np.exp(x - top)
        total, top = e.sum(axis=1), top[:, 0]
    return e, total, top


def _target_log_softmax(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-softmax of every row at its target."""
    _, total, top = _exponents(x)
    return x[np.arange(len(x)), target] - top - np.log(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    e, total, _ = _exponents(x)
    e *= (1 / total)[:, None]
    return e


def log_likelihood(w: dict, ids: np.ndarray, s: Settings, chunk: int = 2048) -> float:
    """Sum over all tokens of the log-probability given both sides."""
    total = 0.0
    for start in range(0, len(ids), chunk):
        at = np.arange(start, min(start + chunk, len(ids)))
        major, minor = np.divmod(ids[at], s.classes)
        a, b = _logits(w, _hidden(w, _context(ids, at, s)), major)
        total += float(_target_log_softmax(a, major).sum(dtype=np.float64) + _target_log_softmax(b, minor).sum(dtype=np.float64))
    return total


def _subtract_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """np.subtract.at for whole rows, by sums over the sorted rows."""
    order = rows.argsort()
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    table[ordered[first]] -= np.add.reduceat(values.take(order, axis=0), first, axis=0)


def step(w: dict, context: np.ndarray, target: np.ndarray, s: Settings) -> None:
    """One gradient step, in place."""
    n, row = len(target), np.arange(len(target))
    major, minor = np.divmod(target, s.classes)
    hidden = _hidden(w, context)
    a, b = _logits(w, hidden, major)
    ga, gb = _softmax(a), _softmax(b)
    ga[row, major] -= 1.0
    gb[row, minor] -= 1.0
    back = ga @ w["major"].T
    back += gb @ w["minor"].T
    back *= (1.0 - hidden * hidden) * np.float32(1 / n)
    rate = np.float32(s.rate / n)
    w["major"] -= rate * (hidden.T @ ga)
    w["major_bias"] -= rate * (np.ones(n, np.float32) @ ga)
    w["minor"] -= rate * (hidden.T @ gb)
    gb *= rate
    _subtract_rows(w["minor_bias"], major, gb)
    w["bias"] -= s.rate * back.sum(axis=0)
    back *= s.rate * 8.0  # few rows per batch: larger steps
    for k, c in enumerate(context):
        _subtract_rows(w["emb"][k], c, back)


def _pack(w: dict) -> list[bytes]:
    return [w[k].astype("<f4").tobytes() for k in sorted(w)]


def _encode(shipped, s: Settings):
    def factory() -> Callable[[pd.DataFrame], Iterator[Made]]:
        vocab = Vocabulary(shipped.value, s)

        def run(batch: pd.DataFrame) -> Iterator[Made]:
            codes = [vocab.codes(text) for text in batch["text"]]
            rare = [np.unique(c[c < 0], return_counts=True) for c in codes]
            yield range(len(codes)), {"ids": [vocab.ids(c).astype("<u2").tobytes() for c in codes], "rare": [r for r, _ in rare], "times": [n for _, n in rare]}

        return run

    return factory


def encode(docs: DataFrame, words: list[bytes], s: Settings) -> DataFrame:
    """(doc_id, ids, rare, times): every whole text as entries of the vocabulary, its words outside the list by hash."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)  # fewer words than the vocabulary has entries
    return beside(docs, _encode(shipped, s), ["text"], "ids binary, rare array<long>, times array<long>", keeps=["doc_id"])


def rare_shares(encoded: DataFrame, s: Settings, counts: DataFrame | None = None) -> DataFrame:
    """(tag, rare_score): the log-shares of a row's words outside the list in their entries, by counts over all rows.

    ``counts`` (word, n): of all words outside the list by code, if they are known already.
    """
    rows = encoded.select("tag", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("tag", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    totals = (rows if counts is None else counts).groupBy("word").agg(F.sum("n").alias("total"))
    totals = materialize(totals.withColumn("entry", F.pmod(-1 - F.col("word"), F.lit(s.shared))), "counts")
    entries = totals.groupBy("entry").agg(F.sum("total").alias("whole"))  # at most ``shared`` rows
    shares = materialize(totals.join(F.broadcast(entries), "entry").select("word", F.log(F.col("total") / F.col("whole")).alias("share")), "shares")
    discard(totals)
    return rows.join(shares, "word").groupBy("tag").agg(F.sum(F.col("n") * F.col("share")).alias("rare_score"))


def _learn(shipped, s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = {k: v.copy() for k, v in shipped.value.items()}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = learned = 0

        def flush() -> None:
            nonlocal count, learned
            step(w, np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held]), s)
            learned += count
            held.clear()
            count = 0

        for batch in batches:
            for raw in batch["ids"]:
                ids = np.frombuffer(raw, dtype="<u2").astype(np.int32)
                at = np.arange(xxhash.xxh3_64_intdigest(raw) % s.stride, len(ids), s.stride)
                for part in range(0, len(at), s.batch):
                    some = at[part : part + s.batch]
                    held.append((_context(ids, some, s), ids[some]))
                    count += len(some)
                    if count >= s.batch:
                        flush()
        if count:
            flush()
        if learned:
            yield pd.DataFrame({"name": sorted(w), "value": _pack(w), "tokens": learned})

    return run


def fit(encoded: DataFrame, s: Settings = Settings()) -> dict[str, np.ndarray]:
    """The network's weights, learned from every document of ``encoded`` (ids)."""
    spark, weights = encoded.sparkSession, initial(s)
    for _ in range(s.rounds):
        shipped = spark.sparkContext.broadcast(weights)  # its size depends on the settings only
        local = materialize(encoded.select("ids").mapInPandas(_learn(shipped, s), "name string, value binary, tokens long"), "weights")
        # Averaged level by level, so that no task reads the weights of more than a few partitions.
        groups = max(1, local.count() // len(weights))
        while groups > 1:
            groups = -(-groups // _AVERAGED)
            spread = local.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(groups)))
            merged = materialize(spread.groupBy("name", "part").applyInPandas(_average_some, "name string, value binary, tokens long"), "weights")
            discard(local)
            local = merged
        for r in local.groupBy("name").applyInPandas(_average_some, "name string, value binary, tokens long").collect():  # one row per tensor
            weights[r["name"]] = np.frombuffer(r["value"], dtype="<f4").reshape(weights[r["name"]].shape).copy()
    return weights


def _average_some(rows: pd.DataFrame) -> pd.DataFrame:
    tokens = int(rows["tokens"].sum())
    total = sum(np.frombuffer(v, dtype="<f4").astype(np.float64) * n for v, n in zip(rows["value"], rows["tokens"], strict=True))
    return pd.DataFrame({"name": rows["name"].iloc[:1], "value": [(total / tokens).astype("<f4").tobytes()], "tokens": [tokens]})


def _score(shipped, s: Settings):
    def run(batch: pd.DataFrame) -> Iterator[Made]:
        counts, scores = [], []
        for raw in batch["ids"]:
            ids = np.frombuffer(raw, dtype="<u2").astype(np.int32)
            counts.append(len(ids))
            scores.append(log_likelihood(shipped.value, ids, s) if len(ids) else 0.0)
        yield range(len(counts)), {"n_tokens": counts, "score": scores}

    return lambda: run


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs``: doc_id, text. One row each: doc_id, n_tokens, score, mean_score."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counts = word_counts(source.select("text"))
    words = vocabulary(source, s, counts)
    s = grown(s, words)
    listed = spark.createDataFrame([(w,) for w in words], "word binary")  # at most most_classes ** 2 rows
    unlisted = counts.join(F.broadcast(listed), "word", "left_anti").select(F.col("code").alias("word"), "n")
    encoded = materialize(encode(source, words, s).withColumn("tag", F.monotonically_increasing_id()), "ids")
    shipped = spark.sparkContext.broadcast(fit(encoded, s))
    known = beside(encoded, _score(shipped, s), ["ids"], "n_tokens long, score double", keeps=["doc_id", "tag"])
    scored = known.join(rare_shares(encoded, s, unlisted), "tag", "left").select("doc_id", "n_tokens", (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
    return scored.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
