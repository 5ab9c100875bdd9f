"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams over the whole text
(lower case, runs of other characters than letters as one space). Document
frequencies come from every training document. The weights are learned with
follow-the-regularised-leader (proximal form, elastic net) on a sample of at
most about ``max_sample`` labelled documents, spread evenly over the labels; a
fifth of the sample is set aside to fit the softmax temperature.

Defined results: null text, or text without a letter, is ``und`` with score 0;
rows with a null label or a null doc_id are never learned from; with nothing to
learn from every row is ``und``; repeated rows are predicted each on their own;
of equally likely labels the first in order is predicted; an empty table gives an
empty result; other columns of any type pass, but for ones named like the result's.
More than ``max_labels`` labels are an error, as the model has a row for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Made, beside, materialize, others, table

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    dims_log2: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    max_sample: int = 4000
    max_labels: int = 1000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 1.0
    calibration_share: float = 0.2


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # labels x dims, mostly zeros
    idf: np.ndarray
    temperature: float
    settings: Settings


class Grams:
    """Hashed counts of the character n-grams of a text."""

    def __init__(self, settings: Settings) -> None:
        self.shift = np.uint32(32 - settings.dims_log2)
        self.dims, self.orders = 1 << settings.dims_log2, settings.orders
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def counts(self, text: str | None) -> np.ndarray | None:
        """None for a text without letters."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        letter = self.letter[points]
        if not letter.any():
            return None
        points = np.where(letter, points, 32).astype(np.uint32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of other characters the first stays
        points = np.concatenate(([np.uint32(32)], points[keep], [np.uint32(32)]))
        total = np.zeros(self.dims, dtype=np.int64)
        with np.errstate(over="ignore"):
            for n in self.orders:
                if len(points) < n:
                    continue
                h = np.full(len(points) - n + 1, n, dtype=np.uint32)
                for k in range(n):
                    h = (h ^ points[k : k + len(h)]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                total += np.bincount((h * np.uint32(0x85EBCA6B)) >> self.shift, minlength=self.dims)
        return total


def _tfidf(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(count)) * idf[index]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def _gather(settings: Settings):
    """Per task: the document frequency of each dimension, and the sampled documents' counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(settings)
        df, n = np.zeros(grams.dims, dtype=np.int64), 0
        for batch in batches:
            rows = []
            for text, lang, sampled, order in zip(batch["text"], batch["lang"], batch["sampled"], batch["pos"], strict=True):
                counts = grams.counts(text)
                if counts is None:
                    continue
                index = np.flatnonzero(counts)
                df[index] += 1
                n += 1
                if sampled:
                    rows.append((-1, 0, lang, order, index.astype("<i4").tobytes(), counts[index].astype("<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["dim", "df", "lang", "pos", "idx", "cnt"])
        dims = np.append(np.flatnonzero(df), grams.dims)
        yield pd.DataFrame({"dim": dims, "df": np.append(df[df > 0], n), "lang": None, "pos": 0, "idx": None, "cnt": None})

    return run


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_labels: int, dims: int, s: Settings) -> np.ndarray:
    """Proximal FTRL over sparse rows (label, index, value)."""
    z, n, w = (np.zeros((n_labels, dims)) for _ in range(3))
    for _ in range(s.epochs):
        for label, index, x in rows:
            p = _softmax(w[:, index] @ x)
            p[label] -= 1.0
            g = p[:, None] * x[None, :]
            old_n, old_w = n[:, index], w[:, index]
            new_n = old_n + g * g
            sigma = (np.sqrt(new_n) - np.sqrt(old_n)) / s.alpha
            new_z = z[:, index] + g - sigma * old_w
            n[:, index], z[:, index] = new_n, new_z
            shrunk = np.sign(new_z) * np.maximum(np.abs(new_z) - s.l1, 0.0)
            w[:, index] = -shrunk / ((s.beta + np.sqrt(new_n)) / s.alpha + s.l2 * 1e-2)
    return w


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, between 0.05 and 20."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20.0, 121)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """``docs``: doc_id, text, lang. Only rows with a label are used."""
    s = settings
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).limit(s.max_labels + 1).collect()
    if len(sizes) > s.max_labels:
        raise ValueError(f"more than {s.max_labels} labels")
    found = {r["lang"]: r["n"] for r in sizes}
    labels = tuple(sorted(found))
    quota = max(1, s.max_sample // max(1, len(labels)))
    # A hash of doc_id decides who is sampled, so the sample is the same on every run.
    shares = F.create_map(*[F.lit(x) for lang in labels for x in (lang, min(1.0, quota / found[lang]))]) if labels else None
    share = F.element_at(shares, F.col("lang")) if labels else F.lit(0.0)
    pos = F.xxhash64("doc_id", F.lit(17))
    marked = usable.select("text", "lang", pos.alias("pos"), (F.pmod(pos, F.lit(1 << 30)) < share * (1 << 30)).alias("sampled"))
    gathered = materialize(
        marked.mapInPandas(_gather(s), "dim long, df long, lang string, pos long, idx binary, cnt binary"), "grams"
    )
    dims = 1 << s.dims_log2
    idf, n_docs = np.zeros(dims), 0
    for r in gathered.where("dim >= 0").groupBy("dim").agg(F.sum("df").alias("df")).collect():  # at most dims + 1 rows
        if r["dim"] == dims:
            n_docs = r["df"]
        else:
            idf[r["dim"]] = r["df"]
    idf = np.where(idf > 0, np.log((1.0 + n_docs) / (1.0 + idf)) + 1.0, 0.0)
    sample = gathered.where("dim < 0").select("lang", "pos", "idx", "cnt").collect()  # about max_sample rows
    rows = []
    for r in sorted(sample, key=lambda r: (r["pos"], bytes(r["idx"]))):
        index = np.frombuffer(r["idx"], dtype="<i4")
        rows.append((labels.index(r["lang"]), index, _tfidf(index, np.frombuffer(r["cnt"], dtype="<i4"), idf)))
    held = int(len(rows) * s.calibration_share)
    weights = train(rows[held:], max(1, len(labels)), dims, s)
    logits = np.array([weights[:, i] @ x for _, i, x in rows[:held]]).reshape(held, max(1, len(labels)))
    temperature = fit_temperature(logits, np.array([label for label, _, _ in rows[:held]], dtype=int))
    return Model(labels if rows else (), weights.astype(np.float32), idf, temperature, s)


def _predictor(model):
    def factory() -> Callable[[pd.DataFrame], Iterator[Made]]:
        m: Model = model.value
        grams = Grams(m.settings)

        def predicted(batch: pd.DataFrame) -> Iterator[Made]:
            langs, scores = [], []
            for text in batch["text"]:
                counts = grams.counts(text) if m.labels else None
                if counts is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                index = np.flatnonzero(counts)
                p = _softmax((m.weights[:, index] @ _tfidf(index, counts[index], m.idf)) / m.temperature)
                langs.append(m.labels[int(p.argmax())])
                scores.append(float(p.max()))
            yield range(len(langs)), {"lang_pred": langs, "score": scores}

        return predicted

    return factory


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without its text column, with lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # labels x dims: its size doesn't depend on the corpus
    return beside(docs, _predictor(shipped), ["text"], "lang_pred string, score double", keeps=others(docs, "text", "lang_pred", "score"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
