"""Toxicity of whole texts by subword-bag embeddings averaged into a linear softmax.

A word is the mean of its character n-grams' vectors, a window of words or a whole text the mean of its words; the softmax is linear
in that mean, so one table of n-gram scores serves all three. Documents are labelled as wholes while a few words may decide, so
training goes in passes: first every word carries its document's label; then the words of toxic documents that the model so far
doesn't point at are left out. A text has three measures: its whole average, its highest window average and its highest word. Its
score is a logistic of the three, fitted on labelled rows that the embeddings never saw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._session import Scratch, chosen, fitted, labelled_sample
from tidemark.llm.subword import BITS, Trainer, folded, word_scores
from tidemark.llm.words import sliced

WINDOW = 5  # words in a window of the second measure; windows slide by one word
FLOOR = -30.0
EPOCHS = (20, 25, 25)
SHARE = 0.05  # of toxic words against clean ones in the later passes
DECAY = 1e-4
MARGIN = 2.0


@dataclass
class Model:
    table: np.ndarray  # one float for each n-gram row: class 1 against class 0
    bias: float
    weight: np.ndarray = field(default_factory=lambda: np.zeros(3))  # of the three measures
    shift: float = 0.0

    def measures(self, texts: pa.Array) -> np.ndarray:
        """Of each text the logit of its whole average, of its highest window and of its highest word; FLOOR without words. A text
        of fewer words than a window is averaged as if words that say nothing followed."""
        out = [np.zeros((0, 3))]
        for data, start, row, n in folded(texts):
            w = word_scores(data, start, self.table)[:, 0].astype(np.float64)
            top = np.full((n, 3), FLOOR)
            if len(w):
                total = np.concatenate([[0.0], np.cumsum(w)])
                first = np.searchsorted(row, np.arange(n + 1))
                end = np.minimum(np.arange(len(w)) + WINDOW, first[row + 1])
                begin = np.maximum(np.minimum(np.arange(len(w)), end - WINDOW), first[row])
                has = np.flatnonzero(np.diff(first))
                top[has, 0] = (total[first[has + 1]] - total[first[has]]) / np.maximum(first[has + 1] - first[has], WINDOW) + self.bias
                top[has, 1] = np.maximum.reduceat((total[end] - total[begin]) / WINDOW, first[has]) + self.bias
                top[has, 2] = np.maximum.reduceat(w, first[has]) + self.bias
            out.append(np.maximum(top, FLOOR))
        return np.concatenate(out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(texts) @ self.weight + self.shift, -40, 40)))


def constant(label: int) -> Model:
    return Model(np.zeros(1 << BITS, np.float32), 0.0, shift=40.0 * (2 * label - 1))


def train(texts: list[str], labels: list[int], rarity: float = 1.0, seed: int = 11) -> Model:
    """Fit on labelled texts; a fifth of them, taken in turn, only serves to fit the logistic. One class alone gives a constant, no
    texts the constant 0. ``rarity``: how much a clean text weighs in the logistic against a toxic one, where the sample holds more
    toxic texts than there are. The result depends on the arguments alone, in every process."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return constant(labels[0] if labels else 0)
    own = np.zeros(len(y), bool)
    for c in (0, 1):
        own[np.flatnonzero(y == c)[::5]] = True
    if len(set(y[own])) < 2 or len(set(y[~own])) < 2:
        own[:] = False
    t = Trainer([x for x, o in zip(texts, own, strict=True) if not o], 2, seed=seed)
    toxic = y[~own][t.text]
    if len(set(toxic)) < 2:  # a class without words
        return constant(0)
    share = np.where(toxic == 1, len(toxic) / (toxic == 1).sum(), len(toxic) / (toxic == 0).sum()).astype(np.float32)
    t.fit(toxic, share, EPOCHS[0])
    for epochs in EPOCHS[1:]:
        z = np.diff(t.logits()[1])[t.word, 0]
        best = np.full(t.text.max() + 1, -np.inf)
        np.maximum.at(best, t.text, z)
        # Words of toxic documents tell nothing if they look no worse than the worst ones of clean documents, or if a much worse word
        # of the same document explains its label.
        worst = max(np.quantile(z[toxic == 0], 0.999), 0.0)
        use = (toxic == 0) | (z >= best[t.text] - 1e-6) | ((z >= worst) & (z >= best[t.text] - MARGIN))
        weight = np.where(use, np.where(toxic == 1, SHARE * (toxic == 0).sum() / max(1, (use & (toxic == 1)).sum()), 1.0), 0.0)
        t.fit(toxic, weight, epochs, decay=DECAY)
    table, bias = t.table()
    model = Model(table[:, 1] - table[:, 0], float(bias[1] - bias[0]))
    measured = model.measures(pa.array([x for x, o in zip(texts, own, strict=True) if o or not own.any()], pa.string()))
    model.weight, model.shift = logistic(measured, y[own] if own.any() else y, rarity)
    return model


def logistic(x: np.ndarray, y: np.ndarray, rarity: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights, none of them negative, and shift of the logistic that fits y, with a little ridge; Newton steps on standardised x."""
    m, s = x.mean(0), x.std(0) + 1e-9
    use, weight = np.ones(x.shape[1], bool), np.where(y == 1, 1.0, rarity)
    while True:
        a = np.concatenate([(x - m) / s * use, np.ones((len(x), 1))], 1)
        w = np.zeros(a.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (weight * (p - y)) + 1e-2 * w
            w -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1]), g)
        if (w[:-1] >= 0).all():
            return w[:-1] * use / s, float(w[-1] - (w[:-1] * use / s) @ m)
        use &= w[:-1] > 0


def bucket(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id's text; labels are learnt only from rows where this mod 5 isn't 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", classes: tuple[int, ...] = (0, 1), a_class: int = 1000, max_bytes: int = 4000, folds: int = 5) -> Model:
    """The model of a bounded sample of labelled texts: of each class, up to ``a_class`` texts of at most ``max_bytes``, those with the
    least hash of their id, held-out ids left out. These bounds are the only limits on what the classifier learns from; the classes
    weigh in the logistic as they are among all labels. The fit runs in one task, not in the driver. An id that is labelled twice
    counts with its lesser label; null ids and labels are passed over; without labels every score is 0."""
    own = chosen(labels, "doc_id", label).toDF("doc_id", "y").where(F.col("doc_id").isNotNull() & (bucket() % folds != 0))
    own = own.where(F.col("y").isin(*classes)).groupBy("doc_id").agg(F.min("y").alias("y"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample, counts = labelled_sample(scratch, docs, own, a_class, max_bytes)
    taken = {r["y"]: min(r["count"], a_class) for r in sample.groupBy("y").count().collect()}
    share = lambda c: counts.get(c, 0) / max(1, taken.get(c, 0))
    rarity = min(100.0, max(1.0, share(classes[0]) / share(classes[1]))) if share(classes[1]) else 1.0
    model = fitted(sample, a_class, lambda rows: train([t for _, t, _ in rows], [classes.index(y) for _, _, y in rows], rarity))
    scratch.close()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score") -> DataFrame:
    """doc_id (or with ``keep`` all of the input's columns), score. Texts are scored alone and whole; null and empty ones, and
    ones without words, get the lowest score. Repeated rows stay; other columns are never read unless kept; one of them that is
    called like ``score_col`` gives way to the score."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = chosen(docs, *[c for c in docs.columns if c != score_col or c == text_col]) if keep else chosen(docs, id_col, text_col)
    at = own.columns.index(text_col)
    out = StructType([*(own.schema.fields if keep else [own.schema[id_col]]), StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s = pa.array(shared.value.scores(batch.column(at)))
            cols = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*cols, s], names=out.names)

    return own.mapInArrow(run, out)


def toxicity(docs: DataFrame, labels: DataFrame, a_class: int = 1000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``. An empty label table gives score 0 everywhere, an empty ``docs``
    an empty result; rows with equal texts get equal scores; very long texts are scored whole."""
    out = score(docs, learn(docs, labels, a_class=a_class))
    return out.select("doc_id", F.coalesce(bucket() % 5 == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
