"""Soft-membership mixing of documents to target weights of domains.

A classifier fitted on a labelled table gives each document its posterior over the domains. Nonnegative rates for the documents are
then fitted so that the expected tokens of each domain, sum of rate * tokens * posterior, meet the targets: projected gradient on
the squared misses, with a rate pulled to 1. A step's gradient is one sum per domain over all documents, so each iteration is a
map and a reduction of ``domains`` numbers, and a rate is a short formula of its own row. Bounds may be put on the rates: a floor
of 1 keeps every document, a ceiling keeps a domain of few documents from being repeated without end.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._session import Scratch, chosen, fitted, labelled_sample
from tidemark.llm.words import LOWER, chunks, hashes, sliced, spans

log = logging.getLogger(__name__)

BITS = 13
DENSE = 8


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of whole texts: (word buckets, row of each word, dense measures, words in each)."""
    for _, data, offsets in chunks(texts):
        n = len(offsets) - 1
        low = LOWER[data]
        start, end, row = spans(low, offsets)
        h = hashes(low, start, end)
        words = np.bincount(row, minlength=n)
        at = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))]), np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        up, lower = (a[offsets[1:]] - a[offsets[:-1]] for a in at)
        sign = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b"#*$%&|<>!~^=", np.uint8)))])
        sign = sign[offsets[1:]] - sign[offsets[:-1]]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row, again, minlength=n)
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order], new, minlength=n)
        chars = np.maximum(offsets[1:] - offsets[:-1], 1)
        w = np.maximum(words, 1)
        dense = np.stack([np.log1p(words), chars / w / 10, up / np.maximum(up + lower, 1), sign / w, again / w, distinct / w, words < 20, np.ones(n)], 1).astype(np.float64)
        yield (h >> np.uint64(64 - BITS)).astype(np.int64), row, dense, words


@dataclass
class DomainModel:
    word: np.ndarray  # buckets x domains
    dense: np.ndarray  # measures x domains
    mean: np.ndarray
    scale: np.ndarray
    names: tuple
    seen: np.ndarray  # domains of which there were labelled texts; the others have posterior 0

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, count = [np.zeros((0, len(self.names)))], [np.zeros(0, np.int64)]
        for bucket, row, dense, words in features(texts):
            z = ((dense - self.mean) / self.scale) @ self.dense
            if len(bucket):
                z += np.stack([np.bincount(row, self.word[bucket, k], len(dense)) for k in range(z.shape[1])], 1) / np.maximum(words, 1)[:, None]
            z = np.where(self.seen, z, -np.inf)
            p = np.exp(z - z.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
            count.append(words)
        return np.concatenate(out), np.concatenate(count)


def fit_domains(texts: list[str], labels: list, names: tuple, epochs: int = 150, rate: float = 0.05) -> DomainModel:
    """Softmax regression on mean word buckets and dense measures, full-batch Adam. A domain without labelled texts has
    posterior 0; without any labelled texts, posteriors are uniform."""
    k = len(names)
    seen = np.array([name in set(labels) for name in names]) if texts else np.ones(k, bool)
    model = DomainModel(np.zeros((1 << BITS, k)), np.zeros((DENSE, k)), np.zeros(DENSE), np.ones(DENSE), names, seen)
    if not texts:
        return model
    y = np.eye(k)[[names.index(v) for v in labels]]
    parts, base = [], 0
    for bucket, row, dense, words in features(pa.array(texts, pa.string())):
        parts.append((bucket, row + base, dense, words))
        base += len(dense)
    bucket, row, dense, words = (np.concatenate([p[i] for p in parts]) for i in range(4))
    model.mean, model.scale = dense.mean(0), dense.std(0) + 1e-6
    model.mean[-1], model.scale[-1] = 0.0, 1.0
    dense = (dense - model.mean) / model.scale
    cell, inverse = np.unique(row * (1 << BITS) + bucket, return_inverse=True)
    value = np.bincount(inverse) / np.maximum(words, 1)[cell >> BITS]
    r, b = cell >> BITS, cell & ((1 << BITS) - 1)
    params, state = [model.word, model.dense], [[0.0, 0.0], [0.0, 0.0]]
    for step in range(1, epochs + 1):
        z = dense @ model.dense + np.stack([np.bincount(r, value * model.word[b, c], len(y)) for c in range(k)], 1)
        z = np.where(seen, z, -np.inf)
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - y) / len(y)
        grads = [np.stack([np.bincount(b, value * g[r, c], 1 << BITS) for c in range(k)], 1) + 1e-6 * model.word, dense.T @ g + 1e-4 * model.dense]
        for p_, g_, s in zip(params, grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g_
            s[1] = 0.999 * s[1] + 0.001 * g_ * g_
            p_ -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-9)
    return model


def learn_domains(docs: DataFrame, labels: DataFrame, domain: str, names: tuple, a_domain: int = 300, max_bytes: int = 20_000) -> DomainModel:
    """The classifier of a bounded sample (``domain``: SQL over the columns of ``labels`` and the documents' lang): of each domain up to
    ``a_domain`` labelled texts of at most ``max_bytes``, those with the least hash of their id. It is fitted in one task, not in the
    driver. Everything after the classifier reads all documents. A ``lang`` of the labels themselves isn't read."""
    y = F.array_position(F.array(*[F.lit(x) for x in names]), F.expr(domain)).cast("int")
    own = chosen(labels, *[c for c in labels.columns if c != "lang"])
    own = own.join(chosen(docs, "doc_id", "lang"), "doc_id").select("doc_id", y.alias("y")).where("doc_id is not null and y > 0")
    scratch = Scratch(docs.sparkSession, "domains")
    sample, _ = labelled_sample(scratch, docs, own.groupBy("doc_id").agg(F.min("y").alias("y")), a_domain, max_bytes)
    model = fitted(sample, a_domain, lambda rows: fit_domains([t for _, t, _ in rows], [names[y - 1] for _, _, y in rows], names))
    scratch.close()
    return model


def memberships(docs: DataFrame, model: DomainModel, keep: bool = False) -> DataFrame:
    """doc_id (with ``keep``: all columns), mix_tokens (words of the whole text), mix_p (posterior of each domain). Input columns
    whose names begin with ``mix_`` give way to these."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = chosen(docs, *[c for c in docs.columns if not c.startswith("mix_")]) if keep else chosen(docs, "doc_id", "text")
    at = own.columns.index("text")
    out = StructType([*(own.schema.fields if keep else [own.schema["doc_id"]]), StructField("mix_tokens", LongType()), StructField("mix_p", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            p, words = shared.value.posteriors(batch.column(at))
            cols = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=out.names)

    return own.mapInArrow(run, out)


def _rate(slope: np.ndarray, floor: float, ceiling: float | None) -> tuple[Column, Column]:
    """A row's rate, 1 moved along its posterior and projected onto [floor, ceiling], and whether the projection left it alone."""
    raw = F.lit(1.0)
    for k, v in enumerate(slope):
        raw = raw + F.col("mix_p")[k] * F.lit(float(v))
    if ceiling is None:
        return F.greatest(F.lit(float(floor)), raw), raw >= floor
    return F.least(F.lit(float(ceiling)), F.greatest(F.lit(float(floor)), raw)), raw.between(floor, ceiling)


def fit_rates(
    members: DataFrame, weights: list[float], budget: float | None = None, floor: float = 0.0, ceiling: float | None = None, steps: int | None = None, tolerance: float = 1e-4
) -> tuple[np.ndarray, dict]:
    """The slope of the fitted rates, and the totals that they reach. ``members`` is a written table.

    Minimises 1/2 |A r - T|^2 over floor <= r <= ceiling, A[k, i] = tokens_i p_ik, T = budget * weights (budget: the current tokens, or
    with floor > 0 the least total at which no domain must shrink), by lazily projected gradient: steps add up before they are
    projected, so of all rates that meet T those nearest to 1 come out, and a row's rate depends on the sum of the steps alone. A step
    is preconditioned by the domains' Gram matrix over the rows that the projection leaves alone, and halved while it makes the miss
    larger. Each step is one pass over members. It goes on until every miss is within ``tolerance`` of the total, or until no step helps
    by a hundredth of the miss (or for at most ``steps`` passes): then the targets are missed, which is logged and reported in ``met``.

    A domain that no row belongs to leaves the targets, and the others share its part. Where all rows have the same posteriors, or
    fewer than two domains are left, no rates can change the shares: every rate stays 1.
    """
    k = len(weights)
    share = np.array(weights, float) / sum(weights)

    def totals(slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rate, loose = _rate(slope, floor, ceiling)
        t = F.col("mix_tokens").cast("double")
        free = F.when(F.col("loose"), t).otherwise(0.0)
        sums = [F.sum(t * F.col("r") * F.col("mix_p")[i]) for i in range(k)]
        gram = [F.sum(free * F.col("mix_p")[i] * F.col("mix_p")[j]) for i in range(k) for j in range(i, k)]
        row = [v or 0.0 for v in members.withColumns({"r": rate, "loose": loose}).agg(*[c.alias(f"c{i}") for i, c in enumerate(sums + gram)]).first()]
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = row[k:]
        return np.array(row[:k]), np.maximum(full, full.T)

    slope = np.zeros(k)
    now, gram = totals(slope)
    start = now
    share = np.where(now > 0, share, 0.0)
    spread = np.linalg.eigvalsh(gram)
    if (share > 0).sum() < 2 or spread[-2] <= 1e-9 * spread[-1]:
        log.warning("mixing: fewer than two domains can be told apart; every rate stays 1")
        return slope, {"target": now, "start": start, "reached": now, "steps": 0, "met": False}
    share /= share.sum()
    if budget is None:
        budget = float((now / np.maximum(share, 1e-9))[share > 0].max()) if floor > 0 else float(now.sum())
    goal, used = budget * share, 0
    step, pace = None, 1.0
    met = lambda: bool(np.abs(goal - now).max() <= tolerance * max(goal.sum(), 1.0))
    while not met() and pace > 1e-6 and (steps is None or used < steps):
        if step is None:
            step = np.linalg.solve(gram + 1e-6 * max(np.trace(gram), 1e-9) * np.eye(k), goal - now)
        then, then_gram = totals(slope + pace * step)
        used += 1
        if np.linalg.norm(goal - then) < 0.99 * np.linalg.norm(goal - now):
            slope, now, gram, step, pace = slope + pace * step, then, then_gram, None, 1.0
        else:
            pace /= 2
    if not met():
        log.warning("mixing targets missed after %d passes: shares %s, targets %s", used, np.round(now / max(now.sum(), 1.0), 4).tolist(), np.round(share, 4).tolist())
    return slope, {"target": goal, "start": start, "reached": now, "steps": used, "met": met()}


def copies(rate: Column, *keys: str) -> Column:
    """A whole number of copies with mean ``rate``: its whole part, and one more with a chance of the rest, by a hash of the keys."""
    u = F.pmod(F.xxhash64(*keys, F.lit(91)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domain: str, names: tuple, weights: list[float], floor: float = 0.0, ceiling: float | None = None, keep: bool = False) -> tuple[DataFrame, dict]:
    """doc_id (``keep``: all columns), mix_tokens, mix_p, mix_rate, mix_copies for every row of ``docs``, and the fit's totals.

    Null and empty texts have no tokens and posteriors by the dense measures alone; very long texts are read whole. Null ids and
    repeated rows are rows like others; rows with equal texts get equal rates. An empty ``docs`` gives an empty result. Without
    labels, or with labels of one domain only, every rate is 1; an id that is labelled twice counts with the domain listed first.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    model = learn_domains(docs, labels, domain, names)
    slim = scratch.keep(memberships(docs, model), "members")
    slope, report = fit_rates(slim, weights, floor=floor, ceiling=ceiling)
    rows = memberships(docs, model, keep=True) if keep else slim
    rated = rows.withColumn("mix_rate", _rate(slope, floor, ceiling)[0])
    if keep:
        scratch.close()
    return rated.withColumn("mix_copies", copies(F.col("mix_rate"), "doc_id")), report
