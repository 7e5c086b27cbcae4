"""Language identification by Bayesian evidence fusion.

For each page three sources speak: its text, by a naive Bayes model over character n-grams; the language that its markup declares;
and where it lives, by priors of its host. Host priors are counts of the languages that declarations and texts point at, added up
by grouped aggregation and smoothed from the host up to its registered domain, its suffix and all pages, so that a host with few
pages leans on its neighbours and a large one on itself; a text's evidence grows with its length, a prior's is bounded. Declarations are believed as far as they agree with the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._session import Scratch, chosen, fitted, join_uneven, labelled_sample
from tidemark.llm.subword import folded, grams
from tidemark.llm.words import sliced

# Every alternative reaches to the end of the text where its own end is missing, so no part of a page is read twice.
TAG = re.compile(r"<(script|style)\b(?:.*?</\1\s*>|.*\Z)|<!--(?:.*?-->|.*\Z)|<[A-Za-z/!?][^>]*(?:>|\Z)", re.S | re.I)
OPENING = re.compile(r"<(html|meta)\b([^>]*)(?:>|\Z)", re.I)
LANG = re.compile(r"(?:\A|[\s\"'])lang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", re.I)
CONTENT = re.compile(r"content\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I)
#: Labels under which names are registered one level deeper, where the last label is a country's. By rule, not a full list:
#: a second label of this kind and a last one of two letters make a suffix of two labels.
SECOND_LEVEL = frozenset("ac co com edu go gob gouv gov gv id ltd me mil ne net nom or org plc sch".split())
PSEUDO = {"host": 4.0, "domain": 8.0, "suffix": 16.0}  # strength of the level above, in pages
PRIOR_ODDS = 6.0  # the most that a host's prior may count for, in nats for one language against another


@dataclass
class TextModel:
    """log P(n-gram | language) against the mean over languages, one row for each n-gram bucket."""

    languages: tuple[str, ...]
    weight: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for data, start, row, n in folded(texts):
            owner = np.repeat(row, np.diff(np.append(start - 1, len(data)))) if len(start) else np.zeros(0, np.int64)
            pad = len(data) - len(owner)
            owner = np.concatenate([np.full(pad, owner[0] if len(owner) else 0), owner])
            total, count = np.zeros((n, len(self.languages))), np.zeros(n)
            for k, (rows, ok) in enumerate(grams(data)):
                if k > 1 or not len(start):
                    break  # sizes 3 and 4 serve here
                w = owner[: len(rows)][ok]
                for c in range(len(self.languages)):
                    total[:, c] += np.bincount(w, self.weight[rows[ok], c], n)
                count += np.bincount(w, minlength=n)
            # neighbouring n-grams overlap, so they count as fewer independent ones; the evidence grows with the text
            out.append(total / 4.0)
        return np.concatenate(out)


def fit_text(texts: list[str], labels: list[str], languages: tuple[str, ...], bits: int = 18) -> TextModel:
    count = np.full((1 << bits, len(languages)), 0.05)
    for c, name in enumerate(languages):
        own = [t for t, y in zip(texts, labels, strict=True) if y == name]
        for data, _, _, _ in folded(pa.array(own, pa.string())):
            for k, (rows, ok) in enumerate(grams(data)):
                if k > 1:
                    break
                count[:, c] += np.bincount(rows[ok], minlength=1 << bits)
    log = np.log(count / count.sum(0))
    return TextModel(languages, (log - log.mean(1, keepdims=True)).astype(np.float32))


def learn(docs: DataFrame, languages: tuple[str, ...], a_language: int = 300, least_bytes: int = 200, max_bytes: int = 8000) -> TextModel:
    """The text model of a bounded sample: of each language, up to ``a_language`` documents of ``least_bytes`` to ``max_bytes``, those with
    the least hash of their id. It is fitted in one task, not in the driver."""
    at = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int")
    own = chosen(docs, "doc_id", "text", "lang").where(F.octet_length("text").between(least_bytes, max_bytes) & F.col("doc_id").isNotNull())
    own = own.select("doc_id", at.alias("y")).where("y > 0")
    scratch = Scratch(docs.sparkSession, "language")
    few, _ = labelled_sample(scratch, docs, own, a_language, max_bytes)
    model = fitted(few, a_language, lambda rows: fit_text([t for _, t, _ in rows], [languages[y - 1] for _, _, y in rows], languages))
    scratch.close()
    return model


def declared(html: str) -> str | None:
    """The language that the html element declares, else the first one of a content-language meta element."""
    said = None
    for m in OPENING.finditer(html):
        if m[1].lower() == "html":
            if found := LANG.search(m[2]):
                return found[1].lower()
        elif said is None and "content-language" in m[2].lower() and (found := CONTENT.search(m[2].replace("content-language", "").replace("Content-Language", ""))):
            said = found[1].lower()
    return said


def text_scores(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, url, declared, z (log likelihood of each language, up to a constant) for every page; its whole text is read."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    own = chosen(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import html

        for batch in sliced(batches, 256):
            sources = [x or "" for x in batch.column(2).to_pylist()]
            texts = pa.array([html.unescape(TAG.sub(" ", x)) for x in sources], pa.string())
            z = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([declared(x) for x in sources], pa.string()), pa.array(list(z), pa.list_(pa.float64()))], names=["page_id", "url", "declared", "z"])

    return own.mapInArrow(run, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, declared string, z array<double>")


def address(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain (suffix and one label more) and suffix (the last label, or the last two where names are registered one
    level deeper); empty where there is none. A numeric address is its own domain and suffix."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]*\]|[^/:?#\[]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    numeric = host.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$")
    second = F.when(n > 1, F.element_at(labels, F.when(n > 1, -2).otherwise(-1)))
    deep = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & second.isin(*sorted(SECOND_LEVEL))
    own = F.when(deep, 2).otherwise(1)

    def last(k: Column) -> Column:
        k = F.least(k, n)
        return F.array_join(F.slice(labels, n - k + 1, k), ".")

    return host, F.when(numeric, host).otherwise(last(own + 1)), F.when(numeric, host).otherwise(last(own))


def _softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, lang, p (its posterior), p_text, declared, host for every page.

    Null or empty html leaves the declaration and the host's prior; a null url falls under the empty host; a declared language that
    the model doesn't know says nothing. Ties go to the language listed first. Repeated rows stay, extra columns are ignored, an
    empty table gives an empty result. A host with a third of all pages is one row of counts for each task before any shuffle, and its
    prior comes back to its pages by broadcast. Every page gets one of the model's languages; there is none for "other".
    """
    names, k = model.languages, len(model.languages)
    scratch = Scratch(pages.sparkSession, "language")
    host, domain, suffix = address(F.col("url"))
    known = F.array_position(F.array(*[F.lit(x) for x in names]), F.coalesce("declared", F.lit("")))
    seen = text_scores(pages, model).select("page_id", "declared", "z", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), _softmax(F.col("z")).alias("p_text"), F.when(known > 0, known.cast("int")).alias("says"))
    seen = scratch.keep(seen, "text")

    # How far declarations are to be believed: P(declares j | language i), from all pages, smoothed.
    sums = [F.sum(F.when(F.col("says") == j + 1, F.col("p_text")[i]).otherwise(0.0)).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
    row = seen.agg(*sums).first()
    count = np.array([row[f"c{i}_{j}"] or 0.0 for i in range(k) for j in range(k)]).reshape(k, k) + 0.5 + 4.0 * np.eye(k)
    likely = np.log(count / count.sum(1, keepdims=True))
    table = F.array(*[F.array(*[F.lit(float(likely[i, j])) for i in range(k)]) for j in range(k)])
    said = F.when(F.col("says").isNotNull(), F.element_at(table, F.col("says"))).otherwise(F.array(*[F.lit(0.0)] * k))
    page = seen.withColumn("z", F.zip_with("z", said, lambda a, b: a + b)).withColumn("own", _softmax(F.col("z")))

    hosts = page.groupBy("suffix", "domain", "host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(k)])
    hosts = scratch.keep(hosts, "hosts")

    def level(keys: list[str]) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])

    def smooth(df: DataFrame, above: str, strength: float, name: str) -> DataFrame:
        p = F.array(*[(F.col(f"s{i}") + strength * F.col(above)[i]) / (F.col("n") + strength) for i in range(k)])
        return df.withColumn(name, p)

    top = hosts.agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(k)]).first()
    share = [((top[i + 1] or 0.0) + 1.0) / ((top[0] or 0) + k) for i in range(k)]
    by_suffix = smooth(level(["suffix"]).withColumn("all", F.array(*[F.lit(float(x)) for x in share])), "all", PSEUDO["suffix"], "p_suffix").select("suffix", "p_suffix")
    by_domain = smooth(level(["suffix", "domain"]).join(by_suffix, "suffix"), "p_suffix", PSEUDO["domain"], "p_domain").select("suffix", "domain", "p_domain")
    # A page's own vote is taken out of its host's counts, else a lone page would only confirm itself.
    by_host = scratch.keep(hosts.join(by_domain, ["suffix", "domain"]).drop("suffix", "domain"), "priors")
    met = join_uneven(page, by_host, "host", "n")
    s = PSEUDO["host"]
    prior = F.array(*[F.log((F.greatest(F.col(f"s{i}") - F.col("own")[i], F.lit(0.0)) + s * F.col("p_domain")[i]) / (F.col("n") - 1 + s)) for i in range(k)])
    # However many pages a host has, a clear text outweighs them.
    prior = F.transform(prior, lambda x: F.greatest(x, F.array_max(prior) - PRIOR_ODDS))
    final = met.withColumn("z", F.zip_with("z", prior, lambda a, b: a + b)).withColumn("p", _softmax(F.col("z")))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return final.select("page_id", F.element_at(F.array(*[F.lit(x) for x in names]), best).alias("lang"), F.round(F.array_max("p"), 6).alias("p"), F.round(F.element_at("p_text", best), 6).alias("p_text"), "declared", "host")
