"""A corpus pipeline of five stages over ``documents``; each is one of the operators, with its decisions applied.

toxicity drops what it rejects, the join keeps one document of each group, secrets are cut out of the texts, mixing repeats the
documents of domains that are short of their target, and packing makes the training sequences. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, secret_ledger, toxicity
from tidemark.llm._session import Scratch, is_small, only, released, tune
from tidemark.llm.jaccard_join import jaccard_components, named
from tidemark.llm.queries import packed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY = ("plain", "good")
QUALITY_WEIGHTS = [0.12, 0.88]
MOST_COPIES = 8.0


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, keep=True).where("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the rows with the least id; of rows that repeat an id, all that differ and aren't dropped
    for their own text. Of equal rows one stays, but for rows without words or id, which are like nothing."""
    found = jaccard_components(docs, pct=80, k=5, node=True)
    dropped = found.where("doc_id != component_id").select("doc_id", "node").distinct()
    own = docs.select(*COLUMNS)
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return only(own, dropped.select("doc_id"), "doc_id", "left_anti")
    once = only(only(own, again, "doc_id", "left_anti"), dropped.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = only(named(only(own, again, "doc_id", "left_semi")), dropped, ["doc_id", "node"], "left_anti")
    return once.unionByName(rows.where("n > 0").select(*COLUMNS).dropDuplicates()).unionByName(rows.where("n = 0").select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret's span replaced by a mark."""
    scratch = Scratch(spark, "redaction")
    held = secret_ledger.paths(docs)
    ledger = secret_ledger.Ledger(spark, scratch.folder("ledger"))
    ledger.scan(docs, held=held)
    found = secret_ledger.findings(docs, ledger.rows(), held=held).where(F.size("spans") > 0).select("blob", "spans")
    hit = scratch.keep(found.groupBy("blob").agg(F.first("spans").alias("spans")), "hits")
    keyed = docs.select(*COLUMNS, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    small = is_small(hit.select("blob", secret_ledger.spans_string(F.col("spans")).alias("spans")))
    joined = keyed.join(F.broadcast(hit) if small else hit, "blob", "left")
    text = F.when(F.col("spans").isNotNull(), secret_ledger.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("spans").isNotNull(), F.char_length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, at least once: no rate is under 1, so clean documents all stay, and none over
    ``MOST_COPIES``. Without labels, or with labels of one quality only, each stays as it is."""
    domain = "case when quality = 1 then 'good' when quality = 0 then 'plain' end"
    rated, _ = mixing.mix(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), domain, QUALITY, QUALITY_WEIGHTS, floor=1.0, ceiling=MOST_COPIES, keep=True)
    return rated.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.greatest("mix_copies", F.lit(1))))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in the sequences."""
    tune(spark)
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("jaccard_join", one_of_each_group),
    ("secret_ledger", without_secrets),
    ("mixing", mixed),
    ("best_fit", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before = docs
        with released(spark, scratch):
            docs = scratch.keep(stage(spark, before, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
