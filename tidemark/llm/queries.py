"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import html_layout, language_fusion, license_rules, oracle, quality_ledger, secret_ledger, tiff
from tidemark.llm._session import Scratch, tune
from tidemark.llm.best_fit import pack_documents
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.mixing import mix
from tidemark.llm.toxicity import toxicity

#: Domains of the mixing query, a language and a quality each, and their shares of the tokens.
DOMAINS = tuple(f"{lang}_{kind}" for lang in ("en", "de", "fr", "es") for kind in ("good", "plain"))
DOMAIN = "concat(lang, if(quality = 1, '_good', '_plain'))"
WEIGHTS = [0.50, 0.02, 0.16, 0.01, 0.16, 0.01, 0.13, 0.01]
LANGUAGES = ("en", "de", "fr", "es")
END_ID = 2
MAX_LEN = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), DOMAIN, DOMAINS, WEIGHTS)
    posterior = [F.col("mix_p")[i].alias(f"p_{name}") for i, name in enumerate(DOMAINS)]
    return rated.select("doc_id", F.col("mix_tokens").alias("n_tokens"), *posterior, F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two releases of the rules against one stored ledger: the base rules read every blob, then the later rules, and only those, do."""
    docs = table(spark, sf_dir, "documents")
    ledger = secret_ledger.Ledger(spark, Scratch(spark, "secrets").folder("ledger"))
    held = secret_ledger.paths(docs)
    ledger.scan(docs, secret_ledger.BASE_RULES, held=held)
    ledger.scan(docs, secret_ledger.RULES, held=held)
    found = secret_ledger.findings(docs, ledger.rows(), held=held)
    base = [r.kind for r in secret_ledger.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = secret_ledger.spans_string(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(of_base, 256).alias("base_sha256"), secret_ledger.spans_string(F.col("spans")).alias("spans"))


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract_pages(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), pct=80, k=5)


def op5_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.apply(quality_ledger.ledger(table(spark, sf_dir, "documents")), quality_ledger.STANDARD)
    base = F.col("failed").bitwiseAND(quality_ledger.BASE.mask()) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "policy")


def op6_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_fusion.identify(table(spark, sf_dir, "pages"), language_fusion.learn(table(spark, sf_dir, "documents"), LANGUAGES))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack_documents(docs, str(path), END_ID, MAX_LEN, str(ranks), digest=True)


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(table(spark, sf_dir, "documents"))


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.recognise(table(spark, sf_dir, "documents"))
    matches = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["first"], m["last"]))
    return found.select(
        "doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", F.transform("places", lambda x: x.cast("string"))).alias("places"),
        F.concat_ws(",", "licenses").alias("licenses"), F.concat_ws(",", matches).alias("matches"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secret_ledger": op2_secret_ledger,
    "op3_html_layout": op3_html_layout,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_ledger": op5_quality_ledger,
    "op6_language_fusion": op6_language_fusion,
    "op7_best_fit": op7_best_fit,
    "op8_tiff": op8_tiff,
    "op9_license_rules": op9_license_rules,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op2_secret_ledger": oracle.SECRETS, "op4_jaccard_join": oracle.JACCARD, "op5_quality_ledger": oracle.QUALITY}
