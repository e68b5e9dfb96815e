"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attribution, decontaminate, htmlextract, lm, packing, quality, sharding, simhash, toxicity, urlfilter
from .common import table


def tokenizer() -> str:
    """The public byte-level BPE file; any other path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null or empty html: the empty string; repeated rows: a row each; no pages: no rows."""
    return htmlextract.main_text(table(spark, sf_dir, "pages"))


def op2_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every document. A null text is an empty one: one END token; a null id is the empty string for the fold."""
    return lm.score(table(spark, sf_dir, "documents"))


def op3_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rule or by template. A null url, or one without ://, has an empty host and path."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. A null or empty text has fingerprint zero, linked like any other; a null id gives way to others as the least of a component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document and the longest verbatim match. Null texts have no words; an empty benchmark hits nothing."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document. A null or empty text is one empty line without tokens."""
    return attribution.line_counts(table(spark, sf_dir, "documents"), tokenizer())


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens. A null text is an empty one: the end token alone."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards whose counts differ by one at most. A null text has no bytes; repeated rows are dealt each."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document. A null or empty text is scored as one without words; without labels of both classes the score is a constant."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document. A null or empty text fails the base rule; null languages and sources are groups of their own."""
    return quality.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_array_decontamination": decontaminate.ORACLE}
