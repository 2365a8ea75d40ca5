"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, lloyd, mixing, pivots, secrets, sharding, simhash, tokens, toxicity, urlrank, warc, whitening
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards under the law ``rows``; odd rows as in ``sharding.text_shards``."""
    return sharding.text_shards(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learnt from ``labels`` of rows not held out; odd rows as in ``toxicity.held_out_scores``."""
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``; odd rows as in ``secrets.secret_report``."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` inside windows of ``benchmark`` items; odd rows as in ``decontaminate.contamination_report``."""
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives and read back; odd rows as in ``warc.round_trip``."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``; odd rows as in ``simhash.simhash_components``."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all ``documents`` that meet the targets of quality; odd rows as in ``mixing.mix_report``."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings``; odd rows as in ``pivots.cosine_components``."""
    return pivots.cosine_components(table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learnt from rows not held out; odd rows as in ``langid.held_out_predictions``."""
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages``; odd rows as in ``urlrank.judge``."""
    return urlrank.judge(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings``, whitened; odd rows as in ``whitening.whitened_rows``."""
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens of all ``documents``, counted into a new cache; odd rows as in ``tokens.token_counts``. ``tokenizer``: the path of its file."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.limit_report(table(spark, sf_dir, "documents"), tokens.Tokenizer.read(tokenizer))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors of ``embeddings``; odd rows as in ``lloyd.compressed``."""
    return lloyd.compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_embeddings": op8_embeddings,
    "op9_langid": op9_langid,
    "op10_urls": op10_urls,
    "op11_whitening": op11_whitening,
    "op12_tokens": op12_tokens,
    "op13_lloyd": op13_lloyd,
}

ORACLES: dict[str, str] = {
    "op4_decontaminate": decontaminate.SQL,
    "op5_warc": warc.SQL,
    "op8_embeddings": pivots.SQL,
    "op13_lloyd": lloyd.SQL,
}
