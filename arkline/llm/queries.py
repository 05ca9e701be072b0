"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import found

    return found(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import counts

    return counts(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judged

    return judged(table(spark, sf_dir, "pages"))


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import grouped

    return grouped(table(spark, sf_dir, "documents"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import qualities

    return qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import line_dedup, mixing, near_dups, topk

    return {"op3_top_k": topk.ORACLE, "op8_near_dups": near_dups.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op6_mixing": mixing.ORACLE}
