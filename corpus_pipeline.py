"""A training corpus from ``documents``: quality, line dedup, near duplicates, mixture, packing.

Each stage gets the documents that the stage before it kept, as written; all but the last return the columns of ``documents``.
Duplicate lines are taken out before near duplicates are looked for, so texts that differ in shared passages only are found.  The mixture takes
nearly all tokens (FRACTION), once each: it turns away only what would put a source far over its weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arkline.llm import line_dedup, mixing, near_dups, packing, quality
from arkline.llm.common import staged, table
from arkline.llm.queries import vocabulary

FRACTION = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.deduplicated(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.selected(docs, fraction=FRACTION, epochs=1)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dups", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: Tokenising and the classifier can't be put in SQL: tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
