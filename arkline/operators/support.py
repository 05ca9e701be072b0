"""Support records of formats: lookups, the taxonomy of gaps, work that is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def supported(formats: DataFrame, key: str, records: DataFrame, record_key: str) -> DataFrame:
    """Each format with its support record, or nulls."""
    return formats.join(records.withColumnRenamed(record_key, "_record"), F.col(key) == F.col("_record"), "left").drop("_record")


def for_extension(formats: DataFrame, aliases: DataFrame) -> DataFrame:
    """ext, format_id, aliased, reg_order: the formats of each extension, then those that an alias (ext, format_id) adds and aren't its own."""
    own = formats.select(F.explode(F.array_distinct(F.transform("extensions", F.lower))).alias("ext"), "format_id", "reg_order")
    added = aliases.select("ext", "format_id").distinct().join(formats.select("format_id", "reg_order"), "format_id").join(own, ["ext", "format_id"], "left_anti")
    return own.withColumn("aliased", F.lit(False)).unionByName(added.select("ext", "format_id", "reg_order", F.lit(True).alias("aliased")))


def taxonomy_issues(gaps: DataFrame, key: str, taxonomy: DataFrame, dispositions: list[str]) -> DataFrame:
    """(key, code, issue) of gaps (key, code, disposition): unknown-gap, invalid-disposition, other-disposition, duplicate-gap (for each repetition)."""
    known = taxonomy.groupBy("code").agg(F.min("disposition").alias("_want"))
    each = gaps.groupBy(key, "code", "disposition").agg(F.count("*").alias("_n")).join(known, "code", "left")
    issue = F.expr(f"""filter(array(
      if(_want is null, 'unknown-gap', null),
      if(disposition is null or disposition not in ({', '.join(repr(d) for d in dispositions)}), 'invalid-disposition', null),
      if(_want is not null and not (_want <=> disposition), 'other-disposition', null)), x -> x is not null)""")
    wrong = each.select(key, "code", F.explode(issue).alias("issue"), "_n").select(key, "code", "issue", F.explode(F.expr("sequence(1L, _n)")).alias("_i")).drop("_i")
    again = each.groupBy(key, "code").agg(F.sum("_n").alias("_n")).where("_n > 1").select(key, "code", F.explode(F.expr("sequence(2L, _n)")).alias("_i"))
    return wrong.unionByName(again.select(key, "code", F.lit("duplicate-gap").alias("issue")))


def pending(rows: DataFrame, status: str, size: str, tag: str, limit: int | None = 40) -> DataFrame:
    """Rows without a status, the smallest source first, unknown sizes last, ties by tag."""
    out = rows.where(F.coalesce(F.col(status), F.lit("")) == "").orderBy(F.asc_nulls_last(size), tag)
    return out if limit is None else out.limit(limit)
