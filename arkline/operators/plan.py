"""Extraction plans: statuses, destinations, totals, budgets and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_destinations(items: DataFrame, destination: str, keep: list[str]) -> DataFrame:
    """Items whose destination another item has too, with the number of them.  Counts are made per destination first, so a destination with very many
    items isn't sorted in one task."""
    n = items.groupBy(destination).agg(F.count("*").alias("n_same")).where("n_same > 1")
    return items.select(*keep, destination).join(n, destination)


def totals(items: DataFrame, status: Column, packed: Column, size: Column) -> DataFrame:
    """One row: counts by status, packed and output bytes of ready items.  Output bytes are null while any ready size is unknown."""
    ready = status == "ready"
    out = items.agg(
        F.count_if(ready).alias("ready_count"),
        F.count_if(status == "skipped").alias("skipped_count"),
        F.count_if(status == "failed").alias("failed_count"),
        F.coalesce(F.sum(F.when(ready, packed)), F.lit(0)).alias("packed_bytes"),
        F.coalesce(F.sum(F.when(ready, size)), F.lit(0)).alias("_known"),
        F.count_if(ready & size.isNull()).alias("unknown_count"),
    )
    return out.withColumn("output_bytes", F.when(F.col("unknown_count") == 0, F.col("_known"))).drop("_known")


def violations(plan: DataFrame, limits: dict[str, tuple[str, int]]) -> DataFrame:
    """budget, allowed, actual for each limit that a plan's totals exceed or, with a null actual, can't be shown to keep.  ``limits`` is name: (column, most)."""
    checks = [F.struct(F.lit(name).alias("budget"), F.lit(most).cast("long").alias("allowed"), F.col(column).cast("long").alias("actual")) for name, (column, most) in limits.items()]
    return plan.select(F.explode(F.array(*checks)).alias("c")).select("c.*").where("actual is null or actual > allowed")


def resource_violations(items: DataFrame, status: Column, size: Column, most: int, budget: str = "maxDecodedBytesPerResource") -> DataFrame:
    """The same for a limit of each ready item: a row for each item over it, and one with a null actual if a ready item's size is unknown."""
    ready = items.where(status == "ready").select(F.lit(budget).alias("budget"), F.lit(most).cast("long").alias("allowed"), size.cast("long").alias("actual"))
    return ready.where("actual > allowed").unionAll(ready.where("actual is null").distinct())


def over_sources(plans: DataFrame) -> DataFrame:
    """The totals of many plans (``totals``' columns) as one: an output of unknown size counts as 0, and is null only where any item's size is unknown."""
    out = plans.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ready_count", "skipped_count", "failed_count", "packed_bytes", "unknown_count")], F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("_known"))
    return out.withColumn("output_bytes", F.when(F.col("unknown_count") == 0, F.col("_known"))).drop("_known")


def within_budgets(broken: DataFrame) -> None:
    """Raises LIMIT_EXCEEDED where ``violations`` has rows: a plan that exceeds its budgets, or can't prove them, isn't run."""
    got = broken.orderBy("budget").take(100)
    if got:
        raise ValueError("LIMIT_EXCEEDED: " + ", ".join(f"{r.budget} {'unknown' if r.actual is None else r.actual} of {r.allowed}" for r in got))


def fold(extracted: Column, skipped: Column, failed: Column) -> Column:
    return F.when(failed == 0, "completed").when((extracted > 0) | (skipped > 0), "partial").otherwise("failed")


def status_of(exists: Column, found: Column, safe: Column, policy: str) -> Column:
    """ready, skipped or failed; ``policy`` (fail, skip, overwrite) says what an existing output does."""
    if policy not in ("fail", "skip", "overwrite"):
        raise ValueError(policy)
    met = {"fail": "failed", "skip": "skipped", "overwrite": "ready"}[policy]
    return F.when(~found | ~safe, "failed").when(exists, met).otherwise("ready")


def planned(selected: DataFrame, existing: DataFrame, destination: str, found: Column, safe: Column, policy: str = "fail") -> DataFrame:
    """Selected entries with a status, by what lies at their destination already."""
    have = existing.select(F.col(destination), F.lit(True).alias("_exists")).distinct()
    out = selected.join(have, destination, "left")
    out = out.withColumn("status", status_of(F.coalesce("_exists", F.lit(False)), found, safe, policy)).drop("_exists")
    n = out.groupBy(destination).agg(F.count("*").alias("_n"))
    return out.join(n, destination, "left").withColumn("status", F.when(F.col("_n") > 1, "failed").otherwise(F.col("status"))).drop("_n")


def guard(expected: str, plan_digest: Column) -> Column:
    """Raises PLAN_CHANGED where the plan's digest is another one."""
    return F.when(plan_digest == expected, plan_digest).otherwise(F.raise_error(F.lit("PLAN_CHANGED")))


def running_offsets(parts: DataFrame, whole: str, order: str, size: str) -> DataFrame:
    """The first byte of each part of a file in parts."""
    w = Window.partitionBy(whole).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def overlaps(parts: DataFrame, size: str, offset: Column, length: Column) -> DataFrame:
    """The slices (from, n) of ``running_offsets`` parts that a range of the whole covers."""
    begin, end = F.greatest(F.col("start"), offset), F.least(F.col("start") + F.col(size), offset + length)
    return parts.withColumn("from", begin - F.col("start")).withColumn("n", end - begin).where("n > 0")


def retained(rows: DataFrame, at: str, now: Column, hours: int = 24) -> DataFrame:
    """Rows of the last ``hours``; a comparison of the bare column, so it reaches the scan."""
    return rows.where(F.col(at) >= now - F.expr(f"interval {hours} hours"))
