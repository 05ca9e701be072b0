"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, keyed_join, staged

ROUNDS = 60
#: Edges of a file of a round's table.
FILE = 500_000


def _least(e: DataFrame) -> DataFrame:
    """The least neighbour of each end."""
    return e.groupBy("u").agg(F.min("v").alias("m"))


# A hub has very many edges, so edges meet their end's least neighbour by a join that Spark can split.


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return keyed_join(both, least, ["u"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    near = keyed_join(down, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each end v of ``edges`` (u, v) but the roots; a root is the least of its component.

    Every round is written to the shared folder, in as many files as its edges fill; the driver sees a count and a checksum only."""
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        seen, old = mark, e
        e = staged(_small(_large(e)).coalesce(1 + mark[0] // FILE), "edges")
        drop_staged(old)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
