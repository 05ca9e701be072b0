"""The registry of formats as tables, read from a list in Markdown rows or given as rows.

A list has one row for each format: id, kind, name, extensions, ..., registration number, hints, signatures.  Its path is a parameter."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "format_id string, kind string, name string, extensions array<string>, reg_order int, priority int, ext_fallback boolean, ext_only boolean, has_signatures boolean"
_ROW = re.compile(r"^\| *([a-z0-9][\w.-]*) *\|")


def read_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(formats, signatures) of a list: rows ``| id | kind | name | ext | cite | LoC | line | det | signature | ...``."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\| *[a-z0-9][A-Za-z0-9_.-]* *\| *(archive|image|audio|script) *\|"))
    c = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    cells = rows.select(c.alias("c")).where(F.size("c") >= 11)
    names = lambda x: F.filter(F.split(x, " +"), lambda e: e.rlike("^[A-Za-z0-9_]+$"))
    det = F.col("c")[8]
    formats = cells.select(
        F.col("c")[1].alias("format_id"), F.col("c")[2].alias("kind"), F.col("c")[3].alias("name"), names(F.col("c")[4]).alias("extensions"), F.expr("try_cast(c[7] as int)").alias("reg_order"),
        F.coalesce(F.expr(r"try_cast(regexp_extract(c[8], 'p(-?[0-9]+)', 1) as int)"), F.lit(0)).alias("priority"), F.contains(det, F.lit("fb")).alias("ext_fallback"), F.contains(det, F.lit("ext")).alias("ext_only"), F.contains(det, F.lit("sig")).alias("has_signatures"),
    )
    sigs = cells.select(F.col("c")[1].alias("format_id"), F.explode(F.split(F.col("c")[9], " +")).alias("s")).where(F.col("s").rlike("^([0-9a-f]{2})+(@[0-9]+)?$"))
    signatures = sigs.select("format_id", F.coalesce(F.expr("try_cast(get(split(s, '@'), 1) as long)"), F.lit(0)).alias("sig_offset"), F.unhex(F.substring_index("s", "@", 1)).alias("sig_bytes"))
    return formats, signatures


def signature_index(signatures: DataFrame) -> list[tuple[int, int]]:
    """The distinct (offset, length) that a file is probed at: as many as the registry has, whatever the data."""
    return [(r.o, r.n) for r in signatures.select(F.col("sig_offset").alias("o"), F.octet_length("sig_bytes").alias("n")).distinct().orderBy("o", "n").collect()]


def matched(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """path, format_id of each signature that a file's bytes have: equality on (offset, length, bytes), no nested loop."""
    places = signature_index(signatures)
    keys = F.array(*[F.struct(F.lit(o).cast("long").alias("sig_offset"), F.expr(f"substring(content, {o + 1}, {n})").alias("sig_bytes"), F.lit(n).alias("n")) for o, n in places])
    probes = files.select("path", F.explode(keys).alias("k")).select("path", "k.*").where(F.octet_length("sig_bytes") == F.col("n"))
    return probes.join(F.broadcast(signatures), ["sig_offset", "sig_bytes"]).select("path", "format_id").distinct()
