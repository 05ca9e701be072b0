"""Cells of HTML tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The named entities, in the order in which they are replaced (so "&amp;lt;" becomes "<").
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")]


def _numbered(text: Column, pattern: str, base: int) -> Column:
    """Replaces each numeric entity by its code point; one beyond Unicode's last stays as it is."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    digits = lambda e: F.regexp_replace(e, "(?i)[&#x;]", "")
    point = lambda e: F.conv(digits(e), base, 10).try_cast("long")
    hexed = lambda e: F.concat(F.lit("0000FEFF"), F.lpad(F.conv(digits(e), base, 16), 8, "0"))
    shown = F.transform(found, lambda e: F.when((F.length(digits(e)) <= 12) & point(e).between(0, 0x10FFFF), F.decode(F.unhex(hexed(e)), "UTF-32")).otherwise(e))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), shown.alias("e")), lambda x: F.array(x["p"], F.coalesce(x["e"], F.lit(""))))), "")


def decoded(text: Column) -> Column:
    """The text with named and numeric entities replaced; each kind once, in order."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return _numbered(_numbered(text, "&#[0-9]+;", 10), "(?i)&#x[0-9a-f]+;", 16)


def stripped(html: Column) -> Column:
    """The text without tags; line breaks and ends of paragraphs become line feeds."""
    for pattern, to in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p\s*>", "\n"), ("<[^>]+>", "")):
        html = F.regexp_replace(html, pattern, to)
    return html


def lines(html: Column) -> Column:
    """The trimmed lines of a cell that aren't empty."""
    return F.filter(F.transform(F.split(decoded(stripped(html)), r"\r?\n"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}﻿]+|[\s\p{Z}﻿]+$", "")), lambda x: x != "")


def carried(rows: DataFrame, table: list[str], order: list[str], cell: str, span: str) -> DataFrame:
    """One column of tables: a row without a cell of its own takes the last one above it that spans as far as its place, else null.

    ``cell`` is null where the row has none; ``span`` counts the rows that a cell covers, its own included."""
    w = Window.partitionBy(*table).orderBy(*order)
    placed = rows.withColumn("_at", F.row_number().over(w))
    above = F.last(F.when(F.col(cell).isNotNull(), F.struct(F.col(cell).alias("c"), (F.col("_at") + F.greatest(F.coalesce(span, F.lit(1)), F.lit(1))).alias("end"))), ignorenulls=True)
    placed = placed.withColumn("_above", above.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return placed.withColumn(cell, F.when(F.col("_at") < F.col("_above.end"), F.col("_above.c"))).drop("_at", "_above")
