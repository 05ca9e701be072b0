"""Entry lists: types, filters, summaries and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

# The resource type of each extension, and all types.
TYPES = ["archive", "audio", "image", "script", "unknown"]
EXTENSIONS = {
    "audio": ["aac", "acb", "awb", "flac", "m4a", "mid", "midi", "mp3", "nwa", "ogg", "opus", "wav", "wma"],
    "image": ["bmp", "dds", "gif", "ico", "jpeg", "jpg", "png", "psd", "tga", "webp"],
    "script": ["js", "json", "ks", "lua", "scn", "tjs", "txt", "xml"],
}
PAGE, MOST = 100, 1000


def type_of(ext: Column, explicit: Column | None = None, metadata: list[Column] = ()) -> Column:
    """The explicit type, else the first metadata value (before its slash) that names a type, else the extension's, else unknown."""
    known = [F.when(ext.isin(names), F.lit(kind)) for kind, names in EXTENSIONS.items()]
    first = [F.lower(F.substring_index(m, "/", 1)) for m in metadata]
    named = [F.when(m.isin(TYPES), m) for m in first]
    return F.coalesce(*([explicit] if explicit is not None else []), *named, *known, F.lit("unknown"))


def filtered(
    entries: DataFrame, path: str = "path", include: list[str] = ("**/*",), exclude: list[str] = (), *, case_sensitive: bool = False,
    compressed: bool | None = None, encrypted: bool | None = None, resource_types: list[str] | None = None,
) -> DataFrame:
    """Entries whose path matches an included and no excluded pattern, with the given flags and types."""
    p = paths.normalised(F.col(path))
    out = entries
    if list(include) != ["**/*"]:
        out = out.where(paths.matches(p, list(include), case_sensitive))
    if exclude:
        out = out.where(~paths.matches(p, list(exclude), case_sensitive))
    for name, want in (("compressed", compressed), ("encrypted", encrypted)):
        if want is not None:
            out = out.where(F.col(name) == want)
    return out.where(F.col("resource_type").isin(resource_types)) if resource_types else out


def summary(entries: DataFrame, compressed: Column, encrypted: Column, size_known: Column) -> DataFrame:
    """One row: how many entries, and how many are compressed, encrypted or of unknown size."""
    return entries.agg(
        F.count("*").alias("entry_count"),
        F.count_if(compressed).alias("compressed_count"),
        F.count_if(encrypted).alias("encrypted_count"),
        F.count_if(~F.coalesce(size_known, F.lit(True))).alias("unknown_size_count"),
    )


def totals(entries: DataFrame, matched: Column) -> DataFrame:
    """All and matching entries in one pass."""
    return entries.agg(F.count("*").alias("archive_total"), F.count_if(matched).alias("matched_total"))


def offset_page(entries: DataFrame, order: list[str], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page by position; Spark sorts no more than offset + limit rows of each partition."""
    if not 0 <= offset or not 1 <= limit <= MOST:
        raise ValueError("offset must be 0 or more, limit 1 to 1000")
    return entries.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, path: str, cursor: str | None = None, limit: int = 200, ties: list[str] = (), after: tuple | None = None) -> DataFrame:
    """The rows after a cursor, in path order; the filter reaches the scan, so pages don't grow slower.

    Where rows share a path, ``after`` has the last row's ``ties``: the rest of its path then comes first."""
    if cursor is not None:
        last = paths.path_of(cursor)
        beyond, same = F.col(path) > last, F.col(path) == last
        for tie, value in zip(ties, after or (), strict=False):
            beyond, same = beyond | (same & (F.col(tie) > value)), same & (F.col(tie) == value)
        rows = rows.where(beyond)
    return rows.orderBy(path, *ties).limit(limit)


def next_cursor(page: DataFrame, path: str, limit: int) -> str | None:
    """The cursor after a page that was fetched with one row more than ``limit``."""
    got = page.select(path).orderBy(path).take(limit + 1)
    return paths.cursor_of(got[limit - 1][0]) if len(got) > limit else None


def next_ties(page: DataFrame, path: str, limit: int, ties: list[str]) -> tuple | None:
    """The last row's ``ties``, beside ``next_cursor``."""
    got = page.select(path, *ties).orderBy(path, *ties).take(limit + 1)
    return tuple(got[limit - 1][1:]) if len(got) > limit else None


def budget_page(rows: DataFrame, order: list[str], size: Column, budget: int, partition: list[str] = ()) -> DataFrame:
    """The longest prefix whose running size fits; within each partition key, if there is one."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def selected_ids(entries: DataFrame, ids: DataFrame, key: str, types: list[str] | None = None) -> DataFrame:
    """Each requested id once, in the order of its first mention (``position``), with its entry or nulls; other types are left out."""
    once = ids.groupBy(key).agg(F.min("position").alias("position"))
    out = once.join(entries, key, "left")
    return out.where(F.col("resource_type").isNull() | F.col("resource_type").isin(types)) if types else out


def decoded_size(declared: Column, size: Column, size_known: Column) -> Column:
    """The declared number of decoded bytes (digits only), else the size where it isn't unknown, else null."""
    return F.when(declared.rlike("^[0-9]+$"), declared.try_cast("decimal(38,0)")).when(F.coalesce(size_known, F.lit(True)), size.cast("decimal(38,0)"))


def placed(offset: Column, size: Column, end: Column) -> Column:
    """Whether a range lies in a file."""
    return (offset < end) & (size <= end) & (offset <= end - size)


def sane_count(n: Column) -> Column:
    return (n > 0) & (n < 0x40000)


def next_offset_sizes(index: DataFrame, source: str, position: str, offset: str, end: Column) -> DataFrame:
    """Sizes from the next record's offset (the last from the end), and whether the index is in order and in bounds."""
    w = Window.partitionBy(source).orderBy(position)
    following = F.coalesce(F.lead(offset).over(w), end)
    return index.withColumn("size", following - F.col(offset)).withColumn("valid", (F.col("size") >= 0) & (following <= end))
