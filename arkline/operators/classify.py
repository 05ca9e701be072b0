"""Types of entries by a catalog of resources: (row_no, tag, resource_type, extensions, signatures), one row a resource.

The catalog is a registry: as large as the list of known formats, whatever the data; its keyed forms are made once and joined by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATALOG = "row_no int, tag string, resource_type string, extensions array<string>, signatures array<binary>"

# First bytes that name a tag before any signature of the catalog is looked at.
KNOWN_STARTS = [(b"OggS", "OGG"), (b"RIFF", "WAV"), (b"BM", "BMP")]


def _main(extensions: Column) -> Column:
    """The first extension that isn't empty, or null."""
    return F.get(F.filter(extensions, lambda e: e != ""), F.lit(0))


def unique_tags(catalog: DataFrame) -> DataFrame:
    """tag, resource_type and ext of the tags that one resource only has."""
    one = catalog.groupBy("tag").agg(F.count("*").alias("_n"), F.min("resource_type").alias("resource_type"), F.min(_main(F.col("extensions"))).alias("ext"))
    return one.where("_n = 1").drop("_n")


def unique_signatures(catalog: DataFrame) -> DataFrame:
    """signature, resource_type and ext of the signatures that one resource only has; a resource that lists one twice has it once."""
    each = catalog.select("row_no", "resource_type", _main(F.col("extensions")).alias("ext"), F.explode(F.array_distinct("signatures")).alias("signature"))
    one = each.groupBy("signature").agg(F.count("*").alias("_n"), F.min("resource_type").alias("resource_type"), F.min("ext").alias("ext"))
    return one.where("_n = 1").drop("_n")


def extension_types(catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """given_ext, resource_type, ext: the extensions all of whose resources have one type, with the first resource's own extension.

    ``aliases`` has (given_ext, position, tag): further resources that an extension stands for; its own come first, and one that is both counts once."""
    keep = [F.col("row_no"), F.col("resource_type"), _main(F.col("extensions")).alias("ext")]
    every = catalog.select(F.explode(F.array_distinct(F.transform("extensions", F.lower))).alias("given_ext"), F.lit(0).alias("_rank"), *keep)
    if aliases is not None:
        every = every.unionByName(catalog.join(aliases, "tag").select("given_ext", (F.col("position") + 1).alias("_rank"), *keep))
    first = F.min_by(F.struct("resource_type", "ext"), F.struct("_rank", "row_no"))
    found = every.where("given_ext <> ''").groupBy("given_ext").agg(first.alias("_f"), F.min("resource_type").alias("_a"), F.max("resource_type").alias("_b"))
    return found.where("_a = _b").select("given_ext", "_f.*")


def by_extension(entries: DataFrame, path: str, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The entries with resource_type of the text after the last dot of their whole path; null where it isn't known or not of one type."""
    from ..functions.paths import last_dot_extension

    types = extension_types(catalog, aliases).select("given_ext", "resource_type")
    return entries.withColumn("given_ext", last_dot_extension(F.col(path))).join(types, "given_ext", "left").drop("given_ext")


def by_signature(entries: DataFrame, first_bytes: str, catalog: DataFrame) -> DataFrame:
    """The entries with resource_type and ext of their first four bytes: known starts by tag, all else by unique signatures."""
    head = F.substring(first_bytes, 1, 4)
    tag = F.coalesce(*[F.when(F.substring(first_bytes, 1, len(start)) == F.lit(start), tag) for start, tag in KNOWN_STARTS])
    keyed = entries.withColumn("_tag", F.when(F.octet_length(head) == 4, tag)).withColumn("_sig", F.when((F.octet_length(head) == 4) & F.col("_tag").isNull(), head))
    # both looked up in one join: a key of two columns, of which one is null
    t = unique_tags(catalog).select(F.concat(F.lit("t"), "tag").alias("_key"), "resource_type", "ext")
    s = unique_signatures(catalog).select(F.concat(F.lit("s"), F.hex("signature")).alias("_key"), "resource_type", "ext")
    key = F.coalesce(F.concat(F.lit("t"), "_tag"), F.concat(F.lit("s"), F.hex("_sig")))
    return keyed.withColumn("_key", key).join(t.unionByName(s), "_key", "left").drop("_key", "_tag", "_sig")


def applied(classified: DataFrame, path: str) -> DataFrame:
    """Classified entries renamed: the last extension of the path gives way to ``ext`` where the class has one."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return classified.withColumn(path, F.when(F.col("resource_type").isNotNull() & F.col("ext").isNotNull(), F.concat(bare, F.lit("."), "ext")).otherwise(F.col(path)))
