"""Format detection: signatures, extensions, ranking, confidence and diagnosis.

``formats`` (format_id, reg_order, extensions, priority, ext_fallback, ext_only) and ``signatures`` (format_id, sig_offset, sig) are dimension tables of a
registry, so their size doesn't follow the data.  Signatures are met by equality: one key column for each distinct (offset, length),
never a nested loop over files and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signature_matches(files: DataFrame, content: str, signatures: list[tuple[str, int, str]], keep: list[str]) -> DataFrame:
    """keep..., format_id of each file and format with a signature that its content has.  ``signatures`` are
    (format_id, offset, text)."""
    spark = files.sparkSession
    places = sorted({(o, len(s)) for _, o, s in signatures})
    table = spark.createDataFrame([(f, o, len(s), s) for f, o, s in signatures], "format_id string, sig_offset int, sig_len int, sig string")
    keys = F.array(*[F.struct(F.lit(o).alias("sig_offset"), F.lit(n).alias("sig_len"), F.substring(content, o + 1, n).alias("sig")) for o, n in places])
    known = [s for _, _, s in signatures]
    probes = files.select(*keep, F.explode(F.filter(keys, lambda k: k["sig"].isin(known))).alias("k")).select(*keep, "k.*")
    return probes.join(F.broadcast(table), ["sig_offset", "sig_len", "sig"]).select(*keep, "format_id").distinct()


def candidates(files: DataFrame, key: str, ext: str, signed: DataFrame, formats: DataFrame) -> DataFrame:
    """key, format_id, sig_match, ext_match and the registry's columns for each format that a file is a candidate of.

    A format with signatures needs a match, unless it may do without one (ext_fallback): then every file is a candidate.  One bound to extensions
    needs one of these as well; one with no signature is met by extension, or by every file if it has none of these either."""
    byext = formats.select("*", F.explode("extensions").alias("_ext"))
    by_ext = files.select(key, F.col(ext).alias("_ext")).join(F.broadcast(byext.select("format_id", F.lower("_ext").alias("_ext"))), "_ext").select(key, "format_id", F.lit(True).alias("ext_match"))
    by_sig = signed.select(key, "format_id", F.lit(True).alias("sig_match"))
    bare = formats.where(F.when(F.col("has_signatures"), F.col("ext_fallback")).otherwise(F.size("extensions") == 0) & ~F.col("ext_only")).select("format_id")
    for_all = files.select(key).join(F.broadcast(bare.withColumn("_1", F.lit(1))), F.lit(1) == F.col("_1")).select(key, "format_id")
    every = by_sig.withColumn("ext_match", F.lit(None).cast("boolean")).unionByName(by_ext.withColumn("sig_match", F.lit(None).cast("boolean"))).unionByName(for_all.withColumns({"ext_match": F.lit(None).cast("boolean"), "sig_match": F.lit(None).cast("boolean")}))
    met = every.groupBy(key, "format_id").agg(F.coalesce(F.bool_or("sig_match"), F.lit(False)).alias("sig_match"), F.coalesce(F.bool_or("ext_match"), F.lit(False)).alias("ext_match"))
    out = met.join(F.broadcast(formats.drop("extensions")), "format_id")
    gate = F.when(F.col("has_signatures"), F.col("sig_match") | F.col("ext_fallback")).otherwise(True)
    return out.where(gate & (~F.col("ext_only") | F.col("ext_match")))


def best(found: DataFrame, key: str) -> DataFrame:
    """The first candidate of each file: signature, extension, priority, order of registration.  A minimum of structs combines in each task and needs
    no sort of a file's candidates."""
    rank = F.struct((~F.col("sig_match")).alias("a"), (~F.col("ext_match")).alias("b"), (-F.col("priority")).alias("c"), F.col("reg_order").alias("d"))
    row = F.struct("format_id", "sig_match", "ext_match", "priority", "has_signatures")
    return found.groupBy(key).agg(F.min_by(row, rank).alias("f")).select(key, "f.*")


def ranked(found: DataFrame, key: str) -> DataFrame:
    """All candidates with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc("sig_match"), F.desc("ext_match"), F.desc("priority"), "reg_order")
    return found.withColumn("rank", F.row_number().over(w))


def confidence():
    """high by signature, medium by extension, else low."""
    return F.when(F.col("sig_match"), "high").when(F.col("ext_match"), "medium").otherwise("low")


def warning():
    return F.when(~F.col("sig_match") & F.col("ext_match") & F.col("has_signatures"), "extension only").when(~F.col("sig_match") & ~F.col("ext_match"), "neither signature nor extension")


def diagnosis(unrecognised: DataFrame, ext: str, formats: DataFrame) -> DataFrame:
    """Why a file has no format: kind, and the formats registered for its extension in order of registration."""
    byext = formats.select("format_id", "reg_order", F.explode("extensions").alias("_ext")).groupBy(F.lower("_ext").alias("_ext"))
    named = byext.agg(F.sort_array(F.collect_list(F.struct("reg_order", "format_id"))).alias("_f")).select("_ext", F.col("_f.format_id").alias("candidates"))
    out = unrecognised.join(F.broadcast(named), F.col(ext) == F.col("_ext"), "left").drop("_ext")
    kind = F.when(F.col(ext) == "", "unknown-format").when(F.col("candidates").isNotNull(), "registered-extension-no-match").otherwise("no-registered-format")
    return out.withColumn("kind", kind)


def outcome_counts(scan: DataFrame, outcome) -> DataFrame:
    return scan.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
