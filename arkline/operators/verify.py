"""Verification of extracted bytes against what was expected of them."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ["verified", "inspected", "mismatch", "invalid", "failed"]


def status(valid: Column, matched: Column) -> Column:
    """invalid before mismatch before verified; with neither an expectation nor a valid structure inspected."""
    return F.when(~valid, "invalid").when(~matched, "mismatch").when(matched | valid, "verified").otherwise("inspected")


def level(expected: Column, valid: Column) -> Column:
    return F.when(expected.isNotNull(), "manifest").when(valid, "structural").otherwise("hash")


def matched(actual_sha: Column, actual_bytes: Column, expected_sha: Column, expected_bytes: Column) -> Column:
    """Whether all that was expected holds (hashes in any case); null if nothing was.  What is expected and missing doesn't hold."""
    ok = (expected_sha.isNull() | F.lower(expected_sha).eqNullSafe(actual_sha)) & (expected_bytes.isNull() | expected_bytes.eqNullSafe(actual_bytes))
    return F.when(expected_sha.isNotNull() | expected_bytes.isNotNull(), ok)


def rollup(rows: DataFrame, by: Column) -> DataFrame:
    return rows.groupBy(by.alias("status")).agg(F.count("*").alias("n"))


def manifest_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


# The fields of an expected entry that are compared where it has them.
EXPECTED_FIELDS = ["size", "packed_size", "compressed", "encrypted", "checksum"]


def listing_differences(expected: DataFrame, listed: DataFrame, path: str = "path", fields: list[str] = EXPECTED_FIELDS) -> DataFrame:
    """(path, field, wanted, got) of all that differs.  Paths are compared as lists: one side's more frequent ones give a row with the field ``path`` and the two counts.
    The other fields are compared where they are expected; of a path listed twice the last ``entry_pos`` counts."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    n = lambda df, name: df.groupBy(path).agg(F.count("*").alias(name))
    counts = n(expected, "_e").join(n(listed, "_l"), path, "full").where("not (_e <=> _l)")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    of_paths = counts.select(path, F.lit("path").alias("field"), number("_e").alias("wanted"), number("_l").alias("got"))
    last = listed.groupBy(path).agg(F.max_by(F.map_from_entries(texts), "entry_pos").alias("_got"))
    wanted = expected.select(path, F.explode(texts).alias("w")).select(path, "w.field", F.col("w.v").alias("wanted")).where("wanted is not null")
    of_fields = wanted.join(last, path).withColumn("got", F.col("_got")[F.col("field")]).where("not (wanted <=> got)").select(path, "field", "wanted", "got")
    return of_paths.unionByName(of_fields)


def sniffed(content: Column) -> Column:
    """ogg, wav or bmp by the first bytes."""
    head = lambda n: F.substring(content, 1, n)
    return F.when(head(4) == F.lit(b"OggS"), "ogg").when((head(4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WAVE")), "wav").when(head(2) == F.lit(b"BM"), "bmp")


def wave_report(data: bytes) -> dict:
    """Walks a WAV's chunks: valid, warnings, and the parameters of its format."""
    out = {"valid": False, "warnings": [], "channels": None, "rate": None, "seconds": None}
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        out["warnings"].append("not a WAV")
        return out
    if struct.unpack_from("<I", data, 4)[0] + 8 != len(data):
        out["warnings"].append("size of the file differs from its header")
    at, rate, payload, seen = 12, 0, None, set()
    while at + 8 <= len(data):
        tag, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > len(data):
            out["warnings"].append("a chunk ends beyond the file")
            return out
        if tag == b"fmt " and n >= 16:
            _, out["channels"], out["rate"], rate, *_ = struct.unpack_from("<HHIIHH", data, at + 8)
        elif tag == b"data":
            payload = n
        seen.add(tag)
        at += 8 + n + n % 2
    if out["channels"] is None:
        out["warnings"].append("no usable format")
    elif not (out["channels"] and out["rate"] and rate):
        out["warnings"].append("a parameter is zero")
    if payload is None:
        out["warnings"].append("no data")
    elif rate:
        out["seconds"] = payload / rate
    out["valid"] = not out["warnings"]
    return out


@F.pandas_udf(T.StructType().add("valid", T.BooleanType()).add("warnings", T.ArrayType(T.StringType())).add("channels", T.IntegerType()).add("rate", T.IntegerType()).add("seconds", T.DoubleType()))
def wave(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([wave_report(bytes(c)) for c in content], columns=["valid", "warnings", "channels", "rate", "seconds"]).astype({"channels": "Int32", "rate": "Int32"})
