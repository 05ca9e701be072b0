"""Digests, canonical JSON and stable identifiers."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NON_REFLECTED = [0] * 256
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else _c << 1
    _NON_REFLECTED[_i] = _c


def sha256(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def crc32(data: Column) -> Column:
    """The reflected CRC-32."""
    return F.crc32(data.cast("binary"))


def crc32_plain(data: bytes, start: int = 0xFFFFFFFF, end: int = 0xFFFFFFFF) -> int:
    """The non-reflected CRC-32 of the same polynomial."""
    crc = start
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _NON_REFLECTED[crc >> 24 ^ b]
    return crc ^ end


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    import zlib

    return data.map(lambda b: None if b is None else zlib.adler32(bytes(b))).astype("Int64")


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else canonical(json.loads(t)))


def stable_id(prefix: str, canonical_text: Column) -> Column:
    """prefix:sha256 of a canonical text."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(canonical_text.cast("binary"), 256))


def digest(rows_json: Column) -> Column:
    """One hash of a bounded number of rows' JSON, whatever their order (an aggregate): the hash of their sorted hashes.  ``digest_of`` does the same for a
    table of any size."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(rows_json.cast("binary"), 256))), "").cast("binary"), 256)


def digest_of(rows: DataFrame, rows_json: Column) -> str:
    """One hash of all rows' JSON, whatever their order: a tree of hashes.  Rows are grouped by the first digits of their hash, a group's hash is that of its
    members' in order, and so on upwards, so no list grows beyond what a group holds."""
    at = rows.select(F.sha2(rows_json.cast("binary"), 256).alias("h")).withColumn("g", F.substring("h", 1, 5))
    for digits in (3, 1, 0):
        joined = F.array_join(F.array_sort(F.collect_list("h")), "")
        at = at.groupBy("g").agg(F.sha2(F.concat("g", joined).cast("binary"), 256).alias("h")).select(F.concat("g", "h").alias("h"), F.substring("g", 1, digits).alias("g"))
    got = at.select("h").orderBy("h").collect()  # one row for each first digit
    return hashlib.sha256("".join(r.h for r in got).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def decode_cp932(data: pd.Series) -> pd.Series:
    """Bytes up to the first NUL, read as CP932."""
    return data.map(lambda b: None if b is None else bytes(b).split(b"\0", 1)[0].decode("cp932", "replace"))
