"""Sinks: files written whole or not at all, reports, and catalogs named by their content.

Tasks may run twice, so each writes to a name of its own attempt and then installs it: a link if nothing may be overwritten, else a
rename.  What an attempt leaves behind it removes itself."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

RESULT = "path string, status string, bytes long, sha256 string, error string"


def install(target: str, data: bytes, overwrite: bool = False) -> str:
    """Writes a file and gives its sha256; FileExistsError if it is there and may not be replaced."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    attempt = f"{target}.{uuid.uuid4().hex}.part"
    try:
        with open(attempt, "xb") as f:
            f.write(data)
        if overwrite:
            os.replace(attempt, target)
        else:
            os.link(attempt, target)
    finally:
        if os.path.lexists(attempt):
            os.unlink(attempt)
    return hashlib.sha256(data).hexdigest()


def write_files(rows: DataFrame, root: str, policy: str = "fail") -> DataFrame:
    """Writes ``path`` and ``bytes`` of each row below a shared folder; a row that fails doesn't stop the others.

    ``policy`` for files that are there: fail, skip or overwrite.  Null and unsafe paths, and those that two rows share once both slashes are read
    as one, fail before anything is written."""
    keyed = rows.withColumn("_to", F.coalesce(paths.normalised(F.col("path")), F.lit("")))
    n = keyed.groupBy("_to").agg(F.count("*").alias("_n"))
    checked = keyed.join(n, "_to").select("path", "bytes", (paths.unsafe(F.col("_to")) | (F.col("_n") > 1)).alias("bad"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data, bad in zip(batch["path"], batch["bytes"], batch["bad"], strict=True):
                target = os.path.join(root, *str(path).replace("\\", "/").split("/"))
                if bad:
                    out.append((path, "failed", None, None, "UNSAFE_PATH"))
                    continue
                try:
                    out.append((path, "extracted", len(data), install(target, bytes(data), policy == "overwrite"), None))
                except FileExistsError:
                    with open(target, "rb") as f:
                        same = f.read() == bytes(data)
                    # an earlier attempt of this very task may have installed it
                    status = "extracted" if same and policy != "skip" else "skipped" if policy == "skip" else "failed"
                    out.append((path, status, len(data) if status == "extracted" else None, hashlib.sha256(bytes(data)).hexdigest() if status == "extracted" else None, None if status != "failed" else "OUTPUT_EXISTS"))
                except OSError as e:
                    out.append((path, "failed", None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"bytes": "Int64"})

    return checked.mapInPandas(run, RESULT)


def wire(rows: DataFrame, big: list[str] = ()) -> DataFrame:
    """One JSON text for each row; whole numbers of the columns ``big`` as decimal strings, nulls left out."""
    return rows.select(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c in big else F.col(c) for c in rows.columns])).alias("value"))


def write_report(rows: DataFrame, folder: str) -> str:
    """A report as JSON lines in a folder of a new name, which is returned."""
    target = f"{folder.rstrip('/')}/{uuid.uuid4()}.report"
    wire(rows).write.text(target)
    return target


def read_report(spark: SparkSession, folder: str, name: str, schema: str, most: int = 64 << 20) -> DataFrame:
    """The rows of a report by the name that ``write_report`` gave it; ValueError for any other name, and for a report above 64 MiB."""
    if not re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\.report", name):
        raise ValueError("INVALID_ARGUMENT: not the name of a report")
    target = f"{folder.rstrip('/')}/{name}"
    if (spark.read.format("binaryFile").load(target).agg(F.sum("length")).first()[0] or 0) > most:
        raise ValueError("LIMIT_EXCEEDED: the report is too large")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(target)


def contained(root: str, path: str) -> str:
    """The real path below a real root, links followed; ValueError if it lies outside."""
    base, found = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([base, found]) != base:
        raise ValueError(f"UNSAFE_PATH: {path}")
    return found


def write_catalog(records: DataFrame, folder: str, header: dict) -> str:
    """Writes a catalog's JSON lines, in order of id, into a folder named by their digest.  The same content is written once."""
    from ..functions.hashing import canonical, digest_of

    head = canonical({"kind": "header", "schemaVersion": 1} | header)
    lines = records.select(F.col("id"), F.to_json(F.struct(*records.columns)).alias("value"))
    name = hashlib.sha256(f"{head}\n{digest_of(lines, F.col('value'))}".encode()).hexdigest()
    target = f"{folder.rstrip('/')}/{name}.jsonl"
    spark = records.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
        # a folder without that mark was left half written
        first = spark.createDataFrame([("", head)], "id string, value string")
        first.unionByName(lines).orderBy("id").select("value").write.mode("overwrite").text(target)
    return target


def summary_of(result: DataFrame) -> str:
    return json.dumps(result.first().asDict(), separators=(",", ":"))
