"""Tables of files, entries and decoded bytes.

Archives are read where their bytes are: one map over files, no shuffle.  Listing prunes ``content`` from everything but the map; globs and depth filter
paths before any content is opened."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .archives import InvalidArchive, Registry, Unsupported, default_registry

ENTRY = "source_path string, format_id string, entry_pos int, entry_id string, path string, raw_path string, size long, size_known boolean, packed_size long, compressed boolean, encrypted boolean, offset long, checksum string"
DETECTION = "source_path string, outcome string, format_id string, confidence string, warnings array<string>, entry_count int, message string"


def scan(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_depth: int = 8, recursive: bool = True) -> DataFrame:
    """path, relative, modified, length and content of the files below a folder.

    The path filters stand above the scan alone, so files they turn away are not opened when content isn't read."""
    if not 0 <= max_depth <= 64:
        raise ValueError("max_depth is 0 to 64")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    bare = root.split(":", 1)[-1].rstrip("/")
    at = F.expr(f"instr(path, {_literal(bare + '/')})") + len(bare) + 1
    out = files.select("path", F.substring("path", at, F.lit(1 << 30)).alias("relative"), F.col("modificationTime").alias("modified"), "length", "content")
    out = out.where(paths.depth(F.col("relative")) <= max_depth)
    if include:
        out = out.where(paths.matches(F.col("relative"), list(include)))
    return out.where(~paths.matches(F.col("relative"), list(exclude))) if exclude else out


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Files move to the readers in Arrow batches of at most this many bytes and one file more, whatever the input.
BATCH_BYTES = 4 << 20


def _batched(files: DataFrame, *columns: str) -> DataFrame:
    """The columns of ``files`` that a map of whole files reads, in bounded batches: a worker holds a batch several times (Arrow, pandas, the one before)."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return files.select(*columns)


def detected(files: DataFrame, registry: Callable[[], Registry] = default_registry) -> DataFrame:
    """The outcome of each file: archive, unrecognized or failure.  Candidates are tried in rank order until one opens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = registry()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    reader, entries, confidence, warnings = known.open(bytes(content), path)
                    rows.append((path, "archive", reader.format_id, confidence, warnings, len(entries), None))
                except InvalidArchive as e:
                    rows.append((path, "unrecognized", None, None, [], None, str(e)))
                except Exception as e:  # noqa: BLE001  one file's failure is its own row
                    rows.append((path, "failure", None, None, [], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTION.split(", ")]).astype({"entry_count": "Int32"})

    return _batched(files, "path", "content").mapInPandas(run, DETECTION)


def entries(files: DataFrame, registry: Callable[[], Registry] = default_registry) -> DataFrame:
    """The entries of each file that a reader opens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = registry()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    reader, found, _, _ = known.open(bytes(content), path)
                except Exception:  # noqa: BLE001  ``detected`` has a row for what can't be opened; one file doesn't stop the others
                    continue
                rows = [(path, reader.format_id, i, e.entry_id, e.path, e.raw_path, e.size, e.size_known, e.packed_size, e.compressed, e.encrypted, e.offset, e.checksum) for i, e in enumerate(found)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return _batched(files, "path", "content").mapInPandas(run, ENTRY)


def extracted(files: DataFrame, wanted: DataFrame, registry: Callable[[], Registry] = default_registry) -> DataFrame:
    """source_path, entry_id, bytes, sha256, status and error of the wanted (source_path, entry_id).

    Wanted ids are gathered by file (as many as a file has), each file is opened once, and an entry that fails doesn't stop the others."""
    ids = wanted.groupBy("source_path").agg(F.collect_set("entry_id").alias("ids"))
    rows = files.select("path", "content").join(ids, F.col("path") == F.col("source_path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = registry()
        for batch in batches:
            for path, content, want in zip(batch["path"], batch["content"], batch["ids"], strict=True):
                out, data = [], bytes(content)
                try:
                    reader, found, _, _ = known.open(data, path)
                except Exception as e:  # noqa: BLE001  one file's failure is its own rows
                    why = str(e) if isinstance(e, (InvalidArchive, Unsupported)) else f"{type(e).__name__}: {e}"
                    out = [(path, i, None, None, "failed", why) for i in want]
                else:
                    by = {e.entry_id: e for e in found}
                    for i in want:
                        if i not in by:
                            out.append((path, i, None, None, "failed", "ENTRY_NOT_FOUND"))
                            continue
                        try:
                            got = reader.read(data, by[i])
                            out.append((path, i, got, hashlib.sha256(got).hexdigest(), "extracted", None))
                        except Exception as e:  # noqa: BLE001  nor does one entry stop the others
                            out.append((path, i, None, None, "failed", f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["source_path", "entry_id", "bytes", "sha256", "status", "error"])

    return _batched(rows, "path", "content", "ids").mapInPandas(run, "source_path string, entry_id string, bytes binary, sha256 string, status string, error string")
