"""Document fingerprints: MinHash over word shingles by universal hash permutations, in vectorised numpy.

A fingerprint has one byte of each of PERMUTATIONS least values.  Likeness is the share of equal bytes, less what equal bytes
two unrelated fingerprints have by chance.

Bands of signatures are joined in Spark: in each band's bucket a leader is linked to the others, links are verified by Jaccard on the full sets, and
buckets whose members are then in different components are searched exactly, as in ``near_dups``.  near_id is the least doc_id of a
document's component.  A link is lost only if no band holds its pair: with J = 0.75, 32 bands and 4 rows the chance is below 1e-5.

``edited`` puts a text's next document (by descending doc_id) beside it without a global sort: rows are cut into
ranges of doc_id (and of a hash of the text, where a doc_id has very many rows), each range is sorted by itself, and the first document of a range is
also dealt to the range before it.  Texts are moved once for this, compressed.

Cases: a null or empty text has no shingles; its fingerprint equals that of every other such text.  Rows that repeat a doc_id are ordered
by a hash of their text; a null doc_id comes last.  near_id of a document without shingles is its own doc_id; it is null only where no
document of the component has a doc_id.  A single document follows itself.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import bucketed, turned
from .common import BATCH_BYTES, BATCH_ROWS, arrow_map, drop_staged, staged, wide
from .near_dups import NO_ID, class_of, classes_of, combined, connected, lists, placed_in, short_names
from .shingles import MinHash, U, hashed, mixed

PERMUTATIONS, SEED = 128, 31
BANDS, ROWS, PERCENT = 32, 4, 75
#: Ranges of doc_id for each partition: more make partitions of more even size.
RANGES = 4


class Fingerprint:
    def __init__(self, n: int = PERMUTATIONS) -> None:
        self.least = MinHash(n, SEED)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return [(mixed(self.least(np.unique(x))) & U(255)).astype(np.uint8) for x in hashed(texts)]


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    same = float((x == y).mean())
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str | None, after: str | None) -> str:
    """The text with the last half of its code points replaced by the first as many (or all) of the next one."""
    text, after = text or "", after or ""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _places(keys: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], int]]:
    """Cuts (k and th) of the rows ``keys`` (k, th) into ranges of about the same size, and the greatest row of each range,
    with the range before it by falling order (the last one, for the first).  As many of each as there are ranges.

    A k that several cuts would fall on has many rows: they are cut at even steps of th, a hash."""
    found = keys.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    k, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    th = np.concatenate([np.zeros(0, np.int64), *((np.arange(1, n + 1, dtype=object) * (1 << 64) // (n + 1) - (1 << 63)).astype(np.int64) for n in times)])
    k = np.repeat(k, times)

    @F.pandas_udf("int")
    def range_of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_range(k, th, a.to_numpy(np.int64), b.to_numpy(np.int64)))

    heads = keys.withColumn("r", range_of("k", "th")).groupBy("r").agg(F.max(F.struct("k", "th")).alias("at")).orderBy("r").collect()
    return k, th, {(h.at.k, h.at.th): heads[i - 1].r for i, h in enumerate(heads)}


def _range(cut_k: np.ndarray, cut_th: np.ndarray, k: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The range, by falling order, of each row: how many cuts aren't below it."""
    low = np.searchsorted(cut_k, k, "left")
    high = np.searchsorted(cut_k, k, "right")
    for at in np.unique(k[high > low]):
        mine = k == at
        a, b = np.searchsorted(cut_k, at, "left"), np.searchsorted(cut_k, at, "right")
        low[mine] = a + np.searchsorted(cut_th[a:b], th[mine], "left")
    return (len(cut_k) - low).astype(np.int32)


def _dealt(docs: DataFrame, keys: DataFrame, near: DataFrame) -> DataFrame:
    """r, guest, k, th, doc_id, near_id, z: each range sorted by itself, with the first row of the next one as a guest.

    Rows of ``near`` (doc_id, th, near_id), without a text, stand before the documents they belong to."""
    spark = docs.sparkSession
    k = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k")
    cut_k, cut_th, before = _places(keys.select(k, "th"), wide(spark) * RANGES)
    tops = {top: before[top] for top in sorted(before)}

    def send(batches):
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            r = _range(cut_k, cut_th, a, b)
            texts = batch.column(4).to_pylist()
            z = [small.compress((t or "").encode()) if mine else None for t, mine in zip(texts, batch.column(5).to_pylist(), strict=True)]
            heads = [i for i, at in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if at in tops and z[i] is not None]
            prior = np.array([tops[int(a[i]), int(b[i])] for i in heads], np.int32)
            take = pa.array([*range(len(r)), *heads], pa.int64())
            columns = [c.take(take) for c in (*batch.columns[:4], pa.array(z, pa.binary()))]
            guest = np.repeat([False, True], [len(r), len(heads)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r, prior])), pa.array(guest), *columns], ["r", "guest", "k", "th", "doc_id", "near_id", "z"])

    rows = docs.select(k, "th", "doc_id", F.lit(None).cast("long").alias("near_id"), "text", F.lit(True).alias("own"))
    rows = rows.union(near.select(k, "th", "doc_id", "near_id", F.lit(None).cast("string"), F.lit(False)))
    sent = rows.mapInArrow(send, "r int, guest boolean, k long, th long, doc_id long, near_id long, z binary").repartition(wide(spark), "r")
    return sent.sortWithinPartitions("r", "guest", F.desc("k"), F.desc("th"), F.col("z").isNotNull())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_id of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, _, keys = _banded(docs, BANDS, ROWS, PERCENT)
    near = rows.where("component_id is not null and not component_id <=> doc_id").select("doc_id", "th", F.col("component_id").alias("near_id")).distinct()
    near = staged(near, "near")
    _set_batches(docs.sparkSession)

    def run(batches):
        mark, opened = Fingerprint(), zstandard.ZstdDecompressor()
        held: list[tuple] = []  # the last row, whose next one is yet to come
        at, names = None, {}
        for batch in batches:
            rows = held
            texts, found = [], []
            for guest, th, doc, near_id, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if z is None:
                    names = names if th == at else {}
                    at, names[doc] = th, near_id
                else:
                    texts.append(opened.decompress(z).decode())
                    found.append((guest, doc, names.get(doc, doc) if th == at else doc))
            rows = held + [(*f, t, m) for f, t, m in zip(found, texts, mark(texts), strict=True)]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[0]]
            held = rows[-1:]
            new = [edited(a[3], b[3]) for a, b in pairs]
            out = []
            for (a, b), text, other in zip(pairs, new, mark(new), strict=True):
                out.append((a[1], len(a[3]), hashlib.sha256(text.encode()).hexdigest(), a[4].tobytes().hex(), other.tobytes().hex(), likeness(a[4], other), likeness(a[4], b[4]), a[2]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)

    given = docs.withColumn("th", F.xxhash64("text"))
    dealt = _dealt(given, keys, near).select("guest", "th", "doc_id", "near_id", "z")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id long")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id"]


def _set_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bands_of(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, th, n, cls, c and keys (one for each band of the signature) of each row."""

    def make():
        least = MinHash(max(PERMUTATIONS, bands * rows), SEED)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, cls, keys = [], [], []
            for x in hashed(batch.column(2).to_pylist()):
                x = np.unique(x)
                n.append(len(x))
                cls.append(class_of(x) if len(x) else None)
                keys.append(combined(least(x)[: bands * rows], rows).view(np.int64) if len(x) else np.empty(0, np.int64))
            columns = [pa.array(n, pa.int64()), pa.array(cls, pa.binary()), short_names(cls), pa.array(keys, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "th", "n", "cls", "c", "keys"])

        return each

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), make, "doc_id long, th long, n long, cls binary, c long, keys array<long>")


def _banded(docs: DataFrame, bands: int, rows: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, th, n, cls and component_id of each row, the verified links, and doc_id and th of each row."""
    sig = staged(bands_of(docs, bands, rows), "bands")

    def members(batch):
        key, n = lists(batch.column(1))
        return turned(key, mixed(key)), np.repeat(batch.column(0).to_numpy().view(U), n)

    tabled = staged(bucketed(sig.where("n > 0").select("c", "keys"), members, sig.count() * bands), "tables")
    keys = staged(sig.drop("keys"), "rows")
    drop_staged(sig)
    classes = classes_of(keys)
    found, links = connected(docs, classes, tabled, percent)
    drop_staged(tabled)
    return placed_in(keys, classes, found), links, keys.select("doc_id", "th")


def banded(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between distinct texts, enough to connect all that are linked by way of others: bands of signatures are joined, each
    band's bucket around one leader, split buckets are searched exactly, and Jaccard is verified on the full sets."""
    return _banded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bands, rows, percent)[1]
