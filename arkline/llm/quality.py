"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Each text becomes a vector of statistics of its bytes, words and lines.  The standardised vector passes through cosines of
random projections (a Gaussian kernel in the limit).  Ridge scores come from normal equations that each partition sums and the driver
adds up; a part of the labelled rows that the ridge doesn't see turns scores into probabilities by pooling adjacent
violators.  Only a bounded sample of labelled rows is fitted (SAMPLE rows, by a hash of doc_id); all rows are scored.

Cases: a null text counts as empty, and an empty text has a score.  Without labelled rows of both
labels every row gets the share of label 1 (or 0.5), and ``kept`` keeps all.  A text of any length is read whole; it takes some ten times its size
in a worker.  Labels of null are left out; repeated labels count as often as they
stand.  Columns of the labels other than doc_id and quality, and of the documents other than doc_id and text, are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, arrow_map, keeping_columns, staged

#: Labelled rows that are fitted at most, cosines, ridge weight, partitions that sum, and the share kept for calibration.
SAMPLE, COSINES, RIDGE, PARTS, CALIBRATION = 40_000, 320, 0.01, 12, 4
THRESHOLD = 0.7

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!", b"?", b"\"'()-", b"|", b"%&$#*@^~", b"<>{}[]\\/=_+`"]
_GROUP = np.full(256, len(_GROUPS), np.int64)
for _k, _chars in enumerate(_GROUPS):
    _GROUP[list(_chars)] = _k
_WORD_END = re.compile(r"[^\W_]$")
N_STATS = len(_GROUPS) + 1 + 16


def statistics(text: str | None) -> np.ndarray:
    """The vector of one whole text."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    data = text.encode()
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    groups = np.bincount(_GROUP, bytes_, len(_GROUPS) + 1) / n
    share = bytes_[bytes_ > 0] / n
    words = data.split()
    count = Counter(words)
    w = max(1, len(words))
    size = np.fromiter(map(len, count), np.float64, len(count)) if count else np.zeros(1)
    times = np.fromiter(count.values(), np.float64, len(count)) if count else np.ones(1)
    lines = data.split(b"\n")
    k = len(lines)
    mean = (size * times).sum() / w
    upper = sum(n for x, n in count.items() if x.isupper())
    ended = sum(n for x, n in count.items() if not x[-1:].isalnum() and x[-1] < 128)
    out[: len(groups)] = np.sqrt(groups)
    out[len(groups) :] = [
        np.log1p(n), np.log1p(w), mean, np.sqrt(max(0, ((size - mean) ** 2 * times).sum() / w)), np.log1p(size.max()),
        len(count) / w**0.8, times.max() / w, np.sqrt((times**2).sum()) / w, times[size <= 3].sum() / w,
        -(share * np.log2(share)).sum(), np.log1p(k), np.log1p(n / k), len(set(lines)) / k, sum(map(len, set(lines))) / n,
        upper / w, ended / w,
    ]
    return out


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), N_STATS)


@dataclass
class Model:
    """All that scoring needs; its size doesn't depend on the input."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray
    #: Whether there were labels to learn from.
    learnt: bool = True

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cosines((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.level), 0, 1)


def cosines(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, with a constant."""
    random = np.random.default_rng(20)
    width = np.sqrt(N_STATS) * 1.2
    w, b = random.normal(0, 1 / width, (N_STATS, COSINES)), random.uniform(0, 2 * np.pi, COSINES)
    return np.hstack([np.sqrt(2 / COSINES) * np.cos(np.clip(x, -6, 6) @ w + b), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic regression of y on x by pooling adjacent violators, row by row: the least and the greatest x of each block, with its
    level.  Rows of equal x are one block to begin with; scores between two blocks are interpolated."""
    values, of, n = np.unique(x, return_inverse=True, return_counts=True)
    total = np.bincount(of, y, len(values))
    blocks: list[list] = []
    for k in range(len(values)):
        blocks.append([int(n[k]), float(total[k]), k, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            m, t, _, end = blocks.pop()
            blocks[-1][0] += m
            blocks[-1][1] += t
            blocks[-1][3] = end
    at = [values[k] for b in blocks for k in dict.fromkeys(b[2:])]
    level = [b[1] / b[0] for b in blocks for _ in dict.fromkeys(b[2:])]
    return np.array(at), np.array(level)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("_of"), F.col("quality").cast("int").alias("_y")).where("_of is not null and _y is not null").where(~held_out(F.col("_of")))
    total, ones = known.agg(F.count("*"), F.sum("_y")).first()
    if ones in (None, 0, total):
        level = np.full(2, ones / total if total else 0.5)
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(COSINES + 1), np.array([0.0, 1.0]), level, False)
    # at most about ``sample`` rows of 12 bytes: small enough to send to every task
    some = known.where(F.pmod(F.xxhash64("_of"), F.lit(1 << 20)) < int((1 << 20) * min(1, sample / total)))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), F.col("doc_id") == F.col("_of"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch.column(0).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "part"])

        return each

    part = F.pmod(F.xxhash64("_of", F.lit(5)), F.lit(CALIBRATION * PARTS)).cast("int")
    rows = staged(arrow_map(joined.select("text", "_y", part.alias("part")), make, "x array<double>, y int, part int"), "statistics")

    def summed(transform, where, size):
        """The sum over all rows of transform(x, y)' transform(x, y): each of at most PARTS tasks sums its own."""

        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = np.vstack(batch.column(0).to_numpy(zero_copy_only=False))
                    z = transform(x, batch.column(1).to_numpy().astype(float))
                    total = z.T @ z if total is None else total + z.T @ z
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["z"])

        got = [np.frombuffer(r[0]) for r in rows.where(where).coalesce(PARTS).mapInArrow(run, "z binary").collect()]
        z = np.sum(got, 0) if got else np.zeros(size**2)
        return z.reshape(size, size)

    s = summed(lambda x, y: np.hstack([np.ones((len(x), 1)), x]), "true", N_STATS + 1)
    n = max(1.0, s[0, 0])  # labels may belong to no document here
    mean = s[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(s)[1:] / n - mean**2, 1e-8))
    scale[scale < 1e-3] = 1
    z = summed(lambda x, y: np.hstack([cosines((x - mean) / scale), y[:, None]]), f"part % {CALIBRATION} <> 0", COSINES + 2)
    weights = np.linalg.solve(z[:-1, :-1] + RIDGE * np.eye(COSINES + 1), z[:-1, -1])
    model = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    rest = rows.where(f"part % {CALIBRATION} = 0").select("x", "y").collect()  # a fourth of the bounded sample
    if rest:  # else the ridge score itself, cut to 0 to 1
        model.at, model.level = isotonic(model.raw(np.array([r[0] for r in rest])), np.array([r[1] for r in rest], float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (text among them) and _score: one pass without a shuffle."""
    spark, names = docs.sparkSession, docs.columns
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    text = names.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(matrix(batch.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, "_score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("_score", DoubleType()))


def qualities(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fitted(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


@keeping_columns
def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns; all of them if there was nothing to learn from."""
    model = fitted(docs, labels)
    return scored(docs, model).where(F.col("_score") >= threshold).drop("_score") if model.learnt else docs
