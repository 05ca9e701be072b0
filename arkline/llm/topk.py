"""Exact top-k by inner product, block at a time.

Vectors become whole numbers, floor(SCALE x).  Ranges of vec_id are blocks; a block has its vectors (the forward index) and the
greatest and least value of each component.  For a query the maxima of all components' terms sum to a bound of the block:
blocks are scored by falling bound until the bound is below the k-th score that the query has so far.  Pairs of equal score are
never cut off, so ties go to the smaller vec_id exactly.

Queries are taken in chunks of a fixed size (CHUNK bytes), each sent to all tasks; a task reads blocks of WINDOW bytes at a time, gives its k best of
each query, and these are merged by query.  Sums are exact: in double precision where length times greatest value squared is below 2**53, in 64-bit
integers where it is below 2**63.  Beyond that a score may not fit a long, and the search raises an error.

Cases: vectors that are null, or hold null or non-finite components, take no part.  Vectors are compared with those of their
own length only.  Rows that repeat a vec_id are candidates each; a query's own vec_id is none.  Fewer
candidates than k give fewer rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, wide

K, SCALE, EVERY = 5, 256, 50
#: Vectors of a block, and bytes of a chunk of queries.
BLOCK, CHUNK = 256, 16 << 20
#: Stands for no score: no inner product that fits is so small.
_NONE = np.iinfo(np.int64).min
#: Bytes of blocks that a task holds at a time.
WINDOW = 64 << 20


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, an array of longs, of the rows that take part."""
    ok = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _blocked(rows: DataFrame) -> DataFrame:
    """Blocks of neighbouring vec_ids of one length: the length d, ids, values, and the greatest and least value of each component."""

    def run(batches):
        d, ids, values = None, [], []

        def block(n):
            i, v = np.array(ids[:n], np.int64), np.array(values[:n], np.int64)
            del ids[:n], values[:n]
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (i, v, v.max(0), v.min(0)))], ["d", "ids", "v", "hi", "lo"])

        for batch in batches:
            for size, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (size != d or len(ids) == BLOCK):
                    yield block(len(ids))
                d = size
                ids.append(i)
                values.append(v)
        if ids:
            yield block(len(ids))

    dealt = rows.select(F.size("v").alias("d"), "vec_id", "v").repartitionByRange(wide(rows.sparkSession), "d", "vec_id")
    return dealt.sortWithinPartitions("d", "vec_id").mapInArrow(run, "d int, ids binary, v binary, hi binary, lo binary")


def _search(chunk: tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]], k: int, batches):
    """The k best candidates in this task for each query of the chunk, among vectors of its length."""
    own, by_size = chunk
    best = {d: Best(own[at], q, k) for d, (at, q) in by_size.items()}
    held: dict[int, list] = defaultdict(list)
    size = 0
    for b in batches:
        for d, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if d in by_size:
                ids, v, hi, lo = (np.frombuffer(x, np.int64) for x in row)
                held[d].append((ids, v.reshape(len(ids), d), hi, lo))
                size += v.nbytes
        if size > WINDOW:
            for d, blocks in held.items():
                best[d].add(blocks)
            held.clear()
            size = 0
    for d, blocks in held.items():
        best[d].add(blocks)
    for d, (at, _) in by_size.items():
        r, found, score = best[d].found()
        yield pa.RecordBatch.from_arrays([pa.array(at[r], pa.int64()), pa.array(found), pa.array(score)], ["q", "vec_id", "score"])


class Best:
    """The k best candidates so far of each query (all of one length)."""

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int) -> None:
        self.own, self.q, self.k = own, q, k
        self.score = np.full((len(q), k), _NONE)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.greatest = int(np.abs(q).max(initial=0))

    def add(self, blocks: list[tuple]) -> None:
        """Scores blocks by falling bound until the bound is below a query's k-th score."""
        q, score, found = self.q, self.score, self.ids
        high, low = (np.array([b[i] for b in blocks]) for i in (2, 3))
        most = self.greatest * int(max(np.abs(high).max(initial=0), np.abs(low).max(initial=0))) * max(1, q.shape[1])
        kind = np.float64 if most < 1 << 53 else np.int64
        bound = np.maximum(q, 0).astype(kind) @ high.T.astype(kind) + np.minimum(q, 0).astype(kind) @ low.T.astype(kind)
        order = np.argsort(-bound, axis=1, kind="stable")
        mine_q = q.astype(kind)
        active = np.arange(len(q))
        for turn in range(len(blocks)):
            active = active[bound[active, order[active, turn]] >= score[active, -1]]
            if not len(active):
                break
            mine = order[active, turn]
            for b in np.unique(mine):
                rows = active[mine == b]
                ids, v = blocks[b][:2]
                s = (mine_q[rows] @ v.T.astype(kind)).astype(np.int64)
                s[self.own[rows][:, None] == ids[None]] = _NONE
                s, i = np.hstack([score[rows], s]), np.hstack([found[rows], np.broadcast_to(ids, s.shape)])
                best = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s falls as s rises, for all longs
                score[rows], found[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q, vec_ids and scores."""
        r, c = np.nonzero(self.score != _NONE)
        return r, self.ids[r, c], self.score[r, c]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each vector whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    rows = whole(vectors, scale)
    schema = "query_id long, rank int, vec_id long, score long"
    rows = staged(rows, "vectors")
    blocks = staged(_blocked(rows), "blocks")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    top, size = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("decimal(20,0)"))))), F.max(F.size("v"))).first()
    if top and int(top) ** 2 * size >= 1 << 63:
        raise ValueError("inner products of these vectors may not fit a long")
    total = queries.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    chunks = max(1, -(-total * 8 // CHUNK))
    out = None
    for c in range(chunks):  # of a fixed size each
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").collect()
        if not got:
            continue
        sizes = np.array([len(r.v) for r in got])
        by_size = {int(d): (at := np.flatnonzero(sizes == d), np.array([got[i].v for i in at], np.int64).reshape(len(at), d)) for d in np.unique(sizes)}
        chunk = np.array([r.vec_id for r in got], np.int64), by_size
        sent = spark.sparkContext.broadcast(chunk)
        run = functools.partial(_sent, sent, k)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        best = blocks.mapInArrow(run, "q long, vec_id long, score long").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        part = best.select("q", "rank", "vec_id", "score").mapInArrow(functools.partial(_named, sent), schema)
        part = staged(part, "best") if chunks > 1 else part
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _sent(sent, k, batches):
    return _search(sent.value, k, batches)


def _named(sent, batches):
    own = sent.value[0]
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(own[b.column(0).to_numpy()]), *b.columns[1:]], ["query_id", "rank", "vec_id", "score"])


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= {K}
"""
