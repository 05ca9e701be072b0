"""Members of hash buckets, with little data moved.

Each member is 16 bytes: a 64-bit key and a 64-bit reference.  A task sorts its members by key, keeps one of those that are equal, and sends
them in blocks of numpy bytes, dealt by key.  A key that a task holds more than LOCAL times is a hot one: its members are put around a leader
there and then, and only the leader goes on, so a key that a third of all rows share takes one member of each task.

The low TURN_BITS bits of a key are its turn: each turn has its own order of leaders, so groups that share many keys aren't one star.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, wide
from .shingles import U, mixed, numbers

TURN_BITS = 2
#: Members that a task sorts together, copies of a key in them that make it hot, and members that are brought together for one block of keys.
CHUNK, LOCAL, BLOCK = 1 << 19, 64, 1 << 21
#: Star rows of a hot key that are sent in one block.
SENT = 1 << 16
_TURN = numbers(23, 1 << TURN_BITS)
_SCHEMA = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("lead", pa.int64()), ("m", pa.int32())])


def _grouped(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (key, c) by key, the start of each key's run, and its size."""
    order = np.lexsort((c, key))
    key, c = key[order], c[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
    key, c = key[new], c[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key, c, starts, np.diff([*starts, len(key)])


def _leads(key: np.ndarray, c: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The leader of each member's bucket: the first in the order of the key's turn."""
    rank = mixed(c ^ _TURN[(key & U(len(_TURN) - 1)).astype(np.int64)])
    bucket = np.repeat(np.arange(len(starts)), sizes)
    first = np.lexsort((c, rank, bucket))[starts]
    return np.repeat(c[first], sizes)


def _stars(key: np.ndarray, c: np.ndarray, lead: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, c, lead)]
    return pa.RecordBatch.from_arrays([*longs, pa.array(m.astype(np.int32))], schema=_SCHEMA)


def bucketed(rows: DataFrame, members: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], expected: int) -> DataFrame:
    """key, c, lead, m: each member c of a bucket that has two or more, its leader (a row of its own), and the bucket's size as far as it was looked at together.

    ``members`` gives keys and references of a batch; ``expected`` is about how many there are of them in all."""
    spark = rows.sparkSession
    deal = wide(spark)
    parts = deal * max(4, -(-expected // (deal * BLOCK)))  # several for each task, so that tasks are even
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = pa.schema([("part", pa.int32()), ("star", pa.bool_()), ("data", pa.binary())])

    def packed(key: np.ndarray, c: np.ndarray):
        key, c, starts, sizes = _grouped(key, c)
        hot = np.repeat(sizes > LOCAL, sizes)
        if hot.any():
            big = sizes > LOCAL
            own = _leads(key[hot], c[hot], np.cumsum(sizes[big]) - sizes[big], sizes[big])
            stars = np.stack([key[hot], c[hot], own, np.repeat(sizes[big], sizes[big]).astype(U)], 1)
            for k in range(0, len(stars), SENT):
                part = int(mixed(stars[k : k + 1, 1])[0] % U(parts))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([True]), pa.array([stars[k : k + SENT].tobytes()], pa.binary())], schema=schema)
            keep = ~hot
            # beside the leader a second member goes on, so that with a member from elsewhere the bucket counts as one of three
            at = np.flatnonzero(hot)
            keep[at[own == c[hot]]] = True
            first = np.cumsum(sizes[big]) - sizes[big]
            keep[at[np.where(own[first] == c[at[first]], first + 1, first)]] = True
            key, c = key[keep], c[keep]
        part = (mixed(key) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, both = part[order], np.stack([key[order], c[order]], 1)
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        blocks = [both[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(part)], strict=False)]
        for k in range(0, len(blocks), BATCH_ROWS):
            some = blocks[k : k + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[k : k + BATCH_ROWS]].astype(np.int32)), pa.array([False] * len(some)), pa.array(some, pa.binary())], schema=schema)

    def send(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                key, c = members(batch)
                held.append((key, c))
                n += len(key)
                if n >= CHUNK:
                    yield from packed(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from packed(*map(np.concatenate, zip(*held, strict=True)))

    def meet(batches):
        held, at = [], None

        def met():
            both = np.frombuffer(b"".join(held), U).reshape(-1, 2)
            key, c, starts, sizes = _grouped(both[:, 0], both[:, 1])
            shared = np.repeat(sizes > 1, sizes)
            if shared.any():
                key, c, sizes = key[shared], c[shared], sizes[sizes > 1]
                starts = np.cumsum(sizes) - sizes
                yield _stars(key, c, _leads(key, c, starts, sizes), np.repeat(sizes, sizes))

        for batch in batches:
            for part, star, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if star:
                    yield _stars(*np.frombuffer(data, U).reshape(-1, 4).T)
                    continue
                if part != at and held:
                    yield from met()
                    held = []
                at = part
                held.append(data)
        if held:
            yield from met()

    sent = rows.mapInArrow(send, "part int, star boolean, data binary")
    return sent.repartition(deal, "part").sortWithinPartitions("part").mapInArrow(meet, "key long, c long, lead long, m int")


def turned(key: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """``key`` with ``turn`` in its low bits."""
    low = U((1 << TURN_BITS) - 1)
    return key & ~low | turn & low


def splits(stars: DataFrame) -> DataFrame:
    """The keys whose members may hold a link that no leader shows.  ``stars``: key, c, lead and comp (any value that stands for c's component).

    Around one leader, each other member was compared with it; only others of different components can hide a link.  Where a hot
    key has several leaders, members of different stars weren't compared, so all count."""
    other = F.when(F.col("c") != F.col("lead"), F.col("comp"))
    seen = stars.groupBy("key").agg(F.min(other).alias("a"), F.max(other).alias("b"), F.min("comp").alias("p"), F.max("comp").alias("q"), F.min("lead").alias("s"), F.max("lead").alias("t"))
    return seen.where("a <> b or s <> t and p <> q").select("key")
