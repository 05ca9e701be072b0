"""Best-fit packing of tokenised documents, after a Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so an instance of any size is described by one count for each length.
The counts alone are planned, on the driver, over at most ``capacity`` numbers:

1. Reduction.  A small set of pieces is fixed for good where it provably dominates every other set that holds its
   largest piece: the piece alone if nothing fits beside it; the piece and its exact complement; the piece and the largest
   one that fits, if no two others fit beside it, or if no three do and no two that fit weigh more than that one.
2. Best fit.  What is left goes, longest first, to the open sequence with the least room that is enough.

Both treat equal pieces together, so the plan is a list of a few thousand kinds of sequence with a multiplicity, however many pieces there are.
Pieces are then numbered within their length (salted, so a frequent length is shared among tasks) and look their place up; full
pieces, the most of a corpus of long texts, are numbered where they lie.

Cases: a null or empty text is the end token alone.  Repeated rows are packed once each; a null doc_id is a document like others.  A very long text is
encoded whole and takes some thirty times its size in a worker.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged, wide

CAPACITY, END = 1024, 2
#: Each length is numbered in this many independent shares.
SALTS = 128

#: Texts of these characters are split alike by all regex engines and Unicode versions; others go to the library.
_COMMON = re.compile("[\t\n\r -~\xa1-ɏ‐-⁞€]*")


class Encoder:
    """Token ids as the tokenizers library gives them for a byte-level BPE file.

    Common texts take a faster library that has the same ranks; ``tests/llm`` compares the two."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        from .token_count import byte_symbols

        back = {s: b for b, s in enumerate(byte_symbols())}
        added = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
        ranks = {bytes(back[c] for c in word): i for word, i in vocab.items() if word not in added}
        self.fast = tiktoken.Encoding("arkline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")

    def __call__(self, text: str) -> np.ndarray:
        if _COMMON.fullmatch(text) and not self.added.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except Exception:  # noqa: BLE001, S110  a text its pattern engine gives up on
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


# A fixed value: the pattern that byte-level BPE of this kind splits texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or capacity
    bounds = [0, *range(min(first, n), n + 1, capacity)] if n > capacity else [0, n]
    return list(zip(bounds, np.diff(bounds).tolist(), strict=False))


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of each row's tokens: doc_id, piece, start, length, ids_crc32, salt."""

    def make():
        encode = encoder(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    rows.append((doc, k, start, n, crc, zlib.crc32(f"{doc} {k} {crc}".encode()) % SALTS))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

        return each

    return arrow_map(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long, salt int")


def reduction(count: list[int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fixes dominating sets; lowers ``count`` (by length) by what they hold, and returns (kind, times)."""
    fixed = []

    def fix(times: int, *lengths: int) -> None:
        kind = tuple((s, lengths.count(s)) for s in sorted(set(lengths), reverse=True))
        for s, n in kind:
            count[s] -= n * times
        fixed.append((kind, times))

    def least(k: int, without: int) -> list[int]:
        """The k shortest pieces that are left, besides one of length ``without``."""
        out = []
        for s in range(1, capacity + 1):
            out += [s] * min(k - len(out), count[s] - (s == without))
            if len(out) == k:
                break
        return out

    for j in range(capacity, 0, -1):
        if count[j] and count[capacity - j] and j < capacity:  # exact complements
            k = capacity - j
            if times := (count[j] // 2 if j == k else min(count[j], count[k])):
                fix(times, j, k)
    for j in range(capacity, 0, -1):
        while count[j]:
            room, low = capacity - j, least(3, j)
            if not low or low[0] > room:
                # only one of several equal pieces can rely on the shortest other one being of its own length
                fix(count[j] if 2 * j > capacity else 1, j)
                continue
            best = next(s for s in range(min(room, capacity), 0, -1) if count[s] - (s == j) > 0)
            pair = len(low) < 2 or low[0] + low[1] > room
            if not pair and (len(low) < 3 or sum(low) > room):
                have = [s for s in range(1, room) if count[s] - (s == j) > 0]
                top = 0
                for a in have:
                    i = bisect.bisect_right(have, room - a) - 1
                    while i >= 0 and have[i] == a and count[a] - (a == j) < 2:
                        i -= 1
                    if i >= 0:
                        top = max(top, a + have[i])
                pair = top <= best
            if not pair:
                break
            # the tests look at three other pieces of this length at most: while there are more, all pairs of it stand as one
            fix(max(1, (count[j] - 4) // 2) if best == j else min(count[j], count[best]), j, best)
    return fixed


def best_fit(count: list[int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, of all that ``count`` (by length) holds; returns (kind, times)."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, kind: tuple, times: int) -> None:
        if times:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((kind, times))

    for s in range(capacity, 0, -1):
        left = count[s]
        while left:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):  # new sequences
                q = capacity // s
                put(capacity - q * s, ((s, q),), left // q)
                put(capacity - left % q * s, ((s, left % q),), int(left % q > 0))
                break
            room = rooms[i]
            kind, times = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            q = room // s  # as soon as one is in, this sequence has the least room that is enough
            full = min(times, left // q)
            put(room - q * s, (*kind, (s, q)), full)
            left -= full * q
            if full < times:
                put(room - left * s, (*kind, (s, left)) if left else kind, 1)
                put(room, kind, times - full - 1)
                left = 0
    return [x for kinds in open_.values() for x in kinds]


def plan(count: list[int], capacity: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], int]:
    """All kinds of sequence with their multiplicity, and how many of them the reduction fixed."""
    count = list(count)
    fixed = reduction(count, capacity)
    return fixed + best_fit(count, capacity), sum(n for _, n in fixed)


def places(kinds: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length, by rising first number of a piece: (first number, first sequence, pieces a sequence, offset)."""
    out, met, sequence = defaultdict(list), defaultdict(int), 0
    for kind, times in kinds:
        offset = 0
        for s, q in kind:
            out[s].append((met[s], sequence, q, offset))
            met[s] += q * times
            offset += q * s
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (as ``pieces`` makes them).

    A full piece is a sequence of its own: it is numbered where it lies, after the planned sequences."""
    every = staged(parts, "pieces")
    parts = every.where(F.col("length") < capacity)
    counted = parts.groupBy("length", "salt").count().collect()  # at most capacity x SALTS rows
    number = np.zeros((capacity + 1, SALTS), np.int64)
    for length, salt, n in counted:
        number[length, salt] = n
    total = number.sum(1)
    kinds = plan([int(x) for x in total], capacity)[0]
    place = places(kinds)
    first = np.cumsum(number, 1) - number

    def assign(batches):
        at, done = (None, None), 0
        for batch in batches:
            length, salt = (batch.column(k).to_numpy() for k in (3, 5))
            if not len(length):
                continue
            starts = np.flatnonzero(np.diff(length * SALTS + salt, prepend=-1))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for a, b in zip(starts, [*starts[1:], len(length)], strict=True):
                s, k = int(length[a]), int(salt[a])
                if (s, k) != at:
                    at, done = (s, k), 0
                mine = first[s, k] + done + np.arange(b - a)
                done += b - a
                rows = place[s]
                row = rows[np.searchsorted(rows[:, 0], mine, "right") - 1]
                nth = mine - row[:, 0]
                sequence[a:b] = row[:, 1] + nth // row[:, 2]
                offset[a:b] = row[:, 3] + nth % row[:, 2] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    first_full = sum(times for _, times in kinds)
    full = every.where(F.col("length") >= capacity).drop("salt").withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(first_full), "offset": F.lit(0).cast("long")})
    n = wide(parts.sparkSession)
    dealt = parts.repartition(n, "length", "salt").sortWithinPartitions("length", "salt", "doc_id", "piece", "start", "ids_crc32")
    return dealt.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").union(full)


def packed(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(pieces(df, path, capacity, end), capacity)
