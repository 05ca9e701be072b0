"""Near duplicates by MinHash with tensored banding.

Two collections of M small hashes, each of K MinHash values, give M x M table keys: every pair of one hash of either
collection is the key of one table.  So M * M tables of 2 K values need 2 M K values in place of 2 M M K.

1. One pass hashes each text's shingles; texts of equal sets form a class, and only classes go on.
2. Classes that meet nobody in the first collection can meet nobody in a table: only those that do get table keys, and only for the hashes
   that they share.
3. In each table's bucket a leader is linked to the others (leaders differ by turn, so groups aren't one star): no pairs
   of a bucket are listed.  Links are verified on the full sets, and components found.
4. Buckets in which members besides the leader are in different components may hide links between them.  Their members are searched exactly: in the
   order of a counting sketch, two sets that are similar enough share one of their rarest shingles (a prefix filter; any
   total order is exact, the sketch only makes it selective).  Shingles that nobody of another component shares are not listed, and pairs that exact
   bounds rule out are not made.

Members of buckets are moved as 16 bytes (``buckets``).  Texts are moved only where a bucket asks for them, compressed; a filter of fixed size tells
which.  A class is known by 128 bits; its first 64 stand for it where candidates are sought, so that a clash there makes a candidate more, not a link.

A link is lost only if no table holds its pair: with J = 0.75, M = 12 and K = 2 the chance is below 1e-4, and less above.

Cases: null texts and texts without words have no shingles, are linked with nothing and stay.  Repeated rows are one class; rows that repeat
the smallest doc_id of a component all stay.  A text of any length is hashed whole, in pieces; it takes some three times its size in a worker.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import bucketed, splits, turned
from .common import arrow_map, drop_staged, key_filter, keeping_columns, keyed_join, staged, wide
from .components import components
from .shingles import MinHash, U, hashed, mixed

M, K = 12, 2
PERCENT = 75
#: Counters of the sketch, a fixed size whatever the input, and chunks that they are sent in.
SKETCH, CHUNKS = 1 << 20, 64
#: Parities of a set in 64-bit words: a bound on how many elements two sets differ in.
WORDS = 16
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def class_of(x: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return np.array([mixed(x ^ U(0xA5A5)).sum(dtype=U), mixed(x + U(len(x))).sum(dtype=U)], U).tobytes()


def combined(values: np.ndarray, k: int) -> np.ndarray:
    """Each k MinHash values in a row as one key."""
    rows = values.reshape(-1, k)
    out = mixed(rows[:, 0] + (np.arange(len(rows), dtype=U) << U(3)))
    for i in range(1, k):
        out = mixed(out ^ rows[:, i])
    return out


def signatures(docs: DataFrame, m: int = M, k: int = K) -> DataFrame:
    """doc_id, th, n, cls (128 bits that stand for the set), c (64 of them), a and b (the two collections) of each row."""

    def make():
        least = MinHash(2 * m * k, 11)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, cls, keys = [], [], []
            for x in hashed(batch.column(2).to_pylist()):
                x = np.unique(x)
                n.append(len(x))
                cls.append(class_of(x) if len(x) else None)
                keys.append(combined(least(x), k).view(np.int64) if len(x) else np.empty(0, np.int64))
            longs = pa.list_(pa.int64())
            columns = [pa.array(n, pa.int64()), pa.array(cls, pa.binary()), short_names(cls), pa.array([x[:m] for x in keys], longs), pa.array([x[m:] for x in keys], longs)]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "th", "n", "cls", "c", "a", "b"])

        return each

    return arrow_map(docs, make, "doc_id long, th long, n long, cls binary, c long, a array<long>, b array<long>")


def short_names(cls: list[bytes | None]) -> pa.Array:
    return pa.array([int.from_bytes(x[:8], "little", signed=True) if x else None for x in cls], pa.int64())


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists of longs, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False).view(U), column.value_lengths().to_numpy(zero_copy_only=False)


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(u, v) as classes: the pairs (u, v: short names) whose full sets are similar enough."""

    def make():
        opened = zstandard.ZstdDecompressor()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            new = [*{*left, *right}]
            kept = dict(zip(new, map(np.unique, hashed(opened.decompress(z).decode() for z in new)), strict=True))
            ok = []
            for s, t in zip(left, right, strict=True):
                x, y = kept[s], kept[t]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            return batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        return each

    two = pairs.join(texts.select(F.col("c").alias("u"), F.col("cls").alias("x"), F.col("z").alias("s")), "u")
    two = two.join(texts.select(F.col("c").alias("v"), F.col("cls").alias("y"), F.col("z").alias("t")), "v")
    return arrow_map(two.select(F.col("x").alias("u"), F.col("y").alias("v"), "s", "t"), make, "u binary, v binary")


def identity(docs: DataFrame) -> list[Column]:
    """_of and _th: what a row of documents is known by in joins."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_of"), F.xxhash64("text").alias("_th")]


def compressed(docs: DataFrame) -> DataFrame:
    """_of, _th and z, the text as zstd, of each row of documents."""

    def make():
        small = zstandard.ZstdCompressor(level=1)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            z = [small.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(z, pa.binary())], ["_of", "_th", "z"])

        return each

    return arrow_map(docs.select("_of", "_th", "text"), make, "_of long, _th long, z binary")


def texts_of(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """cls, c and z (the text, compressed) of the classes of ``ends`` (cls, c, at)."""
    ends = ends.select("cls", "c", F.coalesce("at.doc_id", F.lit(NO_ID)).alias("_of"), F.col("at.th").alias("_th"))
    some = key_filter(ends, ["_of", "_th"])(docs.select(*identity(docs), "text")).where("_met")
    return compressed(some).join(ends, ["_of", "_th"]).dropDuplicates(["_of", "_th"]).select("cls", "c", "z")


def counted(texts: DataFrame) -> np.ndarray:
    """A counting sketch of the shingles of ``texts``: SKETCH counters of a byte (255: as many or more).

    Each task sends its counters in chunks, which are added up chunk by chunk; the driver gets SKETCH bytes, whatever the input."""

    def rows(chunks):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in chunks], pa.int32()), pa.array([x.tobytes() for _, x in chunks], pa.binary())], ["chunk", "n"])

    def count(batches):
        seen, opened = np.zeros(SKETCH, np.uint8), zstandard.ZstdDecompressor()
        for batch in batches:
            for x in hashed(opened.decompress(z).decode() for z in batch.column(0).to_pylist()):
                slot, n = np.unique((np.unique(x) % U(SKETCH)).astype(np.int64), return_counts=True)
                seen[slot] = np.minimum(seen[slot] + n, 255)
        parts = [(c, x) for c, x in enumerate(seen.reshape(CHUNKS, -1)) if x.any()]
        for i in range(0, len(parts), 16):
            yield rows(parts[i : i + 16])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[c] = np.minimum(total.get(c, 0) + np.frombuffer(n, np.uint8).astype(np.int64), 255)
        for c, n in total.items():
            yield rows([(c, n.astype(np.uint8))])

    schema = "chunk int, n binary"
    dealt = texts.select("z").mapInArrow(count, schema).repartition(wide(texts.sparkSession), "chunk")
    out = np.zeros((CHUNKS, SKETCH // CHUNKS), np.uint8)
    for c, n in dealt.mapInArrow(add, schema).collect():
        out[c] = np.frombuffer(n, np.uint8)
    return out.reshape(-1)


def prefixes(texts: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """c, comp, n (its set's size), keys and places (those of its rarest shingles, a prefix in the sketch's order, that somebody may
    share, and their places in that order), and w0... (the parities of WORDS x 64 shares of the set)."""
    names = [f"w{k}" for k in range(WORDS)]

    def make():
        opened = zstandard.ZstdDecompressor()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, keys, places, words = [], [], [], []
            for x in hashed(opened.decompress(z).decode() for z in batch.column(2).to_pylist()):
                x = np.unique(x)
                count = sketch[(x % U(SKETCH)).astype(np.int64)]
                first = np.lexsort((x, count))[: len(x) - -(-percent * len(x) // 100) + 1]
                at = np.flatnonzero(count[first] > 1)
                n.append(len(x))
                keys.append(x[first[at]].view(np.int64))
                places.append(at)
                odd = np.bincount((mixed(x) % U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
                words.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            words = np.array(words)
            longs = pa.list_(pa.int64())
            columns = [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(keys, longs), pa.array(places, longs), *[pa.array(words[:, k]) for k in range(WORDS)]]
            return pa.RecordBatch.from_arrays(columns, ["c", "comp", "n", "keys", "places", *names])

        return each

    return arrow_map(texts.select("c", "comp", "z"), make, "c long, comp long, n long, keys array<long>, places array<long>, " + ", ".join(f"{w} long" for w in names))


def may_link(percent: int) -> str:
    """Whether the sets of x and y can be similar enough, as the condition of a join on a shared prefix shingle; exact bounds,
    so no link is lost.  At the first shingle that two prefixes share, what may be common is bounded by what follows it in
    both; and sets differ at least in as many elements as their parities do."""
    need = f"{percent} * (x.n + y.n)"  # common * (100 + percent) must reach it
    apart = " + ".join(f"bit_count(x.w{k} ^ y.w{k})" for k in range(WORDS))
    return f"x.comp < y.comp and {100 + percent} * least(x.n - x.at, y.n - y.at) >= {need} and {100 + percent} * (x.n + y.n - ({apart})) >= 2 * {need}"


def grouped(docs: DataFrame, m: int = M, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of documents."""
    return _grouped(docs, m, k, percent).drop("th")


def _grouped(docs: DataFrame, m: int, k: int, percent: int) -> DataFrame:
    """``grouped`` with th, the hash of the row's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = staged(signatures(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), m, k), "signatures")
    classes = classes_of(sig, "a", "b")
    rows = sig.count()

    def of_first(batch):
        key, n = lists(batch.column(1))
        return key, np.repeat(batch.column(0).to_numpy().view(U), n)

    def of_both(batch):
        a, na = lists(batch.column(1))
        b, nb = lists(batch.column(2))
        c = batch.column(0).to_numpy().view(U)
        key, of, turn, at, to = [], [], [], np.cumsum([0, *na]), np.cumsum([0, *nb])
        for i in range(len(c)):
            x, y = a[at[i] : at[i + 1]], b[to[i] : to[i + 1]]
            key.append(mixed(x[:, None] ^ mixed(y)[None]).reshape(-1))
            turn.append(np.repeat(mixed(x), len(y)))
            of.append(np.full(len(x) * len(y), c[i]))
        return turned(np.concatenate(key), np.concatenate(turn)), np.concatenate(of)

    met = bucketed(classes.select("c", "a"), of_first, rows * m).select("c", "key").distinct()
    live = met.groupBy("c").agg(F.collect_list("key").alias("a")).join(classes.select("c", "b"), "c")
    tabled = staged(bucketed(live.select("c", "a", "b"), of_both, rows * m), "tables")
    found, _ = connected(docs, classes, tabled, percent)
    drop_staged(tabled)
    out = placed_in(sig, classes, found).select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def classes_of(sig: DataFrame, *arrays: str) -> DataFrame:
    """cls, c, at (the row that stands for the class: the least doc_id, null only where there is no other), and ``arrays``."""
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("at")
    return staged(sig.where("n > 0").groupBy("cls", "c").agg(at, *[F.first(x).alias(x) for x in arrays]), "classes")


def placed_in(sig: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``sig`` with component_id, the least doc_id of their component (null without one)."""
    parts = classes.select("cls", "at.doc_id").join(found.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    least = parts.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = keyed_join(parts, least, ["root"]).select("cls", "component_id")
    return sig.select("doc_id", "th", "n", "cls").join(of_class, "cls", "left")


def connected(docs: DataFrame, classes: DataFrame, tabled: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components (v, root) of the classes that share a bucket of ``tabled`` (key, c, lead, m), split buckets searched exactly, and
    the verified links (u, v) they come from."""
    pairs = tabled.where("c <> lead").select(F.least("c", "lead").alias("u"), F.greatest("c", "lead").alias("v")).distinct()
    ends = staged(classes.select("cls", "c", "at").join(tabled.select("c").distinct(), "c"), "ends")
    texts = staged(texts_of(docs, ends), "texts")
    links = staged(verified(pairs, texts, percent), "links")
    found = staged(components(links), "found")

    # comp: 64 bits that stand for a component
    comps = ends.select("cls", "c").join(found.withColumnRenamed("v", "cls"), "cls", "left").select("c", F.xxhash64(F.coalesce("root", "cls")).alias("comp"))
    # buckets of two are verified as a whole
    placed = staged(keyed_join(tabled.where("m > 2"), comps, ["c"]).select("key", "c", "lead", "comp"), "placed")
    rest = staged(keyed_join(placed, splits(placed), ["key"], "left_semi").select("c", "comp").distinct(), "rest")
    drop_staged(placed)
    if rest.head(1):
        open_texts = staged(texts.join(rest, "c"), "open")
        rare = staged(prefixes(open_texts, counted(open_texts), percent), "rare")
        drop_staged(open_texts)
        each = rare.select("comp", F.explode("keys").alias("key"))
        # members of one component are known to be linked: a shingle's members are met with those of other components only
        mixed_keys = each.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        words = [f"w{k}" for k in range(WORDS)]
        rows = rare.select("c", "comp", "n", *words, F.explode(F.arrays_zip("keys", "places")).alias("k")).select("c", "comp", "n", *words, F.col("k.keys").alias("key"), F.col("k.places").alias("at"))
        both = staged(keyed_join(rows, mixed_keys, ["key"], "left_semi"), "both")
        more = both.alias("x").join(both.alias("y"), F.expr(f"x.key = y.key and {may_link(percent)}"))
        more = more.select(F.least("x.c", "y.c").alias("u"), F.greatest("x.c", "y.c").alias("v")).distinct()
        more = staged(verified(more.join(pairs, ["u", "v"], "left_anti"), texts, percent), "more")
        if more.head(1):
            found = staged(components(found.select(F.col("v").alias("u"), F.col("root").alias("v")).union(more)), "found")
            links = links.union(more)
        drop_staged(rare)
        drop_staged(both)
    for t in (texts, rest, ends):
        drop_staged(t)
    return found, links


@keeping_columns
def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for; null doc_ids stay.

    Rows that the filter of dropped rows holds back stay where they lie; the others are joined to the dropped rows."""
    gone = _grouped(docs, M, K, percent).where("not kept").select(F.col("doc_id").alias("_of"), F.col("th").alias("_th")).distinct()
    gone = staged(gone, "gone")
    rows = key_filter(gone, ["_of", "_th"])(docs.withColumns({"_of": identity(docs)[0], "_th": identity(docs)[1]}))
    stay = rows.where("not _met").select(*docs.columns)
    return stay.union(rows.where("_met").join(gone, ["_of", "_th"], "left_anti").select(*docs.columns))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
