"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches by falling doc_id.  A batch's line keys become a run, sorted by hash: (hash, n_docs, holder).  A key that no
earlier run has is new: the merge anti-join finds it, and its largest doc_id, which is the largest of all, holds it.  Of other
keys the batch adds only the number of documents.  When a level has FAN runs they are merged into one run of the next level,
so a key meets a logarithmic number of runs.  Keys that enough documents have lose their lines outside their holder.

Only (doc_id, text hash, line number, key hash) of long enough lines is kept beside the documents; runs and lines are Parquet in
the shared folder.  A key is known by two independent 64-bit hashes.  All steps are DataFrame operations.

Cases: a null or empty text is one empty line, and stays an empty text.  Each row is a document of its own: repeated rows count
each, and the rows that repeat a key's largest doc_id all keep its lines.  A null doc_id counts as smaller than any other.  An empty table
gives no rows.  Other columns are ignored by ``counts`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, keeping_columns, keyed_join, staged

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches of documents, and runs of a level that are merged into one of the next.
BATCHES, FAN = 4, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAST = -(1 << 63)
_BLANK = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST)), F.xxhash64(docs["text"])


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """d, th (the row), at (line number), h1 and h2 (the key) of each line that is long enough, and whether the row has it
    for the first time, so that a document counts once."""
    d, th = _identity(docs)
    def key_at(line: Column, at: Column) -> Column:
        key = F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)
        long = F.transform(F.array(key), lambda k: F.when(F.char_length(k) >= least_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), at.alias("at"))))
        return F.when(F.char_length(line) >= least_chars, long[0])  # stripping only shortens a line

    rows = docs.select(d.alias("d"), th.alias("th"), F.sort_array(F.filter(F.transform(lines_of(docs["text"]), key_at), lambda x: x.isNotNull())).alias("keys"))
    before = lambda i: F.get("keys", i - 1)
    first = lambda x, i: (i == 0) | (before(i)["h1"] != x["h1"]) | (before(i)["h2"] != x["h2"])
    flagged = F.transform("keys", lambda x, i: F.struct(x["at"].alias("at"), x["h1"].alias("h1"), x["h2"].alias("h2"), first(x, i).alias("first")))
    return rows.where(F.size("keys") > 0).select("d", "th", F.explode(flagged).alias("x")).select("d", "th", "x.*")


def _merged(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.union(r)
    return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))


def _sorted_run(df: DataFrame, level: int) -> DataFrame:
    return staged(df.sortWithinPartitions("h1", "h2"), f"run-{level}")


def runs_of(keys: DataFrame, batches: int = BATCHES, fan: int = FAN) -> list[DataFrame]:
    """The levelled runs over staged line keys."""
    cuts = keys.agg(F.percentile_approx("d", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    levels: list[list[DataFrame]] = [[]]
    for low, high in list(zip(bounds, bounds[1:], strict=False))[::-1]:  # by falling doc_id
        batch = keys
        if low is not None:
            batch = batch.where(F.col("d") > low)
        if high is not None:
            batch = batch.where(F.col("d") <= high)
        own = batch.groupBy("h1", "h2").agg(F.count_if("first").alias("n_docs"), F.max("d").alias("holder"))
        earlier = [r.select("h1", "h2") for level in levels for r in level]
        if earlier:
            seen = earlier[0]
            for r in earlier[1:]:
                seen = seen.union(r)
            new = own.join(seen.hint("merge"), ["h1", "h2"], "left_anti")
            known = own.join(seen.hint("merge"), ["h1", "h2"], "left_semi").withColumn("holder", F.lit(None).cast("long"))
            own = new.union(known)
        levels[0].append(_sorted_run(own, 0))
        for n in range(len(levels)):
            if len(levels[n]) >= fan:
                if n + 1 == len(levels):
                    levels.append([])
                levels[n + 1].append(_sorted_run(_merged(levels[n]), n + 1))
                for r in levels[n]:
                    drop_staged(r)
                levels[n] = []
    return [r for level in levels for r in level]


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """d, th and gone (line numbers) of the rows that lose lines."""
    keys = staged(line_keys(docs, least_chars), "lines")
    frequent = _merged(runs_of(keys)).where(F.col("n_docs") >= least_docs)
    gone = keyed_join(keys, frequent, ["h1", "h2"]).where(F.col("d") < F.col("holder"))
    return gone.groupBy("d", "th").agg(F.collect_set("at").alias("gone"))


def _kept(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with _lines and _gone."""
    d, th = _identity(docs)
    joined = docs.withColumns({"_d": d, "_th": th}).join(gone.select(F.col("d").alias("_d"), F.col("th").alias("_th"), F.col("gone").alias("_gone")), ["_d", "_th"], "left")
    return joined.withColumn("_lines", lines_of(F.col("text")))


def kept_text() -> Column:
    # the numbers that stay, by one hash of those that go
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    return F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _kept(docs, dropped_lines(docs))
    return rows.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"))


@keeping_columns
def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their remaining text; n_chars, where there is one, follows it."""
    out = _kept(docs, dropped_lines(docs))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept_text())
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


# The same in SQL.  (DuckDB's trim takes the characters as a list; translate maps A-Z alone.)
ORACLE = f"""
WITH l AS (
  SELECT doc_id, row_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents)
), k AS (
  SELECT doc_id, row_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT row_id) >= {LEAST_DOCS}
), m AS (SELECT k.*, f.holder IS NOT NULL AND k.doc_id < f.holder AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row_id, doc_id
"""
