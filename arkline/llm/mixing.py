"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents are leaves of a tree domain -> language -> source.  Tokens are estimated from bytes.  A leaf can give at most ``epochs`` times
its tokens.  The total budget is handed down: a node's budget is shared among its children by weight, and no child gets
more than its subtree can give; what a short child leaves goes to its siblings.  Only what a whole subtree can't take goes
to the siblings of its parent.  A leaf's budget is spent on a token-prefix of its seeded epochs: whole epochs first, then the
documents of the next epoch in the order of a seeded hash while they fit.

Only sums for each leaf (and for each leaf's hash ranges) are shuffled.  Each document is kept or not where it lies, by its leaf's last hash, so
a leaf that has a third of all rows needs no task of its own, and texts are not moved.

Cases: null texts count one token, null languages and sources are the name ``''``; an unknown language or domain has the weight of ``other``.  Rows
that repeat (doc_id and text) have the same hash and are kept or left together, where both fit.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keeping_columns, staged

# The default target weights.  Sources of a language share its weight evenly.
DOMAINS = {"web": 0.4, "code": 0.1, "books": 0.3, "news": 0.2, "other": 0.1}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "other": 0.1}
#: Part of all tokens that the mix has, epochs at most, seed, bytes of a token.
FRACTION, EPOCHS, SEED, TOKEN_BYTES = 0.6, 2, 17, 4
LEAF = ["domain", "lang", "source"]
_KINDS = ["web", "code", "books", "news"]


def domain_of(source: Column) -> Column:
    """The domain of a source: by its number, or ``other`` if its name has none."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    # not element_at: over an array of literals, its generated code takes a null index for the last element
    name = F.get(F.array(*map(F.lit, _KINDS)), number % len(_KINDS))
    return F.coalesce(name, F.lit("other"))


def _leaves(docs: DataFrame) -> DataFrame:
    source, lang = F.coalesce(docs["source"], F.lit("")), F.coalesce(docs["lang"], F.lit(""))
    tokens = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(docs["text"]), F.lit(0)) / TOKEN_BYTES)).cast("long")
    return docs.withColumns({"_domain": domain_of(source), "_lang": lang, "_source": source, "_tokens": tokens})


def order_key(doc_id: Column, epoch: Column | int, seed: int = SEED) -> Column:
    """The seeded order of documents in an epoch: 32 hexadecimal digits."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(column: str, weights: dict[str, float]) -> Column:
    out = F.lit(weights["other"])
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out


def _filled(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (parent, name, weight, cap, budget of the parent) with each child's ``share``: as water fills vessels of
    the widths ``weight`` and the volumes ``cap``."""
    w = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "name")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.withColumns({"done": F.coalesce(F.sum("cap").over(before), F.lit(0)), "width": F.sum("weight").over(after)})
    # a child is full if the level that the rest would stand at is above it
    rows = rows.withColumn("level", F.greatest(F.lit(0.0), (F.col("budget") - F.col("done")) / F.col("width")))
    rows = rows.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    first = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    return rows.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(first * F.col("weight"))).cast("long"))


def budgets(leaves: DataFrame, fraction: float, epochs: int, domains: dict[str, float], languages: dict[str, float]) -> DataFrame:
    """domain, lang, source, tokens, budget for each leaf of ``leaves`` (domain, lang, source, tokens)."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    top = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("_t")).withColumn("name", F.col("domain")).withColumn("weight", _weight("domain", domains))
    # the whole budget: over one row for each domain
    top = top.withColumn("root", F.lit(1)).withColumn("budget", F.floor(F.sum("_t").over(Window.partitionBy("root")) * F.lit(fraction)))
    top = _filled(top, ["root"]).select("domain", F.col("share").alias("budget"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("name", F.col("lang")).withColumn("weight", _weight("lang", languages))
    mid = _filled(mid.join(top, "domain"), ["domain"]).select("domain", "lang", F.col("share").alias("budget"))
    low = caps.withColumn("name", F.col("source")).withColumn("weight", F.lit(1.0)).join(mid, ["domain", "lang"])
    return _filled(low, ["domain", "lang"]).select(*LEAF, "tokens", F.col("share").alias("budget"))


def _last_keys(rows: DataFrame, plan: DataFrame, epochs: int, seed: int) -> DataFrame:
    """For each leaf: whole epochs, and the last order key of the epoch after them that still fits (null: none)."""
    plan = plan.withColumn("whole", F.least(F.lit(epochs), F.floor(F.col("budget") / F.col("tokens"))).cast("int"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    open_ = rows.join(plan.where(f"whole < {epochs} and rest > 0").select(*LEAF, "whole", "rest"), LEAF)
    open_ = open_.withColumn("key", order_key(F.col("doc_id"), F.col("whole"), seed))
    # sums of the leaf's hash ranges come first; only the range that the budget ends in is looked at by document, and the
    # ranges are fine enough that it is a small part of the leaf
    two = [F.substring("key", 1, 2).alias("r1"), F.substring("key", 3, 2).alias("r2")]
    ranges = open_.groupBy(*LEAF, "whole", "rest", *two).agg(F.sum("tokens_").alias("t"))
    leaf = Window.partitionBy(*LEAF)
    coarse = ranges.groupBy(*LEAF, "whole", "rest", "r1").agg(F.sum("t").alias("t")).withColumn("before", F.sum("t").over(leaf.orderBy("r1")) - F.col("t"))
    at1 = coarse.where("before <= rest and before + t > rest").select(*LEAF, "r1", F.col("before").alias("before1"))
    fine = ranges.join(at1, [*LEAF, "r1"]).withColumn("before", F.col("before1") + F.sum("t").over(leaf.orderBy("r2")) - F.col("t"))
    at2 = fine.where("before <= rest and before + t > rest").select(*LEAF, F.concat("r1", "r2").alias("r"), "before")
    docs = open_.join(at2, LEAF).where(F.substring("key", 1, 4) == F.col("r"))
    run = docs.withColumn("sum", F.col("before") + F.sum("tokens_").over(leaf.orderBy("key")))  # equal keys stand or fall together
    ends = run.groupBy(*LEAF).agg(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("key"))).alias("last_doc"), F.max("r").alias("r"))
    out = plan.select(*LEAF, "whole", "rest").join(ends, LEAF, "left")
    # without a document of the last range, all ranges before it are in
    last = F.when((F.col("rest") > 0) & F.col("r").isNotNull(), F.coalesce("last_doc", "r")).when(F.col("rest") > 0, F.lit("g"))
    return out.select(*LEAF, "whole", last.alias("last"))


def mixed(docs: DataFrame, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED, domains: dict[str, float] | None = None, languages: dict[str, float] | None = None) -> DataFrame:
    """The documents of the mix with their own columns, and _domain, _tokens and _epoch (from 0) of each time they are in it."""
    rows = _leaves(docs)
    narrow = rows.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("tokens_"))
    narrow = staged(narrow, "narrow")
    leaves = narrow.groupBy(*LEAF).agg(F.sum("tokens_").alias("tokens"))
    plan = staged(budgets(leaves, fraction, epochs, domains or DOMAINS, languages or LANGUAGES), "budgets")
    last = staged(_last_keys(narrow, plan, epochs, seed), "last")
    last = last.select(*[F.col(c).alias(f"_{c}") for c in LEAF], F.col("whole").alias("_whole"), F.col("last").alias("_last"))
    joined = rows.join(last, ["_domain", "_lang", "_source"])
    partial = F.col("_last").isNotNull() & (order_key(F.col("doc_id"), F.col("_whole"), seed) <= F.col("_last"))
    times = F.col("_whole") + F.when(partial, 1).otherwise(0)
    copies = joined.withColumn("_times", times).where("_times > 0")
    if epochs == 1:
        copies = copies.withColumn("_epoch", F.lit(0))
    else:
        copies = copies.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return copies.select(*docs.columns, "_domain", "_tokens", "_epoch")


@keeping_columns
def selected(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, once for each time that they are in it, with their own columns."""
    return mixed(docs, **options).select(*docs.columns)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, domain, lang, source, tokens and epoch of each time that a document is in the mix."""
    out = mixed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), **options)
    return out.select("doc_id", F.col("_domain").alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("_tokens").alias("tokens"), F.col("_epoch").cast("long").alias("epoch"))


def _cases(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w!r}::DOUBLE" for k, w in weights.items()) + f" ELSE {weights['other']!r}::DOUBLE END"


def _fill_sql(name: str, rows: str, parent: str) -> str:
    over = f"PARTITION BY {parent} ORDER BY cap / weight, name ROWS BETWEEN"
    return f"""{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done,
  sum(weight) OVER ({over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS width FROM ({rows})),
{name}_b AS (SELECT *, greatest(0.0::DOUBLE, (budget - done)::DOUBLE / width) AS level FROM {name}_a),
{name}_c AS (SELECT *, cap <= level * weight AS filled FROM {name}_b),
{name} AS (SELECT *, CASE WHEN filled THEN cap ELSE floor(max(CASE WHEN NOT filled THEN level END) OVER (PARTITION BY {parent}) * weight)::BIGINT END AS share FROM {name}_c)"""


_DOCS = f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN ['{"', '".join(_KINDS)}'][try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 + 1] ELSE 'other' END AS domain,
  greatest(1, ceil(coalesce(strlen(text), 0) / {TOKEN_BYTES}.0))::BIGINT AS tokens FROM documents)"""
ORACLE = f"""WITH {_DOCS},
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS t, sum(tokens)::BIGINT * {EPOCHS} AS cap FROM d GROUP BY ALL),
tot AS (SELECT floor(sum(t) * {FRACTION}::DOUBLE)::BIGINT AS budget FROM leaf),
{_fill_sql("f1", f"SELECT 1 AS root, domain, domain AS name, sum(cap)::BIGINT AS cap, {_cases('domain', DOMAINS)} AS weight, any_value(budget) AS budget FROM leaf, tot GROUP BY domain", "root")},
{_fill_sql("f2", f"SELECT domain, lang, lang AS name, sum(leaf.cap)::BIGINT AS cap, {_cases('lang', LANGUAGES)} AS weight, any_value(f1.share) AS budget FROM leaf JOIN f1 USING (domain) GROUP BY domain, lang", "domain")},
{_fill_sql("f3", "SELECT domain, lang, source, source AS name, t, leaf.cap, 1.0::DOUBLE AS weight, f2.share AS budget FROM leaf JOIN f2 USING (domain, lang)", "domain, lang")},
e AS (SELECT domain, lang, source, least({EPOCHS}, share // t) AS whole, share - least({EPOCHS}, share // t) * t AS rest FROM f3),
k AS (SELECT d.*, whole, rest, md5(concat_ws(':', '{SEED}', whole::VARCHAR, doc_id::VARCHAR)) AS key FROM d JOIN e USING (domain, lang, source)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS run FROM k),
n AS (SELECT *, whole + CASE WHEN whole < {EPOCHS} AND run <= rest THEN 1 ELSE 0 END AS times FROM r)
SELECT doc_id, domain, lang, source, tokens, unnest(generate_series(0, times - 1))::BIGINT AS epoch FROM n WHERE times > 0
"""
