"""URL filters: rules by longest match, and boosted trees on lexical features for the urls that no rule fits.

The urls that a rule fits are the labelled ones: the trees learn from three quarters of all of them (by a hash of the url), and the last quarter sets
the threshold.  Features are lexical: lengths, depth, digit ratio, entropy, counts of parameters and marks, and statistics of the
host's suffix (how many pages of the whole table end in it).  The trees never see a rule or the suffix itself.

Cases: a null url, or one without ``://``, has an empty host and path, and its verdict comes from the trees.  Repeated rows each get their row.
Without rules that fit anything, every url is allowed.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import learned, thresholds
from .common import keyed_join

# The rules as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A url is blocked by the trees if at least this share of equally scored urls is blocked.
PRECISION = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None)
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(url: pd.Series, host: pd.Series, path: pd.Series, pages: pd.Series) -> np.ndarray:
    """The features of each url."""
    out = np.zeros((len(url), 16))
    for k, (u, h, p) in enumerate(zip(url.fillna(""), host, path, strict=True)):
        data = np.frombuffer(u.encode(), np.uint8)
        share = np.bincount(data)[np.unique(data)] / max(1, len(data))
        name = h.split(".")[:-2] or [h]
        digits = sum(c.isdigit() for c in u)
        out[k] = [
            len(u), len(h), len(p), p.count("/"), h.count("."), digits / max(1, len(u)), -(share * np.log2(share)).sum(), u.count("&") + ("?" in u), u.count("="),
            "#" in u, h.count("-"), u.count("-") - h.count("-"), max(map(len, name)), u.startswith("https"), p.endswith("/"), 0,
        ]
    out[:, 15] = np.log1p(pages)
    return out


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumns({"host": host, "path": path})
    rows = rows.withColumns({"found": rule_of(rules), "suffix": F.regexp_extract("host", r"[^.]*$", 0)})
    # pre-aggregated in each task, and joined so that a frequent suffix can be split
    ends = rows.groupBy("suffix").agg(F.count("*").alias("_pages"))
    every = ends.agg(F.sum("_pages")).first()[0] or 1
    rows = keyed_join(rows, ends, ["suffix"]).withColumn("_pages", F.col("_pages") * (1000.0 / every))

    @F.pandas_udf("array<double>")
    def features(url: pd.Series, host: pd.Series, path: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series(list(lexical(url, host, path, pages)))

    known = rows.where("found is not null")
    block, seen = (F.col("found.verdict") == "block").cast("int"), F.pmod(F.xxhash64("url"), F.lit(4)) != 0
    (model,), scored = learned(known.select(F.lit(0).alias("k"), block.alias("y"), seen.alias("seen"), features("url", "host", "path", "_pages").alias("x")), 1)
    cut, _ = thresholds(scored.where("not seen"), PRECISION).get(0, (np.inf, np.inf))

    @F.pandas_udf("string")
    def verdict(url: pd.Series, host: pd.Series, path: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series(np.where(model.margin(lexical(url, host, path, pages)) >= cut, "block", "allow"))

    rows = rows.withColumn("_own", verdict("url", "host", "path", "_pages"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "_own").alias("verdict"))
