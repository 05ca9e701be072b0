"""Gradient-boosted trees, fitted on arrays or on all rows of a table, and the same trees as a SQL expression.

Features are cut at quantiles; each tree takes the splits of highest gain in the logistic loss.  ``boosted`` fits arrays in numpy.
``learned`` fits the same trees on every row of a table, of any size: quantiles are exact, from sorted ranges; equal rows of bins are counted once, and for each
level of a tree the sums of gradients by node, feature and bin are aggregated where the rows lie, so the driver gets at most kinds x nodes x features
x BINS of them.  ``Boosted.sql`` gives the margin as nested CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged

BINS = 32
#: Gradients are summed as whole multiples of 1 / UNIT, so that sums don't depend on the order of rows.
UNIT = 1 << 24
#: Different rows of bins that the driver sums itself.
CELLS = 1 << 17
#: Ranges over which the sorted values of a key are dealt.
RANGES = 64


@dataclass
class Boosted:
    base: float = 0.0
    #: Trees as nested (feature, cut, tree if <=, tree if >) or a leaf's value.
    trees: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)

        def walk(tree, rows: np.ndarray) -> None:
            if not isinstance(tree, tuple):
                out[rows] += tree
                return
            low = x[rows, tree[0]] <= tree[1]
            walk(tree[2], rows[low])
            walk(tree[3], rows[~low])

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def sql(self, names: list[str]) -> str:
        """The margin over columns or fields ``names``."""

        def text(tree) -> str:
            if not isinstance(tree, tuple):
                return repr(float(tree)) + "D"
            return f"CASE WHEN {names[tree[0]]} <= {float(tree[1])!r}D THEN {text(tree[2])} ELSE {text(tree[3])} END"

        return " + ".join([repr(float(self.base)) + "D", *map(text, self.trees)])


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 5) -> Boosted:
    """Trees for labels y (0 or 1); with one label only, a constant."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.array([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)])
    margin = np.full(len(y), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(len(cuts) if left else 0):
            b = binned[f, rows]
            n = len(cuts[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g[rows], h[rows], None))
            gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            value = -rate * total_g / (total_h + ridge)
            margin[rows] += value
            return float(value)
        f, k = best[1]
        low = binned[f, rows] <= k
        return (f, float(cuts[f][k]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        model.trees.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), depth))
    return model


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which at least ``precision`` of the rows have label 1; above all scores if there is none."""
    if not len(score):
        return np.inf
    order = np.argsort(-score, kind="stable")
    s, good = score[order], np.cumsum(y[order])
    share = good / np.arange(1, len(s) + 1)
    last = np.append(s[1:] != s[:-1], True)  # equal scores stand or fall together
    ok = np.flatnonzero(last & (share >= precision))
    return float(s[ok[-1]]) if len(ok) else np.inf


def _by_kind(each: dict[int, str], other: str) -> str:
    return "(case k " + " ".join(f"when {k} then {text}" for k, text in each.items()) + f" else {other} end)" if each else f"({other})"


def _on_bins(expression: str) -> str:
    """``expression`` of a row's bins v within a lambda: it is evaluated as it stands, without new code to compile for each tree."""
    return f"get(transform(array(b), v -> {expression}), 0)"


def _cut_bins(tree, cuts: list[list[float]]):
    """A tree on bins as one on values."""
    return (tree[0], cuts[tree[0]][tree[1]], _cut_bins(tree[2], cuts), _cut_bins(tree[3], cuts)) if isinstance(tree, tuple) else tree


def _running(values: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """``values`` (different ``order`` for each ``by``, staged) with the running totals of ``sums``, exact.

    Each key's rows are dealt over RANGES ranges and sorted in them, so that no key lands in one task; the bounds of the ranges are approximate
    quantiles, which decide where a row is sorted and nothing else.  They are written, so that all reads see the same."""
    points = [i / RANGES for i in range(1, RANGES)]
    ends = staged(values.groupBy(*by).agg(F.percentile_approx(order, points, 1000).alias("_ends")), "ends")
    dealt = values.join(F.broadcast(ends), by).withColumn("_range", F.expr(f"size(filter(_ends, e -> e < {order}))")).drop("_ends")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({f"to_{c}": F.sum(c).over(inside) for c in sums}).join(F.broadcast(totals), [*by, "_range"])
    return dealt.withColumns({f"to_{c}": F.col(f"to_{c}") + F.col(f"_{c}") for c in sums})


def _split(sums: np.ndarray, total: np.ndarray, ridge: float, least: int) -> tuple[int, int, np.ndarray] | None:
    """Feature, last bin below and the sums below of the best split; ``sums`` are g, h and n by feature and bin."""
    low = np.cumsum(sums, 2)[:, :, :-1]
    high = total[:, None, None] - low
    gain = low[0] ** 2 / (low[1] + ridge) + high[0] ** 2 / (high[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
    gain[(low[2] < least) | (high[2] < least)] = 0
    f, k = np.unravel_index(gain.argmax(), gain.shape)
    return (int(f), int(k), low[:, f, k]) if gain[f, k] > 1e-6 else None


def _margin(models: list[Boosted], width: int) -> str:
    return _by_kind({k: m.sql([f"v[{f}]" for f in range(width)]) for k, m in enumerate(models)}, "0D")


def _sums_of_table(fit: DataFrame, models: list[Boosted], width: int):
    """A function from the open nodes of each kind's tree (a tree with nodes' numbers, or -1, as leaves) to their g, h and n by feature
    and bin, aggregated where the rows lie."""

    def text(tree) -> str:
        return f"CASE WHEN v[{tree[0]}] <= {tree[1]} THEN {text(tree[2])} ELSE {text(tree[3])} END" if isinstance(tree, tuple) else str(tree)

    def sums(opened: dict[int, object]) -> dict[tuple[int, int], np.ndarray]:
        of = _on_bins(f"named_struct('m', {_margin(models, width)}, 'at', {_by_kind({k: text(t) for k, t in opened.items()}, '-1')})")
        at = fit.selectExpr("k", "y", "w", "b", f"{of} as s").where("s.at >= 0").selectExpr("k", "s.at as at", "y", "w", "b", "1 / (1 + exp(-s.m)) as p")
        at = at.selectExpr("k", "at", "b", f"w * cast(round((p - y) * {UNIT}) as bigint) as g", f"w * cast(round(greatest(p * (1 - p), 1e-6D) * {UNIT}) as bigint) as h", "w")
        out: dict[tuple[int, int], np.ndarray] = {}
        for k, i, f, bin_, *got in at.selectExpr("k", "at", "posexplode(b) as (f, bin)", "g", "h", "w").groupBy("k", "at", "f", "bin").agg(F.sum("g"), F.sum("h"), F.sum("w")).collect():
            out.setdefault((k, i), np.zeros((3, width, BINS), np.int64))[:, f, bin_] = got
        return out

    return sums


def _sums_of_arrays(fit: DataFrame, models: list[Boosted], width: int):
    """The same sums of the same rows, of which there are few different ones, on the driver."""
    got = fit.toArrow()
    k, y, w = (got.column(c).to_numpy().astype(np.int64) for c in ("k", "y", "w"))
    bins = got.column("b").combine_chunks().flatten().to_numpy().reshape(len(k), width)
    rows = {int(i): np.flatnonzero(k == i) for i in np.unique(k)}
    margin = {i: np.full(len(r), models[i].base) for i, r in rows.items()}
    done = dict.fromkeys(rows, 0)

    def sums(opened: dict[int, object]) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for i, tree in opened.items():
            r = rows[i]
            for last in models[i].trees[done[i] :]:
                margin[i] += Boosted(0.0, [last]).margin(bins[r])
            done[i] = len(models[i].trees)
            p = 1 / (1 + np.exp(-margin[i]))
            each = np.array([np.rint((p - y[r]) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT), np.ones(len(r))]).astype(np.int64) * w[r]
            at = Boosted(0.0, [tree]).margin(bins[r])
            for node in np.unique(at[at >= 0]):
                inside = at == node
                found = out[i, int(node)] = np.zeros((3, width, BINS), np.int64)
                for f in range(width):
                    for total, part in zip(found, each, strict=True):
                        np.add.at(total[f], bins[r[inside], f], part[inside])
        return out

    return sums


def learned(rows: DataFrame, kinds: int, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 5, most: int = CELLS) -> tuple[list[Boosted], DataFrame]:
    """The trees of each kind from all rows with ``seen``, and all rows, equal ones counted (w), with their margin m in place of x.

    ``rows`` have k (the kind, from 0), y (0 or 1), seen, x (an array of doubles) and any other columns.  Up to ``most`` different rows of bins
    are sent to the driver and summed there; of more, each level of a tree is summed by an aggregation.  Both are the same sums of all rows."""
    others = [c for c in rows.columns if c not in ("k", "y", "seen", "x")]
    cells = staged(rows.groupBy(*rows.columns).agg(F.count("*").alias("w")), "cells")
    counts = np.zeros((kinds, 2))
    for k, y, n in cells.where("seen").groupBy("k", "y").agg(F.sum("w")).collect():
        counts[k, y] = n
    n = counts.sum(1)
    share = np.clip(np.where(n > 0, counts[:, 1] / np.maximum(1, n), 0.5), 1e-3, 1 - 1e-3)
    models = [Boosted(float(b)) for b in np.log(share / (1 - share))]
    live = [k for k in range(kinds) if counts[k].min() > 0]  # the others have one label only: a constant

    # the values at the ranks that are quantiles
    values = cells.where("seen").where(F.col("k").isin(live)).selectExpr("k", "w", "posexplode(x) as (f, v)").groupBy("k", "f", "v").agg(F.sum("w").alias("w"))
    values = _running(staged(values, "values"), ["k", "f"], "v", ["w"]) if live else values
    rank = f"cast(j * ({_by_kind({k: f'{int(n[k])}L' for k in live}, '1L')} - 1) div {BINS} as bigint)"
    cuts: dict[int, dict[int, list[float]]] = {k: {} for k in live}
    for k, f, v in values.where(f"exists(sequence(1, {BINS - 1}), j -> {rank} < to_w and {rank} >= to_w - w)").select("k", "f", "v").orderBy("k", "f", "v").collect() if live else ():
        cuts[k].setdefault(f, []).append(v)
    width = max((len(c) for c in cuts.values()), default=0)
    table = {k: "array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in cuts[k][f]) + ")" for f in range(width)) + ")" for k in live}
    bins = f"transform(x, (v, f) -> cast(size(filter(get({_by_kind(table, 'null')}, f), c -> c < v)) as int))" if live else "cast(array() as array<int>)"
    bins = f"if({_by_kind({k: 'true' for k in live}, 'false')}, {bins}, cast(array() as array<int>))"
    whole = cells
    cells = staged(cells.withColumn("b", F.expr(bins)).groupBy("k", "y", "seen", *others, "b").agg(F.sum("w").alias("w")), "bins")
    drop_staged(whole)

    fit = cells.where("seen").where(F.col("k").isin(live)).select("k", "y", "w", "b")
    sums = (_sums_of_arrays if live and fit.count() <= most else _sums_of_table)(fit, models, width)
    for _ in range(rounds if live else 0):
        # the nodes of a kind's tree: (feature, bin, node if <=, node if >) or a leaf's value; open ones are None
        trees: dict[int, list] = {k: [None] for k in live}

        def built(k: int, leaf, i: int = 0):
            t = trees[k][i]  # noqa: B023
            return (t[0], t[1], built(k, leaf, t[2]), built(k, leaf, t[3])) if isinstance(t, tuple) else leaf(i, t)  # noqa: B023

        for level in range(depth):
            opened = {k: built(k, lambda i, t: i if t is None else -1) for k in live if None in trees[k]}
            for (k, i), got in sums(opened).items() if opened else ():
                got = got / np.array([UNIT, UNIT, 1])[:, None, None]
                total = got[:, 0].sum(1)
                best = _split(got, total, ridge, least)
                if best is None:
                    trees[k][i] = float(-rate * total[0] / (total[1] + ridge))
                    continue
                trees[k][i] = (best[0], best[1], len(trees[k]), len(trees[k]) + 1)
                for part in (best[2], total - best[2]):
                    # too few rows for a split, or the last level: a leaf
                    trees[k].append(float(-rate * part[0] / (part[1] + ridge)) if level == depth - 1 or part[2] < 2 * least else None)
        for k in live:
            models[k].trees.append(built(k, lambda i, t: t))
    scored = cells.select("k", "y", "seen", *others, "w", F.expr(_on_bins(_margin(models, width))).alias("m"))
    return [Boosted(m.base, [_cut_bins(t, [cuts[k][f] for f in range(width)]) for t in m.trees]) if k in cuts else m for k, m in enumerate(models)], scored


def thresholds(scored: DataFrame, precision: float) -> dict[int, tuple[float, float]]:
    """``threshold`` of each kind from all rows (k, y, w, m) of a table, and the least margin."""
    each = scored.groupBy("k", F.negative("m").alias("down")).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("good"))
    each = _running(staged(each, "margins"), ["k"], "down", ["n", "good"])
    ok = F.col("to_good") / F.col("to_n") >= precision
    got = each.groupBy("k").agg(F.max(F.when(ok, F.col("down"))), F.max("down")).collect()
    return {k: (np.inf if cut is None else -cut, -least) for k, cut, least in got}
