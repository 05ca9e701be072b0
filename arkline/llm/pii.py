r"""Personal data by candidate gradient boosting, in DataFrame and SQL operations only.

Base spans are exact formats with their checks.  Beside them, generators of high recall propose spans that may overlap: numbers
that look like a phone, a card or an address, and mail addresses that are spelled out.  Boosted trees of its kind rate each proposal by its
format and context.  They are fitted on the proposals of all documents, three quarters of them by a hash of the match; the last quarter sets the
thresholds.  Labels come from what a proposal's rating can't see or from evidence beside the base rules: one that meets a
base span of its kind is true, and what decides the base rule (a leading '+', '@' against a spelled-out one) is masked in its features; of the others,
those that meet a base span of another kind, fail a check or stand in a longer number, code or an order, item or serial number are
false, and phones and addresses behind a word such as "phone" or "mail" are true.  Proposals with no evidence aren't fitted, but
rated.  For each kind the lowest rating that keeps PRECISION on a part that the trees didn't see is the threshold: on proposals that meet no
base span, or, with fewer than LEAST true ones of them, with masked base spans beside them.  Proposals from there on that
meet no base span and aren't known to be false are added.

Spans of one kind are in order and don't meet each other, so those that meet a proposal are found by halving: a text with very many spans costs
no square of them.  Positions are found by putting a mark around each match and summing the lengths of the pieces between marks, in blocks, so that many
matches in one text cost no square.  The mark is U+0001; one in the text is read as U+0002, which no pattern holds.

Cases: a null text is empty: no spans.  Repeated rows each get their row.  An empty table gives no rows.  Other columns are
ignored by ``found`` and kept by ``redacted``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, learned, thresholds
from .common import keeping_columns

KINDS = ["email", "ip", "card", "phone"]
# The base formats.  Possessive repeats and looks behind give the same leftmost matches in linear time: a start inside a run
# that has failed from its first character fails too.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "contains(t, '@')", "ip": "contains(t, '.')", "card": "true", "phone": "contains(t, '+')"}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and cast(if(ltrim('0', p) = '', '0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": f"char_length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})",
    "phone": f"char_length({_DIGITS}) between 10 and 15",
}
#: The generators' patterns, and what a text needs for a match.
PROPOSALS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}+)++", "contains(t, '@') or contains(t, '(at)') or contains(t, '[at]')"),
    "ip": (r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}+", "contains(t, '.')"),
    "card": (r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{1,7}(?![0-9])", "true"),
    "phone": (r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "true"),
}
PRECISION = 0.98
#: True proposals that a threshold needs to do without base spans.
LEAST = 20
#: Pieces of a text whose lengths are summed together; even, so that matches stay the odd ones.
BLOCK = 256
_SPAN = "array<struct<s:bigint,e:bigint,m:string>>"
_AROUND = "array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>"


def _pieces(pattern: str, needs: str):
    marked = F.split(F.regexp_replace("t", pattern, "\x01$0\x01"), "\x01", -1)
    return F.when(F.expr(f"({needs})"), marked)


def _spans(column: str, around: bool = False) -> str:
    """SQL for the matches (s, e, m, and with ``around`` l and r: what stands beside) of a column of pieces."""
    kind = _AROUND if around else _SPAN
    at = lambda n: f"coalesce(get({column}, j + {n}), '')"
    beside = f""", 'l', right(concat({at(-3)}, {at(-2)}, {at(-1)}), 24), 'r', left(concat({at(1)}, {at(2)}, {at(3)}), 4)""" if around else ""
    moved = ", 'l', y.l, 'r', y.r" if around else ""
    inner = f"""aggregate(sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size({column})) - 1), struct(0L as at, cast(array() as {kind}) as got),
      (a, j) -> struct(a.at + char_length(get({column}, j)) as at, if(j % 2 = 1, concat(a.got, array(named_struct('s', a.at, 'e', a.at + char_length(get({column}, j)), 'm', get({column}, j){beside}))), a.got) as got))"""
    outer = f"""aggregate(transform(sequence(0, cast((size({column}) - 1) div {BLOCK} as int)), b -> {inner}), struct(0L as at, cast(array() as array<{kind}>) as got),
      (a, b) -> struct(a.at + b.at as at, concat(a.got, array(transform(b.got, y -> named_struct('s', y.s + a.at, 'e', y.e + a.at, 'm', y.m{moved})))) as got), a -> flatten(a.got))"""
    return f"if({column} is null or size({column}) < 2, cast(array() as {kind}), {outer})"


def _leading(array: str, holds: str) -> str:
    """SQL for how many elements of a sorted array come before the first for which ``holds`` (of x) is false: halving."""
    middle = "cast((a.lo + a.hi) div 2 as int)"
    test = holds.replace("x.", f"get({array}, {middle}).")
    return f"""if(size({array}) = 0, 0, aggregate(sequence(1, cast(ceil(log2(size({array}) + 1)) as int)), struct(0 as lo, size({array}) as hi),
      (a, i) -> if(a.lo >= a.hi, a, if({test}, struct({middle} + 1 as lo, a.hi as hi), struct(a.lo as lo, {middle} as hi))), a -> a.lo))"""


def _meets_any(array: str) -> str:
    """SQL for whether span c meets one of an array of spans that are in order and don't meet each other."""
    return f"exists(array({_leading(array, 'x.s < c.e')}), n -> n > 0 and get({array}, n - 1).e > c.s)"


def _based(docs: DataFrame) -> DataFrame:
    """``docs`` with t (the text) and _email to _phone: the base spans of each kind."""
    rows = docs.withColumn("t", F.replace(F.coalesce("text", F.lit("")), F.lit("\x01"), F.lit("\x02")))
    rows = rows.withColumns({f"_p{k}": _pieces(BASE[k], NEEDS[k]) for k in KINDS})
    rows = rows.withColumns({f"_{k}": F.expr(f"filter({_spans(f'_p{k}')}, x -> {CHECKS[k]})") for k in KINDS})
    return rows.drop(*[f"_p{k}" for k in KINDS])


#: What the trees see of a proposal c: its masked format n, and the characters around it.
FEATURES = {
    "kind": "c.k", "chars": "char_length(c.n)", "digits": "char_length(regexp_replace(c.n, '[^0-9]', ''))", "letters": "char_length(regexp_replace(c.n, '[^A-Za-z]', ''))",
    "blanks": "char_length(regexp_replace(c.n, '[^ ]', ''))", "dots": "char_length(regexp_replace(c.n, '[^.]', ''))", "hyphens": "char_length(regexp_replace(c.n, '[^-]', ''))",
    "brackets": "char_length(regexp_replace(c.n, '[^()\\\\[\\\\]]', ''))",
    "luhn": "if(luhn_check(regexp_replace(c.n, '[^0-9]', '')), 1, 0)", "part": "if(c.k = 1, array_max(transform(split(c.n, '[.]'), p -> coalesce(try_cast(p as int), 9999))), 0)",
    "left": "if(c.l rlike '[A-Za-z0-9]$', 2, if(c.l rlike ' $', 1, 0))", "right": "if(c.r rlike '^[A-Za-z0-9]', 2, if(c.r rlike '^[ .,]', 1, 0))",
    "word": "if(lower(c.l) rlike 'mail|phone|tel|call|fax|mobile|card|visa|account|host|addr|contact', 1, 0)",
}
#: What speaks against and for a proposal of each kind that meets no base span.
_NUMBER = "lower(c.l) rlike '(^|[^a-z])(order|invoice|item|part|serial|isbn|sku|ref|reference|ticket|case|account|card|id|no|nr|number)[^a-z0-9]*$'"
_INSIDE = "c.l rlike '[A-Za-z0-9_#/=$%-]$|[0-9][.]$' or c.r rlike '^[A-Za-z0-9_%/=]|^[.,-][0-9]'"
AGAINST = {
    "email": "not c.n rlike '[.][A-Za-z]{2,24}$' or c.n rlike '@-|-[.]|[.]-|^[.]|[.]@'",
    "ip": "exists(split(c.n, '[.]'), p -> cast(p as int) > 255)",
    "card": "not (char_length(regexp_replace(c.n, '[^0-9]', '')) between 14 and 19 and luhn_check(regexp_replace(c.n, '[^0-9]', '')))",
    "phone": f"{_INSIDE} or {_NUMBER} and not lower(c.l) rlike 'phone|fax|mobile|cell'",
}
FOR = {"email": "lower(c.l) rlike 'mail|contact|addr|write'", "ip": "false", "card": "false", "phone": "lower(c.l) rlike '(^|[^a-z])(phone|telephone|tel|call|fax|mobile|cell)([^a-z]|$)'"}


def _of_kind(each: dict[str, str]) -> str:
    return "(case c.k " + " ".join(f"when {i} then {each[k]}" for i, k in enumerate(KINDS)) + " end)"


#: A match without what decides the base rule: spelled-out signs as signs, no leading plus.
_MASKED = {
    "email": r"regexp_replace(regexp_replace(x.m, '\\x20?[(\\[]at[)\\]]\\x20?', '@'), '\\x20?[(\\[]dot[)\\]]\\x20?', '.')", "ip": "x.m", "card": "x.m", "phone": "ltrim('+', x.m)",
}


def _proposed(rows: DataFrame) -> DataFrame:
    """``_based`` rows with _c: the proposals (k, s, e, m, n, l, r); n is m masked."""
    rows = rows.withColumns({f"_q{k}": _pieces(*PROPOSALS[k]) for k in KINDS})
    each = []
    for i, k in enumerate(KINDS):
        each.append(f"""transform({_spans(f"_q{k}", True)}, x -> named_struct('k', {i}, 's', x.s, 'e', x.e, 'm', x.m, 'n', {_MASKED[k]}, 'l', x.l, 'r', x.r))""")
    return rows.withColumn("_c", F.expr(f"concat({', '.join(each)})")).drop(*[f"_q{k}" for k in KINDS])


def fitted(docs: DataFrame) -> tuple[list[Boosted], list[float]]:
    """The trees and the threshold of each kind, from the proposals of all rows."""
    rows = _proposed(_based(docs.select("text")))
    own = _of_kind({k: _meets_any(f"_{k}") for k in KINDS})
    other = " or ".join(_meets_any(f"_{k}") for k in KINDS)
    label = f"case when {own} then 1 when {other} or {_of_kind(AGAINST)} then 0 when {_of_kind(FOR)} then 1 end"
    # labelled within the array: exploded rows would each carry all spans of their text
    x = ", ".join(f"cast({f} as double)" for f in FEATURES.values())
    each = f"transform(_c, c -> named_struct('k', c.k, 'y', {label}, 'based', {other}, 'seen', pmod(xxhash64(c.m), 4) <> 0, 'x', array({x})))"
    # outer: else a filter on the array is inferred, which makes the proposals a second time
    spans = rows.select(F.expr(each).alias("c")).select(F.inline_outer("c")).where("y is not null")
    models, scored = learned(spans, len(KINDS))
    rest = scored.where("not seen")
    # true proposals that meet no base span, by kind
    true = dict(rest.where("not based").groupBy("k").agg(F.sum(F.col("w") * F.col("y"))).collect())
    alone = [k for k, n in true.items() if n >= LEAST]
    found = thresholds(rest.where(~F.col("based") | ~F.col("k").isin(alone)), PRECISION)
    return models, [_cut(*found.get(k, (np.inf, -np.inf))) for k in range(len(KINDS))]


def _cut(cut: float, least: float) -> float:
    """The threshold of one kind; ``least`` is the lowest rating that it was set on."""
    # where all of them keep it, nothing is known against ratings below: as far as the trees themselves are as sure
    return min(cut, float(np.log(PRECISION / (1 - PRECISION)))) if cut == least else cut


def spanned(docs: DataFrame) -> DataFrame:
    """``docs`` with _base and _spans: arrays of (s, k, e), sorted by s, then kind."""
    models, cuts = fitted(docs)
    rows = _based(docs)
    bases = ", ".join(f"transform(_{k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(KINDS))
    if not any(map(np.isfinite, cuts)):
        rows = rows.withColumn("_base", F.expr(f"sort_array(concat({bases}))"))
        return rows.withColumn("_spans", F.col("_base"))
    rows = _proposed(rows).withColumn("_base", F.expr(f"sort_array(concat({bases}))"))
    # proposals that meet a base span, or are known to be false, needn't be rated
    rows = rows.withColumn("_c", F.expr(f"filter(_c, c -> not ({' or '.join(_meets_any(f'_{k}') for k in KINDS)}) and not {_of_kind(AGAINST)})"))
    fields = ", ".join(f"'{n}', cast({f} as double)" for n, f in FEATURES.items())
    rated = f"transform(_c, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'f', named_struct({fields})))"
    rows = rows.withColumn("_c", F.expr(f"if(size(_c) = 0, null, {rated})"))
    names = [f"c.f.{n}" for n in FEATURES]
    margin = _of_kind({k: m.sql(names) for k, m in zip(KINDS, models, strict=True)})
    rows = rows.withColumn("_c", F.expr(f"transform(_c, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'm', {margin}))"))
    cut = "case c.k " + " ".join(f"when {i} then {'true' if c == -np.inf else f'c.m >= {c!r}D' if np.isfinite(c) else 'false'}" for i, c in enumerate(map(float, cuts))) + " end"
    rows = rows.withColumn("_c", F.expr(f"coalesce(filter(_c, c -> {cut}), array())"))
    # of proposals that meet, the one rated highest stays (then the first); those of one kind are in order and don't meet each other
    rows = rows.withColumns({f"_c{k}": F.expr(f"filter(_c, d -> d.k = {i})") for i, k in enumerate(KINDS)})
    near = lambda a: f"exists(array(struct({_leading(a, 'x.e <= c.s')} as i, {_leading(a, 'x.s < c.e')} as j)), n -> n.j > n.i and exists(transform(sequence(n.i, n.j - 1), i -> get({a}, i)), d -> d.m > c.m or d.m = c.m and (d.s < c.s or d.s = c.s and d.k < c.k)))"
    best = f"filter(_c, c -> not ({' or '.join(near(f'_c{k}') for k in KINDS)}))"
    return rows.withColumn("_spans", F.expr(f"sort_array(concat(_base, transform({best}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))))"))


def _text_of(column: str) -> str:
    name = "case x.k " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
    return f"array_join(transform({column}, x -> concat({name}, ':', x.s, ':', x.e)), ',')"


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row."""
    rows = spanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(F.expr(_text_of("_base")).cast("binary"), 256).alias("base_sha256"), F.expr(_text_of("_spans")).alias("spans"))


@keeping_columns
def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each selected span replaced by its kind in angle brackets."""
    rows = spanned(docs)
    name = "case x.k " + " ".join(f"when {i} then '<{k}>'" for i, k in enumerate(KINDS)) + " end"
    # spans that meet are replaced once, by the first
    cut = f"""aggregate(_spans, struct(0L as at, '' as got), (a, x) -> if(x.s < a.at, struct(greatest(a.at, x.e) as at, a.got as got),
      struct(x.e as at, concat(a.got, substring(text, cast(a.at as int) + 1, cast(x.s - a.at as int)), {name}) as got)), a -> concat(a.got, substring(text, cast(a.at as int) + 1)))"""
    return rows.withColumn("text", F.expr(f"if(size(_spans) = 0, text, {cut})")).select(*docs.columns)
