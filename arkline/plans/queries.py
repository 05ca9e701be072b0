"""Each query applies an operator of this library to a whole table; ``SQL`` has the same for DuckDB.

The given tables hold no archives, so each operator runs on the table that is most like its own: pages stand for files (url: path, html:
content), documents for entries, events and orders for outcomes and plans, part and supplier for catalogs.  The queries ``source_*`` read archives
that are made of documents."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, markup, paths
from ..operators import classify, detect, entries, plan, semantic, support, verify
from ..sources import tables as scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: the path of a url without query and fragment."""
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    return table(spark, d, "pages").select(F.col("page_id").alias("entry_id"), path.alias("path"), "url", "html")


_FILES = "SELECT page_id AS entry_id, regexp_extract(url, '://([^?#]*)', 1) AS path, url, html FROM pages"
_EXT = r"lower(regexp_extract(path, '\.([^.]*)$', 1))"


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_TYPE = "CASE " + " ".join(f"WHEN {_EXT} IN ({_quoted(n)}) THEN '{k}'" for k, n in entries.EXTENSIONS.items()) + " ELSE 'unknown' END"


@query(f"SELECT entry_id, path, {_TYPE} AS resource_type, strlen(html) AS size FROM ({_FILES}) WHERE regexp_matches(lower(path), '{paths.globs_regex(['**/en/**', '**/*.html'])}') ORDER BY path, entry_id LIMIT 100")
def entry_page(spark: SparkSession, d: str) -> DataFrame:
    """Scan, classify, filter by glob, page."""
    files = entries.filtered(_files(spark, d), include=["**/en/**", "**/*.html"])
    rows = files.select("entry_id", "path", entries.type_of(paths.last_dot_extension(F.col("path"))).alias("resource_type"), F.octet_length("html").cast("long").alias("size"))
    return entries.offset_page(rows, ["path", "entry_id"], 0, 100)


@query(f"SELECT entry_id, path FROM ({_FILES}) WHERE regexp_matches(lower(path), '{paths.globs_regex(['**/*.html', '*.net/{de,fr}/**'])}')")
def entry_glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return entries.filtered(_files(spark, d), include=["**/*.html", "*.net/{de,fr}/**"]).select("entry_id", "path")


@query(f"SELECT entry_id, path FROM ({_FILES}) WHERE regexp_matches(lower(path), '{paths.globs_regex(['**/en/*'])}') AND NOT regexp_matches(lower(path), '{paths.globs_regex(['www.*/**', '**/[0-4]*'])}')")
def entry_exclude_glob(spark: SparkSession, d: str) -> DataFrame:
    return entries.filtered(_files(spark, d), include=["**/en/*"], exclude=["www.*/**", "**/[0-4]*"]).select("entry_id", "path")


@query(f"SELECT resource_type, count(*) AS n FROM (SELECT {_TYPE.replace('path', 'p')} AS resource_type FROM (SELECT path || ['.png', '.OGG', '/.tjs', '.bin', ''][entry_id % 5 + 1] AS p FROM ({_FILES}))) GROUP BY 1")
def entry_type_classify(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, [".png", ".OGG", "/.tjs", ".bin", ""])), (F.col("entry_id") % 5 + 1).cast("int"))
    kind = entries.type_of(paths.last_dot_extension(F.concat("path", ending)))
    return _files(spark, d).groupBy(kind.alias("resource_type")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS entry_count, count(*) FILTER (n_chars > 2000) AS compressed_count, count(*) FILTER (lang = 'fr') AS encrypted_count, count(*) FILTER (source = 'src3') AS unknown_size_count FROM documents")
def entry_summary(spark: SparkSession, d: str) -> DataFrame:
    return entries.summary(table(spark, d, "documents"), F.col("n_chars") > 2000, F.col("lang") == "fr", F.col("source") != "src3")


@query("SELECT count(*) AS archive_total, count(*) FILTER (lang = 'de' AND n_chars > 500) AS matched_total FROM documents")
def entry_matched_total(spark: SparkSession, d: str) -> DataFrame:
    return entries.totals(table(spark, d, "documents"), (F.col("lang") == "de") & (F.col("n_chars") > 500))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def entry_offset_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars").withColumn("_o", -F.col("n_chars"))
    return entries.offset_page(rows, ["_o", "doc_id"], 100, 50).drop("_o")


@query("SELECT page_id, url FROM pages WHERE url > 'https://blog.' ORDER BY url, page_id LIMIT 200")
def scan_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return entries.keyset_page(table(spark, d, "pages").select("page_id", "url"), "url", paths.cursor_of("https://blog."), 200, ["page_id"])


@query("SELECT CASE WHEN event_type = 'purchase' THEN 'archive' WHEN value IS NULL OR value < 10 THEN 'failure' ELSE 'unrecognized' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def scan_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "archive").when(F.col("value").isNull() | (F.col("value") < 10), "failure").otherwise("unrecognized")
    return detect.outcome_counts(table(spark, d, "events"), outcome)


SIGNATURES = [("the", 0, "The "), ("the", 0, "the "), ("and", 0, "And "), ("an", 0, "An"), ("in", 4, "in"), ("th", 3, "th"), ("e", 1, "e")]
_SIGS = ", ".join(f"('{f}', {o}, '{s}')" for f, o, s in SIGNATURES)


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return detect.signature_matches(table(spark, d, "documents").select("doc_id", "text"), "text", SIGNATURES, ["doc_id"])


@query(f"SELECT DISTINCT doc_id, format_id FROM documents, (VALUES {_SIGS}) s(format_id, o, sig) WHERE substr(text, o + 1, length(sig)) = sig")
def signature_theta_join(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d)


# Stub formats: (format_id, reg_order, extensions, priority, ext_fallback, ext_only, has_signatures)
FORMATS = [("the", 1, ["en"], 0, True, False, True), ("and", 2, ["fr"], 5, False, False, True), ("an", 3, ["en", "de"], 5, True, True, True), ("in", 4, [], 1, False, False, True), ("th", 5, ["es"], 1, True, False, True), ("e", 6, [], 0, False, False, True), ("plain", 7, ["de"], -1, False, False, False), ("any", 8, [], -2, False, False, False)]
_FORMATS = ", ".join(f"('{f}', {r}, {e!r}::VARCHAR[], {p}, {fb}, {eo}, {hs})" for f, r, e, p, fb, eo, hs in FORMATS)


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format_id string, reg_order int, extensions array<string>, priority int, ext_fallback boolean, ext_only boolean, has_signatures boolean")


_CANDIDATES = f"""c AS (SELECT doc_id, f.*, EXISTS (SELECT 1 FROM (VALUES {_SIGS}) s(sf, o, sig) WHERE sf = f.format_id AND substr(text, o + 1, length(sig)) = sig) AS sig_match, list_contains(exts, lang) AS ext_match
  FROM documents, (VALUES {_FORMATS}) f(format_id, reg_order, exts, priority, fb, eo, hs)),
g AS (SELECT * FROM c WHERE (CASE WHEN hs THEN sig_match OR fb ELSE ext_match OR len(exts) = 0 END) AND (NOT eo OR ext_match))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return detect.candidates(docs, "doc_id", "lang", _signed(spark, d), formats(spark))


@query(f"WITH {_CANDIDATES} SELECT doc_id, format_id, sig_match, ext_match FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sig_match DESC, ext_match DESC, priority DESC, reg_order) = 1")
def candidate_rank_top1(spark: SparkSession, d: str) -> DataFrame:
    return detect.best(_candidates(spark, d), "doc_id").select("doc_id", "format_id", "sig_match", "ext_match")


@query(f"WITH {_CANDIDATES} SELECT doc_id, format_id, row_number() OVER (PARTITION BY doc_id ORDER BY sig_match DESC, ext_match DESC, priority DESC, reg_order)::INT AS rank FROM g")
def candidate_ranks(spark: SparkSession, d: str) -> DataFrame:
    return detect.ranked(_candidates(spark, d), "doc_id").select("doc_id", "format_id", "rank")


@query(f"""WITH {_CANDIDATES}, b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sig_match DESC, ext_match DESC, priority DESC, reg_order) = 1)
SELECT doc_id, CASE WHEN sig_match THEN 'high' WHEN ext_match THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN NOT sig_match AND ext_match AND hs THEN 'extension only' WHEN NOT sig_match AND NOT ext_match THEN 'neither signature nor extension' END AS warning FROM b""")
def confidence_case(spark: SparkSession, d: str) -> DataFrame:
    return detect.best(_candidates(spark, d), "doc_id").select("doc_id", detect.confidence().alias("confidence"), detect.warning().alias("warning"))


@query(f"""SELECT entry_id, ext, CASE WHEN ext = '' THEN 'unknown-format' WHEN names IS NOT NULL THEN 'registered-extension-no-match' ELSE 'no-registered-format' END AS kind, coalesce(names, '') AS candidates
FROM (SELECT entry_id, [{_quoted(['en', 'de', '', 'xyz', 'es'])}][entry_id % 5 + 1] AS ext FROM ({_FILES})) LEFT JOIN
(SELECT e, string_agg(format_id, ',' ORDER BY reg_order) AS names FROM (SELECT unnest(exts) AS e, format_id, reg_order FROM (VALUES {_FORMATS}) f(format_id, reg_order, exts, priority, fb, eo, hs)) GROUP BY e) ON e = ext""")
def diagnose_unrecognized(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ["en", "de", "", "xyz", "es"])), (F.col("entry_id") % 5 + 1).cast("int"))
    out = detect.diagnosis(_files(spark, d).select("entry_id", ext.alias("ext")), "ext", formats(spark))
    return out.select("entry_id", "ext", "kind", F.coalesce(F.array_join("candidates", ","), F.lit("")).alias("candidates"))


@query("SELECT i.doc_id, position, source, d.doc_id IS NOT NULL AS found FROM (SELECT doc_id, min(position) AS position FROM (SELECT o_orderkey % 5000 AS doc_id, o_orderkey AS position FROM orders) GROUP BY 1) i LEFT JOIN documents d ON d.doc_id = i.doc_id")
def ids_left_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select((F.col("o_orderkey") % 5000).alias("doc_id"), F.col("o_orderkey").alias("position"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.lit(True).alias("found"))
    return entries.selected_ids(docs, ids, "doc_id").select("doc_id", "position", "source", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"SELECT * FROM (SELECT entry_id, split_part(lower(path), '/', 1) AS destination, count(*) OVER (PARTITION BY split_part(lower(path), '/', 1)) AS n_same FROM ({_FILES})) WHERE n_same > 1")
def duplicate_destinations(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).select("entry_id", F.substring_index(F.lower("path"), "/", 1).alias("destination"))
    return plan.duplicate_destinations(files, "destination", ["entry_id"])


_PLAN = "SELECT CASE l_returnflag WHEN 'N' THEN 'ready' WHEN 'R' THEN 'skipped' ELSE 'failed' END AS status, CAST(l_quantity AS BIGINT) AS packed, CASE WHEN l_linenumber < 7 THEN CAST(l_quantity * 3 AS BIGINT) END AS size, l_suppkey AS source FROM lineitem"


def _plan(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "ready").when(F.col("l_returnflag") == "R", "skipped").otherwise("failed")
    size = F.when(F.col("l_linenumber") < 7, (F.col("l_quantity") * 3).cast("long"))
    return table(spark, d, "lineitem").select(status.alias("status"), F.col("l_quantity").cast("long").alias("packed"), size.alias("size"), F.col("l_suppkey").alias("source"))


_TOTALS = "count(*) FILTER (status = 'ready') AS ready_count, count(*) FILTER (status = 'skipped') AS skipped_count, count(*) FILTER (status = 'failed') AS failed_count, coalesce(sum(packed) FILTER (status = 'ready'), 0)::BIGINT AS packed_bytes, count(*) FILTER (status = 'ready' AND size IS NULL) AS unknown_count, CASE WHEN count(*) FILTER (status = 'ready' AND size IS NULL) = 0 THEN coalesce(sum(size) FILTER (status = 'ready'), 0)::BIGINT END AS output_bytes"


@query(f"SELECT {_TOTALS} FROM ({_PLAN})")
def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    return plan.totals(_plan(spark, d), F.col("status"), F.col("packed"), F.col("size"))


def _shown(broken: DataFrame) -> DataFrame:
    """Violations with the word unknown for what isn't known."""
    return broken.withColumn("actual", F.coalesce(F.col("actual").cast("string"), F.lit("unknown")))


_LIMITS = {"maxResources": ("ready_count", 1000), "maxPackedBytes": ("packed_bytes", 1 << 40), "maxOutputBytes": ("output_bytes", 1 << 20), "maxUnknown": ("unknown_count", 10)}


@query(f"WITH t AS (SELECT {_TOTALS} FROM ({_PLAN})), c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS budget, {n}::BIGINT AS allowed, {c}::BIGINT AS actual FROM t" for k, (c, n) in _LIMITS.items()) + ") SELECT budget, allowed, coalesce(actual::VARCHAR, 'unknown') AS actual FROM c WHERE actual IS NULL OR actual > allowed")
def budget_violations(spark: SparkSession, d: str) -> DataFrame:
    return _shown(plan.violations(plan_totals(spark, d), _LIMITS))


_VERIFY = """SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS actual, CASE WHEN doc_id % 6 = 0 THEN upper(sha256(text)) WHEN doc_id % 3 = 0 THEN sha256(text) WHEN doc_id % 3 = 1 THEN sha256(text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '!' END) END AS wanted,
 CASE WHEN doc_id % 7 = 0 THEN n_chars <> 7 END AS valid FROM documents"""
_STATUS = "CASE WHEN valid = FALSE THEN 'invalid' WHEN wanted IS NOT NULL AND NOT coalesce(lower(wanted) = actual, FALSE) THEN 'mismatch' WHEN wanted IS NOT NULL OR valid THEN 'verified' ELSE 'inspected' END"


def _verified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    changed = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "").otherwise("!"))
    wanted = F.when(F.col("doc_id") % 6 == 0, F.upper(hashing.sha256(F.col("text")))).when(F.col("doc_id") % 3 == 0, hashing.sha256(F.col("text"))).when(F.col("doc_id") % 3 == 1, hashing.sha256(changed))
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 11 != 0, hashing.sha256(F.col("text"))).alias("actual"), wanted.alias("wanted"), F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") != 7).alias("valid"))
    none = F.lit(None).cast("long")
    return rows.withColumn("status", verify.status(F.col("valid"), verify.matched(F.col("actual"), none, F.col("wanted"), none)))


@query(f"SELECT doc_id, {_STATUS} AS status, CASE WHEN wanted IS NOT NULL THEN 'manifest' WHEN valid THEN 'structural' ELSE 'hash' END AS level FROM ({_VERIFY})")
def verify_status(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).select("doc_id", "status", verify.level(F.col("wanted"), F.col("valid")).alias("level"))


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM ({_VERIFY}) GROUP BY 1")
def verify_rollup(spark: SparkSession, d: str) -> DataFrame:
    return verify.rollup(_verified(spark, d), F.col("status"))


@query(f"SELECT source, CASE WHEN f = 0 THEN 'completed' WHEN r > 0 OR s > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT source, count(*) FILTER (status = 'ready') AS r, count(*) FILTER (status = 'skipped') AS s, count(*) FILTER (status = 'failed') AS f FROM ({_PLAN}) GROUP BY source)")
def status_fold(spark: SparkSession, d: str) -> DataFrame:
    n = _plan(spark, d).groupBy("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "skipped", "failed")])
    return n.select("source", plan.fold(F.col("ready"), F.col("skipped"), F.col("failed")).alias("status"))


@query("""WITH a AS (SELECT l_suppkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_suppkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT k, n, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT k, n, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def manifest_except(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") % 2).alias("h"))
    return verify.manifest_difference(rows.where("h = 0").drop("h"), rows.where("h = 1").drop("h"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(text), 'thering')")
def semantic_node_filter(spark: SparkSession, d: str) -> DataFrame:
    return semantic.node_filter(table(spark, d, "documents"), F.col("lang") == "en", " THERING ", "text").select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND contains(lower(p_name), 'ring')) OR EXISTS (SELECT 1 FROM part WHERE p_partkey = l_suppkey AND contains(lower(p_name), 'ring'))")
def semantic_relation_semi(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.withColumn("id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    nodes = semantic.node_filter(table(spark, d, "part"), None, "ring", "p_name")
    return semantic.touching(lines, "id", ["l_partkey", "l_suppkey"], nodes, "p_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT o_orderkey, e AS evidence_id FROM (SELECT o_orderkey, unnest([o_custkey, o_orderkey % 977, o_orderkey // 3]) AS e FROM orders) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = e)")
def semantic_missing_evidence(spark: SparkSession, d: str) -> DataFrame:
    cited = F.array("o_custkey", F.col("o_orderkey") % 977, F.floor(F.col("o_orderkey") / 3))
    return semantic.missing_evidence(table(spark, d, "orders"), "o_orderkey", cited, table(spark, d, "customer"), "c_custkey")


_RELATION = "CASE WHEN value < 20 THEN 'verified' WHEN value < 40 THEN 'candidate' WHEN value < 60 THEN 'rejected' ELSE 'unresolved' END"


@query(f"SELECT s AS status, count(r) AS n FROM (SELECT unnest([{_quoted(semantic.RELATION_STATUSES)}]) AS s) LEFT JOIN (SELECT {_RELATION} AS r FROM events) ON r = s GROUP BY s")
def semantic_status_summary(spark: SparkSession, d: str) -> DataFrame:
    return semantic.status_summary(table(spark, d, "events"), F.expr(_RELATION))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def semantic_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return semantic.duplicate_ids(table(spark, d, "events"), "user_id")


_ALIAS = "SELECT page_id, 0 AS kind_order, 'alias' AS kind, regexp_extract(url, '://([^.]*)', 1) AS value FROM pages UNION ALL SELECT page_id, 1, 'title', regexp_extract(html, '<title>([^<]*)', 1) FROM pages UNION ALL SELECT page_id, 2, 'path', url FROM pages"


@query(f"""SELECT page_id, lower(value) = 'blog' AS exact, kind, value FROM ({_ALIAS}) WHERE contains(lower(value), 'blog')
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY lower(value) = 'blog' DESC, kind_order, value) = 1""")
def alias_search_rank(spark: SparkSession, d: str) -> DataFrame:
    values = [("alias", F.regexp_extract("url", r"://([^.]*)", 1)), ("title", F.regexp_extract("html", "<title>([^<]*)", 1)), ("path", F.col("url"))]
    return semantic.alias_search(table(spark, d, "pages"), "page_id", values, "BLOG")


@query("SELECT event_id, value FROM events WHERE value >= 25 AND value <= 75.5")
def alias_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return semantic.ranged(table(spark, d, "events").select("event_id", "value"), "value", 25, 75.5)


@query("SELECT source AS ext, min(lang) AS kind, min(doc_id) AS first_row FROM (SELECT 'e' || (doc_id % 400) AS source, lang, doc_id FROM documents) GROUP BY 1 HAVING count(DISTINCT lang) = 1")
def catalog_unique_type(spark: SparkSession, d: str) -> DataFrame:
    ext = F.concat(F.lit("e"), (F.col("doc_id") % 400).cast("string"))
    return semantic.unique_types(table(spark, d, "documents"), ext, F.col("lang"), "doc_id")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def map_upsert_last(spark: SparkSession, d: str) -> DataFrame:
    return semantic.upsert_last(table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value", "event_id"])


@query("SELECT coalesce(o_orderstatus, 'not-started') AS status, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def gap_left_join(spark: SparkSession, d: str) -> DataFrame:
    tracked = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    return semantic.gap_counts(table(spark, d, "customer").select("c_custkey"), tracked, ["c_custkey"], "status")


_GAPS = "SELECT l_orderkey AS id, CASE l_orderkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'blocked' END AS status, CASE l_returnflag WHEN 'N' THEN 'planned' WHEN 'R' THEN 'external' ELSE 'other' END AS disposition FROM lineitem"


@query(f"""WITH h AS (SELECT id, min(status) AS s, bool_or(disposition = 'planned') AS p, bool_or(disposition = 'external') AS e FROM ({_GAPS}) GROUP BY id)
SELECT id, 'complete-has-planned' AS rule FROM h WHERE s = 'complete' AND p UNION ALL SELECT id, 'complete-has-external' FROM h WHERE s = 'complete' AND e
UNION ALL SELECT id, 'partial-lacks-planned' FROM h WHERE s = 'partial' AND NOT p UNION ALL SELECT id, 'blocked-lacks-external' FROM h WHERE s = 'blocked' AND NOT e""")
def gap_set_rules(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "lineitem").selectExpr("l_orderkey as id", "case l_orderkey % 3 when 0 then 'complete' when 1 then 'partial' else 'blocked' end as status", "case l_returnflag when 'N' then 'planned' when 'R' then 'external' else 'other' end as disposition")
    return semantic.gap_rules(gaps, "id", "status", "disposition")


_NAMED = "SELECT c_custkey // 12 AS dir, 'f' || (c_custkey // 4) || ['.dat', '.dat.idx', '.tar.gz', ''][c_custkey % 4 + 1] AS name, (c_custkey // 12) || '/f' || (c_custkey // 4) || ['.dat', '.dat.idx', '.tar.gz', ''][c_custkey % 4 + 1] AS path FROM customer"


@query(f"""WITH f AS ({_NAMED}), o AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS base FROM f)
SELECT a.path, b.path AS companion FROM o a JOIN f b ON a.dir = b.dir AND a.path <> b.path AND a.base <> '' AND starts_with(b.name, a.base || '.')""")
def companion_stem_join(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, [".dat", ".dat.idx", ".tar.gz", ""])), (F.col("c_custkey") % 4 + 1).cast("int"))
    folder, name = F.floor(F.col("c_custkey") / 12), F.concat(F.lit("f"), F.floor(F.col("c_custkey") / 4), ending)
    files = table(spark, d, "customer").select(folder.alias("dir"), name.alias("name"), F.concat_ws("/", folder, name).alias("path"))
    return semantic.companions(files, "dir", "name", "path")


@query(f"WITH p AS ({_PLAN}) SELECT 'maxDecodedBytesPerResource' AS budget, 120::BIGINT AS allowed, size::VARCHAR AS actual FROM p WHERE status = 'ready' AND size > 120 UNION ALL SELECT DISTINCT 'maxDecodedBytesPerResource', 120::BIGINT, 'unknown' FROM p WHERE status = 'ready' AND size IS NULL")
def resource_budget_violations(spark: SparkSession, d: str) -> DataFrame:
    return _shown(plan.resource_violations(_plan(spark, d), F.col("status"), F.col("size"), 120))


_PARTS = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lineitem"


@query(f'SELECT l_orderkey, l_linenumber, start, greatest(start, 10) - start AS "from", least(start + size, 70) - greatest(start, 10) AS n FROM ({_PARTS}) WHERE least(start + size, 70) - greatest(start, 10) > 0')
def multipart_running_offset(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.col("l_quantity").cast("long").alias("size"))
    out = plan.overlaps(plan.running_offsets(parts, "l_orderkey", "o", "size"), "size", F.lit(10).cast("long"), F.lit(60).cast("long"))
    return out.select("l_orderkey", "l_linenumber", "start", "from", "n")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 24 HOUR")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    return plan.retained(table(spark, d, "events"), "ts", F.lit("2024-01-05 00:00:00").cast(dict(table(spark, d, "events").dtypes)["ts"])).select("event_id", "user_id")


@query("SELECT conv_id, turn, running FROM (SELECT conv_id, turn, (sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS running FROM conversations) WHERE running <= 2048")
def running_response_budget(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return entries.budget_page(turns, ["turn", "role", "text"], F.octet_length("text"), 2048, ["conv_id"]).select("conv_id", "turn", "running")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hashing.sha256(F.col("text")).alias("sha256"))


@query("SELECT doc_id, 'doc:' || sha256(source || '/' || lang || '/' || doc_id) AS id FROM documents")
def stable_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hashing.stable_id("doc", F.concat_ws("/", "source", "lang", "doc_id")).alias("id"))


@query("SELECT source, pos, size, size >= 0 AS valid FROM (SELECT o_custkey AS source, o_orderkey AS pos, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 100000000) - o_orderkey AS size FROM orders)")
def next_offset_sizes(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("pos"))
    return entries.next_offset_sizes(index, "source", "pos", "pos", F.lit(100_000_000).cast("long")).select("source", "pos", "size", "valid")


@query(f"SELECT entry_id, (path IS NULL OR path = '' OR starts_with(path, '/') OR len(list_filter(string_split(path, '/'), lambda s: s = '' OR s = '.' OR s = '..' OR contains(s, ':') OR regexp_matches(s, '[. ]$') OR lower(regexp_extract(s, '^([^.]*)', 1)) IN ({_quoted(paths.RESERVED)}))) > 0) AS unsafe FROM (SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN path WHEN 1 THEN '../' || path WHEN 2 THEN 'a/NUL.txt' ELSE path || '/x.png' END AS path FROM ({_FILES}))")
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    path = F.expr("case entry_id % 4 when 0 then path when 1 then concat('../', path) when 2 then 'a/NUL.txt' else concat(path, '/x.png') end")
    return _files(spark, d).select("entry_id", paths.unsafe(path).alias("unsafe"))


# A catalog of resources from parts: the tag is a name, extensions are brands, the signature is made of the size.
_CATALOG = "SELECT p_partkey::INT AS row_no, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || p_partkey % 90 END AS tag, p_type AS resource_type, ['', p_brand || p_partkey % 40] AS exts, chr((65 + p_size % 26)::INT) || chr((97 + p_partkey % 26)::INT) || 'ea' AS sig FROM part"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("cast(p_partkey as int) as row_no", "if(p_partkey % 5 = 0, p_name, concat(p_name, p_partkey % 90)) as tag", "p_type as resource_type", "array('', concat(p_brand, p_partkey % 40)) as extensions", "array(cast(concat(char(65 + p_size % 26), char(97 + p_partkey % 26), 'ea') as binary)) as signatures")


@query(f"SELECT tag, min(resource_type) AS resource_type, min(exts[2]) AS ext FROM ({_CATALOG}) GROUP BY tag HAVING count(*) = 1")
def unique_tag(spark: SparkSession, d: str) -> DataFrame:
    return classify.unique_tags(_catalog(spark, d))


@query(f"SELECT sig AS signature, min(resource_type) AS resource_type, min(exts[2]) AS ext FROM ({_CATALOG}) GROUP BY sig HAVING count(*) = 1")
def unique_signature(spark: SparkSession, d: str) -> DataFrame:
    return classify.unique_signatures(_catalog(spark, d)).withColumn("signature", F.col("signature").cast("string"))


_EXT_ALIASES = "SELECT lower(exts[2]) AS given_ext, 1 AS position, tag || '0' AS tag FROM c WHERE row_no % 7 = 0"


@query(f"""WITH c AS ({_CATALOG}), a AS ({_EXT_ALIASES}), e AS (SELECT lower(exts[2]) AS x, 0 AS k, row_no, resource_type FROM c UNION ALL SELECT given_ext, 2, row_no, resource_type FROM c JOIN a USING (tag)),
t AS (SELECT x, min(resource_type) AS resource_type FROM e GROUP BY x HAVING count(DISTINCT resource_type) = 1)
SELECT s_suppkey, resource_type FROM (SELECT s_suppkey, lower('Brand#' || s_suppkey % 25 || s_suppkey % 40) AS x FROM supplier) LEFT JOIN t USING (x)""")
def extension_classify(spark: SparkSession, d: str) -> DataFrame:
    catalog = _catalog(spark, d)
    aliases = catalog.where("row_no % 7 = 0").selectExpr("lower(extensions[1]) as given_ext", "1 as position", "concat(tag, '0') as tag")
    path = F.concat(F.lit("a.b/Brand.Brand#"), (F.col("s_suppkey") % 25).cast("string"), (F.col("s_suppkey") % 40).cast("string"))
    return classify.by_extension(table(spark, d, "supplier").withColumn("path", path), "path", catalog, aliases).select("s_suppkey", "resource_type")


@query(f"""WITH c AS ({_CATALOG}), u AS (SELECT sig, min(resource_type) AS rt, min(exts[2]) AS ext FROM c GROUP BY sig HAVING count(*) = 1)
SELECT doc_id, rt AS resource_type, CASE WHEN rt IS NULL THEN 'd/n.' || doc_id ELSE 'd/n.' || ext END AS path FROM (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN substr(text, 1, 4) ELSE chr((65 + doc_id % 26)::INT) || chr((97 + doc_id % 23)::INT) || 'ea' END AS head FROM documents)
LEFT JOIN u ON head = sig AND NOT starts_with(head, 'BM')""")
def signature_classify(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 4)).otherwise(F.concat(F.expr("char(65 + doc_id % 26)"), F.expr("char(97 + doc_id % 23)"), F.lit("ea")))
    files = table(spark, d, "documents").select("doc_id", F.encode(head, "UTF-8").alias("head"), F.concat(F.lit("d/n."), F.col("doc_id").cast("string")).alias("path"))
    return classify.applied(classify.by_signature(files, "head", _catalog(spark, d)), "path").select("doc_id", "resource_type", "path")


_NATIONS = f"SELECT format_id, reg_order, unnest(exts) AS ext FROM (VALUES {_FORMATS}) f(format_id, reg_order, exts, priority, fb, eo, hs)"


@query(f"""WITH own AS ({_NATIONS}), a AS (SELECT DISTINCT lang AS ext, ['the', 'and', 'plain', 'any', 'none'][doc_id % 5 + 1] AS format_id FROM documents)
SELECT ext, format_id, reg_order, FALSE AS aliased FROM own UNION ALL SELECT a.ext, a.format_id, r.reg_order, TRUE FROM a JOIN (SELECT format_id, reg_order FROM (VALUES {_FORMATS}) f(format_id, reg_order, exts, priority, fb, eo, hs)) r USING (format_id) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.ext = a.ext AND o.format_id = a.format_id)""")
def aliased_formats(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["the", "and", "plain", "any", "none"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return support.for_extension(formats(spark), table(spark, d, "documents").select(F.col("lang").alias("ext"), name.alias("format_id")))


@query("SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_suppkey = n_nationkey * 3")
def support_lookup(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("record"))
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") * 3).cast("long").alias("k"))
    return support.supported(nations, "k", records, "record").select("n_nationkey", "n_name", "s_suppkey")


_GAP = "SELECT l_orderkey AS id, 'g' || l_suppkey % 6 AS code, CASE l_returnflag WHEN 'N' THEN 'planned' WHEN 'R' THEN 'external' ELSE 'other' END AS disposition FROM lineitem"


@query(f"""WITH g AS ({_GAP}), t AS (SELECT 'g' || n AS code, CASE WHEN n % 2 = 0 THEN 'planned' ELSE 'external' END AS want FROM range(5) r(n))
SELECT id, code, 'unknown-gap' AS issue FROM g WHERE code NOT IN (SELECT code FROM t) UNION ALL SELECT id, code, 'invalid-disposition' FROM g WHERE disposition = 'other'
UNION ALL SELECT id, code, 'other-disposition' FROM g JOIN t USING (code) WHERE disposition <> want UNION ALL SELECT id, code, 'duplicate-gap' FROM (SELECT id, code, row_number() OVER (PARTITION BY id, code) AS n FROM g) WHERE n > 1""")
def gap_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "lineitem").selectExpr("l_orderkey as id", "concat('g', l_suppkey % 6) as code", "case l_returnflag when 'N' then 'planned' when 'R' then 'external' else 'other' end as disposition")
    taxonomy = spark.range(5).selectExpr("concat('g', id) as code", "if(id % 2 = 0, 'planned', 'external') as disposition")
    return support.taxonomy_issues(gaps, "id", taxonomy, ["planned", "external"])


@query("SELECT o_orderkey, bytes FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS bytes FROM orders WHERE o_orderstatus <> 'F') ORDER BY bytes ASC NULLS LAST, o_orderkey LIMIT 40")
def pending_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").alias("status"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey")).alias("bytes"))
    return support.pending(rows, "status", "bytes", "o_orderkey").select("o_orderkey", "bytes")


@query(f"SELECT sum(ready_count)::BIGINT AS ready_count, sum(packed_bytes)::BIGINT AS packed_bytes, sum(unknown_count)::BIGINT AS unknown_count, CASE WHEN sum(unknown_count) = 0 THEN sum(coalesce(output_bytes, 0))::BIGINT END AS output_bytes FROM (SELECT source, {_TOTALS} FROM ({_PLAN}) WHERE size IS NOT NULL GROUP BY source)")
def source_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The totals of each source's plan, then of all plans."""
    items, ready = _plan(spark, d).where("size is not null"), F.col("status") == "ready"
    plans = items.groupBy("source").agg(F.count_if(ready).alias("ready_count"), F.count_if(F.col("status") == "skipped").alias("skipped_count"), F.count_if(F.col("status") == "failed").alias("failed_count"), F.coalesce(F.sum(F.when(ready, F.col("packed"))), F.lit(0)).alias("packed_bytes"), F.count_if(ready & F.col("size").isNull()).alias("unknown_count"), F.sum(F.when(ready, F.col("size"))).alias("output_bytes"))
    return plan.over_sources(plans).select("ready_count", "packed_bytes", "unknown_count", "output_bytes")


@query("""WITH e AS (SELECT p_partkey AS path, p_size AS size, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS checksum FROM part WHERE p_partkey % 10 > 0), l AS (SELECT p_partkey AS path, p_size + (p_partkey % 4 = 1)::INT AS size, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS checksum FROM part WHERE p_partkey % 11 > 0)
SELECT coalesce(e.path, l.path) AS path, 'path' AS field, (e.path IS NOT NULL)::INT::VARCHAR AS wanted, (l.path IS NOT NULL)::INT::VARCHAR AS got FROM e FULL JOIN l ON e.path = l.path WHERE e.path IS NULL OR l.path IS NULL
UNION ALL SELECT path, 'size', e.size::VARCHAR, l.size::VARCHAR FROM e JOIN l USING (path) WHERE e.size <> l.size UNION ALL SELECT path, 'checksum', e.checksum, l.checksum FROM e JOIN l USING (path) WHERE e.checksum IS NOT NULL AND e.checksum IS DISTINCT FROM l.checksum""")
def expected_entry_fields(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    wanted = part.where("p_partkey % 10 > 0").selectExpr("p_partkey as path", "p_size as size", "if(p_partkey % 3 > 0, p_brand, null) as checksum")
    listed = part.where("p_partkey % 11 > 0").selectExpr("p_partkey as path", "p_size + if(p_partkey % 4 = 1, 1, 0) as size", "if(p_partkey % 5 > 0, p_brand, null) as checksum", "1 as entry_pos")
    return verify.listing_differences(wanted, listed, fields=["size", "checksum"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars * 2 WHEN doc_id % 5 > 0 THEN n_chars END::BIGINT AS bytes FROM documents")
def decoded_sizes(spark: SparkSession, d: str) -> DataFrame:
    declared = F.when(F.col("doc_id") % 3 == 0, (F.col("n_chars") * 2).cast("string")).otherwise("-1")
    return table(spark, d, "documents").select("doc_id", entries.decoded_size(declared, F.col("n_chars"), F.col("doc_id") % 5 > 0).cast("long").alias("bytes"))


@query("SELECT l_suppkey, o, CASE WHEN place < until THEN text END AS text FROM (SELECT *, max(place + span) FILTER (own) OVER (PARTITION BY l_suppkey, run) AS until, max(cell) OVER (PARTITION BY l_suppkey, run) AS text FROM (SELECT *, count(cell) OVER (PARTITION BY l_suppkey ORDER BY place) AS run, cell IS NOT NULL AS own FROM (SELECT l_suppkey, o, cell, span, row_number() OVER (PARTITION BY l_suppkey ORDER BY o) AS place FROM (SELECT l_suppkey, l_orderkey * 100 + l_linenumber AS o, CASE WHEN l_partkey % 3 = 0 THEN 'c' || l_partkey END AS cell, 1 + l_partkey % 4 AS span FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)))))")
def rowspan_carry(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = lines.selectExpr("l_suppkey", "l_orderkey * 100 + l_linenumber as o", "if(p % 3 = 0, concat('c', p), null) as text", "1 + p % 4 as span")
    return markup.carried(rows, ["l_suppkey"], ["o"], "text", "span").select("l_suppkey", "o", "text")


_TAGLESS = r"regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p\s*>', chr(10), 'g'), '<[^>]+>', '', 'g')"
_NAMED_SQL = _TAGLESS
for _name, _char in markup.ENTITIES:
    _NAMED_SQL = f"replace({_NAMED_SQL}, '{_name}', chr({ord(_char)}))"


def _points(pattern: str, number: str) -> str:
    """SQL that replaces the numeric entities of ``t`` by their code points."""
    return f"array_to_string(list_transform(list_zip(string_split_regex(t, '{pattern}'), regexp_extract_all(t, '{pattern}', 1)), lambda x: x[1] || coalesce(chr({number}), '')), '')"


@query(f"SELECT page_id, sha256(t) AS text_sha256 FROM (SELECT page_id, {_points('(?i)&#x([0-9a-f]+);', "('0x' || x[2])::INT")} AS t FROM (SELECT page_id, {_points('&#([0-9]+);', 'x[2]::INT')} AS t FROM (SELECT page_id, {_NAMED_SQL} AS t FROM pages)))")
def html_cell_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", hashing.sha256(markup.decoded(markup.stripped(F.col("html")))).alias("text_sha256"))


GROUP = 16


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """Files of sixteen documents each: every fifth is no archive, the others are of two kinds of fixed index in turn, named by group."""

    def build(key, rows):
        group, docs = int(key[0]), [(f"d{i}.txt".encode(), t.encode()) for i, t in sorted(zip(rows["doc_id"], rows["text"].fillna(""), strict=True))]
        n, body = len(docs), b"".join(t for _, t in docs)
        if group % 5 == 4:
            return pd.DataFrame({"path": [f"g{group}.bin"], "content": [b"\0none" + body]})
        kind = group % 2
        at = 16 + 32 * (n + 1) if kind else 8 + 40 * n
        index = b"ADPACK32" + struct.pack("<II", 0, n + 1) if kind else b"PACK" + struct.pack("<I", n)
        for name, text in docs:
            index += struct.pack("<24s4xI", name, at) if kind else struct.pack("<32sII", name, len(text), at)
            at += len(text)
        index += struct.pack("<24s4xI", b"", at) if kind else b""
        return pd.DataFrame({"path": [f"g{group}.pak"], "content": [index + body]})

    grouped = table(spark, d, "documents").select(F.floor(F.col("doc_id") / GROUP).alias("g"), "doc_id", "text").groupBy("g")
    return grouped.applyInPandas(build, "path string, content binary")


_GROUPS = f"(SELECT doc_id, doc_id // {GROUP} AS g, doc_id % {GROUP} AS pos, coalesce(text, '') AS text FROM documents)"
_ARCHIVE = "'g' || g || '.pak'"


@query(f"SELECT CASE WHEN g % 5 = 4 THEN 'g' || g || '.bin' ELSE {_ARCHIVE} END AS source_path, CASE WHEN g % 5 = 4 THEN 'unrecognized' ELSE 'archive' END AS outcome, CASE WHEN g % 5 = 4 THEN NULL WHEN g % 2 = 1 THEN 'adpack32' ELSE 'cdpa-pack' END AS format_id, CASE WHEN g % 5 < 4 THEN 'high' END AS confidence, CASE WHEN g % 5 < 4 THEN count(*)::INT END AS entry_count FROM {_GROUPS} GROUP BY g")
def source_detect(spark: SparkSession, d: str) -> DataFrame:
    return scans.detected(_archives(spark, d)).select("source_path", "outcome", "format_id", "confidence", "entry_count")


@query(f"SELECT {_ARCHIVE} AS source_path, (row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1)::VARCHAR AS entry_id, 'd' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size, FALSE AS compressed FROM {_GROUPS} WHERE g % 5 < 4")
def source_entries(spark: SparkSession, d: str) -> DataFrame:
    return scans.entries(_archives(spark, d)).select("source_path", "entry_id", "path", "size", "compressed")


@query(f"""SELECT {_ARCHIVE} AS source_path, n.entry_id, CASE WHEN x.doc_id IS NULL THEN 'failed' ELSE 'extracted' END AS status, sha256(x.text) AS sha256, CASE WHEN x.doc_id IS NULL THEN 'ENTRY_NOT_FOUND' END AS error
FROM (SELECT DISTINCT g, unnest(['0', '3', '99']) AS entry_id FROM {_GROUPS} WHERE g % 5 < 4) n LEFT JOIN (SELECT g AS h, doc_id, text, (row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1)::VARCHAR AS e FROM {_GROUPS}) x ON h = g AND e = entry_id""")
def source_extract(spark: SparkSession, d: str) -> DataFrame:
    """The first, the fourth and an entry that isn't there, of each archive."""
    files = _archives(spark, d)
    named = table(spark, d, "documents").select(F.floor(F.col("doc_id") / GROUP).alias("g")).distinct().where("g % 5 < 4")
    wanted = named.select(F.concat(F.lit("g"), F.col("g").cast("string"), F.lit(".pak")).alias("source_path"), F.explode(F.array(F.lit("0"), F.lit("3"), F.lit("99"))).alias("entry_id"))
    return scans.extracted(files, wanted).select("source_path", "entry_id", "status", "sha256", "error")
