"""Rules of verification, detection, budgets, types, gaps, companions, pages and sinks, each on the cases that tell it apart."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arkline.functions import hashing, paths
from arkline.operators import detect, entries, plan, semantic, verify
from arkline.sources import archives, maps, sinks, tables


def test_verification(spark):
    rows = [
        ("a", "AB", None, "ab", None, None, "verified", "manifest"), ("b", "ab", None, None, None, None, "mismatch", "manifest"),
        ("c", None, None, "ab", None, True, "verified", "structural"), ("d", None, None, "ab", None, None, "inspected", "hash"),
        ("e", "ab", None, "ab", None, False, "invalid", "manifest"), ("f", None, None, "ab", None, False, "invalid", "hash"),
        ("g", "ab", 3, "ab", 3, None, "verified", "manifest"), ("h", None, 3, "ab", 4, True, "mismatch", "manifest"), ("i", None, 3, "ab", None, None, "mismatch", "manifest"),
    ]
    df = spark.createDataFrame(rows, "k string, want string, size long, sha string, bytes long, valid boolean, status string, level string")
    c = F.col
    got = df.select("status", "level", verify.status(c("valid"), verify.matched(c("sha"), c("bytes"), c("want"), c("size"))).alias("s"), verify.level(F.coalesce("want", c("size").cast("string")), c("valid")).alias("l"))
    for r in got.collect():
        assert (r.s, r.l) == (r.status, r.level)


def test_fallback_formats_are_candidates_of_every_file(spark):
    formats = spark.createDataFrame([("falls", 1, ["x"], 0, True, False, True), ("bound", 2, ["x"], 0, True, True, True), ("strict", 3, ["x"], 9, False, False, True), ("named", 4, ["y"], 0, False, False, False), ("all", 5, [], 0, False, False, False)], "format_id string, reg_order int, extensions array<string>, priority int, ext_fallback boolean, ext_only boolean, has_signatures boolean")
    files = spark.createDataFrame([(1, "x"), (2, "z"), (3, "y")], "id int, ext string")
    signed = spark.createDataFrame([(2, "strict")], "id int, format_id string")
    got = {}
    for r in detect.ranked(detect.candidates(files, "id", "ext", signed, formats), "id").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.format_id)
    assert got == {1: ["falls", "bound", "all"], 2: ["strict", "falls", "all"], 3: ["named", "falls", "all"]}
    reader = archives.Reader("falls", ("x",), ((b"SIG", 0),), lambda d, p: [], lambda *a: b"", ext_fallback=True)
    assert [r.format_id for r, *_ in archives.Registry([reader]).candidates(b"none", "a.zzz")] == ["falls"]


def test_unknown_sizes_break_budgets(spark):
    items = spark.createDataFrame([("ready", 5, 10), ("ready", 5, None), ("failed", 5, None), ("ready", 5, 99)], "status string, packed long, size long")
    totals = plan.totals(items, F.col("status"), F.col("packed"), F.col("size"))
    broken = plan.violations(totals, {"maxOutputBytes": ("output_bytes", 1000), "maxResources": ("ready_count", 2), "maxInputBytes": ("packed_bytes", 15)})
    assert {(r.budget, r.actual) for r in broken.collect()} == {("maxOutputBytes", None), ("maxResources", 3)}
    with pytest.raises(ValueError, match="LIMIT_EXCEEDED.*maxOutputBytes unknown"):
        plan.within_budgets(broken)
    each = plan.resource_violations(items, F.col("status"), F.col("size"), 50)
    assert sorted((r.actual for r in each.collect()), key=str) == [99, None]
    plan.within_budgets(each.limit(0))


def test_types_take_the_last_dot_of_the_path(spark):
    rows = spark.createDataFrame([("a/.png", "image"), ("a.png/b", "unknown"), ("x.OGG", "audio"), ("none", "unknown")], "path string, want string")
    assert all(r.want == r.got for r in rows.select("want", entries.type_of(paths.last_dot_extension(F.col("path"))).alias("got")).collect())


def test_gaps_are_separate_issues(spark):
    gaps = spark.createDataFrame([("a", "complete", "planned"), ("a", "complete", "external"), ("b", "partial", "external"), ("c", "blocked", "external")], "id string, s string, d string")
    assert sorted(tuple(r) for r in semantic.gap_rules(gaps, "id", "s", "d").collect()) == [("a", "complete-has-external"), ("a", "complete-has-planned"), ("b", "partial-lacks-planned")]


def test_companions_start_with_the_stem(spark):
    files = spark.createDataFrame([("d", n, f"d/{n}") for n in ("a.dat", "a.tar.gz", "a.b.dat", "ab.x", "a", ".x")] + [("e", "a.gz", "e/a.gz")], "dir string, name string, path string")
    got = {(r.path[2:], r.companion[2:]) for r in semantic.companions(files, "dir", "name", "path").collect()}
    assert got == {("a.dat", "a.tar.gz"), ("a.dat", "a.b.dat"), ("a", "a.dat"), ("a", "a.tar.gz"), ("a", "a.b.dat")}


def test_pages_keep_ties(spark):
    rows = spark.createDataFrame([("p", i) for i in range(5)] + [("q", 9)], "path string, id int")
    first = entries.keyset_page(rows, "path", None, 4, ["id"])
    cursor, after = entries.next_cursor(first, "path", 3), entries.next_ties(first, "path", 3, ["id"])
    assert after == (2,) and [tuple(r) for r in entries.keyset_page(rows, "path", cursor, 9, ["id"], after).collect()] == [("p", 3), ("p", 4), ("q", 9)]


def test_one_damaged_file_does_not_stop_a_scan(spark):
    files = spark.createDataFrame([("a.bad", bytearray(b"x")), ("b.good", bytearray(b"y"))], "path string, content binary")

    def registry():
        def odd(data, path):
            if path.endswith("bad"):
                raise RecursionError("deep")
            return [archives.Entry("1", "n", 1, 1), archives.Entry("2", "m", 1, 1)]

        return archives.Registry([archives.Reader("any", (), (), odd, lambda data, e: {"1": b"!"}[e.entry_id])])

    assert {r.source_path for r in tables.entries(files, registry).collect()} == {"b.good"}
    wanted = spark.createDataFrame([("a.bad", "1"), ("b.good", "1"), ("b.good", "2")], "source_path string, entry_id string")
    got = sorted((r.source_path, r.entry_id, r.status, r.error) for r in tables.extracted(files, wanted, registry).collect())
    assert got == [("a.bad", "1", "failed", "RecursionError: deep"), ("b.good", "1", "extracted", None), ("b.good", "2", "failed", "KeyError: '2'")]


def test_readers_get_few_bytes_of_files_at_once(spark, monkeypatch):
    """However many files a partition has, a batch holds 4 MiB of them and one more."""
    files = spark.range(0, 48, 1, 1).selectExpr("concat(id, '.any') as path", "cast(repeat(chr(97 + id % 26), 1048576) as binary) as content")
    wanted = files.selectExpr("path as source_path", "'0' as entry_id")
    mapped = type(files).mapInPandas

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"bytes": [int(batch["content"].map(len).sum())]})

    monkeypatch.setattr(type(files), "mapInPandas", lambda self, run, schema: mapped(self, sizes, "bytes long"))
    for given in (tables.detected(files), tables.entries(files), tables.extracted(files, wanted)):
        found = [r.bytes for r in given.collect()]
        assert sum(found) == 48 << 20 and max(found) <= 5 << 20


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a\\b", bytearray(b"1")), ("a/b", bytearray(b"2")), (None, bytearray(b"3")), ("c", bytearray(b"4"))], "path string, bytes binary")
    assert sorted((str(r.path), r.status) for r in sinks.write_files(rows, str(tmp_path / "x")).collect()) == [("None", "failed"), ("a/b", "failed"), ("a\\b", "failed"), ("c", "extracted")]
    records = spark.createDataFrame([(f"id{i}", i) for i in range(50)], "id string, v int")
    target = sinks.write_catalog(records, str(tmp_path / "c"), {})
    os.unlink(f"{target}/_SUCCESS")
    assert sinks.write_catalog(records.repartition(3), str(tmp_path / "c"), {}) == target and os.path.exists(f"{target}/_SUCCESS") and spark.read.text(target).count() == 51
    assert hashing.digest_of(records, F.col("id")) != hashing.digest_of(records.limit(49), F.col("id"))


def test_alias_rows_do_not_depend_on_partitions(spark):
    one = ("r", "p", "e", "en", [f"n{i}" for i in range(1500)])
    schema = "root_id string, path string, entry_id string, locale string, aliases array<string>"
    given = spark.createDataFrame([one, ("r", "q", "e", "en", ["n0"])], schema)
    a, b = ({r.row for r in maps.alias_rows(df).collect()} for df in (given.coalesce(1), given.repartition(3)))
    assert a == b and len(a) == 1501
