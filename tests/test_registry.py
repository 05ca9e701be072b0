"""Classification, support, listings, cells of tables, and catalogs with line numbers and limits."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from arkline.functions import markup
from arkline.operators import classify, entries, plan, support, verify
from arkline.sources import catalogs, sinks


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        (1, "OGG", "audio", ["", "ogg"], [b"OggS", b"OggS"]), (2, "BMP", "image", ["bmp"], [b"BM\x01\x02"]), (3, "ABC", "image", ["Abc", "xyz"], [b"ABC1", b"SAME"]),
        (4, "DEF", "script", ["def", "xyz"], [b"SAME"]), (5, "TWO", "audio", ["two"], [b"TWO1"]), (6, "TWO", "image", [], [b"TWO2"]), (7, "ABD", "image", ["abc"], []),
    ]
    return spark.createDataFrame([(n, t, k, e, [bytearray(x) for x in s]) for n, t, k, e, s in rows], classify.CATALOG)


def test_unique_tags_and_signatures(catalog):
    assert {r.tag for r in classify.unique_tags(catalog).collect()} == {"OGG", "BMP", "ABC", "DEF", "ABD"}
    assert {bytes(r.signature) for r in classify.unique_signatures(catalog).collect()} == {b"OggS", b"BM\x01\x02", b"ABC1", b"TWO1", b"TWO2"}


def test_types_by_extension(spark, catalog):
    aliases = spark.createDataFrame([("abc", 0, "ABC"), ("two", 0, "DEF"), ("only", 0, "BMP")], "given_ext string, position int, tag string")
    files = spark.createDataFrame([("a.ABC",), ("a.xyz",), ("a.two",), ("a.only",), ("d.abc/n",), ("plain",), ("a.",), (None,)], "path string")
    got = {r.path: r.resource_type for r in classify.by_extension(files, "path", catalog, aliases).collect()}
    assert got == {"a.ABC": "image", "a.xyz": None, "a.two": None, "a.only": "image", "d.abc/n": None, "plain": None, "a.": None, None: None}
    assert {r.given_ext: r.ext for r in classify.extension_types(catalog).collect()} == {"ogg": "ogg", "bmp": "bmp", "abc": "Abc", "def": "def", "two": "two"}


def test_types_by_signature(spark, catalog):
    heads = {"a.x": b"OggS....", "b.y/n": b"BMzz", "c": b"ABC1", "d": b"SAME", "e": b"AB", "f": b"RIFFxxxx", "g.q": b"TWO2", "h": None}
    files = spark.createDataFrame([(p, None if h is None else bytearray(h)) for p, h in heads.items()], "path string, head binary")
    got = {(r.resource_type, r.path) for r in classify.applied(classify.by_signature(files, "head", catalog), "path").collect()}
    assert got == {("audio", "a.ogg"), ("image", "b.y/n.bmp"), ("image", "c.Abc"), (None, "d"), (None, "e"), (None, "f"), ("image", "g.q"), (None, "h")}


def test_formats_of_an_extension(spark):
    formats = spark.createDataFrame([("a", 1, ["X", "x"]), ("b", 2, ["y"]), ("c", 3, [])], "format_id string, reg_order int, extensions array<string>")
    aliases = spark.createDataFrame([("x", "a"), ("x", "c"), ("x", "c"), ("x", "none")], "ext string, format_id string")
    assert sorted(map(tuple, support.for_extension(formats, aliases).select("ext", "format_id", "aliased").collect())) == [("x", "a", False), ("x", "c", True), ("y", "b", False)]


def test_taxonomy_and_pending(spark):
    gaps = spark.createDataFrame([("r", "k", "planned")] * 3 + [("r", "q", "odd"), ("s", "k", None), ("s", "z", "external")], "id string, code string, disposition string")
    taxonomy = spark.createDataFrame([("k", "planned"), ("z", "external")], "code string, disposition string")
    got = sorted(map(tuple, support.taxonomy_issues(gaps, "id", taxonomy, ["planned", "external"]).collect()))
    assert got == [("r", "k", "duplicate-gap")] * 2 + [("r", "q", "invalid-disposition"), ("r", "q", "unknown-gap"), ("s", "k", "invalid-disposition"), ("s", "k", "other-disposition")]
    rows = spark.createDataFrame([("t1", None, 5), ("t0", None, 5), ("t2", "", None), ("t3", "done", 1), ("t4", None, 2)], "tag string, status string, size long")
    assert [r.tag for r in support.pending(rows, "status", "size", "tag", 3).collect()] == ["t4", "t0", "t1"]


def test_sizes_and_totals(spark):
    rows = spark.createDataFrame([("12", 3, True, "12"), ("1x", 3, True, "3"), (None, 3, None, "3"), (None, 3, False, None), ("-1", None, True, None), ("9" * 20, 1, True, "9" * 20)], "d string, s long, k boolean, want string")
    assert all(r.want == r.got for r in rows.select("want", entries.decoded_size(F.col("d"), F.col("s"), F.col("k")).cast("string").alias("got")).collect())
    columns = "ready_count long, skipped_count long, failed_count long, packed_bytes long, unknown_count long, output_bytes long"
    plans = spark.createDataFrame([(1, 0, 0, 5, 0, 7), (2, 0, 1, 5, 0, None)], columns)
    assert plan.over_sources(plans).first().asDict() == {"ready_count": 3, "skipped_count": 0, "failed_count": 1, "packed_bytes": 10, "unknown_count": 0, "output_bytes": 7}
    assert plan.over_sources(plans.limit(0)).first().output_bytes == 0
    assert plan.over_sources(plans.withColumn("unknown_count", F.lit(1))).first().output_bytes is None


def test_listing_differences(spark):
    wanted = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, None), ("c", 3, None)], "path string, size long, checksum string")
    listed = spark.createDataFrame([("a", 1, "any", 0), ("b", 9, None, 1), ("c", 3, None, 2), ("d", 1, None, 3)], "path string, size long, checksum string, entry_pos int")
    got = sorted(map(tuple, verify.listing_differences(wanted, listed, fields=["size", "checksum"]).collect()), key=str)
    assert got == [("b", "checksum", "x", None), ("b", "size", "2", "9"), ("c", "path", "2", "1"), ("d", "path", "0", "1")]


def test_cells(spark):
    cells = {"a&amp;lt;b": ["a<b"], "x<BR/>y<br>\r\n z </p >&nbsp;": ["x", "y", "z"], "&#65;&#x1F600;&#X42;&#99999999;": ["A\U0001f600B&#99999999;"], "<b>&quot;q&apos;</b>": ["\"q'"], "": [], "&#38;#65;": ["&#65;"]}
    df = spark.createDataFrame([(k, v) for k, v in cells.items()], "html string, want array<string>")
    for r in df.select("html", "want", markup.lines(F.col("html")).alias("got")).collect():
        assert r.got == r.want, r.html


def test_rowspans(spark):
    rows = spark.createDataFrame([("t", 1, "a", 3), ("t", 2, None, None), ("t", 3, None, None), ("t", 4, None, None), ("t", 5, "b", None), ("t", 6, None, None), ("u", 1, None, None)], "t string, i int, cell string, span int")
    got = {(r.t, r.i): r.cell for r in markup.carried(rows, ["t"], ["i"], "cell", "span").collect()}
    assert got == {("t", 1): "a", ("t", 2): "a", ("t", 3): "a", ("t", 4): None, ("t", 5): "b", ("t", 6): None, ("u", 1): None}


def _write(folder, lines):
    os.makedirs(folder, exist_ok=True)
    (folder / "c.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder / "c.jsonl")


HEADER = '{"kind":"header","schemaVersion":1,"game":{}}'


def test_line_numbers_over_blocks(spark, tmp_path):
    path = _write(tmp_path / "n", [f'{{"kind":"entity","id":"e{i}","type":"t"}}' if i % 7 else "" for i in range(1, 3001)])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r.line_no: r.value for r in catalogs.numbered_lines(spark, path).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 3000 and all((got[i] == "") == (i % 7 == 0) and (i % 7 == 0 or f'"e{i}"' in got[i]) for i in got)


def test_damaged_catalogs(spark, tmp_path):
    entity = '{"kind":"entity","id":"a","type":"core:x","properties":"{}"}'
    with pytest.raises(ValueError, match="line 4"):
        catalogs.load(spark, _write(tmp_path / "a", [HEADER, "", entity, '{"kind":', entity]))
    with pytest.raises(ValueError, match="no header"):
        catalogs.load(spark, _write(tmp_path / "b", [entity]))
    with pytest.raises(ValueError, match="Duplicate"):
        catalogs.load(spark, _write(tmp_path / "c", [HEADER, entity, entity]))
    with pytest.raises(ValueError, match="too large"):
        catalogs.load(spark, _write(tmp_path / "d", [HEADER, entity]), max_bytes=10)
    with pytest.raises(ValueError, match="too many"):
        catalogs.load(spark, _write(tmp_path / "e", [HEADER, entity]), max_records=0)
    header, found = catalogs.load(spark, _write(tmp_path / "f", ["", HEADER, entity]))
    assert header["schemaVersion"] == 1 and found.nodes.count() == 1


def test_vocabularies(spark, tmp_path):
    bad = lambda p: F.when(F.length(p) > 2, F.array(F.struct(F.lit("name").alias("path"), F.lit("too long").alias("message")))).otherwise(F.array().cast("array<struct<path:string,message:string>>"))
    mine = catalogs.Vocabulary(["my:thing"], {}, {"my:thing": bad})
    both = catalogs.DEFAULT.with_vocabulary("my", 3, mine)
    assert both.names() == [("core", 1), ("my", 3), ("vn", 1)]
    for name, version in (("My", 1), ("my", 0), ("vn", 1), ("other", 1)):
        with pytest.raises(ValueError, match="vocabulary|Vocabulary"):
            catalogs.DEFAULT.with_vocabulary(name, version, mine)
    path = _write(tmp_path, [HEADER, '{"kind":"entity","id":"a","type":"my:thing","properties":"{\\"k\\":1}"}', '{"kind":"entity","id":"b","type":"my:thing","properties":"{}"}'])
    _, found = catalogs.load(spark, path, both, check=False)
    assert found.first_issues() == [("a.properties.name", "too long")]


def test_reports_and_roots(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "path string, n long")
    target = sinks.write_report(rows, str(tmp_path))
    assert sorted(map(tuple, sinks.read_report(spark, str(tmp_path), os.path.basename(target), "path string, n long").collect()), key=str) == [("a", 1), ("b", None)]
    for name in ("x.report", "../" + os.path.basename(target)):
        with pytest.raises(ValueError, match="not the name"):
            sinks.read_report(spark, str(tmp_path), name, "path string")
    with pytest.raises(ValueError, match="too large"):
        sinks.read_report(spark, str(tmp_path), os.path.basename(target), "path string", most=3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "link").symlink_to(tmp_path)
    assert sinks.contained(str(tmp_path / "in"), "a/b").endswith("in/a/b")
    for path in ("../x", "/etc", "link/x"):
        with pytest.raises(ValueError, match="UNSAFE_PATH"):
            sinks.contained(str(tmp_path / "in"), path)
