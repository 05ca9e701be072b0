from __future__ import annotations

import hashlib
import json
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from arkline.functions import codecs
from arkline.operators import entries as entry_ops
from arkline.sources import archives, catalogs, datasource, formats, maps, sinks, tables
from arkline.streaming.tasks import Tasks

FILES3 = [("hello.txt", b"hello xp3\n"), ("scripts/startup.tjs", b"System.title = 'fixture';\n"), ("画像/サンプル.bin", bytes([0, 1, 2, 3, 0xFE, 0xFF]))]
# Digests that the three files must have.
SHAS = ["566db3d0bd873e0433ff02efe30ea31efdc4de9462ffa1fb8d3f325d6a52e057", "cb9c091b4a3dba8ce59d6f7598e03c559f5ed457a72fd097b0018cc5790f3078", "7ea646958715ed687aa9ac2f5d785feb1a93411f4f25fdd6c7fcc6ab07fdf0e3"]


def xp3(files, packed=True, continued=False, protected=False) -> bytes:
    body, chunks = b"", []
    for name, data in files:
        kept = zlib.compress(data) if packed else data
        info = struct.pack("<IQQH", 1 << 31 if protected else 0, len(data), len(kept), len(name)) + name.encode("utf-16-le")
        segm = struct.pack("<IQQQ", int(packed), 19 + len(body), len(data), len(kept))
        part = b"".join(t + struct.pack("<Q", len(b)) + b for t, b in ((b"info", info), (b"segm", segm), (b"adlr", struct.pack("<I", zlib.adler32(data)))))
        chunks.append(b"File" + struct.pack("<Q", len(part)) + part)
        body += kept
    groups = [chunks[:1], chunks[1:]] if continued else [chunks]
    index, at = b"", 19 + len(body)
    for i, g in enumerate(groups):
        raw = b"".join(g)
        more = i + 1 < len(groups)
        small = zlib.compress(raw)
        block = bytes([1 | 0x80 * more]) + struct.pack("<QQ", len(small), len(raw)) + small
        if more:
            block += struct.pack("<Q", at + len(index) + len(block) + 8)
        index += block
    return archives.MAGIC3 + struct.pack("<Q", at) + body + index


def pack32(files) -> bytes:
    at, records, body = 16 + 32 * (len(files) + 1), b"", b""
    for name, data in files:
        records += name.encode("cp932").ljust(24, b"\0") + bytes(4) + struct.pack("<I", at + len(body))
        body += data
    records += bytes(28) + struct.pack("<I", at + len(body))
    return b"ADPACK32" + bytes(4) + struct.pack("<I", len(files) + 1) + records + body


@pytest.mark.parametrize("options", [{}, {"packed": False}, {"continued": True}])
def test_xp3(options):
    data = xp3(FILES3, **options)
    found = archives.xp3_entries(data)
    assert [(e.path, e.size) for e in found] == [(n, len(d)) for n, d in FILES3]
    assert [hashlib.sha256(archives.xp3_read(data, e)).hexdigest() for e in found] == SHAS
    for cut in (5, 30, len(data) - 3):
        with pytest.raises((archives.InvalidArchive, struct.error)):
            archives.xp3_entries(data[:cut])


def test_protected_entries_are_listed_only():
    data = xp3(FILES3, protected=True)
    e = archives.xp3_entries(data)[0]
    assert e.encrypted
    with pytest.raises(archives.Unsupported):
        archives.xp3_read(data, e)


def test_pack32():
    files = [("hello.txt", b"hello adpack32\n"), ("画像.bin", bytes([0, 1, 2, 0xFD, 0xFE, 0xFF]))]
    data = pack32(files)
    found = archives.pack32_entries(data)
    assert [(e.path, archives.stored(data, e)) for e in found] == files
    with pytest.raises(archives.InvalidArchive):
        archives.pack32_entries(data[:-1])


def test_fixed_index():
    family = archives.FixedIndex("stub", ((b"STUB", 0),), (4, "I"), 8, {"name": "16s", "offset": "I", "size": "I", "packed": "I"}, base=None, codec="zlib")
    payload = [b"one" * 9, b"two"]
    packed = [zlib.compress(p) for p in payload]
    index = b"".join(struct.pack("<16sIII", f"n{i}".encode(), sum(map(len, packed[:i])), len(p), len(q)) for i, (p, q) in enumerate(zip(payload, packed, strict=True)))
    data = b"STUB" + struct.pack("<I", 2) + index + b"".join(packed)
    found = family.entries(data)
    assert [family.read(data, e) for e in found] == payload and all(e.compressed for e in found)
    with pytest.raises(archives.InvalidArchive):
        family.entries(b"STUB" + struct.pack("<I", 0))


@pytest.mark.parametrize("family", archives.FAMILY, ids=lambda f: f.format_id)
def test_family(family):
    """Each layout on an archive that is built from its declaration."""
    layout, payload = struct.Struct("<" + "".join(family.fields.values())), [b"first", b"second one", b"3"]
    names = [k for k, c in family.fields.items() if not c.endswith("x")]
    start = family.start if isinstance(family.start, int) else 64
    at = start + len(payload) * layout.size
    if isinstance(family.base, int) and family.base and "offset" not in family.fields:  # entries before the index
        at, start = family.base, 256
    base = at if isinstance(family.base, tuple) else 0
    head, index = bytearray(64), b""
    for i, p in enumerate(payload):
        values = {"name": f"n{i}.bin".encode(), "offset": at + sum(map(len, payload[:i])) - base, "size": len(p)}
        index += layout.pack(*[values[n] for n in names])
    for sig, place in (family.signatures[0], *family.also):
        head[place : place + len(sig)] = sig
    for place, value in ((family.count, len(payload)), (family.start, start), (family.base, at)):
        if isinstance(place, tuple):
            struct.pack_into("<" + place[1], head, place[0], value)
    data = bytearray(max(at + sum(map(len, payload)), start + len(index)))
    if isinstance(family.start, tuple) and isinstance(family.base, int) and family.base:
        head = head[: family.base]
    data[: len(head)] = head
    data[start : start + len(index)] = index
    data[at : at + sum(map(len, payload))] = b"".join(payload)
    found = family.entries(bytes(data), "x/file.dat")
    assert [family.read(bytes(data), e) for e in found][:2] == payload[:2]
    assert [e.path for e in found] == ([f"n{i}.bin" for i in range(3)] if "name" in family.fields else [f"file#000{i}" for i in range(3)])
    with pytest.raises((archives.InvalidArchive, struct.error)):
        family.entries(bytes(data[: start + 4]), "x")


def test_candidates_are_ranked():
    called = []

    def stub(name, sigs=(), exts=(), **more):
        return archives.Reader(name, exts, sigs, lambda d, p: called.append(name) or (_ for _ in ()).throw(archives.InvalidArchive(name)), archives.stored, **more)

    known = archives.Registry([stub("any"), stub("ext", exts=("pak",)), stub("sig", ((b"AB", 1),)), stub("both", ((b"xA", 0),), ("pak",), priority=-9), stub("miss", ((b"ZZ", 0),)), stub("back", ((b"ZZ", 0),), ("pak",), ext_fallback=True), stub("bound", exts=("dat",), ext_only=True)])
    with pytest.raises(archives.InvalidArchive):
        known.open(b"xAB", "a/b.PAK")
    assert called == ["both", "sig", "ext", "back", "any"]
    with pytest.raises(ValueError, match="already"):
        known.register(stub("any"))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "basic.xp3").write_bytes(xp3(FILES3))
    (tmp_path / "in" / "deep" / "second.pak").write_bytes(pack32([("a.ogg", b"OggS")]))
    (tmp_path / "in" / "readme.txt").write_bytes(b"nothing")
    return tmp_path


def test_scan_detect_list_extract(spark, folder):
    files = tables.scan(spark, str(folder / "in"))
    assert sorted(r.relative for r in files.select("relative").collect()) == ["basic.xp3", "deep/second.pak", "readme.txt"]
    assert tables.scan(spark, str(folder / "in"), max_depth=0).count() == 2
    assert [r.relative for r in tables.scan(spark, str(folder / "in"), ["**/*.pak"]).collect()] == ["deep/second.pak"]
    got = {r.source_path.rsplit("/", 1)[1]: (r.outcome, r.format_id, r.confidence, r.entry_count) for r in tables.detected(files).collect()}
    assert got == {"basic.xp3": ("archive", "xp3", "high", 3), "second.pak": ("archive", "adpack32", "high", 1), "readme.txt": ("unrecognized", None, None, None)}
    listed = tables.entries(files)
    tjs = entry_ops.filtered(listed, include=["**/*.tjs"]).collect()
    assert [(r.entry_id, r.path) for r in tjs] == [("1", "scripts/startup.tjs")]
    source = listed.where("format_id = 'xp3'").first().source_path
    wanted = spark.createDataFrame([(source, i) for i in ("0", "1", "2", "missing")], "source_path string, entry_id string")
    out = {r.entry_id: r for r in tables.extracted(files, wanted).collect()}
    assert [out[i].sha256 for i in "012"] == SHAS and out["missing"].status == "failed"


def test_data_source(spark, folder):
    datasource.register(spark)
    df = spark.read.format("archive_entries").load(str(folder / "in"))
    assert df.count() == 4
    assert [r.path for r in spark.read.format("archive_entries").load(str(folder / "in")).where("format_id = 'adpack32'").collect()] == ["a.ogg"]


def test_writing(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", b"one"), ("../bad", b"two"), ("same", b"3"), ("same", b"4"), ("b.txt", b"five")], "path string, bytes binary")
    (tmp_path / "b.txt").write_bytes(b"other")
    status = lambda policy: {r.path: r.status for r in sinks.write_files(rows, str(tmp_path), policy).collect()}
    assert status("fail") == {"a/x.txt": "extracted", "../bad": "failed", "same": "failed", "b.txt": "failed"}
    assert status("skip")["b.txt"] == "skipped" and (tmp_path / "b.txt").read_bytes() == b"other"
    assert status("overwrite")["b.txt"] == "extracted" and (tmp_path / "b.txt").read_bytes() == b"five"
    assert not list(tmp_path.rglob("*.part"))


def test_csv_map():
    rows = maps.csv_rows('a,"b,""c""\nd",e"f\r\n,,\n"",x,y')
    assert rows == [["a", 'b,"c"\nd', 'e"f'], ["", "x", "y"]]
    with pytest.raises(ValueError, match="closed"):
        maps.csv_rows('a,"b')
    text = "﻿subject_type,subject_key,subject_name,predicate,resource_type,resource_path,entry_id,root_id,override\nvn:character,kagari,篝,vn:voiceResource,audio,Rewrite/koe/z0001.ovk,42,games,true\n"
    (row,) = maps.read_map(text, "csv")
    assert (row["subject_name"], row["entry_id"], row["override"]) == ("篝", "42", True)
    for bad in ("subject_type\nx", text.replace("true", "yes"), text.replace("kagari", "")):
        with pytest.raises(ValueError):  # noqa: PT011
            maps.read_map(bad, "csv")


def test_map_records(spark):
    rows = spark.createDataFrame([(1, "vn:character", "k", "vn:voiceResource", "audio", "a\\b", "n1", "4", None, True), (2, "vn:character", "k", "vn:voiceResource", "audio", "a/b", "n2", "4", None, None)], maps.MAP)
    got = maps.records(rows, "root", "map.csv", "0" * 64).collect()
    kinds = sorted(r.kind for r in got)
    assert kinds == ["entity", "evidence", "evidence", "relation", "relation", "resource"]
    entity = next(r for r in got if r.kind == "entity")
    assert json.loads(entity.properties)["name"] == "n2"
    assert entity.id == "entity:" + hashlib.sha256(b'{"key":"k","type":"vn:character"}').hexdigest()
    resource = next(r for r in got if r.kind == "resource")
    assert resource.id == "resource:" + hashlib.sha256(b'{"entryId":"4","path":"a/b","rootId":"root"}').hexdigest()


def test_alias_search(spark, tmp_path):
    def one(aliases, path, seconds):
        return {"aliases": aliases, "locale": "ja", "locator": {"source": {"rootId": "games", "path": path}}, "metadata": {"title": "Sange", "durationSeconds": seconds} if seconds else None}

    (tmp_path / "a.json").write_text(json.dumps({"schemaVersion": 1, "resources": [one(["散花", "sange"], "x/1.ogg", 120), one(["sange long"], "x/2.ogg", None)]}))
    table = maps.alias_table(spark, str(tmp_path / "a.json"))
    assert [(r.path, r.exact) for r in maps.search(table, "散花").collect()] == [("x/1.ogg", True)]
    assert [(r.path, r.matched_by) for r in maps.search(table, "SANGE").collect()] == [("x/1.ogg", "alias"), ("x/2.ogg", "alias")]
    assert maps.search(table, "散花", least=200).count() == 0
    assert maps.alias_rows(table).count() == 3
    with pytest.raises(ValueError, match="empty"):
        maps.search(table, " ")


def test_catalog(spark, tmp_path):
    def line(**r):
        return json.dumps(r, ensure_ascii=False)

    records = [
        line(kind="header", schemaVersion=1),
        "",
        line(kind="entity", id="character:kagari", type="vn:character", properties={"name": "篝"}),
        line(kind="resource", id="resource:voice", type="core:resource", resourceType="audio", locator={"source": {"rootId": "g", "path": "a"}}, properties={}),
        line(kind="evidence", id="evidence:1", type="x:y", properties={}),
        line(kind="relation", id="relation:1", subject="character:kagari", predicate="vn:voiceResource", object={"kind": "entity", "id": "resource:voice"}, evidenceIds=["evidence:1"], status="user-confirmed"),
        line(kind="relation", id="relation:2", subject="resource:voice", predicate="vn:voiceResource", object={"kind": "literal", "value": "x"}, evidenceIds=["evidence:2"], status="candidate"),
        line(kind="relation", id="relation:3", subject="nobody", predicate="no:such", object={"kind": "entity", "id": "z"}, evidenceIds=[], status="verified"),
    ]
    (tmp_path / "c.jsonl").write_text("\n".join(records))
    catalog = catalogs.Catalog(catalogs.lines(spark, str(tmp_path / "c.jsonl")))
    nodes, relations = catalog.query(entity_type="vn:character", query="篝", predicate="vn:voiceResource")
    assert [r.id for r in nodes.collect()] == ["character:kagari"] and [r.id for r in relations.collect()] == ["relation:1"]
    assert {r.path for r in catalog.issues().collect()} == {"relation:2.subject", "relation:2.object", "relation:2.evidenceIds"}
    s = catalog.summary().first()
    assert (s.records, s.entities, s.resources, s.relations, s.evidence, s.user_confirmed, s.candidate, s.rejected) == (6, 1, 1, 3, 1, 1, 1, 0)
    plain = catalog.records.drop("line")
    assert sinks.write_catalog(plain, str(tmp_path / "out"), {"game": "g"}) == sinks.write_catalog(plain.orderBy(F.desc("id")), str(tmp_path / "out"), {"game": "g"})


def test_format_list(spark, tmp_path):
    (tmp_path / "list.md").write_text("| id | kind |\n| abc-x | archive | Name | pak dat | f.ts:1 | 10 | 7 | sig+fb+p-1 | 4142@1 5a | - | - |\n| def | image | N | - | f.ts:2 | 10 | 3 | any | - | - | - |\n")
    known, signatures = formats.read_list(spark, str(tmp_path / "list.md"))
    rows = {r.format_id: r for r in known.collect()}
    assert rows["abc-x"].extensions == ["pak", "dat"] and rows["abc-x"].priority == -1 and rows["abc-x"].ext_fallback and rows["def"].extensions == []
    files = spark.createDataFrame([("p", b"xAB"), ("q", b"Z"), ("r", b"")], "path string, content binary")
    assert sorted(r.path for r in formats.matched(files, signatures).collect()) == ["p", "q"]


def test_tasks(spark):
    tasks = Tasks(spark, kept=3)
    done = tasks.wait(tasks.submit(lambda s, report: report(0.5, "half") or s.range(10).count(), key="k").id)
    assert (done.state, done.result) == ("completed", 10) and done.revision >= 3
    assert tasks.submit(lambda s, r: 1, key="k").id == done.id
    assert tasks.wait(tasks.submit(lambda s, r: {"status": "partial"}).id).state == "partial"
    assert "zero" in tasks.wait(tasks.submit(lambda s, r: 1 / 0).id).error
    slow = tasks.submit(lambda s, r: s.range(1 << 40).selectExpr("sum(id % 7)").collect())
    assert tasks.wait(slow.id, seconds=0.5).state == "running"
    assert tasks.cancel(slow.id).state == "cancelled" and len(list(tasks)) == 3
    for _ in range(100):  # its jobs end too
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.1)
    else:
        pytest.fail("a cancelled task's job goes on")


def test_bmp_is_an_archive_of_one():
    found = archives.default_registry().open(codecs.write_bmp(2, 2, 8, bytes(4), bytes(1024)), "x.bmp")
    assert found[0].format_id == "bmp" and len(found[1]) == 1


def test_pictures_are_listed_by_their_headers():
    """Run-length BMP and interlaced PNG: an entry each; a broken header has none."""
    runs = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 1082, 0, 0, 1078, 40, 2, 2, 1, 8, 1, 4, 0, 0, 0, 0) + bytes(1024) + b"\2\0\0\0\2\0\0\1"
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    laced = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")
    for data, kind in ((runs, "bmp"), (laced, "png")):
        found = archives.default_registry().open(data, f"x.{kind}")
        assert found[0].format_id == kind and len(found[1]) == 1
        with pytest.raises(archives.InvalidArchive):
            archives.default_registry().open(data[:30], f"x.{kind}")
