from __future__ import annotations

import bz2
import hashlib
import lzma
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arkline.functions import binary, codecs, hashing, paths
from arkline.operators import verify


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/*.tjs", ["a.tjs", "x/y/a.tjs"], ["a.tjsx", "tjs"]), ("*.png", ["a.png"], ["x/a.png"]), ("a/**", ["a/b", "a/b/c"], ["b/a"]), ("{a,b}/?.t[xy]t", ["a/1.txt", "b/2.tyt"], ["c/1.txt", "a/12.txt"]), ("a.b", ["a.b"], ["aXb"])])
def test_globs(glob, yes, no):
    pattern = re.compile(paths.glob_regex(glob))
    assert all(pattern.match(x) for x in yes) and not any(pattern.match(x) for x in no)


@pytest.mark.parametrize("bad", ["", "/a", "c:/x", "a/../b", "a\0b"])
def test_bad_globs(bad):
    with pytest.raises(ValueError, match="pattern"):
        paths.check_globs([bad])
    with pytest.raises(ValueError, match="most"):
        paths.check_globs(["a"] * 33)


def test_cursor():
    assert paths.path_of(paths.cursor_of("画像/a.bin")) == "画像/a.bin"
    for bad in ("", "a", "YQ=="):
        with pytest.raises(ValueError, match="cursor"):
            paths.path_of(bad)


def test_paths(spark):
    given = ["a/b.PNG", "../x", "a//b", "/abs", "a/nul.txt", "a/b.", "c:/x", "dir.x/name", "ok", "a\\b.txt", ""]
    df = spark.createDataFrame([(p,) for p in given], "p string")
    p = F.col("p")
    got = df.select(paths.unsafe(p), paths.extension(p), paths.last_dot_extension(p), paths.raw_path(p), paths.output_path(p, F.lit("bmp"))).collect()
    assert [r[0] for r in got] == [False, True, True, True, True, True, True, False, False, False, True]
    assert [r[1] for r in got][:1] == ["png"] and got[7][1] == "" and got[7][2] == "x/name"
    assert got[9][3] == "a\\b.txt" and got[0][3] is None and got[8][4] == "ok.bmp" and got[0][4] == "a/b.PNG"


def test_hashes(spark):
    data = [b"", b"a", b"hello", bytes(range(256))]
    got = spark.createDataFrame([(d,) for d in data], "d binary").select(hashing.sha256(F.col("d")), hashing.crc32(F.col("d")), hashing.adler32("d")).collect()
    assert [tuple(r) for r in got] == [(hashlib.sha256(d).hexdigest(), zlib.crc32(d), zlib.adler32(d)) for d in data]
    assert hashing.crc32_plain(b"123456789") == 0xFC891918
    assert hashing.canonical({"b": [1, {"d": None, "c": "é"}], "a": True}) == '{"a":true,"b":[1,{"c":"é","d":null}]}'
    rows = spark.createDataFrame([("x",), ("y",), ("y",)], "j string")
    one, other = (df.agg(hashing.digest(F.col("j"))).first()[0] for df in (rows, rows.orderBy(F.desc("j"))))
    assert one == other != rows.distinct().agg(hashing.digest(F.col("j"))).first()[0]
    assert spark.createDataFrame([("画像.bin".encode("cp932") + b"\0xx",)], "b binary").select(hashing.decode_cp932("b")).first()[0] == "画像.bin"


def test_standard_codecs():
    data = b"some text that repeats, some text that repeats " * 20
    assert codecs.inflate(zlib.compress(data), len(data)) == data
    assert codecs.bunzip2(bz2.compress(data)) == data
    assert codecs.lzma_alone(lzma.compress(data, lzma.FORMAT_ALONE)) == data
    for bad in (lambda: codecs.inflate(zlib.compress(data)[:-9]), lambda: codecs.inflate(zlib.compress(data), 3), lambda: codecs.inflate(zlib.compress(data), cap=10), lambda: codecs.bunzip2(b"xx")):
        with pytest.raises(ValueError):  # noqa: PT011
            bad()


def lzss_packed(data: bytes) -> bytes:
    """An encoder of its own: literals, and matches where the last bytes repeat."""
    out, i = bytearray(), 0
    while i < len(data):
        control, body = 0, bytearray()
        for bit in range(8):
            if i >= len(data):
                break
            best, where = 0, 0
            for j in range(max(0, i - 4000), i):
                n = 0
                while n < 18 and i + n < len(data) and data[j + n] == data[i + n]:
                    n += 1
                if n > best:
                    best, where = n, j
            if best >= 3:
                place = (where + 0xFEE) % 4096
                body += bytes([place & 255, place >> 4 & 0xF0 | best - 3])
                i += best
            else:
                control |= 1 << bit
                body.append(data[i])
                i += 1
        out += bytes([control]) + body
    return bytes(out)


def test_lzss():
    data = b"abcabcabcabcabc" + bytes(range(50)) + b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + b"abcabc"
    packed = lzss_packed(data)
    assert codecs.lzss(packed) == data and codecs.lzss(packed, 20) == data[:20] and codecs.lzss(packed, 1000) == data


def test_lz4():
    assert codecs.lz4_block(b"\x14a\x01\x00" + b"\x50bcdef") == b"a" * 9 + b"bcdef"
    frame = b"\x04\x22\x4d\x18\x60\x40\x82" + struct.pack("<I", 3 | 1 << 31) + b"xyz" + b"\0\0\0\0"
    assert codecs.lz4_frame(frame) == b"xyz"
    with pytest.raises(ValueError, match="before"):
        codecs.lz4_block(b"\x14a\x05\x00\x10b")


def test_bits_and_huffman():
    m, n = codecs.MsbBits(b"\xa5\x0f"), codecs.LsbBits(b"\xa5\x0f")
    assert [m.read(4), m.read(8), m.read(4)] == [0xA, 0x50, 0xF] and [n.read(4), n.read(8)] == [5, 0xFA]
    # a node of the leaves a and b, then a b b a
    bits = "1" + "0" + f"{97:08b}" + "0" + f"{98:08b}" + "0110"
    packed = int(bits.ljust(24, "0"), 2).to_bytes(3, "big")
    assert codecs.huffman_tree(packed, 4) == b"abba"


def test_random_and_ciphers():
    rand = codecs.msvc_random(1)
    assert [next(rand) for _ in range(3)] == [41, 18467, 6334]
    mt = codecs.mersenne_twister(5489)
    assert next(mt) == 3499211612
    assert codecs.rc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3"
    assert codecs.xor(b"abc", b"\x01\x02", 1) == bytes([97 ^ 2, 98 ^ 1, 99 ^ 2])
    aes = codecs.Aes(bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"))
    assert aes.block(bytes.fromhex("6bc1bee22e409f96e93d7e117393172a")).hex() == "3ad77bb40d7a3660a89ecaf32466ef97"
    assert aes.cfb8_decrypt(bytes.fromhex("3b79424c9c0dd436bace9e0ed4586a4f32b9"), bytes(range(16))).hex() == "6bc1bee22e409f96e93d7e117393172aae2d"
    assert codecs.rc6_decrypt(bytes.fromhex("8fc3a53656b1f778c129df4e9848a41e"), codecs.rc6_keys(bytes(16))) == bytes(16)


def test_pictures_and_sound():
    pixels = bytes(range(24))
    assert codecs.read_bmp(codecs.write_bmp(4, 2, 24, pixels)) == (4, 2, 24, pixels)
    assert codecs.read_wave(codecs.write_wave(2, 44100, 16, b"\1\2\3\4")) == (2, 44100, 16, b"\1\2\3\4")
    rows = b"".join(bytes([f]) + r for f, r in ((0, b"\1\2\3"), (1, b"\1\1\1"), (2, b"\1\1\1"), (3, b"\4\4\4"), (4, b"\1\1\1")))
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    w, h, bits, out = codecs.read_png(png)
    assert (w, h, bits) == (3, 5, 8) and out[:9] == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4]) and out[9:12] == bytes([5, 8, 10]) and out[12:] == bytes([6, 9, 11])
    assert codecs.dxt1(struct.pack("<HHI", 0xF800, 0x001F, 0b0100), 2, 1) == bytes([0, 0, 255, 255, 255, 0, 0, 255])


def test_wave_report():
    good = codecs.write_wave(1, 8000, 16, b"\0" * 16000)
    assert verify.wave_report(good)["valid"] and verify.wave_report(good)["seconds"] == 1.0
    assert not verify.wave_report(good[:-5])["valid"] and not verify.wave_report(b"RIFF")["valid"]
    assert verify.wave_report(codecs.write_wave(0, 8000, 16, b""))["warnings"]


def test_decoded_fails_alone(spark):
    rows = spark.createDataFrame([("zlib", zlib.compress(b"x")), ("zlib", b"junk"), ("nothing", b"x"), ("none", None)], "c string, d binary")
    got = [r[0] for r in rows.select(codecs.decoded("c", "d")).collect()]
    assert bytes(got[0].bytes) == b"x" and got[1].error and got[2].error and got[3].bytes is None


def test_blowfish():
    b = codecs.Blowfish(bytes(8))
    assert b.encrypt(bytes(8)).hex() == "4ef997456198dd78" and b.decrypt(bytes.fromhex("4ef997456198dd78")) == bytes(8)
    assert codecs.Blowfish(bytes.fromhex("0123456789abcdef")).encrypt(bytes.fromhex("1111111111111111")).hex() == "61f9c3802281b096"


def test_binary(spark):
    df = spark.createDataFrame([(bytes(range(1, 9)),)], "c binary")
    c = F.col("c")
    assert tuple(df.select(binary.le_number(c, 0, 4), binary.be_number(c, 1, 3), binary.range_read(c, 2, 3)).first()) == (0x04030201, 0x020304, bytearray(b"\3\4\5"))
    with pytest.raises(Exception, match="INVALID_ARCHIVE"):
        df.select(binary.range_read(c, 6, 3)).collect()
    assert list(binary.chunks(b"abcdefg", 1, 5, 2)) == [b"bc", b"de", b"f"]
    assert binary.joined_range([b"abc", b"", b"defg"], 2, 3) == b"cde"
    cursor = binary.Cursor(b"\1\2\3\xffab\0c\0\0\0")
    assert (cursor.u(3), cursor.i(1), cursor.text(), cursor.text(3)) == (0x030201, -1, "ab", "c")
    with pytest.raises(ValueError, match="outside"):
        cursor.take(9)


def test_executables():
    body, rsrc = b"CODE" * 4, 0x2000
    leaf = struct.pack("<IIII", rsrc + 0x58, 5, 0, 0)
    tree = b"".join([struct.pack("<12xHH", 0, 1) + struct.pack("<II", 10, 1 << 31 | 0x18), struct.pack("<12xHH", 0, 1) + struct.pack("<II", 7, 1 << 31 | 0x30), struct.pack("<12xHH", 0, 1) + struct.pack("<II", 1033, 0x48), leaf, b"hello"])
    optional = struct.pack("<H", 0x10B).ljust(96, b"\0") + struct.pack("<II", 0, 0) * 2 + struct.pack("<II", rsrc, len(tree))
    sections = [(b".text", 16, 0x1000, 16, 0x200), (b".rsrc", len(tree), rsrc, len(tree), 0x210)]
    head = b"MZ".ljust(60, b"\0") + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH12xHH", 0x14C, 2, len(optional), 0) + optional + b"".join(struct.pack("<8sIIII16x", *s) for s in sections)
    data = head.ljust(0x200, b"\0") + body + tree + b"OVERLAY"
    assert data[binary.executable_overlay(data) :] == b"OVERLAY"
    assert binary.address_offset(data, 0x1004) == 0x204 and binary.address_offset(data, 0x9000) is None
    optional_fixed = binary._sections(data)[2]
    data = data[: optional_fixed + 16] + struct.pack("<I", rsrc) + data[optional_fixed + 20 :]
    assert binary.executable_resources(data) == {(10, 7, 1033): b"hello"}
    with pytest.raises(ValueError, match="executable"):
        binary.executable_overlay(b"xx")


def test_isaac64_is_even_and_repeats():
    one, other = codecs.Isaac64([1, 2, 3]), codecs.Isaac64([1, 2, 3])
    got = [one.next() for _ in range(2000)]
    assert got == [other.next() for _ in range(2000)] and len(set(got)) == 2000
    assert abs(sum(x.bit_count() for x in got) / 2000 - 32) < 0.5 and codecs.Isaac64([1, 2, 4]).next() != got[0]


def test_dxt_alpha():
    colours = struct.pack("<HHI", 0xF800, 0x001F, 0b0100)
    assert codecs.dxt3(bytes([0xF0]) + bytes(7) + colours, 2, 1) == bytes([0, 0, 255, 0, 255, 0, 0, 255])
    assert codecs.dxt5(bytes([255, 0, 0b001000, 0, 0, 0, 0, 0]) + colours, 2, 1) == bytes([0, 0, 255, 255, 255, 0, 0, 0])


def test_tiff():
    pixels = bytes(range(12))
    # codes of nine bits: clear, twelve literals, end
    packed = int("".join(f"{c:09b}" for c in [256, *pixels, 257]).ljust(128, "0"), 2).to_bytes(16, "big")
    for kind, body in ((1, pixels), (5, packed), (8, zlib.compress(pixels)), (32773, bytes([11]) + pixels)):
        tags = [(256, 3, 4), (257, 3, 3), (258, 3, 8), (259, 3, kind), (273, 4, 8), (278, 3, 3), (279, 4, len(body))]
        ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + bytes(4)
        data = b"II*\0" + struct.pack("<I", 8 + len(body)) + body + ifd
        assert codecs.read_tiff(data) == (4, 3, 8, pixels)


@pytest.mark.parametrize(("bits", "depth", "colour"), [(1, 1, 0), (2, 2, 3), (4, 4, 0), (8, 8, 3), (16, 8, 4), (24, 8, 2), (32, 8, 6), (64, 16, 6)])
@pytest.mark.parametrize(("width", "height"), [(1, 1), (3, 2), (5, 9), (17, 8)])
def test_interlaced_png(bits, depth, colour, width, height):
    """Pixels dealt to seven passes, by their places in an 8 by 8 square, come back in order."""
    order = ["16462646", "77777777", "56565656", "77777777", "36463646", "77777777", "56565656", "77777777"]
    rng = np.random.default_rng(bits * width + height)
    pixels = rng.integers(0, 2, (height, width, bits), dtype=np.uint8)
    packed = b""
    for step in "1234567":
        for y in range(height):
            line = [pixels[y, x] for x in range(width) if order[y % 8][x % 8] == step]
            if line:
                packed += b"\0" + np.packbits(np.concatenate(line)).tobytes()
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 1)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(packed)) + chunk(b"IEND", b"")
    want = b"".join(np.packbits(pixels[y].reshape(-1)).tobytes() for y in range(height))
    assert codecs.read_png(png) == (width, height, bits, want)


def _run_bmp(bits, packing, width, height, body):
    colours = bytes(4 << bits)
    start = 54 + len(colours)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + len(body), 0, 0, start, 40, width, height, 1, bits, packing, len(body), 0, 0, 0, 0) + colours + body


def test_run_length_bmp():
    eight = b"\3\7\0\3\1\2\3\0" + b"\0\0" + b"\0\2\1\1" + b"\2\5\0\1"
    assert codecs.read_bmp(_run_bmp(8, 1, 6, 3, eight)) == (6, 3, 8, bytes([0, 5, 5, 0, 0, 0]) + bytes(6) + bytes([7, 7, 7, 1, 2, 3]))
    assert codecs.read_bmp(_run_bmp(8, 1, 6, -3, eight))[3][:6] == bytes([7, 7, 7, 1, 2, 3])
    four = b"\3\x12\0\5\x34\x56\x70\0" + b"\0\1"
    assert codecs.read_bmp(_run_bmp(4, 2, 8, 1, four)) == (8, 1, 4, bytes([0x12, 0x13, 0x45, 0x67]))
    for body in (b"\7\1", b"\0\5\1", b"\0\2\1", b"\0\0\1\1"):
        with pytest.raises(ValueError, match="cut short|beyond"):
            codecs.read_bmp(_run_bmp(8, 1, 5, 1, body))
