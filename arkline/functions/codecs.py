"""Decoders: bytes to bytes.  Each raises ValueError on damaged input; sizes are capped by whoever calls."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAP = 256 << 20


# --- deflate, bzip2, LZMA


def inflate(data: bytes, expected: int | None = None, cap: int = CAP, raw: bool = False) -> bytes:
    d = zlib.decompressobj(-15 if raw else 15)
    try:
        out = d.decompress(data, cap + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(out) > cap:
        raise ValueError("more than the cap")
    if not d.eof:
        raise ValueError("the stream is cut short")
    if expected is not None and len(out) != expected:
        raise ValueError(f"{len(out)} bytes, expected {expected}")
    return out


def bunzip2(data: bytes, cap: int = CAP) -> bytes:
    try:
        out = bz2.BZ2Decompressor().decompress(data, cap + 1)
    except OSError as e:
        raise ValueError(str(e)) from e
    if len(out) > cap:
        raise ValueError("more than the cap")
    return out


def lzma_raw(data: bytes, properties: bytes, size: int) -> bytes:
    """A raw LZMA stream with its five bytes of properties."""
    code, dictionary = properties[0], struct.unpack_from("<I", properties, 1)[0]
    if code >= 225:
        raise ValueError("no LZMA properties")
    chain = [{"id": lzma.FILTER_LZMA1, "lc": code % 9, "lp": code // 9 % 5, "pb": code // 45, "dict_size": max(4096, dictionary)}]
    try:
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain).decompress(data, size)
    except lzma.LZMAError as e:
        raise ValueError(str(e)) from e
    if len(out) != size:
        raise ValueError("the stream is cut short")
    return out


def lzma_alone(data: bytes, cap: int = CAP) -> bytes:
    size = struct.unpack_from("<Q", data, 5)[0]
    if size != (1 << 64) - 1:
        if size > cap:
            raise ValueError("more than the cap")
        return lzma_raw(data[13:], data[:5], size)
    try:
        return lzma.LZMADecompressor(lzma.FORMAT_ALONE).decompress(data, cap)
    except lzma.LZMAError as e:
        raise ValueError(str(e)) from e


# --- LZ families


def overlapped_copy(out: bytearray, distance: int, n: int) -> None:
    """Copies from ``distance`` bytes back, over what it writes itself."""
    if not 0 < distance <= len(out):
        raise ValueError("a match from before the start")
    if distance >= n:
        at = len(out) - distance
        out += out[at : at + n]
    else:
        piece = bytes(out[-distance:])
        out += (piece * (n // distance + 1))[:n]


def lzss(data: bytes, size: int | None = None, ring: int = 4096, fill: int = 0, start: int = 0xFEE, literal: int = 1, cap: int = 1 << 30) -> bytes:
    """LZSS with a ring: control bits from the lowest; a match is two bytes, 12 bits of place and 4 of length less 3.

    With ``size`` it ends there, or quietly with the input; without, with the input."""
    window, out, at, i = bytearray([fill]) * ring, bytearray(), start, 0
    limit = cap if size is None else size
    while i < len(data) and len(out) < limit:
        control = data[i]
        i += 1
        for bit in range(8):
            if i >= len(data) or len(out) >= limit:
                break
            if control >> bit & 1 == literal:
                window[at] = data[i]
                out.append(data[i])
                at = (at + 1) % ring
                i += 1
                continue
            if i + 1 >= len(data):
                i = len(data)
                break
            low, high = data[i], data[i + 1]
            i += 2
            place = (high & 0xF0) << 4 | low
            for k in range(min(3 + (high & 15), limit - len(out))):
                b = window[(place + k) % ring]
                window[at] = b
                out.append(b)
                at = (at + 1) % ring
    if size is None and len(out) >= cap:
        raise ValueError("more than the cap")
    return bytes(out)


def lz4_block(data: bytes, cap: int = CAP, before: bytes = b"") -> bytes:
    out, i = bytearray(before), 0

    def more(n: int) -> int:
        nonlocal i
        if n == 15:
            while True:
                if i >= len(data):
                    raise ValueError("a length is cut short")
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        return n

    while i < len(data):
        token = data[i]
        i += 1
        n = more(token >> 4)
        if i + n > len(data):
            raise ValueError("literals are cut short")
        out += data[i : i + n]
        i += n
        if i == len(data):
            break
        if i + 2 > len(data):
            raise ValueError("a distance is cut short")
        distance = data[i] | data[i + 1] << 8
        i += 2
        overlapped_copy(out, distance, more(token & 15) + 4)
        if len(out) - len(before) > cap:
            raise ValueError("more than the cap")
    return bytes(out[len(before) :])


def lz4_frame(data: bytes, cap: int = CAP) -> bytes:
    if data[:4] != b"\x04\x22\x4d\x18":
        raise ValueError("not an LZ4 frame")
    flags, i, out = data[4], 6, bytearray()
    if flags >> 6 != 1:
        raise ValueError("an unknown version")
    i += 8 * bool(flags & 8) + 4 * bool(flags & 1) + 1
    while True:
        n = struct.unpack_from("<I", data, i)[0]
        i += 4
        if n == 0:
            break
        block = data[i : i + (n & 0x7FFFFFFF)]
        i += len(block) + 4 * bool(flags & 16)
        out += block if n >> 31 else lz4_block(block, cap, b"" if flags & 32 else bytes(out[-65536:]))
        if len(out) > cap:
            raise ValueError("more than the cap")
    return bytes(out)


def rle_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


# --- bits


class MsbBits:
    """Reads bits from the highest of each byte."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the bits are cut short")
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:end], "big") >> (8 * end - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)


class LsbBits(MsbBits):
    """Reads bits from the lowest of each byte."""

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the bits are cut short")
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:end], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


def huffman_tree(data: bytes, size: int) -> bytes:
    """A tree of bits (1: a node, 0: a leaf of eight bits), then the codes of ``size`` bytes."""
    bits = MsbBits(data)

    def tree(depth: int = 0):
        if depth > 255:
            raise ValueError("a tree that is too deep")
        if bits.read(1):
            return tree(depth + 1), tree(depth + 1)
        return bits.read(8)

    root, out = tree(), bytearray()
    while len(out) < size:
        node = root
        while isinstance(node, tuple):
            node = node[bits.read(1)]
        out.append(node)
    return bytes(out)


# --- random numbers


def msvc_random(seed: int) -> Iterator[int]:
    while True:
        seed = (seed * 214013 + 2531011) & 0xFFFFFFFF
        yield seed >> 16 & 0x7FFF


def mersenne_twister(seed: int) -> Iterator[int]:
    s = [seed & 0xFFFFFFFF]
    for i in range(1, 624):
        s.append((1812433253 * (s[-1] ^ s[-1] >> 30) + i) & 0xFFFFFFFF)
    while True:
        for i in range(624):
            y = s[i] & 0x80000000 | s[(i + 1) % 624] & 0x7FFFFFFF
            s[i] = s[(i + 397) % 624] ^ y >> 1 ^ (0x9908B0DF if y & 1 else 0)
        for y in list(s):
            y ^= y >> 11
            y ^= y << 7 & 0x9D2C5680
            y ^= y << 15 & 0xEFC60000
            yield y ^ y >> 18


# --- ciphers


def rc4(data: bytes, key: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def xor(data: bytes, key: bytes, start: int = 0) -> bytes:
    """Each byte with the key's, repeated from ``start``."""
    import numpy as np

    k = np.frombuffer(key, np.uint8)
    at = (np.arange(len(data)) + start) % len(k)
    return (np.frombuffer(data, np.uint8) ^ k[at]).tobytes()


def _times2(x: int) -> int:
    return (x << 1 ^ (0x11B if x & 0x80 else 0)) & 0xFF


def _aes_box() -> list[int]:
    """The substitution box by its rule: the inverse in the field, then an affine map."""
    powers, x = [], 1
    for _ in range(255):
        powers.append(x)
        x ^= _times2(x)
    log = {p: i for i, p in enumerate(powers)}
    out = []
    for i in range(256):
        v = powers[-log[i] % 255] if i else 0
        out.append(v ^ 0x63 ^ (v << 1 | v >> 7) & 255 ^ (v << 2 | v >> 6) & 255 ^ (v << 3 | v >> 5) & 255 ^ (v << 4 | v >> 4) & 255)
    return out


_BOX = _aes_box()


class Aes:
    """The block cipher, encrypting only: the feedback modes need no more."""

    def __init__(self, key: bytes) -> None:
        n = len(key) // 4
        if n not in (4, 6, 8) or len(key) % 4:
            raise ValueError("keys have 16, 24 or 32 bytes")
        words, round_ = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if i % n == 0:
                w = [_BOX[b] for b in w[1:] + w[:1]]
                w[0] ^= round_
                round_ = _times2(round_)
            elif n == 8 and i % n == 4:
                w = [_BOX[b] for b in w]
            words.append([a ^ b for a, b in zip(words[-n], w, strict=True)])
        self.keys = [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]

    def block(self, data: bytes) -> bytes:
        s = [a ^ b for a, b in zip(data, self.keys[0], strict=True)]
        for r, key in enumerate(self.keys[1:], 1):
            s = [_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < len(self.keys) - 1:
                t = []
                for c in range(0, 16, 4):
                    a = s[c : c + 4]
                    every = a[0] ^ a[1] ^ a[2] ^ a[3]
                    t += [a[i] ^ every ^ _times2(a[i] ^ a[(i + 1) % 4]) for i in range(4)]
                s = t
            s = [a ^ b for a, b in zip(s, key, strict=True)]
        return bytes(s)

    def cfb8_decrypt(self, data: bytes, iv: bytes) -> bytes:
        register, out = iv, bytearray()
        for b in data:
            out.append(b ^ self.block(register)[0])
            register = register[1:] + bytes([b])
        return bytes(out)


def rc6_keys(key: bytes, rounds: int = 20) -> list[int]:
    """The key schedule of RC6-32."""
    left = lambda x, n: (x << (n & 31) | x >> (32 - (n & 31))) & 0xFFFFFFFF if n & 31 else x
    words = [int.from_bytes(key[i : i + 4], "little") for i in range(0, len(key), 4)] or [0]
    s = [(0xB7E15163 + i * 0x9E3779B9) & 0xFFFFFFFF for i in range(2 * rounds + 4)]
    a = b = i = j = 0
    for _ in range(3 * max(len(words), len(s))):
        a = s[i] = left((s[i] + a + b) & 0xFFFFFFFF, 3)
        b = words[j] = left((words[j] + a + b) & 0xFFFFFFFF, a + b)
        i, j = (i + 1) % len(s), (j + 1) % len(words)
    return s


def rc6_decrypt(block: bytes, s: list[int]) -> bytes:
    left = lambda x, n: (x << (n & 31) | x >> (32 - (n & 31))) & 0xFFFFFFFF if n & 31 else x
    a, b, c, d = struct.unpack("<4I", block)
    rounds = (len(s) - 4) // 2
    c, a = (c - s[-1]) & 0xFFFFFFFF, (a - s[-2]) & 0xFFFFFFFF
    for i in range(rounds, 0, -1):
        a, b, c, d = d, a, b, c
        u, t = left(d * (2 * d + 1) & 0xFFFFFFFF, 5), left(b * (2 * b + 1) & 0xFFFFFFFF, 5)
        c = left((c - s[2 * i + 1]) & 0xFFFFFFFF, -t & 31) ^ u
        a = left((a - s[2 * i]) & 0xFFFFFFFF, -u & 31) ^ t
    d, b = (d - s[1]) & 0xFFFFFFFF, (b - s[0]) & 0xFFFFFFFF
    return struct.pack("<4I", a, b, c, d)


# --- pictures and sound


def write_bmp(width: int, height: int, bits: int, pixels: bytes, palette: bytes = b"", bottom_up: bool = False) -> bytes:
    """A BMP of packed rows (top down unless told otherwise) of 1, 4, 8, 16, 24 or 32 bits."""
    row = (width * bits + 7) // 8
    if len(pixels) < row * height:
        raise ValueError("too few pixels")
    stride = (row + 3) // 4 * 4
    order = range(height) if bottom_up else range(height - 1, -1, -1)
    body = b"".join(pixels[y * row : (y + 1) * row].ljust(stride, b"\0") for y in order)
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(body), 2835, 2835, len(palette) // 4, 0) + palette + body


def bmp_header(data: bytes) -> tuple[int, int, int, int, int]:
    """start of the pixels, width, height (negative: from the top), bits and packing of a BMP, run-length or not."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    start, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if width <= 0 or not height or size < 40 or packing > 3 or (packing in (1, 2) and bits != 8 // packing):
        raise ValueError("a kind of BMP that isn't read")
    if start + (0 if packing in (1, 2) else (width * bits + 31) // 32 * 4 * abs(height)) > len(data):
        raise ValueError("the pixels are cut short")
    return start, width, height, bits, packing


def read_bmp(data: bytes) -> tuple[int, int, int, bytes]:
    """width, height, bits and packed rows from the top of a BMP, run-length or not."""
    start, width, height, bits, packing = bmp_header(data)
    if packing in (1, 2):
        lines = _runs(data[start:], width, abs(height), bits)
        return width, abs(height), bits, b"".join(lines[::-1] if height > 0 else lines)
    row, stride = (width * bits + 7) // 8, (width * bits + 31) // 32 * 4
    lines = [data[start + y * stride : start + y * stride + row] for y in range(abs(height))]
    return width, abs(height), bits, b"".join(lines[::-1] if height > 0 else lines)


def _runs(data: bytes, width: int, height: int, bits: int) -> list[bytes]:
    """The packed rows, as stored, of run-length pixels of 8 or 4 bits; pixels that are skipped are 0."""
    pixels, x, y, at = [bytearray(width) for _ in range(height)], 0, 0, 0

    def put(values: bytes) -> None:
        nonlocal x
        if y >= height or x + len(values) > width + 1:  # an odd run of half bytes may end one past the row
            raise ValueError("a run beyond the picture")
        pixels[y][x : x + len(values)] = values[: width - x]
        x += len(values)

    nibbles = lambda part: bytes(v for b in part for v in (b >> 4, b & 15))
    while at + 2 <= len(data):
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            put(bytes([v]) * n if bits == 8 else (nibbles([v]) * (n // 2 + 1))[:n])
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            if at + 2 > len(data):
                raise ValueError("a step is cut short")
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = v if bits == 8 else (v + 1) // 2
            part = data[at : at + size]
            if len(part) < size:
                raise ValueError("a run is cut short")
            put(part if bits == 8 else nibbles(part)[:v])
            at += size + size % 2
    if bits == 8:
        return [bytes(p) for p in pixels]
    return [bytes((p[i] << 4) | (p[i + 1] if i + 1 < width else 0) for i in range(0, width, 2)) for p in pixels]


def write_wave(channels: int, rate: int, bits: int, pcm: bytes) -> bytes:
    align = channels * bits // 8
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * align, align, bits)
    body = form + struct.pack("<4sI", b"data", len(pcm)) + pcm + b"\0" * (len(pcm) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body


def read_wave(data: bytes) -> tuple[int, int, int, bytes]:
    """channels, rate, bits, samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at, form = 12, None
    while at + 8 <= len(data):
        tag, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if tag == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif tag == b"data" and form:
            return form[1], form[2], form[5], data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def png_header(data: bytes) -> tuple[int, int, int, int, int, int, int]:
    """width, height, depth, colour, packing, filter and interlace of a PNG, interlaced or not."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[8:16] != b"\0\0\0\rIHDR" or len(data) < 33:
        raise ValueError("not a PNG")
    head = struct.unpack_from(">IIBBBBB", data, 16)
    if not head[0] or not head[1] or head[2] not in (1, 2, 4, 8, 16) or head[3] not in (0, 2, 3, 4, 6) or head[4] or head[5] or head[6] > 1:
        raise ValueError("not a PNG")
    return head


# The seven passes of an interlaced PNG (first column and row, steps of both).
ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def read_png(data: bytes) -> tuple[int, int, int, bytes]:
    """width, height, bits of a pixel and unfiltered rows of a PNG, put in order if it is interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if tag == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif tag == b"IDAT":
            packed += body
        elif tag == b"IEND":
            break
        at += 12 + n
    if not head or head[6] > 1 or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("a kind of PNG that isn't read")
    width, height, depth, colour, _, _, laced = head
    bits = depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    passes = [p for p in (ADAM7 if laced else [(0, 0, 1, 1)]) if p[0] < width and p[1] < height]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    raw = inflate(packed, sum(((w * bits + 7) // 8 + 1) * h for w, h in sizes))
    if not laced:
        return width, height, bits, b"".join(_unfiltered(raw, (width * bits + 7) // 8, height, bits))
    stride = (width * bits + 7) // 8
    out, at = bytearray(stride * height), 0
    for (x, y, dx, dy), (w, h) in zip(passes, sizes, strict=True):
        row = (w * bits + 7) // 8
        for i, line in enumerate(_unfiltered(raw[at : at + (row + 1) * h], row, h, bits)):
            place = (y + i * dy) * stride
            if bits >= 8:
                n = bits // 8
                for k in range(n):
                    out[place + x * n + k : place + stride : dx * n] = line[k : w * n : n]
            else:
                for j in range(w):
                    pixel, to = line[j * bits // 8] >> (8 - bits - j * bits % 8) & ((1 << bits) - 1), (x + j * dx) * bits
                    out[place + to // 8] |= pixel << (8 - bits - to % 8)
        at += (row + 1) * h
    return width, height, bits, bytes(out)


def _unfiltered(raw: bytes, row: int, height: int, bits: int) -> Iterator[bytes]:
    """The rows of a pass, each after a byte that names its filter."""
    step, before = max(1, bits // 8), bytes(row)
    for y in range(height):
        kind, line = raw[y * (row + 1)], bytearray(raw[y * (row + 1) + 1 : (y + 1) * (row + 1)])
        for i in range(row if kind else 0):
            a, b, c = (line[i - step], before[i], before[i - step]) if i >= step else (0, before[i], 0)
            if kind == 1:
                p = a
            elif kind == 2:
                p = b
            elif kind == 3:
                p = (a + b) // 2
            else:
                near = a + b - c
                p = min((a, b, c), key=lambda v: (abs(near - v), (a, b, c).index(v)))
            line[i] = (line[i] + p) & 255
        before = bytes(line)
        yield before


def dxt1(data: bytes, width: int, height: int) -> bytes:
    """32-bit BGRA pixels of DXT1 blocks."""
    out = bytearray(width * height * 4)
    at = 0

    def colour(v: int) -> tuple[int, int, int]:
        r, g, b = v >> 11, v >> 5 & 63, v & 31
        return b << 3 | b >> 2, g << 2 | g >> 4, r << 3 | r >> 2

    for y0 in range(0, height, 4):
        for x0 in range(0, width, 4):
            c0, c1, bits = struct.unpack_from("<HHI", data, at)
            at += 8
            p, q = colour(c0), colour(c1)
            if c0 > c1:
                table = [(*p, 255), (*q, 255), (*((2 * a + b) // 3 for a, b in zip(p, q, strict=True)), 255), (*((a + 2 * b) // 3 for a, b in zip(p, q, strict=True)), 255)]
            else:
                table = [(*p, 255), (*q, 255), (*((a + b) // 2 for a, b in zip(p, q, strict=True)), 255), (0, 0, 0, 0)]
            for i in range(16):
                x, y = x0 + i % 4, y0 + i // 4
                if x < width and y < height:
                    k = 4 * (y * width + x)
                    out[k : k + 4] = bytes(table[bits >> 2 * i & 3])
    return bytes(out)


CODECS: dict[str, Callable[[bytes], bytes]] = {
    "zlib": inflate,
    "deflate": lambda b: inflate(b, raw=True),
    "bzip2": bunzip2,
    "lzma": lzma_alone,
    "lz4": lz4_frame,
    "lz4-block": lz4_block,
    "lzss": lzss,
    "packbits": rle_packbits,
    "none": bytes,
}


@F.pandas_udf(T.StructType().add("bytes", T.BinaryType()).add("error", T.StringType()))
def decoded(codec: pd.Series, data: pd.Series) -> pd.DataFrame:
    """The decoded bytes, or why there are none: one damaged row fails alone."""
    out = []
    for name, b in zip(codec, data, strict=True):
        try:
            out.append((CODECS[name](bytes(b)), None) if b is not None else (None, None))
        except (ValueError, KeyError, IndexError, struct.error) as e:
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["bytes", "error"])


# --- Blowfish: its tables are the digits of pi, so they are computed


def _pi_words(n: int) -> list[int]:
    """The first n 32-bit words of pi's fraction."""
    bits = 32 * n + 64
    one = 1 << bits

    def arctan(inverse: int) -> int:
        term, total, k, sign = one // inverse, 0, 1, 1
        while term:
            total += sign * (term // k)
            term //= inverse * inverse
            k, sign = k + 2, -sign
        return total

    pi = 4 * (4 * arctan(5) - arctan(239))
    fraction = (pi & (one - 1)) >> 64
    return [fraction >> 32 * (n - 1 - i) & 0xFFFFFFFF for i in range(n)]


class Blowfish:
    _start: list[int] = []

    def __init__(self, key: bytes) -> None:
        if not Blowfish._start:
            Blowfish._start = _pi_words(18 + 1024)
        words = Blowfish._start
        ring = key * (72 // len(key) + 1)
        self.p = [w ^ int.from_bytes(ring[4 * i : 4 * i + 4], "big") for i, w in enumerate(words[:18])]
        self.s = [words[18 + 256 * k : 18 + 256 * (k + 1)] for k in range(4)]
        a = b = 0
        for table in (self.p, *self.s):
            for i in range(0, len(table), 2):
                a, b = self._rounds(a, b, self.p)
                table[i], table[i + 1] = a, b

    def _rounds(self, a: int, b: int, keys: list[int]) -> tuple[int, int]:
        s = self.s
        for k in keys[:16]:
            a ^= k
            b ^= ((s[0][a >> 24] + s[1][a >> 16 & 255] ^ s[2][a >> 8 & 255]) + s[3][a & 255]) & 0xFFFFFFFF
            a, b = b, a
        return b ^ keys[17], a ^ keys[16]

    def _each(self, data: bytes, keys: list[int], order: str) -> bytes:
        end = len(data) // 8 * 8
        out = bytearray()
        for a, b in struct.iter_unpack(order + "II", data[:end]):
            out += struct.pack(order + "II", *self._rounds(a, b, keys))
        return bytes(out) + data[end:]

    def encrypt(self, data: bytes, order: str = ">") -> bytes:
        return self._each(data, self.p, order)

    def decrypt(self, data: bytes, order: str = ">") -> bytes:
        """Whole blocks; what is left over stays as it is."""
        return self._each(data, self.p[::-1], order)


# --- ISAAC-64


class Isaac64:
    """The 64-bit ISAAC generator; ``seed`` has up to 256 words."""

    def __init__(self, seed: list[int] = ()) -> None:
        mask = (1 << 64) - 1
        v = [0x9E3779B97F4A7C13] * 8

        def mix() -> None:
            for i, (n, left) in enumerate(((9, False), (9, True), (23, False), (15, True), (14, False), (20, True), (17, False), (14, True))):
                a, e, f, h = i, (i + 4) % 8, (i + 5) % 8, (i + 7) % 8
                v[a] = (v[a] - v[e]) & mask
                v[f] ^= (v[h] << n & mask) if left else v[h] >> n
                v[h] = (v[h] + v[a]) & mask

        words = [*seed, *[0] * (256 - len(seed))]
        for _ in range(4):
            mix()
        self.m = [0] * 256
        for source in (words, self.m) if seed else (None,):
            for i in range(0, 256, 8):
                if source is not None:
                    v[:] = [(x + y) & mask for x, y in zip(v, source[i : i + 8], strict=True)]
                mix()
                self.m[i : i + 8] = v
        self.a = self.b = self.c = 0
        self.left: list[int] = []

    def _fill(self) -> None:
        mask, m = (1 << 64) - 1, self.m
        self.c = (self.c + 1) & mask
        a, b = self.a, (self.b + self.c) & mask
        out = [0] * 256
        for i in range(256):
            kind = i % 4
            x = m[i]
            step = ~(a ^ a << 21 & mask) & mask if kind == 0 else a ^ a >> 5 if kind == 1 else a ^ a << 12 & mask if kind == 2 else a ^ a >> 33
            a = (step + m[(i + 128) % 256]) & mask
            y = m[i] = (m[x >> 3 & 255] + a + b) & mask
            b = out[i] = (m[y >> 11 & 255] + x) & mask
        self.a, self.b, self.left = a, b, out

    def next(self) -> int:
        """The next number, the last of a block first."""
        if not self.left:
            self._fill()
        return self.left.pop()


# --- DXT3 and DXT5


def _colours(data: bytes, width: int, height: int, alpha) -> bytes:
    """32-bit BGRA of 16-byte blocks; ``alpha`` gives the 16 values of a block's first half."""
    out = bytearray(width * height * 4)
    across = (width + 3) // 4
    for k in range(across * ((height + 3) // 4)):
        block = data[16 * k : 16 * k + 16]
        if len(block) < 16:
            raise ValueError("the blocks are cut short")
        values = alpha(block[:8])
        c0, c1, bits = struct.unpack_from("<HHI", block, 8)
        ends = [((c & 31) * 255 // 31, (c >> 5 & 63) * 255 // 63, (c >> 11) * 255 // 31) for c in (c0, c1)]
        table = [*ends, *(tuple((p * u + q * (3 - u)) // 3 for p, q in zip(*ends, strict=True)) for u in (2, 1))]
        for i in range(16):
            x, y = k % across * 4 + i % 4, k // across * 4 + i // 4
            if x < width and y < height:
                at = 4 * (y * width + x)
                out[at : at + 4] = bytes((*table[bits >> 2 * i & 3], values[i]))
    return bytes(out)


def dxt3(data: bytes, width: int, height: int) -> bytes:
    return _colours(data, width, height, lambda half: [17 * (int.from_bytes(half, "little") >> 4 * i & 15) for i in range(16)])


def dxt5(data: bytes, width: int, height: int) -> bytes:
    def alpha(half: bytes) -> list[int]:
        a, b, bits = half[0], half[1], int.from_bytes(half[2:], "little")
        table = [a, b, *(((7 - i) * a + i * b) // 7 for i in range(1, 7))] if a > b else [a, b, *(((5 - i) * a + i * b) // 5 for i in range(1, 5)), 0, 255]
        return [table[bits >> 3 * i & 7] for i in range(16)]

    return _colours(data, width, height, alpha)


# --- TIFF


def lzw_tiff(data: bytes) -> bytes:
    """LZW of TIFF: codes from the highest bit, a width more one code early."""
    bits, out = MsbBits(data), bytearray()
    table: list[bytes] = []
    width, before = 9, None
    while bits.at + width <= 8 * len(data):
        code = bits.read(width)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code < len(table):
            part = table[code]
        elif before is not None and code == len(table):
            part = before + before[:1]
        else:
            raise ValueError("an unknown code")
        out += part
        if before is not None:
            table.append(before + part[:1])
        before = part
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def read_tiff(data: bytes) -> tuple[int, int, int, bytes]:
    """width, height, bits of a pixel and rows of a TIFF's first picture (stored, LZW, deflated or PackBits)."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            size = struct.calcsize(code) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, place))
    width, height = tags[256][0], tags[257][0]
    bits = sum(tags.get(258, [1]))
    unpack = {1: bytes, 5: lzw_tiff, 8: inflate, 32946: inflate, 32773: rle_packbits}.get(tags.get(259, [1])[0])
    if unpack is None:
        raise ValueError("a kind of TIFF that isn't read")
    row, strip = (width * bits + 7) // 8, tags.get(278, [height])[0]
    out = bytearray()
    for k, (start, n) in enumerate(zip(tags[273], tags[279], strict=True)):
        lines = min(strip, height - k * strip)
        part = bytearray(unpack(data[start : start + n])[: row * lines])
        if tags.get(317, [1])[0] == 2:  # differences of neighbours
            step = bits // 8
            for y in range(lines):
                for x in range(y * row + step, (y + 1) * row):
                    part[x] = (part[x] + part[x - step]) & 255
        out += part
    if len(out) < row * height:
        raise ValueError("the pixels are cut short")
    return width, height, bits, bytes(out)
