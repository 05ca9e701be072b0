"""Archive readers: bytes of a file to entries, and an entry to its bytes.

A reader says which files it may read (signatures, extensions) and gives two plain functions, so the same reader serves the table
function over a DataFrame of files, the data source and the extraction.  ``FixedIndex`` reads a whole family from a declaration."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..functions import codecs


class InvalidArchive(ValueError):
    """The file is not what the reader reads; the next candidate is tried."""


class Unsupported(ValueError):
    """The file is, but needs what no reader does."""


@dataclass(frozen=True)
class Entry:
    entry_id: str
    path: str
    size: int
    packed_size: int
    offset: int = 0
    compressed: bool = False
    encrypted: bool = False
    size_known: bool = True
    checksum: str | None = None
    raw_path: str | None = None
    #: (method, offset, size, packed size) of each part.
    segments: tuple[tuple[int, int, int, int], ...] = ()


@dataclass(frozen=True)
class Reader:
    format_id: str
    extensions: tuple[str, ...]
    signatures: tuple[tuple[bytes, int], ...]
    #: Of the bytes and the path of a file.
    entries: Callable[[bytes, str], list[Entry]]
    read: Callable[[bytes, Entry], bytes]
    priority: int = 0
    ext_fallback: bool = False
    ext_only: bool = False


def piece(data: bytes, offset: int, n: int) -> bytes:
    if not (0 <= offset and 0 <= n and offset + n <= len(data)):
        raise InvalidArchive(f"{n} bytes at {offset} lie outside the file")
    return data[offset : offset + n]


def name_of(data: bytes, encoding: str = "cp932") -> str:
    return data.split(b"\0", 1)[0].decode(encoding, "replace")


def stored(data: bytes, entry: Entry) -> bytes:
    return piece(data, entry.offset, entry.packed_size)


def entry(i: int, path: str, size: int, **more) -> Entry:
    plain = path.replace("\\", "/")
    return Entry(str(i), plain, size, more.pop("packed_size", size), raw_path=path if plain != path else None, **more)


# --- 32-byte records with a sentinel


def pack32_entries(data: bytes, path: str = "") -> list[Entry]:  # noqa: ARG001
    """``ADPACK32``: the count includes a last record that only says where the last entry ends."""
    if data[:8] != b"ADPACK32":
        raise InvalidArchive("another signature")
    n = struct.unpack_from("<I", piece(data, 12, 4))[0]
    if not 1 < n <= 0x100000:
        raise InvalidArchive("an impossible count")
    records = [struct.unpack("<24s4xI", piece(data, 16 + 32 * i, 32)) for i in range(n)]
    out, end = [], 16 + 32 * n
    for i, ((name, start), (_, after)) in enumerate(zip(records, records[1:], strict=False)):
        plain = name_of(name)
        if not plain.strip() or start < end or after < start or after > len(data):
            raise InvalidArchive(f"record {i}")
        out.append(entry(i, plain, after - start, offset=start))
    return out


# --- chunked index, deflated or not, in several blocks

MAGIC3 = bytes.fromhex("58 50 33 0d 0a 20 0a 1a 8b 67 01")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        tag, n = struct.unpack("<4sQ", piece(data, at, 12))
        yield tag, piece(data, at + 12, n)
        at += 12 + n


def _blocks(data: bytes) -> Iterator[bytes]:
    at, seen = struct.unpack("<Q", piece(data, 11, 8))[0], set()
    while True:
        if at in seen:
            raise InvalidArchive("an index block that repeats")
        seen.add(at)
        flag = piece(data, at, 1)[0]
        if flag & 7 == 0:
            n = struct.unpack("<Q", piece(data, at + 1, 8))[0]
            body, end = piece(data, at + 9, n), at + 9 + n
        elif flag & 7 == 1:
            packed, n = struct.unpack("<QQ", piece(data, at + 1, 16))
            try:
                body, end = codecs.inflate(piece(data, at + 17, packed), n), at + 17 + packed
            except ValueError as e:
                raise InvalidArchive(str(e)) from e
        else:
            raise Unsupported(f"index method {flag & 7}")
        yield body
        if not flag & 0x80:
            return
        at = struct.unpack("<Q", piece(data, end, 8))[0]


def xp3_entries(data: bytes, path: str = "") -> list[Entry]:  # noqa: ARG001
    """``XP3``: File chunks with info, segm and adlr; protected entries are listed as encrypted."""
    if len(data) < 19 or data[:11] != MAGIC3:
        raise InvalidArchive("another signature")
    out: list[Entry] = []
    for block in _blocks(data):
        for tag, body in _chunks(block):
            if tag != b"File":
                continue
            part = dict(_chunks(body))
            info, segm = part.get(b"info", b""), part.get(b"segm", b"")
            if len(info) < 22 or not segm or len(segm) % 28:
                raise InvalidArchive("a File chunk that lacks its parts")
            flags, size, packed, n = struct.unpack_from("<IQQH", info)
            segments = []
            for i in range(0, len(segm), 28):
                method, *rest = struct.unpack_from("<IQQQ", segm, i)
                if method & 7 > 1:
                    raise Unsupported(f"segment method {method & 7}")
                segments.append((method & 7, *rest))
            if sum(s[2] for s in segments) != size or sum(s[3] for s in segments) != packed:
                raise InvalidArchive("segments that don't add up")
            name = piece(info, 22, 2 * n).decode("utf-16-le")
            sum_ = part.get(b"adlr")
            out.append(entry(len(out), name, size, packed_size=packed, offset=segments[0][1], compressed=any(s[0] for s in segments), encrypted=bool(flags >> 31), checksum=f"{struct.unpack('<I', sum_[:4])[0]:08x}" if sum_ else None, segments=tuple(segments)))
    if not out:
        raise InvalidArchive("no entries")
    return out


def xp3_read(data: bytes, e: Entry) -> bytes:
    if e.encrypted:
        raise Unsupported("a protected entry")
    out = b""
    for method, offset, size, packed in e.segments:
        part = piece(data, offset, packed)
        part = codecs.inflate(part, size) if method else part
        if len(part) != size:
            raise InvalidArchive("a segment of another size")
        out += part
    return out


# --- a family by declaration


@dataclass(frozen=True)
class FixedIndex:
    """Archives with an index of records of one size, by declaration.

    ``fields`` maps name, offset, size, packed and skipped places to struct codes, in order.  ``start`` and ``base`` (added to
    offsets) are numbers, or where a number is read: (place, code); a ``base`` of None is the end of the index.  Without a name field, entries are
    called after the file and their number.  Without an offset field they lie one behind the other from ``base``; without a size field
    they end where the next one begins.  ``skip`` leaves out records whose name or size is empty, which are errors (names) or entries
    (sizes) otherwise.  ``also`` are further (bytes, place) that a file must have."""

    format_id: str
    signatures: tuple[tuple[bytes, int], ...]
    count: tuple[int, str]
    start: int | tuple[int, str]
    fields: dict[str, str]
    extensions: tuple[str, ...] = ()
    base: int | tuple[int, str] | None = 0
    encoding: str = "cp932"
    codec: str = "none"
    skip: bool = False
    also: tuple[tuple[bytes, int], ...] = ()
    more: dict = field(default_factory=dict)

    def entries(self, data: bytes, path: str = "") -> list[Entry]:
        has = lambda sig: data[sig[1] : sig[1] + len(sig[0])] == sig[0]
        if (self.signatures and not any(map(has, self.signatures))) or not all(map(has, self.also)):
            raise InvalidArchive("another signature")
        number = lambda at, code: struct.unpack("<" + code, piece(data, at, struct.calcsize("<" + code)))[0]
        n = number(*self.count)
        if not 0 < n < 0x40000:
            raise InvalidArchive("an impossible count")
        layout = struct.Struct("<" + "".join(self.fields.values()))
        start = self.start if isinstance(self.start, int) else number(*self.start)
        body = piece(data, start, n * layout.size)
        base = start + len(body) if self.base is None else self.base if isinstance(self.base, int) else number(*self.base)
        names = [k for k, c in self.fields.items() if not c.endswith("x")]
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        rows, at = [], base
        for i in range(n):
            row = dict(zip(names, layout.unpack_from(body, i * layout.size), strict=True))
            name = name_of(row["name"], self.encoding) if "name" in row else f"{stem}#{i:04d}"
            if self.skip and (not name or row.get("size", 1) == 0):
                continue
            if not name:
                raise InvalidArchive(f"record {i} has no name")
            offset = row["offset"] + base if "offset" in row else at
            rows.append((name, offset, row.get("packed", row.get("size")), row.get("size")))
            at = offset + (rows[-1][2] or 0)
        ends = sorted({r[1] for r in rows} | {len(data)})
        out = []
        for i, (name, offset, packed, size) in enumerate(rows):
            if packed is None:
                packed = next((e for e in ends if e > offset), offset) - offset
            piece(data, offset, packed)
            out.append(entry(i, name, packed if size is None else size, packed_size=packed, offset=offset, compressed=self.codec != "none", size_known=size is not None or self.codec == "none"))
        return out

    def read(self, data: bytes, e: Entry) -> bytes:
        out = codecs.CODECS[self.codec](stored(data, e))
        if e.size_known and len(out) != e.size:
            raise InvalidArchive(f"{len(out)} bytes, expected {e.size}")
        return out

    def reader(self) -> Reader:
        return Reader(self.format_id, self.extensions, self.signatures, self.entries, self.read, **self.more)


# Layouts of archives with fixed records.
FAMILY = [
    FixedIndex("advsys-fpk", ((b"MFWY", 0),), (4, "i"), 16, {"name": "24s", "size": "I", "offset": "I"}),
    FixedIndex("ags-dat", ((b"pack", 0),), (4, "h"), 6, {"name": "16s", "offset": "I", "size": "I"}, ("dat",)),
    FixedIndex("alicesoft-alk", ((b"ALK0", 0),), (4, "i"), 8, {"offset": "I", "size": "I"}, skip=True),
    FixedIndex("applepie-arc", ((b"ARC\x10", 0),), (4, "i"), (12, "I"), {"name": "16s", "size": "I", "offset": "I"}),
    FixedIndex("aquarium-cpa", ((b"CPA\0", 0),), (12, "i"), 32, {"name": "16s", "offset": "I", "size": "I", "_": "8x"}, base=(8, "I"), skip=True),
    FixedIndex("basil-mif", ((b"MIF\0", 0),), (4, "i"), 8, {"name": "16s", "offset": "I", "size": "I"}),
    FixedIndex("bellda-bld", tuple((b"BLD0" + v + b"\0", 0) for v in (b"0", b"1", b"12", b"3")), (8, "h"), (10, "I"), {"name": "12s", "size": "I"}, base=16),
    FixedIndex("bishop-pk", ((b"\x8c\x8ePK", 0),), (4, "i"), 12, {"name": "512s", "_": "4x", "offset": "I", "size": "I", "__": "36x"}),
    FixedIndex("cdpa-pack", ((b"PACK", 0),), (4, "i"), 8, {"name": "32s", "size": "I", "offset": "I"}),
    FixedIndex("cherry-myk", ((b"MYK0", 0), (b"CHE0", 0)), (8, "H"), (10, "I"), {"name": "12s", "size": "I"}, base=16, also=((b"\x30\x1a", 4),)),
    FixedIndex("circus-crm", ((b"CRXB", 0),), (8, "i"), 16, {"offset": "I", "_": "4x", "name": "24s"}),
    FixedIndex("entexec-cab", ((b"Pack", 0),), (8, "i"), 12, {"name": "256s", "offset": "I", "size": "I", "_": "4x"}, also=((b"Dat3", 4),)),
    FixedIndex("fc01-mrg0", ((b"mrg0", 0),), (4, "i"), 16, {"name": "64s", "size": "I", "_": "8x"}, base=(8, "I")),
    FixedIndex("harvest-dat", ((b"UNA\0", 0),), (8, "i"), 32, {"name": "32s", "offset": "I", "size": "I", "_": "8x"}, also=((b"001\0", 4),)),
    FixedIndex("mutation-dpf", ((b"DPFL", 0),), (4, "H"), 6, {"name": "16s", "offset": "I", "size": "I"}),
    FixedIndex("tail-pkg", ((b"PKG ", 0),), (4, "i"), 8, {"offset": "I", "size": "I"}),
    FixedIndex("ucom-uk", ((b"UK", 0),), (2, "H"), 4, {"name": "16s", "offset": "I", "size": "I"}),
]


# --- single pictures and sounds as archives of one entry


def _single(check: Callable[[bytes], object]) -> Callable[[bytes, str], list[Entry]]:
    def entries(data: bytes, path: str = "") -> list[Entry]:  # noqa: ARG001
        try:
            check(data)
        except (ValueError, struct.error) as e:
            raise InvalidArchive(str(e)) from e
        return [entry(0, "content", len(data))]

    return entries


class Registry:
    """Readers in order of registration."""

    def __init__(self, readers: list[Reader] = ()) -> None:
        self.readers: list[Reader] = []
        for r in readers:
            self.register(r)

    def register(self, reader: Reader) -> None:
        if any(r.format_id == reader.format_id for r in self.readers):
            raise ValueError(f"{reader.format_id} is registered already")
        self.readers.append(reader)

    def candidates(self, data: bytes, path: str) -> list[tuple[Reader, bool, bool]]:
        """(reader, signature matches, extension matches), the best first."""
        ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
        out = []
        for i, r in enumerate(self.readers):
            by_sig = any(data[o : o + len(s)] == s for s, o in r.signatures)
            by_ext = ext in r.extensions
            if r.signatures:
                ok = by_sig or r.ext_fallback
            else:
                ok = by_ext or not r.extensions
            if ok and (by_ext or not r.ext_only):
                out.append((not by_sig, not by_ext, -r.priority, i, r))
        return [(r, not a, not b) for a, b, _, _, r in sorted(out, key=lambda x: x[:4])]

    def open(self, data: bytes, path: str) -> tuple[Reader, list[Entry], str, list[str]]:
        """The first candidate that opens, its entries, the confidence and warnings.  Later candidates aren't tried."""
        for r, by_sig, by_ext in self.candidates(data, path):
            try:
                found = r.entries(data, path)
            except (InvalidArchive, struct.error, zlib.error, UnicodeDecodeError):
                continue
            warnings = [] if by_sig or (by_ext and not r.signatures) else ["extension only"] if by_ext else ["neither signature nor extension"]
            return r, found, "high" if by_sig else "medium" if by_ext else "low", warnings
        raise InvalidArchive("no registered format")


def default_registry() -> Registry:
    return Registry(
        [
            Reader("xp3", ("xp3", "exe"), ((MAGIC3, 0),), xp3_entries, xp3_read),
            Reader("adpack32", ("pak",), ((b"ADPACK32", 0),), pack32_entries, stored),
            *(f.reader() for f in FAMILY),
            Reader("bmp", ("bmp",), ((b"BM", 0),), _single(codecs.bmp_header), stored, -1),
            Reader("wav", ("wav",), ((b"RIFF", 0),), _single(codecs.read_wave), stored, -1),
            Reader("png", ("png",), ((b"\x89PNG\r\n\x1a\n", 0),), _single(codecs.png_header), stored, -1),
        ]
    )
