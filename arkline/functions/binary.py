"""Bytes: ranges, chunks, a cursor over fixed-width numbers, and parts of executables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 262_144


def range_read(content: Column, offset: Column | int, n: Column | int) -> Column:
    """n bytes from an offset; an error if the file is shorter."""
    offset, n = (F.lit(x) if isinstance(x, int) else x for x in (offset, n))
    part = F.substring(content, (offset + 1).cast("int"), n.cast("int"))
    return F.when((offset >= 0) & (n >= 0) & (F.octet_length(part) == n), part).otherwise(F.raise_error(F.lit("INVALID_ARCHIVE: a range outside the file")))


def be_number(content: Column, offset: int, n: int) -> Column:
    """An unsigned big-endian number of up to seven bytes."""
    return F.conv(F.hex(F.substring(content, offset + 1, n)), 16, 10).cast("long")


def le_number(content: Column, offset: int, n: int) -> Column:
    """An unsigned little-endian number of up to seven bytes."""
    return F.conv(F.concat(*[F.hex(F.substring(content, offset + 1 + i, 1)) for i in reversed(range(n))]), 16, 10).cast("long")


def chunks(data: bytes, offset: int = 0, n: int | None = None, size: int = CHUNK) -> Iterator[bytes]:
    end = len(data) if n is None else offset + n
    if not 0 <= offset <= end <= len(data):
        raise ValueError("a range outside the file")
    for at in range(offset, end, size):
        yield data[at : min(at + size, end)]


def joined_range(parts: list[bytes], offset: int, n: int) -> bytes:
    """A range of the parts laid end to end."""
    out, at = [], 0
    for p in parts:
        low, high = max(offset, at), min(offset + n, at + len(p))
        if low < high:
            out.append(p[low - at : high - at])
        at += len(p)
    if offset < 0 or n < 0 or offset + n > at:
        raise ValueError("a range outside the parts")
    return b"".join(out)


class Cursor:
    """Reads numbers and strings one after the other.  ``u(3)`` is an unsigned number of three bytes."""

    def __init__(self, data: bytes, at: int = 0, order: str = "little") -> None:
        self.data, self.at, self.order = data, at, order

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"{n} bytes at {self.at} lie outside the data")
        self.at += n
        return self.data[self.at - n : self.at]

    def u(self, n: int) -> int:
        return int.from_bytes(self.take(n), self.order)

    def i(self, n: int) -> int:
        return int.from_bytes(self.take(n), self.order, signed=True)

    def unpack(self, layout: str) -> tuple:
        s = struct.Struct(("<" if self.order == "little" else ">") + layout)
        return s.unpack(self.take(s.size))

    def seek(self, at: int) -> None:
        if not 0 <= at <= len(self.data):
            raise ValueError(f"{at} lies outside the data")
        self.at = at

    def text(self, n: int | None = None, encoding: str = "cp932") -> str:
        """A string up to its NUL: of a field of n bytes, or of as many as there are."""
        if n is None:
            end = self.data.find(b"\0", self.at)
            if end < 0:
                raise ValueError("a string without an end")
            out = self.data[self.at : end]
            self.at = end + 1
        else:
            out = self.take(n).split(b"\0", 1)[0]
        return out.decode(encoding, "replace")


def _sections(data: bytes) -> tuple[int, list[tuple[bytes, int, int, int, int]], int]:
    """(place of the optional header, sections as (name, virtual size, address, size, place), place of the data directories)."""
    if data[:2] != b"MZ" or len(data) < 64:
        raise ValueError("not an executable")
    at = struct.unpack_from("<I", data, 60)[0]
    if data[at : at + 4] != b"PE\0\0":
        raise ValueError("not a portable executable")
    n, optional = struct.unpack_from("<2xH12xH", data, at + 4)
    head = at + 24
    rows = [struct.unpack_from("<8sIIII", data, head + optional + 40 * i) for i in range(n)]
    directories = head + (112 if struct.unpack_from("<H", data, head)[0] == 0x20B else 96)
    return head, rows, directories


def executable_overlay(data: bytes) -> int:
    """Where what follows the last section begins."""
    return max((place + size for _, _, _, size, place in _sections(data)[1]), default=len(data))


def address_offset(data: bytes, address: int) -> int | None:
    """Where in the file a virtual address lies."""
    for _, virtual, start, size, place in _sections(data)[1]:
        if start <= address < start + max(virtual, size):
            at = address - start + place
            return at if at < place + size else None
    return None


def executable_resources(data: bytes) -> dict[tuple[int | str, ...], bytes]:
    """The resources by (type, name, language)."""
    _, _, directories = _sections(data)
    address = struct.unpack_from("<I", data, directories + 16)[0]
    root = address_offset(data, address) if address else None
    out: dict[tuple[int | str, ...], bytes] = {}
    if root is None:
        return out

    def name(value: int) -> int | str:
        if not value >> 31:
            return value
        at = root + (value & 0x7FFFFFFF)
        n = struct.unpack_from("<H", data, at)[0]
        return data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace")

    def walk(at: int, path: tuple) -> None:
        named, numbered = struct.unpack_from("<12xHH", data, at)
        for i in range(named + numbered):
            key, target = struct.unpack_from("<II", data, at + 16 + 8 * i)
            if target >> 31:
                if len(path) < 3:
                    walk(root + (target & 0x7FFFFFFF), (*path, name(key)))
                continue
            place, size = struct.unpack_from("<II", data, root + target)
            start = address_offset(data, place)
            if start is not None and start + size <= len(data):
                out[(*path, name(key))] = data[start : start + size]

    walk(root, ())
    return out
