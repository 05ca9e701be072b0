"""Word shingles of texts as 64-bit hashes, and MinHash values of them, in vectorised numpy.

A word is a run of bytes other than blank and U+0009 to U+000D of the text with A-Z lower-cased.  A shingle is five words in a
row; a text of one to four words has its whole sequence as its only shingle; one without words has none.  A shingle stands
as a 64-bit hash of its words, so two different shingles of one pair of texts are taken for one with a chance of about
1e-13 for texts of a thousand words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
#: Bytes hashed at once (a longer text is hashed in pieces).
SLICE = 1 << 19
U = np.uint64

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mixed((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


_BASE = U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_PLACE = numbers(3, WIDTH) | U(1)


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to 2 SLICE of the base and of its inverse."""
    out = []
    for base in (_BASE, _BACK):
        row = np.full(2 * SLICE + 1, base)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word of at most 2 SLICE bytes that end in white space."""
    data = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_WHITE[data], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    up, back = powers()
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U)), starts


def _long_word(word: bytes) -> np.ndarray:
    """The same hash of one word of any length, piece by piece."""
    total, at = np.zeros(1, U), np.ones(1, U)
    for k in range(0, len(word), SLICE):
        part = np.frombuffer(word, np.uint8, min(SLICE, len(word) - k), k)
        total += ((part.astype(U) + U(1)) * powers()[0][: len(part)]).sum(dtype=U) * at
        at *= powers()[0][len(part)]
    return mixed(total + U(len(word)))


def _long_words(data: bytes) -> np.ndarray:
    """The hashes of the words of a text of any length, in pieces of about SLICE bytes that are cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end >= len(data):
            out.append(_words(data[at:] + b" ")[0])
            break
        white = np.flatnonzero(_WHITE[np.frombuffer(data, np.uint8, SLICE, at)])
        if len(white):
            end = at + int(white[-1]) + 1
            out.append(_words(data[at:end])[0])
        else:
            found = _BLANK.search(data, end)
            end = found.start() if found else len(data)
            out.append(_long_word(data[at:end]))
        at = end
    return np.concatenate(out)


def _rolled(words: np.ndarray) -> np.ndarray:
    """The shingles of words in a row (five words or more)."""
    out = np.zeros(len(words) - WIDTH + 1, U)
    for k in range(WIDTH):
        out += words[k : k + len(out)] * _PLACE[k]
    return mixed(out)


def _few(words: np.ndarray) -> np.ndarray:
    """The only shingle of less than five words, or none."""
    return mixed(np.array([(words * _PLACE[: len(words)]).sum(dtype=U) + U(len(words))], U)) if len(words) else words


def _hashed(docs: list[bytes]) -> list[np.ndarray]:
    """The shingle hashes, in order and with repeats, of each (lower-cased) text; all of them have SLICE bytes at most."""
    words, starts = _words(b" ".join(docs) + b" ")
    first = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in docs)])).tolist()
    rolled = _rolled(words) if len(words) >= WIDTH else words[:0]
    return [rolled[a : b - WIDTH + 1] if b - a >= WIDTH else _few(words[a:b]) for a, b in zip(first, first[1:], strict=False)]


def hashed(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The shingle hashes, in order and with repeats, of each text (null: none).

    Beside the text itself, a very long one takes some 16 bytes a word."""
    held, size = [], 0
    for text in texts:
        data = (text or "").encode().lower()  # bytes.lower() changes A-Z only
        if held and size + len(data) > SLICE:
            yield from _hashed(held)
            held, size = [], 0
        if len(data) > SLICE:
            words = _long_words(data)
            yield _rolled(words) if len(words) >= WIDTH else _few(words)
            continue
        held.append(data)
        size += len(data) + 1
    if held:
        yield from _hashed(held)


class MinHash:
    """n universal hash permutations x -> a x + b (a odd, modulo 2^64), and the least value of each over a set."""

    def __init__(self, n: int, seed: int) -> None:
        self.a, self.b = numbers(seed, n) | U(1), numbers(seed + 1, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(U).max, U)
        for k in range(0, len(x), 2048):
            part = np.multiply.outer(self.a, x[k : k + 2048])
            part += self.b[:, None]
            np.minimum(out, part.min(1), out=out)
        return out
