"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut at white space; what lies between is normalised and split as the vocabulary file says, and each piece is
merged: the adjacent pair of lowest rank is popped from a heap, its two symbols become one in a linked list, and the
two new neighbours are pushed.  The count is the number of initial symbols less the number of merges; no identifiers
are made.  Counts of pieces between white space are kept in two bounded generations of a cache in each worker.

Cases: a null or empty text has 0 bytes and 0 tokens.  Repeated rows each get their row.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

LIMIT = 2048
#: Entries in each of the two generations of a worker's cache; longer pieces than KEEP_CHARS are never kept.
CACHE, KEEP_CHARS = 400_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts the tokens of texts as the vocabulary file (a BPE with word-end symbols) gives them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        signs = byte_symbols()
        self.inner = [vocab[s] for s in signs]
        self.last = [vocab[s + end] for s in signs]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = re.compile("|".join(re.escape(x["content"]) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))) or r"(?!)")
        self.any_special = re.compile("|".join(sorted({re.escape(x["content"][:2]) for x in spec["added_tokens"]})) or r"(?!)")
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Symbols left of one piece after all merges."""
        n = len(data)
        sign = [self.inner[b] for b in data]
        sign[-1] = self.last[data[-1]]
        if n == 1:
            return 1
        pairs = self.pairs
        heap = [(found[0], i) for i in range(n - 1) if (found := pairs.get((sign[i], sign[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        before, after, left = list(range(-1, n - 1)), [*range(1, n), -1], n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if sign[i] >= 0 else -1
            if j < 0:
                continue
            found = pairs.get((sign[i], sign[j]))
            if not found or found[0] != rank:
                continue  # the pair that was pushed is gone
            sign[i], sign[j] = found[1], -1
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := pairs.get((sign[i], sign[k])):
                    heapq.heappush(heap, (found[0], i))
            k = before[i]
            if k >= 0 and (found := pairs.get((sign[k], sign[i]))):
                heapq.heappush(heap, (found[0], k))
        return left

    def piece(self, chunk: str) -> int:
        """Tokens of what lies between two white spaces."""
        if chunk.isascii():
            words = self.pattern.findall(chunk.lower())
        else:  # normalised and split by the library's own tables
            words = [w for w in self.pattern.findall(self.library.normalizer.normalize_str(chunk)) if w]
        return sum(self.merged(w.encode()) for w in words)

    def plain(self, text: str) -> int:
        chunks = text.split() if not _SEPARATORS.search(text) else _WHITE.split(text)
        new, old = self.new, self.old
        for c in set(chunks).difference(new):
            if (n := old.get(c)) is None:
                n = self.piece(c) if c else 0
            if len(c) <= KEEP_CHARS:
                new[c] = n
        try:
            total = sum(map(new.__getitem__, chunks))
        except KeyError:  # a long piece
            total = sum(new[c] if c in new else self.piece(c) for c in chunks)
        if len(new) > CACHE:
            self.old, self.new = new, {}
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.any_special.search(text):
            return self.plain(text)
        marks = self.special.findall(text)
        return len(marks) + sum(self.plain(x) for x in self.special.split(text) if x)


#: White space of the vocabulary's pattern; the four separators are white space to str.split alone.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    """One counter, with its cache, in each Python worker."""
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text; one pass without a shuffle."""

    def make():
        count = counter(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = batch.columns
            texts = texts.to_pylist()
            n = [count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return each

    out = arrow_map(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
