"""The pipeline's stages on a small table, each against a plain version of what it must do to its own input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from arkline.llm import mixing, packing, quality
from arkline.llm.queries import vocabulary

from .data import words
from .test_operators import kept_lines, near_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "this line stands in very many documents of the table, over and over"


def plain_quality(spark, docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    known = [(i, q) for i, q, _ in labels if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    frame = spark.createDataFrame(known, "doc_id long, quality int").selectExpr("doc_id", f"int(pmod(xxhash64(doc_id, 5), {quality.CALIBRATION * quality.PARTS}))")
    part = dict(map(tuple, frame.collect()))
    used = [(d[1], q, part[i]) for i, q in known for d in docs if d[0] == i]
    x, y, part = quality.matrix([u[0] for u in used]), np.array([u[1] for u in used], float), np.array([u[2] for u in used])
    mean, scale = x.mean(0), np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 1e-8))
    scale[scale < 1e-3] = 1
    fit = part % quality.CALIBRATION != 0
    z = quality.cosines((x - mean) / scale)
    weights = np.linalg.solve(z[fit].T @ z[fit] + quality.RIDGE * np.eye(z.shape[1]), z[fit].T @ y[fit])
    at, level = quality.isotonic(z[~fit] @ weights, y[~fit])
    score = np.interp(quality.cosines((quality.matrix([d[1] for d in docs]) - mean) / scale) @ weights, at, level)
    assert np.abs(score - quality.THRESHOLD).min() > 1e-6  # rounding can't decide
    return [d for d, s in zip(docs, score, strict=True) if s >= quality.THRESHOLD]


def plain_lines(docs: list[tuple]) -> list[tuple]:
    """Each document with the remaining text that ``kept_lines`` has the digest of."""
    out = []
    holder = max(d[0] for d in docs if d[0] is not None and LINE in (d[1] or "").split("\n"))
    for d, (_, n, gone, digest) in zip(docs, kept_lines(docs), strict=True):
        lines = (d[1] or "").split("\n")
        left = [x for x in lines if x != LINE or d[0] == holder]
        assert len(left) == n - gone and hashlib.sha256("\n".join(left).encode()).hexdigest() == digest
        text = "\n".join(left) if gone else d[1]
        out.append((d[0], text, d[2], d[3], len(text) if gone else d[4]))
    return out


def shares(budget: float, children: list[tuple]) -> dict:
    """As water fills vessels: (name, weight, volume) of each child, and what it gets."""
    out, rest, left = {}, budget, list(children)
    while left:
        level = max(0.0, rest / sum(w for _, w, _ in left))
        full = [c for c in left if c[2] <= level * c[1]]
        if not full:
            return out | {name: math.floor(level * w) for name, w, _ in left}
        out |= {name: cap for name, _, cap in full}
        rest -= sum(cap for _, _, cap in full)
        left = [c for c in left if c not in full]
    return out


def plain_mix(docs: list[tuple], fraction: float) -> list[tuple]:
    """One epoch at most of each leaf."""
    leaves, size = defaultdict(list), {}
    for d in docs:
        number = re.search("([0-9]{1,9})$", d[3] or "")
        domain = ["web", "code", "books", "news"][int(number[1]) % 4] if number else "other"
        leaves[domain, d[2] or "", d[3] or ""].append((max(1, -(-len((d[1] or "").encode()) // 4)), d))
    size = {leaf: sum(t for t, _ in of) for leaf, of in leaves.items()}
    under = lambda *at: sum(n for leaf, n in size.items() if leaf[: len(at)] == at)
    weight = lambda table, name: table.get(name, table["other"])
    top = shares(math.floor(sum(size.values()) * fraction), [((a,), weight(mixing.DOMAINS, a), under(a)) for a in {leaf[0] for leaf in size}])
    mid = {k: n for a, budget in top.items() for k, n in shares(budget, [(b, weight(mixing.LANGUAGES, b[1]), under(*b)) for b in {leaf[:2] for leaf in size} if b[:1] == a]).items()}
    low = {k: n for b, budget in mid.items() for k, n in shares(budget, [(c, 1.0, size[c]) for c in size if c[:2] == b]).items()}
    out = []
    for leaf, of in leaves.items():
        if low[leaf] >= size[leaf]:
            out += [d for _, d in of]
            continue
        groups = defaultdict(list)
        for t, d in of:
            groups[hashlib.md5(f"{mixing.SEED}:0:{'' if d[0] is None else d[0]}".encode()).hexdigest()].append((t, d))
        spent = 0
        for _, same in sorted(groups.items()):
            spent += sum(t for t, _ in same)
            if spent > low[leaf]:
                break
            out += [d for _, d in same]
    return out


def plain_pieces(docs: list[tuple]) -> Counter:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    out = Counter()
    for d in docs:
        ids = [*(library.encode(d[1], add_special_tokens=False).ids if d[1] else []), 2]
        bounds = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            out[d[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def packs(rows: list) -> int:
    """How many sequences there are; each is full without a gap from 0 on, and none is too long."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    return len(by)


def corpus() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(300):
        good = i % 5 != 0
        text = ". ".join(words(rng, 12).capitalize() for _ in range(6 if i % 50 else 300)) + "."
        if i % 7 == 3:
            text += "\n" + LINE
        if i % 11 == 4 and docs[-1][1]:
            text = docs[-1][1]  # an exact copy
        if i % 13 == 6 and docs[-1][1]:
            text = docs[-1][1] + " and some words more"  # a near copy
        lang, source = rng.choice(["en", "en", "de", "fr", None]), rng.choice([f"src{i % 6}", "src1", "misc", None])
        docs.append((i, text if good else " | ".join(text.upper().split()), lang, source, len(text)))
        labels.append((i, int(good), 0))
    docs += [(1000, None, None, None, None), (1001, "", "en", "src1", 0), docs[1], (None, "a document without a number. It has two sentences.", "en", "src2", 50)]
    labels += [(1000, None, 0), (None, 1, 0), (5000, 1, 0)]
    return docs, labels


def test_pipeline(spark, tmp_path):
    docs, labels = corpus()
    d = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    plain = {
        "quality": lambda rows: plain_quality(spark, rows, labels),
        "line_dedup": plain_lines,
        "near_dups": lambda rows: [r for r, g in zip(rows, near_groups(rows), strict=True) if g[3] is not False],
        "mixing": lambda rows: plain_mix(rows, corpus_pipeline.FRACTION),
    }
    given = spark.read.parquet(f"{d}/documents.parquet")
    at, rows = given, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, d)
        assert out.columns == given.columns, name
        out.write.parquet(f"{d}/{name}")
        at = spark.read.parquet(f"{d}/{name}")
        before, rows = rows, plain[name](rows)
        assert Counter(map(tuple, at.collect())) == Counter(rows), name
        assert (rows != before) if name == "line_dedup" else 0 < len(rows) < len(before), name  # each one acts
    pieces = plain_pieces(rows)
    count = [0] * (packing.CAPACITY + 1)
    for (_, _, _, length, _), n in pieces.items():
        count[length] += n
    best = sum(times for _, times in packing.plan(count, packing.CAPACITY)[0])
    assert best >= -(-sum(n * k for n, k in enumerate(count)) // packing.CAPACITY)
    for out in (corpus_pipeline.STAGES[-1][1](spark, at, d).collect(), corpus_pipeline.run(spark, d).collect()):
        assert Counter(tuple(r)[:5] for r in out) == pieces and packs(out) == best


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_clashing_names(spark, tmp_path, name):
    docs, labels = corpus()
    extra = [(*d, f"of {d[0]}", d[0], None) for d in docs]
    wide = spark.createDataFrame(extra, f"{SCHEMA}, key string, _score long, _of string")
    d = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, wide, d)
    assert out.columns == wide.columns
    got = out.collect()
    assert all((r.key, r._score, r._of) == (f"of {r.doc_id}", r.doc_id, None) for r in got)
    narrow = stage(spark, spark.createDataFrame(docs, SCHEMA), d)
    assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, narrow.collect()))


def test_stages_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), d).count() == 0, name
    one = spark.createDataFrame([(1, "a text that nothing is known about", "en", "src1", 35)], SCHEMA)
    assert corpus_pipeline.quality_stage(spark, one, d).count() == 1
