"""Small inputs with the cases that every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _gone string, count int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    shared = "this is a passage that many documents of the corpus hold in common"
    texts: list[str | None] = [None, "", " ", "\n", "one two three", "one two three", "Ünïcödé Σ ΑΣ straße 😀 ok", "a" * 5000, words(rng, 4000)]
    for i in range(12):
        base = words(rng, 60).split()
        texts.append(" ".join(base))
        for k in range(3):
            other = list(base)
            other[rng.randrange(60)] = f"x{k}"
            texts.append(" ".join(other))
        texts.append("\n".join([words(rng, 12), shared if i % 2 else shared.upper() + "  ", words(rng, 8)]))
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "misc", None]), len(t or ""), "k", "g", 1) for i, t in enumerate(texts)]
    out.append(out[9])  # a repeated row
    out.append((10, "another text under the same number", "en", "src1", 34, None, None, None))
    out.append((None, "a document without a number at all", None, None, None, None, None, None))
    return out


def documents(spark, given: list[tuple] | None = None):
    return spark.createDataFrame(rows() if given is None else given, SCHEMA)
