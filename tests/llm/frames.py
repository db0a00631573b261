"""Small tables with every edge case, and a deterministic vocabulary."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, start string, key string, score string"


def sentence(rng: random.Random, n: int) -> str:
    syllables = ["ba", "ke", "mo", "ti", "ru", "sha", "len", "dor", "vi", "pa", "gu", "ze"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n))


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); further columns clash with the operators' own names."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, "s")[:4] if len(r) == 2 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text), "x", "x", "x", "x", "x"))
    return spark.createDataFrame(full, DOCS)


def edge_rows():
    rng = random.Random(5)
    long = sentence(rng, 4000)
    return [
        (1, None), (2, ""), (3, "   \n "), (4, "one"), (5, "one"), (None, "no id here at all for this text"), (6, long), (6, long),
        (7, "é" * 30 + " ß 中文 字 😀"), (8, "!!! ..."), (9, sentence(rng, 40))
    ]
