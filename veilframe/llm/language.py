"""Language identification by hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1 of its own. A trigram is the product of its letters' vectors, each rolled
by its distance from the end; a text is the sum of its trigrams, a language the sum of its
texts, each weighing the same. A text goes to the language whose prototype, less the mean of all
prototypes, has the largest cosine with it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches, tidy, unused

DIMENSIONS = 512
#: Trigram vectors that a worker keeps; beyond that it starts afresh.
KEPT = 1 << 15
#: Sums of tasks that come to the driver for each language.
GROUPS = 64
#: A text's weight when prototypes are summed: whole numbers, so that sums are the same in any order.
UNIT = 1 << 24
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Each code point itself, 0 if it is no letter."""
    table = np.arange(0x110000, dtype=np.int32)
    table[[not chr(c).isalpha() for c in range(0x110000)]] = 0
    return table


def trigrams(text: str) -> np.ndarray:
    """Codes of a text's trigrams, 21 bits a letter; every run of other characters counts as one boundary."""
    s = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    s = np.concatenate([
        [0], s[(s != 0) | np.concatenate([[False], s[:-1] != 0])], [0]
    ]).astype(np.int64) if len(s) else np.zeros(2, np.int64)
    return ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[s[1:-1] != 0]


def letter_vectors(code_points: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 9) -> np.ndarray:
    """A random vector of +1 and -1 for each code point (0 for the boundary): bits of a mixed counter."""
    words = -(-dimensions // 64)
    x = code_points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    x = (x + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :dimensions]
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


class TrigramVectors:
    """Vectors of the trigrams met so far, made from the letters' random vectors on first sight."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.clear()

    def clear(self) -> None:
        self.codes, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.zeros((1024, self.dimensions), np.int8)
        self.used = 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The row numbers of distinct codes in self.vectors."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        if not known.all():
            new = codes[~known]
            while self.used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            parts = [(new >> 42, 2), ((new >> 21) & 0x1FFFFF, 1), (new & 0x1FFFFF, 0)]
            a, b, c = (np.roll(letter_vectors(x, self.dimensions), shift, 1) for x, shift in parts)
            self.vectors[self.used : self.used + len(new)] = a * b * c
            self.codes = np.insert(self.codes, at[~known], new)
            self.row = np.insert(self.row, at[~known], np.arange(self.used, self.used + len(new)))
            self.used += len(new)
            at = np.searchsorted(self.codes, codes)
        return self.row[at]

    def bundle(self, rows: np.ndarray, weights: np.ndarray, dtype=np.float32) -> np.ndarray:
        """Sum of the rows' vectors by weight: exact for whole weights below the type's limit."""
        total = np.zeros(self.dimensions)
        for k in range(0, len(rows), 4096):
            total += weights[k : k + 4096].astype(dtype) @ self.vectors[rows[k : k + 4096]].astype(dtype)
        return total


@functools.cache
def _vectors(dimensions: int) -> TrigramVectors:
    return TrigramVectors(dimensions)


def fit(documents: DataFrame, learn: Column, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language from the rows of documents(text, lang, ...) where learn is true.

    Rows with a null text or lang, or without letters, teach nothing. Tasks bundle their rows and
    send a vector for each language, summed in GROUPS groups and then on the driver. All sums are of whole numbers, so
    they do not depend on the partitioning.
    """
    small_batches(documents.sparkSession)
    rows = documents.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))

    @tidy
    def bundle(batches):
        memory, weights, total = _vectors(dimensions), {}, {}

        def flush():
            for lang, w in weights.items():
                used = np.flatnonzero(w)
                total[lang] = total.get(lang, 0) + memory.bundle(used, w[used], np.float64).astype(np.int64)
            weights.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = np.unique(trigrams(text), return_counts=True)
                if len(codes):
                    if memory.used > KEPT:
                        flush()
                        memory.clear()
                    rows = memory.rows(codes)
                    old = weights.get(lang)
                    if old is None or len(old) < memory.used:
                        grown = np.zeros(2 * memory.used, np.int64)
                        if old is not None:
                            grown[: len(old)] = old
                        old = weights[lang] = grown
                    old[rows] += counts * UNIT // counts.sum()
        flush()
        part = TaskContext.get().partitionId() % GROUPS
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(total)), pa.array([part] * len(total), pa.int64()),
                    pa.array([v.astype("<i8").tobytes() for v in total.values()])
                ],
                names=["lang", "part", "vector"]
            )

    def summed(table: pa.Table) -> pa.Table:
        vector = sum(np.frombuffer(v, "<i8") for v in table.column("vector").to_pylist())
        return pa.table({
            "lang": table.column("lang")[:1], "part": table.column("part")[:1], "vector": pa.array([vector.tobytes()], pa.binary())
        })

    parts = rows.mapInArrow(bundle, "lang string, part long, vector binary").groupBy("lang", "part").applyInArrow(summed, "lang string, part long, vector binary")
    out: dict[str, np.ndarray] = {}
    for r in parts.toLocalIterator():
        out[r["lang"]] = out.get(r["lang"], 0) + np.frombuffer(r["vector"], "<i8")
    return {lang: v.astype(float) for lang, v in out.items()}


def classify(documents: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """documents(text, ...) with lang_pred and score (the cosine, 0 at least).

    Null texts and texts without letters are `und` with score 0, as is everything if nothing was
    learned. Equal cosines go to the name that sorts first. All columns are kept; columns of the new names are replaced, see identified().
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in names]) if names else np.zeros((0, dimensions))
    matrix = matrix - matrix.mean(0) if len(names) > 1 else matrix
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    documents = documents.drop("lang_pred", "score")
    fields = documents.schema

    @tidy
    def predict(batches):
        memory = _vectors(dimensions)
        at = fields.names.index("text")
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at).to_pylist():
                codes, counts = np.unique(trigrams(text or ""), return_counts=True)
                lang, score = UNDETERMINED, 0.0
                if len(codes) and names:
                    if memory.used > KEPT:
                        memory.clear()
                    vector = memory.bundle(memory.rows(codes), counts)
                    cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-12)
                    best = int(np.argmax(cosines))
                    lang, score = names[best], float(min(1.0, max(0.0, cosines[best])))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*fields.names, "lang_pred", "score"]
            )

    from pyspark.sql import types as T

    schema = T.StructType([*fields.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.mapInArrow(predict, schema)


def identified(documents: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> tuple[DataFrame, str, str]:
    """classify() under names that documents does not have: (documents with both, name of the language, name of the score)."""
    lang, score = unused(documents.columns, "lang_pred", "score")
    clashes = [c for c in documents.columns if c.lower() in ("lang_pred", "score")]
    own = dict(zip(clashes, unused([*documents.columns, lang, score], *(f"own_{c}" for c in clashes))))
    found = classify(documents.withColumnsRenamed(own), prototypes, dimensions)
    back = {v: k for k, v in own.items()}
    new = {"lang_pred": lang, "score": score}
    return found.withColumnsRenamed(new).withColumnsRenamed(back), lang, score
