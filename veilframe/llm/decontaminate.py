"""Benchmark decontamination by a generalised suffix automaton over words.

The automaton of all test items takes the words of each document one by one and holds the longest
suffix read so far that occurs in an item. Where that is at least a window long, the window's words
are hit and the state of exactly that length names the items. Words reach the automaton only in runs
whose every neighbouring pair occurs in an item, since elsewhere no match can grow past a word:
finding those runs is vectorised.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import pickle
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import open_file, scratch_dir, small_batches, tidy, write_file

WINDOW = 13
#: Words of an automaton: about 800 bytes each while it is built, and some tens afterwards.
AUTOMATON_WORDS = 250_000
#: Bytes of texts that go through several automata one after the other.
GATHERED = 32 << 20
#: Words in UTF-8: digits, letters and all beyond ASCII; A-Z in lower case, the rest are separators.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class SuffixAutomaton:
    """All substrings of the items' word sequences."""

    def __init__(self, window: int = WINDOW):
        self.window, self.items = window, []
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.pairs: set[tuple[int, int]] = set()
        self.words = 0

    def _state(self, length: int, link: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        out = self.next
        if c in out[last]:  # an earlier item has this prefix already
            q = out[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, c, q)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = out[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, item_id, words: list[bytes]) -> None:
        if not words:
            return
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.pairs.update(itertools.pairwise(ids))
        last = 0
        for c in ids:
            last = self._extend(last, c)
        self.items.append((item_id, ids))
        self.words += len(ids)

    def finish(self) -> "Matcher":
        """The automaton as sorted arrays, with item numbers at the states of the windows."""
        ends: list[tuple[int, int]] = []
        short: dict[int, list[tuple[int, int]]] = {}
        shortest = self.window
        for number, (_, ids) in enumerate(self.items):
            need = min(self.window, len(ids))
            shortest = min(shortest, need)
            state = length = 0
            seen = set()
            for c in ids:
                state, length = self.next[state][c], length + 1
                while length > need and self.length[self.link[state]] >= need:
                    state = self.link[state]
                length = min(length, need)
                if length == need and state not in seen:
                    seen.add(state)
                    if len(ids) < self.window:
                        short.setdefault(state, []).append((need, number))
                    else:
                        ends.append((state, number))
        size = max(1, len(self.vocabulary))
        keys = np.array([s * size + c for s, out in enumerate(self.next) for c in out], np.int64)
        to = np.array([t for out in self.next for t in out.values()], np.int32)
        order = np.argsort(keys)
        length, link = np.array(self.length, np.int32), np.array(self.link, np.int32)
        # the nearest state on the way of links, itself included, where a short item ends
        output = np.full(len(length), -1, np.int32)
        if short:
            for s in np.argsort(length, kind="stable").tolist():
                output[s] = s if s in short else output[link[s]] if s else -1
        ends.sort()
        at = np.searchsorted(np.array([s for s, _ in ends], np.int64), np.arange(len(length) + 1)).astype(np.int32)
        pairs = np.array(sorted(a * size + b for a, b in self.pairs), np.int64)
        return Matcher(
            self.window, shortest, [i for i, _ in self.items], self.vocabulary, keys[order], to[order], link, length, at,
            np.array([n for _, n in ends], np.int32), short, output, pairs
        )


class Matcher:
    """A finished automaton: some tens of bytes a word instead of the builder's several hundred."""

    def __init__(self, window, shortest, names, vocabulary, keys, to, link, length, ends_at, ends, short, output, pair_keys):
        self.window, self.shortest, self.names, self.vocabulary = window, shortest, names, vocabulary
        self.keys, self.to, self.link, self.length = keys, to, link, length
        self.ends_at, self.ends, self.short, self.output, self.pair_keys = ends_at, ends, short, output, pair_keys

    def _next(self, state: int, c: int) -> int:
        """The state after c, -1 if there is none."""
        key = state * max(1, len(self.vocabulary)) + c
        at = self.keys.searchsorted(key)
        return int(self.to[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """(start, stop) of the runs that may hold a window."""
        n = len(ids)
        known = ids >= 0
        joined = np.zeros(n + 1, bool)  # joined[i]: words i - 1 and i stand side by side in an item
        if n > 1 and len(self.pair_keys):
            at = np.flatnonzero(known[1:] & known[:-1])
            keys = ids[at].astype(np.int64) * len(self.vocabulary) + ids[at + 1]
            place = np.searchsorted(self.pair_keys, keys)
            joined[at[self.pair_keys[np.minimum(place, len(self.pair_keys) - 1)] == keys] + 1] = True
        starts = np.flatnonzero(known & ~joined[:n])
        stops = np.flatnonzero(known & ~joined[1:]) + 1
        long = stops - starts >= self.shortest
        return np.stack([starts[long], stops[long]], 1)

    def match(self, words: list[bytes], hit: np.ndarray) -> set[int]:
        """Mark the words that windows cover; the numbers of the items that occur."""
        get = self.vocabulary.get
        ids = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
        found: set[int] = set()
        link, size, window = self.link, self.length, self.window
        for start, stop in self.runs(ids).tolist():
            state = length = 0
            for i, c in enumerate(ids[start:stop].tolist(), start + 1):
                after = self._next(state, c)
                while state and after < 0:
                    state = int(link[state])
                    length = int(size[state])
                    after = self._next(state, c)
                if after >= 0:
                    state, length = after, length + 1
                if length >= window:
                    at = state
                    while size[link[at]] >= window:
                        at = int(link[at])
                    a, b = self.ends_at[at : at + 2].tolist()
                    if a < b:
                        hit[i - window : i] = True
                        found.update(self.ends[a:b].tolist())
                at = int(self.output[state])
                while at >= 0:
                    for need, number in self.short[at]:
                        if need <= length:
                            hit[i - need : i] = True
                            found.add(number)
                    at = int(self.output[link[at]]) if at else -1
        return found


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = AUTOMATON_WORDS) -> list[str]:
    """Files of automata, of about max_words words each, of the items of benchmark(item_id, text, ...).

    Items are dealt out by hash and the automata built where they land; only the files' names come here. Items with the same id and
    text are one.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null").distinct()
    words = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]
    out_dir, groups = scratch_dir(spark, "automata"), -(-words // max_words)

    def build(table: pa.Table) -> pa.Table:
        builder = SuffixAutomaton(window)
        for item_id, text in sorted(
            zip(table.column("item_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] or "", r[1])
        ):
            builder.add(item_id, words_of(text))
        if not builder.items:
            return pa.table({"path": pa.array([], pa.string())})
        path = f"{out_dir}/{table.column('g')[0].as_py():06d}-{uuid.uuid4().hex}"
        write_file(path, [pickle.dumps(builder.finish(), protocol=5)])
        return pa.table({"path": pa.array([path])})

    if not groups:
        return []
    placed = items.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    return sorted(r["path"] for r in placed.groupBy("g").applyInArrow(build, "path string").collect())


@functools.lru_cache(maxsize=1)
def _load(path: str) -> Matcher:
    """An automaton that automata() wrote; a worker holds one at a time."""
    with open_file(path) as file:
        return pickle.loads(file.read())


def _spans(hit: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edges.reshape(-1, 2)


def _read(paths: list[str], texts: list[str | None]):
    """For each text the number of words, which of them are hit, and the ids of the items that occur (without null) and their number.

    The texts go through one automaton after the other, so a batch loads each once.
    """
    hits: list[np.ndarray] = []
    found: list[set] = [set() for _ in texts]
    for turn, path in enumerate(paths or [None]):
        for k, text in enumerate(texts):
            words = words_of(text)
            if not turn:
                hits.append(np.zeros(len(words), bool))
            if path is not None:
                matcher = _load(path)
                found[k].update(matcher.names[n] for n in matcher.match(words, hits[k]))
    for hit, names in zip(hits, found):
        yield len(hit), hit, sorted(n for n in names if n is not None), len(names)


def _gathered(batches, paths: list[str]):
    """Batches as they come if there is one automaton; else as many at a time as make GATHERED bytes, so that loading pays."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if len(paths) < 2 or size >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0]


def _over(hit: np.ndarray, min_coverage: float) -> bool:
    n = int(hit.sum())
    return n > 0 and n * 1_000_000 >= round(min_coverage * 1_000_000) * len(hit)


def _without(text: str | None, spans: list) -> str | None:
    """The text without its parts from the first to the last word of each span."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD_BYTES.finditer(data)]
    keep, pos = [], 0
    for a, b in spans:
        keep.append(data[pos : at[a][0]])
        pos = at[b - 1][1]
    return b"".join([*keep, data[pos:]]).decode("utf-8", "surrogatepass")


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = 0.05, cut: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) of documents(doc_id, text, ...).

    spans: maximal runs [start, end) of hit words; contaminated: some are, and at least the share
    min_coverage of all words. With cut, a column text has the document without the text from
    the first to the last word of every span. Null or empty texts have no words and are clean;
    items of one id count once, whatever their texts and rows; a null item_id counts, but is left out of items_sha256; items
    without words match nothing; equal rows give equal rows; other columns are ignored; an empty benchmark leaves everything clean.
    """
    small_batches(documents.sparkSession)
    paths = automata(benchmark, window)
    rows = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>" + (", text string" if cut else "")
    types = [
        pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(),
        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()
    ]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "text"][: 6 + cut]

    @tidy
    def scan(batches):
        for batch in _gathered(batches, paths):
            columns: list[list] = [[] for _ in names]
            texts = batch.column(1).to_pylist()
            for text, (n, hit, items, n_items) in zip(texts, _read(paths, texts)):
                spans = _spans(hit).tolist()
                row = [
                    n, int(hit.sum()), n_items, hashlib.sha256(",".join(items).encode()).hexdigest(), _over(hit, min_coverage),
                    [{"start": a, "end": b} for a, b in spans]
                ]
                for column, value in zip(columns, row + [_without(text, spans)] * cut):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    return rows.mapInArrow(scan, schema)


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = 0.05) -> DataFrame:
    """documents(text, ...) without contaminated rows, and without the hit spans of the others; all columns are kept.

    A column n_chars is set anew where a span went. Conditions as in contamination().
    """
    small_batches(documents.sparkSession)
    paths = automata(benchmark, window)
    names = documents.columns
    at = names.index("text")

    @tidy
    def clean(batches):
        for batch in _gathered(batches, paths):
            keep, texts, changed = [], [], []
            before = batch.column(at).to_pylist()
            for text, (_, hit, _, _) in zip(before, _read(paths, before)):
                keep.append(not _over(hit, min_coverage))
                changed.append(bool(keep[-1] and hit.any()))
                texts.append(_without(text, _spans(hit).tolist()) if changed[-1] else text)
            columns = [*batch.columns]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                sizes = [len(t) if c else n for t, c, n in zip(texts, changed, columns[k].to_pylist())]
                columns[k] = pa.array(sizes, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return documents.mapInArrow(clean, documents.schema)
