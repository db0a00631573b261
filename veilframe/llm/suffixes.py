"""Removal of byte strings that occur earlier, by a sparse suffix sort.

A string of SPAN bytes is represented by one suffix: the one that starts at its anchor, of its k-grams (k = KGRAM) the one
with the least hash, the leftmost of equals. Equal strings have equal anchors at equal distances, so the suffixes at
anchors, about one in 32, tell what all suffixes would.

1. Texts are packed into files in the shared folder, with their anchors.
2. Counts of k-gram hashes leave out the suffixes that can repeat nothing: a hash that stands alone is that of a
   k-gram that does. Nothing else is decided by a hash.
3. The other suffixes are range-partitioned by their leading bytes, at splitters sampled from the packs, with the bytes
   around them that their strings cover. A bucket sorts them by multikey quicksort on eight-byte words; of equal surroundings
   the first remains, the rest repeat it. Where a k-gram has different surroundings, the strings in them are sorted in
   the same way and each one's first occurrence stays.
4. A k-gram with more than GROUP occurrences is too much for a bucket. Its strings are suffixes of their own then, filtered by counts
   and sorted like the others, and the order of occurrence is a part of the range that a bucket holds: a string of any
   frequency is cut over as many buckets as it needs. What a bucket starts with is compared, byte by byte, with
   what the buckets before it ended with.
5. Documents get their repeated string starts back and drop the covered bytes.

Only suffixes with their surroundings and starts are shuffled, as blocks of many.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep, open_file, scratch_dir, tidy, write_file

SPAN = 100
KGRAM = 37
PACK_BYTES = 4 << 20
#: Occurrences above which a k-gram's strings are sorted one by one.
GROUP = 20_000
#: Packs that splitters are sampled from, and keys from each; the balance of buckets only depends on them.
SAMPLE_PACKS, SAMPLE_KEYS = 64, 2000
#: Bytes that a bucket of keys or surroundings is meant to hold, and that a task reads of packs.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 32 << 20
_NULL = np.iinfo(np.int64).min


def _hash_kgrams(data: np.ndarray, k: int, m: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A mixed hash of the k bytes from each place on (the last k - 1 places have none)."""
    width = 1
    part = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    total, have = None, 0
    need = k
    while need:
        if need & 1:  # what is gathered so far, followed by this width
            if total is None:
                total, have = part, width
            else:
                n = len(part) - have
                total = total[:n] * np.uint64(pow(m, width, 1 << 64)) + part[have:][:n]
                have += width
        need >>= 1
        if need:
            n = len(part) - width
            part = part[:n] * np.uint64(pow(m, width, 1 << 64)) + part[width:]
            width *= 2
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    width, out = 1, x
    while 2 * width <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == w else np.minimum(out[: len(out) - (w - width)], out[w - width :])


class Anchors:
    """The anchors of a pack's strings: place, and the first and last start of the strings it stands for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, span: int = SPAN, k: int = KGRAM):
        n, w = len(data), span - k + 1
        self.place = self.first = self.last = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n < span:
            return
        hashes = _hash_kgrams(data, k)
        # a place in the low bits makes the minimum name it, the leftmost of equals first
        bits = np.uint64(max(1, int(n).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        least = _sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), w)
        at = (least & low).astype(np.int64)
        starts = np.zeros(len(at), bool)  # string starts that do not cross the end of their document
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= span:
                starts[a : b - span + 1] = True
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | ~starts[:-1]
        heads = np.flatnonzero(change & starts)
        ends = change | ~starts
        ends = np.append(ends[1:], True) & starts
        self.first, self.last = heads, np.flatnonzero(ends)
        self.place = at[heads]
        lead = (data[self.place].astype(np.uint64) << np.uint64(56)) | (data[self.place + 1].astype(np.uint64) << np.uint64(48))
        self.key = lead | (hashes[self.place] >> np.uint64(16))


def word_levels(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number in their order; data must have 7 bytes to spare."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x


def multikey_sort(
    words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salt: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(order, classes): the strings data[start : start + length] sorted by length, salt and bytes, and each string's class in that order.

    Multikey quicksort with characters of eight bytes: each level sorts what is tied so far by the next one and splits the
    ties; strings that are alone drop out. Equal classes are equal strings. words: word_levels of the data.
    """
    n = len(starts)
    order, first = np.arange(n), np.zeros(n, np.int64)  # first: where the ties of a place in the order begin
    tied, depth = np.arange(n), -1
    while len(tied):
        items = order[tied]
        if depth < 0:
            level = [lengths] if salt is None else [salt, lengths]
        else:
            # the last word of a string reaches back to end with it, so no byte beyond it counts
            level = [words[starts[items] + np.maximum(0, np.minimum(8 * depth, lengths[items] - 8))]]
        turn = np.lexsort([*level, first[tied]])
        order[tied] = items = items[turn]
        new = np.ones(len(tied), bool)
        new[1:] = first[tied][1:] != first[tied][:-1]
        for column in level:
            new[1:] |= column[turn][1:] != column[turn][:-1]
        run = np.cumsum(new) - 1
        first[tied] = tied[new][run]
        depth += 1
        tied = tied[(np.bincount(run)[run] > 1) & (8 * depth < lengths[items])]
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]])) if n else first
    return order, classes


class Pack:
    """Texts with their anchors: ids, offsets and data; place, first, last, key and new (its surroundings are the first of their kind here)."""

    @staticmethod
    def write(uri: str, ids: list[int], texts: list[bytes], span: int, k: int) -> int:
        """Write a pack; the number of its anchors."""
        body = b"".join(texts)
        data, offsets = np.frombuffer(body, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = Anchors(data, offsets, span, k)
        starts, lengths = found.first, found.last - found.first + span
        _, classes = multikey_sort(word_levels(_padded(data)), starts, lengths, found.place - starts)
        new = np.zeros(len(starts), bool)
        new[np.unique(classes, return_index=True)[1]] = True
        codec = pa.Codec("zstd", 1)
        near = [
            np.diff(found.place, prepend=0).astype("<u4"), (found.place - found.first).astype("<u2"),
            (found.place - found.last).astype("<u2"), new
        ]
        text, anchors = codec.compress(body, asbytes=True), codec.compress(b"".join(x.tobytes() for x in near), asbytes=True)
        head = np.array([len(ids), len(body), len(starts), len(anchors), *ids, *map(len, texts)], "<i8").tobytes()
        write_file(uri, [head, found.key.astype("<u8").tobytes(), anchors, text])
        return len(starts)

    def __init__(self, uri: str, texts: bool = True):
        with open_file(uri) as file:
            n, size, m, packed = np.frombuffer(file.read(32), "<i8").tolist()
            self.ids, lengths = np.frombuffer(file.read(8 * n), "<i8"), np.frombuffer(file.read(8 * n), "<i8")
            self.offsets = np.concatenate([[0], np.cumsum(lengths)])
            self.key = np.frombuffer(file.read(8 * m), "<u8")
            if not texts:
                return
            near = pa.Codec("zstd").decompress(file.read(packed), 9 * m, asbytes=True) if m else b""
            self.place = np.cumsum(np.frombuffer(near, "<u4", m).astype(np.int64))
            self.first = self.place - np.frombuffer(near, "<u2", m, 4 * m)
            self.last = self.place - np.frombuffer(near, "<u2", m, 6 * m)
            self.new = np.frombuffer(near, bool, m, 8 * m)
            self.data = np.frombuffer(pa.Codec("zstd").decompress(file.read(), size, asbytes=True) if size else b"", np.uint8)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def strings(self, keys: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings whose anchor is among the keys: each string's first here, and those that repeat one of them.

        Anchors whose surroundings came before are left out: their strings are known to repeat.
        """
        at = np.flatnonzero(np.isin(self.key, keys) & self.new)
        starts = _ranges(self.first[at], self.last[at] - self.first[at] + 1)
        _, classes = multikey_sort(word_levels(_padded(self.data)), starts, np.full(len(starts), span))
        first = np.zeros(len(starts), bool)
        first[np.unique(classes, return_index=True)[1]] = True
        return starts[first], starts[~first]


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(7, np.uint8)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(sizes.sum())
    return np.repeat(starts, sizes) + np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _blocks(buckets: np.ndarray, n_buckets: int):
    """(bucket, rows) of the rows grouped by bucket."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def _compressed(head: np.ndarray, body: bytes = b"") -> tuple[bytes, int]:
    """(block, plain size) of a table of int64 and what belongs to it."""
    plain = np.array([head.shape[1], len(body)], "<i8").tobytes() + head.astype("<i8").tobytes() + body
    return pa.Codec("zstd", 1).compress(plain, asbytes=True), len(plain)


def _plain(block: bytes, size: int, rows: int) -> tuple[np.ndarray, bytes]:
    raw = pa.Codec("zstd").decompress(block, size, asbytes=True)
    n, body = np.frombuffer(raw, "<i8", 2).tolist()
    return np.frombuffer(raw, "<i8", rows * n, 16).reshape(rows, n), raw[len(raw) - body :]


def _bytes_at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The strings of this length as one array of fixed-size bytes."""
    if not len(starts):
        return np.zeros(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts]).view(f"S{length}")[:, 0]


def _occurrences(strings: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """The strings followed by their document's id, so that byte order is the order of strings and of their occurrences."""
    n, width = len(strings), strings.dtype.itemsize
    out = np.zeros((n, width + 8), np.uint8)
    out[:, :width] = strings.view(np.uint8).reshape(n, width)
    out[:, width:] = (doc_ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8)
    return out.reshape(-1).view(f"S{width + 8}") if n else np.zeros(0, f"S{width + 8}")


def _split_at(keys: np.ndarray, n: int) -> np.ndarray:
    """At most n - 1 bounds between n ranges that hold about equally many of the sampled keys."""
    keys = np.sort(keys)
    return np.unique(keys[(np.arange(1, n) * len(keys)) // n]) if len(keys) and n > 1 else keys[:0]


def _counted(uid: str, keys: np.ndarray, ordinals: np.ndarray, counts: np.ndarray, n_buckets: int):
    """Rows (bucket, uid, data) of keys to be counted."""
    for b, at in _blocks((keys % np.uint64(n_buckets)).astype(np.int64), n_buckets):
        yield b, uid, keys[at].astype("<u8").tobytes() + ordinals[at].astype("<u4").tobytes() + np.minimum(counts[at], 65535).astype("<u2").tobytes()


def _shared(group: int):
    """Of a bucket's keys those that occur again: their ordinals by pack, with the top bit above group occurrences."""

    def run(table: pa.Table) -> pa.Table:
        uids, blobs = table.column("uid").to_pylist(), table.column("data").to_pylist()
        sizes = np.array([len(b) // 14 for b in blobs])
        keys = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(blobs, sizes)])
        counts = np.concatenate([np.frombuffer(b, "<u2", n, 12 * n) for b, n in zip(blobs, sizes)]).astype(np.int64)
        inverse = np.unique(keys, return_inverse=True)[1]
        total = np.bincount(inverse, counts)[inverse]
        out, ends = [], np.cumsum(sizes)
        for uid, blob, n, e in zip(uids, blobs, sizes, ends):
            mine, ordinals = total[e - n : e], np.frombuffer(blob, "<u4", n, 8 * n)
            named = (ordinals | ((mine > group).astype("<u4") << np.uint32(31)))[mine > 1]
            if len(named):
                out.append((uid, named.astype("<u4").tobytes(), bool((mine > group).any())))
        return pa.table({
            "uid": pa.array([r[0] for r in out], pa.string()), "data": pa.array([r[1] for r in out], pa.binary()),
            "frequent": pa.array([r[2] for r in out], pa.bool_())
        })

    return run


#: What a block between the packs and the buckets holds: surroundings, single strings, or starts already known to repeat.
AROUND, SINGLE, KNOWN = 0, 1, 2
#: Kinds of rows about a pack: that it exists, its k-grams that occur again, its single strings that do.
PACK, KGRAMS, STRINGS = 0, 1, 2
_FOUND = "uid string, data binary, bucket int, string binary, opens boolean"


def _repeats_around(key, doc_id, doc, first, length, shift, source, names, bodies: list[bytes], span: int):
    """(source, doc, first, last) of the string starts that repeat an earlier one, given all surroundings of the k-grams."""
    words = word_levels(np.frombuffer(b"".join([*bodies, bytes(7)]), np.uint8))
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    turn = np.empty(len(key), np.int64)  # order of occurrence
    turn[np.lexsort([first, doc, names[source], doc_id])] = np.arange(len(key))
    kgrams = np.unique(key, return_inverse=True)[1]
    _, classes = multikey_sort(words, starts, length, kgrams * (span + 1) + shift)
    by_turn = np.lexsort([turn, classes])
    head = np.ones(len(key), bool)
    head[1:] = classes[by_turn][1:] != classes[by_turn][:-1]
    again = by_turn[~head]
    yield np.stack([source[again], doc[again], first[again], first[again] + length[again] - span])
    firsts = by_turn[head]
    several = np.bincount(kgrams[firsts], minlength=int(kgrams.max()) + 1)[kgrams[firsts]] > 1
    firsts = firsts[several]
    # every string of the different surroundings of a k-gram; strings of different k-grams are different
    firsts = firsts[np.argsort(kgrams[firsts], kind="stable")]
    sizes = length[firsts] - span + 1
    total, at = np.cumsum(sizes), 0
    edges = np.flatnonzero(np.diff(kgrams[firsts], append=-1)) + 1  # where k-grams end
    while at < len(firsts):  # some hundred thousands of strings at a time, whole k-grams
        done = int(total[at - 1]) if at else 0
        stop = int(edges[min(len(edges) - 1, np.searchsorted(total[edges - 1], done + 1_000_000, side="right"))])
        part, count = firsts[at:stop], sizes[at:stop]
        owner = np.repeat(part, count)
        step = _ranges(np.zeros(len(part), np.int64), count)
        _, same = multikey_sort(words, starts[owner] + step, np.full(len(owner), span), kgrams[owner] * (span + 1) + shift[owner] - step)
        order = np.lexsort([turn[owner], same])
        repeat = order[1:][same[order][1:] == same[order][:-1]]
        yield np.stack([
            source[owner[repeat]], doc[owner[repeat]], first[owner[repeat]] + step[repeat], first[owner[repeat]] + step[repeat]
        ])
        at = stop


def _merged(rows: list[np.ndarray]) -> np.ndarray:
    """(source, doc, first, last) in order, runs of neighbouring starts as one."""
    rows = np.concatenate([np.zeros((4, 0), np.int64), *rows], 1).astype(np.int64)
    rows = rows[:, np.lexsort([rows[2], rows[1], rows[0]])]
    if not rows.shape[1]:
        return rows
    joined = np.zeros(rows.shape[1], bool)
    joined[1:] = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1]) & (rows[2, 1:] <= rows[3, :-1] + 1)
    run = np.flatnonzero(~joined)
    return np.concatenate([rows[:3, run], np.maximum.reduceat(rows[3], run)[None]])


def repeated_spans(
    documents: DataFrame, span: int = SPAN, k: int = KGRAM, pack_bytes: int = PACK_BYTES, group: int = GROUP,
    bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept), one row per row of documents(doc_id, text, ...).

    A byte goes if a string of span bytes that covers it also starts earlier: in a document of smaller id, or
    before in the same. Null texts are empty; texts below span bytes are kept whole. Null ids come first;
    rows with equal ids are ordered by where they were read, so of a repeated row one is kept. spans: the removed runs [start, end) in bytes; kept: the remaining bytes.
    Extra columns are ignored; an empty table gives an empty one.
    """
    if not 16 <= k < span < 1 << 16:
        raise ValueError("16 <= k < span < 65536 is needed")
    spark = documents.sparkSession
    out_dir = scratch_dir(spark, "packs")
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    )
    least_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    @tidy
    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, bodies, size = [], [], 0

        def flush():
            order = sorted(range(len(ids)), key=lambda i: ids[i])
            doc_ids, texts_ = [ids[i] for i in order], [bodies[i] for i in order]
            mark = hashlib.sha1(np.array([*doc_ids, *map(len, texts_)], np.int64).tobytes()).hexdigest()[:12]
            uid = f"{part}-{seq}-{mark}"  # the same for the same rows: a task that runs again rewrites the same pack
            anchors = Pack.write(f"{out_dir}/{uid}", doc_ids, texts_, span, k)
            return pa.RecordBatch.from_arrays(
                [pa.array([uid]), pa.array([sum(map(len, texts_))], pa.int64()), pa.array([anchors], pa.int64())],
                names=["uid", "bytes", "anchors"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(_NULL if doc_id is None else doc_id)
                bodies.append(text.as_py())
                size += len(bodies[-1]) + 64
                if size >= pack_bytes:
                    yield flush()
                    ids, bodies, size, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    # a task that was lost and read its rows in another order leaves packs that no row names
    packs = keep(texts.mapInArrow(pack, "uid string, bytes long, anchors long"), "suffix-packs")
    n_packs, n_bytes, n_anchors = packs.agg(
        F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("anchors"), F.lit(0))
    ).first()
    tasks = max(least_tasks, -(-n_bytes // TASK_BYTES))
    key_buckets = max(2 * least_tasks, -(-14 * n_anchors // bucket_bytes))

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    counted = pa.schema([("bucket", pa.int32()), ("uid", pa.string()), ("data", pa.binary())])

    @tidy
    def kgram_keys(batches):
        for batch in batches:
            for uid in batch.column(0).to_pylist():
                keys, counts = np.unique(Pack(f"{out_dir}/{uid}", texts=False).key, return_counts=True)
                rows = list(_counted(uid, keys, np.arange(len(keys)), counts, key_buckets))
                if rows:
                    yield batch_of(rows, counted)

    def shared(keys: DataFrame, label: str) -> DataFrame:
        return keep(keys.groupBy("bucket").applyInArrow(_shared(group), "uid string, data binary, frequent boolean"), label)

    kgrams = shared(
        packs.select("uid").repartition(tasks, "uid").mapInArrow(kgram_keys, "bucket int, uid string, data binary"), "suffix-kgrams"
    )

    def named(table: pa.Table, kind: int) -> np.ndarray:
        kinds = np.array(table.column("kind").to_pylist())
        blobs = table.column("data").to_pylist()
        return np.frombuffer(b"".join(blobs[i] for i in np.flatnonzero(kinds == kind)), "<u4").astype(np.int64)

    def frequent_and_rest(pack: Pack, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(pack.key)
        return keys[ordinals[ordinals >> 31 == 1] & 0x7FFFFFFF], keys[ordinals[ordinals >> 31 == 0]]

    def string_keys(table: pa.Table) -> pa.Table:
        uid = table.column("uid")[0].as_py()
        pack = Pack(f"{out_dir}/{uid}")
        often, _ = frequent_and_rest(pack, named(table, KGRAMS))
        starts, _ = pack.strings(often, span)
        hashes = _hash_kgrams(pack.data, span)[starts] if len(starts) else np.zeros(0, np.uint64)
        rows = list(_counted(uid, hashes, np.arange(len(starts)), np.ones(len(starts), np.int64), key_buckets))
        return pa.Table.from_batches([batch_of(rows, counted)]) if rows else counted.empty_table()

    about = packs.select("uid", F.lit(PACK).alias("kind"), F.lit(b"").alias("data"))
    about = about.unionByName(kgrams.select("uid", F.lit(KGRAMS).alias("kind"), "data"))
    if kgrams.where("frequent").limit(1).count():
        touched = kgrams.where("frequent").select("uid", F.lit(KGRAMS).alias("kind"), "data").repartition(tasks, "uid")
        strings = shared(touched.groupBy("uid").applyInArrow(string_keys, "bucket int, uid string, data binary"), "suffix-strings")
        about = about.unionByName(strings.select("uid", F.lit(STRINGS).alias("kind"), "data"))

    def chosen(table: pa.Table):
        """The pack, its anchors whose surroundings are compared, the starts of single strings that are, and of those known to repeat."""
        pack = Pack(f"{out_dir}/{table.column('uid')[0].as_py()}")
        often, rest_ = frequent_and_rest(pack, named(table, KGRAMS))
        anchors = np.flatnonzero(np.isin(pack.key, rest_) & pack.new)
        starts, again = pack.strings(often, span) if len(often) else (np.zeros(0, np.int64),) * 2
        return pack, anchors, starts[np.sort(named(table, STRINGS) & 0x7FFFFFFF)], again

    def sampled(table: pa.Table) -> pa.Table:
        pack, anchors, starts, _ = chosen(table)
        some, few = (x[:: max(1, len(x) // SAMPLE_KEYS)] for x in (anchors, starts))
        size = int((pack.last[anchors] - pack.first[anchors] + span + 48).sum())
        singles = _occurrences(_bytes_at(pack.data, few, span), pack.ids[pack.document(few)])
        row = (size, (span + 24) * len(starts), _bytes_at(pack.data, pack.place[some], k).tobytes(), singles.tobytes())
        return pa.table({
            n: pa.array([x], t) for n, x,
            t in zip(("around", "single", "kgrams", "strings"), row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))
        })

    some = packs.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE_PACKS).select("uid")
    sample = about.join(F.broadcast(some), "uid", "left_semi").groupBy("uid").applyInArrow(
        sampled, "around long, single long, kgrams binary, strings binary"
    ).collect()
    scale = n_packs / max(1, len(sample))

    def bounds(column: str, sizes: str, width: int) -> np.ndarray:
        n = max(2 * least_tasks, round(scale * sum(r[sizes] for r in sample)) // bucket_bytes + 1)
        return _split_at(np.frombuffer(b"".join(r[column] for r in sample), f"S{width}"), n)

    around_at, single_at = bounds("kgrams", "around", k), bounds("strings", "single", span + 8)
    n_around = len(around_at) + 1
    blocks = pa.schema([("bucket", pa.int32()), ("uid", pa.string()), ("kind", pa.int32()), ("data", pa.binary()), ("size", pa.int64())])

    def suffixes(table: pa.Table) -> pa.Table:
        uid = table.column("uid")[0].as_py()
        pack, anchors, starts, again = chosen(table)
        rows = []
        if len(anchors):
            first, lengths = pack.first[anchors], pack.last[anchors] - pack.first[anchors] + span
            doc, raw = pack.document(first), pack.data.tobytes()
            buckets = np.searchsorted(around_at, _bytes_at(pack.data, pack.place[anchors], k), side="right")
            for b, at in _blocks(buckets, n_around):
                head = np.stack([
                    pack.key[anchors[at]].view(np.int64), pack.ids[doc[at]], doc[at], first[at] - pack.offsets[doc[at]],
                    lengths[at], pack.place[anchors[at]] - first[at]
                ])
                rows.append((
                    b, uid, AROUND,
                    *_compressed(head, b"".join(raw[s : s + n] for s, n in zip(first[at].tolist(), lengths[at].tolist())))
                ))
        if len(starts):
            doc, strings = pack.document(starts), _bytes_at(pack.data, starts, span)
            buckets = np.searchsorted(single_at, _occurrences(strings, pack.ids[doc]), side="right")
            for b, at in _blocks(buckets, len(single_at) + 1):
                at = at[np.argsort(strings[at], kind="stable")]  # like strings beside each other compress well
                head = np.stack([pack.ids[doc[at]], doc[at], starts[at] - pack.offsets[doc[at]]])
                rows.append((n_around + b, uid, SINGLE, *_compressed(head, strings[at].tobytes())))
        if len(again):
            doc = pack.document(again)
            rows.append((zlib.crc32(uid.encode()) % n_around, uid, KNOWN, *_compressed(np.stack([doc, again - pack.offsets[doc]]))))
        return pa.Table.from_batches([batch_of(rows, blocks)]) if rows else blocks.empty_table()

    def compare(table: pa.Table) -> pa.Table:
        uids, kinds, bucket = table.column("uid").to_pylist(), table.column("kind").to_pylist(), table.column("bucket")[0].as_py()
        names = np.argsort(np.argsort(np.array(uids), kind="stable"), kind="stable")  # rows of equal ids are ordered by pack and place in it
        parts: dict = {AROUND: [], SINGLE: [], KNOWN: []}
        bodies: dict = {AROUND: [], SINGLE: [], KNOWN: []}
        for i, (kind, blob, size) in enumerate(zip(kinds, table.column("data").to_pylist(), table.column("size").to_pylist())):
            head, body = _plain(blob, size, {AROUND: 6, SINGLE: 3, KNOWN: 2}[kind])
            parts[kind].append(np.concatenate([head, np.full((1, head.shape[1]), i)]))
            bodies[kind].append(body)
        rows, edges = [], []
        if parts[KNOWN]:
            doc, first, source = np.concatenate(parts[KNOWN], 1)
            rows.append(np.stack([source, doc, first, first]))
        if parts[SINGLE]:
            doc_id, doc, first, source = np.concatenate(parts[SINGLE], 1)
            body = b"".join(bodies[SINGLE])
            _, classes = multikey_sort(
                word_levels(np.frombuffer(body + bytes(7), np.uint8)), span * np.arange(len(first)), np.full(len(first), span)
            )
            order = np.lexsort([first, doc, names[source], doc_id, classes])
            repeat = order[1:][classes[order][1:] == classes[order][:-1]]
            rows.append(np.stack([source[repeat], doc[repeat], first[repeat], first[repeat]]))
            # what this bucket starts and ends with, for the comparison with the others
            for at, opens in ((int(order[0]), True), (int(order[-1]), False)):
                edges.append((
                    uids[source[at]], np.array([doc[at], first[at], first[at]], "<i8").tobytes(), bucket,
                    body[span * at : span * (at + 1)], opens
                ))
        if parts[AROUND]:
            key, doc_id, doc, first, length, shift, source = np.concatenate(parts[AROUND], 1)
            rows += _repeats_around(key, doc_id, doc, first, length, shift, source, names, bodies[AROUND], span)
        found = _merged(rows)
        cuts = np.searchsorted(found[0], np.arange(len(uids) + 1))
        out = [(u, found[1:, a:b].astype("<i8").tobytes(), None, None, None) for u, a, b in zip(uids, cuts[:-1], cuts[1:]) if a < b] + edges
        return pa.table({
            n: pa.array([r[i] for r in out], t) for i,
            (n, t) in enumerate((
                ("uid", pa.string()), ("data", pa.binary()), ("bucket", pa.int32()), ("string", pa.binary()), ("opens", pa.bool_())
            ))
        })

    def finish(table: pa.Table) -> pa.Table:
        uid = table.column("uid")[0].as_py()
        pack = Pack(f"{out_dir}/{uid}")
        doc, first, last = np.concatenate(
            [np.zeros((3, 0), np.int64), *(np.frombuffer(b, "<i8").reshape(3, -1) for b in table.column("data").to_pylist())], 1
        ).astype(np.int64)
        first = np.concatenate([pack.offsets[doc] + first, pack.first[~pack.new]])
        last = np.concatenate([pack.offsets[doc] + last, pack.last[~pack.new]]) + span
        depth = np.bincount(first, minlength=len(pack.data) + 1) - np.bincount(last, minlength=len(pack.data) + 1)
        gone = np.cumsum(depth)[: len(pack.data)] > 0
        columns: list[list] = [[] for _ in range(7)]
        for doc_id, a, b in zip(pack.ids.tolist(), pack.offsets[:-1].tolist(), pack.offsets[1:].tolist()):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).view(np.int8))).reshape(-1, 2)
            kept = pack.data[a:b][~mine].tobytes()
            row = (
                None if doc_id == _NULL else doc_id, b - a, int(mine.sum()), len(edges), hashlib.sha256(kept).hexdigest(),
                [{"start": int(x), "end": int(y)} for x, y in edges], kept
            )
            for column, value in zip(columns, row):
                column.append(value)
        types = [
            pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
            pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()
        ]
        return pa.table({
            n: pa.array(c, t) for n, c,
            t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"), columns, types)
        })

    # a pack costs the same however few bytes name it, so the packs' tasks are not merged by their shuffled size
    moved = about.repartition(tasks, "uid").groupBy("uid").applyInArrow(
        suffixes, "bucket int, uid string, kind int, data binary, size long"
    )
    found = keep(moved.groupBy("bucket").applyInArrow(compare, _FOUND), "suffix-repeats")
    edges = found.where("string is not null")
    # a bucket that opens with a string that an earlier one holds as well opens with a repeat of it
    lowest = edges.groupBy("string").agg(F.min("bucket").alias("lowest"))
    opened = edges.where("opens").join(lowest, "string").where("bucket > lowest")
    starts = packs.select("uid", F.lit(b"").alias("data")).unionByName(found.where("string is null").select("uid", "data")).unionByName(opened.select("uid", "data"))
    return starts.repartition(tasks, "uid").groupBy("uid").applyInArrow(
        finish,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    )
