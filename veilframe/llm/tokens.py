"""Token ids in files of directly addressable codes.

An id is cut into chunks of CHUNK_BITS bits, lowest first. Level k holds the k-th chunks of the ids that
have one, a bitmap says which of them go on in level k + 1, and a directory of ranks (set
bits before each block of RANK_BLOCK) leads there. So token i is found with a rank
lookup for each level, without decoding its neighbours.

File, all little-endian: magic ``DAC1``, uint32 levels, uint64 documents, uint64 tokens, int64
document ids, a byte per document that is 1 if its id is null, uint64 offsets (documents + 1) of the
documents' first tokens, and for each level uint64 n, n chunk bytes, the bitmap (n bits, lowest
first, padded to a byte) and uint32 ranks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep, open_file, shared_dir, small_batches, tidy, write_file

CHUNK_BITS = 8
RANK_BLOCK = 512
FILE_TOKENS = 4_000_000
#: Words in a generation of a worker's cache: some 150 bytes each.
CACHE_WORDS = 600_000
#: Longer pieces (texts without spaces) are not kept.
KEPT_CHARS = 64
#: Bytes of texts that are encoded together, or one text.
BLOCK_BYTES = 4_000_000
#: Letters up to Latin Extended-B, which every version of Unicode takes for letters, and ASCII marks but the apostrophe.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]*"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level; no ids: no levels."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        chunks, rest = (rest & 255).astype(np.uint8), rest >> CHUNK_BITS
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        # the ranks come from counts of whole blocks: entry b = continuations before bit b * RANK_BLOCK
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint32)
        levels.append((chunks, bitmap, np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.uint32)))
        rest = rest[more]
    return levels


def decode_levels(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids."""
    if not levels:
        return np.zeros(0, np.uint32)
    ids = np.zeros(len(levels[0][0]), np.uint32)
    at = np.arange(len(ids))
    for k, (chunks, bitmap, _) in enumerate(levels):
        ids[at] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * k)
        at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
    return ids


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray):
    """The blocks of a file."""
    levels = encode_levels(ids)
    yield b"DAC1" + struct.pack("<IQQ", len(levels), len(doc_ids), len(ids))
    yield np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    yield bytes(x is None for x in doc_ids)
    yield np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()
    for chunks, bitmap, ranks in levels:
        yield struct.pack("<Q", len(chunks))
        yield chunks.tobytes()
        yield bitmap.tobytes()
        yield ranks.astype("<u4").tobytes()


class TokenFile:
    """A file of codes, read in place: only what an access needs is fetched."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        if self._read(0, 4) != b"DAC1":
            raise ValueError(f"not a token file: {uri}")
        levels, self.documents, self.tokens = struct.unpack("<IQQ", self._read(4, 20))
        at = 24
        nulls = self._read(at + 8 * self.documents, self.documents)
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(self._read(at, 8 * self.documents), "<i8"), nulls)]
        at += 9 * self.documents
        self.offsets = np.frombuffer(self._read(at, 8 * (self.documents + 1)), "<u8").astype(np.int64)
        at += 8 * (self.documents + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack("<Q", self._read(at, 8))
            at += 8
            ranks_at = at + n + (n + 7) // 8
            self.levels.append((n, at, at + n, ranks_at))
            at = ranks_at + 4 * ((n + RANK_BLOCK - 1) // RANK_BLOCK)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def token(self, i: int) -> int:
        """Token i of the file."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for k, (n, chunks, bitmap, ranks) in enumerate(self.levels):
            value |= self._read(chunks + i, 1)[0] << (CHUNK_BITS * k)
            block = i // RANK_BLOCK
            first = block * RANK_BLOCK
            bits = np.unpackbits(np.frombuffer(self._read(bitmap + first // 8, (i - first) // 8 + 1), np.uint8), bitorder="little")
            if not bits[i - first]:
                return value
            (before,) = struct.unpack("<I", self._read(ranks + 4 * block, 4))
            i = before + int(bits[: i - first].sum())
        return value

    def ids(self) -> np.ndarray:
        """All tokens of the file."""
        parts = [
            (np.frombuffer(self._read(c, n), np.uint8), np.frombuffer(self._read(b, (n + 7) // 8), np.uint8), None) for n, c, b,
            _ in self.levels
        ]
        return decode_levels(parts)

    def close(self) -> None:
        self.file.close()


def by_words(definition: dict) -> bool:
    """Whether a tokenizer, given its JSON definition, encodes a text's words one by one.

    That is so for byte-level pair encoding that splits by the usual expression, changes nothing before, adds no space in
    front, drops and cuts nothing, and has no added token that takes white space in, looks at its neighbours or goes from
    letters on to marks.
    """
    split, model = definition.get("pre_tokenizer") or {}, definition.get("model") or {}
    plain = all(definition.get(x) is None for x in ("normalizer", "truncation", "padding"))
    level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    pairs = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    tokens = definition.get("added_tokens") or []
    apart = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not re.search(r"\s", t["content"]) for t in tokens)
    inside = all(t["content"].isalpha() or not re.fullmatch(LETTERS + MARKS, t["content"]) for t in tokens)
    return bool(plain and level and pairs and apart and inside)


class WordEncoder:
    """Whole-text encoding by the tokenizers library, with the ids of words kept.

    The tokenizer's splitting always starts anew at a space that is followed by a character other than white space, whatever
    stands before it. So the ids of a text are those of what precedes the first such space, and of each further piece with its
    space. That holds for the tokenizers that by_words() admits; with others, texts go through the library whole.
    Splitting starts anew, too, between letters and marks and on both sides of a line break that stands alone, so pieces like
    these are put together from their parts, of which there are fewer.
    Texts are cut, pieces told apart and ids put in a row by Arrow; a piece is looked up once for all texts of a block.
    Words are kept in two generations, so that frequent ones outlive a full cache; pieces of over KEPT_CHARS are not kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole_only = not by_words(json.loads(self.tokenizer.to_str()))
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.cut = re.compile(r" (?=\S)")
        self.form = re.compile(rf"({LETTERS})({MARKS})(?:\n({LETTERS})({MARKS}))?")
        size = 1 + max(self.tokenizer.get_vocab().values(), default=0)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"  # ids are kept as small as they are
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.opens = {sign: np.array([x.startswith(as_byte) for x in tokens]) for sign, as_byte in ((" ", "Ġ"), ("\n", "Ċ"))}
        self.line = b"" if self.whole_only else self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return self._ids([text])[0].tobytes()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], sign: str) -> dict[str, bytes]:
        """The ids of words behind a space (with its token) or a line break (without), encoded together and cut where a token opens with it."""
        out: dict[str, bytes] = {}
        for k in range(0, len(words), 1024):
            part = words[k : k + 1024]
            ids = self._ids([sign + sign.join(part)])[0]
            cuts = np.flatnonzero(self.opens[sign][ids])
            if len(cuts) != len(part):
                out.update((w, self._whole(w if sign == "\n" else sign + w)) for w in part)
                continue
            data, begin, end = ids.tobytes(), cuts + (sign == "\n"), np.append(cuts[1:], len(ids))
            out.update(zip(part, map(data.__getitem__, map(slice, (begin * ids.itemsize).tolist(), (end * ids.itemsize).tolist()))))
        return out

    def _heads(self, words: set[str]) -> dict[str, bytes]:
        """The ids of what nothing stands before."""
        found = {w: self.first.get(w) for w in words}
        new = [w for w, ids in found.items() if ids is None]
        plain = [w for w in new if w.isalpha()]
        found |= self._together(plain, "\n")
        other = [w for w in new if not w.isalpha()]
        found.update(zip(other, (x.tobytes() for x in self._ids(other))))
        if len(self.first) + len(new) > CACHE_WORDS // 8:
            self.first = {}
        self.first.update((w, found[w]) for w in new if len(w) <= KEPT_CHARS)
        return found

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of further pieces, each with its space, that self.rest does not hold."""
        if len(self.rest) + len(words) > CACHE_WORDS:
            self.rest, self.old = {}, self.rest
        rest, old, marks = self.rest, self.old, self.marks
        if len(marks) > CACHE_WORDS // 8:
            marks = self.marks = {"": b""}
        out, plain, alone, made, match = {}, [], [], [], self.form.fullmatch
        for w, ids in zip(words, map(old.get, words)):
            if ids is not None:
                out[w] = ids
            elif w.isalpha() and len(w) <= KEPT_CHARS:
                plain.append(w)
            elif len(w) > KEPT_CHARS or " " in w:
                alone.append(w)
            elif form := match(w):
                made.append((w, *form.groups()))
            else:
                plain.append(w)
        stems = [*{x[1] for x in made}.difference(plain)]
        for stem, ids in zip(stems, map(rest.get, stems)):
            ids = ids or old.get(stem)
            if ids is None:
                plain.append(stem)
            else:
                out[stem] = ids
        out.update(self._together(plain, " "))
        for x in {y for x in made for y in x[2::2]} - marks.keys() - {None}:
            marks[x] = self._whole(x)
        firsts = self._heads({x[3] for x in made} - {None})
        whole = {}
        for w, stem, tail, head, head_tail in made:
            if head:
                whole[w] = out[stem] + marks[tail] + self.line + firsts[head] + marks[head_tail]
            else:
                out[w] = out[stem] + marks[tail]
        rest.update(out)
        whole.update(zip(alone, (x.tobytes() for x in self._ids([" " + w for w in alone]))))
        rest.update((w, whole[w]) for w in alone if len(w) <= KEPT_CHARS)
        out.update(whole)
        return [*map(out.get, words)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if self.whole_only:
            return [x.astype("<u4").tobytes() for x in self._ids(texts.to_pylist())]
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        out, at = [], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            out += self._block(texts.slice(at, to - at))
            at = to
        return out

    def _block(self, texts: pa.Array) -> list[bytes]:
        pieces = pc.split_pattern(texts, " ")
        starts, coded = pieces.offsets.to_numpy().astype(np.int64), pieces.values.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        order = np.arange(len(texts))
        white = [j for j, w in enumerate(words) if not w or w[0].isspace()]
        inner = np.ones(len(codes), bool)
        inner[starts[:-1]] = False
        uncut = np.flatnonzero(np.isin(codes, white) & inner) if white else ()
        if len(uncut):  # texts with a space before white space or the end are cut again, and come last
            odd = np.unique(np.searchsorted(starts, uncut, "right") - 1)
            even = np.setdiff1d(order, odd)
            index = {w: j for j, w in enumerate(words)}
            cut = [self.cut.split(text) for text in texts.take(pa.array(odd)).to_pylist()]
            again = [index.setdefault(w, len(index)) for piece in cut for w in piece]
            words, lengths = [*index], np.diff(starts)
            codes = np.concatenate([codes[~np.repeat(np.isin(order, odd), lengths)], np.array(again, codes.dtype)])
            starts = np.concatenate([[0], np.cumsum(np.concatenate([lengths[even], [len(x) for x in cut]]))]).astype(np.int64)
            order = np.concatenate([even, odd])
            inner = np.ones(len(codes), bool)
            inner[starts[:-1]] = False
        used = np.zeros(len(words), bool)
        used[codes[inner]] = True
        found = [*map(self.rest.get, words)]
        used = used.tobytes()
        missing = [j for j, ids in enumerate(found) if ids is None and used[j]]
        step = max(1, CACHE_WORDS // 4)
        for k in range(0, len(missing), step):
            part = missing[k : k + step]
            for j, ids in zip(part, self._learn([words[j] for j in part])):
                found[j] = ids
        heads = [words[j] for j in codes[starts[:-1]].tolist()]
        firsts = self._heads(set(heads))
        codes = codes.astype(np.int64)
        codes[starts[:-1]] = len(words) + np.arange(len(heads))
        # what is no further piece of any text has no ids and is not asked for
        rows = pa.array(found + [firsts[w] for w in heads], pa.large_binary()).take(pa.array(codes))
        _, bounds, data = rows.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(codes) + 1)
        ids = np.frombuffer(data or b"", np.uint8, bounds[-1]).view(self.kind).astype("<u4")
        bounds = (bounds[starts] // np.dtype(self.kind).itemsize).tolist()
        out: list[bytes] = [b""] * len(texts)
        for j, a, b in zip(order.tolist(), bounds, bounds[1:]):
            out[j] = ids[a:b].tobytes()
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(
    documents: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 0, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Encode documents(doc_id, text, ...) into files; a row (part, seq, path, documents, tokens) per file.

    Null or empty texts have the end id only. Documents are in ascending order of id over
    the files in order of (part, seq), a null id first; rows with equal ids follow in order of a
    hash of their text. Other columns are ignored; an empty table has no files.
    """
    small_batches(documents.sparkSession)
    out_dir = out_dir or shared_dir(documents.sparkSession, "tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("order"))
    rows = rows.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    @tidy
    def write(batches):
        part, seq = TaskContext.get().partitionId(), 0
        coder, doc_ids, blocks, tokens = encoder(tokenizer_path), [], [], 0

        def flush():
            path = f"{out_dir}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            ids = np.frombuffer(b"".join(blocks), "<u4")
            write_file(path, pack_file(doc_ids, [len(b) // 4 for b in blocks], ids))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x], t) for x,
                    t in ((part, pa.int64()), (seq, pa.int64()), (path, pa.string()), (len(doc_ids), pa.int64()), (len(ids), pa.int64()))
                ],
                names=["part", "seq", "path", "documents", "tokens"]
            )

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                doc_ids.append(doc_id)
                blocks.append(data + end)
                tokens += len(data) // 4 + 1
                if tokens >= file_tokens:
                    yield flush()
                    doc_ids, blocks, tokens, seq = [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    return keep(rows.mapInArrow(write, "part long, seq long, path string, documents long, tokens long"), "token-list")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in files: their ids decoded from the files.

    start counts the tokens of all documents before; the prefix sum runs over a row per file.
    """
    ahead = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base"))
    files = files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    @tidy
    def read(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(path)
                data, offsets = file.ids().astype("<u4").tobytes(), file.offsets
                file.close()
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, pa.int64()), pa.array(offsets[:-1] + base, pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
