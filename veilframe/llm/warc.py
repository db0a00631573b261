"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

A reader that starts in the middle of an archive cannot trust the record magic: a
payload may hold it as well, even a whole well-formed record. So the tasks that scan the splits
emit every *candidate* record with the offset of its successor, and only candidates that
a chain of successors reaches from offset 0 of the file are records. Chains are followed
by pointer jumping: within a split in numpy, between the splits of a file
by joining the split-to-split pointers with themselves.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep, open_file, shared_dir, write_file

GZIP_MAGIC = b"\x1f\x8b\x08"
WARC_MAGIC = b"WARC/1.1\r\n"
#: Bytes of equal payloads above which their rows are not brought together: there are no more such payloads than the table has
#: times this many bytes, so 100 TB have 400,000 at most, of some 40 bytes each when they are broadcast.
HOT_BYTES = 256 << 20

RECORD_SCHEMA = (
    "path string, split long, offset long, successor long, exit long, page_id long, url string, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def digest32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record(page_id, url, payload: bytes, sha_hex: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    uri = "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest32(sha_hex)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Target-URI-Null: {int(url is None)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        ]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _parse(data: bytes) -> tuple[dict, bytes, int] | None:
    """Header fields, payload and length of the record at the start of data; None if there is none."""
    if not data.startswith(WARC_MAGIC):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(line.split(": ", 1) for line in data[len(WARC_MAGIC) : end].decode("utf-8", "replace").split("\r\n") if ": " in line)
    size = fields.get("Content-Length", "")
    if not (size.isascii() and size.isdigit()):
        return None
    stop = end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    return fields, data[end + 4 : stop], stop + 4


def _id(text: str | None) -> int | None:
    text = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _row(fields: dict, payload: bytes) -> tuple:
    kind = fields.get("WARC-Type", "")
    if kind == "revisit":
        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url = None if fields.get("X-Target-URI-Null") == "1" else fields.get("WARC-Target-URI", "")
    return _id(fields.get("WARC-Record-ID")), url, size, digest, kind, _id(fields.get("WARC-Refers-To"))


def write_archives(
    pages: DataFrame, out_dir: str | None = None, min_payload: int = 0, compress: bool = True, file_bytes: int = 16 << 20,
    hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """Write a record per row of pages(page_id, url, html, ...); a row (path, size, records) per archive.

    Payload: html in UTF-8, null as empty. Among rows with equal payloads of at least
    ``min_payload`` bytes the smallest page_id is a response, rows with other ids revisit it;
    repeated rows of that id are responses too. A null page_id is always a response and never
    referred to. A null url stays null. Other columns are ignored; no rows, no archives.
    Rows meet the first page of their payload by its digest; those of payloads with more than hot_bytes in all stay
    where they are and have it broadcast, so no group of copies, however large, meets in one task.
    """
    spark = pages.sparkSession
    out_dir = out_dir or shared_dir(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("sha", F.sha1("payload"))
    firsts = (
        rows.where(F.col("page_id").isNotNull() & (F.length("payload") >= min_payload))
        .groupBy("sha")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.sum(F.length("payload")).alias("bytes"))
        .where("last_id > first_id")
        .select("sha", "first_id", "bytes")
    )
    firsts = keep(firsts, "warc-firsts")
    hot, cold = (firsts.where(x).select("sha", "first_id") for x in (F.col("bytes") > hot_bytes, F.col("bytes") <= hot_bytes))
    if hot.limit(1).count():
        joined = rows.join(F.broadcast(hot), "sha").unionByName(rows.join(F.broadcast(hot), "sha", "left_anti").join(cold, "sha", "left"))
    else:
        joined = rows.join(cold, "sha", "left")
    joined = joined.select(
        "page_id", "url", "payload", "sha",
        F.when((F.length("payload") >= min_payload) & (F.col("first_id") != F.col("page_id")), F.col("first_id")).alias("refers_to")
    )

    def write(batches):
        blocks, size, n = [], 0, 0

        def flush():
            path = f"{out_dir}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([write_file(path, blocks)], pa.int64()), pa.array([n], pa.int64())],
                names=["path", "size", "records"]
            )

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, payload, sha, refers_to = (c[i].as_py() for c in columns)
                record = _record(page_id, url, payload, sha, refers_to)
                if compress:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    record = z.compress(record) + z.flush()
                blocks.append(record)
                size, n = size + len(record), n + 1
                if size >= file_bytes:
                    yield flush()
                    blocks, size, n = [], 0, 0
        if n:
            yield flush()

    return keep(joined.mapInArrow(write, "path string, size long, records long"), "warc-list")


class _Window:
    """Bytes of a file from an offset on, read as far as they are asked for."""

    def __init__(self, file, start: int, size: int, first: int):
        self.file, self.start, self.size = file, start, size
        self.data = b""
        self.more(first)

    def more(self, n: int) -> bool:
        at = self.start + len(self.data)
        n = min(n, self.size - at)
        if n <= 0:
            return False
        self.file.seek(at)
        self.data += self.file.read(n)
        return True


def _candidate(window: _Window, at: int, gz: bool):
    """(successor, row) of the candidate at this place of the window, or None."""
    if gz:
        z, out, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if pos >= len(window.data) and not window.more(1 << 20):
                    return None
                chunk = window.data[pos : pos + (1 << 18)]
                out.append(z.decompress(chunk))
                pos += len(chunk)
        except zlib.error:
            return None
        pos -= len(z.unused_data)
        data = b"".join(out)
        found = _parse(data)
        if not found or found[2] != len(data):
            return None
        return window.start + pos, _row(found[0], found[1])
    need = 1 << 16
    window.more(at + need - len(window.data))
    while True:
        view = window.data[at : at + need]
        if found := _parse(view):
            return window.start + at + found[2], _row(found[0], found[1])
        end = view.find(b"\r\n\r\n")
        if end >= 0:
            size = dict(x.split(b": ", 1) for x in view[:end].split(b"\r\n") if b": " in x).get(b"Content-Length", b"")
            if not size.isdigit() or len(view) >= end + int(size) + 8:
                return None
            need = max(need, end + int(size) + 8)
        else:  # the header's end is near: even magic in a payload is followed by the end of the record around it
            need *= 4
        if at + need > len(window.data) and not window.more(at + need - len(window.data)):
            return None  # the file ends before the record does


def jump(successor: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each candidate the first offset on its chain that is not a candidate here (pointer jumping)."""
    if not len(offsets):
        return successor
    place = np.searchsorted(offsets, successor)
    inside = (place < len(offsets)) & (offsets[np.minimum(place, len(offsets) - 1)] == successor)
    hop = np.where(inside, place, np.arange(len(offsets)))
    while True:
        far = hop[hop]
        if (far == hop).all():
            return successor[hop]
        hop = far


def reached(successor: np.ndarray, offsets: np.ndarray, entry: int) -> np.ndarray:
    """Which of the sorted candidates the chain from entry passes, by doubling jumps."""
    n = len(offsets)
    mark = np.zeros(n + 1, bool)
    at = np.searchsorted(offsets, entry)
    if at >= n or offsets[at] != entry:
        return mark[:n]
    place = np.searchsorted(offsets, successor)
    inside = (place < n) & (offsets[np.minimum(place, n - 1)] == successor)
    hop = np.append(np.where(inside, place, n), n)
    mark[at] = True
    while True:
        new = mark.copy()
        new[hop[np.flatnonzero(mark)]] = True
        new[n] = False
        hop = hop[hop]
        if (hop == n).all() and (new == mark).all():
            return mark[:n]
        mark = new


def candidates(archives: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """Every candidate record of archives(path, size): where it starts, its successor, and the first
    offset outside its split that its chain leads to (``exit``)."""
    spark = archives.sparkSession
    splits = archives.where("size > 0").select(
        "path", "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / split_bytes).cast("long"))).alias("split")
    )
    splits = splits.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def scan(batches):
        for batch in batches:
            for path, size, split in zip(*(c.to_pylist() for c in batch.columns)):
                gz = path.endswith(".gz")
                magic = GZIP_MAGIC if gz else WARC_MAGIC
                start, stop = split * split_bytes, min(size, (split + 1) * split_bytes)
                rows, offsets, after = [], [], []
                with open_file(path) as file:
                    window = _Window(file, start, size, stop - start + len(magic) - 1)
                    at = window.data.find(magic)
                    while 0 <= at < stop - start:
                        if found := _candidate(window, at, gz):
                            offsets.append(start + at)
                            after.append(found[0])
                            rows.append(found[1])
                        at = window.data.find(magic, at + 1)
                exits = jump(np.array(after, np.int64), np.array(offsets, np.int64)).tolist()
                if rows:
                    n = len(rows)
                    columns = [[path] * n, [split] * n, offsets, after, exits, *zip(*rows)]
                    types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return splits.mapInArrow(scan, RECORD_SCHEMA)


def read_archives(archives: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of archives(path, size): RECORD_SCHEMA without the chain's columns.

    Candidates are kept in the shared folder. Entry offsets of the splits come from doubling the
    exits (as many joins as the logarithm of the splits of the longest file; none if every
    file is one split), then each split keeps what its entry reaches. Empty archives have no records.
    """
    found = keep(candidates(archives, split_bytes), "warc-candidates")
    entries = archives.where("size > 0").select("path", F.lit(0).cast("long").alias("offset"))
    splits = archives.agg(F.max(F.ceil(F.col("size") / split_bytes))).first()[0] or 0
    pointers, span = found.select("path", "offset", "exit"), 1
    while span < splits:
        step = entries.join(pointers, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        entries = keep(entries.union(step).distinct(), "warc-entries")
        twice = pointers.alias("a").join(
            pointers.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.exit") == F.col("b.offset")), "left"
        )
        pointers = keep(twice.select("a.path", "a.offset", F.coalesce("b.exit", "a.exit").alias("exit")), "warc-pointers")
        span *= 2
    # an entry that is no candidate here is the file's end or a broken chain: nothing follows it
    marked = found.join(entries.withColumn("entry", F.lit(True)), ["path", "offset"], "left")

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        offsets, after = (table.column(c).to_numpy() for c in ("offset", "successor"))
        keep_rows = np.zeros(len(offsets), bool)
        for at in np.flatnonzero(np.array([x is not None for x in table.column("entry").to_pylist()])):
            keep_rows |= reached(after, offsets, offsets[at])
        return table.filter(pa.array(keep_rows)).select([
            "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "offset"
        ])

    return marked.groupBy("path", "split").applyInArrow(
        walk,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"
    )
