"""WARC archives and exact search against brute force."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import topk, warc
from veilframe.llm.storage import shared_dir, write_file

PAGES = "page_id long, url string, html string, sha string, salt string"


def brute_pages(rows, least):
    first: dict = {}
    for i, _, html, *_ in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        revisit = i is not None and len(data) >= least and first[html or ""] != i
        out.append((
            i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
            first[html or ""] if revisit else None
        ))
    return Counter(out)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize(
    "compress, split, least", [(True, 16 << 20, 0), (True, 700, 0), (False, 16 << 20, 5), (False, 500, 0), (False, 97, 0)]
)
def test_archives_round_trip(spark, compress, split, least):
    rows = [(k, f"http://x/{k} y?é", "<p>" + "ab" * k + "</p>", "s", "t") for k in range(30)]
    rows += [(100 + k, "http://same", "<html>same</html>", "s", "t") for k in range(20)] + [(7, "http://x", "<html>same</html>", "s", "t")]
    rows += [
        (200, None, None, "s", "t"), (201, "u", "", "s", "t"), (None, "n", "<html>same</html>", "s", "t"),
        (202, "a\r\nb", FAKE * 3, "s", "t"), (203, "f", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n", "s", "t"),
        (204, "l", "é" * 30000, "s", "t"), (205, "m", "WARC/1.1\r\n" * 50, "s", "t"),
        (3, "http://x/3 y?é", "<p>ababab</p>", "s", "t")
    ]
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES), min_payload=least, compress=compress, file_bytes=4000)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    found = warc.read_archives(archives, split).collect()
    assert Counter((
        r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]
    ) for r in found) == brute_pages(rows, least)
    if not compress:
        seen = warc.candidates(archives, split).where("page_id = 666").count()
        assert seen >= 3  # records inside a payload are candidates, but no chain reaches them


def test_large_groups_of_copies_and_very_long_headers(spark):
    rows = [(k, f"u{k}", "<p>often</p>", "s", "t") for k in range(60)] + [(100 + k, f"u{k}", f"<p>{k // 2}</p>", "s", "t") for k in range(20)]
    rows += [(200, "long " + "x" * (3 << 20), "after a long url", "s", "t"), (201, "u", FAKE, "s", "t"), (202, "u", "last", "s", "t")]
    for hot in (100, warc.HOT_BYTES):
        archives = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), compress=False, file_bytes=2000, hot_bytes=hot)
        found = warc.read_archives(archives, 1 << 20).collect()
        assert Counter((
            r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]
        ) for r in found) == brute_pages(rows, 0)


def test_no_pages(spark):
    archives = warc.write_archives(spark.createDataFrame([], PAGES))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0


def test_broken_chain_ends_there(spark):
    good = FAKE.replace("666", "1").encode()
    path = shared_dir(spark, "broken") + "/a.warc"
    size = write_file(path, [good, b"garbage", good])
    archives = spark.createDataFrame([(path, size)], "path string, size long")
    assert [r["page_id"] for r in warc.read_archives(archives).collect()] == [1]


def brute_top(rows, k):
    valid = [
        (i, np.floor(256 * np.array(v, float)).astype(object)) for i,
        v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, q in valid:
        if i % 50 == 0:
            scores = sorted(((-sum(int(a) * int(b) for a, b in zip(q, v)), j) for j, v in valid if j != i))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return Counter(out)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_search_equals_all_products(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    rng = np.random.default_rng(5)
    lengths = np.exp(rng.normal(0, spread, 600))
    data = (rng.normal(0, 1, (600, 8)) * lengths[:, None]).astype(np.float32)
    data[100:140] = data[50]
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    rows += [
        (1000, None), (1050, [float("nan")] * 8), (1100, [1.0, None] * 4), (1150, [float("inf")] * 8), (None, [1.0] * 8),
        (1200, [0.0] * 8), (1250, [1.0] * 3), (1300, [])
    ]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, norm double")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5)
    assert Counter(map(tuple, got.collect())) == brute_top(rows, 5)
    assert topk.top_k(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0, 5).count() == 2
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_huge_components_do_not_lose_digits():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0]])
    assert topk._product(a, b)[0, 0] == 2**60 + 3
    assert topk._product(a * 2.0**20, b * 2.0**20)[0, 0] == 2**63 - 1


def test_pruning_leaves_less_to_verify():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (2000, 16)) * np.exp(rng.normal(0, 1.5, 2000))[:, None]
    norms = np.linalg.norm(x, axis=1)
    order = np.argsort(-norms)
    x, norms = np.floor(256 * x[order]), np.linalg.norm(np.floor(256 * x[order]), axis=1)
    best, seen = topk._Best(5, 3), {}
    keep = np.argsort(-norms, kind="stable")
    x, norms = x[keep], norms[keep]
    for a in range(0, 2000, 200):
        topk.bucket_search(x[:5], np.arange(5), x[a : a + 200], np.arange(a, a + 200), norms[a : a + 200], best, seen)
    assert seen["verified"] < 5 * 2000 / 2
