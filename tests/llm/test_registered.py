"""The registered queries against their SQL twins, and the pipeline against its parts done by hand."""

from __future__ import annotations

import hashlib
import os
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import rows_of, twin

from veilframe.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    df = QUERIES[name](spark, SF)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert (names, got) == twin(ORACLES[name], SF)


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


LONG, TEXT, YES, REAL, WHOLE = "bigint", "string", "boolean", "double", "int"
CONTRACT = {
    "op1_warc": ("pages", {"page_id": LONG, "payload_bytes": LONG, "payload_digest": TEXT, "record_type": TEXT, "refers_to": LONG}),
    "op2_jaccard": ("documents", {"doc_id": LONG, "class_id": LONG, "n_links": LONG}),
    "op3_decontaminate": (
        "documents", {"doc_id": LONG, "n_words": LONG, "n_hit": LONG, "n_items": LONG, "items_sha256": TEXT, "contaminated": YES}
    ),
    "op4_pii": (
        "documents",
        {"doc_id": LONG, "n_email": LONG, "n_ip": LONG, "n_card": LONG, "n_phone": LONG, "base_sha256": TEXT, "spans": TEXT}
    ),
    "op5_tokens": ("documents", {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG}),
    "op6_suffixes": ("documents", {"doc_id": LONG, "n_bytes": LONG, "n_removed": LONG, "n_spans": LONG, "kept_sha256": TEXT}),
    "op7_quality": ("documents", {"doc_id": LONG, "held_out": YES, "score": REAL, "predicted": WHOLE}),
    "op8_top_k": (None, {"query_id": LONG, "rank": WHOLE, "vec_id": LONG, "score": LONG}),
    "op9_language": ("documents", {"doc_id": LONG, "held_out": YES, "lang_pred": TEXT, "score": REAL}),
    "op10_mix": ("documents", {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": REAL, "taken": LONG}),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, name):
    """Every registered query over its whole table, by columns and rows; those without a twin by value."""
    from test_corpus_operators import TOKENIZER, brute_languages, brute_pii
    from tokenizers import Tokenizer

    table, columns = CONTRACT[name]
    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == columns
    if name in ORACLES:
        return  # compared with its twin above
    rows = {r["doc_id"]: r for r in df.collect()}
    source = spark.read.parquet(f"{SF}/{table}.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in source}
    assert rows.keys() == texts.keys() and len(rows) == len(source)
    if name == "op4_pii":
        for i, t in texts.items():
            spans = brute_pii(t)
            assert rows[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
            assert [rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in spans.split(",")) for k in ("email", "ip", "card", "phone")]
            assert [s for s in rows[i]["spans"].split(",") if s and not s.startswith("term:")] == [s for s in spans.split(",") if s]
    elif name == "op5_tokens":
        t, start = Tokenizer.from_file(TOKENIZER), 0
        for i in sorted(texts):
            ids = np.array(t.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
            assert tuple(rows[i])[:4] == (i, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    elif name == "op9_language":
        out = [r["doc_id"] for r in source if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
        assert sorted(i for i, r in rows.items() if r["held_out"]) == sorted(out)
        plain = brute_languages([(r["doc_id"], r["text"], r["lang"], None) for r in source], lambda i: zlib.crc32(str(i).encode()) % 4 != 2)
        assert all(rows[i]["lang_pred"] == lang and abs(rows[i]["score"] - s) < 1e-6 for i, lang, s in plain)
    elif name == "op7_quality":
        assert all(
            r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i,
            r in rows.items()
        )


NAMES = [
    "score", "lang_pred", "tie", "n", "t", "id", "least", "number", "times", "row", "mine", "cls", "root", "key", "taken", "h",
    "spans"
]


def documents_with(spark, rows):
    """rows (doc_id, text, lang, source) in a table with the columns of documents and others that have the operators' names."""
    own = ", ".join(f"`{c}` {'int' if k % 2 else 'string'}" for k, c in enumerate(NAMES))
    full = [(i, t, lang, s, None if t is None else len(t), *(k if k % 2 else f"x{k}" for k in range(len(NAMES)))) for i, t, lang, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {own}")


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_awkward_tables(spark, tmp_path, stage):
    """Null ids, texts, languages and sources, repeated rows and ids, a very long text, columns of the stages' own names, and no rows."""
    import random

    import corpus_pipeline as cp
    from frames import edge_rows, sentence

    rng = random.Random(31)
    item = sentence(rng, 20)
    spark.createDataFrame(
        [(1, item), (None, sentence(rng, 15)), (2, None), (1, item)], "item_id long, text string"
    ).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i, t in edge_rows()]
    rows += [(100 + k, sentence(rng, 30), "en", "a") for k in range(12)] + [
        (100, rows[5][1], None, "b"), (None, None, None, None), (None, item, "en", None),
        (7, f"{sentence(rng, 300)} {item} {sentence(rng, 300)}", "en", "a")
    ]
    name, run = cp.STAGES[stage]
    df = documents_with(spark, rows)
    out = run(spark, df, str(tmp_path))
    found = out.collect()
    empty = run(spark, df.limit(0), str(tmp_path))
    assert empty.columns == out.columns and empty.count() == 0
    if stage == 4:
        assert Counter(r["doc_id"] for r in found) == Counter(i for i, *_ in rows)
        return
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    assert all([r[c] for c in NAMES] == [k if k % 2 else f"x{k}" for k in range(len(NAMES))] for r in found)
    given = Counter((i, s) for i, _, _, s in rows)
    assert all(k in given and (stage == 3 or n <= given[k]) for k, n in Counter((r["doc_id"], r["source"]) for r in found).items())
    texts = Counter(t for _, t, _, _ in rows)
    if stage != 2:
        assert all(r["text"] in texts for r in found)
    if stage == 0:
        assert Counter(r["text"] for r in found) == Counter(
            t for _, t, _, _ in rows if any(c.isalpha() for c in t or "")
        ) and {r["lang"] for r in found} <= {"en", "fr"}
    elif stage == 1:
        ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
        assert len(ids) == len(set(ids)) and sum(r["doc_id"] is None for r in found) == sum(i is None for i, *_ in rows)
    elif stage == 2:
        assert not any(item in (r["text"] or "") for r in found) and len(found) == len(rows) - 1
    else:
        assert all(r["text"] and r["text"].split() for r in found)


def test_kept_folders_are_released(spark):
    from veilframe.llm import storage

    storage.release()
    df = storage.keep(spark.range(3), "small")
    path = df.inputFiles()[0].rpartition("/")[0].replace("file:", "")
    assert os.path.isdir(path) and storage.release() == 1 and not os.path.exists(path) and storage.release() == 0


def test_pipeline(spark):
    """Stages one after the other on the smallest tables, each held against brute force on its own input."""
    import corpus_pipeline as cp
    from frames import docs  # noqa: F401
    from test_corpus_operators import TOKENIZER, brute_contamination, brute_links
    from tokenizers import Tokenizer

    read = spark.read.parquet
    start = read(f"{SF}/documents.parquet")
    stage = {name: f for name, f in cp.STAGES}
    assert [*stage] == [
        "language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights",
        "token-ID / binary output"
    ]
    known = cp.language_id(spark, start, SF)
    letters = Counter(r["doc_id"] for r in start.collect() if any(c.isalpha() for c in r["text"] or ""))
    assert Counter(r["doc_id"] for r in known.collect()) == letters and known.columns == start.columns
    named = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op9_language"](spark, SF).collect()}
    assert all(r["lang"] == named[r["doc_id"]] for r in known.collect())
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    single = cp.near_duplicates(spark, known, SF)
    assert Counter(r["doc_id"] for r in single.collect()) == Counter({c for _, c, _ in brute_links(rows)}) and single.columns == start.columns
    items = [tuple(r) for r in read(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = cp.benchmark_decontamination(spark, single, SF)
    kept = Counter(r["doc_id"] for r in single.collect() if not brute_contamination(r["text"], items)[4])
    assert Counter(r["doc_id"] for r in clean.collect()) == kept and clean.columns == start.columns
    mixed = cp.source_mix(spark, clean, SF)
    assert mixed.columns == start.columns and {r["doc_id"] for r in mixed.collect()} <= set(kept)
    t = Tokenizer.from_file(TOKENIZER)
    ids = [(r["doc_id"], t.encode(r["text"], add_special_tokens=False).ids + [0]) for r in mixed.collect()]
    expected = Counter((i, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for i, v in ids)
    got = [tuple(r) for r in cp.run(spark, SF).select("doc_id", "n_tokens", "ids_crc32", "start").collect()]
    assert Counter(r[:3] for r in got) == expected
    assert max(r[3] + r[1] for r in got) == sum(len(v) for _, v in ids)
