"""Operators on texts against brute force, on planted cases and edges."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
from frames import docs, edge_rows, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import decontaminate, jaccard, language, mixing, pii, quality, suffixes, tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# near duplicates


def shingle_set(text):
    w = decontaminate.words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links, root = [0] * len(rows), {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is None or j is None or not s or not t or 5 * len(s & t) < 4 * len(s | t):
                continue
            links[a] += 1
            links[b] += 1
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return Counter((i, None if i is None else find(i), 0 if i is None else links[k]) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(1)
    rows = edge_rows()
    base = sentence(rng, 120).split()
    for k in range(40):  # edits that leave some pairs above and some below the threshold
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        rows.append((100 + k, " ".join(words)))
    return rows + [(200 + k, "copy " * 3 + base[0]) for k in range(8)] + [(300 + k, sentence(rng, 60)) for k in range(30)]


@pytest.mark.parametrize(
    "block_bytes, rows", [(jaccard.BLOCK_BYTES, jaccard.ROWS), (jaccard.BLOCK_BYTES, 7), (9000, 7), (1000, jaccard.ROWS)]
)
def test_links_equal_all_pairs(spark, near_rows, block_bytes, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "ROWS", rows)
    got = jaccard.jaccard_links(docs(spark, near_rows), block_bytes=block_bytes).collect()
    assert Counter(map(tuple, got)) == brute_links(near_rows)


def test_deduplication_keeps_one_of_each_group(spark, near_rows):
    kept = jaccard.deduplicated(docs(spark, near_rows))
    assert kept.columns == docs(spark, []).columns
    heads = {c for _, c, _ in brute_links(near_rows)}
    assert sorted(
        (r["doc_id"] for r in kept.collect()), key=lambda x: (x is not None, x)
    ) == sorted(heads, key=lambda x: (x is not None, x))


def test_no_documents(spark):
    empty = docs(spark, [])
    assert jaccard.jaccard_links(empty).count() == 0
    assert suffixes.repeated_spans(empty).count() == 0
    assert pii.find_pii(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert tokens.read_tokens(tokens.write_tokens(empty, TOKENIZER)).count() == 0
    assert language.classify(empty, language.fit(empty, F.lit(True))).count() == 0
    assert quality.scored(empty, spark.createDataFrame([], "doc_id long, quality int"), "quality", F.lit(True)).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, bench).count() == 0


def test_prefix_gets_shorter_for_recall():
    assert jaccard.prefix_length(0.8, 20, 8, 0.5) == 8
    lengths = [jaccard.prefix_length(0.8, 20, 8, r) for r in (0.9, 0.99, 0.999, 0.999999)]
    assert lengths == sorted(lengths, reverse=True) and lengths[-1] < 8


def test_least_similarity_of_a_size_is_that_of_all_pairs_of_sets():
    for size in range(1, 40):
        reached = [(size - a, size + b) for a in range(size) for b in range(20) if a + b and 5 * (size - a) >= 4 * (size + b)]
        least = min((c / u for c, u in reached), default=None)
        assert jaccard.least_similarity(size) == least
    assert jaccard.depths(0.8, 20, 8, 0.999)[:8] == [9, 9, 9, 9, 5, 5, 6, 7]


def test_shingles_are_told_apart_word_by_word():
    rng = random.Random(12)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(120)]
    plain = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    numbers = jaccard.shingle_numbers(texts)
    for s, x in zip(plain, numbers):
        assert len(s) == len(x)
        assert [len(s & t) for t in plain] == [len(np.intersect1d(x, y)) for y in numbers]


def test_nodes_of_the_tries_hold_all_that_share_a_prefix(spark):
    rng = np.random.default_rng(2)
    forest = jaccard.Forest(trees=3, depth=8)
    labels = rng.integers(0, 2, (90, 3, 8)).astype(">u2")
    needs = rng.choice([5, 5, 6, 8, 9], 90).tolist()
    classes = spark.createDataFrame(
        [(i, x.tobytes(), n) for i, (x, n) in enumerate(zip(labels, needs))], "rep long, labels binary, need int"
    ).repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    members = defaultdict(set)
    try:
        for r in jaccard.trie_groups(classes, forest).collect():
            members[r["node"]].add(r["rep"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    together = {(i, j) for m in members.values() for i in m for j in m if i < j}
    common = lambda i, j: max(int((np.cumprod(labels[i, t] == labels[j, t])).sum()) for t in range(3))
    assert together == {(i, j) for j in range(90) for i in range(j) if common(i, j) >= max(needs[i], needs[j])}


def test_planted_near_copies_are_found_in_a_larger_table(spark):
    rng = random.Random(21)
    rows, pairs = [], []
    for k in range(400):
        words = sentence(rng, rng.randint(60, 200)).split()
        other = list(words)
        for _ in range(rng.randint(1, 3)):
            other[rng.randrange(len(other))] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if 5 * len(shingle_set(rows[-2][1]) & shingle_set(rows[-1][1])) >= 4 * len(shingle_set(rows[-2][1]) | shingle_set(rows[-1][1])):
            pairs.append(2 * k)
    found = {r["doc_id"]: r["class_id"] for r in jaccard.jaccard_links(docs(spark, rows)).collect()}
    assert len(pairs) > 200 and sum(found[i + 1] == i for i in pairs) >= 0.99 * len(pairs)
    assert sum(i != c for i, c in found.items()) <= len(pairs)


def test_deduplication_of_tables_with_names_of_its_own(spark):
    df = docs(spark, edge_rows()).withColumnsRenamed({"h": "n", "size": "t", "start": "__id", "key": "least", "score": "id"})
    kept = jaccard.deduplicated(df)
    assert kept.columns == df.columns
    heads = {c for _, c, _ in brute_links(edge_rows())}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(heads)


# decontamination


def brute_contamination(text, items, window=13):
    words = decontaminate.words_of(text)
    hit, found = np.zeros(len(words), bool), set()
    for item_id, item in items:
        w = decontaminate.words_of(item)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in grams:
                hit[p : p + n] = True
                found.add(item_id)
    return len(words), int(hit.sum()), len(found), hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest(), bool(hit.any() and 20 * hit.sum() >= len(words))


@pytest.fixture(scope="module")
def bench_case():
    rng = random.Random(3)
    items = [(k, sentence(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]))) for k in range(30)] + [
        (90, None), (91, ""), (92, "aa bb aa bb aa bb aa bb aa bb aa bb aa bb aa"), (93, "aa bb")
    ]
    items += [items[6], items[6], (items[6][0], items[7][1]), (None, items[8][1]), (None, items[8][1]), (None, "kept apart zq")]
    rows = edge_rows()
    for k in range(40):
        item = rng.choice(items)[1] or ""
        words = item.split()
        cut = " ".join(words[rng.randint(0, 2) :])
        rows.append((50 + k, f"{sentence(rng, rng.randint(0, 60))}, {cut.upper()} ... {sentence(rng, rng.randint(0, 200))}"))
    rows += [(95, "aa bb " * 10), (96, " ".join(items[0][1].split() * 3))]
    return items, rows


@pytest.mark.parametrize("max_words", [decontaminate.AUTOMATON_WORDS, 50])
def test_contamination_equals_search(spark, bench_case, max_words, monkeypatch):
    items, rows = bench_case
    monkeypatch.setattr(decontaminate.automata, "__defaults__", (decontaminate.WINDOW, max_words))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs(spark, rows), bench, cut=True).collect()
    expected = Counter((i, *brute_contamination(t, items)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == expected
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert len(decontaminate.words_of(r["text"])) == r["n_words"] - r["n_hit"]


def test_decontaminated_documents(spark, bench_case):
    items, rows = bench_case
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.decontaminated(docs(spark, rows), bench)
    clean = Counter(i for i, t in rows if not brute_contamination(t, items)[4])
    empty = decontaminate.decontaminated(docs(spark, rows), bench.limit(0))
    assert Counter(map(tuple, empty.collect())) == Counter(map(tuple, docs(spark, rows).collect()))
    assert Counter(r["doc_id"] for r in kept.collect()) == clean and kept.columns == docs(spark, []).columns
    assert kept.where(F.length("text") != F.col("n_chars")).count() == 0


# personal data


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


PII_TEXTS = [
    "a.b@c.de_f@g.h x@y.z", "é😀 mail me: joe+x@mail.example.com, 1.2.3.4 and 1.2.3.256 or 01.02.003.255.9", "4465758382889437 4465758382889437", "4465-7583 8288 9437.", "+1 (743) 555-3824 +49 30 1234567 +1 2",
    "@@@ a@b a@b.c.d..e", "1.1.1.1.1.1.1.1", "0 0 0 0 0 0 0 0 0 0 0 0", "12 34  56-78", "+123456789 0", "a@b.c" * 50, "7" * 5000, "+" + "1 " * 3000, "x@" + "a." * 3000 + "b",
]


def test_patterns_equal_plain_search(spark):
    rows = edge_rows() + [(100 + k, t) for k, t in enumerate(PII_TEXTS)]
    got = pii.find_pii(docs(spark, rows)).select(
        "doc_id", pii.listed(F.filter("spans", lambda s: s["kind"] != "term")).alias("s")
    ).collect()
    assert Counter((r["doc_id"], r["s"]) for r in got) == Counter((i, brute_pii(t)) for i, t in rows)


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(8)
    rows = [(k, sentence(rng, 40)) for k in range(300)]
    rows += [(1000 + k, f"{sentence(rng, 20)} Quorvath wrote quorvath@mail.example.org the {sentence(rng, 20)}") for k in range(6)]
    rows += [(1100, f"{sentence(rng, 9)} quorvath, {sentence(rng, 9)}")]
    rows += [(1200 + k, f"copied line Unrevealing {k % 2} other@mail.example.org end of it") for k in range(6)]  # two contexts only
    found = {r["doc_id"]: [s for s in r["spans"]] for r in pii.find_pii(docs(spark, rows)).collect()}
    texts = dict(rows)
    terms = {i: {texts[i][s["start"] : s["end"]].lower() for s in spans if s["kind"] == "term"} for i, spans in found.items()}
    assert all("quorvath" in terms[1000 + k] for k in range(6)) and terms[1100] == {"quorvath"}
    assert not any("unrevealing" in t for t in terms.values())
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs(spark, rows)).collect()}
    assert "uorvath" not in clean[1000] and "[EMAIL]" in clean[1000] and "quorvath" not in clean[1100]
    assert clean[5] == texts[5] and len(clean) == len(rows)


def test_words_at_the_ends_of_short_texts_count(spark):
    rng = random.Random(9)
    rows = [(k, sentence(rng, 40)) for k in range(200)]
    rows += [(1000 + k, f"Quorvath first@mail.example.org {sentence(rng, 4)}") for k in range(6)]
    rows += [(1100 + k, f"{sentence(rng, 4)} last@mail.example.org Zelbrinth") for k in range(6)]
    texts = pii._texts(docs(spark, rows))
    found = {(r["term"], r["entity"]) for r in pii.disclosing_terms(texts, pii.base_spans(texts)).collect()}
    assert found >= {("quorvath", "email:first@mail.example.org"), ("zelbrinth", "email:last@mail.example.org")}
    long = docs(spark, [(1, "cut " + "x" * 30 + " " + "word " * 12 + "a@b.cc")])
    assert "x" not in pii.base_spans(pii._texts(long)).first()["left"]


LETTERS = "[^\\x00-\\x60\\x7B-\\x7F]"
PATTERNS = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute_terms(rows, context=80, min_contexts=3, min_disclosure=0.7):
    """The disclosing terms and every row's spans, row by row."""
    base, near, spans = defaultdict(set), defaultdict(list), []
    words_of_row = []
    for n, (_, text) in enumerate(rows):
        text = text or ""
        words_of_row.append(set(regex.findall(LETTERS + "{3,}+", lower(text))))
        mine = []
        for rank, (kind, pattern) in enumerate(PATTERNS.items()):
            found = list(regex.finditer(pattern, text))
            for k, m in enumerate(found):
                left = text[found[k - 1].end() if k else 0 : m.start()]
                right = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
                if f"{kind}:{m.start()}:{m.end()}" not in brute_pii(text).split(","):
                    continue
                mine.append((m.start(), rank, kind, m.end()))
                left = regex.sub(r"^\S*\s", "", left[-context:]) if len(left) > context else left
                right = regex.sub(r"\s\S*$", "", right[:context]) if len(right) > context else right
                side = lower(regex.sub(pii.EMAIL, " ", left) + " " + regex.sub(pii.EMAIL, " ", right))
                entity = f"{kind}:{lower(m[0])}"
                base[entity].add(n)
                for term in set(regex.findall(LETTERS + "{3,}+", side)):
                    near[entity, term].append((n, side))
        spans.append(mine)
    terms = set()
    for (entity, term), seen in near.items():
        n, n_entity = len(rows), len(base[entity])
        n_both, n_term = len({i for i, _ in seen}), sum(term in w for w in words_of_row)
        content = math.log(n / n_entity)
        disclosure = math.log(n_both * n / (n_entity * n_term)) / content if content > 1e-12 else 0.0
        if len({c for _, c in seen}) >= min_contexts and disclosure >= min_disclosure:
            terms.add(term)
    out = []
    for (doc_id, text), mine in zip(rows, spans):
        for m in regex.finditer(LETTERS + "+", lower(text or "")):
            if m[0] in terms and all(m.end() <= a or m.start() >= b for a, _, _, b in mine if _ != "term"):
                mine = [*mine, (m.start(), 4, "term", m.end())]
        out.append((doc_id, ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(mine))))
    return terms, Counter(out)


def test_terms_equal_a_count_row_by_row(spark):
    rng = random.Random(18)
    people = {f"{sentence(rng, 1)}{k}@mail.example.org": sentence(rng, 2).title() for k in range(12)}
    rows = edge_rows() + [(100 + k, sentence(rng, 40)) for k in range(150)]
    for k in range(160):
        mail, name = rng.choice(list(people.items()))
        said = [
            sentence(rng, rng.randint(0, 25)), name if rng.random() < 0.8 else "", f"<{mail}>", sentence(rng, rng.randint(0, 25)),
            rng.choice(["", "+49 30 1234567", "10.2.0.7", rng.choice(list(people))])
        ]
        rows.append((400 + k, " ".join(said)))
    rows += [(700 + k, f"seen {rng.choice(list(people.values()))} again") for k in range(20)]
    rows += [rows[-40]] * 30 + [rows[-25]] * 2  # repeated rows, one of them often
    terms, expected = brute_terms(rows)
    assert len(terms) > 3
    got = pii.find_pii(docs(spark, rows)).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()
    assert Counter(map(tuple, got)) == expected
    wide = pii.find_pii(docs(spark, rows), context=30, min_disclosure=0.4).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()
    assert Counter(map(tuple, wide)) == brute_terms(rows, 30, 3, 0.4)[1]


# token files


def test_token_round_trip(spark):
    rows = edge_rows() + [
        (20, "a  b"), (21, " lead"), (22, "trail "), (23, "tab\tx \n y"), (24, "x<|endoftext|>y z"), (25, "don't stop. a, b.")
    ] + [(30 + k, sentence(random.Random(k), 50)) for k in range(60)]
    t = Tokenizer.from_file(TOKENIZER)
    got = tokens.read_tokens(tokens.write_tokens(docs(spark, rows), TOKENIZER, file_tokens=500)).collect()
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (i, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for i, v in ids
    )
    got = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert [r["doc_id"] or -1 for r in got] == sorted((i or -1 for i, _ in rows))


def test_only_tokenizers_that_split_into_words_are_encoded_by_words(spark):
    good = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    assert tokens.by_words(good)
    token = good["added_tokens"][0]
    for change in (
        {"normalizer": {"type": "Lowercase"}},
        {"pre_tokenizer": {**good["pre_tokenizer"], "add_prefix_space": True}},
        {"pre_tokenizer": {**good["pre_tokenizer"], "use_regex": False}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": None},
        {"model": {**good["model"], "dropout": 0.1}},
        {"model": {"type": "WordLevel"}},
        {"truncation": {"max_length": 5}},
        {"added_tokens": [{**token, "lstrip": True}]},
        {"added_tokens": [{**token, "content": "two words"}]},
    ):
        assert not tokens.by_words(good | change)
    other = public_tokenizers.path("word_bpe_49k.json")
    t, rows = Tokenizer.from_file(other), edge_rows() + [(40 + k, sentence(random.Random(k), 30).title()) for k in range(10)]
    assert tokens.encoder(other).whole_only
    got = tokens.read_tokens(tokens.write_tokens(docs(spark, rows), other)).collect()
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in rows]
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, zlib.crc32(np.array(v, "<u4").tobytes())) for i, v in ids)


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01/documents.parquet"])
def test_words_give_the_ids_of_whole_texts(table, monkeypatch):
    """Every text of a table, with caches large and small enough to be emptied often."""
    if not os.path.exists(table):
        pytest.skip("no test tables")
    texts = [t or "" for t in pq.read_table(table, columns=["text"]).column("text").to_pylist()]
    t = Tokenizer.from_file(TOKENIZER)
    expected = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    for words in (tokens.CACHE_WORDS, 3000):
        monkeypatch.setattr(tokens, "CACHE_WORDS", words)
        coder = tokens.WordEncoder(TOKENIZER)
        assert [x for k in range(0, len(texts), 200) for x in coder.encode(texts[k : k + 200])] == expected


def test_words_beside_any_white_space():
    rng, t, coder = random.Random(41), Tokenizer.from_file(TOKENIZER), tokens.WordEncoder(TOKENIZER)
    signs = [" ", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "a", "bc", "é", "中", "1", ".", ",", "'s", "!?", "<|endoftext|>", "\u0301", "Ġ", "\x00"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    got = [x for k in range(0, len(texts), 100) for x in coder.encode(texts[k : k + 100])]
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_added_tokens_across_letters_and_marks(tmp_path):
    """Pieces are put together from letters and marks only if no token goes across the two."""
    definition = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    added = {**definition["added_tokens"][0], "id": 50257, "content": "n."}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(definition | {"added_tokens": [*definition["added_tokens"], added]}))
    t, texts = Tokenizer.from_file(str(path)), ["seen on. then on. again", "n.", "so on.\nOn, on."]
    assert 50257 in t.encode(texts[0]).ids
    assert tokens.WordEncoder(str(path)).encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_letters_marks_and_line_breaks_are_told_apart_as_by_the_library():
    rng, t, coder = random.Random(43), Tokenizer.from_file(TOKENIZER), tokens.WordEncoder(TOKENIZER)
    letters = [chr(x) for x in range(0x250) if re.fullmatch(tokens.LETTERS, chr(x))]
    marks = [chr(x) for x in range(128) if re.fullmatch(tokens.MARKS, chr(x))]
    assert len(letters) > 400 and len(marks) == 31 and "'" not in marks
    texts = [f"a x{c}{m} {c}{m}\n{c}x{m}{m} {c}\n{c}" for c in letters for m in [*rng.sample(marks, 3), ""]] + [f"a b{m}{n} c{n}" for m in marks for n in marks]
    stems = ["the", "then", "Ever", "don't", "s", "é", "ºx", "x2", "_y", "ж", "中", "x\u0301", ""]
    tails = ["", ".", "...", "!?", "'", "'s", ".'s", "&&&", "_", "\n", "\n\n", ".\n", "\r\n", "<|endoftext|>", "\u2019"]
    texts += [" ".join(rng.choice(stems) + rng.choice(tails) + rng.choice(stems) + rng.choice(tails) for _ in range(6)) for _ in range(4000)]
    got = [x for k in range(0, len(texts), 500) for x in coder.encode(texts[k : k + 500])]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_library_sees_letters_once_whatever_marks_follow(monkeypatch):
    """The cost of op5_tokens is that of the characters which the library encodes."""
    rng, t, coder, seen = random.Random(47), Tokenizer.from_file(TOKENIZER), tokens.WordEncoder(TOKENIZER), []
    stems = ["".join(rng.choice("abcdeilnorst") for _ in range(9)) for _ in range(300)]
    texts = [" ".join(f"{s}{rng.choice(['***', '...', '.', ''])}\n{rng.choice(stems)}{rng.choice(['&&&', ','])}" for s in stems) for _ in range(10)]
    ids = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda xs: seen.extend(xs) or ids(xs))
    assert coder.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert sum(map(len, seen)) < 3 * sum(map(len, stems)) < sum(map(len, texts)) / 5


def test_long_pieces_are_not_kept():
    t, coder = Tokenizer.from_file(TOKENIZER), tokens.WordEncoder(TOKENIZER)
    texts = ["中文" * 500 + " " + "文" * 700 + f"{k} a  b " + "x" * 900 + ". a" + "-" * 900 for k in range(20)] + ["", " "]
    assert coder.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert max(len(w) for kept in (coder.first, coder.rest, coder.old, coder.marks) for w in kept) <= tokens.KEPT_CHARS


def test_any_token_is_found_without_its_neighbours(spark):
    rows = [(k, sentence(random.Random(k), 300)) for k in range(20)]
    files = tokens.write_tokens(docs(spark, rows), TOKENIZER).collect()
    for f in files:
        file = tokens.TokenFile(f["path"])
        ids = file.ids()
        assert all(file.token(i) == ids[i] for i in random.Random(1).sample(range(len(ids)), 200))
        with pytest.raises(IndexError):
            file.token(len(ids))


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(3000))])
def test_code_levels(ids):
    ids = np.array(ids, np.uint32)
    levels = tokens.encode_levels(ids)
    assert (tokens.decode_levels(levels) == ids).all() and len(levels) == (max(1, -(-int(ids.max()).bit_length() // 8)) if len(ids) else 0)


# repeated byte strings


def brute_repeats(rows, span):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - span + 1):
            s = data[p : p + span]
            if s in seen:
                gone[p : p + span] = True
            seen.add(s)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((
            rows[i][0], len(data), int(gone.sum()), int((edges == 1).sum()),
            hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()
        ))
    return Counter(out)


@pytest.mark.parametrize(
    "pack_bytes, group, bucket_bytes",
    [
        (suffixes.PACK_BYTES, suffixes.GROUP, suffixes.BUCKET_BYTES), (3000, suffixes.GROUP, 5000), (3000, 5, 1000), (2000, 1, 300),
        (1000, 1, suffixes.BUCKET_BYTES)
    ]
)
def test_repeats_equal_brute_force(spark, pack_bytes, group, bucket_bytes):
    rng = random.Random(11)
    passage, line = sentence(rng, 60), sentence(rng, 16)
    rows = edge_rows() + [(30, passage * 3), (31, "ab" * 400), (32, "z" * 600), (33, passage[:130])]
    for k in range(60):
        a, b = sorted((rng.randrange(len(passage)), rng.randrange(len(passage))))
        rows.append((
            100 + k,
            f"{sentence(rng, rng.randint(0, 30))} {passage[a:b]} {line} {sentence(rng, rng.randint(0, 30))}" + passage[:b] * rng.randint(0, 1)
        ))
    rng.shuffle(rows)
    got = suffixes.repeated_spans(docs(spark, rows).repartition(5), pack_bytes=pack_bytes, group=group, bucket_bytes=bucket_bytes).collect()
    assert Counter((
        r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]
    ) for r in got) == brute_repeats(rows, suffixes.SPAN)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_a_very_frequent_phrase_between_different_words(spark):
    rng = random.Random(15)
    phrase = "the same forty bytes stand in every line. "
    rows = [(k, "".join(f"{rng.randrange(10**6):06d}{phrase}" for _ in range(60))) for k in range(400)]
    rows += [(1000 + k, (phrase * 4)[k : k + 130]) for k in range(20)]
    assert sum(t.count(phrase) for _, t in rows) > suffixes.GROUP
    got = suffixes.repeated_spans(docs(spark, rows).repartition(4), pack_bytes=200_000, bucket_bytes=100_000).collect()
    assert Counter((
        r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]
    ) for r in got) == brute_repeats(rows, suffixes.SPAN)


def test_one_string_fills_several_buckets(spark):
    """Copies of one text in packs of their own: the bounds fall between occurrences of one string."""
    rng = random.Random(16)
    text = sentence(rng, 30)
    rows = [(k, text) for k in range(80)] + [(200 + k, sentence(rng, 20)) for k in range(10)]
    found = []
    plain = suffixes._split_at
    try:
        suffixes._split_at = lambda keys, n: found.append(plain(keys, n)) or found[-1]
        got = suffixes.repeated_spans(docs(spark, rows).repartition(8), pack_bytes=100, group=1, bucket_bytes=500).collect()
    finally:
        suffixes._split_at = plain
    bounds = [b[: suffixes.SPAN] for b in found[1].tolist()]
    assert len(bounds) > len(set(bounds))
    assert Counter((
        r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]
    ) for r in got) == brute_repeats(rows, suffixes.SPAN)


def test_multikey_sort_orders_and_tells_apart():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts, lengths = rng.integers(0, 3900, 1500), rng.choice([8, 9, 16, 23, 60], 1500)
    order, classes = suffixes.multikey_sort(suffixes.word_levels(np.concatenate([data, np.zeros(7, np.uint8)])), starts, lengths)
    strings = [data[s : s + n].tobytes() for s, n in zip(starts.tolist(), lengths.tolist())]
    ordered = [(lengths[i], strings[i]) for i in order]
    assert ordered == sorted(ordered) and sorted(order.tolist()) == list(range(1500))
    names = defaultdict(set)
    for c, s in zip(classes.tolist(), strings):
        names[c].add(s)
    assert all(len(v) == 1 for v in names.values()) and len(names) == len(set(strings))


# language and quality


def test_languages_of_unseen_documents(spark):
    rng = random.Random(2)
    words = {"xx": ["strand", "wacht", "schiff", "zug"], "yy": ["perro", "casa", "llano", "ojo"], "zz": ["слово", "дом", "мир", "лес"]}
    rows = [(
        k, " ".join(rng.choice(words[x]) + rng.choice(["", "en", "os"]) for _ in range(20)), x, "s"
    ) for k in range(150) for x in [rng.choice(list(words))]]
    rows += [
        (1000, None, "xx", "s"), (1001, "123 !!", "yy", "s"), (1002, "", None, "s"), (1003, "wacht", None, "s"),
        (1004, "schiff " * 5000, "xx", "s")
    ]
    df = docs(spark, rows)
    found = {r["doc_id"]: r for r in language.classify(df, language.fit(df, F.col("doc_id") % 2 == 0)).collect()}
    assert np.mean([found[i]["lang_pred"] == x for i, _, x, _ in rows[:150] if i % 2]) > 0.95
    assert [found[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and found[1004]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in found.values()) and all(found[k]["score"] == 0 for k in (1000, 1001, 1002))
    none = language.classify(df, language.fit(df, F.lit(False))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def brute_languages(rows, learn):
    """Prototypes and predictions, one letter and one trigram at a time."""
    vector = functools.cache(lambda c: language.letter_vectors(np.array([c]))[0].astype(np.int64))

    def bundle(text):
        marks, found = [0], Counter()
        for c in (text or "").lower():
            if c.isalpha():
                marks.append(ord(c))
            elif marks[-1]:
                marks.append(0)
        if marks[-1]:
            marks.append(0)
        for a, b, c in zip(marks, marks[1:], marks[2:]):
            if b:
                found[a, b, c] += 1
        return found

    product = functools.cache(lambda a, b, c: np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c))
    sums: dict = {}
    for i, text, lang, _ in rows:
        grams = bundle(text)
        if learn(i) and lang is not None and grams:
            n = sum(grams.values())
            sums[lang] = sums.get(lang, 0) + sum(k * language.UNIT // n * product(*g) for g, k in grams.items())
    names = sorted(sums)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    mean = sum(unit(sums[x].astype(float)) for x in names) / max(1, len(names)) if len(names) > 1 else 0
    prototypes = {x: unit(unit(sums[x].astype(float)) - mean) for x in names}
    out = []
    for i, text, _, _ in rows:
        grams = bundle(text)
        if not grams or not names:
            out.append((i, "und", 0.0))
            continue
        v = unit(sum(k * product(*g) for g, k in grams.items()).astype(float))
        cosines = [float(prototypes[x] @ v) for x in names]
        best = max(range(len(names)), key=lambda k: (round(cosines[k], 9), -k))
        out.append((i, names[best], min(1.0, max(0.0, cosines[best]))))
    return out


def test_languages_equal_a_plain_count(spark):
    rng = random.Random(22)
    alphabet = {"aa": "abcdeéß", "bb": "abcdeñí", "cc": "абвгд", "dd": "漢字仮名交文", "ee": "àȏáņ"}
    rows = [(
        k,
        " ".join("".join(rng.choice(alphabet[x]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))) + rng.choice(["", ".", " 12"]),
        x, "s"
    ) for k in range(120) for x in [rng.choice(list(alphabet))]]
    rows += [
        (500, None, "aa", "s"), (501, "", "bb", "s"), (502, "12 !!", "aa", "s"), (503, "abc", None, "s"),
        (504, "ABC abc\x00abc", "bb", "s"), (505, "漢" * 3000, "dd", "s"), (505, "漢" * 3000, "dd", "s")
    ]
    df = docs(spark, rows).repartition(5)
    expected = brute_languages(rows, lambda i: i % 3 != 0)
    for parts in (5, 2):
        prototypes = language.fit(df.repartition(parts), F.col("doc_id") % 3 != 0)
        got = language.classify(df, prototypes).select("doc_id", "lang_pred", "score").collect()
        assert Counter((r[0], r[1], round(r[2], 6)) for r in got) == Counter((i, x, round(s, 6)) for i, x, s in expected)
    assert len({language.letter_vectors(np.array([c])).tobytes() for c in range(3000)}) == 3000


def test_languages_that_tie_go_to_the_first_name(spark):
    rows = [(k, "same words here", x, "s") for k, x in enumerate(["zz", "mm", "aa", "zz", "mm", "aa"])]
    df = docs(spark, rows)
    assert {r["lang_pred"] for r in language.classify(df, language.fit(df, F.lit(True))).collect()} == {"aa"}


def test_languages_beside_columns_of_the_same_names(spark):
    df = docs(
        spark, [(1, "wacht schiff", "xx", "s"), (2, "perro casa", "yy", "s")]
    ).withColumnsRenamed({"h": "lang_pred", "key": "own_score"})
    found, lang, score = language.identified(df, language.fit(df, F.lit(True)))
    assert found.columns == [*df.columns, lang, score] and not {lang, score} & set(df.columns)
    for r in found.collect():
        assert (r["lang_pred"], r["score"], r["own_score"]) == ("x", "x", "x") and r[lang] == r["lang"]


def brute_statistics(text):
    """The 24 numbers, by counting characters, words and lines one at a time."""
    data = (text or "").encode()
    words, n = data.split(), len(data)
    if not words:
        return [0.0] * 24
    k, share = len(words), lambda f: sum(map(f, data)) / n
    sizes, counts = [len(w) for w in words], Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    mean, top = sum(sizes) / k, sorted(counts.values(), reverse=True)
    letter = lambda c: c >= 128 or chr(c).isalpha()
    rest = lambda c: 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()"
    return [
        math.log(n + 1), math.log(k + 1), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / k), min(max(sizes), 100),
        share(letter), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b" \t\n\r\x0b\x0c"), share(lambda c: c in b".,;:!?"), share(rest),
        len(counts) / k, math.log(len(counts)) / math.log(k + 1), top[0] / k, sum(top[:3]) / k, len({(a, b) for a, b in zip(words, words[1:])}) / max(1, k - 1),
        math.log(len(lines) + 1), len(set(lines)) / len(lines), sum(len(x) for i, x in enumerate(lines) if x in lines[:i]) / n, math.log(n / len(lines) + 1),
        math.log(k / (sum(c in b".!?" for c in data) + 1) + 1), sum(x <= 3 for x in sizes) / k, len(zlib.compress(data, 1)) / (n + 32), sum(chr(w[0]).isupper() and w[0] < 128 for w in words) / k,
    ]


def test_quality_equals_one_fit_over_all_rows(spark):
    rng = random.Random(24)
    rows = edge_rows()[:5] + [(
        100 + k,
        ". ".join(sentence(rng, rng.randint(1, 9)).capitalize() for _ in range(rng.randint(1, 9))) + "." + "\nline x" * rng.randint(0, 3)
    ) for k in range(150)]
    rows += [(300 + k, " | ".join([sentence(rng, 1)] * rng.randint(1, 40)) + " 12!!") for k in range(120)]
    labels = [(i, int(i is not None and i < 300), "x") for i, _ in rows[5:]] + [
        (100, 0, "again"), (1, None, "x"), (None, 1, "x"), (99999, 1, "x")
    ]
    known = [(i, y) for i, y, _ in labels if i is not None and i % 3 != 1 and y is not None]
    stats = {i: brute_statistics(t) for i, t in rows}
    x = np.array([stats[i] for i, _ in known if i in stats])
    y = np.array([float(v) for i, v in known if i in stats])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    draw = np.random.default_rng(7)
    directions, phases = draw.normal(0, 1 / 5.0, (24, quality.FEATURES)), draw.uniform(0, 2 * np.pi, quality.FEATURES)
    features = lambda v: np.append(
        np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((v - mean) / scale, -8, 8) @ directions + phases), 1.0
    )
    z = np.array([features(v) for v in x])
    penalty = len(x) * 1e-4 * np.diag([*[1.0] * quality.FEATURES, 1e-9])
    weights = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    place = lambda v: int(np.clip((features(v) @ weights + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1))
    at = np.array([place(v) for v in x])
    used = sorted(set(at.tolist()))
    total, hits = [int((at == b).sum()) for b in used], [float(y[at == b].sum()) for b in used]
    level = [max(min(sum(hits[a : c + 1]) / sum(total[a : c + 1]) for c in range(b, len(used))) for a in range(b + 1)) for b in range(len(used))]

    def score(v):
        below = [k for k, b in enumerate(used) if b <= place(v)]
        return level[below[-1]] if below else 0.0

    df = docs(spark, rows).repartition(3)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, stats string")
    found = quality.scored(df, frame, "quality", F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))).collect()
    differ = [(
        r["doc_id"], r["score"], score(np.array(stats[r["doc_id"]]))
    ) for r in found if abs(r["score"] - score(np.array(stats[r["doc_id"]]))) > 1e-9]
    assert len(found) == len(rows) and not differ
    for i, t in rows:
        assert np.allclose(quality.statistics(t), stats[i], atol=1e-12)


def test_quality_of_unseen_documents(spark):
    rng = random.Random(4)
    good = [(k, ". ".join(sentence(rng, 8).capitalize() for _ in range(rng.randint(2, 8))) + ".") for k in range(300)]
    bad = [(1000 + k, " | ".join([sentence(rng, 1)] * rng.randint(5, 60)) + " !!") for k in range(150)]
    df = docs(spark, good + bad + edge_rows()[:4])
    labels = spark.createDataFrame(
        [(i, 1, "x") for i, _ in good] + [(i, 0, "x") for i, _ in bad] + [(1, None, "x"), (None, 1, "x"), (99999, 1, "x")],
        "doc_id long, quality int, score string"
    )
    found = quality.scored(df, labels, "quality", F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))).collect()
    score = {r["doc_id"]: r["score"] for r in found}
    assert len(found) == df.count() and all(0 <= s <= 1 for s in score.values())
    held = [(score[i] >= 0.5) == (i < 1000) for i, _ in good + bad if i % 3 == 1]
    assert np.mean(held) > 0.95
    assert {r["score"] for r in quality.scored(df, labels, "quality", F.lit(False)).collect()} == {0.5}


def test_isotonic_fit_is_the_best_monotone_one():
    sums, weights = np.array([3.0, 0.0, 4.0, 0.0, 5.0]), np.array([3.0, 2.0, 5.0, 0.0, 5.0])
    fit = quality.pool_adjacent_violators(sums, weights)
    assert (np.diff(fit) >= 0).all() and np.allclose(fit[:2], 0.6) and fit[-1] == 1


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] >= 3 * sizes[s]]
        if not over:
            return target | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("bucket_rows, hot_rows", [(mixing.BUCKET_ROWS, mixing.HOT_ROWS), (3, 60)])
def test_mix_meets_its_targets(spark, bucket_rows, hot_rows):
    rng = random.Random(6)
    rows = [(k, sentence(rng, rng.randint(0, 60)), None, rng.choice(["a", "a", "a", "a", "b", "c", None])) for k in range(400)]
    rows += [
        (1000, sentence(rng, 20000), None, "a"), (1001, None, None, "empty"), (1002, "", None, None), (None, "w w", None, "c"),
        (7, "again", None, "b"), (7, "again", None, "b"), (1003, "x\x0by\x1fz q", None, "c")
    ]
    out = mixing.mix(docs(spark, rows), bucket_rows=bucket_rows, hot_rows=hot_rows).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    targets = brute_targets(sizes)
    taken: dict = defaultdict(int)
    for r in out:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, size(t)) for i, t, _, _ in rows)
    assert all(abs(taken[s] - targets[s]) < 1 for s in sizes)
    again = mixing.mix(docs(spark, rows).repartition(7), bucket_rows=bucket_rows, hot_rows=hot_rows).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    copies = mixing.mixed(docs(spark, rows), bucket_rows=bucket_rows, hot_rows=hot_rows)
    assert copies.count() == sum(-(-r["taken"] // r["size"]) for r in out if r["taken"]) and copies.columns == docs(spark, []).columns
