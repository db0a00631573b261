"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    records = read_archives(write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_links

    return jaccard_links(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii, listed

    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = find_pii(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *map(count, KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count("term")
    )


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import read_tokens, write_tokens

    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    found = scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", remainder != 1)
    return found.select(
        "doc_id", (remainder == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import classify, fit

    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    documents = _table(spark, sf_dir, "documents")
    found = classify(documents.select("doc_id", "text"), fit(documents, remainder != 2))
    return found.select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_jaccard, op3_decontaminate, op4_pii, op5_tokens, op6_suffixes, op7_quality, op8_top_k, op9_language, op10_mix
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(h, (5 * i // 4 + 1)::BIGINT, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN f USING (h)""",
    "op2_jaccard": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS t(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
        SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.x = doc_id) AS n_links
        FROM documents""",
    "op6_suffixes": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM d, unnest(range(0, len(h) // 2 - 99)) AS t(i)),
        again AS (SELECT doc_id, i FROM starts QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
        edges AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM again),
        runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
        gaps AS (
            SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
            UNION ALL SELECT doc_id, coalesce(max(b), 0), max(len(h) // 2) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
        ), kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256 FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
        sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op3_decontaminate": rf"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
        bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS g FROM b, unnest(range(1, len(ws) - k + 2)) AS t(i)),
        ks AS (SELECT DISTINCT k FROM bw),
        dw AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g FROM w, ks, unnest(range(1, len(ws) - k + 2)) AS t(i)),
        hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
        covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_mix": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5('42|' || doc_id), 1, 15))::BIGINT AS key FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS weight
            FROM d GROUP BY source
        ), rounds AS (
            SELECT 0 AS round, source, source_size, weight, false AS capped, NULL::DOUBLE AS level FROM s
            UNION ALL
            SELECT round + 1, source, source_size, weight, capped OR 3 * source_size::DOUBLE <= level_now * weight, level_now
            FROM (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
                          / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0)::DOUBLE AS level_now FROM rounds) AS r
            WHERE round < 64
        ), t AS (
            SELECT source, source_size, CASE WHEN capped THEN 3 * source_size::DOUBLE ELSE level * weight END AS target FROM rounds WHERE round = 64
        ), o AS (
            SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE
                   (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
        FROM o""",
}
