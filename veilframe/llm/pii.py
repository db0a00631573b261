"""Personal data: fixed patterns, and terms that reveal what the patterns protect. DataFrame functions only.

The values that the patterns find are the protected entities. The corpus tells how strongly a term near an
entity discloses it: their pointwise mutual information as a share of the entity's information content,
1 if the term never occurs without the entity. Terms above the threshold that keep the entity company in enough
different contexts are sensitive wherever they occur: removed, while entities are generalised
to their kind.

Positions come from what stands between matches: Spark's split and regexp_extract_all walk
over the same matches, and a prefix sum of both lengths gives starts in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep

# What counts as which kind. The possessive forms match what greedy ones would, but neither
# recurse nor start again inside a run, so a long text costs linear time and constant stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALUE = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)){3}$"
KINDS = ("email", "ip", "card", "phone", "term")
LETTER = r"[^\x00-\x60\x7B-\x7F]"
TERM = LETTER + "{3,}+"

#: Characters beside a mention that count as its company: about a line of text on either side.
CONTEXT = 80
MIN_CONTEXTS = 3
MIN_DISCLOSURE = 0.7
#: Tables of terms up to so many rows are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = ["doc_id", "h"]


def _pieces(text: Column, pattern: str, guard: Column) -> tuple[Column, Column]:
    """Matches of pattern, and what stands before each and after the last."""
    none = F.array().cast("array<string>")
    matches = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    return matches, F.when(guard, F.split(text, pattern, -1)).otherwise(none)


def _guarded(text: Column) -> list[tuple[str, str, Column]]:
    """(kind, pattern, a cheap condition that every text with a match fulfils)."""
    return [
        ("email", EMAIL, F.contains(text, F.lit("@"))), ("ip", IP, text.rlike(IP)), ("card", CARD, text.rlike(CARD)),
        ("phone", PHONE, F.contains(text, F.lit("+")))
    ]


def _suspect(text: Column) -> Column:
    first, *others = (guard for _, _, guard in _guarded(text))
    for guard in others:
        first = first | guard
    return first


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        (kind == "email")
        | ((kind == "ip") & value.rlike(IP_VALUE))
        | ((kind == "card") & F.call_function("luhn_check", digits))
        | ((kind == "phone") & F.length(digits).between(9, 15))
    )


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, h, text): h tells rows with equal ids apart; rows that are equal in both are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows(doc_id, h, kind, i, gap, length, ...) with start and end; repeated documents come out once, with their number as times."""
    partition = [*_ROW, "kind"]
    others = [F.first(c).alias(c) for c in rows.columns if c not in (*partition, "i")]
    rows = rows.repartition(*partition).groupBy(*partition, "i").agg(*others, F.count("*").alias("times"))
    so_far = Window.partitionBy(*partition).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("length"))


def _before(gap: Column, context: int) -> Column:
    return F.when(F.length(gap) > context, F.regexp_replace(F.right(gap, F.lit(context)), r"^\S*\s", "")).otherwise(gap)


def _after(gap: Column, context: int) -> Column:
    return F.when(F.length(gap) > context, F.regexp_replace(F.left(gap, F.lit(context)), r"\s\S*$", "")).otherwise(gap)


def base_spans(texts: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, h, kind, start, end, value, left, right, times) of what the patterns find in texts(doc_id, h, text).

    left and right: up to context characters beside it, not past another match of the kind; an outer word goes only
    where a longer gap was cut.
    """
    text = F.col("text")
    kinds = []
    for kind, pattern, guard in _guarded(text):
        matches, gaps = _pieces(text, pattern, guard)
        kinds.append(F.struct(F.lit(kind).alias("kind"), matches.alias("m"), gaps.alias("g")))
    rows = texts.select(*_ROW, F.explode(F.array(*kinds)).alias("k")).where(F.size("k.m") > 0)
    # gaps are one more than matches: the pair after the last match is dropped
    pairs = F.transform(
        "k.m", lambda m,
        i: F.struct(
            m.alias("value"), F.length(F.get("k.g", i)).alias("gap"), _before(F.get("k.g", i), context).alias("left"),
            _after(F.get("k.g", i + 1), context).alias("right")
        )
    )
    rows = rows.select(
        *_ROW, F.col("k.kind").alias("kind"), F.posexplode(pairs).alias("i", "x")
    ).select(*_ROW, "kind", "i", "x.*", F.length("x.value").alias("length"))
    placed = _placed(rows)
    return placed.where(_valid(F.col("kind"), F.col("value"))).select(*_ROW, "kind", "start", "end", "value", "left", "right", "times")


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _semi(words: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """words whose term is among terms; the smaller table is broadcast only below BROADCAST_ROWS."""
    return words.join(F.broadcast(terms) if rows <= BROADCAST_ROWS else terms, "term", "left_semi")


def disclosing_terms(
    texts: DataFrame, spans: DataFrame, min_contexts: int = MIN_CONTEXTS, min_disclosure: float = MIN_DISCLOSURE
) -> DataFrame:
    """(term, entity, contexts, disclosure) of the terms that reveal an entity, from counts over all texts.

    A context is the text beside a mention without its cut-off outer words; copies of a context count once.
    Documents with the term, with the entity and with both are counted over the whole corpus, a repeated row as often as it
    stands.
    """
    entity = F.concat(F.col("kind"), F.lit(":"), _lower(F.col("value")))
    side = F.concat(F.regexp_replace("left", EMAIL, " "), F.lit(" "), F.regexp_replace("right", EMAIL, " "))
    mentions = spans.select(*_ROW, "times", entity.alias("entity"), _lower(side).alias("context"))
    near = mentions.select(
        *_ROW, "times", "entity", F.xxhash64("context").alias("c"),
        F.explode(F.array_distinct(F.regexp_extract_all("context", F.lit(TERM), F.lit(0)))).alias("term")
    )
    contexts = near.select("entity", "term", "c").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= min_contexts)
    # rows that are equal came out once and stand for their number
    both = near.select("entity", "term", *_ROW, "times").distinct().groupBy("entity", "term").agg(F.sum("times").alias("n_both"))
    n_entity = mentions.select("entity", *_ROW, "times").distinct().groupBy("entity").agg(F.sum("times").alias("n_entity"))
    n = float(max(1, texts.count()))
    content = F.log(F.lit(n) / F.col("n_entity"))

    def disclosure(n_term: str) -> Column:
        mutual = F.log(F.col("n_both") * F.lit(n) / (F.col("n_entity") * F.col(n_term)))
        return F.when(content > 1e-12, mutual / content).otherwise(0.0)

    # the documents with matches are a part of the corpus, so their counts bound a term's documents from below: nothing is
    # lost by leaving out pairs that miss the threshold even so, those of all but rare words
    words_of = lambda df: df.select(F.explode(F.array_distinct(F.regexp_extract_all(_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term"))
    at_least = words_of(texts.where(_suspect(F.col("text")))).groupBy("term").agg(F.count("*").alias("n_low"))
    pairs = contexts.join(both, ["entity", "term"]).join(n_entity, "entity").join(at_least, "term", "left")
    pairs = pairs.withColumn("n_low", F.greatest(F.coalesce("n_low", F.lit(0)), F.col("n_both")))
    pairs = keep(pairs.where(disclosure("n_low") >= min_disclosure).drop("n_low"), "pii-pairs")
    terms = pairs.select("term").distinct()
    n_terms = terms.count()
    if not n_terms:
        return pairs.select("term", "entity", "contexts", F.lit(0.0).alias("disclosure"))
    words = words_of(texts)
    if n_terms <= BROADCAST_ROWS:
        n_term = _semi(words, terms, n_terms).groupBy("term").agg(F.count("*").alias("n_term"))
    else:  # counted before the join, so that only sums are shuffled
        n_term = _semi(words.groupBy("term").agg(F.count("*").alias("n_term")), terms, n_terms)
    counted = pairs.join(n_term, "term").withColumn("disclosure", disclosure("n_term"))
    return counted.where(F.col("disclosure") >= min_disclosure).select("term", "entity", "contexts", "disclosure")


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end) of every occurrence of terms(term) in texts."""
    n = terms.count()
    if not n:
        return texts.select(
            *_ROW, F.lit("term").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")
        ).where(F.lit(False))
    words = texts.select(
        *_ROW, F.explode(F.array_distinct(F.regexp_extract_all(_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term")
    )
    touched = keep(_semi(words, terms, n).groupBy(*_ROW).agg(F.collect_set("term").alias("terms")), "pii-touched")
    lower = _lower(F.col("text"))
    rows = texts.join(touched, (texts["doc_id"].eqNullSafe(touched["doc_id"])) & (texts["h"] == touched["h"]))
    # terms are letters only, so they stand for themselves in a pattern
    pattern = F.concat(F.lit(f"(?<!{LETTER})(?:"), F.array_join("terms", "|"), F.lit(f")(?!{LETTER})"))
    rows = rows.select(
        texts["doc_id"], texts["h"], F.regexp_extract_all(lower, pattern, F.lit(0)).alias("m"),
        F.split(lower, pattern, -1).alias("g")
    )
    pairs = F.transform("m", lambda m, i: F.struct(F.length(m).alias("length"), F.length(F.get("g", i)).alias("gap")))
    rows = rows.select(*_ROW, F.lit("term").alias("kind"), F.posexplode(pairs).alias("i", "x")).select(*_ROW, "kind", "i", "x.*")
    return _placed(rows).select(*_ROW, "kind", "start", "end")


def find_pii(
    documents: DataFrame, min_contexts: int = MIN_CONTEXTS, min_disclosure: float = MIN_DISCLOSURE, context: int = CONTEXT
) -> DataFrame:
    """(doc_id, h, spans) of documents(doc_id, text, ...): spans as array<struct<start,rank,kind,end>> by start, then kind.

    One row per document, repeated rows included. Null texts are empty; an empty text has no spans and its
    row an empty array. Terms that overlap a base span are part of it and not listed.
    """
    texts = _texts(documents)
    base = keep(base_spans(texts, context), "pii-base")
    terms = keep(disclosing_terms(texts, base, min_contexts, min_disclosure).select("term").distinct(), "pii-terms")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = base.select(*_ROW, "kind", "start", "end").union(term_spans(texts, terms)).withColumn("rank", rank)
    # a term is dropped if a base span begun before it reaches into it, or one that begins in it
    row = Window.partitionBy(*_ROW).orderBy("start", "rank")
    reach = F.max(F.when(F.col("kind") != "term", F.col("end"))).over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    onward = F.min(F.when(F.col("kind") != "term", F.col("start"))).over(row.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    spans = spans.withColumns({"reach": reach, "onward": onward}).where((F.col("kind") != "term") | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("onward", F.col("end")) >= F.col("end"))))
    found = spans.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    rows = texts.select(*_ROW)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["h"] == found["h"]), "left")
    return joined.select(
        rows["doc_id"], rows["h"], F.coalesce(found["spans"], F.array().cast(found.schema["spans"].dataType)).alias("spans")
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def sanitised(documents: DataFrame, **limits) -> DataFrame:
    """documents(doc_id, text, ...) with entities generalised to [KIND] and disclosing terms removed; all columns kept.

    Overlapping base spans are covered from the first's start to the last's end under the first one's kind.
    """
    found = find_pii(documents, **limits).where(F.size("spans") > 0).dropDuplicates(_ROW)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = documents.withColumn("__h", F.xxhash64(text))
    joined = left.join(
        found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__fh"), F.col("spans").alias("__spans")),
        left["doc_id"].eqNullSafe(F.col("__id")) & (left["__h"] == F.col("__fh")), "left"
    )
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("pos"))
    mark = lambda s: F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    step = lambda a, s: F.when(s["start"] < a["pos"], F.struct(a["done"].alias("done"), F.greatest(a["pos"], s["end"]).alias("pos"))).otherwise(
        F.struct(
            F.concat(a["done"], F.substr(text, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")), mark(s)).alias("done"),
            s["end"].alias("pos")
        )
    )
    clean = F.aggregate("__spans", start, step, lambda a: F.concat(a["done"], F.substr(text, (a["pos"] + 1).cast("int"))))
    return joined.withColumn(
        "text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean)
    ).drop("__h", "__id", "__fh", "__spans")
