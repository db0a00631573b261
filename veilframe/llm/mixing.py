"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys and are range-sorted by them within their source. A source of any size
is cut into buckets of the key space by its own row count; bucket sums, then a prefix sum over
buckets, then one inside each bucket give every document the number of words before it without
any source meeting in one task. A target is reached by whole epochs and a cut in the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep, unused

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096
#: The hash-random key: so many first bits of an MD5 of seed and id.
KEY_BITS = 60
MAX_EPOCHS = 3
#: Rows from which a source is large.
HOT_ROWS = 1_000_000


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, docs, target) of sizes(source, size): one row per source.

    Weights 1, 2, 3, repeating over the sources by code point, null last, share the whole; a target stops
    at max_epochs times its source's size and the excess is reshared. That ends in water
    filling: sources in order of cap / weight, the first ones capped as long as the level that
    is left for the others lies above theirs. The windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = level.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))
    })
    # the level if all sources before this one are capped; below it this source is capped as well
    per = per.withColumn(
        "level", (F.col("total") - F.col("cap_before")).cast("double") / (F.col("weights") - F.col("weight_before")).cast("double")
    )
    per = per.withColumn("capped", F.col("cap").cast("double") <= F.col("level") * F.col("weight"))
    per = per.withColumn(
        "final_level", F.min(F.when(~F.col("capped"), F.struct("cap_before", "weight_before", "level"))).over(everything)["level"]
    )
    return per.select(
        "source", "source_size", "docs",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final_level") * F.col("weight")).alias("target")
    )


def mix(
    documents: DataFrame, seed: int = 42, bucket_rows: int = BUCKET_ROWS, max_epochs: int = MAX_EPOCHS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, tie) of documents(doc_id, text, source, ...).

    Size: words of the text, 0 if it is null or empty. Rows with equal ids are told apart by
    a hash of their text and may be in either order only if they are the same. Other columns
    are ignored; an empty table gives an empty one. taken = whole epochs of the document plus
    what the last epoch's cut leaves of it, so a source's sum is its target rounded down.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = documents.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(
            F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, KEY_BITS // 4), 16, 10
        ).cast("long").alias("key"),
        F.xxhash64(text, F.col("source").cast("string")).alias("tie"),
    )
    sized = keep(sized, "mix-sizes")
    plan = targets(sized, max_epochs).withColumn("buckets", F.ceil(F.col("docs") / bucket_rows).cast("long"))
    plan = keep(
        plan.withColumn("source_key", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))),
        "mix-plan"
    )
    place = F.shiftright(F.shiftright(F.col("key"), KEY_BITS - 31) * F.col("buckets"), 31)
    sized = sized.withColumn("source_key", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
    # rows of large sources stay where they are and have the source's row broadcast: there are no more such sources than
    # the table has times hot_rows rows; the others meet theirs by a shuffle in which no key has more than that
    facts = plan.select("source_key", "source_size", "target", "buckets")
    hot, cold = facts.where(plan["docs"] > hot_rows), facts.where(plan["docs"] <= hot_rows)
    if hot.limit(1).count():
        placed = sized.join(F.broadcast(hot), "source_key").unionByName(sized.join(F.broadcast(hot), "source_key", "left_anti").join(cold, "source_key"))
    else:
        placed = sized.join(cold, "source_key")
    placed = placed.withColumn("bucket", place)
    sums = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    local = placed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = local.join(offsets, ["source_key", "bucket"]).withColumn("before", F.col("offset") + F.col("local"))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), "tie"
    )


def mixed(documents: DataFrame, **how) -> DataFrame:
    """documents(doc_id, text, source, ...) as the mix takes them: each row once for every epoch that takes words of it.

    The row that a source's cut goes through stays whole. All columns are kept; see mix() for the rest.
    """
    id_, tie, number, mine, row, times, time = unused(documents.columns, "id", "tie", "number", "mine", "row", "times", "time")
    nth = lambda *order, by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    plan = mix(documents, **how).where("taken > 0")
    plan = plan.select(
        F.col("doc_id").alias(id_), F.col("tie").alias(tie), nth(F.desc("taken"), by=("doc_id", "tie")).alias(number),
        F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times)
    )
    rows = documents.withColumn(mine, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")))
    rows = rows.withColumn(row, nth(F.lit(0), by=("doc_id", mine)))
    taken = rows.join(plan, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mine) == F.col(tie)) & (F.col(row) == F.col(number)))
    return taken.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*documents.columns)
