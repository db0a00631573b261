"""Exact quantiles with linear interpolation, whatever the number of rows."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many values Spark's exact aggregate may hold them in one task.
DIRECT = 1_000_000
SPLITS = 63


def _elements(values: DataFrame, ranks: list[int], n: int, limit: int) -> dict[int, float]:
    """The values at these 0-based ranks of values(v), n rows."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low == high:
        return {r: low for r in ranks}
    if n <= limit:
        found = values.agg(F.percentile("v", F.array(*(F.lit(r / (n - 1)) for r in ranks)))).first()[0]
        return dict(zip(ranks, found))
    cuts = values.agg(F.percentile_approx("v", [i / (SPLITS + 1) for i in range(1, SPLITS + 1)], 10000)).first()[0]
    cuts = sorted({c for c in cuts if c < high}) or [low]
    below = values.agg(*(F.count_if(F.col("v") <= c) for c in cuts)).first()
    ends, out = [*below, n], {}
    for part in sorted({bisect_right(list(below), r) for r in ranks}):
        start = ends[part - 1] if part else 0
        inside = values
        if part:
            inside = inside.where(F.col("v") > cuts[part - 1])
        if part < len(cuts):
            inside = inside.where(F.col("v") <= cuts[part])
        mine = [r for r in ranks if start <= r < ends[part]]
        found = _elements(inside, [r - start for r in mine], ends[part] - start, limit)
        out.update({r + start: v for r, v in found.items()})
    return out


def frame_quantiles(df: DataFrame, wanted: dict[str, list[float]], limit: int = DIRECT) -> dict[str, list[float | None]]:
    """Quantiles of several columns without nulls and NaN; None each for a column with nothing left.

    One job counts, and one takes the quantiles of as many columns as have limit values together. Columns of more values have
    their ranks narrowed down by approximate cuts and exact counts until the values around each fit one task. Every
    pass is an aggregation.
    """
    if not wanted:
        return {}
    values = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(wanted)))
    counts = dict(zip(wanted, values.agg(*(F.count(f"v{i}") for i in range(len(wanted)))).first()))
    found: dict[str, list[float | None]] = {c: [None] * len(p) for c, p in wanted.items()}
    places = {c: i for i, c in enumerate(wanted)}
    groups: list[list[str]] = [[]]
    for c in sorted((c for c in wanted if 0 < counts[c] <= limit), key=counts.__getitem__):
        if groups[-1] and sum(counts[x] for x in groups[-1]) + counts[c] > limit:
            groups.append([])
        groups[-1].append(c)
    for group in filter(None, groups):
        row = values.agg(*(F.percentile(f"v{places[c]}", F.array(*(F.lit(float(p)) for p in wanted[c]))) for c in group)).first()
        found |= {c: list(r) for c, r in zip(group, row)}
    for c in wanted:
        if counts[c] > limit:
            n, column = counts[c], values.select(F.col(f"v{places[c]}").alias("v")).where("v is not null")
            at = [(n - 1) * p for p in wanted[c]]
            ranks = sorted({math.floor(h) for h in at} | {math.ceil(h) for h in at})
            element = _elements(column, ranks, n, limit)
            found[c] = [element[math.floor(h)] + (element[math.ceil(h)] - element[math.floor(h)]) * (h - math.floor(h)) for h in at]
    return found


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], limit: int = DIRECT) -> list[float | None]:
    """frame_quantiles() of one column."""
    return frame_quantiles(df, {column: probabilities}, limit)[column]
