"""Encodings: codes, indicators, scaling, and values normalised by the mode of a mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, gaussian_pdf
from ..functions.ranking import prefix_sum

#: Categories that an encoding may spread over columns.
MAX_CATEGORIES = 1000


def category_codes(frames: list[DataFrame], column: str) -> DataFrame:
    """(value, code): 0.. over the sorted union of the frames' values; null has no code."""
    values = None
    for df in frames:
        mine = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
        values = mine if values is None else values.union(mine)
    return prefix_sum(values.distinct(), "value", F.lit(1), "code", "__next").select("value", F.col("code").cast("int").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame, output: str) -> DataFrame:
    """df with the value's code, null for values without one."""
    table = codes.select(F.col("value").alias("__value"), F.col("code").alias(output))
    return df.join(table, F.col(column).cast("string") == F.col("__value"), "left").drop("__value")


def categories(df: DataFrame, column: str, by_frequency: bool = False) -> list[str]:
    """The values, sorted or most frequent first; ValueError if there are too many to spread."""
    counts = df.select(F.col(column).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    order = [F.desc("n"), "v"] if by_frequency else ["v"]
    found = [r["v"] for r in counts.orderBy(*order).limit(MAX_CATEGORIES + 1).collect()]
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    return found


def indicators(column: str, values: list[str]) -> list[Column]:
    """1 or 0 per value; a value outside the list, and null, is 0 everywhere."""
    x = F.col(column).cast("string")
    return [F.coalesce((x == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values]


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The column replaced by its indicators, aligned to the fitted values."""
    return df.select(*(c for c in df.columns if c != column), *indicators(column, values))


def scale_parameters(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation, 1 for a constant column."""
    row = df.agg(*(f(c).alias(f"{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m{c}"] or 0.0, row[f"s{c}"] or 1.0) for c in columns}


def standard_scale(df: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in parameters.items()})


def _array(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def mode_posterior(x: Column, weights: list[float], means: list[float], deviations: list[float]) -> Column:
    """Array of the modes' shares of the density at x."""
    dense = [F.lit(float(w)) * gaussian_pdf(x, m, s) for w, m, s in zip(weights, means, deviations)]
    total = sum(dense[1:], dense[0]) + F.lit(1e-8)
    return F.array(*(d / total for d in dense))


def draw_slot(shares: Column, u: Column, n: int) -> Column:
    """0-based slot whose cumulated share first exceeds u of the total; uniform over the n slots if the total is 0 or null."""
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    even = F.least(F.floor(u * n), F.lit(n - 1)).cast("int")
    step = F.aggregate(
        shares,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("passed")),
        lambda a, x: F.struct(
            (a["sum"] + x).alias("sum"), (a["passed"] + F.when(a["sum"] + x <= u * total, 1).otherwise(0)).alias("passed")
        ),
    )
    return F.when(total > 0, F.least(step["passed"], F.lit(n - 1))).otherwise(even)


def mode_normalise(x: Column, mode: Column, means: list[float], deviations: list[float]) -> Column:
    """(x - mean) / (4 deviations) of the mode, held to [-1, 1]."""
    return clip((x - F.get(_array(means), mode)) / (F.lit(4.0) * F.get(_array(deviations), mode)), -1.0, 1.0)


def mode_denormalise(scalar: Column, mode: Column, means: list[float], deviations: list[float]) -> Column:
    return scalar * F.lit(4.0) * F.get(_array(deviations), mode) + F.get(_array(means), mode)


def argmax_slot(values: Column) -> Column:
    """1-based place of the first largest element; null for an empty array."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values))).cast("int")
