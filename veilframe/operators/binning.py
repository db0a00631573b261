"""Discretisation: quantile bins, zero-inflated levels, most frequent values."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

MISSING = "nan"


@dataclass(frozen=True)
class Bins:
    """Edges e0 < e1 < ...; bin i is (e_i, e_i+1], the first one with its lower edge. Fewer than two edges: no bin."""

    edges: tuple[float, ...]

    def labels(self) -> list[str]:
        """`(lo, hi]` with edges rounded to as few digits as keep them apart; the first one is lowered by one unit."""
        if len(self.edges) < 2:
            return []
        for digits in range(20):
            shown = [round(e, digits) + 0.0 for e in self.edges]
            if len(set(shown)) == len(shown):
                break
        shown[0] = round(shown[0] - 10.0**-digits, digits)
        return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]

    def index(self, x: Column) -> Column:
        """0-based bin, null outside and for null."""
        out = F.when(x < self.edges[0], None) if len(self.edges) > 1 else F.when(F.lit(True), None)
        for i, edge in enumerate(self.edges[1:]):
            out = out.when(x <= edge, F.lit(i))
        return out.cast("int")

    def label(self, x: Column) -> Column:
        names = self.labels()
        if not names:
            return F.lit(MISSING)
        return F.coalesce(F.get(F.array(*map(F.lit, names)), self.index(x)), F.lit(MISSING))

    def index_of(self, x: float) -> int | None:
        if len(self.edges) < 2 or not self.edges[0] <= x <= self.edges[-1]:
            return None
        return max(0, bisect_left(self.edges, x) - 1)


def quantile_edges(q: int) -> list[float]:
    return [k / q for k in range(q + 1)]


def bins_at(found: list[float | None]) -> Bins:
    """Bins between quantiles, duplicates dropped."""
    return Bins(tuple(sorted({e for e in found if e is not None})))


def fit_bins(df: DataFrame, column: str, q: int) -> Bins:
    """Edges at the k/q quantiles."""
    return bins_at(exact_quantiles(df, column, quantile_edges(q)))


def apply_bins(df: DataFrame, column: str, bins: Bins, output: str | None = None) -> DataFrame:
    return df.withColumn(output or column, bins.label(F.col(column).cast("double")))


def zero_inflated(df: DataFrame, column: str, threshold: float | None, output: str | None = None) -> DataFrame:
    """None for 0, Low up to the threshold, High above; null is High, as it is neither."""
    x = F.col(column)
    return df.withColumn(output or column, F.when(x == 0, "None").when(x <= threshold, "Low").otherwise("High"))


#: The share of values up to which a zero-inflated number is low.
HIGH = 0.9


def high_threshold(df: DataFrame, column: str, probability: float = HIGH) -> float | None:
    return exact_quantiles(df, column, [probability])[0]


def frequent_values(df: DataFrame, column: str, k: int) -> list[str]:
    """The k most frequent values, ties in order of the value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return [r[column] for r in counts.orderBy(F.desc("n"), column).limit(k).collect()]


def group_rest(df: DataFrame, column: str, kept: list, other: str = "Other") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(kept), F.col(column).cast("string")).otherwise(other))
