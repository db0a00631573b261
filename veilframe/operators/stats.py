"""Counts, marginals, correlations, information, and what plots are drawn from."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, gaussian_pdf
from ..functions.quantiles import exact_quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), null left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, share) of the values that are not null."""
    total = df.agg(F.count(F.col(column)).alias("total"))
    return value_counts(df, column).join(total, how="cross").select("value", (F.col("n") / F.col("total")).alias("share"))


def marginals(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """(value, real_share, synthetic_share) over the union of the values, 0 where one frame lacks it."""
    a = value_shares(real, column).withColumnRenamed("share", "real_share")
    b = value_shares(synthetic, column).withColumnRenamed("share", "synthetic_share")
    return a.join(b, "value", "full").select("value", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("real_share", "synthetic_share")))


def tall(df: DataFrame, columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """A row per aggregate: df is aggregated once, whatever the number of columns."""
    wide = df.agg(*(e.alias(f"a{i}") for i, e in enumerate(columns.values())))
    pairs = F.array(*(F.struct(F.lit(k).alias(name), F.col(f"a{i}").alias(value)) for i, k in enumerate(columns)))
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def distinct_count_table(df: DataFrame, columns: list[str]) -> DataFrame:
    return tall(df, {c: F.count_distinct(F.col(c)) for c in columns}, "column_name", "n_distinct")


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return distinct_count_table(df, columns).where("n_distinct <= 1").select("column_name")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return tall(df, {c: F.count_if(F.col(c).isNull()) for c in columns}, "column_name", "n_missing")


def frame_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column_name, data_type, n_present, n_missing) of the columns; NaN counts as present."""
    kinds, columns = dict(df.dtypes), columns or df.columns
    row = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"a{i}") for i, c in enumerate(columns)))
    parts = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"),
            F.col(f"a{i}").alias("n_present"), (F.col("n") - F.col(f"a{i}")).alias("n_missing")
        ) for i,
        c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every ordered pair over the rows that have both, r null with a constant: one aggregation over the upper triangle."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*(correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows += [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")) for x, y in {(a, b), (b, a)}]
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def nan_correlation_columns(matrix: DataFrame) -> DataFrame:
    """Columns of which any correlation is missing."""
    return matrix.where(F.col("r").isNull()).select(F.col("a").alias("column_name")).distinct()


def correlation_difference(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(a, b, difference) of two matrices, missing correlations as 0."""
    joined = real.join(synthetic.withColumnRenamed("r", "other"), ["a", "b"])
    return joined.select("a", "b", F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("other", F.lit(0.0))).alias("difference"))


def frobenius(differences: DataFrame) -> DataFrame:
    return differences.agg(F.coalesce(F.sqrt(F.sum(F.col("difference") * F.col("difference"))), F.lit(0.0)).alias("norm"))


def contingency(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, child, n) over all pairs of observed values, 0 included."""
    kept = df.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(
        F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child")
    )
    counts = kept.groupBy("parent", "child").agg(F.count("*").alias("n"))
    # the grid is the result itself; both domains come from the counts, which are as few as the pairs of values
    grid = counts.select("parent").distinct().join(counts.select("child").distinct(), how="cross")
    return grid.join(counts, ["parent", "child"], "left").select("parent", "child", F.coalesce("n", F.lit(0)).alias("n"))


def contingency_pivot(df: DataFrame, parent: str, child: str, values: list[str]) -> DataFrame:
    counts = df.where(F.col(parent).isNotNull()).groupBy(F.col(parent).cast("string").alias("parent")).pivot(child, values).agg(F.count(F.lit(1)))
    return counts.na.fill(0).select("parent", *(F.col(v).alias(f"n_{v}") for v in values))


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, mi) in nats of every pair of columns, over the rows where neither is null.

    All pairs are counted in one aggregation: rows spread into (pair, value, value), combined before the shuffle.
    """
    pairs = F.array(*(
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a,
        b in combinations(columns, 2)
    ))
    # equal rows are counted first: what is spread is as small as the distinct combinations
    counted = df.groupBy(*columns).agg(F.count("*").alias("k"))
    cells = counted.select("k", F.explode(pairs).alias("p")).select("k", "p.*").where("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.sum("k").cast("double").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("a", "b", *by))
    cells = cells.withColumns({"total": over(), "nx": over("x"), "ny": over("y")})
    part = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return cells.groupBy("a", "b").agg(F.sum(part).alias("mi"))


def quantile_table(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    found = exact_quantiles(df, column, probabilities)
    return df.sparkSession.createDataFrame([(float(p), v) for p, v in zip(probabilities, found)], "probability double, value double")


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, Tukey's whiskers (the outermost values within 1.5 box lengths) and the number of points beyond."""
    q1, q2, q3 = exact_quantiles(df, column, [0.25, 0.5, 0.75])
    if q1 is None:
        q1 = q2 = q3 = float("nan")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    x = F.col(column).cast("double")
    inside = x.between(low, high)
    return df.where(x.isNotNull()).agg(
        F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"), F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers")
    )


def kde_curve(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """(x, density): a Gaussian kernel estimate on an even grid from the least to the largest value, bandwidth n^(-1/5) times the sample deviation."""
    x = F.col(column).cast("double")
    n, sd, low, high = df.where(x.isNotNull()).agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = (sd or 1.0) * n**-0.2
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    curve = df.where(x.isNotNull()).agg(*(F.avg(gaussian_pdf(F.lit(g), x, width)).alias(f"d{i}") for i, g in enumerate(grid)))
    return curve.select(F.explode(F.array(*(
        F.struct(F.lit(g).alias("x"), F.col(f"d{i}").alias("density")) for i, g in enumerate(grid)
    ))).alias("p")).select("p.*")


def log_frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, weight): ln(n + 1) as a share of its sum."""
    counts = value_counts(df, column).select("value", F.log(F.col("n") + F.lit(1)).alias("w"))
    return counts.join(counts.agg(F.sum("w").alias("total")), how="cross").select("value", (F.col("w") / F.col("total")).alias("weight"))


def aggregate_trials(trials: DataFrame) -> DataFrame:
    """(metric, submetric, mean, std, min, max) of trials(metric, submetric, value), population deviation; NaN counts as missing."""
    v = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    return trials.groupBy("metric", "submetric").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def tree_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, is_root) of edges(a, b): the root has the largest degree, the smallest name among equals."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
    first = degrees.agg(F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("first"))
    return degrees.join(first, how="cross").select("node", "degree", (F.col("node") == F.col("first.node")).alias("is_root"))
