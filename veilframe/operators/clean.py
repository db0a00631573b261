"""Cleaning: sentinels, blanks, casts, imputation, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import frame_quantiles

#: Numbers of distinct values up to which a column counts as discrete, by rule.
COMPARE_LIMIT, SYNTHESIS_LIMIT = 20, 10


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def sentinel_to_null(df: DataFrame, sentinel: str = "?", columns: list[str] | None = None) -> DataFrame:
    """The sentinel, blanks around it or not, becomes null."""
    return df.withColumns({c: F.when(F.trim(c) != sentinel, F.col(c)) for c in columns or text_columns(df)})


def trim_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns or text_columns(df)})


def fill_constant(df: DataFrame, values: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in values.items() if c in df.columns})


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Doubles; what is no number becomes null."""
    return df.withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in columns})


def strip_literal(df: DataFrame, column: str, literal: str = ".") -> DataFrame:
    return df.withColumn(column, F.trim(F.replace(column, F.lit(literal), F.lit(""))))


def impute_median(df: DataFrame, columns: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Nulls become the column's median, in the reference frame if there is one."""
    medians = frame_quantiles(df if reference is None else reference, {c: [0.5] for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")) for c, (m,) in medians.items()})


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c]).cast("double")) for c in columns})


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Distinct values without null, of all columns in one aggregation."""
    columns = columns or df.columns
    row = df.agg(*(F.count_distinct(F.col(c)).alias(c) for c in columns)).first()
    return {c: row[c] for c in columns}


def infer_roles(df: DataFrame, limit: int = COMPARE_LIMIT, columns: list[str] | None = None) -> dict[str, str]:
    """categorical for text and columns of few values, else numeric. limit 0: by type only."""
    columns = columns or df.columns
    text = {c for c in text_columns(df) if c in columns}
    rest = [c for c in columns if c not in text]
    counts = {}
    if limit and rest:
        # one pass without spreading rows tells which columns are nowhere near the limit; the others are counted exactly
        about = df.agg(*(F.approx_count_distinct(F.col(c), 0.02).alias(f"n{i}") for i, c in enumerate(rest))).first()
        near = [c for i, c in enumerate(rest) if about[f"n{i}"] <= 2 * limit + 10]
        counts = dict.fromkeys(rest, limit + 1) | (distinct_counts(df, near) if near else {})
    return {c: "categorical" if c in text or (limit and counts[c] <= limit) else "numeric" for c in columns}


def as_category(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text with null as a category of its own, `nan`; whole doubles are written without fraction."""
    kinds = dict(df.dtypes)

    def text(c):
        x = F.col(c)
        if kinds[c] in ("double", "float"):
            x = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))
        return F.coalesce(x.cast("string"), F.lit("nan"))

    return df.withColumns({c: text(c) for c in columns})


def harmonise(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Both frames with the first one's roles: text for categories, doubles with the first one's median for the rest."""
    roles = infer_roles(real, COMPARE_LIMIT, columns)
    category = [c for c in columns if roles[c] == "categorical"]
    number = [c for c in columns if roles[c] == "numeric"]
    left, right = (to_numeric(as_category(x, category), number) for x in (real, synthetic))
    return impute_median(left, number), impute_median(right, number, left), roles
