"""Preprocessing recipes: a table's roles in, a cleaned frame and what is known of it out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.quantiles import frame_quantiles
from ..operators import binning, clean
from ..sources.tables import COVERTYPE_BINARY, COVERTYPE_NUMERIC, FrameMeta


@dataclass(frozen=True)
class Roles:
    """Which column gets which treatment.

    unknown: missing values become a category. dropped: left out. quantile: bins by column. zero_inflated: three levels.
    rest: most frequent values kept, as (for the network, for the generator). numeric: parsed and
    imputed by the standard recipe, as doubles by the generator's. whole: integers there. strip: a literal taken out.
    """

    key: str | None = None
    unknown: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    quantile: tuple[tuple[str, int], ...] = ()
    zero_inflated: tuple[str, ...] = ()
    rest: tuple[tuple[str, int, int], ...] = ()
    numeric: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()
    strip: tuple[tuple[str, str], ...] = ()


ADULT = Roles(
    key="row_key",
    unknown=("workclass", "occupation", "native-country"),
    dropped=("education-num",),
    quantile=(("age", 5), ("fnlwgt", 10), ("hours-per-week", 5)),
    zero_inflated=("capital-gain", "capital-loss"),
    rest=(("native-country", 2, 5),),
    numeric=("age", "fnlwgt", "capital-gain", "capital-loss", "hours-per-week"),
    strip=(("income", "."),),
)
COVERTYPE = Roles(
    key="row_key", quantile=tuple((c, 5) for c in COVERTYPE_NUMERIC), numeric=tuple(COVERTYPE_NUMERIC),
    whole=(*COVERTYPE_BINARY, "Cover_Type")
)
PEOPLE = Roles(
    key="o_orderkey", unknown=("segment",), dropped=("known_segment",), quantile=(("price_text", 5),), zero_inflated=("balance",),
    rest=(("c_nationkey", 2, 5),), numeric=("price_text", "balance"), strip=(("priority", "."),)
)
RECIPES = {"adult": ADULT, "covertype": COVERTYPE, "people": PEOPLE}


def _clean(df: DataFrame, roles: Roles) -> DataFrame:
    df = clean.trim_strings(clean.sentinel_to_null(df))
    df = clean.drop_columns(df, *roles.dropped)
    for column, literal in roles.strip:
        df = clean.strip_literal(df, column, literal)
    return clean.fill_constant(df, dict.fromkeys(roles.unknown, "Unknown"))


def for_network(df: DataFrame, roles: Roles, fitted_on: DataFrame | None = None) -> tuple[DataFrame, FrameMeta]:
    """All text: bins, levels and most frequent values are fitted on fitted_on, or on the frame itself."""
    df = _clean(df, roles)
    base = df if fitted_on is None else _clean(fitted_on, roles)
    numbers = [c for c, _ in roles.quantile] + list(roles.zero_inflated)
    df, base = clean.to_numeric(df, numbers), clean.to_numeric(base, numbers)
    wanted = {c: binning.quantile_edges(q) for c, q in roles.quantile} | {c: [binning.HIGH] for c in roles.zero_inflated}
    found = frame_quantiles(base, wanted)
    for c, _ in roles.quantile:
        df = binning.apply_bins(df, c, binning.bins_at(found[c]))
    for c in roles.zero_inflated:
        df = binning.zero_inflated(df, c, found[c][0])
    for c, k, _ in roles.rest:
        df = binning.group_rest(df, c, binning.frequent_values(base, c, k))
    columns = [c for c in df.columns if c != roles.key]
    return clean.cast_columns(df, dict.fromkeys(columns, "string")), FrameMeta("privbayes", True, tuple(columns))


def for_generator(df: DataFrame, roles: Roles, fitted_on: DataFrame | None = None) -> tuple[DataFrame, FrameMeta]:
    """Numbers stay numbers, the rest is text of few values."""
    df = _clean(df, roles)
    base = df if fitted_on is None else _clean(fitted_on, roles)
    for c, _, k in roles.rest:
        df = binning.group_rest(df, c, binning.frequent_values(base, c, k))
    df = clean.to_numeric(df, list(roles.numeric))
    df = clean.cast_columns(df, dict.fromkeys(roles.whole, "bigint"))
    discrete = [c for c in df.columns if c not in roles.numeric and c != roles.key]
    return df, FrameMeta("dpctgan", False, tuple(discrete))


def standard(df: DataFrame, roles: Roles, fitted_on: DataFrame | None = None) -> tuple[DataFrame, FrameMeta]:
    """Numbers parsed and imputed by their median, the rest as text."""
    df = _clean(df, roles)
    base = clean.to_numeric(df if fitted_on is None else _clean(fitted_on, roles), list(roles.numeric))
    df = clean.impute_median(clean.to_numeric(df, list(roles.numeric)), list(roles.numeric), base)
    df = clean.cast_columns(df, dict.fromkeys(roles.whole, "bigint"))
    text = [c for c in df.columns if c not in roles.numeric and c not in roles.whole and c != roles.key]
    return clean.cast_columns(df, dict.fromkeys(text, "string")), FrameMeta("standard", False, tuple(text))


_BY_SYNTHESIZER = {"privbayes": for_network, "dpctgan": for_generator, "standard": standard}


def preprocess(df: DataFrame, dataset: str, synthesizer: str, fitted_on: DataFrame | None = None) -> tuple[DataFrame, FrameMeta]:
    """The recipe for a dataset and a synthesizer, by name in any case; ValueError for others."""
    try:
        return _BY_SYNTHESIZER[synthesizer.lower()](df, RECIPES[dataset.lower()], fitted_on)
    except KeyError as e:
        raise ValueError(f"unknown dataset or synthesizer: {e.args[0]}") from None


def describe(dataset: str, synthesizer: str) -> dict:
    """What a recipe does, by column."""
    if dataset.lower() not in RECIPES or synthesizer.lower() not in _BY_SYNTHESIZER:
        raise ValueError(f"unknown dataset or synthesizer: {dataset}, {synthesizer}")
    roles = RECIPES[dataset.lower()]
    info: dict = {
        "dataset": dataset.lower(), "synthesizer": synthesizer.lower(), "dropped": list(roles.dropped),
        "unknown": list(roles.unknown)
    }
    if synthesizer.lower() == "privbayes":
        info |= {"bins": dict(roles.quantile), "levels": list(roles.zero_inflated), "kept_values": {c: k for c, k, _ in roles.rest}}
    elif synthesizer.lower() == "dpctgan":
        info |= {"numeric": list(roles.numeric), "kept_values": {c: k for c, _, k in roles.rest}}
    else:
        info |= {"imputed": list(roles.numeric)}
    return info


