"""The evaluation: prepare, synthesise, and score fidelity, utility and disclosure over budgets and trials."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bayesnet, ctgan, mlutil, privacy, sampling, stats
from ..operators.clean import harmonise
from ..operators.encode import category_codes, encode
from ..sources import files, plots
from . import recipes

METRICS = "dataset string, synthesizer string, epsilon double, trial int, metric string, submetric string, value double, status string, error string"
MARGINAL_COLUMNS = 6
SYNTHETIC_ROWS = 800


class Synthesizer(Protocol):
    """What the evaluation needs of one: fit on a frame, then sample rows with the same columns."""

    def fit_frame(self, df: DataFrame, columns: list[str], discrete: list[str], key: str) -> Synthesizer: ...

    def sample_frame(self, spark: SparkSession, n: int) -> DataFrame: ...


class NetworkSynthesizer:
    def __init__(self, epsilon: float, seed: int | None = None):
        self.model = bayesnet.PrivBayes(epsilon, seed)

    def fit_frame(self, df, columns, discrete, key):
        self.model.fit(df, columns)
        return self

    def sample_frame(self, spark, n):
        return self.model.sample(n)


class GeneratorSynthesizer:
    def __init__(self, epsilon: float, seed: int | None = None, epochs: int = 30):
        self.model = ctgan.CTGAN(epsilon=epsilon, delta=1e-5, epochs=epochs, batch=250, seed=seed)

    def fit_frame(self, df, columns, discrete, key):
        self.model.fit(df, columns, key, discrete)
        return self

    def sample_frame(self, spark, n):
        return self.model.sample(spark, n, self.model.seed)


def synthesizer(name: str, epsilon: float, seed: int | None = None, **how) -> Synthesizer:
    """By name in any case; ValueError for others."""
    kinds = {"privbayes": NetworkSynthesizer, "dpctgan": GeneratorSynthesizer}
    if name.lower() not in kinds:
        raise ValueError(f"unknown synthesizer: {name}")
    return kinds[name.lower()](epsilon, seed, **how)


def check_columns(synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """synthetic in the order of columns; ValueError unless the sets are equal."""
    if set(synthetic.columns) != set(columns):
        raise ValueError(f"columns differ: {sorted(set(synthetic.columns) ^ set(columns))}")
    return synthetic.select(*columns)


def correlation_gap(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, difference) of the frames' correlations, categories by their codes."""
    left, right, roles = harmonise(real, synthetic, columns)
    plain = [left, right]  # codes come from these, so that a column's plan does not hold those of the columns before it
    for c in columns:
        if roles[c] == "categorical":
            codes = category_codes(plain, c)
            left, right = (encode(x, c, codes, f"{c}__code").drop(c).withColumnRenamed(f"{c}__code", c) for x in (left, right))
    return stats.correlation_difference(*(stats.correlation_matrix(x, columns) for x in (left, right)))


def evaluate_statistical(real: DataFrame, synthetic: DataFrame, columns: list[str], key: str) -> list[tuple[str, str, Callable[[], float]]]:
    """(metric, submetric, how to get it): the norm of the correlations' difference, and the propensity error with its floor."""

    def norm() -> float:
        return stats.frobenius(correlation_gap(real, synthetic, columns)).first()["norm"]

    found: dict = {}

    def error(name: str) -> float:
        if not found:
            found.update(mlutil.pmse(real, synthetic, columns, key).first().asDict())
        return found[name]

    return [
        ("correlation_difference_norm", "", norm), ("pmse_score", "", lambda: error("pmse")),
        ("pmse_floor", "", lambda: error("floor"))
    ]


def evaluate_privacy(real: DataFrame, synthetic: DataFrame, columns: list[str], key: str) -> list[tuple[str, str, Callable[[], float]]]:
    """Exact matches, their percentage, and the distances to the closest record."""
    found: dict = {}

    def match(name: str) -> float:
        if "matches" not in found:
            found.update(privacy.exact_match_percentage(real, synthetic, columns).first().asDict())
        return float(found[name])

    def distance(name: str) -> float:
        if "mean" not in found:
            found.update(privacy.dcr_summary(privacy.closest_records(real, synthetic, columns, key, key)).first().asDict())
        return found[name]

    return [
        ("exact_matches", "", lambda: match("matches")), ("exact_matches_percentage", "", lambda: match("percentage")),
        *(("dcr_stats", m, lambda m=m: distance(m)) for m in ("mean", "min", "max"))
    ]


def evaluate_learning(
    train: DataFrame, test: DataFrame, synthetic: DataFrame, columns: list[str], target: str, models=mlutil.MODELS
) -> list[tuple[str, str, Callable[[], float]]]:
    """Accuracies on real test rows of models trained on real and on synthetic rows, and what is retained."""
    found: dict = {}

    def get(kind: str, model: str) -> float:
        if not found:
            base = mlutil.evaluate(train, test, columns, target, models)
            tstr = mlutil.evaluate(synthetic, test, columns, target, models)
            for r in mlutil.retention(base, tstr).collect():
                found.update({
                    ("baseline", r["model"]): r["baseline"], ("tstr", r["model"]): r["tstr"],
                    ("retention", r["model"]): r["retention"]
                })
        return found[kind, model]

    return [(kind, m, lambda kind=kind, m=m: get(kind, m)) for kind in ("baseline", "tstr", "retention") for m in models]


def measure(tasks: list[tuple[str, str, Callable[[], float]]], labels: tuple) -> list[tuple]:
    """A row per metric; one that fails is recorded with its error and does not stop the others."""
    rows = []
    for metric, submetric, get in tasks:
        try:
            value = get()
            rows.append((*labels, metric, submetric, None if value is None else float(value), "ok", None))
        except Exception as e:  # noqa: BLE001
            rows.append((*labels, metric, submetric, None, "failed", f"{type(e).__name__}: {e}"[:500]))
    return rows


def marginal_data(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, real_share, synthetic_share) of the first columns: what bar charts are drawn from."""
    out = None
    for c in columns[:MARGINAL_COLUMNS]:
        part = stats.marginals(real, synthetic, c).select(F.lit(c).alias("column_name"), "value", "real_share", "synthetic_share")
        out = part if out is None else out.unionByName(part)
    return out


def _write_plots(real: DataFrame, synthetic: DataFrame, columns: list[str], folder: Path, trial: int) -> float:
    """The marginals of a trial as a table and as bars, and the matrix of the correlations' differences; the number of files."""
    shares = marginal_data(real, synthetic, columns).cache()
    files.write_csv(shares, str(folder / f"marginal_distributions_trial_{trial}"))
    plots.marginal_bars(shares, folder / f"marginal_distributions_trial_{trial}.svg")
    plots.matrix_cells(correlation_gap(real, synthetic, columns), "difference", folder / f"correlation_difference_trial_{trial}.svg")
    shares.unpersist()
    return 3.0


def nested(aggregates: DataFrame) -> dict:
    """{metric: {mean, ...}} or {metric: {submetric: {mean, ...}}} with sorted keys."""
    out: dict = {}
    for r in sorted(aggregates.collect(), key=lambda r: (r["metric"], r["submetric"])):
        values = {k: r[k] for k in ("mean", "std", "min", "max")}
        if r["submetric"]:
            out.setdefault(r["metric"], {})[r["submetric"]] = values
        else:
            out[r["metric"]] = values
    return out


def run(
    spark: SparkSession, data: DataFrame, dataset: str, name: str, target: str, key: str, epsilons: list[float], n_trials: int = 3,
    train_size: int = 1000, test_size: int = 500, out: str | None = None, seed: int = 42, models=mlutil.MODELS, **how
) -> DataFrame:
    """METRICS rows over the grid of budgets and trials; with out, also the files of each configuration.

    Recipes run on the whole split, the test part's fitted on the training part, and samples are taken afterwards.
    One split and one seed serve all preparations, so a row means the same record in each.
    """
    split = sampling.stratified_split(data, target, key, 0.3, seed).cache()
    train_all, test_all = split.where("is_test = 0").drop("is_test"), split.where("is_test = 1").drop("is_test")
    train, meta = recipes.preprocess(train_all, dataset, name)
    plain, _ = recipes.preprocess(train_all, dataset, "standard")
    test, _ = recipes.preprocess(test_all, dataset, "standard", train_all)
    train, plain, test = (
        sampling.seeded_sample(df, key, n, seed).cache() for df, n in ((train, train_size), (plain, train_size), (test, test_size))
    )
    columns = [c for c in train.columns if c != key]
    discrete = [c for c in columns if c in meta.discrete_columns]
    rows = []
    for epsilon in epsilons:
        folder = files.results_dir(out, dataset, name, epsilon) if out else None
        kept: dict[str, list] = {"statistical": [], "privacy": [], "ml": []}
        for trial in range(1, n_trials + 1):
            labels = (dataset, name, float(epsilon), trial)
            try:
                model = synthesizer(name, epsilon, None if seed is None else seed + trial, **how).fit_frame(train, columns, discrete, key)
                synthetic = _pinned(spark, check_columns(model.sample_frame(spark, SYNTHETIC_ROWS), columns), key)
            except Exception as e:  # noqa: BLE001
                rows.append((*labels, "synthesis", "", None, "failed", f"{type(e).__name__}: {e}"[:500]))
                continue
            features = [c for c in columns if c != target]
            parts = {
                "statistical": evaluate_statistical(train, synthetic, columns, key),
                "privacy": evaluate_privacy(train, synthetic, columns, key),
                "ml": evaluate_learning(plain, test, synthetic, features, target, models),
            }
            for part, tasks in parts.items():
                found = measure(tasks, labels)
                kept[part] += found
                rows += found
                if out and part == "statistical":
                    found = measure([("plots", "", lambda: _write_plots(train, synthetic, columns, folder, trial))], labels)
                    rows += [r for r in found if r[7] != "ok"]
                    found = kept[part][-len(tasks) :]
                if out and part != "ml":
                    files.write_json(
                        {f"{r[4]}.{r[5]}".rstrip("."): r[6] for r in found if r[7] == "ok"},
                        folder / f"{part}_metrics_trial_{trial}.json"
                    )
        if out:
            done = {
                p: nested(stats.aggregate_trials(spark.createDataFrame([r for r in v if r[7] == "ok"], METRICS))) if any(r[7] == "ok" for r in v) else {} for p,
                v in kept.items()
            }
            files.write_aggregates(folder, done["statistical"], done["privacy"], done["ml"])
    return spark.createDataFrame(rows, METRICS)


def _pinned(spark: SparkSession, synthetic: DataFrame, key: str) -> DataFrame:
    """The synthetic rows, at most some hundreds, drawn once and numbered."""
    drawn = [(i, *r) for i, r in enumerate(synthetic.collect())]
    schema = f"`{key}` long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in synthetic.schema)
    return spark.createDataFrame(drawn, schema)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Evaluate a synthesizer over budgets and trials.")
    p.add_argument("--synthesizer", choices=["privbayes", "dpctgan"], required=True)
    p.add_argument("--dataset", choices=["adult", "covertype"], required=True)
    p.add_argument("--train-size", type=int, default=1000)
    p.add_argument("--test-size", type=int, default=500)
    p.add_argument("--epsilon", type=lambda s: [float(x) for x in s.split(",")], default=[1.0])
    p.add_argument("--n-trials", type=int, default=3)
    p.add_argument("--data", nargs="+", required=True, help="adult: the training and the test file; covertype: one file")
    p.add_argument("--out", default="results")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    data = files.load_adult(spark, *args.data) if args.dataset == "adult" else files.load_covertype(spark, args.data[0])
    # the files have no key: one from the row's content, and a number among equal rows
    from pyspark.sql import Window

    same = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in data.columns)), 256)
    data = data.withColumn("row_hash", same)
    data = data.withColumn(
        "row_key", F.concat_ws("-", "row_hash", F.row_number().over(Window.partitionBy("row_hash").orderBy("row_hash")))
    ).drop("row_hash")
    target = "income" if args.dataset == "adult" else "Cover_Type"
    found = run(
        spark, data, args.dataset, args.synthesizer, target, "row_key", args.epsilon, args.n_trials, args.train_size,
        args.test_size, args.out
    )
    files.write_metrics(found, str(Path(args.out) / "metrics"))
    found.show(200, truncate=False)


if __name__ == "__main__":
    main()
