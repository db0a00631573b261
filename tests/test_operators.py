"""Small frames with known answers, and the edges of each operator."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.functions import numeric
from veilframe.functions.quantiles import exact_quantiles
from veilframe.functions.ranking import hashed_row_number
from veilframe.operators import bayesnet, binning, clean, ctgan, encode, mixture, mlutil, privacy, sampling, stats
from veilframe.plans import evaluation, recipes
from veilframe.sources import files, plots
from veilframe.sources.tables import adult_schema


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k long, x {kind}")


@pytest.mark.parametrize(
    "values, q, labels",
    [
        (
            [17, 18, 22, 25, 26, 30, 31, 37, 38, 40, 45, 50, 52, 60, 90], 5,
            ["(16.0, 24.0]", "(24.0, 31.0]", "(31.0, 39.0]", "(39.0, 50.0]", "(50.0, 90.0]"]
        ),
        ([40] * 10 + [10, 20, 30, 50, 60], 5, ["(9.0, 38.0]", "(38.0, 40.0]", "(40.0, 60.0]"]),
        ([5, 5, 5, 5], 5, []),
    ],
)
def test_bins(spark, values, q, labels):
    df = column(spark, [float(v) for v in values])
    bins = binning.fit_bins(df, "x", q)
    assert bins.labels() == labels
    got = [r["x"] for r in binning.apply_bins(df, "x", bins).orderBy("k").collect()]
    assert set(got) == (set(labels) if labels else {"nan"})
    if len(labels) == 3:
        assert [got.count(x) for x in labels] == [3, 10, 2]


def test_small_bins_widen_their_labels(spark):
    assert binning.fit_bins(column(spark, [0.12, 0.13, 0.14, 0.15, 0.5, 0.9]), "x", 5).labels()[0] == "(0.11, 0.13]"


def test_bins_of_nulls(spark):
    df = column(spark, [None, 1.0, 2.0, 3.0])
    assert [r["x"] for r in binning.apply_bins(df, "x", binning.fit_bins(df, "x", 2)).orderBy("k").collect()] == ["nan", "(0.0, 2.0]", "(0.0, 2.0]", "(2.0, 3.0]"]
    assert binning.fit_bins(column(spark, [None, None]), "x", 2).labels() == []


def test_quantiles_narrow_down_like_the_direct_way(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.round(rng.lognormal(3, 2, 3000), 2)] + [7.0] * 900 + [None]
    df, wanted = column(spark, values), [0, 0.1, 0.25, 0.5, 0.9, 0.999, 1]
    expected = np.quantile([v for v in values if v is not None], wanted)
    assert np.allclose(exact_quantiles(df, "x", wanted), expected)
    assert np.allclose(exact_quantiles(df, "x", wanted, limit=50), expected)
    assert exact_quantiles(column(spark, [None]), "x", [0.5]) == [None]


def test_hashed_row_numbers_are_a_permutation(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    rows = hashed_row_number(df, 1, "id", "n", "g").collect()
    for g in ("a", "b", None):
        mine = sorted(r["n"] for r in rows if r["g"] == g)
        assert mine == list(range(1, len(mine) + 1))


def test_split_is_exact_by_label(spark):
    df = spark.range(1001).withColumn("y", F.col("id") % 4 == 0)
    counts = {r["y"]: (r["t"], r["n"]) for r in sampling.stratified_split(df, "y", "id", 0.3).groupBy("y").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert counts == {True: (75, 251), False: (225, 750)}
    folds = [r["count"] for r in sampling.kfold(df, "id").groupBy("fold").count().collect()]
    assert max(folds) - min(folds) <= 1 and sum(folds) == 1001


def test_cleaning(spark):
    df = spark.createDataFrame([(" ? ", "a.", "1"), (" x ", " >50K.", "n/a"), (None, None, None)], "a string, b string, c string")
    out = clean.to_numeric(clean.strip_literal(clean.trim_strings(clean.sentinel_to_null(df)), "b"), ["c"]).collect()
    assert [tuple(r) for r in out] == [(None, "a", 1.0), ("x", ">50K", None), (None, None, None)]
    assert clean.infer_roles(spark.range(30).select((F.col("id") % 3).alias("few"), "id", F.lit("t").alias("t"))) == {"few": "categorical", "id": "numeric", "t": "categorical"}


def test_exact_matches_by_name_and_by_place(spark):
    real = spark.createDataFrame([("x", "y")], "a string, b string")
    synthetic = spark.createDataFrame([("y", "x")], "b string, a string")
    assert privacy.exact_matches(real, synthetic, ["a", "b"]).first()["matches"] == 1
    assert privacy.exact_matches(real, synthetic, ["b", "a"], positional=True).first()["matches"] == 0


def test_closest_records_agree_with_all_pairs_in_any_number_of_blocks(spark):
    rng = np.random.default_rng(2)

    def frame(n, nulls):
        return spark.createDataFrame(
            [(i, str(rng.integers(0, 4)), None if nulls and i % 7 == 0 else float(rng.integers(0, 50)), 3.0) for i in range(n)],
            "k long, c string, x double, same double"
        )

    real, synthetic, columns = frame(60, True), frame(80, True), ["c", "x", "same"]
    roles = {"c": "categorical", "x": "numeric", "same": "numeric"}
    best: dict = {}
    for r in privacy.gower_pairs(real, synthetic, columns, "k", "k", roles).collect():
        best[r["synthetic_key"]] = min(best.get(r["synthetic_key"], (9, 9)), (r["distance"], r["real_key"]))
    for block in (1000, 10):
        got = {r["synthetic_key"]: (r["distance"], r["real_key"]) for r in privacy.closest_records(real, synthetic, columns, "k", "k", roles, block).collect()}
        assert got.keys() == best.keys()
        assert all(math.isclose(got[k][0], best[k][0], abs_tol=1e-12) and got[k][1] == best[k][1] for k in best)


def test_correlation_of_a_constant_is_filled(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    m = stats.correlation_matrix(df, ["a", "b"])
    assert {(r["a"], r["b"]): r["r"] for r in m.collect()}[("a", "b")] is None
    assert stats.frobenius(stats.correlation_difference(m, m)).first()["norm"] == 0
    assert {r[0] for r in stats.nan_correlation_columns(m).collect()} == {"a", "b"}  # a has none with b


def test_correlations_equal_those_of_pandas(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 60)
    columns = {
        "x": x,
        "holes": np.where(np.arange(60) % 4 == 0, x, np.nan),
        "other_holes": np.where(np.arange(60) % 3 == 0, rng.normal(0, 1, 60), np.nan),
        "tiny": 5 + 1e-7 * np.arange(60),
        "small": 1e-9 * x,
        "constant": np.full(60, 0.1),
        "constant_where_x": np.where(np.arange(60) % 2 == 0, 7.0, np.nan),
        "never": np.full(60, np.nan),
        "once": np.where(np.arange(60) == 5, 1.0, np.nan),
    }
    frame = pd.DataFrame(columns)
    rows = [tuple(None if np.isnan(v) and k % 2 else float(v) for v in r) for k, r in enumerate(frame.itertuples(index=False))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    m = stats.correlation_matrix(df, list(columns))
    expected = frame.corr()
    for r in m.collect():
        want = expected.loc[r["a"], r["b"]]
        assert (r["r"] is None) == bool(np.isnan(want)), (r, want)
        assert r["r"] is None or abs(r["r"] - want) < 1e-7, (r, want)
    missing = expected.columns[expected.isna().any()].tolist()
    assert sorted(r[0] for r in stats.nan_correlation_columns(m).collect()) == sorted(missing)


def test_noise_of_published_tables_is_in_no_plan(spark):
    df = spark.createDataFrame([("x", "p")] * 30 + [("y", "q")] * 20, "a string, b string")
    cells = stats.value_counts(df, "a")
    drawn = bayesnet.entropy_noise("a", cells, F.col("value"), 2.0)
    plan = drawn._jdf.queryExecution().toString().lower()
    assert "uuid" not in plan and "rand" not in plan
    assert [tuple(r) for r in drawn.collect()] == [tuple(r) for r in drawn.collect()]
    values = [bayesnet.entropy_laplace(2.0) for _ in range(4000)]
    assert abs(np.mean(np.abs(values)) - 2.0) < 0.3 and abs(np.median(values)) < 0.3 and len(set(values)) == 4000
    tables = bayesnet.PrivBayes(0.5).fit(df, ["a", "b"]).tables
    assert tables.count() == 2 + 4 and "uuid" not in tables._jdf.queryExecution().toString().lower()


def test_draws_from_very_many_values(spark):
    rows = spark.range(3000).select(F.col("id").alias("row"))
    shares = spark.createDataFrame([(f"v{k:05d}", 1.0 if k else 20000.0) for k in range(20000)], "value string, w double")
    intervals = sampling.cumulative(shares, "value", "w")
    drawn = sampling.categorical_draw(rows, (F.col("row") + 0.5) / 3000, intervals, "value", "drawn").collect()
    assert len(drawn) == 3000 and abs(sum(r["drawn"] == "v00000" for r in drawn) - 1500) < 3


def test_one_hot_of_an_unknown_value(spark):
    known = encode.categories(spark.createDataFrame([("a",), ("b",), ("c",)], "v string"), "v")
    rows = encode.one_hot(spark.createDataFrame([("a",), ("zz",), (None,)], "v string"), "v", known).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_tree_and_budgets():
    weights = {("a", "b"): 0.9, ("a", "c"): 0.8, ("b", "c"): 0.1, ("a", "d"): 0.2, ("b", "d"): 0.3, ("c", "d"): 0.0}
    edges = bayesnet.spanning_tree(["a", "b", "c", "d"], weights)
    tree = bayesnet.orient(["a", "b", "c", "d"], edges, weights)
    assert tree.order == ("a", "b", "c", "d") and tree.parent == {"a": None, "b": "a", "c": "a", "d": "b"}
    assert bayesnet.node_budgets(tree, 1.0) == {"a": 0.5, "b": 1 / 6, "c": 1 / 6, "d": 1 / 6}
    assert bayesnet.node_budgets(bayesnet.orient(["a"], []), 2.0) == {"a": 2.0}


def test_private_tables_are_distributions(spark):
    df = spark.createDataFrame([("x", "p")] * 30 + [("y", "q")] * 20 + [("x", "q"), (None, "p")], "a string, b string")
    model = bayesnet.PrivBayes(0.01, seed=3).fit(df, ["a", "b"])
    totals = model.tables.groupBy("node", "parent_value").agg(
        F.sum("prob").alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).collect()
    assert all(math.isclose(r["p"], 1) and r["lo"] == 0 and r["hi"] == 1 for r in totals)
    out = model.sample(200)
    assert out.columns == ["a", "b"] and out.count() == 200
    assert bayesnet.PrivBayes(5.0).fit(df, ["a", "b"]).sample(50).count() == 50


def test_accountant():
    spent = [ctgan.epsilon_spent(0.01, s, 1000, 1e-5) for s in (0.7, 1.0, 2.0)]
    assert spent[0] > spent[1] > spent[2] > 0
    assert ctgan.epsilon_spent(0.01, 1.0, 2000, 1e-5) > spent[1]
    sigma = ctgan.noise_for(1.0, 1e-5, 0.05, 200)
    assert ctgan.epsilon_spent(0.05, sigma, 200, 1e-5) <= 1.0 < ctgan.epsilon_spent(0.05, sigma * 0.98, 200, 1e-5)


def test_clipped_gradients_are_those_of_single_packs():
    rng = np.random.default_rng(0)
    critic, x = ctgan.Critic(rng, 12), rng.normal(size=(5, 12))
    critic.forward(x, drop=False)
    total, _ = critic.backward(np.ones(5), clip=0.05)
    by_hand = {k: np.zeros_like(v) for k, v in critic.weights.items()}
    for i in range(5):
        critic.forward(x[i : i + 1], drop=False)
        one, _ = critic.backward(np.ones(1))
        norm = math.sqrt(sum((g * g).sum() for g in one.values()))
        for k, g in one.items():
            by_hand[k] += g * min(1, 0.05 / norm)
    assert all(np.allclose(total[k], by_hand[k]) for k in total)


def test_generator_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    g, x, goal = ctgan.Generator(rng, 4, 3), rng.normal(size=(8, 4)), rng.normal(size=(8, 3))
    grads = (g.forward(x), g.backward(goal))[1]
    for name in ("w0", "g1", "b2"):
        at, old = (0,) * g.weights[name].ndim, g.weights[name][(0,) * g.weights[name].ndim]
        values = []
        for step in (1e-5, -1e-5):
            g.weights[name][at] = old + step
            values.append((g.forward(x) * goal).sum())
        g.weights[name][at] = old
        assert math.isclose((values[0] - values[1]) / 2e-5, grads[name][at], rel_tol=1e-3, abs_tol=1e-6)


def test_mixture_finds_two_modes():
    rng = np.random.default_rng(4)
    w, m, s = mixture.fit_mixture(np.concatenate([rng.normal(0, 1, 600), rng.normal(20, 2, 400)]), 5)
    assert abs(sum(w) - 1) < 1e-9 and min(s) > 0
    assert min(abs(x) for x in m) < 1 and min(abs(x - 20) for x in m) < 1.5
    assert mixture.fit_mixture(np.array([3.0, 3.0]), 4) == ([1.0], [3.0], [1e-6])


def test_generator_round_trip(spark, tmp_path):
    df = spark.range(400).select(
        "id", (F.col("id") % 2).cast("string").alias("c"), (F.col("id") * 0.5).alias("x"),
        F.when(F.col("id") < 0, 1.0).alias("empty")
    )
    model = ctgan.CTGAN(epsilon=5.0, epochs=2, batch=100, seed=3).fit(df, ["c", "x", "empty"], "id", ["c"])
    assert [s.name for s in model.transformer.specs] == ["c", "x"]
    spent = [h["epsilon"] for h in model.history]
    assert spent[0] < spent[1] <= 5.0
    model.save(tmp_path / "m")
    again = ctgan.CTGAN.load(tmp_path / "m")
    a, b = (sorted(map(tuple, m.sample(spark, 60, seed=1).collect())) for m in (model, again))
    assert len(a) == 60 and a == b and {r[0] for r in a} <= {"0", "1"}
    assert model.training_curve(spark).count() == 2 and "trained=True" in repr(again)


def test_learning(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("c"),
        F.when(F.col("id") % 10 < 5, "lo").otherwise("hi").alias("y")
    )
    found = {r["model"]: r["accuracy"] for r in mlutil.evaluate(df, df, ["x", "c"], "y", mlutil.MODELS[:2], trees=5, depth=4).collect()}
    assert min(found.values()) > 0.9
    with pytest.raises(ValueError):
        mlutil.evaluate(df, df.drop("y"), ["x"], "y")
    with pytest.raises(ValueError):
        mlutil.feature_stages(df, [], {})


def test_retention_without_baseline(spark):
    a = spark.createDataFrame([("m", 0.0), ("n", 0.8), ("o", 0.5)], "model string, accuracy double")
    b = spark.createDataFrame([("m", 0.5), ("n", 0.4)], "model string, accuracy double")
    assert {r["model"]: r["retention"] for r in mlutil.retention(a, b).collect()} == {"m": None, "n": 50.0}


ADULT = "39, Private, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K\n50, ?, 83311, Bachelors, 13, Married, ?, Husband, White, Male, 0, 0, 13, ?, >50K\n"


def test_adult_files(spark, tmp_path):
    (tmp_path / "train").write_text(ADULT)
    (tmp_path / "test").write_text("|1x3 Cross validator\n" + ADULT.replace("K\n", "K.\n"))
    df = files.load_adult(spark, str(tmp_path / "train"), str(tmp_path / "test"))
    assert df.count() == 4 and df.schema["age"].dataType == adult_schema()["age"].dataType
    assert {r["income"] for r in df.collect()} == {"<=50K", ">50K"} and df.where("occupation is null").count() == 2
    out, meta = recipes.preprocess(df, "Adult", "PrivBayes")
    assert meta.all_categorical and "education-num" not in out.columns and out.where("workclass = 'Unknown'").count() == 2
    with pytest.raises(FileNotFoundError):
        files.scan_csv(spark, str(tmp_path / "none"), adult_schema())
    with pytest.raises(ValueError):
        recipes.preprocess(df, "adult", "other")
    assert recipes.describe("covertype", "dpctgan")["numeric"][0] == "Elevation"
    files.write_csv(out, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4


def test_gzip_scan(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write(ADULT)
    assert files.scan_csv(spark, str(tmp_path / "a.csv.gz"), adult_schema()).count() == 2


def test_tables_are_fetched_once(spark, tmp_path):
    import gzip

    from veilframe.sources.tables import COVERTYPE_COLUMNS

    (tmp_path / "adult.data").write_text(ADULT)
    (tmp_path / "adult.test").write_text("|1x3 Cross validator\n" + ADULT.replace("K\n", "K.\n"))
    with gzip.open(tmp_path / "covtype.data.gz", "wt") as f:
        f.write(",".join(str(i) for i in range(len(COVERTYPE_COLUMNS))) + "\n")
    urls = [(tmp_path / n).as_uri() for n in ("adult.data", "adult.test", "covtype.data.gz")]
    assert files.fetch_adult(spark, tmp_path / "local", tuple(urls[:2])).count() == 4
    assert files.fetch_covertype(spark, tmp_path / "local", urls[2]).first()["Slope"] == 2
    (tmp_path / "adult.data").unlink()
    assert files.fetch(urls[0], tmp_path / "local" / "adult.data") == str(tmp_path / "local" / "adult.data")
    with pytest.raises(OSError):
        files.fetch(urls[0], tmp_path / "other" / "adult.data")
    assert not list((tmp_path / "other").iterdir())


def test_plots_of_awkward_values(spark, tmp_path):
    import xml.dom.minidom as xml

    rows = [("a", f"<v{k}> & \u00e9", 0.01, 0.02) for k in range(60)] + [("b", "x", 1.0, 0.0)]
    plots.marginal_bars(
        spark.createDataFrame(rows, "column_name string, value string, real_share double, synthetic_share double"),
        tmp_path / "bars.svg"
    )
    cells = spark.createDataFrame([("p", "q", 0.5), ("q", "p", None), ("p", "p", 0.0)], "a string, b string, difference double")
    plots.matrix_cells(cells, "difference", tmp_path / "deep" / "matrix.svg")
    plots.matrix_cells(cells.limit(0), "difference", tmp_path / "empty.svg")
    drawn = {p.name: len(xml.parse(str(p)).getElementsByTagName("rect")) for p in tmp_path.rglob("*.svg")}
    assert drawn == {"bars.svg": 2 * plots.MAX_BARS + 2 + 2, "matrix.svg": 2, "empty.svg": 0}


def test_command_line(spark, tmp_path, monkeypatch):
    import functools

    body = "".join(ADULT.splitlines(keepends=True)[k % 2].replace("39", str(20 + k), 1) for k in range(60))
    (tmp_path / "train").write_text(body)
    (tmp_path / "test").write_text("|1x3 Cross validator\n" + body.replace("K\n", "K.\n"))
    monkeypatch.setattr(evaluation, "run", functools.partial(evaluation.run, models=mlutil.MODELS[:1]))
    out = tmp_path / "out"
    evaluation.main([
        "--synthesizer", "privbayes", "--dataset", "adult", "--epsilon", "1", "--n-trials", "1", "--train-size", "40",
        "--test-size", "20", "--data", str(tmp_path / "train"), str(tmp_path / "test"), "--out", str(out)
    ])
    kept = spark.read.parquet(str(out / "metrics"))
    assert kept.where("status = 'ok'").count() >= 8 and kept.where("metric = 'plots'").count() == 0
    folder = out / "adult_privbayes_eps_1.0"
    assert {p.name for p in folder.iterdir()} >= {
        "marginal_distributions_trial_1.svg", "correlation_difference_trial_1.svg", "marginal_distributions_trial_1"
    }
    shares = spark.read.csv(str(folder / "marginal_distributions_trial_1"), header=True)
    assert shares.select("column_name").distinct().count() == evaluation.MARGINAL_COLUMNS
    with pytest.raises(SystemExit):
        evaluation.main(["--synthesizer", "none"])


def test_evaluation_end_to_end(spark, tmp_path):
    df = spark.range(240).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") % 3 == 0, " a ").otherwise("b").alias("segment"), F.concat((F.col("id") % 2).cast("string"), F.lit(".")).alias("priority"),
        F.col("id").cast("string").alias("price_text"), F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("balance"), F.lit("x").alias("known_segment"), (F.col("id") % 4).alias("c_nationkey"),
    )
    found = evaluation.run(
        spark, df, "people", "privbayes", "priority", "o_orderkey", [1.0], 1, 120, 60, str(tmp_path), models=mlutil.MODELS[:1]
    )
    rows = found.collect()
    assert not [r for r in rows if r["status"] != "ok"], rows
    assert {r["trial"] for r in rows} == {1}
    folder = tmp_path / "people_privbayes_eps_1.0"
    assert {p.name for p in folder.iterdir()} >= {
        "aggregated_statistical_metrics.json", "aggregated_privacy_metrics.json", "aggregated_ml_metrics.json",
        "privacy_metrics_trial_1.json"
    }
    assert evaluation.parser().parse_args([
        "--synthesizer", "privbayes", "--dataset", "adult", "--epsilon", "0.5,1", "--data", "a", "b"
    ]).epsilon == [0.5, 1.0]


def test_a_failing_metric_is_recorded(spark):
    rows = evaluation.measure([("m", "", lambda: 1 / 0), ("n", "", lambda: 2)], ("d", "s", 1.0, 1))
    assert [(r[4], r[7]) for r in rows] == [("m", "failed"), ("n", "ok")]
    with pytest.raises(ValueError):
        evaluation.check_columns(spark.range(1), ["a"])
    with pytest.raises(ValueError):
        evaluation.synthesizer("none", 1.0)
    assert evaluation.nested(stats.aggregate_trials(spark.createDataFrame([], "metric string, submetric string, value double"))) == {}


def test_generator_and_mixtures_read_all_rows(spark, monkeypatch):
    n = 60_000
    rare = F.xxhash64("id") % 200 == 0
    df = spark.range(n).select(
        "id", F.when(F.col("id") == n - 1, "once").otherwise("often").alias("c"), F.when(rare, 1000.0).otherwise(0.0).alias("far"),
        (F.col("id") % 7919 * 0.25).alias("x")
    )
    seen, step = [], ctgan.minibatches
    monkeypatch.setattr(ctgan, "minibatches", lambda blocks, batch: step((seen.append(b.sum(0)) or b for b in blocks), batch))
    model = ctgan.CTGAN(epsilon=None, epochs=1, batch=10_000, seed=3).fit(df, ["c", "far", "x"], "id", ["c"])
    assert sum(seen)[:2].tolist() == [n - 1, 1]
    assert np.allclose(model.sampler.shares[0], mixture.log_frequencies(np.array([n - 1, 1])))
    values = np.arange(n) % 7919 * 0.25
    for got, wanted in zip(
        (model.transformer.specs[2].weights, model.transformer.specs[2].means, model.transformer.specs[2].deviations),
        mixture.fit_mixture(values, 10)
    ):
        assert np.allclose(got, wanted, rtol=1e-6)


def test_compact_rows_expand_to_slots(spark):
    df = spark.range(300).select(
        "id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("c"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("x")
    )
    t = mixture.ColumnTransformer.fit(df, ["c", "x"], ["c"], "id")
    wanted = np.array([r["x"] for r in df.orderBy("id").select(t.forward(F.col("id"), 3).alias("x")).collect()])
    assert np.allclose(t.expand(np.array([r["__x"] for r in t.compact(df, "id", 3).orderBy("id").collect()])), wanted)


def test_registered_generator_trains_with_the_defaults(spark, monkeypatch):
    from veilframe.plans import queries

    made = []
    monkeypatch.setattr(ctgan.CTGAN, "fit", lambda self, *a: made.append(self) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        queries.QUERIES["ctgan_sample"](spark, "/root/testdata/sf0.001")
    defaults = ctgan.CTGAN()
    assert (made[0].epochs, made[0].batch, made[0].train_rows) == (defaults.epochs, defaults.batch, None)


def test_recipes_are_fitted_on_the_whole_split(spark, monkeypatch):
    df = spark.range(300).select(
        F.col("id").alias("o_orderkey"), F.lit("s").alias("segment"), (F.col("id") % 2).cast("string").alias("priority"), (F.col("id") * F.col("id")).cast("string").alias("price_text"),
        F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("balance"), F.lit("x").alias("known_segment"), F.lit(1).alias("c_nationkey"),
    )
    seen = {}

    class Fake:
        def fit_frame(self, train, *how):
            seen["train"] = train.collect()
            return self

        def sample_frame(self, spark, n):
            return spark.createDataFrame(seen["train"]).drop("o_orderkey")

    monkeypatch.setattr(evaluation, "synthesizer", lambda *a, **k: Fake())
    monkeypatch.setattr(
        evaluation, "evaluate_learning", lambda plain, test, *a: seen.update(plain=plain.collect(), test=test.collect()) or []
    )
    monkeypatch.setattr(evaluation, "evaluate_statistical", lambda *a: [])
    monkeypatch.setattr(evaluation, "evaluate_privacy", lambda *a: [("m", "", lambda: 1.0)])
    evaluation.run(spark, df, "people", "privbayes", "priority", "o_orderkey", [1.0], 1, 40, 20)
    split = sampling.stratified_split(df, "priority", "o_orderkey", 0.3, 42)
    whole, rest = split.where("is_test = 0").drop("is_test"), split.where("is_test = 1").drop("is_test")
    for name, frame, fitted, recipe, n in (
        ("train", whole, None, "privbayes", 40), ("plain", whole, None, "standard", 40), ("test", rest, whole, "standard", 20)
    ):
        wanted = {r["o_orderkey"]: r for r in recipes.preprocess(frame, "people", recipe, fitted)[0].collect()}
        assert len(seen[name]) == n and all(r == wanted[r["o_orderkey"]] for r in seen[name])
    assert [r["o_orderkey"] for r in seen["train"]] == [r["o_orderkey"] for r in seen["plain"]]


def test_the_full_matrix_is_dealt_out_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(privacy, "TASK_PAIRS", 500)
    real = spark.range(100, numPartitions=1).select(F.col("id").alias("k"), (F.col("id") * 0.37).alias("x"))
    for n in (30, 300):  # either side may be the longer one
        synthetic = spark.range(n, numPartitions=1).select(F.col("id").alias("k"), (F.col("id") * 0.11).alias("x"))
        pairs = privacy.gower_pairs(real, synthetic, ["x"], "k", "k", {"x": "numeric"})
        assert pairs.rdd.getNumPartitions() >= 100 * n // 500
        assert pairs.select("synthetic_key", "real_key").distinct().count() == 100 * n
    assert privacy.gower_pairs(real.limit(0), real, ["x"], "k", "k", {"x": "numeric"}).count() == 0


def test_quick_rounding_is_rounding(spark):
    edges = [0.0, -0.0, 0.1234565, 0.1234575, -0.1234565, 2.5e-7, 5e-7, 1.0000005, 123456.7890125, 1e9 + 0.1234565, 1e300, -4e-7, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(x,) for x in edges], "x double").union(spark.range(20_000).select(F.rand(3) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)))
    df = df.union(spark.range(20_000).select((F.col("id") * 2 + 1) / F.lit(2e6)))  # halves of the last digit
    differ = df.where(~numeric.quick_round(F.col("x")).eqNullSafe(F.round("x", 6)))
    assert differ.count() == 0


def test_learners_read_rows_in_a_part_for_each_core(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(240, numPartitions=1).select(
        (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 < 5, "lo").otherwise("hi").alias("y")
    )
    parts, plain = [], mlutil.classifier

    def watched(*how, **more):
        model = plain(*how, **more)
        fit = model.fit
        model.fit = lambda rows: parts.append((rows.rdd.getNumPartitions(), rows.count())) or fit(rows)
        return model

    monkeypatch.setattr(mlutil, "classifier", watched)
    found = mlutil.evaluate(df, df, ["x"], "y", mlutil.MODELS[:2], trees=3, depth=3).collect()
    assert parts == [(cores, 240)] * 2 and [r["model"] for r in found] == list(mlutil.MODELS[:2])
    monkeypatch.setattr(mlutil, "PART_ROWS", 10)
    assert mlutil.spread(df).rdd.getNumPartitions() == 24
