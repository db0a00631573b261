"""Every operator as a registered query over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.determinism import uniform
from ..functions.numeric import clip, gaussian_pdf, laplace, quick_round
from ..functions.quantiles import exact_quantiles
from ..operators import bayesnet, binning, clean, ctgan, encode, mixture, mlutil, privacy, sampling, stats
from ..sources import files
from ..sources.files import parse_csv
from . import fixtures as fx
from . import recipes

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(
        r6(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c,
        t in df.dtypes
    ))


# sources and cleaning


@query
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    return parse_csv(_csv_lines(spark, sf), "line", _CSV_SCHEMA)


@query
def scan_csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines through files: compressed, with a comment line in front."""
    path = fx.scratch(spark, "lines")
    head = spark.createDataFrame([("|1x3 a comment",)], "line string")
    head.union(_csv_lines(spark, sf)).write.text(path, compression="gzip")
    return files.scan_csv(spark, path, _CSV_SCHEMA, comment="|")


def _csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fx.people(spark, sf).select(F.concat_ws(
        ",", F.col("o_orderkey").cast("string"),
        F.concat(F.lit(" "), F.when(F.col("c_mktsegment") == "MACHINERY", "?").otherwise(F.col("c_mktsegment"))),
        F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))
    ).alias("line"))


_CSV_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("priority", T.StringType())
])


@query
def clean_sentinel(spark, sf):
    return clean.sentinel_to_null(fx.messy(spark, sf).select("o_orderkey", "segment"), "?", ["segment"])


@query
def clean_trim(spark, sf):
    return clean.trim_strings(fx.messy(spark, sf).select("o_orderkey", "segment", "priority"))


@query
def fill_constant(spark, sf):
    return clean.fill_constant(fx.messy(spark, sf).select("o_orderkey", "known_segment"), {"known_segment": "Unknown"})


@query
def drop_column(spark, sf):
    return clean.drop_columns(fx.people(spark, sf), "c_acctbal", "o_totalprice")


@query
def cast_string(spark, sf):
    return clean.cast_columns(
        fx.people(spark, sf).select("o_orderkey", "c_nationkey", F.floor("o_totalprice").cast("long").alias("price")),
        {"c_nationkey": "string", "price": "string"}
    )


@query
def cast_numeric(spark, sf):
    text = fx.people(spark, sf).select(
        "o_orderkey", F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_nationkey").cast("string").alias("nation_number")
    )
    return clean.cast_columns(text, {"nation": "bigint", "nation_number": "double"})


@query
def to_numeric(spark, sf):
    return clean.to_numeric(fx.messy(spark, sf).select("o_orderkey", "price_text"), ["price_text"])


@query
def impute_median(spark, sf):
    return rounded(clean.impute_median(fx.messy(spark, sf).select("o_orderkey", "balance"), ["balance"]))


@query
def impute_median_cross(spark, sf):
    real = fx.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"))
    return rounded(clean.impute_median(fx.messy(spark, sf).select("o_orderkey", "balance"), ["balance"], real))


@query
def impute_mean(spark, sf):
    return rounded(clean.impute_mean(fx.messy(spark, sf).select("o_orderkey", "balance"), ["balance"]))


@query
def strip_literal(spark, sf):
    return clean.strip_literal(fx.messy(spark, sf).select("o_orderkey", "priority"), "priority", ".")


@query
def drop_nulls(spark, sf):
    return clean.drop_nulls(fx.messy(spark, sf).select("o_orderkey", "known_segment", "balance"), ["known_segment", "balance"])


@query
def infer_roles(spark, sf):
    df = fx.people(spark, sf).select(*fx.PEOPLE)
    rules = {
        name: clean.infer_roles(df, limit) for name,
        limit in (("by_type", 0), ("at_10", clean.SYNTHESIS_LIMIT), ("at_20", clean.COMPARE_LIMIT))
    }
    return spark.createDataFrame(
        [(c, *(rules[r][c] for r in rules)) for c in fx.PEOPLE], "column_name string, by_type string, at_10 string, at_20 string"
    )


@query
def project(spark, sf):
    return fx.people(spark, sf).select("c_mktsegment", "o_orderkey", "o_orderstatus")


@query
def harmonise(spark, sf):
    columns = ["balance", "segment", "c_nationkey"]
    real = fx.messy(spark, sf).select("o_orderkey", "balance", F.col("known_segment").alias("segment"), "c_nationkey")
    synthetic = fx.mirrored(spark, sf).select(
        "o_orderkey", F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("balance"),
        F.col("c_mktsegment").alias("segment"), "c_nationkey"
    )
    left, right, _ = clean.harmonise(real, synthetic, columns)
    return rounded(sampling.union_tagged(left, right))


# discretisation


@query
def qcut_bins(spark, sf):
    df = fx.people(spark, sf)
    bins = binning.fit_bins(df, "o_totalprice", 5)
    return df.select("o_orderkey", bins.index(F.col("o_totalprice")).cast("long").alias("bin"))


@query
def qcut_labels(spark, sf):
    df = fx.people(spark, sf)
    return binning.apply_bins(
        df.select("o_orderkey", "o_totalprice"), "o_totalprice", binning.fit_bins(df, "o_totalprice", 10), "label"
    ).select("o_orderkey", "label")


@query
def zero_inflated_bin(spark, sf):
    df = fx.people(spark, sf).select("o_orderkey", F.greatest(F.col("o_totalprice") - 400000, F.lit(0.0)).alias("excess"))
    return binning.zero_inflated(df, "excess", binning.high_threshold(df, "excess"), "level").select("o_orderkey", "level")


@query
def topk_group(spark, sf):
    df = fx.people(spark, sf).select("o_orderkey", "c_nationkey")
    return binning.group_rest(df, "c_nationkey", binning.frequent_values(df, "c_nationkey", 5))


@query
def topk_values(spark, sf):
    df = fx.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return df.orderBy(F.desc("n"), "l_suppkey").limit(10)


# encodings


@query
def category_codes(spark, sf):
    return rounded(encode.category_codes(
        [
            fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")),
            fx.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"))
        ],
        "n"
    ))


@query
def label_encode(spark, sf):
    codes = encode.category_codes([fx.people(spark, sf)], "o_orderpriority")
    return rounded(encode.encode(fx.mirrored(spark, sf).select("o_orderkey", "o_orderpriority"), "o_orderpriority", codes, "code"))


@query
def one_hot(spark, sf):
    df = fx.people(spark, sf).select("o_orderkey", "o_orderstatus")
    return rounded(encode.one_hot(df, "o_orderstatus", encode.categories(df, "o_orderstatus")))


@query
def one_hot_unknown(spark, sf):
    known = encode.categories(fx.messy(spark, sf), "known_segment")
    return rounded(encode.one_hot(fx.people(spark, sf).select("o_orderkey", F.col("c_mktsegment").alias("segment")), "segment", known))


@query
def freq_one_hot(spark, sf):
    df = fx.people(spark, sf).select("o_orderkey", "o_orderpriority")
    values = encode.categories(df, "o_orderpriority", by_frequency=True)
    return df.select("o_orderkey", *(i.cast("long").alias(f"slot_{k}") for k, i in enumerate(encode.indicators("o_orderpriority", values))))


@query
def standard_scale(spark, sf):
    df = fx.people(spark, sf).select("o_orderkey", "o_totalprice", "c_acctbal")
    return rounded(encode.standard_scale(df, encode.scale_parameters(df, ["o_totalprice", "c_acctbal"])))


def _balance(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("x"), uniform("mode", F.col("c_custkey")).alias("u")
    )


@query
def mode_posterior(spark, sf):
    p = encode.mode_posterior(F.col("x"), fx.MODES["weights"], fx.MODES["means"], fx.MODES["deviations"])
    return _balance(spark, sf).withColumn("p", p).select("c_custkey", *(r6(F.col("p")[i]).alias(f"p{i}") for i in range(3)))


def _drawn(spark, sf) -> DataFrame:
    p = encode.mode_posterior(F.col("x"), fx.MODES["weights"], fx.MODES["means"], fx.MODES["deviations"])
    return _balance(spark, sf).withColumn("mode", encode.draw_slot(p, F.col("u"), 3))


@query
def mode_draw(spark, sf):
    return _drawn(spark, sf).select("c_custkey", F.col("mode").cast("long").alias("mode"))


@query
def mode_normalise(spark, sf):
    return _drawn(spark, sf).select(
        "c_custkey", r6(encode.mode_normalise(F.col("x"), F.col("mode"), fx.MODES["means"], fx.MODES["deviations"])).alias("scalar")
    )


@query
def mode_denormalise(spark, sf):
    df = _balance(spark, sf).withColumn("mode", F.pmod("c_custkey", F.lit(3)).cast("int"))
    return df.select(
        "c_custkey",
        r6(encode.mode_denormalise(F.col("u") * 2 - 1, F.col("mode"), fx.MODES["means"], fx.MODES["deviations"])).alias("x")
    )


@query
def argmax_slot(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", encode.argmax_slot(F.col("embedding")).cast("long").alias("slot"))


@query
def filter_components(spark, sf):
    kept = F.filter("embedding", lambda x: x > 0.01)
    return fx.table(spark, sf, "embeddings").select(
        "vec_id", F.size(kept).cast("long").alias("n_kept"), r6(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)).alias("total")
    )


def _transformer(df: DataFrame) -> mixture.ColumnTransformer:
    return mixture.ColumnTransformer([
        mixture.Continuous("c_acctbal", *(tuple(fx.MODES[k]) for k in ("weights", "means", "deviations"))),
        mixture.Discrete("c_mktsegment", tuple(encode.categories(df, "c_mktsegment", by_frequency=True)))
    ])


@query
def ctgan_transform(spark, sf):
    df = fx.table(spark, sf, "customer")
    t = _transformer(df)
    slots = df.select("c_custkey", t.forward(F.col("c_custkey"), 7).alias("s"))
    return slots.select("c_custkey", *(r6(F.col("s")[i]).alias(f"s{i}") for i in range(t.width)))


@query
def ctgan_inverse(spark, sf):
    df = fx.table(spark, sf, "customer")
    t = _transformer(df)
    back = df.select("c_custkey", t.forward(F.col("c_custkey"), 7).alias("s")).select("c_custkey", *t.inverse(F.col("s")))
    return rounded(back)


# expressions


@query
def clip_range(spark, sf):
    return fx.people(spark, sf).select(
        "o_orderkey", clip(F.col("c_acctbal"), 0.0).alias("low"), clip(F.col("c_acctbal"), -1.0, 1.0).alias("unit")
    )


@query
def gaussian_density(spark, sf):
    return fx.people(spark, sf).select("o_orderkey", r6(gaussian_pdf(F.col("c_acctbal") / 1000, 4.5, 2.5)).alias("density"))


@query
def union_tagged(spark, sf):
    real, synthetic = fx.holders(spark, sf)
    return rounded(sampling.union_tagged(real, synthetic))


# counts and statistics


@query
def value_counts(spark, sf):
    return stats.value_counts(fx.messy(spark, sf), "known_segment")


@query
def value_shares(spark, sf):
    return rounded(stats.value_shares(fx.messy(spark, sf), "known_segment"))


@query
def marginals_categorical(spark, sf):
    return rounded(stats.marginals(
        fx.messy(spark, sf).withColumnRenamed("known_segment", "s"), fx.mirrored(spark, sf).withColumnRenamed("c_mktsegment", "s"),
        "s"
    ))


@query
def distinct_counts(spark, sf):
    return stats.distinct_count_table(
        fx.messy(spark, sf).select("known_segment", "price_text", "c_nationkey", "balance"),
        ["known_segment", "price_text", "c_nationkey", "balance"]
    )


@query
def constant_columns(spark, sf):
    df = fx.people(spark, sf).select("o_orderstatus", F.lit(5).alias("five"), F.when(F.col("o_totalprice") < 0, 1).alias("never"))
    return stats.constant_columns(df, df.columns)


@query
def frame_summary(spark, sf):
    return rounded(stats.frame_summary(fx.messy(spark, sf)))


@query
def missing_counts(spark, sf):
    return stats.missing_counts(fx.messy(spark, sf), ["known_segment", "balance", "priority"])


def _coded(df: DataFrame) -> DataFrame:
    """Categories as codes over a fixed order, so that both frames agree; one of them is missing, and negative balances are."""
    rank = {"o_orderstatus": ["F", "O", "P"], "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]}
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal")
    return df.select(
        "o_totalprice", balance, "c_nationkey",
        *((F.nullif(F.array_position(F.array(*map(F.lit, v)), F.col(c)), F.lit(0)) - 1).alias(c) for c, v in rank.items()),
        F.lit(1.0).alias("always")
    )


_NUMBERS = ["o_totalprice", "c_acctbal", "c_nationkey", "o_orderstatus", "c_mktsegment", "always"]


@query
def correlation_matrix(spark, sf):
    return rounded(stats.correlation_matrix(_coded(fx.people(spark, sf)), _NUMBERS))


@query
def nan_correlation_columns(spark, sf):
    return stats.nan_correlation_columns(stats.correlation_matrix(_coded(fx.people(spark, sf)), _NUMBERS))


def _differences(spark, sf):
    return stats.correlation_difference(*(stats.correlation_matrix(_coded(f(spark, sf)), _NUMBERS) for f in (fx.people, fx.mirrored)))


@query
def correlation_difference(spark, sf):
    return rounded(_differences(spark, sf))


@query
def correlation_norm(spark, sf):
    return rounded(stats.frobenius(_differences(spark, sf)))


@query
def contingency(spark, sf):
    return stats.contingency(fx.items(spark, sf), "l_returnflag", "l_linenumber")


@query
def contingency_pivot(spark, sf):
    return rounded(stats.contingency_pivot(fx.items(spark, sf), "l_linenumber", "l_returnflag", ["A", "N", "R"]))


@query
def mutual_information(spark, sf):
    return rounded(stats.mutual_information(fx.items(spark, sf), fx.ITEMS))


@query
def quantiles(spark, sf):
    return rounded(stats.quantile_table(fx.people(spark, sf), "o_totalprice", [0.0, 0.2, 0.25, 0.4, 0.5, 0.6, 0.75, 0.8, 0.9, 1.0]))


@query
def median(spark, sf):
    found = exact_quantiles(fx.messy(spark, sf), "balance", [0.5])[0]
    return rounded(spark.createDataFrame([(found,)], "median double"))


@query
def box_stats(spark, sf):
    return rounded(stats.box_stats(fx.people(spark, sf), "o_totalprice"))


@query
def kde_curve(spark, sf):
    curve = stats.kde_curve(fx.table(spark, sf, "customer"), "c_acctbal")
    return curve.select(r6("x").alias("x"), r6(F.col("density") * 1000).alias("density_per_1000"))


@query
def log_frequency(spark, sf):
    return rounded(stats.log_frequency(fx.people(spark, sf), "c_mktsegment"))


@query
def aggregate_trials(spark, sf):
    return rounded(stats.aggregate_trials(fx.items(spark, sf).select(
        F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("submetric"), F.col("l_tax").alias("value")
    )))


@query
def tree_degrees(spark, sf):
    return rounded(stats.tree_degrees(spark.createDataFrame(fx.EDGES, "a string, b string")))


# sampling


@query
def stratified_split(spark, sf):
    df = fx.people(spark, sf).select("o_orderkey", "o_orderstatus")
    return rounded(sampling.stratified_split(df, "o_orderstatus", "o_orderkey"))


@query
def seeded_sample(spark, sf):
    return sampling.seeded_sample(fx.people(spark, sf), "o_orderkey", fx.SAMPLE_ROWS).select("o_orderkey")


@query
def aligned_sample(spark, sf):
    keys = sampling.seeded_sample(fx.people(spark, sf).select("o_orderkey"), "o_orderkey", fx.SAMPLE_ROWS)
    versions = [
        fx.people(spark, sf).select("o_orderkey", "c_mktsegment"),
        fx.mirrored(spark, sf).select("o_orderkey", F.col("c_mktsegment").alias("other_segment"))
    ]
    return versions[0].join(keys, "o_orderkey", "left_semi").join(versions[1].join(keys, "o_orderkey", "left_semi"), "o_orderkey")


@query
def kfold_assign(spark, sf):
    return rounded(sampling.kfold(fx.people(spark, sf).select("o_orderkey"), "o_orderkey"))


@query
def categorical_draw(spark, sf):
    shares = sampling.cumulative(stats.value_shares(fx.people(spark, sf), "c_mktsegment"), "value", "share")
    rows = fx.table(spark, sf, "orders").select("o_orderkey")
    return sampling.categorical_draw(rows, uniform(42, F.col("o_orderkey")), shares, "value", "drawn")


# privacy


@query
def gower_pairs(spark, sf):
    real, synthetic = fx.holders(spark, sf)
    pairs = privacy.gower_pairs(
        real, synthetic, ["nation", "balance"], "key", "key", {"nation": "categorical", "balance": "numeric"}
    )
    # as rounded(), without a decimal for each of the pairs
    return pairs.select("synthetic_key", "real_key", (quick_round(F.col("distance")) + F.lit(0.0)).alias("distance"))


def _closest(spark, sf):
    synthetic, real = fx.holders(spark, sf)
    return privacy.closest_records(real, synthetic, ["nation", "balance"], "key", "key", {"nation": "categorical", "balance": "numeric"})


@query
def dcr_per_row(spark, sf):
    return rounded(_closest(spark, sf).select("synthetic_key", "distance"))


@query
def dcr_summary(spark, sf):
    return rounded(privacy.dcr_summary(_closest(spark, sf)))


_MATCHED = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "c_nationkey"]


@query
def exact_matches(spark, sf):
    return privacy.exact_matches(fx.people(spark, sf).select(*_MATCHED), fx.mirrored(spark, sf).select(*_MATCHED), _MATCHED)


@query
def exact_matches_positional(spark, sf):
    other = ["c_mktsegment", "o_orderpriority", "o_orderstatus", "c_nationkey"]
    return privacy.exact_matches(fx.people(spark, sf).select(*other), fx.mirrored(spark, sf).select(*_MATCHED), _MATCHED, positional=True)


@query
def exact_match_pct(spark, sf):
    return rounded(privacy.exact_match_percentage(
        fx.people(spark, sf).select(*_MATCHED), fx.mirrored(spark, sf).select(*_MATCHED), _MATCHED
    ))


# the Bayesian network


def _tree() -> bayesnet.Tree:
    return bayesnet.Tree(tuple(n for n, _ in fx.TREE), dict(fx.TREE))


def _item_text(spark, sf) -> DataFrame:
    return fx.items(spark, sf).select(*(F.col(n).cast("string").alias(n) for n, _ in fx.TREE))


@query
def laplace_counts(spark, sf):
    counts = stats.value_counts(fx.people(spark, sf), "c_mktsegment")
    return counts.select("value", r6(F.col("n") + laplace(uniform("noise", F.col("value")), 2.0)).alias("noisy"))


@query
def noisy_marginal(spark, sf):
    return rounded(bayesnet.noisy_marginal(_item_text(spark, sf), "l_returnflag", 0.5, bayesnet.seeded_noise(42)).select("value", "prob"))


@query
def noisy_cpt(spark, sf):
    return rounded(bayesnet.noisy_conditional(_item_text(spark, sf), "l_linestatus", "l_linenumber", 0.25, bayesnet.seeded_noise(42)))


@query
def ancestral_sample(spark, sf):
    tables, tree = None, _tree()
    for node, parent in fx.TREE:
        df = _item_text(spark, sf)
        if parent is None:
            t = stats.value_shares(df, node).select(F.lit(None).cast("string").alias("parent_value"), "value", F.col("share").alias("prob"))
        else:
            t = stats.contingency(df, parent, node).select(
                F.col("parent").alias("parent_value"), F.col("child").alias("value"), F.col("n").cast("double").alias("prob")
            )
        t = sampling.cumulative(t, "value", "prob", "parent_value").withColumn("node", F.lit(node))
        tables = t if tables is None else tables.unionByName(t)
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"))
    return bayesnet.ancestral_sample(rows, "row", tree, tables, lambda node, key: uniform(f"42|{node}", key))


@query
def chow_liu_edges(spark, sf):
    tree = bayesnet.chow_liu(fx.items(spark, sf), fx.ITEMS)
    return rounded(spark.createDataFrame(tree.edges(), "parent string, child string, weight double, level int"))


_BINNED = ["price_bin", "o_orderstatus", "o_orderpriority", "c_mktsegment"]


def _binned(spark, sf) -> DataFrame:
    df = fx.people(spark, sf)
    return binning.apply_bins(df, "o_totalprice", binning.fit_bins(df, "o_totalprice", 5), "price_bin").select("o_orderkey", *_BINNED)


@query
def privbayes_fit(spark, sf):
    return rounded(bayesnet.PrivBayes(1.0, seed=42).fit(_binned(spark, sf), _BINNED).tables)


@query
def privbayes_sample(spark, sf):
    return bayesnet.PrivBayes(1.0, seed=42).fit(_binned(spark, sf), _BINNED).sample(fx.SAMPLE_ROWS)


@query
def ctgan_sample(spark, sf):
    model = ctgan.CTGAN(epsilon=1.0, seed=42)
    model.fit(fx.people(spark, sf), ["o_totalprice", "o_orderstatus", "c_mktsegment"], "o_orderkey")
    return model.sample(spark, fx.SAMPLE_ROWS, seed=1)


# recipes


@query
def prep_privbayes(spark, sf):
    df, _ = recipes.for_network(fx.messy(spark, sf), recipes.PEOPLE)
    return df


@query
def prep_ctgan(spark, sf):
    df, _ = recipes.for_generator(fx.messy(spark, sf), recipes.PEOPLE)
    return rounded(df)


@query
def prep_standard(spark, sf):
    df, _ = recipes.standard(fx.messy(spark, sf), recipes.PEOPLE)
    return rounded(df)


# learning


def _guesses(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "labels")


@query
def accuracy(spark, sf):
    return rounded(mlutil.accuracy(_guesses(spark, sf), "quality", "toxic"))


@query
def weighted_f1(spark, sf):
    return rounded(mlutil.weighted_f1(_guesses(spark, sf), "quality", "toxic"))


@query
def pmse_from_scores(spark, sf):
    return fx.table(spark, sf, "orders").agg(r6(mlutil.pmse_from_scores(uniform("score", F.col("o_orderkey")))).alias("pmse"))


@query
def retention(spark, sf):
    """Accuracies by line status: how often a return flag is N, and how often the line number is at most 4."""
    rows = fx.items(spark, sf).groupBy(F.concat_ws("/", "l_linestatus", "l_returnflag").alias("model"))
    baseline = rows.agg(F.round(F.avg((F.col("l_linenumber") <= 4).cast("double")), 4).alias("accuracy"))
    tstr = rows.agg(F.round(F.avg((F.col("l_tax") <= 0.03).cast("double")), 4).alias("accuracy"))
    return rounded(mlutil.retention(baseline, tstr))


@query
def pmse(spark, sf):
    columns = ["o_totalprice", "c_acctbal", "o_orderstatus", "c_mktsegment"]
    return rounded(mlutil.pmse(fx.people(spark, sf), fx.mirrored(spark, sf), columns, "o_orderkey"))


def _learn(spark, sf, models: tuple[str, ...]) -> DataFrame:
    columns = ["o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"]
    return mlutil.evaluate(fx.mirrored(spark, sf), fx.people(spark, sf), columns, "o_orderstatus", models)


@query
def tstr_lr(spark, sf):
    return _learn(spark, sf, mlutil.MODELS[:1])


@query
def tstr_rf(spark, sf):
    return _learn(spark, sf, mlutil.MODELS[1:2])


@query
def tstr_mlp(spark, sf):
    return _learn(spark, sf, mlutil.MODELS[2:])


@query
def tstr(spark, sf):
    columns = ["o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"]
    real = sampling.stratified_split(fx.people(spark, sf), "o_orderstatus", "o_orderkey")
    train, test = real.where("is_test = 0"), real.where("is_test = 1")
    base = mlutil.evaluate(train, test, columns, "o_orderstatus")
    return mlutil.retention(base, mlutil.evaluate(fx.mirrored(spark, sf), test, columns, "o_orderstatus"))
