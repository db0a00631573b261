"""Learning: features, models, train on synthetic and test on real, the propensity score's mean squared error."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import harmonise, infer_roles
from .encode import scale_parameters, standard_scale
from .learners import Forest, Network
from .sampling import kfold

MODELS = ("Logistic Regression", "Random Forest", "Neural Network")
#: Rows that a task of a learner reads at most.
PART_ROWS = 500_000


def feature_stages(df: DataFrame, columns: list[str], roles: dict[str, str]) -> list:
    """Indicators for categories (unknown ones all 0) and the numbers as they are, in one vector; ValueError without columns."""
    if not columns:
        raise ValueError("no feature columns")
    category = [c for c in columns if roles[c] == "categorical"]
    stages: list = [StringIndexer(inputCol=c, outputCol=f"{c}__i", stringOrderType="alphabetAsc", handleInvalid="keep") for c in category]
    if category:
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in category], outputCols=[f"{c}__v" for c in category], dropLast=True))
    return [
        *stages,
        VectorAssembler(inputCols=[f"{c}__v" if c in category else c for c in columns], outputCol="__features", handleInvalid="keep")
    ]


def classifier(name: str, n: int, inputs: int = 0, classes: int = 2, trees: int = 100, depth: int = 12):
    """A model by name. The regression's penalty is that of a unit cost on the summed loss; forests are depth-limited."""
    if name == MODELS[0]:
        return LogisticRegression(
            maxIter=1000, regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, labelCol="__y",
            featuresCol="__features"
        )
    if name == MODELS[1]:
        plain = RandomForestClassifier(
            numTrees=trees, seed=42, maxDepth=depth, labelCol="__y", featuresCol="__features", maxBins=64, cacheNodeIds=True
        )
        return Forest(plain, classes, trees, depth, 64, 42)
    return Network([inputs, 100, classes], 200, 42)


def accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def weighted_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """F1 by class, weighted by the class's share of the truth; 0 for a class never guessed right."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0))
    truths = cells.groupBy("t").agg(F.sum("n").alias("support"), hit.alias("hit"))
    guesses = cells.groupBy("g").agg(F.sum("n").alias("guessed"))
    per = truths.join(guesses, truths["t"] == guesses["g"], "left")
    f1 = F.lit(2.0) * F.col("hit") / (F.col("support") + F.coalesce("guessed", F.lit(0)))
    return per.agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def prepare(train: DataFrame, test: DataFrame, columns: list[str], target: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Both frames with the training frame's roles and scale."""
    left, right, _ = harmonise(train, test, columns)
    roles = infer_roles(left, columns=columns)
    numbers = [c for c in columns if roles[c] == "numeric"]
    if numbers:
        scale = scale_parameters(left, numbers)
        left, right = standard_scale(left, scale), standard_scale(right, scale)
    return left, right, roles


def spread(rows: DataFrame) -> DataFrame:
    """The rows, kept, in a part for each core, or more of PART_ROWS: learners read them many times, and a join may leave them in one part."""
    once = rows.cache()
    n, session = once.count(), rows.sparkSession
    out = once.repartition(max(session.sparkContext.defaultParallelism, -(-n // PART_ROWS))).cache()
    out.count()
    once.unpersist()
    return out


def evaluate(train: DataFrame, test: DataFrame, columns: list[str], target: str, models: tuple[str, ...] = MODELS, **how) -> DataFrame:
    """(model, accuracy, f1), rounded to 4 digits: each model trained on one frame and tested on the other.

    Both need the target and the columns, else ValueError. Test rows of a class that training lacks count as wrong.
    """
    for df in (train, test):
        if missing := [c for c in [*columns, target] if c not in df.columns]:
            raise ValueError(f"missing columns: {missing}")
    left, right, roles = prepare(train, test, columns, target)
    label = StringIndexer(inputCol=target, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep")
    fitted = Pipeline(stages=[label, *feature_stages(left, columns, roles)]).fit(left)
    names = fitted.stages[0].labels
    left = spread(fitted.transform(left).select("__y", "__features"))
    right = fitted.transform(right).select(F.col(target).cast("string").alias("truth"), "__y", "__features").cache()
    n, first = left.count(), left.first()
    rows = []
    for name in models:
        model = classifier(name, n, first["__features"].size, max(2, len(names)), **how).fit(left)
        guess = F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))
        guessed = model.transform(right).select("truth", guess.alias("guess"))
        cells = guessed.groupBy("truth", "guess").agg(F.count("*").alias("n")).collect()
        rows.append((name, *_scores([(r["truth"], r["guess"], r["n"]) for r in cells])))
    left.unpersist()
    right.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, accuracy double, f1 double")


def _scores(cells: list[tuple[str, str, int]]) -> tuple[float, float]:
    total = sum(n for _, _, n in cells)
    right = sum(n for t, g, n in cells if t == g)
    f1 = 0.0
    for c in {t for t, _, _ in cells}:
        hit = sum(n for t, g, n in cells if t == g == c)
        support, guessed = sum(n for t, _, n in cells if t == c), sum(n for _, g, n in cells if g == c)
        f1 += support * 2 * hit / (support + guessed)
    return (round(right / total, 4), round(f1 / total, 4)) if total else (0.0, 0.0)


def retention(baseline: DataFrame, tstr: DataFrame) -> DataFrame:
    """(model, baseline, tstr, retention): 100 tstr / baseline of the models in both, null where the baseline is 0."""
    a, b = baseline.select("model", F.col("accuracy").alias("baseline")), tstr.select("model", F.col("accuracy").alias("tstr"))
    return a.join(b, "model").withColumn("retention", F.when(F.col("baseline") > 0, F.lit(100.0) * F.col("tstr") / F.col("baseline")))


def pmse_from_scores(p: Column) -> Column:
    return F.avg((p - F.lit(0.5)) * (p - F.lit(0.5)))


def pmse(real: DataFrame, synthetic: DataFrame, columns: list[str], key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(pmse, floor): mean squared distance from 1/2 of out-of-fold propensity scores, and what a constant score would give.

    key tells rows of both frames apart; it is no feature.
    """
    left, right, _ = harmonise(real, synthetic, columns)
    both = left.withColumn("__y", F.lit(1.0)).withColumn("__k", F.concat(F.lit("r"), F.col(key).cast("string"))).select("__k", "__y", *columns)
    both = both.unionByName(right.withColumn("__y", F.lit(0.0)).withColumn("__k", F.concat(F.lit("s"), F.col(key).cast("string"))).select("__k", "__y", *columns))
    roles = infer_roles(both, columns=columns)
    both = kfold(both, "__k", folds, seed, "__fold")
    ready = Pipeline(stages=feature_stages(both, columns, roles)).fit(both).transform(both).select("__y", "__fold", "__features").cache()
    n, scored = ready.count(), None
    for f in range(folds):
        train = ready.where(F.col("__fold") != f)
        model = classifier(MODELS[0], n - n // folds).fit(train)
        part = model.transform(ready.where(F.col("__fold") == f)).select("__y", vector_to_array("probability")[1].alias("p"))
        scored = part if scored is None else scored.union(part)
    out = scored.agg(pmse_from_scores(F.col("p")).alias("pmse"), F.avg("__y").alias("share"))
    return out.select("pmse", ((F.col("share") - 0.5) * (F.col("share") - 0.5)).alias("floor"))
