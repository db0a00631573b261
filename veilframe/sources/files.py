"""CSV scans, and sinks for tables and metrics."""

from __future__ import annotations

import json
import shutil
import urllib.request
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import adult_schema, covertype_schema


def ensure_path(spark: SparkSession, path: str) -> str:
    """path, if Spark's file systems have it; FileNotFoundError otherwise, before any job starts."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    return path


# Where the two public tables are published.
ADULT_URLS = (
    "https://archive.ics.uci.edu/ml/machine-learning-databases/adult/adult.data",
    "https://archive.ics.uci.edu/ml/machine-learning-databases/adult/adult.test"
)
COVERTYPE_URL = "https://archive.ics.uci.edu/ml/machine-learning-databases/covtype/covtype.data.gz"


def fetch(url: str, path: str | Path, timeout: float = 60) -> str:
    """The path of a local copy of url: fetched once, and there under its name only when it is complete."""
    path = Path(path)
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f"{path.name}.{uuid.uuid4().hex}.part")
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer, open(part, "wb") as out:
                shutil.copyfileobj(answer, out)
            part.rename(path)
        finally:
            part.unlink(missing_ok=True)
    return str(path)


def fetch_adult(spark: SparkSession, folder: str | Path, urls: tuple[str, str] = ADULT_URLS) -> DataFrame:
    """load_adult() of local copies in a folder that driver and executors share."""
    return load_adult(spark, *(fetch(u, Path(folder) / u.rpartition("/")[2]) for u in urls))


def fetch_covertype(spark: SparkSession, folder: str | Path, url: str = COVERTYPE_URL) -> DataFrame:
    """load_covertype() of a local copy in a folder that driver and executors share."""
    return load_covertype(spark, fetch(url, Path(folder) / url.rpartition("/")[2]))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, null_value: str = "?", comment: str | None = None) -> DataFrame:
    """A headerless CSV: blanks trimmed, null_value as null, lines that start with comment left out.

    Files that end in .gz are decompressed; as those cannot be split, their rows are dealt out again.
    """
    ensure_path(spark, path)
    options = {
        "header": "false", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": null_value
    } | ({"comment": comment} if comment else {})
    df = spark.read.schema(schema).options(**options).csv(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def parse_csv(lines: DataFrame, column: str, schema: T.StructType, null_value: str = "?") -> DataFrame:
    """Rows of a column of CSV lines, under the same rules as scan_csv."""
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": null_value}
    return lines.select(F.from_csv(
        column, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), options
    ).alias("r")).select("r.*")


def load_adult(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Both files as one table; the test file opens with a comment line and ends its labels with a full stop."""
    parts = [scan_csv(spark, train, adult_schema(), comment="|"), scan_csv(spark, test, adult_schema(), comment="|")]
    both = parts[0].unionByName(parts[1])
    return both.withColumn("income", F.trim(F.replace("income", F.lit("."), F.lit("")))).where(F.col("age").isNotNull())


def load_covertype(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, covertype_schema())


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header; for results, not for data of any size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(values: dict, path: str | Path) -> None:
    """A small result as sorted, indented JSON."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values, indent=4, sort_keys=True))


def results_dir(root: str | Path, dataset: str, synthesizer: str, epsilon: float) -> Path:
    return Path(root) / f"{dataset}_{synthesizer}_eps_{epsilon}"


def write_aggregates(root: Path, statistical: dict, privacy: dict, ml: dict) -> None:
    """The aggregated files of a configuration; the one on learning only if there is anything."""
    write_json(statistical, root / "aggregated_statistical_metrics.json")
    write_json(privacy, root / "aggregated_privacy_metrics.json")
    if ml:
        write_json(ml, root / "aggregated_ml_metrics.json")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The tall metrics frame as Parquet, a folder for each configuration."""
    metrics.write.mode("append").partitionBy("dataset", "synthesizer", "epsilon").parquet(path)
