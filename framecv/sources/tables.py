"""Label, frame, fold, statistics, prediction, metric and parameter tables on disk."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from framecv.functions.scalars import numeric_features
from framecv.operators.stats import stats_long, stats_wide
from framecv.session import write_partitioned


def _require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")


#: Lines from which the types of a file without a schema are taken.
HEAD_LINES = 1000


def head_schema(text: DataFrame, lines: int = HEAD_LINES) -> T.StructType:
    """Types of string columns from their first rows: bigint or double where every value is one, else string. No more than those rows are read."""
    checks = []
    for i, name in enumerate(text.columns):
        cell = F.col(f"`{name}`")
        checks += [F.bool_and(cell.isNull() | cell.try_cast(kind).isNotNull()).alias(f"{kind}_{i}") for kind in ("bigint", "double")]
        checks.append(F.count(cell).alias(f"n_{i}"))
    found = text.limit(lines).agg(*checks).first()

    def kind_of(i):
        if found[f"n_{i}"]:
            for kind, data_type in (("bigint", T.LongType()), ("double", T.DoubleType())):
                if found[f"{kind}_{i}"]:
                    return data_type
        return T.StringType()

    return T.StructType([T.StructField(name, kind_of(i)) for i, name in enumerate(text.columns)])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
             rename: dict[str, str] | None = None, **options) -> DataFrame:
    """CSV with a header. With a schema the header is checked against it; without one the types are those of the first lines, and a later value
    that does not fit fails the read: give a schema then. Either way the file is read once."""
    reader = spark.read.option("header", True).options(**options)
    if schema is None:
        schema = head_schema(reader.csv(path))
        reader = reader.option("mode", "FAILFAST")
    df = reader.option("enforceSchema", False).schema(schema).csv(path)
    return df.withColumnsRenamed(rename) if rename else df


def read_labels(spark: SparkSession, path: str, key: str, label: str, schema=None) -> DataFrame:
    df = read_csv(spark, path, schema)
    _require(df, [key, label], "label table")
    return df.select(key, label)


def read_frames(spark: SparkSession, paths: Sequence[str], key: str, usecols: Sequence[str] | None = None,
                schemas: Sequence | None = None, common_key: str | None = None) -> DataFrame:
    """Union of frame files by column name; a column that a file lacks is NULL there."""
    union = None
    for i, path in enumerate(paths):
        df = read_csv(spark, path, schemas[i] if schemas else None)
        _require(df, [key, *(usecols or [])], f"frame table {path}")
        if usecols is not None:
            df = df.select(*dict.fromkeys([key, *usecols]))
        union = df if union is None else union.unionByName(df, allowMissingColumns=True)
    return union.withColumnRenamed(key, common_key) if common_key else union


def model_matrix(df: DataFrame, key: str, label: str, features: Sequence[str] | None = None, task: str = "reg") -> DataFrame:
    """Key, float features and the label (float, or integer class); run and block numbers are not features."""
    features = features or numeric_features(df, [key, label, "run", "frame", "block", "repeat", "fold"])
    target = F.col(label).cast("float") if task == "reg" else F.col(label).cast("int")
    return df.select(key, *[F.col(f"`{c}`").cast("float").alias(c) for c in features], target.alias(label))


def write_splits(df: DataFrame, path: str, by: Sequence[str] = ("repeat", "fold"), mode: str = "errorifexists") -> None:
    write_partitioned(df, by, mode).parquet(path)


def load_fold(spark: SparkSession, path: str, repeat: int, fold: int, validation: bool = True) -> DataFrame:
    """Validation rows of a fold (one partition is read) or its training rows (the other folds)."""
    df = spark.read.parquet(path).where(F.col("repeat") == repeat)
    return df.where(F.col("fold") == fold) if validation else df.where(F.col("fold") != fold)


def resolve_dataset(spark: SparkSession, preferred: str, fallback: str) -> DataFrame:
    """Parquet table at the preferred path, or at the fallback if that does not exist."""
    try:
        return spark.read.parquet(preferred)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.parquet(fallback)


def save_stats(stats: DataFrame, features: Sequence[str], path: str, mode: str = "errorifexists") -> None:
    stats_long(stats, features).write.mode(mode).parquet(path)


def load_stats(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    long = spark.read.parquet(path)
    _require(long, ["colname", "mean", "std"], "statistics table")
    return stats_wide(long, features)


def write_predictions(df: DataFrame, path: str, label: str = "entity", pred: str = "predicted", truth: str = "true",
                      by: Sequence[str] = (), fmt: str = "csv", mode: str = "errorifexists") -> None:
    """``Label, Predicted, True`` rows, in one directory per value of the ``by`` columns."""
    out = df.select(F.col(label).alias("Label"), F.col(pred).alias("Predicted"), F.col(truth).alias("True"), *by)
    writer = write_partitioned(out, by, mode) if by else out.write.mode(mode)
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def four_decimals(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("NaN")).otherwise(F.format_string("%.4f", x))


def format_metrics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics as text for a report: four decimals, ``NaN`` when undefined."""
    return df.withColumns({m: four_decimals(F.col(m).cast("double")) for m in metrics})


def write_params(params: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One-row parameter table as JSON; NULL parameters are kept."""
    params.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_params(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def params_dict(params: DataFrame) -> dict:
    return json.loads(params.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"])


def write_trials(trials: DataFrame, path: str, mode: str = "errorifexists") -> None:
    trials.write.mode(mode).option("header", True).csv(path)
