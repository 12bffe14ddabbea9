"""Prediction files whose names carry the experiment: task, scramble fraction, repeat, fold and sweep level.

The name may be that of a file or of a directory written by Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framecv.functions.scalars import fraction_tag, parse_fraction, percent_tag
from framecv.sources.tables import _require

# The layout of the file names.
NAME = r"predictions_(test_)?(reg|bin|mclass)_(final_avg_)?scr(\d+p\d+)(?:_(noi|sub)(\d+))?(?:_rep(\d+)_fold(\d+))?\.csv"
RENAMES = {
    "reg": {"Predicted": "Predicted_reg", "True": "True_reg"},
    "bin": {"Predicted": "Predicted_class", "True": "True_class"},
    "mclass": {"Predicted": "Predicted_mclass", "True": "mclass"},
}
SCHEMA = "Label string, Predicted double, True double"
AVERAGED_SCHEMA = "Label string, AvgPredicted double, AvgTrue double"
ROW_FILES = "{predictions_reg,predictions_test_reg}_scr*.csv"
AVERAGED_FILES = "predictions_reg_final_avg_*.csv"


def name_columns(path: Column) -> dict[str, Column]:
    """Metadata columns parsed from a path; NULL where the name does not say."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(path, NAME, i), F.lit(""))

    return {
        "model_type": part(2),
        "scr_frac": parse_fraction(part(4)),
        "level": part(6).cast("int") / F.lit(100.0),
        "rep": part(7).cast("int"),
        "fold": part(8).cast("int"),
        "is_test": part(1).isNotNull(),
        "final_avg": part(3).isNotNull(),
    }


def _scan(spark: SparkSession, path: str, glob: str, schema: str, recursive: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("enforceSchema", False).schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
        return reader.option("pathGlobFilter", glob).csv(path)
    return reader.csv(f"{path.rstrip('/')}/{glob}")


#: A list of so many files at most is broadcast (some 200 bytes a file; the driver holds it anyway to plan the scan).
BROADCAST_FILES = 500_000


def file_table(raw: DataFrame) -> DataFrame:
    """One row per file of a scan: ``_path``, ``_known`` (whether the name is understood), ``_kind`` of sweep and what the name says.

    The paths come from the file index of the scan, so no file is opened and every name is parsed once.
    """
    paths = [re.sub(r"^(\w+):/+(?=/)", r"\1:", p) if p.startswith("file:") else p for p in raw.inputFiles()]  # rows say file:/ for file:///
    spark = raw.sparkSession
    parsed = spark.createDataFrame([(p,) for p in paths], "_path string").withColumns({
        "_known": F.regexp_like("_path", F.lit(NAME)), "_kind": F.regexp_extract("_path", NAME, 5)}).withColumns(name_columns(F.col("_path")))
    # as plain values: a condition on an expression of the path would be inferred for the path of every row that is joined
    files = spark.createDataFrame(parsed.collect(), parsed.schema)
    return F.broadcast(files) if len(paths) <= BROADCAST_FILES else files


def read_predictions(spark: SparkSession, path: str, glob: str = "predictions_*", schema: str = SCHEMA,
                     sweep: str | None = None, recursive: bool = False) -> DataFrame:
    """Row predictions of every file below ``path`` whose name is understood.

    ``glob`` selects entries of the folder, or with ``recursive`` the files themselves at any depth.
    ``sweep``: None for plain names, 'noi' or 'sub' for names with a noise or subsample level;
    the level becomes ``noise_level`` (a fraction) or ``sub_pct`` (percent).
    """
    raw = _scan(spark, path, glob, schema, recursive)
    files = file_table(raw)
    rows = raw.withColumn("_path", F.col("_metadata.file_path")).join(files, "_path", "left")
    # every row comes from a file of the index; one that does not is an error, not a row to leave out
    found = F.coalesce(F.col("_kind"), F.raise_error(F.concat(F.lit("not in the file index: "), F.col("_path"))))
    rows = rows.withColumn("_kind", found).where(F.coalesce(F.col("_known"), F.lit(True)) & (F.col("_kind") == (sweep or "")))
    # a row is either of the test set or of one repeat and fold, or averaged over all of them
    rows = rows.where(F.col("is_test") | F.col("final_avg") | F.col("rep").isNotNull()).drop("_path", "_known", "_kind")
    if sweep == "noi":
        return rows.withColumnRenamed("level", "noise_level")
    if sweep == "sub":
        return rows.withColumn("level", F.round(F.col("level") * 100).cast("int")).withColumnRenamed("level", "sub_pct")
    return rows.drop("level")


def file_account(spark: SparkSession, path: str, files: str = ROW_FILES, schema: str = SCHEMA) -> DataFrame:
    """``path, status`` of every file that a search at any depth finds: ``read`` if it gave rows, ``skipped`` if it gave none because it is corrupt, ``empty``
    if it has no bytes or its scan ended without rows, ``unnamed`` if its name is not understood.

    The listing reads no content. A corrupt file is told from an empty one by its bytes: a file of some size without a row was skipped.
    """
    scan = _scan(spark, path, files, schema, True)
    gave = scan.select(F.col("_metadata.file_path").alias("_path")).groupBy("_path").agg(F.count(F.lit(1)).alias("n_rows"))
    # files without a byte are in the index of the scan, not in the listing by size
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path).select(
        F.col("_metadata.file_path").alias("_path"), "length")
    header = len(",".join(c.split()[0] for c in schema.split(", "))) + 2  # bytes of a file with a header only
    status = (F.when(~F.col("_known"), "unnamed").when(F.col("n_rows") > 0, "read")
              .when(F.coalesce(F.col("length"), F.lit(0)) <= header, "empty").otherwise("skipped"))
    found = file_table(scan).join(gave, "_path", "left").join(sizes, "_path", "left")
    return found.select(F.col("_path").alias("path"), status.alias("status"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


def read_by_task(spark: SparkSession, path: str, glob: str = "predictions_*") -> dict[str, DataFrame]:
    """The rows of each task under its own column names; classes as integers.

    Each task lists only its own files, so every file is read once.
    """
    out = {}
    for task, names in RENAMES.items():
        own = glob.replace("predictions_*", f"{{predictions_{task},predictions_test_{task}}}_*")
        part = read_predictions(spark, path, own).where(F.col("model_type") == task)
        if task != "reg":
            part = part.withColumns({c: F.col(c).cast("int") for c in names})
        out[task] = part.withColumnsRenamed(names)
    return out


def standard_names(df: DataFrame) -> DataFrame:
    """Predicted/True or AvgPredicted/AvgTrue under the names used for regression."""
    out = df.withColumnsRenamed({"Predicted": "Predicted_reg", "True": "True_reg",
                                 "AvgPredicted": "Predicted_reg", "AvgTrue": "True_reg"})
    _require(out, ["Predicted_reg", "True_reg"], "prediction table")
    return out


def collect_regression_predictions(spark: SparkSession, path: str, averaged: str | None = None, files: str = ROW_FILES,
                                   averaged_files: str = AVERAGED_FILES) -> DataFrame:
    """Regression rows below a folder at any depth, corrupt files skipped.

    Files of averages over the folds have other column names; they are looked for in the same
    folder unless ``averaged`` names another. The last two arguments select files by their own names.
    """
    rows = read_predictions(spark, path, files, recursive=True).where(~F.col("final_avg"))
    means = read_predictions(spark, averaged or path, averaged_files, AVERAGED_SCHEMA, recursive=True).where(F.col("final_avg"))
    both = standard_names(rows).unionByName(standard_names(means))
    return both.where(F.col("model_type") == "reg").drop("model_type")


def file_name(task: str, is_test: Column, scr_frac: Column, rep: Column, fold: Column, level: Column | None = None,
              prefix: str = "noi") -> Column:
    """Name under which a row is stored; the inverse of ``name_columns``."""
    tag = F.concat(F.lit("_"), percent_tag(prefix, level)) if level is not None else F.lit("")
    place = F.concat(F.lit("_rep"), rep.cast("string"), F.lit("_fold"), fold.cast("string"))
    return F.concat(F.lit("predictions_"), F.when(is_test, F.lit("test_")).otherwise(F.lit("")), F.lit(f"{task}_scr"),
                    fraction_tag(scr_frac), tag, F.when(is_test, F.lit("")).otherwise(place), F.lit(".csv"))
