"""Readers and writers. Each query lets Spark write the driver tables in the stored form and reads them back."""

from __future__ import annotations

from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from framecv.catalog.base import FEATURES, KEY, ORDER, SEED, frames, labelled, labels, predictions, query, rounded, sql, table
from framecv.catalog.frames import PREPARED
from framecv.catalog.metrics import GROUPS, REG_COLS, reg_sql
from framecv.catalog.splits import ENTITIES, _repeats, balanced
from framecv.functions.scalars import fraction_tag
from framecv.operators.frames import tail_blocks
from framecv.operators.metrics import regression_metrics
from framecv.operators.split import assign_folds
from framecv.operators.stats import fit_stats
from framecv.plans.crossval import with_folds
from framecv.plans.search import best_trial, trial_loss
from framecv.session import materialize, scratch_path, write_partitioned
from framecv.sources.predictions import file_account, collect_regression_predictions, file_name, read_by_task, read_predictions
from framecv.sources.tables import (format_metrics, load_fold, load_stats, model_matrix, params_dict, read_frames, read_labels,
                                    read_csv, read_params, resolve_dataset, save_stats, write_params, write_predictions, write_splits)


def _csv(df, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


@query(sql("SELECT entity, y FROM targets", "targets", rounds="y"))
def label_scan(spark, sf_dir):
    """Label file: header checked, key and label projected."""
    source = labels(spark, sf_dir)
    return rounded(read_labels(spark, _csv(source, "labels"), KEY, "y", source.schema))


@query(sql("SELECT entity, count(*) AS n, sum(price) AS price, sum(tax) AS tax FROM frames GROUP BY entity", "frames", rounds="price tax", digits=4))
def frame_scan(spark, sf_dir):
    """Frame file with a column subset and an optional rename on read."""
    source = frames(spark, sf_dir)
    path = _csv(source.withColumnRenamed("tax", "Tax Energy"), "frames")
    schema = source.withColumnRenamed("tax", "Tax Energy").schema
    rows = read_frames(spark, [path], KEY, ["price", "Tax Energy"], [schema]).withColumnRenamed("Tax Energy", "tax")
    return rounded(rows.groupBy("entity").agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.sum("tax").alias("tax")), 4)


@query("""SELECT l_partkey AS entity, count(*) AS n, count(CASE WHEN l_returnflag <> 'R' THEN l_tax END) AS n_tax,
    round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY l_partkey""")
def frame_union(spark, sf_dir):
    """Several files, one without a column, under a renamed key."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("probe"), "l_returnflag", F.col("l_quantity").alias("quantity"),
                                                   F.col("l_tax").alias("tax"))
    parts = [rows.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in ("A", "N", "R")]
    parts[2] = parts[2].drop("tax")
    union = read_frames(spark, [_csv(p, "part") for p in parts], "probe", None, [p.schema for p in parts], common_key=KEY)
    return rounded(union.groupBy("entity").agg(F.count("*").alias("n"), F.count("tax").alias("n_tax"), F.sum("quantity").alias("quantity")), 4)


@query(sql("""SELECT entity, discount::FLOAT::DOUBLE AS discount, price::FLOAT::DOUBLE AS price, quantity::FLOAT::DOUBLE AS quantity,
    tax::FLOAT::DOUBLE AS tax, y_bin FROM labelled""", "labelled", rounds="discount price quantity tax"))
def model_matrix_rows(spark, sf_dir):
    """Key, 32-bit features and integer class."""
    rows = labelled(spark, sf_dir).select(KEY, "run", "frame", *FEATURES, "y_bin")
    return rounded(model_matrix(rows, KEY, "y_bin", task="bin"))


@query(sql("SELECT entity, block, discount, price, y FROM blocks JOIN folds USING (entity) WHERE repeat = 1 AND fold = 2",
           "labelled", PREPARED | ENTITIES | _repeats(2) | balanced(5), "discount price y"))
def split_store(spark, sf_dir):
    """Rows written by repeat and fold; the validation part is one partition."""
    blocks = materialize(tail_blocks(frames(spark, sf_dir), KEY, ORDER, 60, 5, SEED, "y", FEATURES, labels(spark, sf_dir).select(KEY, "y")))
    path = scratch_path(spark, "splits")
    write_splits(with_folds(blocks, assign_folds(frames(spark, sf_dir), KEY, 5, 2, SEED), KEY), path)
    return rounded(load_fold(spark, path, 1, 2).select("entity", "block", "discount", "price", "y"))


@query(sql("SELECT " + ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in FEATURES) + " FROM frames", "frames",
           rounds=" ".join(f"mean_{c} std_{c}" for c in FEATURES), digits=8))
def statistics_store(spark, sf_dir):
    """Statistics stored as one row per feature and loaded as one wide row."""
    path = scratch_path(spark, "stats")
    save_stats(fit_stats(frames(spark, sf_dir), FEATURES), FEATURES, path)
    return rounded(load_stats(spark, path, FEATURES), 8)


@query(sql('SELECT rep, fold, count(*) AS n, sum(pred_reg) AS predicted, sum(true_reg) AS "true" FROM preds GROUP BY rep, fold', "preds",
           rounds='predicted "true"', digits=4))
def prediction_store(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    write_predictions(predictions(spark, sf_dir), path, KEY, "pred_reg", "true_reg", ["rep", "fold"], fmt="parquet")
    back = spark.read.parquet(path)
    return rounded(back.groupBy("rep", "fold").agg(F.count("*").alias("n"), F.sum("Predicted").alias("predicted"), F.sum("True").alias("true")), 4)


@query(sql("SELECT scr_frac, is_test, rep, fold, n, coalesce(printf('%.4f', mse), 'NaN') AS mse, coalesce(printf('%.4f', pear), 'NaN') AS pear, "
           f"coalesce(printf('%.4f', mcc), 'NaN') AS mcc FROM ({reg_sql(', '.join(GROUPS), 'pred_reg', 'true_reg', 'preds', True)})", "preds"))
def metric_report(spark, sf_dir):
    """Metrics as text with four decimals."""
    metrics = regression_metrics(predictions(spark, sf_dir), GROUPS, "pred_reg", "true_reg")
    return format_metrics(metrics, ["mse", "pear", "mcc"]).select(*GROUPS, "n", "mse", "pear", "mcc")


@query(sql(f"""SELECT trial, loss, noise_level, max_depth FROM (SELECT CAST(row_number() OVER (ORDER BY noise_level) - 1 AS BIGINT) AS trial,
    coalesce(1 - pear, 1e6) AS loss, noise_level, NULL::BIGINT AS max_depth FROM ({reg_sql('noise_level', 'pred_reg', 'true_reg', 'preds', True)}))
    ORDER BY loss, trial LIMIT 1""", "preds", rounds="loss noise_level"))
def best_params_file(spark, sf_dir):
    """The best trial as JSON and back; an unset parameter stays in the file."""
    by_level = regression_metrics(predictions(spark, sf_dir), ["noise_level"], "pred_reg", "true_reg")
    trials = by_level.select(F.round(F.col("noise_level") * 20).cast("bigint").alias("trial"), trial_loss("reg").alias("loss"), "noise_level",
                             F.lit(None).cast("bigint").alias("max_depth"))
    path = scratch_path(spark, "params")
    write_params(best_trial(trials), path)
    return rounded(read_params(spark, path, trials.schema))


# ---- prediction files whose names carry the experiment ----------------------------------------

def _stored(rows, name_column, name: str, columns) -> str:
    """One directory per name, in one job."""
    path = scratch_path(rows.sparkSession, name)
    out = rows.select(F.col(KEY).cast("string").alias("Label"), *columns, name_column.alias("file"))
    write_partitioned(out, ["file"]).option("header", True).csv(path)
    return path


def _values(task: str, averaged: bool = False):
    p, t = {"reg": ("pred_reg", "true_reg"), "bin": ("pred_bin", "true_bin"), "mclass": ("pred_cls", "true_cls")}[task]
    names = ("AvgPredicted", "AvgTrue") if averaged else ("Predicted", "True")
    return [F.col(p).cast("double").alias(names[0]), F.col(t).cast("double").alias(names[1])]


def _named(task, level=None, prefix="noi"):
    return file_name(task, F.col("is_test"), F.col("scr_frac"), F.col("rep"), F.col("fold"), level, prefix)


_BY_TASK = " UNION ALL ".join(
    f"SELECT '{t}' AS model_type, scr_frac, is_test, rep, fold, count(*) AS n, sum({p})::DOUBLE AS predicted, sum({y})::DOUBLE AS truth FROM preds GROUP BY ALL"
    for t, p, y in (("reg", "pred_reg", "true_reg"), ("bin", "pred_bin", "true_bin"), ("mclass", "pred_cls", "true_cls")))


@query(sql(_BY_TASK, "preds", rounds="predicted truth", digits=4))
def prediction_files(spark, sf_dir):
    """Files of three tasks: metadata from the names, columns renamed and cast by task."""
    rows = predictions(spark, sf_dir)
    entries = F.array(*[F.struct(*_values(task), _named(task).alias("file")) for task in ("reg", "bin", "mclass")])
    path = _stored(rows.select(KEY, F.inline(entries)), F.col("file"), "predictions", ["Predicted", "True"])
    tasks = read_by_task(spark, path, "file=predictions_*")
    out = None
    for task, (p, t) in {"reg": ("Predicted_reg", "True_reg"), "bin": ("Predicted_class", "True_class"), "mclass": ("Predicted_mclass", "mclass")}.items():
        part = tasks[task].groupBy("model_type", "scr_frac", "is_test", "rep", "fold").agg(
            F.count("*").alias("n"), F.sum(p).cast("double").alias("predicted"), F.sum(t).cast("double").alias("truth"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


@query(sql("""SELECT scr_frac, CAST(trunc(noise_level * 100::DOUBLE) AS INTEGER) / 100.0::DOUBLE AS noise_level, is_test, rep, fold, count(*) AS n,
    sum(pred_reg) AS predicted FROM preds GROUP BY ALL""", "preds", rounds="predicted", digits=4))
def noise_prediction_files(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    path = _stored(rows, _named("reg", F.col("noise_level")), "noise", _values("reg"))
    back = read_predictions(spark, path, "file=predictions_*", sweep="noi")
    return rounded(back.groupBy("scr_frac", "noise_level", "is_test", "rep", "fold").agg(F.count("*").alias("n"), F.sum("Predicted").alias("predicted")), 4)


@query(sql("""SELECT scr_frac, CAST(25 * (1 + frame % 4) AS INTEGER) AS sub_pct, is_test, rep, fold, count(*) AS n, sum(pred_reg) AS predicted FROM preds GROUP BY ALL""",
           "preds", rounds="predicted", digits=4))
def subsample_prediction_files(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    path = _stored(rows, _named("reg", 0.25 * (1 + F.col("frame") % 4), "sub"), "subsample", _values("reg"))
    back = read_predictions(spark, path, "file=predictions_*", sweep="sub")
    return rounded(back.groupBy("scr_frac", "sub_pct", "is_test", "rep", "fold").agg(F.count("*").alias("n"), F.sum("Predicted").alias("predicted")), 4)


@query(sql("""SELECT scr_frac, is_test, rep, fold, false AS final_avg, count(*) AS n, sum(pred_reg) AS predicted FROM preds GROUP BY ALL
    UNION ALL SELECT scr_frac, false, NULL, NULL, true, count(*), sum(p) FROM (SELECT scr_frac, entity, avg(pred_reg) AS p FROM preds WHERE NOT is_test GROUP BY ALL) GROUP BY scr_frac""",
           "preds", rounds="predicted", digits=4))
def nested_prediction_files(spark, sf_dir):
    """A search at any depth, with files of fold averages under other column names."""
    rows = predictions(spark, sf_dir)
    path = _stored(rows, _named("reg"), "nested", _values("reg"))
    means = rows.where(~F.col("is_test")).groupBy("scr_frac", KEY).agg(F.avg("pred_reg").alias("pred_reg"), F.avg("true_reg").alias("true_reg"))
    name = F.concat(F.lit("predictions_reg_final_avg_scr"), fraction_tag(F.col("scr_frac")), F.lit(".csv"))
    averaged = _stored(means, name, "averaged", _values("reg", averaged=True))
    back = collect_regression_predictions(spark, path, averaged, "part-*", "part-*")
    return rounded(back.groupBy("scr_frac", "is_test", "rep", "fold", "final_avg").agg(F.count("*").alias("n"), F.sum("Predicted_reg").alias("predicted")), 4)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def dataset_fallback(spark, sf_dir):
    """The preferred table does not exist, so the fallback is read."""
    rows = resolve_dataset(spark, f"{sf_dir}/lineitem_preferred.parquet", f"{sf_dir}/lineitem.parquet")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(sql("""SELECT status, count(*) AS n_files, sum(n)::BIGINT AS n_rows FROM (
    SELECT 'read' AS status, count(*) AS n FROM preds GROUP BY scr_frac, is_test, rep, fold
    UNION ALL SELECT 'skipped', 0 UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'unnamed', 0) GROUP BY status""", "preds"))
def prediction_file_account(spark, sf_dir):
    """A search at any depth that meets a corrupt, an empty and a foreign file: what was read and what was not."""
    rows = predictions(spark, sf_dir)
    path = _stored(rows, _named("reg"), "account", _values("reg"))
    store, root = FileSystem.from_uri(path)
    for name, content in (("predictions_reg_scr0p00_rep7_fold0.csv/part-0.csv.gz", b"this is no compressed file, whatever its name says"),
                          ("predictions_reg_scr0p00_rep8_fold0.csv/part-0.csv", b""), ("other.csv/part-0.csv", b"Label,Predicted,True\n")):
        target = f"{root}/deep/file={name}"
        store.create_dir(target.rsplit("/", 1)[0])
        with store.open_output_stream(target, compression=None) as out:
            out.write(content)
    found = file_account(spark, path, "part-*")
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"))
