"""Label join, tail window, block average, statistics and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecv.catalog.base import (CTES, FEATURES, KEY, ORDER, ORDER_SQL, SEED, blocks_cte, frames, h, labelled, labels, query,
                                  rounded, scaled_cte, sql, table, tail_cte)
from framecv.functions.scalars import keep_existing, numeric_features, ordered_columns
from framecv.operators.frames import block_average, frame_positions, join_labels, tail_blocks, tail_percent
from framecv.operators.quantiles import value_distribution
from framecv.operators.split import assign_folds
from framecv.operators.stats import fit_stats, fold_train_stats, standardize, standardize_by_fold, stats_long
from framecv.plans.prepare import standardized_blocks

ROUND_FEATURES = " ".join(FEATURES)
PREPARED = tail_cte(60) | blocks_cte(5, SEED)


@query(sql("SELECT * FROM scaled", "labelled", PREPARED | scaled_cte(), ROUND_FEATURES + " y"))
def standardized_frames(spark, sf_dir):
    """The flagship: label join, last 60%, blocks of five, statistics, scaling."""
    return rounded(standardized_blocks(frames(spark, sf_dir), labels(spark, sf_dir).select("entity", "y"), KEY, "y", ORDER,
                                       FEATURES, 60, 5, SEED))


@query(sql("SELECT entity, run, frame, replica, cents, y FROM labelled", "labelled", rounds="y"))
def frames_with_labels(spark, sf_dir):
    joined = join_labels(frames(spark, sf_dir), labels(spark, sf_dir).select("entity", "y"), KEY)
    return rounded(joined.select("entity", *ORDER, "y"))


@query(sql(f"SELECT entity, {ORDER_SQL} FROM tail", "frames", tail_cte(37.5, "frames")))
def tail_window(spark, sf_dir):
    return tail_percent(frames(spark, sf_dir), KEY, ORDER, 37.5).select("entity", *ORDER)


@query("""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id FROM placed WHERE pos >= n - greatest(1, CAST(trunc(n::DOUBLE * (10.0::DOUBLE / 100::DOUBLE)) AS BIGINT))""")
def tail_window_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return tail_percent(events, "user_id", ["ts", "event_id"], 10).select("user_id", "event_id")


@query(sql(f"""SELECT entity, {ORDER_SQL}, count(*) OVER (PARTITION BY entity) AS group_size,
    row_number() OVER (PARTITION BY entity ORDER BY {ORDER_SQL}) - 1 AS position FROM frames""", "frames"))
def group_positions(spark, sf_dir):
    return frame_positions(frames(spark, sf_dir).select("entity", *ORDER), KEY, ORDER)


@query(sql("SELECT * FROM blocks", "labelled", blocks_cte(7, 3, "labelled"), ROUND_FEATURES + " y"))
def block_means(spark, sf_dir):
    return rounded(block_average(labelled(spark, sf_dir), KEY, ORDER, 7, 3, "y", FEATURES))


_BY_SUPPLIER = {"coarse": "SELECT replica AS entity, run, frame, entity AS replica, cents, discount, price, quantity, tax, 0.0::DOUBLE AS y FROM frames"}


@query(sql("SELECT * EXCLUDE (y) FROM blocks", "frames", _BY_SUPPLIER | tail_cte(90, "coarse") | blocks_cte(28, 5), ROUND_FEATURES))
def block_means_large_entities(spark, sf_dir):
    """The second grain: hundreds of frames per entity and wider blocks."""
    coarse = frames(spark, sf_dir).select(F.col("replica").alias("entity"), "run", "frame", F.col("entity").alias("replica"),
                                          "cents", *FEATURES)
    return rounded(tail_blocks(coarse, KEY, ORDER, 90, 28, 5, None, FEATURES))


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS colname, avg({c}) AS mean, stddev_samp({c}) AS std FROM frames" for c in FEATURES)


@query(sql(_STATS, "frames", rounds="mean std", digits=8))
def train_statistics(spark, sf_dir):
    return rounded(stats_long(fit_stats(frames(spark, sf_dir), FEATURES), FEATURES), 8)


@query(sql("SELECT entity, sum(discount) AS discount, sum(price) AS price, sum(quantity) AS quantity, sum(tax) AS tax, sum(flat) AS flat "
           "FROM (SELECT * , 0.0::DOUBLE AS flat FROM scaled) GROUP BY entity",
           "frames", scaled_cte("frames", keep="entity"), ROUND_FEATURES + " flat"))
def scaled_frames(spark, sf_dir):
    """Scaling of all frames; a column without spread is centred only."""
    rows = frames(spark, sf_dir).withColumn("flat", F.lit(5.0))
    names = [*FEATURES, "flat"]
    scaled = standardize(rows, fit_stats(rows, names), names)
    return rounded(scaled.groupBy("entity").agg(*[F.sum(c).alias(c) for c in names]))


_FOLDED = {"folded": f"SELECT *, {h('run', SEED, chr(39) + 'part' + chr(39))} % 4 AS fold FROM frames"}
_FOLD_STATS = ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in FEATURES)


def _folded(spark, sf_dir):
    from framecv.functions.hashing import hash52
    return frames(spark, sf_dir).withColumn("fold", hash52(F.col("run"), SEED, "part") % 4)


@query(sql(f"SELECT held AS fold, {_FOLD_STATS} FROM (SELECT DISTINCT fold AS held FROM folded) JOIN folded ON fold <> held GROUP BY held",
           "frames", _FOLDED, " ".join(f"mean_{c} std_{c}" for c in FEATURES), 8))
def train_statistics_by_fold(spark, sf_dir):
    """Statistics of the other folds from one pass over the rows."""
    return rounded(fold_train_stats(_folded(spark, sf_dir), FEATURES, []), 8)


@query(sql(f"""SELECT fold, count(*) AS n, sum(abs((discount - mean_discount) / std_discount)) AS discount,
    sum(abs((price - mean_price) / std_price)) AS price FROM folded JOIN
    (SELECT held AS fold, {_FOLD_STATS} FROM (SELECT DISTINCT fold AS held FROM folded) JOIN folded ON fold <> held GROUP BY held)
    USING (fold) GROUP BY fold""", "frames", _FOLDED, "discount price", 4))
def scaled_by_fold_statistics(spark, sf_dir):
    rows = _folded(spark, sf_dir)
    scaled = standardize_by_fold(rows, fold_train_stats(rows, FEATURES, []), FEATURES, [])
    return rounded(scaled.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.abs("discount")).alias("discount"),
                                              F.sum(F.abs("price")).alias("price")), 4)


@query(sql("SELECT entity, discount, price, quantity, tax FROM blocks", "labelled", PREPARED, ROUND_FEATURES))
def feature_columns(spark, sf_dir):
    """Numeric features found by type, the run dropped, the key first and the rest in order."""
    blocks = tail_blocks(labelled(spark, sf_dir).select("entity", *ORDER, *FEATURES, "y"), KEY, ORDER, 60, 5, SEED, "y", FEATURES)
    found = numeric_features(blocks.drop("run"), [KEY, "y", "block"])
    wanted = keep_existing(blocks, [*found, "absent"])
    return rounded(ordered_columns(blocks.select(KEY, *reversed(wanted)), KEY))


# ---- entities that are far above what one window may hold ------------------------------------

_FLAGGED = {"flagged": f"""SELECT l_returnflag AS entity, l_orderkey AS run, l_linenumber AS frame, l_suppkey AS replica,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_discount AS discount, sqrt(l_extendedprice) AS price,
    l_quantity AS quantity, l_tax AS tax, 0.0::DOUBLE AS y FROM lineitem"""}
_SMALL_WINDOW = 500


def _flagged(spark, sf_dir):
    """Three entities hold all rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("entity"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("frame"),
        F.col("l_suppkey").alias("replica"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_discount").alias("discount"), F.sqrt("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
        F.col("l_tax").alias("tax"))


@query(sql(f"SELECT entity, {ORDER_SQL} FROM tail", "", _FLAGGED | tail_cte(37.5, "flagged")))
def tail_window_hot(spark, sf_dir):
    return tail_percent(_flagged(spark, sf_dir), KEY, ORDER, 37.5, _SMALL_WINDOW).select("entity", *ORDER)


@query(sql(f"""SELECT entity, {ORDER_SQL}, count(*) OVER (PARTITION BY entity) AS group_size,
    row_number() OVER (PARTITION BY entity ORDER BY {ORDER_SQL}) - 1 AS position FROM flagged""", "", _FLAGGED))
def group_positions_hot(spark, sf_dir):
    return frame_positions(_flagged(spark, sf_dir).select("entity", *ORDER), KEY, ORDER, _SMALL_WINDOW)


@query(sql("SELECT * EXCLUDE (y) FROM blocks", "", _FLAGGED | blocks_cte(7, 3, "flagged"), ROUND_FEATURES))
def block_means_hot(spark, sf_dir):
    return rounded(block_average(_flagged(spark, sf_dir), KEY, ORDER, 7, 3, None, FEATURES, _SMALL_WINDOW))


@query(sql("SELECT * EXCLUDE (y) FROM blocks", "", _FLAGGED | tail_cte(90, "flagged") | blocks_cte(28, 5), ROUND_FEATURES))
def tail_blocks_hot(spark, sf_dir):
    return rounded(tail_blocks(_flagged(spark, sf_dir), KEY, ORDER, 90, 28, 5, None, FEATURES, max_rows=_SMALL_WINDOW))


@query(sql("""SELECT entity, count(price) AS n, min(price) AS low, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS q50,
    quantile_cont(price, 0.75) AS q75, max(price) AS high FROM flagged GROUP BY entity""", "", _FLAGGED, "low q25 q50 q75 high"))
def quantiles_hot(spark, sf_dir):
    return rounded(value_distribution(_flagged(spark, sf_dir), "entity", "price", _SMALL_WINDOW))
