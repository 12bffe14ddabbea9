"""Registry, the roles the driver tables play, and the SQL fragments the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framecv.functions.hashing import hash52, uniform

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

KEY, ORDER = "entity", ["run", "frame", "replica", "cents"]
FEATURES = ["discount", "price", "quantity", "tax"]
SEED = 42


def query(sql: str | None = None):
    """Register a function under its own name, with its oracle if it has one."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles})


def spread(df: DataFrame, *by: str) -> DataFrame:
    """One partition per core and million rows at least. The driver's tables are files of one row group, so a scan is one task, too few where
    every row is rendered and parsed as a report. Large tables have enough partitions of their own and are dealt by about as many."""
    count = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // 1_000_000)
    return df.repartition(count, *by)


# ---- roles -----------------------------------------------------------------------------------

def frames(spark, sf_dir) -> DataFrame:
    """Repeated measurements: one entity per part, four features, a total order inside the entity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("frame"),
        F.col("l_suppkey").alias("replica"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_discount").alias("discount"), F.sqrt("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))


def labels(spark, sf_dir) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity"), (F.col("p_retailprice") - 950.0).alias("y"),
        (size > 25).cast("int").alias("y_bin"), F.expr("cast((p_size - 1) div 17 as int)").alias("y_cls"))


def labelled(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir).join(labels(spark, sf_dir), "entity", "inner")


def predictions(spark, sf_dir) -> DataFrame:
    """Row predictions of three tasks: the truth disturbed by a hash of the row."""
    rows = labelled(spark, sf_dir).select("entity", *ORDER, "y", "y_bin", "y_cls",
                                          uniform(*[F.col(c) for c in ORDER], "pred").alias("u"))
    u = F.col("u")
    is_test = hash52(F.col("entity"), "holdout") % 7 == 0
    return rows.select(
        "entity", *ORDER, F.col("y").alias("true_reg"), (F.col("y") * 0.5 + (u - 0.5) * 60.0).alias("pred_reg"),
        F.col("y_bin").alias("true_bin"), F.when(u < 0.25, 1 - F.col("y_bin")).otherwise(F.col("y_bin")).alias("pred_bin"),
        F.col("y_cls").alias("true_cls"),
        F.when(u < 0.3, (F.col("y_cls") + F.when(u < 0.15, 2).otherwise(1)) % 3).otherwise(F.col("y_cls")).alias("pred_cls"),
        ((F.col("frame") % 3) * F.lit(0.25)).alias("scr_frac"), ((F.col("frame") % 4) * F.lit(0.05)).alias("noise_level"),
        is_test.alias("is_test"),
        F.when(~is_test, (hash52(F.col("run"), "rep") % 2).cast("int")).alias("rep"),
        F.when(~is_test, (hash52(F.col("entity"), "part") % 3).cast("int")).alias("fold"))


def sequences(spark, sf_dir) -> DataFrame:
    """One 36-letter sequence per document."""
    digest = F.concat(F.md5(F.col("doc_id").cast("string")), F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("x"))))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.translate(F.substring(digest, 1, 36), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"), "n_chars")


# ---- SQL -------------------------------------------------------------------------------------

def h(*parts) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 13))::BIGINT"


def unit(*parts) -> str:
    return f"(({h(*parts)}::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def normal(*parts) -> str:
    u1, u2 = unit(*parts, "'radius'"), unit(*parts, "'angle'")
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos(6.283185307179586::DOUBLE * {u2}))"


def kept(n: str, pct: float) -> str:
    return f"greatest(1, CAST(trunc({n}::DOUBLE * ({float(pct)}::DOUBLE / 100::DOUBLE)) AS BIGINT))"


def count_of(n: str, fraction: float) -> str:
    return f"CAST(trunc({n}::DOUBLE * {float(fraction)!r}::DOUBLE) AS BIGINT)"


ORDER_SQL = ", ".join(ORDER)
CTES: dict[str, str] = {
    "frames": """SELECT l_partkey AS entity, l_orderkey AS run, l_linenumber AS frame, l_suppkey AS replica,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_discount AS discount, sqrt(l_extendedprice) AS price,
        l_quantity AS quantity, l_tax AS tax FROM lineitem""",
    "targets": """SELECT p_partkey AS entity, p_retailprice - 950.0::DOUBLE AS y, CAST(p_size > 25 AS INTEGER) AS y_bin,
        CAST((p_size - 1) // 17 AS INTEGER) AS y_cls FROM part""",
    "labelled": "SELECT * FROM frames JOIN targets USING (entity)",
    "drawn": f"SELECT *, {unit(*ORDER, chr(39) + 'pred' + chr(39))} AS u, {h('entity', chr(39) + 'holdout' + chr(39))} % 7 = 0 AS is_test FROM labelled",
    "preds": f"""SELECT entity, {ORDER_SQL}, y AS true_reg, y * 0.5::DOUBLE + (u - 0.5::DOUBLE) * 60::DOUBLE AS pred_reg,
        y_bin AS true_bin, CASE WHEN u < 0.25::DOUBLE THEN 1 - y_bin ELSE y_bin END AS pred_bin, y_cls AS true_cls,
        CASE WHEN u < 0.3::DOUBLE THEN (y_cls + CASE WHEN u < 0.15::DOUBLE THEN 2 ELSE 1 END) % 3 ELSE y_cls END AS pred_cls,
        (frame % 3) * 0.25::DOUBLE AS scr_frac, (frame % 4) * 0.05::DOUBLE AS noise_level, is_test,
        CASE WHEN NOT is_test THEN CAST({h('run', "'rep'")} % 2 AS INTEGER) END AS rep,
        CASE WHEN NOT is_test THEN CAST({h('entity', "'part'")} % 3 AS INTEGER) END AS fold FROM drawn""",
    "seqs": """SELECT doc_id, n_chars, translate(substr(md5(doc_id::VARCHAR) || md5(doc_id || '|x'), 1, 36),
        '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents""",
}
NEEDS = {"labelled": ["frames", "targets"], "drawn": ["labelled"], "preds": ["drawn"]}


def tail_cte(pct: float, source: str = "labelled", name: str = "tail", keys: str = "entity") -> dict[str, str]:
    return {f"{name}_pos": f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ORDER_SQL}) - 1 AS pos,
                count(*) OVER (PARTITION BY {keys}) AS n FROM {source}""",
            name: f"SELECT * EXCLUDE (pos, n) FROM {name}_pos WHERE pos >= n - {kept('n', pct)}"}


def blocks_cte(n: int, seed: int, source: str = "tail", label: str = "y", name: str = "blocks") -> dict[str, str]:
    means = ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
    return {f"{name}_pos": f"""SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {h(*ORDER, seed, "'block'")}, {ORDER_SQL}) - 1 AS pos,
                count(*) OVER (PARTITION BY entity) AS n FROM {source}""",
            name: f"""SELECT entity, pos // {n} AS block, {means}, arg_min({label}, pos) AS {label} FROM {name}_pos
                WHERE pos // {n} < n // {n} GROUP BY entity, pos // {n}"""}


def scaled_cte(source: str = "blocks", name: str = "scaled", keep: str = "entity, block, y") -> dict[str, str]:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATURES)
    cols = ", ".join(f"CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN {c} - m_{c} ELSE ({c} - m_{c}) / s_{c} END AS {c}" for c in FEATURES)
    return {f"{name}_stats": f"SELECT {stats} FROM {source}",
            name: f"SELECT {keep}, {cols} FROM {source} CROSS JOIN {name}_stats"}


def _closure(names):
    out: list[str] = []
    for n in names:
        for m in [*_closure(NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def sql(select: str, use: str = "", extra: dict[str, str] | None = None, rounds: str = "", digits: int = 6) -> str:
    """WITH the named shared tables and the extra ones, the select, with the given columns rounded."""
    parts = {n: CTES[n] for n in _closure(use.split())} | (extra or {})
    head = "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in parts.items()) + "\n" if parts else ""
    if rounds:
        cols = ", ".join(f"round({c}, {digits}) AS {c}" for c in rounds.split())
        select = f"SELECT * REPLACE ({cols}) FROM ({select}) AS res"
    return head + select
