"""Label scrambling and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecv.catalog.base import KEY, ORDER, SEED, count_of, h, labelled, normal, query, rounded, sql
from framecv.catalog.splits import ENTITIES, ranked
from framecv.functions.scalars import fraction_tag, percent_tag
from framecv.operators.perturb import add_label_noise, flipped_labels, scramble_labels, scrambled_labels


def _scrambled(fraction: float, minimum: int, seed: int) -> dict[str, str]:
    chosen = f"rank < greatest({count_of('n', fraction)}, {minimum}) AND n > 1"
    donor = f"(rank + 1 + {h('entity', seed, chr(39) + 'donor' + chr(39))} % greatest(n - 1, 1)) % n"
    return ENTITIES | ranked("scramble", seed) | {
        "takers": f"SELECT entity, rank, CASE WHEN {chosen} THEN {donor} ELSE rank END AS donor FROM ranked",
        "given": "SELECT t.entity, d.y, t.donor <> t.rank AS scrambled FROM takers t JOIN ranked d ON d.rank = t.donor"}


@query(sql("SELECT entity, y, scrambled FROM given", "labelled", _scrambled(0.25, 0, 11), "y"))
def scrambled_entity_labels(spark, sf_dir):
    return rounded(scrambled_labels(labelled(spark, sf_dir), KEY, "y", 0.25, 11))


@query(sql("SELECT entity, given.y AS y, count(*) AS n FROM labelled JOIN given USING (entity) GROUP BY ALL", "labelled",
           _scrambled(1.0, 0, 11), "y"))
def fully_scrambled_rows(spark, sf_dir):
    rows = scramble_labels(labelled(spark, sf_dir), KEY, "y", 1.0, 11)
    return rounded(rows.groupBy("entity", "y").agg(F.count("*").alias("n")))


@query(sql("SELECT entity, y, scrambled FROM given", "labelled", _scrambled(0.00001, 1, 5), "y"))
def scrambled_at_least_one(spark, sf_dir):
    return rounded(scrambled_labels(labelled(spark, sf_dir), KEY, "y", 0.00001, 5, min_count=1))


@query(sql(f"""SELECT entity, {', '.join(ORDER)}, y + {normal(*ORDER, 9, "'noise'")} * 0.2::DOUBLE * s AS y
    FROM labelled CROSS JOIN (SELECT stddev_pop(y) AS s FROM labelled)""", "labelled", rounds="y"))
def gaussian_label_noise(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("entity", *ORDER, "y")
    return rounded(add_label_noise(rows, KEY, "y", 0.2, 9, "reg", ORDER))


@query(sql(f"SELECT entity, CASE WHEN rank < greatest({count_of('n', 0.1)}, 1) THEN 1 - y_bin ELSE y_bin END AS y_bin, "
           f"rank < greatest({count_of('n', 0.1)}, 1) AS flipped FROM ranked", "labelled", ENTITIES | ranked("flip", 9)))
def binary_label_flips(spark, sf_dir):
    return flipped_labels(labelled(spark, sf_dir), KEY, "y_bin", 0.1, 9, "bin")


_OTHERS = {"classes": "SELECT list_sort(list(DISTINCT y_cls)) AS c FROM labelled",
           "chances": "SELECT *, list_filter(c, lambda v: v <> y_cls) AS others FROM ranked CROSS JOIN classes"}


@query(sql(f"""SELECT y_cls, count(*) AS n FROM (SELECT l.entity, CASE WHEN rank < greatest({count_of('n', 0.3)}, 1)
    THEN others[{h('l.entity', 9, "'class'")} % greatest(len(others), 1) + 1] ELSE c.y_cls END AS y_cls
    FROM labelled l JOIN chances c ON l.entity = c.entity) GROUP BY y_cls""",
           "labelled", ENTITIES | ranked("flip", 9) | _OTHERS))
def multiclass_label_flips(spark, sf_dir):
    """A flipped entity takes one of the other classes; counted over the rows."""
    rows = add_label_noise(labelled(spark, sf_dir), KEY, "y_cls", 0.3, 9, "mclass")
    return rows.groupBy("y_cls").agg(F.count("*").alias("n"))


@query("""SELECT l_discount AS level, 'scr' || replace(printf('%.2f', l_discount), '.', 'p') AS scr_tag,
    'noi' || printf('%02d', CAST(trunc(l_discount * 100.0::DOUBLE) AS INTEGER)) AS noise_tag,
    'sub' || printf('%02d', CAST(trunc(l_discount * 100.0::DOUBLE) AS INTEGER)) AS sub_tag, count(*) AS n FROM lineitem GROUP BY l_discount""")
def level_tags(spark, sf_dir):
    """Tags of the sweep levels, truncated in double arithmetic (0.29 gives 28)."""
    from framecv.catalog.base import table
    level = F.col("level")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_discount").alias("level")).agg(F.count("*").alias("n"))
    return rows.select("level", F.concat(F.lit("scr"), fraction_tag(level)).alias("scr_tag"),
                       percent_tag("noi", level).alias("noise_tag"), percent_tag("sub", level).alias("sub_tag"), "n")
