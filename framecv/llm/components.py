"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framecv.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) to (id, component): component is the smallest id that can be reached. Ids in no link are absent.

    Alternating large and small stars: each round hangs the neighbours of an id below its smallest neighbour. The
    smallest neighbours are found with a map-side combine and joined back, so an id with very many links is a
    skewed join key that Spark splits. Links are written to the shared folder after each round. Null ends and
    links from an id to itself are left out.
    """
    def directed(df):
        return df.where("a > b")

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a > b and a is not null and b is not null").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(directed(large.distinct()))
        low = materialize(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(directed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
