"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, join_by_key, stored


def _least(edges: DataFrame) -> DataFrame:
    """u, least neighbour or u itself, number of u's edges (map-side combined)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))


def _with_least(edges: DataFrame, most: int, total: int) -> DataFrame:
    """u, v, m of ``_least``. A hub's edges meet its one row by broadcast, never in one task;
    where no node has many edges, they are dealt out by node once, without a join."""
    if few(most, total):
        return edges.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), F.col("u")))
    return join_by_key(edges, _least(edges), "u", "n", total)


def stars(edges: DataFrame) -> tuple[DataFrame, int]:
    """((u, v), largest number of edges of a node): every node of ``edges`` (u, v) but the
    least of its component once as u, with that least node as v. A round shrinks every
    component's depth by a constant factor; its edges are stored in the shared folder.
    It is the last once all nodes with a lesser neighbour have that one neighbour only."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mark = _least(both).agg(F.count_if(F.expr("m < u AND n > 1")).alias("open"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
        if not mark["open"]:
            return now, mark["most"] or 0
        large = stored(_with_least(both, mark["most"], mark["n"]).where("v > u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # every edge now leads from the larger node u down to v; no node has more of them than it had edges
        now = stored(_with_least(large, mark["most"], mark["n"] // 2)
                     .selectExpr("inline(filter(array(struct(u, m AS v), struct(v AS u, m AS v)), e -> e.u <> e.v))").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the least node
    that it is connected with."""
    return with_roots(stars(edges)[0])


def with_roots(links: DataFrame) -> DataFrame:
    """(node, root) of ``stars``' edges."""
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
