"""Connected components by repeated contraction; every step is a join, nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written


def contract(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (t, c), with edges (a, b) between values of t taken in: t, c with c equal within a component.

    Each step hooks every label to its least neighbour, follows one more pointer and renames the edges;
    at least half of the labels that still have edges vanish in a step. Hubs are met by map-side
    minima and by joins, which may be split where a label has very many edges.
    """
    left = labels.select(F.col("t").alias("a"), F.col("c").alias("ca"))
    right = labels.select(F.col("t").alias("b"), F.col("c").alias("cb"))
    open_edges = written(edges.join(left, "a").join(right, "b").where("ca <> cb").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct())
    while not open_edges.isEmpty():
        both = open_edges.unionByName(open_edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = written(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        jump = written(hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")))
        labels = written(labels.join(jump, labels.c == jump.u, "left").select("t", F.coalesce("p", "c").alias("c")))
        renamed = open_edges.join(jump.withColumnRenamed("p", "pu"), "u").join(jump.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        open_edges = written(renamed.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    return labels
