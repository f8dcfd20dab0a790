"""Hash trees over the rows of a table: where two tables differ is found without comparing their rows.

A row falls into one of LEAVES ranges of its key's hash. A node of the tree holds the number of rows below it and two
independent sums of 64-bit row hashes, kept in full width, so repeated rows don't cancel. Sums of children are the
parent's sums, so a tree is one aggregation of the table and some thousand rows. A comparison goes down from the root and follows
only nodes that differ; rows are read from the ranges that it ends in, which a stored copy holds apart, sorted by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import artifacts

#: Children of a node, and levels below the root.
FAN, DEPTH = 16, 3
LEAVES = FAN**DEPTH


def range_of(key: str) -> Column:
    """The leaf range of a key (any type; null is a key)."""
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(LEAVES)).cast("int")


def tree(frame: DataFrame, key: str) -> DataFrame:
    """(level, node, n, a, b) of all nodes that have rows: level 0 is the root, level DEPTH has the ranges."""
    columns = [F.col(c) for c in sorted(frame.columns)]
    own = lambda seed: F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")
    rows = frame.select(range_of(key).alias("leaf"), own(2).alias("a"), own(3).alias("b"))
    leaves = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))
    above = F.array(*(F.struct(F.lit(d).alias("level"), (F.col("leaf") / FAN ** (DEPTH - d)).cast("int").alias("node")) for d in range(DEPTH + 1)))
    nodes = leaves.select(F.explode(above).alias("x"), "n", "a", "b").select("x.*", "n", "a", "b")
    return nodes.groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))


def differing(one: DataFrame, other: DataFrame) -> list[int]:
    """Ranges whose rows differ between two trees, found level by level below nodes that differ."""
    open_nodes = [0]
    for level in range(DEPTH + 1):
        at = (F.col("level") == level) & F.col("node").isin(open_nodes)
        a, b = (t.where(at).select("node", *(F.col(c).alias(f"{c}{i}") for c in ("n", "a", "b"))) for i, t in enumerate((one, other)))
        same = F.col("n0").eqNullSafe(F.col("n1")) & F.col("a0").eqNullSafe(F.col("a1")) & F.col("b0").eqNullSafe(F.col("b1"))
        wrong = sorted(r.node for r in a.join(b, "node", "full").where(~same).select("node").collect())
        if not wrong or level == DEPTH:
            return wrong
        open_nodes = [FAN * x + i for x in wrong for i in range(FAN)]
    return []


def publish(frame: DataFrame, root: str, key: str, **facts) -> None:
    """A version at root whose rows lie in files by range, and its tree beside it."""
    spark, spread = frame.sparkSession, [c for c in ("key_range",) if c not in frame.columns]
    if not spread:
        raise ValueError("the table has a column key_range")
    laid_out = frame.withColumn("key_range", range_of(key)).repartitionByRange("key_range", key).sortWithinPartitions("key_range", key)
    staged = artifacts.stage(laid_out, root, kind="ranged", key=key, **facts)
    tree(spark.read.parquet(f"{root}/{staged['version']}").drop("key_range"), key).coalesce(1).write.parquet(f"{root}/{staged['version']}-tree")
    artifacts.point(spark, root, staged)


def stored_tree(spark, root: str) -> DataFrame:
    version, _ = artifacts.manifest(spark, root)
    return spark.read.parquet(f"{root}/{version}-tree")


def changes(frame: DataFrame, root: str) -> tuple[DataFrame, list[int]]:
    """((key, change) of rows that are new, gone or changed against the version at root, the ranges that were read for it).

    Rows are compared as sets for each key. The stored rows are read from the differing ranges only.
    """
    spark = frame.sparkSession
    _, facts = artifacts.manifest(spark, root)
    key = facts["key"]
    ranges = differing(tree(frame, key), stored_tree(spark, root))
    mark = lambda rows, name: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(F.xxhash64(F.lit(i), *sorted(c for c in frame.columns)) for i in (2, 3))))).alias(name))
    now = mark(frame.where(range_of(key).isin(ranges)), "now")
    had = mark(artifacts.load(spark, root).where(F.col("key_range").isin(ranges)).drop("key_range"), "had").withColumnRenamed(key, "_key")
    both = now.join(had, F.col(key).eqNullSafe(F.col("_key")) & (F.col("now").isNotNull()), "full")
    what = F.when(F.col("had").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("had"), "changed")
    found = both.select(F.when(F.col("now").isNull(), F.col("_key")).otherwise(F.col(key)).alias(key), what.alias("change")).where("change is not null")
    return found, ranges
