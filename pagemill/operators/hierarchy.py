"""Trees of categories: all ancestors of each node, paths, and counts rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage


def ancestors(nodes: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """id, ancestor and distance (0 for the node itself) of all pairs; of several ways the shortest.

    What is known is joined with itself, so the number of joins is the logarithm of the tree's height. A node on a cycle
    is an ancestor of its own (see cyclic), and the search ends there too. Parents that are no nodes are not followed.
    """
    spark = nodes.sparkSession
    known = nodes.select(F.col(id).alias("id")).where("id IS NOT NULL").distinct()
    up = nodes.select(F.col(id).alias("id"), F.col(parent).alias("ancestor")).where("id IS NOT NULL AND ancestor IS NOT NULL").distinct()
    pairs = up.join(known.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select("id", "ancestor", F.lit(1).alias("distance"))
    before, pairs = -1, _written(spark, pairs)
    while (n := pairs.count()) != before:
        before = n
        further = pairs.alias("a").join(pairs.alias("b"), F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        pairs = _written(spark, pairs.unionByName(further).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
    return known.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).unionByName(pairs)


def _written(spark, rows: DataFrame) -> DataFrame:
    path = storage.scratch(spark, "pairs")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def cyclic(pairs: DataFrame) -> DataFrame:
    """Nodes on a cycle, or below one, among what ancestors() gives."""
    on = pairs.where("distance > 0 AND id = ancestor").select("id")
    return pairs.join(on.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select("id").distinct()


def paths(nodes: DataFrame, pairs: DataFrame, id: str = "id", name: str = "name", gap: str = " / ") -> DataFrame:
    """id, root, depth (from 0) and path of names from the root of each node; nodes on or below a cycle are left out."""
    names = nodes.select(F.col(id).alias("ancestor"), F.col(name).alias("name"))
    own = pairs.join(cyclic(pairs), "id", "left_anti").join(names, "ancestor")
    each = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "ancestor", "name")), asc=False).alias("up"))
    return each.select("id", F.col("up")[0]["ancestor"].alias("root"), (F.size("up") - 1).alias("depth"), F.concat_ws(gap, F.transform("up", lambda x: x["name"])).alias("path"))


def subtree_counts(pairs: DataFrame, records: DataFrame, category: str = "category_id") -> DataFrame:
    """id, own and whole: records of each node, and of it and all below it."""
    n = records.groupBy(F.col(category).alias("id")).agg(F.count("*").alias("n"))
    met = pairs.groupBy("id", "ancestor").agg(F.min("distance").alias("distance")).join(n, "id", "left")
    return met.groupBy(F.col("ancestor").alias("id")).agg(F.coalesce(F.sum(F.when(F.col("distance") == 0, F.col("n"))), F.lit(0)).alias("own"), F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))


def totals(records: DataFrame) -> DataFrame:
    """Records by document, category and page, with their totals by document and category, by document, and of all: level is
    the number of columns that a row is a total over."""
    out = records.rollup("document_id", "category_id", "page_number").agg(F.count("*").alias("records"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).when(F.col("g") == 3, 2).otherwise(3)
    return out.select("document_id", "category_id", "page_number", "records", level.alias("level"))
