"""Property-graph lookups over nodes (id, label) and edges (source, target, relationship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def create_nodes(nodes: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The nodes with new ones (label, and a column that orders them): ids are `label:n`, n counting on within a label."""
    from pyspark.sql import Window

    last = nodes.groupBy("label").agg(F.max(F.substring_index("id", ":", -1).try_cast("long")).alias("last"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(order))
    made = new.withColumn("place", place).join(last, "label", "left")
    made = made.select(F.concat(F.lower("label"), F.lit(":"), F.coalesce(F.col("last"), F.lit(0)) + F.col("place")).alias("id"), "label")
    return nodes.select("id", "label").unionByName(made)


def create_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with those new ones whose ends exist, and the refused ones."""
    ids = nodes.select("id").distinct()
    good = new.join(ids, new["source"] == ids["id"], "left_semi").join(ids, new["target"] == ids["id"], "left_semi")
    return edges.unionByName(good), new.exceptAll(good)


def find_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.lower("label") == label.lower())


def node_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at each node, both directions added up before they meet the nodes."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out"), F.lit(0).cast("long").alias("in"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.lit(0).cast("long").alias("out"), F.count("*").alias("in"))
    both = out.unionByName(into).groupBy("id").agg(F.sum("out").alias("n_out"), F.sum("in").alias("n_in"))
    return nodes.join(both, "id", "left").select("id", "label", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those ids; edges that touch them go too."""
    ids = gone.select("id").distinct()
    left = edges.join(ids, edges["source"] == ids["id"], "left_anti").join(ids, edges["target"] == ids["id"], "left_anti")
    return nodes.join(ids, "id", "left_anti"), left
