"""Hierarchy checks: cycles of the subclass graph, the edges that close them, and two-way verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.operators.hierarchy import resolve
from ontoloom.runtime import checkpoint


def find_cycles(links: DataFrame) -> DataFrame:
    """Every cycle of (node, parent): cycle_uri (its smallest node), path (from it up to itself), n_nodes.

    The nodes whose way up never ends are cut at the smallest node of each cycle; what was the cycle is then
    the path from that node's parent to it.
    """
    looped = checkpoint(resolve(links).where("depth = -1").select("node", F.col("root").alias("cycle_uri")))
    inner = checkpoint(links.join(looped, "node"))
    cut = inner.select("node", F.when(F.col("node") != F.col("cycle_uri"), F.col("parent")).alias("parent"))
    heads = inner.where("node = cycle_uri").select("cycle_uri", F.col("parent").alias("head"))
    up = resolve(cut, with_paths=True).join(heads, F.col("node") == F.col("head"))
    path = F.concat(F.array("cycle_uri"), F.reverse("path"))
    return up.select("cycle_uri", path.alias("path"), F.size("path").alias("n_nodes"))


def closing_edges(cycles: DataFrame) -> DataFrame:
    """(child, parent) of the edge that closes each cycle: the one whose parent is the smallest node."""
    return cycles.select(F.element_at("path", -2).alias("child"), F.col("cycle_uri").alias("parent"))


def break_cycles(links: DataFrame) -> DataFrame:
    """The links without the edge that closes each cycle: (node, parent), parent null where it was cut."""
    cut = closing_edges(find_cycles(links)).select(F.col("child").alias("node"), F.lit(True).alias("_cut"))
    return links.join(cut, "node", "left").select("node", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"))


def rejected_edges(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges (child, parent) that a verdict doesn't hold as true forward and false backward; a null verdict rejects nothing."""
    bad = verdicts.where(~F.col("forward_valid") | F.col("reverse_valid")).select(F.col("child_uri").alias("child"), F.col("parent_uri").alias("parent")).distinct()
    return edges.join(bad, ["child", "parent"], "left_semi")


def two_way_filter(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The edges that no verdict rejects."""
    return edges.join(rejected_edges(edges, verdicts), ["child", "parent"], "left_anti")
