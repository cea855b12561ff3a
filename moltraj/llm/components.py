"""Connected components by alternating stars, as joins and aggregates only.

First every node points at its smallest neighbour; what that leaves to connect are distinct pairs of pointed-at nodes,
which are few where many nodes share neighbours. On these, every round makes each node point at the smallest node it
has heard of, first from the larger neighbours, then from the smaller ones; the number of rounds grows with the
logarithm of the longest chain. Each round is written to the shared folder, so a lost executor costs one round and the
plan stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltraj.llm.shared import written


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def lowered(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """The lower ends of each node's edges, pointed at the lowest of them."""
    below = (edges["u"] == lowest["n"]) & (edges["v"] != lowest["m"])
    return edges.join(lowest, below).select(F.col("v").alias("u"), F.col("m").alias("v"))


def lowest_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")


def stars(edges: DataFrame) -> DataFrame:
    """u, v: each node but the smallest of its component, and that smallest. `edges` is written, with u > v."""
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = lowest_of(both).select("n", F.least("n", "m").alias("m"))
        large = both.join(smallest, (both["u"] == smallest["n"]) & (both["v"] > both["u"])).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = lowest_of(large)
        edges = written(lowered(large, lowest).unionByName(lowest.toDF("u", "v")).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node of `links` (columns a and b) that is not the smallest of its component.

    Nodes of any orderable type; links in either direction, repeated or of a node to itself are allowed, those with a
    null end are ignored. An empty table gives an empty result.
    """
    edges = written(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    parents = written(lowest_of(edges))
    others = lowered(edges, parents).distinct()
    pointed = parents.select(F.col("m").alias("p")).unionByName(others.select(F.col("u").alias("p"))).distinct()
    inner = parents.join(pointed, parents["n"] == pointed["p"], "left_semi").toDF("u", "v")
    core = stars(written(others.unionByName(inner).distinct()))
    leaves = parents.join(core.select(F.col("u").alias("c")), F.col("n") == F.col("c"), "left_anti")
    ends = leaves.join(core, leaves["m"] == core["u"], "left").select(F.col("n").alias("node"), F.coalesce("v", "m").alias("root"))
    return ends.unionByName(core.toDF("node", "root"))
