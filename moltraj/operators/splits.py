"""Leak-free train / val / test splits by topology."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltraj.scale import fits, lookup_join, ranked

SEED = 1729
PARITY_TOPOLOGIES = 1_000_000


def topologies(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.col("cath_topology").cast("string").alias("cath_topology")).distinct()


def shuffled_by_hash(values: DataFrame, seed: int = SEED) -> DataFrame:
    """Position of each topology in a seeded order of hashes; any number of topologies, no single-task sort."""
    hashed = values.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("cath_topology"))))
    block = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    return ranked(hashed, [], block, ["_h", "cath_topology"], "pos").drop("_h")


def shuffled_as_listed(values: DataFrame, seed: int = SEED) -> DataFrame:
    """Position in the permutation that Python's seeded shuffle gives to the sorted list.

    The permutation depends only on how many topologies there are, so the driver makes that many integers and no
    topology leaves Spark. Ranks are counted by the first characters. Meant for the catalogue sizes of real datasets and refused beyond a checked bound.
    """
    if not fits(values, PARITY_TOPOLOGIES):
        raise ValueError(f"more than {PARITY_TOPOLOGIES} topologies: use the hash order")
    permutation = list(range(values.count()))
    random.Random(seed).shuffle(permutation)
    spark = values.sparkSession
    places = spark.createDataFrame(
        [(rank, pos) for pos, rank in enumerate(permutation)], "_rank bigint, pos bigint"
    )
    first = [F.ascii(F.substring("cath_topology", at, 1)).cast("long") for at in (1, 2, 3)]
    block = (first[0] * (1 << 42)) + (first[1] * (1 << 21)) + first[2]
    return ranked(values, [], block, ["cath_topology"], "_rank").join(places, "_rank").drop("_rank")


def cut(shuffled: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Fractions of the count, truncated, by position; the rest is test."""
    total = shuffled.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_train = F.floor(total * F.lit(train))
    n_val = F.floor(total * F.lit(val))
    split = F.when(F.col("pos") < n_train, "train").when(F.col("pos") < n_train + n_val, "val").otherwise("test")
    return shuffled.withColumn("split", split)


def topology_split(metadata: DataFrame, *, seed: int = SEED, order: str = "hash") -> DataFrame:
    values = topologies(metadata)
    shuffled = shuffled_by_hash(values, seed) if order == "hash" else shuffled_as_listed(values, seed)
    return cut(shuffled)


def assigned(metadata: DataFrame, topology_splits: DataFrame) -> DataFrame:
    """Every trajectory with the split of its topology."""
    keyed = metadata.withColumn("cath_topology", F.col("cath_topology").cast("string"))
    return lookup_join(
        keyed.select("traj_id", "cath_topology"),
        topology_splits.select("cath_topology", "split"),
        ["cath_topology"],
        salt_by=["traj_id"],
    )
