"""Content hashes of trajectories and of a whole dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltraj.schema import TRAJECTORY_KEY

FAN_OUT = 1024
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def joined_digest(order: Column, digest: Column) -> Column:
    """SHA-256 over the digests of a group in the given order."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), digest.alias("d"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda item: item["d"]), ""), 256)


def trajectory_digests(frames: DataFrame, *, fan_out: int = FAN_OUT, keys: Sequence[str] = TRAJECTORY_KEY) -> DataFrame:
    """Hash tree over (keys, frame, digest): blocks of `fan_out` frames, blocks of blocks, then the trajectory.

    No task ever holds more than `fan_out` digests of a level, and the last level holds frames / fan_out**2 of them,
    so one very long trajectory is hashed by many tasks.
    """
    level = frames.select(*keys, F.col("frame").cast("bigint").alias("_at"), "digest")
    for _ in range(2):
        level = (
            level.withColumn("_up", F.floor(F.col("_at") / F.lit(fan_out)))
            .groupBy(*keys, "_up")
            .agg(joined_digest(F.col("_at"), F.col("digest")).alias("digest"))
            .withColumnRenamed("_up", "_at")
        )
    return level.groupBy(*keys).agg(joined_digest(F.col("_at"), F.col("digest")).alias("content_hash"))


def flat_dataset_hash(digests: DataFrame, column: str = "content_hash") -> DataFrame:
    """SHA-256 of all digests, sorted and concatenated, copies kept. Needs the digests of one dataset in one group."""
    ordered = F.array_sort(F.collect_list(column))
    return digests.agg(F.sha2(F.array_join(ordered, ""), 256).alias("dataset_hash"))


def tree_dataset_hash(digests: DataFrame, column: str = "content_hash") -> DataFrame:
    """Order-independent dataset hash for any number of trajectories, copies counted.

    Equal digests are first reduced to (digest, copies), which keeps a group of copies small; the rest is spread by
    digest prefix, and prefixes are hashed in order.
    """
    counted = digests.groupBy(F.col(column).alias("_d")).agg(F.count(F.lit(1)).alias("copies"))
    level = counted.select("_d", F.concat_ws("*", "_d", F.col("copies").cast("string")).alias("digest"))
    for width in (6, 3, 0):
        level = (
            level.withColumn("_p", F.substring("_d", 1, width))
            .groupBy("_p")
            .agg(joined_digest(F.col("_d"), F.col("digest")).alias("digest"))
            .withColumnRenamed("_p", "_d")
        )
    return level.select(F.col("digest").alias("dataset_hash"))


def dataset_hash(digests: DataFrame, column: str = "content_hash", *, layout: str = "tree") -> DataFrame:
    """One definition at every size: the tree. The flat layout only for callers that name it."""
    return flat_dataset_hash(digests, column) if layout == "flat" else tree_dataset_hash(digests, column)
