"""Writing the processed store: features, metadata, manifests and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.operators.packed import unpacked
from moltraj.schema import FRAME_KEY, TRAJECTORY_KEY

FRAMES_PER_FILE_GROUP = 4096
ROW_GROUP_BYTES = 4 << 20


def save_mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def guard(spark: SparkSession, path: str, force: bool) -> None:
    """Refuse to write where a finished result is, unless forced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if found and not force:
        raise FileExistsError(f"{path} holds a finished result; use force=True to replace it")


def write_frames(packed: DataFrame, path: str, *, force: bool = False) -> None:
    """The frame store as Parquet: one row a frame with its residues as arrays, one folder per domain, rows in
    (trajectory, frame) order.

    Rows are distributed by trajectory and frame block, not by domain alone, so a large domain is written by many
    tasks as several files. Row groups are small, so that their statistics lead a reader of a few frames to a few groups.
    """
    block = F.floor(F.col("frame") / F.lit(FRAMES_PER_FILE_GROUP))
    placed = packed.withColumn("_block", block).repartition(*TRAJECTORY_KEY, "_block").drop("_block")
    (
        placed.sortWithinPartitions(*FRAME_KEY).write.mode(save_mode(force)).option("compression", "zstd")
        .option("parquet.block.size", str(ROW_GROUP_BYTES)).partitionBy("domain_id").parquet(path)
    )


def read_frames(spark: SparkSession, out: str) -> DataFrame:
    """The packed frames of a finished store."""
    return spark.read.parquet(f"{out}/frames")


def read_features(spark: SparkSession, out: str) -> DataFrame:
    """The store as one row per frame and residue."""
    return unpacked(read_frames(spark, out))


def write_table(df: DataFrame, path: str, *, force: bool = False) -> None:
    df.write.mode(save_mode(force)).parquet(path)


def write_lines(lines: DataFrame, path: str, *, force: bool = False) -> None:
    """One JSON document per line. Documents stay per row, so a long manifest is many lines and many files."""
    lines.write.mode(save_mode(force)).text(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Every row as one JSON object with its keys in name order."""
    names = sorted(df.columns)
    return df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))
