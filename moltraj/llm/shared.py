"""What the operators share: tables, Arrow maps, and intermediate tables in the folder all executors see."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.scale import ensure_checkpoint_dir

#: Folders written by `written`, for `forget`.
WRITTEN: list[str] = []
#: Spark's setting by which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes, empty where it is null; Python then takes it without decoding."""
    return F.encode(text_or_empty(column), "UTF-8")


def arrow_map(df: DataFrame, convert: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One Arrow batch in, one out, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield convert(batch)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the session's spark.checkpoint.dir, which all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/moltraj-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in the block go as each ends, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(df: DataFrame) -> Iterator[DataFrame]:
    """`df` as by `written`, deleted at the end of the block: for what is written again there in the form that is kept."""
    rows, path = written(df), WRITTEN[-1]
    yield rows
    WRITTEN.remove(path)
    deleted(df.sparkSession, path)


def forget(spark: SparkSession) -> None:
    """Delete what `written` has left, once no result that reads it is needed any more."""
    for path in WRITTEN:
        deleted(spark, path)
    WRITTEN.clear()
