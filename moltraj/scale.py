"""Building blocks that keep every task small when one key holds a large share of the rows.

A plain window over a trajectory, or a plain shuffle join on a domain, puts all rows of that key into one task.
The helpers here split a key into blocks of its order column, aggregate per block, and stitch the blocks together
with a small table, so the largest unit of work is a block and never a whole key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 4096
SALTS = 32
BROADCAST_ROWS = 200_000
BROADCAST_ENTRIES = 2_000_000


def fits(df: DataFrame, max_rows: int, weight: Column | None = None) -> bool:
    """True when `df` has at most `max_rows` rows, or entries when `weight` counts the entries of a row."""
    if weight is None:
        return df.limit(max_rows + 1).count() <= max_rows
    return (df.agg(F.sum(weight)).first()[0] or 0) <= max_rows


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    salt_by: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    known_rows: int | None = None,
    weight: Column | None = None,
    probe: bool = True,
) -> DataFrame:
    """Join a large table to a lookup table.

    The lookup side is broadcast only when its row count was checked: from `known_rows` if the caller has counted a
    cheaper table of the same length, else by counting up to the bound (entries, where `weight` sizes a row). Beyond that, or without `probe`, both sides
    shuffle on the key plus a salt taken from `salt_by`, so a key that holds a third of `big` is spread over `salts`
    tasks; adaptive execution may still broadcast a side it has measured.
    """
    small_enough = known_rows <= max_rows if known_rows is not None else probe and fits(small, max_rows, weight)
    if small_enough:
        return big.join(F.broadcast(small), list(on), how)
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    return salted_big.join(salted_small, [*on, "_salt"], how).drop("_salt")


def running_total(
    df: DataFrame,
    group: Sequence[str],
    block: Column,
    order: Sequence[str | Column],
    value: Column,
    name: str,
) -> DataFrame:
    """Sum of `value` over the rows before this one in its group (0 for the first), without a per-group task.

    `block` must not decrease along `order`; it bounds how many rows one task sorts. Group columns must not be NULL.
    """
    keys = [*group, "_block"]
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    totals = blocked.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        local.join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_block", "_value", "_local", "_before")
    )


def ranked(
    df: DataFrame,
    group: Sequence[str],
    block: Column,
    order: Sequence[str | Column],
    name: str,
    *,
    start: int = 0,
) -> DataFrame:
    """Exact dense position (row_number - 1 + start) in each group, split by `block` as in `running_total`."""
    positioned = running_total(df, group, block, order, F.lit(1), name)
    return positioned.withColumn(name, F.col(name) + F.lit(start))


def with_halo(df: DataFrame, position: str, reach: int, width: int = BLOCK) -> DataFrame:
    """Give each block of `position` also the first `reach` rows of the blocks after it.

    Adds `_block` and `_home`; each input row is home in exactly one block. A look-ahead of at most `reach`
    positions is then local to (group, _block), with a copy rate of about reach / width.
    """
    width = max(width, reach)
    pos = F.col(position)
    home = F.floor(pos / F.lit(width))
    first = F.greatest(F.floor((pos - F.lit(reach)) / F.lit(width)), F.lit(0))
    return (
        df.withColumn("_own", home)
        .withColumn("_block", F.explode(F.sequence(first, F.col("_own"))))
        .withColumn("_home", F.col("_block") == F.col("_own"))
        .drop("_own")
    )


def look_ahead(
    df: DataFrame, group: Sequence[str], position: str, steps: int, columns: dict[str, str], width: int = BLOCK
) -> DataFrame:
    """`lead` by `steps` over gap-free positions, for groups of any length."""
    order = Window.partitionBy(*group, "_block").orderBy(position)
    shifted = with_halo(df, position, steps, width).select(
        "*", *[F.lead(source, steps).over(order).alias(target) for source, target in columns.items()]
    )
    return shifted.filter("_home").drop("_block", "_home")


def look_back(
    df: DataFrame, group: Sequence[str], position: str, steps: int, columns: dict[str, str], width: int = BLOCK
) -> DataFrame:
    """`lag` by `steps` over gap-free positions, for groups of any length."""
    width = max(width, steps)
    pos = F.col(position)
    spread = (
        df.withColumn("_own", F.floor(pos / F.lit(width)))
        .withColumn("_block", F.explode(F.sequence(F.col("_own"), F.floor((pos + F.lit(steps)) / F.lit(width)))))
        .withColumn("_home", F.col("_block") == F.col("_own"))
    )
    order = Window.partitionBy(*group, "_block").orderBy(position)
    shifted = spread.select(
        "*", *[F.lag(source, steps).over(order).alias(target) for source, target in columns.items()]
    )
    return shifted.filter("_home").drop("_block", "_home", "_own")


def value_block(df: DataFrame, value: str, parts: int = 64, steps: int = 1024) -> Column:
    """A block number that grows with a numeric `value`: sampled quantile intervals, each cut into equal steps.

    Cuts only balance the blocks; results built on the blocks stay exact. Equal values share a block, so aggregate
    ties first. The quantile sketch runs as one small job, and its cuts become a balanced comparison tree.
    """
    levels = F.array(*[F.lit(i / parts) for i in range(parts + 1)])
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), levels, F.lit(1000)).alias("cuts")).first()["cuts"]
    cuts = sorted({cut for cut in found or [] if abs(cut) < float("inf")})
    v = f"CAST({value} AS DOUBLE)"

    def step(interval: int) -> str:
        if not 0 < interval < len(cuts):
            return str(interval * steps)
        low, high = cuts[interval - 1], cuts[interval]
        inside = f"least(floor(({v} - DOUBLE('{low!r}')) / DOUBLE('{high - low!r}') * {steps}), {steps - 1})"
        return f"{interval * steps} + {inside}"

    def tree(low: int, high: int) -> str:
        if low == high:
            return step(low)
        middle = (low + high) // 2
        return f"if({v} < DOUBLE('{cuts[middle]!r}'), {tree(low, middle)}, {tree(middle + 1, high)})"

    return F.expr(f"CAST({tree(0, len(cuts))} AS BIGINT)")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the reliable checkpoint folder so iterations do not grow the plan.

    The folder is the session's spark.checkpoint.dir. It is set here only for local masters that have none.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def working_folder(spark: SparkSession) -> str:
    """A new folder name below the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
