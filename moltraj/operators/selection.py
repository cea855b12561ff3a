"""Ranking and choosing trajectories to continue."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltraj.functions.numeric import draw_below
from moltraj.scale import BLOCK, BROADCAST_ROWS, cut_lineage, look_back, lookup_join, ranked, running_total, value_block

# Share of random picks, largest share of one trajectory, weights of spread and of rarity.
RANDOM_FLOOR = 0.05
TRAJECTORY_SHARE = 0.25
KAPPA = 1.0
RARITY = 1.0
SALTS = 16


def acquisition(candidates: DataFrame, visits: DataFrame, region: str, kappa: float = KAPPA, c: float = RARITY) -> DataFrame:
    """mean + kappa * spread + c * sqrt(ln t / visits of the candidate's region), t being all visits."""
    visits = cut_lineage(visits)
    total = visits.agg(F.sum("n_visits").alias("t")).scalar()
    joined = lookup_join(candidates, visits, [region], "left", salt_by=["traj_index"])
    rarity = F.sqrt(F.ln(total) / F.greatest(F.coalesce("n_visits", F.lit(0)), F.lit(1)))
    return joined.withColumn("score", F.col("mean") + kappa * F.col("spread") + c * rarity)


#: Axes whose cells find candidates; the distance is over all axes.
GRID_AXES = 2
#: Hash tables, projections a table and bucket width in radii of the approximate search.
TABLES, PROJECTIONS, BUCKET = 12, 2, 6.0


def distinct_places(archive: DataFrame, axes: Sequence[str]) -> DataFrame:
    """`_at`, an array of all coordinates, and how often it occurs."""
    return archive.select(F.array(*[F.col(axis).cast("double") for axis in axes]).alias("_at")).groupBy("_at").agg(F.count(F.lit(1)).alias("_copies"))


def squared_gap(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, g: total + g)


def visits_within(
    queries: DataFrame, archive: DataFrame, key: str, axes: Sequence[str], radius: float, *, grid_axes: int = GRID_AXES
) -> DataFrame:
    """Number of archived points within a radius of each query point, on any number of named coordinates.

    Copies of a point are counted first. Candidates are found on the first few axes only, by grid cells of the radius'
    width, so that a query looks into 3^grid_axes cells however many axes there are; the distance is exact over all. A
    full cell is salted so that its points spread over tasks.
    """
    grid = range(min(grid_axes, len(axes)))
    places = distinct_places(archive, axes)
    cells = places.select(
        "_at", "_copies", F.pmod(F.xxhash64("_at"), F.lit(SALTS)).cast("int").alias("_salt"),
        *[F.floor(F.col("_at")[i] / radius).alias(f"_cell_{i}") for i in grid],
    )
    looking = queries.select(key, F.array(*[F.col(axis).cast("double") for axis in axes]).alias("_from"))
    looking = looking.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for i in grid:
        low, high = F.floor((F.col("_from")[i] - radius) / radius), F.floor((F.col("_from")[i] + radius) / radius)
        looking = looking.withColumn(f"_cell_{i}", F.explode(F.sequence(low, high)))
    near = looking.join(cells, [*[f"_cell_{i}" for i in grid], "_salt"]).filter(squared_gap("_from", "_at") <= radius * radius)
    counted = near.groupBy(key).agg(F.sum("_copies").alias("n_visits"))
    return queries.select(key).join(counted, key, "left").withColumn("n_visits", F.coalesce("n_visits", F.lit(0)))


def directions(dims: int, tables: int, projections: int, seed: int = 0) -> list[list[tuple[list[float], float]]]:
    """Seeded unit vectors of each table with an offset in buckets, rounded so that they read the same in any engine."""
    draws = np.random.default_rng(seed)
    axes, shifts = draws.normal(size=(tables, projections, dims)), np.round(draws.random((tables, projections)), 6)
    axes = np.round(axes / np.linalg.norm(axes, axis=2, keepdims=True), 6)
    return [[(axis.tolist(), float(shift)) for axis, shift in zip(*table)] for table in zip(axes, shifts)]


def visits_within_hashed(
    queries: DataFrame, archive: DataFrame, key: str, axes: Sequence[str], radius: float, *, tables: int = TABLES,
    projections: int = PROJECTIONS, bucket: float = BUCKET, seed: int = 0,
) -> DataFrame:
    """The same count by random-projection hashing: a point counts if it shares a bucket of any table with the query.

    Every distance is checked, so counts are never too high; points that share no bucket are missed. Buckets are
    BUCKET radii wide, so that a pair at the radius parts in one projection with a chance of about 1 / BUCKET.
    """
    chosen = directions(len(axes), tables, projections, seed)

    def hashed(at: str) -> Column:
        def step(direction: list[float], shift: float) -> Column:
            product = F.aggregate(F.zip_with(at, F.array(*[F.lit(x) for x in direction]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            return F.floor(product / F.lit(bucket * radius) + F.lit(shift))

        return F.array(*[F.struct(*[step(*d).alias(f"h{i}") for i, d in enumerate(table)]) for table in chosen])

    places = distinct_places(archive, axes).withColumn("_place", F.xxhash64("_at"))
    held = places.select("_at", "_place", "_copies", F.posexplode(hashed("_at")).alias("_table", "_bucket"))
    held = held.withColumn("_salt", F.pmod(F.col("_place"), F.lit(SALTS)).cast("int"))
    looking = queries.select(key, F.array(*[F.col(axis).cast("double") for axis in axes]).alias("_from"))
    looking = looking.select(key, "_from", F.posexplode(hashed("_from")).alias("_table", "_bucket"))
    looking = looking.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = looking.join(held, ["_table", "_bucket", "_salt"]).filter(squared_gap("_from", "_at") <= radius * radius)
    counted = near.select(key, "_at", "_copies").distinct().groupBy(key).agg(F.sum("_copies").alias("n_visits"))
    return queries.select(key).join(counted, key, "left").withColumn("n_visits", F.coalesce("n_visits", F.lit(0)))


def top_of_each(rows: DataFrame, order: Sequence[str | Column], most: int) -> DataFrame:
    """The first `most` rows of every traj_id, with their place `_n`: first of each salt, then of the trajectory."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    for keys in (["traj_id", "_salt"], ["traj_id"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("_n", place).filter(F.col("_n") <= most)
    return salted.drop("_salt")


def budgeted(
    candidates: DataFrame, budget: int, *, epsilon: float = RANDOM_FLOOR, share: float = TRAJECTORY_SHARE, seed: int = 0
) -> DataFrame:
    """Pick `budget` of (traj_id, item, score): a seeded random floor, then by score, never above one trajectory's share.

    Both steps are top-k queries: ranks within a trajectory are cut at the share before rows are shuffled, and the
    picked rows never exceed the budget.
    """
    n_random, cap = math.ceil(epsilon * budget), max(1, math.floor(share * budget))
    chance = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item").cast("string")))
    drawn = candidates.withColumn("_h", chance)
    lucky = (
        top_of_each(drawn, ["_h", "item"], cap)
        .orderBy("_h", "item").limit(n_random).select("traj_id", "item", "score", F.lit("random").alias("reason"))
    )
    used = lucky.groupBy("traj_id").agg(F.count(F.lit(1)).alias("_used"))
    small = F.broadcast if budget <= BROADCAST_ROWS else lambda df: df
    rest = candidates.join(small(lucky.select("item")), "item", "left_anti")
    best = top_of_each(rest, [F.desc("score"), "item"], cap)
    best = best.join(small(used), "traj_id", "left").filter(F.col("_n") <= cap - F.coalesce("_used", F.lit(0)))
    greedy = best.orderBy(F.desc("score"), "item").limit(budget - n_random)
    return lucky.unionByName(greedy.select("traj_id", "item", "score", F.lit("score").alias("reason")))


def positions(rows: DataFrame, value: str, tie: str, name: str, *, start: int = 1) -> DataFrame:
    """Exact position of each row by (value, tie), without a single-task sort.

    Distinct values are placed in quantile blocks and equal values are numbered among themselves in blocks of the
    integer tie column, so neither a long list nor a heavily shared value lands in one task. The rows, one per
    trajectory, are materialised because they are read three times. Rows without a value come last, by the tie column.
    """
    every = cut_lineage(rows)
    rows, bare = every.filter(F.col(value).isNotNull()), every.filter(F.col(value).isNull())
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_copies"))
    below = running_total(counted, [], value_block(rows, value), [value], F.col("_copies"), "_less").select(value, "_less")
    among = ranked(rows, [value], F.floor(F.col(tie) / BLOCK), [tie], "_among")
    placed = lookup_join(among, below, [value], salt_by=[tie], probe=False)
    placed = placed.withColumn(name, F.col("_less") + F.col("_among") + start).drop("_less", "_among")
    behind = rows.agg(F.count(F.lit(1)).alias("n")).scalar() + start
    last = ranked(bare, [], F.floor(F.col(tie) / BLOCK), [tie], "_among").withColumn(name, behind + F.col("_among")).drop("_among")
    return placed.unionByName(last)


def round_robin(metadata: DataFrame) -> DataFrame:
    """Least-served trajectory first."""
    return positions(metadata.select("traj_index", "n_frames"), "n_frames", "traj_index", "place")


def random_with_replacement(metadata: DataFrame, n_picks: int, seed: int = 0) -> DataFrame:
    block = F.floor(F.col("traj_index") / BLOCK)
    numbered = ranked(metadata.select("traj_index"), [], block, ["traj_index"], "_slot")
    total = metadata.agg(F.count(F.lit(1)).alias("n")).scalar()
    picks = metadata.sparkSession.range(n_picks).select(
        F.col("id").alias("pick"), draw_below(total, seed, F.col("id")).alias("_slot")
    )
    return picks.join(numbered, "_slot").select("pick", "traj_index")


def rmsd_velocity(frames: DataFrame, run: str, rmsd: str, frame_ps: float) -> DataFrame:
    """Trajectories by how fast their RMSD moved at the last frame, fastest first; those of one frame have no speed and
    come last.
    """
    moved = look_back(frames.select(run, "frame", rmsd), [run], "frame", 1, {rmsd: "_before"})
    speed = F.abs(F.col(rmsd) - F.col("_before")) / F.lit(frame_ps)
    latest = moved.groupBy(run).agg(F.max_by(speed, F.when(F.col("_before").isNotNull(), F.col("frame"))).alias("velocity"))
    return positions(latest.withColumn("_v", -F.col("velocity")), "_v", run, "place").drop("_v")


def distance_to_known(latest: DataFrame, run: str, axes: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """Trajectories by distance of their last frame to the nearest discovered state, farthest first.

    The centres of discovered states are few and given as values.
    """
    gaps = [
        sum((F.pow(F.col(axis) - F.lit(float(at)), F.lit(2)) for axis, at in zip(axes, centre, strict=True)), F.lit(0.0))
        for centre in centres
    ]
    nearest = F.sqrt(F.least(*gaps) if len(gaps) > 1 else gaps[0])
    ranked_rows = latest.select(run, nearest.alias("distance")).withColumn("_v", -F.col("distance"))
    return positions(ranked_rows, "_v", run, "place").drop("_v")


def rare_states(latest: DataFrame, counts: DataFrame, run: str, state: str) -> DataFrame:
    """Trajectories by how rarely their current state was visited; a state without visits is the rarest, with weight 1."""
    weighed = lookup_join(latest.select(run, state), counts, [state], "left", salt_by=[run])
    weighed = weighed.withColumn("n_visits", F.coalesce("n_visits", F.lit(0).cast("bigint")))
    return positions(weighed, "n_visits", run, "place").withColumn("weight", F.lit(1.0) / F.greatest("n_visits", F.lit(1)))
