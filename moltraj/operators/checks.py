"""Quality checks of a processed store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltraj.functions.numeric import draw, round_up
from moltraj.scale import BLOCK, lookup_join, ranked
from moltraj.schema import FRAME_MULTIPLE, RESIDUE_MULTIPLE, TRAJECTORY_KEY

RMSD_THRESHOLD = 0.05


def shape_report(packed: DataFrame) -> DataFrame:
    """Number of trajectories and the padded frame and residue extents of each stored array, from packed frames."""
    per_trajectory = packed.groupBy(*TRAJECTORY_KEY).agg(F.max("frame").alias("frame"), F.max(F.size("dssp")).alias("n"))
    extents = per_trajectory.agg(
        F.count(F.lit(1)).alias("n_trajectories"),
        round_up(F.max("frame") + 1, FRAME_MULTIPLE).alias("n_frames"),
        round_up(F.max("n"), RESIDUE_MULTIPLE).alias("n_residues"),
    )
    # Stored arrays and the length of their last axis (0 = none).
    arrays = {"ca": 3, "cb": 3, "backbone_torsions": 6, "dssp": 0, "sasa": 0, "residue_mask": 0}
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("parts")) for n, k in arrays.items()]))
    return extents.withColumn("a", listed).select(
        F.col("a.name").alias("array_name"),
        "n_trajectories",
        F.when(F.col("a.name") != "residue_mask", F.col("n_frames")).alias("n_frames"),
        "n_residues",
        F.when(F.col("a.parts") > 0, F.col("a.parts")).alias("n_parts"),
    )


def set_difference(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, in long form: (key, finding = missing | unexpected)."""
    left = expected.select(key).distinct().withColumn("wanted", F.lit(True))
    right = observed.select(key).distinct().withColumn("seen", F.lit(True))
    finding = F.when(F.col("seen").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected")
    return left.join(right, key, "full").select(key, finding.alias("finding")).filter("finding IS NOT NULL")


def domain_list_check(expected: DataFrame, observed: DataFrame, key: str = "domain_id") -> DataFrame:
    """Counts of both sides (the list is counted with its duplicates) and the verdict, as one row."""
    differing = set_difference(expected, observed, key).agg(
        F.count_if(F.col("finding") == "missing").alias("n_missing"),
        F.count_if(F.col("finding") == "unexpected").alias("n_unexpected"),
    )
    return differing.select(
        expected.agg(F.count(F.lit(1)).alias("n")).scalar().alias("expected_count"),
        observed.agg(F.count_distinct(key).alias("n")).scalar().alias("observed_count"),
        "n_missing",
        "n_unexpected",
        ((F.col("n_missing") == 0) & (F.col("n_unexpected") == 0)).alias("passed"),
    )


def manifest_hash_check(recomputed: DataFrame, expected: Column | str) -> DataFrame:
    wanted = F.lit(expected) if isinstance(expected, str) else expected
    return recomputed.select(
        wanted.alias("expected"), F.col("dataset_hash").alias("recomputed"),
        (F.col("dataset_hash") == wanted).alias("passed"),
    )


def coverage_check(roundtrip: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every trajectory of the metadata passes its round trip with as many frames as it was stored with.

    Both have traj_id and n_frames; a trajectory that was stored empty needs no rows.
    """
    found = roundtrip.select("traj_id", F.col("n_frames").alias("_found"), F.col("passed").alias("_passed"))
    rows = metadata.select("traj_id", "n_frames").join(found, "traj_id", "full")
    whole = F.coalesce(F.col("_passed") & (F.col("_found") == F.col("n_frames")), F.lit(False))
    return rows.select("traj_id", (whole | F.coalesce((F.col("n_frames") == 0) & F.col("_found").isNull(), F.lit(False))).alias("passed"))


def content_hash_check(recomputed: DataFrame, metadata: DataFrame, empty: str) -> DataFrame:
    """The content hash of every trajectory, recomputed from the stored rows, is the one in the metadata."""
    again = recomputed.select("traj_id", F.col("content_hash").alias("_again"))
    rows = metadata.select("traj_id", "content_hash").join(again, "traj_id", "full")
    return rows.select("traj_id", F.coalesce(F.col("content_hash") == F.coalesce("_again", F.lit(empty)), F.lit(False)).alias("passed"))


def window_draws(spark, n_windows: int, seed: int) -> DataFrame:
    at = F.col("id")
    return spark.range(n_windows).select(
        at.alias("window_id"), draw(seed, at, F.lit("t")).alias("pick"), draw(seed, at, F.lit("s")).alias("slide")
    )


def random_windows(metadata: DataFrame, *, n_windows: int = 100, window_frames: int = 64, seed: int = 0) -> DataFrame:
    """Seeded windows: a uniform trajectory among those long enough, then a uniform start in it.

    Trajectories are numbered by traj_index in blocks; only the few picked numbers are joined back.
    """
    eligible = metadata.filter(F.col("n_frames") >= window_frames)
    block = F.floor(F.col("traj_index") / F.lit(BLOCK))
    numbered = ranked(eligible.select("traj_index", "traj_id", "n_frames"), [], block, ["traj_index"], "_place")
    total = eligible.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = window_draws(metadata.sparkSession, n_windows, seed)
    picked = draws.filter(total > 0).withColumn("_place", F.pmod("pick", total))
    start = F.pmod(F.col("slide"), F.col("n_frames") - F.lit(window_frames - 1))
    return lookup_join(numbered, picked, ["_place"], salt_by=["traj_index"], known_rows=n_windows).select(
        "window_id", "traj_index", "traj_id", start.alias("start"), (start + window_frames).alias("stop")
    )


def window_rows(frames: DataFrame, windows: DataFrame, key: str, n_windows: int, position: str = "frame") -> DataFrame:
    """Rows of `frames` inside each window: a lookup join on the trajectory, then the range.

    Few windows are broadcast and frames stay where they are; many windows meet frames on a salted trajectory key.
    """
    inside = windows.select(key, "window_id", "start", "stop")
    paired = lookup_join(frames, inside, [key], salt_by=[position], known_rows=n_windows)
    return paired.filter((F.col(position) >= F.col("start")) & (F.col(position) < F.col("stop")))


def checksum_audit(held: DataFrame, published: DataFrame) -> DataFrame:
    """State of every path by digest: ok, mismatch, missing (published only) or unexpected (held only)."""
    both = held.withColumnRenamed("digest", "_held").join(published.withColumnRenamed("digest", "_published"), "path", "full")
    state = (
        F.when(F.col("_held").isNull(), "missing").when(F.col("_published").isNull(), "unexpected")
        .when(F.col("_held") == F.col("_published"), "ok").otherwise("mismatch")
    )
    return both.select("path", state.alias("state"))


def file_digests(spark, root: str, pattern: str) -> DataFrame:
    """SHA-256 of files below a folder, each read whole by one task; larger files bring their own digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("digest"))


def latency_summary(timings: DataFrame, column: str = "ms") -> DataFrame:
    """p50, p99 (interpolated) and maximum. `percentile` counts equal values before it merges tasks."""
    parts = F.percentile(column, F.array(F.lit(0.5), F.lit(0.99)))
    return timings.agg(parts.alias("p"), F.max(column).alias("max_ms")).select(
        F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p99_ms"), "max_ms"
    )


def verdict(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row per check plus the overall AND; a check without rows fails."""
    rows = None
    for name, result in checks:
        row = result.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed")).select(
            F.lit(name).alias("check_name"), "passed"
        )
        rows = row if rows is None else rows.unionByName(row)
    overall = rows.agg(F.bool_and("passed").alias("passed")).select(F.lit("all").alias("check_name"), "passed")
    return rows.unionByName(overall)
