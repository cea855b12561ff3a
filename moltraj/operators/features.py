"""Per-frame features: folded-frame filter, renumbering, geometry, secondary structure, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltraj.functions import geometry as geo
from moltraj.functions.codes import dssp_code, trajectory_id
from moltraj.functions.numeric import quantize_f16, round_up
from moltraj.scale import BLOCK, BROADCAST_ENTRIES, lookup_join, running_total
from moltraj.schema import (
    FOLDED_RMSD_ANGSTROM,
    FRAME_KEY,
    FRAME_MULTIPLE,
    RESIDUE_MULTIPLE,
    TRAJECTORY_KEY,
    UNFOLDING_TEMPERATURE,
)

#: Frames whose bits share one number.
WORD = 64
TORSIONS = [f"{name}_{part}" for name in ("phi", "psi", "omega") for part in ("sin", "cos")]
CA = ["ca_x", "ca_y", "ca_z"]
CB = ["cb_x", "cb_y", "cb_z"]


def rmsd_angstrom(rmsd: Column, unit: Column) -> Column:
    """Single-precision RMSD in Angstrom; kept in FLOAT because 0.4 nm sits on the filter bound."""
    value = rmsd.cast("float")
    return F.when(F.lower(F.coalesce(unit, F.lit(""))) == "nm", value * F.lit(10).cast("float")).otherwise(value)


def is_hot(temperature: Column) -> Column:
    """Compared as text, so that groups with other names are passed over and the test reaches the scan."""
    return F.coalesce(temperature == F.lit(str(UNFOLDING_TEMPERATURE)), F.lit(False))


def is_folded(temperature: Column, has_rmsd: Column, rmsd: Column) -> Column:
    """Frames to keep. NaN and NULL values of a trajectory that has an RMSD series are dropped."""
    hot = is_hot(temperature)
    low = F.coalesce(rmsd <= F.lit(FOLDED_RMSD_ANGSTROM).cast("float"), F.lit(False))
    return ~hot | ~F.coalesce(has_rmsd, F.lit(False)) | low


def word_of(frame: Column) -> Column:
    return F.floor(frame / F.lit(WORD)).cast("bigint")


def kept_words(frames: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Bitmaps of the kept high-temperature frames: per trajectory and 64 frames, `_bits` and `_earlier`, the number of
    kept frames in earlier words. Only keys and RMSD are read, and one word stands for 64 frames.
    """
    hot = is_hot(F.col("temperature"))
    series = trajectories.filter(hot).select(*TRAJECTORY_KEY, "rmsd_unit", "has_rmsd")
    keyed = frames.filter(hot).select(*FRAME_KEY, "rmsd")
    joined = lookup_join(keyed, series, TRAJECTORY_KEY, "left", salt_by=["frame"])
    folded = joined.filter(is_folded(F.col("temperature"), F.col("has_rmsd"), rmsd_angstrom(F.col("rmsd"), F.col("rmsd_unit"))))
    bit = F.expr(f"shiftleft(1L, CAST(frame % {WORD} AS INT))")
    words = folded.groupBy(*TRAJECTORY_KEY, word_of(F.col("frame")).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return running_total(
        words, TRAJECTORY_KEY, F.floor(F.col("_word") / F.lit(BLOCK)), ["_word"], F.bit_count("_bits").cast("bigint"), "_earlier"
    )


def kept_frames(
    frames: DataFrame, trajectories: DataFrame, *, filter_unfolded: bool = True, carried: DataFrame | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Frames that pass the high-temperature RMSD gate, with frame numbers closed up.

    Landed frames are numbered without gaps, so only the filtered temperature is renumbered; every other frame passes
    through in a narrow stage. A kept frame's new number is the count of kept frames in earlier words plus the bits
    below its own, looked up by (trajectory, word), so that no window ever sorts rows with coordinates. `carried` is a
    table by trajectory (planned trajectories with their domain's arrays) whose columns come along; frames of other
    trajectories are dropped. Either way every frame row takes part in one join.
    """
    extra = [] if carried is None else [c for c in carried.columns if c not in TRAJECTORY_KEY]
    weight = sum((F.coalesce(F.size(c), F.lit(0)) for c in extra), F.lit(1))
    most = BROADCAST_ENTRIES if max_rows is None else max_rows

    def passed(rows: DataFrame) -> DataFrame:
        numbered = rows.withColumn("source_frame", F.col("frame"))
        if carried is None:
            return numbered
        return lookup_join(numbered, carried, TRAJECTORY_KEY, salt_by=["frame"], max_rows=most, weight=weight)

    if not filter_unfolded:
        return passed(frames)
    hot = is_hot(F.col("temperature"))
    words = kept_words(frames, trajectories)
    words = words if carried is None else words.join(carried, TRAJECTORY_KEY)
    keyed = frames.filter(hot).withColumn("_word", word_of(F.col("frame")))
    # A word is the key of at most 64 frames, so that no salt is needed.
    found = lookup_join(keyed, words, [*TRAJECTORY_KEY, "_word"], salt_by=["frame"], salts=1, max_rows=most, weight=weight)
    at = f"CAST(frame % {WORD} AS INT)"
    place = F.expr(f"CAST(_earlier + bit_count(_bits & ~shiftleft(-1L, {at})) AS INT)")
    renumbered = found.filter(F.expr(f"(shiftright(_bits, {at}) & 1L) = 1L")).withColumns({"source_frame": F.col("frame"), "_place": place})
    renumbered = renumbered.drop("_word", "_bits", "_earlier", "frame").withColumnRenamed("_place", "frame")
    return passed(frames.filter(~hot)).unionByName(renumbered)


TORSION_POINTS = {name: geo.WALK[at - 2 : at + 2] for name, at in geo.TORSION_AXIS.items()}
POINT_INDEX = {
    "n": "n_index", "ca": "ca_index", "c": "c_index", "cb": "cb_index",
    "cp": "c_before", "nn": "n_after", "can": "ca_after",
}


def present(*points: str) -> str:
    return "(" + " AND ".join(f"{POINT_INDEX[point]} IS NOT NULL" for point in points) + ")"


def residue_points(frames: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per (frame, residue) with the backbone points it needs, as double columns.

    Frames meet their domain's residue array and are unpacked in the same stage: no shuffle when the arrays fit a
    broadcast, and a salted one otherwise.
    """
    joined = lookup_join(
        frames, sites, ["domain_id"], salt_by=["temperature", "replicate", "frame"], max_rows=BROADCAST_ENTRIES,
        weight=F.size("sites"),
    )
    unpacked = joined.select(*FRAME_KEY, "dssp", "xyz", F.inline("sites"))
    gathered = {}
    for name, index in POINT_INDEX.items():
        gathered |= geo.named(name, geo.gather("xyz", index))
    flags = {f"has_{name}": present(*points) for name, points in TORSION_POINTS.items()}
    flags |= {"has_cb": present("cb"), "has_arms": present("n", "c")}
    return unpacked.selectExpr(
        *FRAME_KEY, "residue_index", "residue_type", "get(dssp, residue_index) AS dssp_label",
        *[f"{text} AS {name}" for name, text in {**flags, **gathered}.items()],
    )


def residue_features(frames: DataFrame, sites: DataFrame) -> DataFrame:
    """C-alpha, C-beta, phi/psi/omega as sine and cosine, and codes, for every residue of every frame."""
    defined = {name: f"has_{name}" for name in TORSION_POINTS}
    return geo.with_backbone(residue_points(frames, sites), defined, "has_cb", "has_arms").select(
        *FRAME_KEY,
        trajectory_id(F.col("domain_id"), F.col("temperature"), F.col("replicate")).alias("traj_id"),
        "residue_index", *CA, *CB, *TORSIONS,
        dssp_code(F.col("dssp_label")).alias("dssp"),
        F.lit(float("nan")).alias("sasa"),
        "residue_type",
        F.lit(0).alias("ff_tag"),
        F.lit(True).alias("residue_mask"),
    )


def stored_precision(features: DataFrame) -> DataFrame:
    """Coordinates, torsions and areas as half precision would hold them, in FLOAT columns."""
    rounded = {name: quantize_f16(F.col(name)).cast("float") for name in [*CA, *CB, *TORSIONS, "sasa"]}
    return features.withColumns(rounded)


def padded_grid(features: DataFrame, fills: dict[str, Column]) -> DataFrame:
    """Every (trajectory, frame, residue) cell of the rounded-up rectangle, with fills where there is no data.

    An opt-in export shape, never the storage layout. The rectangle grows from one row per trajectory to one per frame
    block, is spread over tasks, and only then unfolds to frames and residues.
    """
    rectangle = features.agg(
        round_up(F.max("frame") + 1, FRAME_MULTIPLE).alias("n_frames"),
        round_up(F.max("residue_index") + 1, RESIDUE_MULTIPLE).alias("n_residues"),
    )
    return padded_to(features, rectangle, fills)


def padded_to(features: DataFrame, rectangle: DataFrame, fills: dict[str, Column]) -> DataFrame:
    rows, across = rectangle.select("n_frames").scalar(), rectangle.select("n_residues").scalar()
    blocks = (
        features.select(*TRAJECTORY_KEY).distinct().withColumns({"_rows": rows, "_across": across})
        .withColumn("_block", F.explode(F.sequence(F.lit(0), ((F.col("_rows") - 1) / FRAME_MULTIPLE).cast("int"))))
        .repartition(*TRAJECTORY_KEY, "_block")
    )
    first = F.col("_block") * FRAME_MULTIPLE
    last = F.least(first + FRAME_MULTIPLE, F.col("_rows")).cast("int") - 1
    cells = (
        blocks.withColumn("frame", F.explode(F.sequence(first, last)))
        .withColumn("residue_index", F.explode(F.sequence(F.lit(0), (F.col("_across") - 1).cast("int"))))
        .drop("_block", "_rows", "_across")
    )
    keys = [*FRAME_KEY, "residue_index"]
    marked = features.select(*keys, *fills, F.lit(True).alias("_real"))
    return cells.join(marked, keys, "left").select(
        *keys,
        *[F.when(F.col("_real"), F.col(name)).otherwise(fill).alias(name) for name, fill in fills.items()],
    )
