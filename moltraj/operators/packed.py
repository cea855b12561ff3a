"""Packed frames: one row a frame, its residues as arrays, so that a frame is written, hashed and compared in place.

A packed row has the frame's key, `traj_id`, and over its residues in order `ca` and `cb` (three numbers each),
`torsions` (six: sine and cosine of phi, psi, omega), `dssp`, `residue_type`, and `sasa` (null if it was not asked for).
Frames meet their domain's residue and atom arrays by a lookup; everything else happens inside the row, on Arrow batches
whose size Spark bounds in rows and bytes. No step here shuffles frames or residues.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltraj.functions import kernels
from moltraj.functions.codes import BLANKS, trajectory_id
from moltraj.scale import BROADCAST_ENTRIES, lookup_join
from moltraj.schema import DSSP_CODES, FRAME_KEY, TRAJECTORY_KEY, VIRTUAL_CB

cloudpickle.register_pickle_by_value(kernels)

#: Index columns of a residue site by the point they name.
POINTS = {"n": "n_index", "ca": "ca_index", "c": "c_index", "cb": "cb_index", "cp": "c_before", "nn": "n_after", "can": "ca_after"}
NUMBERS = {"ca": 3, "cb": 3, "torsions": 6}


def flat_points():
    """Reader of an Arrow list of x, y, z structs: all points of a batch, and how many each frame has."""

    def read(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        axes = column.flatten().flatten()
        return np.stack([np.asarray(axis.to_numpy(zero_copy_only=False), np.float64) for axis in axes], axis=1), counts

    return read


def numbers_of():
    """Reader of a whole-number field of an Arrow list of structs, -1 where it is null."""

    def read(column: pa.ListArray, name: str) -> np.ndarray:
        return pc.fill_null(pc.struct_field(column.flatten(), name), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    return read


def packing_kernel(precise: bool, with_areas: bool, n_points: int):
    """The batch function behind `packed_frames`; made here so that it travels to the workers by value."""
    k, read_points, read_numbers, keys, points, weights = kernels, flat_points(), numbers_of(), list(FRAME_KEY), dict(POINTS), VIRTUAL_CB
    codes, blanks = dict(DSSP_CODES), BLANKS
    kind = pa.float64() if precise else pa.float32()

    def as_lists(values: np.ndarray, counts: np.ndarray, value_kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(k.starts_of(counts), pa.int32()), pa.array(values.ravel(), value_kind))

    def labels(batch: pa.RecordBatch, frame: np.ndarray, residue: np.ndarray) -> np.ndarray:
        """Secondary-structure codes; a residue without a label is coil."""
        column = batch.column("dssp")
        first = k.starts_of(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        coded = pc.dictionary_encode(column.flatten(), null_encoding="encode")
        table = np.array([codes.get((text or "").strip(blanks)[:1], 0) for text in coded.dictionary.to_pylist()] + [0])
        numbers = np.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(table) - 1)
        there = residue < (first[1:] - first[:-1])[frame]
        return table[numbers[np.where(there, first[:-1][frame] + residue, len(numbers) - 1)]]

    def areas(batch: pa.RecordBatch, xyz: np.ndarray, first: np.ndarray, counts: np.ndarray, n_res: np.ndarray) -> np.ndarray:
        column = batch.column("members")
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        frame = np.repeat(np.arange(len(sizes)), sizes)
        atom, residue = read_numbers(column, "atom_index"), read_numbers(column, "residue_index")
        reach = pc.struct_field(column.flatten(), "reach").to_numpy(zero_copy_only=False)
        at = k.gathered(xyz, first[frame], counts[frame], atom)
        base = k.starts_of(n_res)
        area = k.sphere_areas(sizes, at, reach, n_points)
        total, owned = np.zeros(base[-1]), residue >= 0
        np.add.at(total, (base[frame] + residue)[owned], area[owned])
        return total

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz, counts = read_points(batch.column("xyz"))
            first = k.starts_of(counts)
            sites = batch.column("sites")
            n_res = pc.fill_null(pc.list_value_length(sites), 0).to_numpy().astype(np.int64)
            frame = np.repeat(np.arange(len(n_res)), n_res)
            index = {name: read_numbers(sites, column) for name, column in points.items()}
            at = {name: k.gathered(xyz, first[frame], counts[frame], found) for name, found in index.items()}
            cb, torsions = k.backbone(at, {name: found >= 0 for name, found in index.items()}, weights)
            values = {"ca": at["ca"], "cb": cb, "torsions": torsions}
            columns = {name: as_lists(part if precise else k.half(part), n_res * part.shape[1], kind) for name, part in values.items()}
            columns["dssp"] = as_lists(labels(batch, frame, read_numbers(sites, "residue_index")), n_res, pa.int32())
            columns["residue_type"] = as_lists(read_numbers(sites, "residue_type"), n_res, pa.int32())
            if with_areas:
                found = areas(batch, xyz, first, counts, n_res)
                columns["sasa"] = as_lists(found if precise else k.half(found), n_res, kind)
            else:
                columns["sasa"] = pa.nulls(batch.num_rows, pa.list_(kind))
            kept = [name for name in batch.schema.names if name in (*keys, "traj_id")]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in kept], *columns.values()], names=[*kept, *columns])

    return pack


def domain_arrays(sites: DataFrame, spheres: DataFrame | None = None) -> DataFrame:
    """One row per domain: its residue sites and, for areas, its atoms with their reach (`sasa.domain_spheres`)."""
    return sites if spheres is None else sites.join(spheres, "domain_id", "left")


def with_domain_arrays(frames: DataFrame, arrays: DataFrame) -> DataFrame:
    """Frames next to their domain's arrays: no shuffle where these fit a broadcast, a salted one otherwise."""
    weight = F.size("sites") + (F.coalesce(F.size("members"), F.lit(0)) if "members" in arrays.columns else F.lit(0))
    return lookup_join(
        frames, arrays, ["domain_id"], salt_by=["temperature", "replicate", "frame"], max_rows=BROADCAST_ENTRIES, weight=weight
    )


def packed_frames(joined: DataFrame, *, precise: bool = True, n_points: int = 100) -> DataFrame:
    """Packed rows of frames that already carry `sites` (and `members` for areas); half precision unless `precise`."""
    areas = "members" in joined.columns
    kinds = dict(joined.dtypes)
    number = "double" if precise else "float"
    schema = ", ".join([
        *[f"{name} {kinds[name]}" for name in FRAME_KEY], "traj_id string", *[f"{name} array<{number}>" for name in NUMBERS],
        "dssp array<int>", "residue_type array<int>", f"sasa array<{number}>",
    ])
    traj_id = trajectory_id(F.col("domain_id"), F.col("temperature"), F.col("replicate"))
    wanted = joined.select(*FRAME_KEY, traj_id.alias("traj_id"), "xyz", "dssp", "sites", *(["members"] if areas else []))
    return wanted.mapInArrow(packing_kernel(precise, areas, n_points), schema)


def unpacked(packed: DataFrame) -> DataFrame:
    """One row per frame and residue, as `features.residue_features` gives them; in place, without a shuffle."""
    each = "transform(sequence(0, size(dssp) - 1), i -> named_struct('residue_index', i"
    for name, parts in (("ca", ("ca_x", "ca_y", "ca_z")), ("cb", ("cb_x", "cb_y", "cb_z")), ("torsions", tuple(
        f"{t}_{p}" for t in ("phi", "psi", "omega") for p in ("sin", "cos")))):
        each += "".join(f", '{part}', {name}[{len(parts)} * i + {at}]" for at, part in enumerate(parts))
    each += ", 'dssp', dssp[i], 'sasa', coalesce(sasa[i], float('NaN')), 'residue_type', residue_type[i]))"
    rows = packed.where(F.size("dssp") > 0).select(*FRAME_KEY, "traj_id", F.inline(F.expr(each)))
    return rows.withColumns({"ff_tag": F.lit(0), "residue_mask": F.lit(True)})


def digest_kernel(with_areas: bool):
    k = kernels

    def digests(*columns: pa.Array) -> pa.Array:
        """SHA-256 of each frame's canonical whole numbers, residue by residue, as big-endian 64-bit numbers."""
        dssp, kinds, *numbers = columns
        n_res = pc.fill_null(pc.list_value_length(dssp), 0).to_numpy().astype(np.int64)
        total = int(n_res.sum())
        if not total:
            return pa.array([hashlib.sha256(b"").hexdigest()] * len(n_res), pa.string())

        def table(column: pa.Array) -> np.ndarray:
            if column.null_count == len(column):
                return np.full((total, 1), k.NO_NUMBER)
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
            return k.canonical_whole(flat).reshape(total, -1)

        parts = [table(column) for column in numbers[:3]] + [np.asarray(dssp.flatten()).reshape(total, 1)]
        parts += [table(numbers[3])] if with_areas else []
        parts += [np.asarray(kinds.flatten()).reshape(total, 1), np.ones((total, 1), np.int64)]
        whole = np.concatenate(parts, axis=1).astype(">i8")
        first = k.starts_of(n_res)
        return pa.array([hashlib.sha256(whole[a:b].tobytes()).hexdigest() for a, b in zip(first[:-1], first[1:])], pa.string())

    return digests


def frame_digests(packed: DataFrame, *, include_sasa: bool = False) -> DataFrame:
    """FRAME_KEY and one digest per frame, taken inside the row. Area is left out unless asked for."""
    kernel = digest_kernel(include_sasa)

    @F.arrow_udf("string")
    def digest(dssp: pa.Array, kinds: pa.Array, ca: pa.Array, cb: pa.Array, torsions: pa.Array, sasa: pa.Array) -> pa.Array:
        return kernel(dssp, kinds, ca, cb, torsions, sasa)

    return packed.select(*FRAME_KEY, digest("dssp", "residue_type", "ca", "cb", "torsions", "sasa").alias("digest"))


def half_precision(values: Column) -> Column:
    """An array of numbers as half precision holds them, in FLOAT."""
    k = kernels

    @F.arrow_udf("array<float>")
    def stored(column: pa.Array) -> pa.Array:
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        return pa.ListArray.from_arrays(pa.array(k.starts_of(counts), pa.int32()), pa.array(k.half(flat)))

    return stored(values)


def squared_gap(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, g: s + g)


def roundtrip_rmsd(paired: DataFrame, threshold: float) -> DataFrame:
    """RMSD over all C-alpha components per trajectory, from rows with `ca` and `stored_ca`; one sum a frame moves.

    NaN fails, and so does a trajectory with a frame, or a residue of a frame, that only one side has.
    """
    both = F.col("ca").isNotNull() & F.col("stored_ca").isNotNull()
    whole = both & (F.size("ca") == F.size("stored_ca"))
    sums = paired.select(
        *FRAME_KEY, whole.alias("_whole"), F.when(whole, squared_gap(F.col("ca"), F.col("stored_ca"))).alias("_gap"),
        F.when(whole, F.size("ca")).alias("_n"),
    )
    return (
        sums.groupBy(*TRAJECTORY_KEY)
        .agg(F.count(F.lit(1)).alias("n_frames"), F.sqrt(F.sum("_gap") / F.sum("_n")).alias("rmsd_angstrom"), F.bool_and("_whole").alias("_whole"))
        .withColumn("passed", F.coalesce(F.col("_whole") & ~F.isnan("rmsd_angstrom") & (F.col("rmsd_angstrom") < threshold), F.lit(False)))
        .drop("_whole")
    )


def beside(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Raw and stored packed frames of the same key in one row, for a check of two tables."""
    left, right = raw.select(*FRAME_KEY, "ca"), stored.select(*FRAME_KEY, F.col("ca").alias("stored_ca"))
    return left.join(right, FRAME_KEY, "full")

