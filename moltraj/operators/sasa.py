"""Solvent-exposed area per residue: test points on each atom's sphere, minus those inside a neighbour.

Neighbours are found by a cell list inside the frame's row, for all frames of an Arrow batch at once, so that neither
atoms nor pairs of atoms are ever rows and nothing is shuffled between frames and areas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltraj.functions import kernels
from moltraj.functions.kernels import sphere
from moltraj.operators.packed import flat_points, numbers_of
from moltraj.operators.topology import residue_atoms
from moltraj.scale import BROADCAST_ENTRIES, lookup_join
from moltraj.schema import FRAME_KEY

# Van der Waals radii in Angstrom by element (Bondi 1964).
RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80}
OTHER_RADIUS = 1.80
PROBE = 1.4
POINTS = 100

__all__ = ["PROBE", "RADII", "atom_spheres", "domain_spheres", "residue_areas", "sphere"]


def atom_radius(atom_name: Column) -> Column:
    """Radius from the element letter an atom name starts with."""
    element = F.substring(atom_name, 1, 1)
    chosen = F.lit(OTHER_RADIUS)
    for letter, radius in RADII.items():
        chosen = F.when(element == letter, radius).otherwise(chosen)
    return chosen


def domain_spheres(atoms: DataFrame, residue_table: DataFrame, probe: float = PROBE) -> DataFrame:
    """One row per domain with its atoms as `members`: atom, residue and probe-extended radius."""
    paired = residue_atoms(atoms, residue_table).withColumn("reach", atom_radius(F.col("atom_name")) + F.lit(probe))
    return paired.groupBy("domain_id").agg(F.collect_list(F.struct("atom_index", "residue_index", "reach")).alias("members"))


def atom_spheres(frames: DataFrame, atoms: DataFrame, residue_table: DataFrame, probe: float = PROBE) -> DataFrame:
    """Frames with the `members` of their domain; no shuffle where these fit a broadcast."""
    return lookup_join(
        frames.select(*FRAME_KEY, "xyz"), domain_spheres(atoms, residue_table, probe), ["domain_id"],
        salt_by=["temperature", "replicate", "frame"], max_rows=BROADCAST_ENTRIES, weight=F.size("members"),
    )


def residue_areas(spheres: DataFrame, *, n_points: int = POINTS) -> DataFrame:
    """Exposed area of every residue of every frame, in square Angstrom, from `atom_spheres`."""
    kinds = dict(spheres.dtypes)
    k, read_points, read_numbers, keys = kernels, flat_points(), numbers_of(), list(FRAME_KEY)

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz, counts = read_points(batch.column("xyz"))
            members = batch.column("members")
            sizes = pc.fill_null(pc.list_value_length(members), 0).to_numpy().astype(np.int64)
            frame, first = np.repeat(np.arange(len(sizes)), sizes), k.starts_of(counts)
            at = k.gathered(xyz, first[frame], counts[frame], read_numbers(members, "atom_index"))
            reach = pc.struct_field(members.flatten(), "reach").to_numpy(zero_copy_only=False)
            area = k.sphere_areas(sizes, at, reach, n_points)
            residue = read_numbers(members, "residue_index")
            owned = residue >= 0
            rows, place = np.unique(np.stack([frame[owned], residue[owned]]), axis=1, return_inverse=True)
            total = np.bincount(place.ravel(), weights=area[owned], minlength=rows.shape[1])
            ends = np.searchsorted(rows[0], np.arange(len(sizes) + 1))
            found = pa.StructArray.from_arrays([pa.array(rows[1], pa.int32()), pa.array(total)], names=["residue_index", "area"])
            columns = [*[batch.column(name) for name in keys], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "found"])

    schema = ", ".join(f"{name} {kinds[name]}" for name in FRAME_KEY) + ", found array<struct<residue_index:int,area:double>>"
    return spheres.select(*FRAME_KEY, "xyz", "members").mapInArrow(areas, schema).select(*FRAME_KEY, F.inline("found"))
