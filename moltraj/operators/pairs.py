"""Pairs and buckets over frames: near-in-time pairs, contact graphs, length buckets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltraj.functions import kernels
from moltraj.operators.packed import flat_points
from moltraj.schema import FRAME_KEY

# Residue-count buckets, contact radius in Angstrom and neighbours kept.
LENGTH_BUCKETS = (128, 192, 256, 320)
CONTACT_RADIUS = 12.0
CONTACT_NEIGHBOURS = 16
# Points that a worker's cell list takes at a time.
POINTS_AT_ONCE = 10_000


def positive_pairs(frames: DataFrame, group: str, time: str, item: str, within: float) -> DataFrame:
    """Pairs of one trajectory less than `within` apart in time, earlier item first.

    Time is cut into slices of that width; the earlier frame looks only into its own slice and the next, so the join
    key is (trajectory, slice) and a slice holds a fixed stretch of time however long the trajectory is.
    """
    at = F.floor(F.col(time) / F.lit(within))
    early = frames.select(
        group, F.col(item).alias("item"), F.col(time).alias("_t"), F.explode(F.array(at, at + 1)).alias("_slice")
    )
    late = frames.select(group, F.col(item).alias("later_item"), F.col(time).alias("_later"), at.alias("_slice"))
    near = (F.col("_later") > F.col("_t")) & (F.col("_later") - F.col("_t") < within)
    return early.join(late, [group, "_slice"]).filter(near).select(group, "item", "later_item")


def contact_graph(
    frames: DataFrame, *, radius: float = CONTACT_RADIUS, neighbours: int = CONTACT_NEIGHBOURS
) -> DataFrame:
    """Edges from each residue to its nearest residues within the radius, in each frame, from one point a residue (`xyz`).

    A cell list inside the frame's row finds the neighbours, so that only the edges that are kept become rows and
    nothing is shuffled. Frames are taken together up to POINTS_AT_ONCE points, so that a worker's memory is that of so
    many points or of one frame, whatever Arrow's batch holds.
    """
    kinds = dict(frames.dtypes)
    k, read_points, keys, at_once = kernels, flat_points(), list(FRAME_KEY), POINTS_AT_ONCE
    edge = "struct<residue_index:int,other_residue_index:int,place:int,distance:double>"

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole.column("xyz")), 0).to_numpy().astype(np.int64)
            for low, high in k.stretches(sizes, at_once):
                batch = whole.slice(low, high - low)
                xyz, counts = read_points(batch.column("xyz"))
                first, frame = k.starts_of(counts), np.repeat(np.arange(len(counts)), counts)
                a, b, place, distance = k.nearest(frame, xyz, radius, neighbours)
                local = [a - first[frame[a]], b - first[frame[a]], place]
                parts = [*[pa.array(part, pa.int32()) for part in local], pa.array(distance)]
                found = pa.StructArray.from_arrays(parts, names=["residue_index", "other_residue_index", "place", "distance"])
                ends = np.searchsorted(frame[a], np.arange(len(counts) + 1))
                columns = [*[batch.column(name) for name in keys], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "edges"])

    schema = ", ".join(f"{name} {kinds[name]}" for name in FRAME_KEY) + f", edges array<{edge}>"
    return frames.select(*FRAME_KEY, "xyz").mapInArrow(edges, schema).select(*FRAME_KEY, F.inline("edges"))


def length_bucket(length: Column, buckets: Sequence[int] = LENGTH_BUCKETS) -> Column:
    """The smallest bucket that holds the length; NULL when none does."""
    chosen = F.lit(None).cast("int")
    for bucket in sorted(buckets, reverse=True):
        chosen = F.when(length <= bucket, F.lit(bucket)).otherwise(chosen)
    return chosen
