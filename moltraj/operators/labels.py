"""State labels per domain: frame vectors, lagged covariance, slow coordinates, gate, clustering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltraj.scale import BLOCK, cut_lineage, fits, look_ahead, lookup_join, running_total, with_halo

RESOLUTIONS = (4, 16, 64)
FEATURE_RESIDUES = 32
SLOW_DIM = 8
# Eigenvalues of the instantaneous covariance below this are treated as zero.
RANK_CUTOFF = 1e-6
# Label method names, the reason given when the gate does not pass, stage and label type.
PASSED_METHOD = "vampnet"
FALLBACK_METHOD = "tica_kmeans"
FALLBACK_REASON = "health_score_not_above_random_projection_baseline"
STAGE = "A0"
LABEL_TYPE = "vampnet_tier1_pilot"


# --- which frames -----------------------------------------------------------------------------------------------------


def selected_domains(metadata: DataFrame, requested: DataFrame | None = None, max_domains: int | None = None) -> DataFrame:
    """Domains to label as (pos, domain_id): all in name order, or the requested ones in list order; then the first N.

    A requested domain without data is an error.
    """
    available = metadata.select(F.col("domain_id").cast("string").alias("domain_id")).distinct()
    if requested is None:
        chosen, order = available, ["domain_id"]
    else:
        missing = requested.join(available, "domain_id", "left_anti").select("domain_id").distinct()
        first = [row.domain_id for row in missing.orderBy("domain_id").limit(10).collect()]
        if first:
            raise ValueError(f"no processed data for these requested domains: {first}")
        chosen, order = requested.select("pos", "domain_id"), ["pos"]
    if max_domains is not None:
        chosen = chosen.orderBy(*order).limit(max_domains)
    return chosen


def frame_offsets(metadata: DataFrame, cap: int = 0, *, block: Column | None = None) -> DataFrame:
    """[start, stop) of each trajectory on its domain's frame axis, cut at `cap` frames per domain if it is above 0.

    The running sum over a domain's trajectories is split into blocks of traj_index.
    """
    block = F.floor(F.col("traj_index") / F.lit(BLOCK)) if block is None else block
    placed = running_total(metadata, ["domain_id"], block, ["traj_index"], F.col("n_frames"), "start")
    stop = F.col("start") + F.col("n_frames")
    if cap > 0:
        placed = placed.filter(F.col("start") < cap)
        stop = F.least(stop, F.lit(cap))
    return placed.withColumn("stop", stop).select("domain_id", "traj_id", "traj_index", "start", "stop")


def capped_frames(frames: DataFrame, offsets: DataFrame, *, n_trajectories: int | None = None) -> DataFrame:
    """Frames inside their trajectory's share, with their place on the domain axis and the domain's total."""
    totals = offsets.groupBy("domain_id").agg(F.max("stop").alias("n_total"))
    spans = offsets.join(totals, "domain_id").select("domain_id", "traj_id", "start", "stop", "n_total")
    # The domain is part of the key so that partition folders of other domains are pruned from a stored table.
    joined = lookup_join(frames, spans, ["domain_id", "traj_id"], salt_by=["frame"], known_rows=n_trajectories)
    return joined.filter(F.col("frame") < F.col("stop") - F.col("start")).withColumn(
        "frame_global", F.col("start") + F.col("frame")
    ).drop("start", "stop")


# --- frame vectors ----------------------------------------------------------------------------------------------------


def sample_indices(n_residues: str, count: int) -> str:
    """Evenly spread residue numbers from 0 to the last, floored, as SQL text."""
    used = f"least({count}, {n_residues})"
    spread = f"CAST(floor(k * (({n_residues} - 1) / ({used} - 1))) AS INT)"
    return (
        f"transform(sequence(0, {used} - 1), "
        f"k -> CASE WHEN k = 0 THEN 0 WHEN k = {used} - 1 THEN {n_residues} - 1 ELSE {spread} END)"
    )


def points_from_store(frames: DataFrame, count: int = FEATURE_RESIDUES) -> DataFrame:
    """Sampled C-alpha points of packed frames, whose `ca` holds three numbers a residue; in place."""
    indices = sample_indices("CAST(size(ca) / 3 AS INT)", count)
    return frames.withColumn("points", F.expr(f"transform({indices}, i -> named_struct('x', ca[3 * i], 'y', ca[3 * i + 1], 'z', ca[3 * i + 2]))")).drop("ca")


def sampled_points(frames: DataFrame, ca: str, count: int = FEATURE_RESIDUES) -> DataFrame:
    """Sampled C-alpha points from an array column, in place."""
    return frames.withColumn("points", F.expr(f"transform({sample_indices(f'size({ca})', count)}, i -> {ca}[i])"))


def frame_vectors(frames: DataFrame, count: int = FEATURE_RESIDUES) -> DataFrame:
    """Points centred on their own mean, flattened and zero-padded to 3 * count values; no shuffle."""
    centred = frames
    for axis in "xyz":
        total = f"aggregate(points, 0D, (s, p) -> s + p.{axis})"
        centred = centred.withColumn(f"_m{axis}", F.expr(f"{total} / size(points)"))
    flat = "flatten(transform(points, p -> array(p.x - _mx, p.y - _my, p.z - _mz)))"
    padded = f"concat({flat}, array_repeat(0D, 3 * ({count} - size(points))))"
    return centred.withColumn("vector", F.expr(padded)).drop("points", "_mx", "_my", "_mz")


MOMENTS = "traj_id string, n bigint, m array<double>, q array<double>"


def moment_parts(most: int = 4096):
    """Task-side count, means and sums of squared deviations of each trajectory's vectors, as arrays.

    Parts of a trajectory are merged pair by pair, which keeps every digit that a running sum of squares would lose. A
    task passes on its parts when it holds more than `most` trajectories and at its end.
    """
    def merged(a, b):
        (n, m, q), (k, p, r) = a, b
        gap, total = p - m, n + k
        return total, m + gap * (k / total), q + r + gap * gap * (n * k / total)

    def table(held: dict) -> pa.RecordBatch:
        counts, means, squares = zip(*held.values(), strict=True)
        columns = [list(held), counts, [m.tolist() for m in means], [q.tolist() for q in squares]]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["traj_id", "n", "m", "q"])

    def run(batches):
        held = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            numbers, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at, name in enumerate(names):
                x = values[numbers == at]
                m = x.mean(axis=0)
                part = len(x), m, ((x - m) ** 2).sum(axis=0)
                held[name] = merged(held[name], part) if name in held else part
            if len(held) > most:
                yield table(held)
                held = {}
        if held:
            yield table(held)

    def join(group: pa.Table) -> pa.Table:
        whole = None
        for n, m, q in zip(*[group.column(name).to_pylist() for name in ("n", "m", "q")], strict=True):
            part = n, np.array(m), np.array(q)
            whole = part if whole is None else merged(whole, part)
        return pa.Table.from_batches([table({group.column("traj_id")[0].as_py(): whole})])

    return run, join


def moments_of(vectors: DataFrame) -> DataFrame:
    """Count, means and sums of squared deviations of `vector` per trajectory: one row of arrays a task and trajectory moves."""
    run, join = moment_parts()
    return vectors.select("traj_id", "vector").mapInArrow(run, MOMENTS).groupBy("traj_id").applyInArrow(join, MOMENTS)


def standardised(vectors: DataFrame, *, n_trajectories: int | None = None) -> DataFrame:
    """Z-scores per trajectory and component (population deviation, floored at 1e-6).

    Moments are arrays from the start: each task adds up its frames' vectors, and only those arrays are shuffled, so a
    long trajectory costs no more than a short one; they return to the frames by a lookup join.
    """
    deviation = "transform(q, v -> greatest(sqrt(v / n), 1e-6D))"
    moments = moments_of(vectors).select("traj_id", F.col("m").alias("_m"), F.expr(deviation).alias("_s"))
    joined = lookup_join(vectors, moments, ["traj_id"], salt_by=["frame"], max_rows=20_000, known_rows=n_trajectories)
    scored = "transform(vector, (x, i) -> (x - _m[i]) / _s[i])"
    return joined.withColumn("z", F.expr(scored)).drop("vector", "_m", "_s")


# --- lagged covariance and slow coordinates ---------------------------------------------------------------------------


def lagged_pairs(frames: DataFrame, group: Sequence[str], position: str, lag: int, columns: dict[str, str]) -> DataFrame:
    """Each frame next to the frame `lag` later in its group; frames without one are dropped."""
    shifted = look_ahead(frames, group, position, lag, {**columns, position: "_there"})
    return shifted.filter(F.col("_there").isNotNull()).drop("_there")


def clipped_lag(lag: int) -> Column:
    """The lag used on an axis of `n_total` frames."""
    return F.greatest(F.lit(1), F.least(F.lit(lag), F.col("n_total") - 2)).cast("int")


def block_products():
    """The task-side product of one block of at most BLOCK + lag frames.

    Gives x'x + y'y and x'y + y'x with a leading column of ones. Defined inside a function so that it travels to the
    workers by value and the package need not be installed there.
    """
    kinds = {
        "domain_id": pa.string(), "n_total": pa.int64(), "i": pa.int32(), "j": pa.int32(), "same": pa.float64(),
        "across": pa.float64(),
    }

    def products(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        domain, n_total = table.column("domain_id")[0].as_py(), table.column("n_total")[0].as_py()
        lag = table.column("_lag")[0].as_py()
        home = int(np.count_nonzero(table.column("_home").to_numpy(zero_copy_only=False)))
        n_pairs = max(0, min(home, table.num_rows - lag))
        flat = table.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        z = np.hstack([np.ones((table.num_rows, 1)), flat.reshape(table.num_rows, -1)])
        x, y = z[:n_pairs], z[lag : lag + n_pairs]
        same, across = x.T @ x + y.T @ y, x.T @ y
        i, j = np.triu_indices(z.shape[1] if n_pairs else 0)
        columns = [[domain] * len(i), [n_total] * len(i), i, j, same[i, j], (across + across.T)[i, j]]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return products


PRODUCTS = "domain_id string, n_total bigint, i int, j int, same double, across double"


def lagged_products(scored: DataFrame, lag: int, *, pair_scope: str = "domain") -> DataFrame:
    """Summed lagged products of each domain as (i, j) rows with i <= j; index 0 is the constant 1.

    Frames are split into blocks of the frame axis with the next `lag` frames attached, so a long domain is many
    groups; each block is one matrix product, and only its (F + 1)^2 / 2 sums are shuffled on.
    pair_scope "domain" pairs across trajectory ends, "trajectory" does not.
    """
    position, group = ("frame_global", ["domain_id"]) if pair_scope == "domain" else ("frame", ["domain_id", "traj_id"])
    frames = scored.select(
        *group, "n_total", clipped_lag(lag).alias("_lag"), F.col(position).cast("bigint").alias("_at"), "z"
    )
    blocks = with_halo(frames, "_at", lag).groupBy(*group, "_block").applyInArrow(block_products(), PRODUCTS)
    return blocks.groupBy("domain_id", "n_total", "i", "j").agg(F.sum("same").alias("same"), F.sum("across").alias("across"))


def lagged_covariance(products: DataFrame) -> DataFrame:
    """Symmetrised instantaneous and lagged covariance with the pooled mean removed, for 0-based components i <= j."""
    firsts = products.filter("i = 0")
    count = firsts.filter("j = 0").select("domain_id", F.col("same").alias("_n"))
    mean = firsts.filter("j > 0").join(count, "domain_id").select("domain_id", "j", (F.col("same") / F.col("_n")).alias("m"))
    body = products.filter("i > 0").join(count, "domain_id")
    body = body.join(mean.withColumnsRenamed({"j": "i", "m": "_mi"}), ["domain_id", "i"])
    body = body.join(mean.withColumnRenamed("m", "_mj"), ["domain_id", "j"])
    both = F.col("_mi") * F.col("_mj")
    return body.select(
        "domain_id", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"),
        (F.col("same") / F.col("_n") - both).alias("c00"), (F.col("across") / F.col("_n") - both).alias("c0t"),
    )


MODELS = (
    "domain_id string, n_total bigint, dim int, mean array<double>, weights array<array<double>>, "
    "singular_values array<double>, score double, baseline double"
)


def slow_models(products: DataFrame, *, dim: int = SLOW_DIM, seed: int = 0) -> DataFrame:
    """One linear model per domain from its (F + 1) x (F + 1) sums, with the score of a random projection beside it.

    Only matrices of the feature size reach a group, never frames. The random projection is linear, so its score is
    taken from the projected matrices without a second pass over the frames.
    """
    cutoff = RANK_CUTOFF

    def slow_directions(c00: np.ndarray, c0t: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Leading eigenvalues of the whitened lagged covariance and their directions, scaled by the eigenvalue."""
        size, axes = np.linalg.eigh(c00)
        keep = size > cutoff
        if not keep.any():
            return np.zeros(0), np.zeros((len(c00), 0))
        whiten = axes[:, keep] / np.sqrt(size[keep])
        values, vectors = np.linalg.eigh(whiten.T @ c0t @ whiten)
        order = np.argsort(-np.abs(values))[:count]
        values, directions = values[order], whiten @ vectors[:, order]
        largest = np.abs(directions).argmax(axis=0)
        directions = directions * np.where(directions[largest, np.arange(len(order))] < 0, -1.0, 1.0)
        return values, directions * values

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        order = int(rows["j"].max()) + 1
        same, across = np.zeros((order, order)), np.zeros((order, order))
        for matrix, column in ((same, "same"), (across, "across")):
            matrix[rows["i"], rows["j"]] = rows[column]
            matrix[rows["j"], rows["i"]] = rows[column]
        n_features, n_total = order - 1, int(rows["n_total"].iloc[0])
        mean = same[0, 1:] / same[0, 0]
        c00 = same[1:, 1:] / same[0, 0] - np.outer(mean, mean)
        c0t = across[1:, 1:] / same[0, 0] - np.outer(mean, mean)
        kept = max(1, min(dim, n_features, n_total - 1))
        values, weights = slow_directions(c00, c0t, kept)
        width = max(1, min(dim, n_features))
        projection = np.random.default_rng(seed).normal(size=(n_features, width)).astype(np.float32).astype(float)
        baseline, _ = slow_directions(projection.T @ c00 @ projection, projection.T @ c0t @ projection,
                                      max(1, min(width, n_total - 1)))
        return pd.DataFrame([{
            "domain_id": rows["domain_id"].iloc[0], "n_total": n_total, "dim": len(values), "mean": mean,
            "weights": weights.T.tolist(), "singular_values": values,
            "score": float(np.sum(values**2)), "baseline": float(np.sum(baseline**2)),
        }])

    return products.groupBy("domain_id").applyInPandas(solve, MODELS)


def embedded(scored: DataFrame, models: DataFrame, *, n_domains: int | None = None) -> DataFrame:
    """Frames on their domain's slow coordinates, as array `e`. A domain without a model gets an empty array."""
    model = models.select("domain_id", "mean", "weights")
    joined = lookup_join(
        scored, model, ["domain_id"], "left", salt_by=["traj_id", "frame"], max_rows=2_000, known_rows=n_domains
    )
    centred = joined.withColumn("_d", F.expr("zip_with(z, mean, (x, m) -> x - m)"))
    score = "transform(weights, w -> aggregate(zip_with(_d, w, (a, b) -> a * b), 0D, (s, x) -> s + x))"
    coordinates = F.coalesce(F.expr(score), F.array().cast("array<double>"))
    return centred.withColumn("e", coordinates).drop("z", "mean", "weights", "_d")


def health_gate(models: DataFrame, margin: float = 0.0) -> DataFrame:
    """Whether the score beats the random projection by more than the margin, and the method name that follows."""
    passed = F.coalesce(F.col("score") > F.col("baseline") + F.lit(margin), F.lit(False))
    return models.withColumn("health_passed", passed).withColumns({
        "method": F.when(F.col("health_passed"), PASSED_METHOD).otherwise(FALLBACK_METHOD),
        "fallback_reason": F.when(~F.col("health_passed"), FALLBACK_REASON),
    })


# --- clustering -------------------------------------------------------------------------------------------------------


#: One clustering: a domain, a resolution, and one of several starts.
SET = ["domain_id", "resolution", "run"]
STARTS = 5
SEED_ROUNDS = 3
# Candidates that a round of seeding draws for each wanted centroid, on average.
OVERSAMPLING = 2.0
# Squared distance that a centroid moves at most once its run has settled.
SETTLED = 1e-12
# Coordinates of all centroids together up to which they travel to the tasks; beyond, they are joined to the points.
CENTROID_ENTRIES = 2_000_000


def resolution_plan(totals: DataFrame, resolutions: Sequence[int], starts: int = 1) -> DataFrame:
    """(domain_id, resolution, run, k) with k limited by the domain's number of frames."""
    each = F.explode(F.array(*[F.lit(r) for r in resolutions])).alias("resolution")
    sized = totals.select("domain_id", "n_total", each).withColumn(
        "k", F.greatest(F.lit(1), F.least(F.col("resolution").cast("bigint"), F.col("n_total"))).cast("int")
    )
    return sized.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))


def first_centroids(points: DataFrame, plan: DataFrame, seed: int = 0, *, n_picks: int | None = None) -> DataFrame:
    """Seeded start: one frame from each of k equal stretches of the frame axis, all different; each run draws its own."""
    def bound(step: Column) -> Column:
        return F.floor(step.cast("bigint") * F.col("n_total") / F.col("k"))

    slots = plan.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    low, high = bound(F.col("cluster")), bound(F.col("cluster") + 1)
    drawn = F.pmod(draw_of(F.col("run") + F.lit(seed), F.col("domain_id"), F.col("resolution"), F.col("cluster")), high - low)
    picks = slots.withColumn("frame_global", low + drawn).drop("n_total", "k")
    found = lookup_join(
        points.select("domain_id", "frame_global", "e"), picks, ["domain_id", "frame_global"], salt_by=["frame_global"],
        known_rows=n_picks,
    )
    return found.select(*SET, "cluster", "e")


def packed_centroids(centroids: DataFrame) -> DataFrame:
    """Centroids of a run as one array; at most the resolution's number of entries."""
    return centroids.groupBy(*SET).agg(F.array_sort(F.collect_list(F.struct("cluster", F.col("e").alias("at")))).alias("centroids"))


def assigned(points: DataFrame, centroids: DataFrame, *, n_domains: int | None = None) -> DataFrame:
    """Nearest centroid of every point in every run (lowest number on ties) and its squared distance `d`, without a
    shuffle of points.
    """
    # One lookup row holds all runs of a domain.
    grouped = packed_centroids(centroids).groupBy("domain_id").agg(F.collect_list(F.struct("resolution", "run", "centroids")).alias("sets"))
    joined = lookup_join(points, grouped, ["domain_id"], salt_by=["frame_global"], max_rows=10_000, known_rows=n_domains)
    distance = "aggregate(zip_with(c.at, e, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)"
    nearest = f"array_min(transform(centroids, c -> struct({distance} AS d, c.cluster AS cluster)))"
    found = joined.select(*points.columns, F.inline("sets")).withColumn("_near", F.expr(nearest))
    return found.withColumns({"cluster": F.col("_near.cluster"), "d": F.col("_near.d")}).drop("centroids", "_near")


def uniform(points: DataFrame, dim: int) -> bool:
    """Whether every point has `dim` finite coordinates, so that `summed` may take them."""
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return points.filter(F.coalesce((F.size("e") != dim) | odd, F.lit(True))).select("domain_id").isEmpty()


def summed(points: DataFrame, centroids: DataFrame, dim: int) -> DataFrame:
    """For each centroid how many points are nearest to it (`n`), their sums (`sums`) and squared distances (`cost`), a row a task.

    The same distances, added in the same order, and the same ties as in `assigned`, on Arrow batches: centroids travel
    to the tasks, and no point becomes a row for each run. For points that are `uniform` and centroids that fit.
    """
    rows = centroids.select(*SET, "cluster", "e").orderBy(*SET, "cluster").collect()
    sets: dict[str, dict[tuple[int, int], list]] = {}
    for row in rows:
        sets.setdefault(row["domain_id"], {}).setdefault((row["resolution"], row["run"]), []).append((row["cluster"], row["e"]))
    held = {d: [(*of, [c for c, _ in each], np.array([e for _, e in each], float)) for of, each in of_d.items()] for d, of_d in sets.items()}
    kinds = {f.name: f.dataType.simpleString() for f in centroids.schema.fields}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, list] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            at, own = np.asarray(batch.column(1).flatten(), float).reshape(-1, dim), names.indices.to_numpy(zero_copy_only=False)
            for number, domain in enumerate(names.dictionary.to_pylist()):
                columns = np.ascontiguousarray(at[own == number].T)
                for resolution, run, clusters, centres in held.get(domain, ()):
                    gaps = np.zeros((len(centres), columns.shape[1]))
                    for axis, column in enumerate(columns):
                        gap = centres[:, axis, None] - column
                        gaps += gap * gap
                    owner, k = gaps.argmin(axis=0), len(centres)
                    parts = [
                        np.bincount(owner, minlength=k), np.stack([np.bincount(owner, weights=c, minlength=k) for c in columns], axis=1),
                        np.bincount(owner, weights=gaps.min(axis=0), minlength=k),
                    ]
                    key = (domain, resolution, run)
                    done[key] = [clusters, *parts] if key not in done else [clusters, *[x + y for x, y in zip(done[key][1:], parts)]]
        found = [(*key, c, int(n), s.tolist(), float(d)) for key, (clusters, *parts) in done.items() for c, n, s, d in zip(clusters, *parts) if n]
        if found:
            kind = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), kind)], [*SET, "cluster", "n", "sums", "cost"])

    schema = "domain_id string, resolution int, run int, cluster bigint, n bigint, sums array<double>, cost double"
    return points.select("domain_id", "e").mapInArrow(add, schema).withColumn("cluster", F.col("cluster").cast(kinds["cluster"]))


def lloyd_step(points: DataFrame, centroids: DataFrame, dim: int, *, n_domains: int | None = None, packed: bool = False) -> DataFrame:
    """One step for all domains, resolutions and runs: assign, then average; a cluster without points stays in place.

    `moved` is the squared distance that a centroid went. Averages combine per task before the shuffle, so only
    centroid-sized rows move. With `packed`, they come from `summed`.
    """
    if packed:
        parts = summed(points, centroids, dim).groupBy(*SET, "cluster")
        added = parts.agg(F.sum("n").alias("_n"), *[F.sum(F.col("sums")[c]).alias(f"_{c}") for c in range(dim)])
        averaged = added.select(*SET, "cluster", *[(F.col(f"_{c}") / F.col("_n")).alias(f"_{c}") for c in range(dim)])
    else:
        means = [F.avg(F.get(F.col("e"), F.lit(c))).alias(f"_{c}") for c in range(dim)]
        averaged = assigned(points, centroids, n_domains=n_domains).groupBy(*SET, "cluster").agg(*means)
    new = averaged.select(
        *SET, "cluster", F.filter(F.array(*[F.col(f"_{c}") for c in range(dim)]), lambda x: x.isNotNull()).alias("_new"),
    )
    kept = centroids.select(*SET, "cluster", "e").join(new, [*SET, "cluster"], "left").withColumn("_new", F.coalesce("_new", "e"))
    gap = F.aggregate(F.zip_with("e", "_new", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return kept.select(*SET, "cluster", F.col("_new").alias("e"), gap.alias("moved"))


def recluster(seed: int, steps: int = 20):
    """Task-side choice of k centroids among weighted candidates of one run: weighted k-means++, then weighted steps."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        k, rows = int(rows["k"].iloc[0]), rows.sort_values("cluster")
        at, weight = np.array(rows["e"].tolist(), dtype=float), rows["weight"].to_numpy(dtype=float)
        draws = np.random.default_rng([seed, int(rows["run"].iloc[0]), int(rows["resolution"].iloc[0])])
        picked = [int(draws.choice(len(at), p=weight / weight.sum()))]
        near = ((at - at[picked[0]]) ** 2).sum(axis=1)
        while len(picked) < min(k, len(at)) and (near * weight).sum() > 0:
            picked.append(int(draws.choice(len(at), p=near * weight / (near * weight).sum())))
            near = np.minimum(near, ((at - at[picked[-1]]) ** 2).sum(axis=1))
        centres = at[picked]
        for _ in range(steps):
            owner = ((at[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            mass = np.bincount(owner, weights=weight, minlength=len(centres))
            sums = np.stack([np.bincount(owner, weights=weight * column, minlength=len(centres)) for column in at.T], axis=1)
            centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
        first = rows.iloc[0]
        return pd.DataFrame({
            "domain_id": first["domain_id"], "resolution": first["resolution"], "run": first["run"],
            "cluster": np.arange(len(centres)), "e": list(centres),
        })

    return choose


def oversampled_centroids(points: DataFrame, plan: DataFrame, seed: int = 0, *, rounds: int = SEED_ROUNDS, n_domains: int | None = None) -> DataFrame:
    """Distributed seeding by oversampling (k-means||), for all runs together.

    Each round draws every point with a chance in proportion to its squared distance from the candidates so far, about
    OVERSAMPLING * k points a run, by a seeded hash. Candidates are weighed by the points nearest to them, and the
    weighted candidates of a run, a few hundred at most whatever the number of frames, are clustered in one task.
    Centroids that the data do not support (fewer different points than k) come from the stretches of `first_centroids`.
    """
    firsts = plan.withColumn("frame_global", F.pmod(draw_of(F.col("run") + F.lit(seed), F.col("domain_id"), F.col("resolution"), F.lit("first")), F.col("n_total")))
    found = lookup_join(points.select("domain_id", "frame_global", "e"), firsts.select(*SET, "frame_global"), ["domain_id", "frame_global"], salt_by=["frame_global"])
    candidates = cut_lineage(found.select(*SET, F.col("frame_global").alias("cluster"), "e"))
    wanted = plan.select(*SET, "k")
    for number in range(rounds):
        near = assigned(points, candidates, n_domains=n_domains)
        cost = near.groupBy(*SET).agg(F.sum("d").alias("_cost")).join(wanted, SET)
        costs = F.broadcast(cut_lineage(cost)) if n_domains is not None and n_domains <= 10_000 else cost
        luck = draw_of(F.col("run") + F.lit(seed), F.col("domain_id"), F.col("resolution"), F.lit(f"round{number}"), F.col("frame_global")) / F.lit(4294967296.0)
        drawn = near.join(costs, SET).filter((F.col("d") > 0) & (luck < F.lit(OVERSAMPLING) * F.col("k") * F.col("d") / F.col("_cost")))
        candidates = cut_lineage(candidates.unionByName(drawn.select(*SET, F.col("frame_global").alias("cluster"), "e")))
    weights = assigned(points, candidates, n_domains=n_domains).groupBy(*SET, "cluster").agg(F.count(F.lit(1)).alias("weight"))
    weighed = candidates.join(weights, [*SET, "cluster"]).join(wanted, SET)
    schema = "domain_id string, resolution int, run int, cluster int, e array<double>"
    chosen = cut_lineage(weighed.groupBy(*SET).applyInPandas(recluster(seed), schema))
    rest = first_centroids(points, plan, seed).join(chosen.select(*SET, "cluster"), [*SET, "cluster"], "left_anti")
    return chosen.unionByName(rest.withColumn("cluster", F.col("cluster").cast("int")))


def draw_of(seed: Column, *parts: Column) -> Column:
    """A uniform integer in [0, 2**32) from a seed column and parts."""
    text = F.concat_ws(":", seed.cast("string"), *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def settled_centroids(points: DataFrame, centroids: DataFrame, dim: int, iterations: int, *, n_domains: int | None = None, packed: bool = False) -> DataFrame:
    """Lloyd steps of all runs together until each has settled, at most `iterations`; settled runs take no further part."""
    active, done = centroids, None
    for _ in range(iterations):
        stepped = cut_lineage(lloyd_step(points, active, dim, n_domains=n_domains, packed=packed))
        moving = stepped.groupBy(*SET).agg(F.max("moved").alias("_most")).filter(F.col("_most") > SETTLED).select(*SET)
        active = cut_lineage(stepped.join(moving, SET, "left_semi").drop("moved"))
        quiet = stepped.join(moving, SET, "left_anti").drop("moved")
        done = quiet if done is None else done.unionByName(quiet)
        if active.isEmpty():
            return done
    return active if done is None else done.unionByName(active)


def best_runs(points: DataFrame, centroids: DataFrame, *, n_domains: int | None = None, packed: int = 0) -> DataFrame:
    """Centroids of the run with the least inertia (sum of squared distances; ties to the lower run) of each clustering.

    `packed` is the number of coordinates where `summed` may take the points.
    """
    costs = summed(points, centroids, packed).withColumnRenamed("cost", "d") if packed else assigned(points, centroids, n_domains=n_domains)
    inertia = costs.groupBy(*SET).agg(F.sum("d").alias("inertia"))
    best = inertia.groupBy("domain_id", "resolution").agg(F.min(F.struct(F.round("inertia", 9).alias("i"), "run")).alias("b"))
    return centroids.join(best.select("domain_id", "resolution", F.col("b.run").alias("run")), SET, "left_semi")


def clustered(
    points: DataFrame, totals: DataFrame, resolutions: Sequence[int] = RESOLUTIONS, *,
    dim: int = SLOW_DIM, seed: int = 0, iterations: int = 10, starts: int = 1, seeding: str = "stretches",
) -> DataFrame:
    """Labels of every frame at every resolution: the best of several starts by inertia.

    `points` must be materialised by the caller, as it is read once per step. Starts and domains advance together, so
    that a step is one pass over the points whatever their number. Centroids are checkpointed each step, which keeps
    the plan short and lets a step restart when an executor is lost; steps end when every run has settled. States are
    numbered by the first frame they appear in.
    """
    totals = cut_lineage(totals)
    n_domains = totals.count()
    plan = cut_lineage(resolution_plan(totals, resolutions, starts))
    if seeding == "oversampled":
        start = oversampled_centroids(points, plan, seed, n_domains=n_domains)
    else:
        start = first_centroids(points, plan, seed, n_picks=n_domains * sum(resolutions) * starts)
    start = cut_lineage(start)
    packed = fits(start, CENTROID_ENTRIES, F.size("e")) and uniform(points, dim) and uniform(start, dim)
    centroids = cut_lineage(settled_centroids(points, start, dim, iterations, n_domains=n_domains, packed=packed))
    if starts > 1:
        centroids = cut_lineage(best_runs(points, centroids, n_domains=n_domains, packed=dim if packed else 0))
    labelled = assigned(points, centroids, n_domains=n_domains).drop("run", "d")
    firsts = labelled.groupBy("domain_id", "resolution", "cluster").agg(F.min("frame_global").alias("_first"))
    order = Window.partitionBy("domain_id", "resolution").orderBy("_first")
    states = firsts.select(
        "domain_id", "resolution", "cluster", (F.row_number().over(order) - 1).cast("bigint").alias("state")
    )
    return lookup_join(
        labelled, states, ["domain_id", "resolution", "cluster"], salt_by=["frame_global"],
        known_rows=n_domains * sum(resolutions),
    ).drop("cluster")
