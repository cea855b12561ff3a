import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moltraj import schema
from moltraj.functions import kernels
from moltraj.operators import features, labels, packed, pairs, sasa, selection, topology
from moltraj.plans import queries
from tests.test_jobs import exchanges_with

SF = "/root/testdata/sf0.001"


def brute_pairs(frame, points, reach):
    found = set()
    for a in range(len(points)):
        for b in range(len(points)):
            if a != b and frame[a] == frame[b] and ((points[a] - points[b]) ** 2).sum() < reach * reach:
                found.add((a, b))
    return found


@pytest.mark.parametrize("scale", [1.0, 30.0, 1e7])
def test_cell_list_finds_all_neighbours(scale):
    draw = np.random.default_rng(1)
    points = draw.normal(size=(120, 3)) * scale
    points[5], points[9], points[20:24] = np.nan, points[8], points[20]
    frame = np.sort(draw.integers(0, 4, 120))
    for reach in (0.7 * scale, 3.0 * scale):
        with np.errstate(invalid="ignore"):
            expected = brute_pairs(frame, points, reach)
        for at_once in (7, 400_000):
            got = [(a, b) for x, y, _ in kernels.neighbours(frame, points, reach, at_once) for a, b in zip(x.tolist(), y.tolist())]
            assert len(got) == len(set(got)) and set(got) == expected
    assert list(kernels.neighbours(np.zeros(0, int), np.zeros((0, 3)), 1.0)) == []


def test_nearest_takes_ties_by_number():
    points = np.array([[0, 0, 0], [1, 0, 0], [-1, 0, 0], [0, 1, 0], [9, 9, 9]], float)
    a, b, place, distance = kernels.nearest(np.zeros(5, int), points, 2.0, 2)
    assert list(zip(a, b, place))[:2] == [(0, 1, 1), (0, 2, 2)] and 4 not in a and distance[0] == 1.0


def awkward(spark):
    """Frames with null points, too few points, missing labels and a domain without residues."""
    atoms = spark.createDataFrame(
        [("d", 3 * r + k, name, "A", r, "ALA", name[0]) for r in range(3) for k, name in enumerate(("N", "CA", "C"))]
        + [("e", 0, "CA", "A", 0, "GLY", "C"), ("e", 1, "CB", "A", 0, "GLY", "C")], schema.ATOMS)
    draw = np.random.default_rng(2)
    def cloud(n):
        return [tuple(map(float, p)) for p in draw.normal(size=(n, 3)).astype(np.float32)]
    broken = cloud(9)
    broken[4] = None
    rows = [
        ("d", "320", 0, 0, 0.1, ["H", None, " E"], cloud(9)), ("d", "320", 0, 1, 0.1, ["T"], cloud(4)), ("d", "320", 0, 2, 0.1, None, broken),
        ("d", "450", 1, 0, None, [], [(0.0, 0.0, 0.0)] * 9), ("e", "320", 0, 0, 0.1, ["B"], cloud(2)), ("e", "320", 0, 1, 0.1, ["-"], []),
    ]
    return atoms, spark.createDataFrame(rows, schema.FRAMES)


def test_packed_frames_equal_residue_rows(spark):
    """The batch kernel and the generated expressions give the same numbers to the last bit."""
    atoms, frames = awkward(spark)
    sites = topology.residue_sites(topology.residues(atoms))
    rows = features.residue_features(frames, sites)
    got = packed.unpacked(packed.packed_frames(packed.with_domain_arrays(frames, sites)))
    names = [c for c in rows.columns if c != "sasa"]
    key = lambda row: tuple(row)[:6]
    expected, found = sorted(rows.select(*names).collect(), key=key), sorted(got.select(*names).collect(), key=key)
    assert len(found) == 14
    for a, b in zip(expected, found, strict=True):
        for name in names:
            same = a[name] == b[name] or (isinstance(a[name], float) and math.isnan(a[name]) and math.isnan(b[name]))
            assert same, (name, a, b)


def test_areas_in_the_packed_row_equal_area_rows(spark):
    atoms, frames = awkward(spark)
    residues = topology.residues(atoms)
    arrays = packed.domain_arrays(topology.residue_sites(residues), sasa.domain_spheres(atoms, residues))
    rows = packed.unpacked(packed.packed_frames(packed.with_domain_arrays(frames, arrays)))
    got = {tuple(r)[:5]: r.sasa for r in rows.select(*schema.FRAME_KEY, "residue_index", "sasa").collect()}
    areas = sasa.residue_areas(sasa.atom_spheres(frames, atoms, residues)).collect()
    assert got == {tuple(r)[:5]: pytest.approx(r.area) for r in areas}


def test_half_precision_and_canonical_numbers(spark):
    values = [0.1, -0.0, 65504.0, 65520.0, -70000.0, 5.96e-8, 1e-9, math.nan, math.inf, 2.0009765625]
    df = spark.createDataFrame([(values,), ([],), (None,)], "v array<double>")
    got = [row.h for row in df.select(packed.half_precision(F.col("v")).alias("h")).collect()]
    assert str(got[0]) == str([float(np.float16(v)) for v in values]) and got[1] == []
    whole = kernels.canonical_whole(np.array([1.00004, -1.00006, math.nan, math.inf, -math.inf, 0.0]))
    assert whole.tolist() == [10000, -10001, kernels.NO_NUMBER, kernels.ABOVE, kernels.BELOW, 0]


def test_digest_is_over_the_frame_in_order(spark):
    row = ("d", "320", 0, 0, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [0.0, 1.0] * 3, [2], [8], None)
    kinds = "ca array<double>, cb array<double>, torsions array<double>, dssp array<int>, residue_type array<int>, sasa array<double>"
    df = spark.createDataFrame([row, (*row[:3], 1, [], [], [], [], [], None)], f"domain_id string, temperature string, replicate int, frame int, {kinds}")
    numbers = [10000, 20000, 30000] * 2 + [0, 10000] * 3 + [2, 8, 1]
    expected = hashlib.sha256(b"".join(n.to_bytes(8, "big", signed=True) for n in numbers)).hexdigest()
    got = {r.frame: r.digest for r in packed.frame_digests(df).collect()}
    assert got == {0: expected, 1: hashlib.sha256(b"").hexdigest()}


def test_a_lost_or_shortened_frame_fails_its_trajectory(spark):
    key = "domain_id string, temperature string, replicate int, frame int, ca array<double>"
    raw = spark.createDataFrame([("d", "1", 0, f, [1.0, 2.0, 3.0] * 2) for f in range(3)] + [("d", "2", 0, 0, [1.0] * 3), ("d", "3", 0, 0, [1.0] * 3), ("d", "4", 0, 0, [math.nan] * 3)], key)
    stored = spark.createDataFrame([("d", "1", 0, f, [1.0, 2.0, 3.01] * 2) for f in range(3)] + [("d", "2", 0, 0, [1.0] * 3), ("d", "2", 0, 1, [1.0] * 3), ("d", "3", 0, 0, []), ("d", "4", 0, 0, [1.0] * 3)], key)
    got = {r.temperature: r for r in packed.roundtrip_rmsd(packed.beside(raw, stored), 0.05).collect()}
    assert got["1"].passed and got["1"].rmsd_angstrom == pytest.approx(0.01 / math.sqrt(3)) and got["1"].n_frames == 3
    assert not got["2"].passed and not got["3"].passed and not got["4"].passed


@pytest.mark.parametrize("name, column", [("trajectory_hash", "ca"), ("roundtrip_rmsd", "ca"), ("residue_sasa", "area"), ("contact_graph", "distance"), ("frame_features", "component")])
def test_no_shuffle_of_frames_after_they_are_packed(spark, name, column):
    assert exchanges_with(queries.REGISTERED[name](spark, SF), column) == 0


def test_bitmaps_renumber_kept_frames(spark):
    draw = np.random.default_rng(3)
    rmsd = [None if u < 0.1 else math.nan if u < 0.2 else float(np.float32(8 * u)) for u in draw.random(700)]
    rows = [("d", t, 0, f, v, [], []) for t in ("450", "320") for f, v in enumerate(rmsd)] + [("e", "450", 2, f, 9.0, [], []) for f in range(5)]
    frames = spark.createDataFrame(rows, schema.FRAMES).repartition(5)
    series = spark.createDataFrame([("d", "450", 0, 700, "A", True), ("d", "320", 0, 700, "A", True), ("e", "450", 2, 5, "A", True)], schema.TRAJECTORIES)
    got = features.kept_frames(frames, series).select("domain_id", "temperature", "source_frame", "frame").collect()
    kept = [f for f, v in enumerate(rmsd) if v is not None and not math.isnan(v) and v <= 4]
    assert sorted((r.source_frame, r.frame) for r in got if r.temperature == "450") == [(f, i) for i, f in enumerate(kept)]
    assert sorted((r.source_frame, r.frame) for r in got if r.temperature == "320") == [(f, f) for f in range(700)]


def test_array_moments_match_numpy_far_from_zero(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(500, 3)) + np.array([1e8, 0, -1e6])
    rows = [(f"t{i % 3}", i, [float(v) for v in row]) for i, row in enumerate(x)] + [("lone", 0, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "traj_id string, frame int, vector array<double>").repartition(7)
    got = {r.traj_id: r for r in labels.moments_of(df).collect()}
    for t in range(3):
        part = x[t::3]
        assert got[f"t{t}"].n == len(part)
        assert np.allclose(got[f"t{t}"].m, part.mean(axis=0), rtol=1e-12)
        assert np.allclose(np.array(got[f"t{t}"].q) / len(part), part.var(axis=0), rtol=1e-9)
    assert got["lone"].q == [0.0, 0.0, 0.0]
    z = {(r.traj_id, r.frame): r.z for r in labels.standardised(df).collect()}
    assert z["lone", 0] == [0.0, 0.0, 0.0]


def test_contact_edges_of_a_frame(spark):
    rows = [("d", "320", 0, f, 0.1, [], [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (5.0, 0.0, 0.0)]) for f in range(2)] + [("d", "320", 0, 2, 0.1, [], [])]
    got = pairs.contact_graph(spark.createDataFrame(rows, schema.FRAMES), radius=4.5, neighbours=1).collect()
    assert sorted((r.frame, r.residue_index, r.other_residue_index, r.place, r.distance) for r in got) == [
        (f, *edge) for f in range(2) for edge in ((0, 1, 1, 1.0), (1, 0, 1, 1.0), (2, 1, 1, 4.0))
    ]


def test_contact_edges_take_a_bounded_number_of_points_at_a_time(spark, monkeypatch):
    """a worker held whole Arrow batches of up to 10,000 frames in its cell list."""
    draw = np.random.default_rng(4)
    clouds = [draw.normal(size=(int(n), 3)) * 3 for n in [0, 3, 40, 5, 0, 12, 12, 12, *draw.integers(1, 9, 30)]]
    rows = [("d", "320", 0, f, 0.1, [], [tuple(map(float, p)) for p in cloud]) for f, cloud in enumerate(clouds)]
    frames = spark.createDataFrame(rows, schema.FRAMES).repartition(1)
    kernel = {name: getattr(pairs.kernels, name) for name in ("starts_of", "stretches", "nearest")}
    found = kernel["nearest"]

    def bounded(frame, points, *rest):
        assert len(points) <= 24 or len(set(frame.tolist())) == 1
        return found(frame, points, *rest)

    expected = sorted(map(tuple, pairs.contact_graph(frames, radius=4.0, neighbours=3).collect()))
    monkeypatch.setattr(pairs, "POINTS_AT_ONCE", 24)
    monkeypatch.setattr(pairs, "kernels", type("Kernels", (), {**{n: staticmethod(f) for n, f in kernel.items()}, "nearest": staticmethod(bounded)}))
    got = sorted(map(tuple, pairs.contact_graph(frames, radius=4.0, neighbours=3).collect()))
    assert got == expected and len({r[3] for r in got}) > 20


@pytest.mark.parametrize("axes", [1, 2, 8, 60])
def test_counts_within_a_radius_in_many_dimensions(spark, axes):
    draw = np.random.default_rng(axes)
    centres = draw.normal(size=(6, axes)) * 2
    cloud = np.round(np.concatenate([centres[draw.integers(0, 6, 240)] + draw.normal(size=(240, axes)) * 0.25, np.zeros((60, axes))]), 2)
    names = [f"a{i}" for i in range(axes)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "id int, " + ", ".join(f"{n} double" for n in names))
    radius = 0.3 * math.sqrt(axes) + 1e-6
    expected = [int(np.count_nonzero(((cloud - p) ** 2).sum(1) <= radius * radius)) for p in cloud]
    for grid in (1, 3):
        got = {r.id: r.n_visits for r in selection.visits_within(df, df, "id", names, radius, grid_axes=grid).collect()}
        assert [got[i] for i in range(300)] == expected
    hashed = {r.id: r.n_visits for r in selection.visits_within_hashed(df, df, "id", names, radius).collect()}
    assert all(hashed[i] <= expected[i] for i in range(300))
    assert sum(hashed.values()) >= 0.95 * sum(expected)


def blobs(spark, groups, each, seed=0):
    draw = np.random.default_rng(seed)
    points = np.concatenate([draw.normal(size=(each, 2)) * 0.1 + np.array([10.0 * g, (-1) ** g * 5.0]) for g in range(groups)])
    rows = [("d", t, len(points), [float(v) for v in x]) for t, x in enumerate(points)]
    df = spark.createDataFrame(rows, "domain_id string, frame_global bigint, n_total bigint, e array<double>")
    return df, points


def inertia(spark, points, labelled, resolution):
    owner = {r.frame_global: r.state for r in labelled.filter(F.col("resolution") == resolution).collect()}
    total = 0.0
    for state in set(owner.values()):
        part = points[[t for t, s in owner.items() if s == state]]
        total += ((part - part.mean(axis=0)) ** 2).sum()
    return total


def test_oversampled_starts_find_all_groups(spark):
    """Groups far apart: every one gets a centroid, whatever the order of frames; one start from stretches alone need not."""
    df, points = blobs(spark, 8, 40)
    totals = df.select("domain_id", "n_total").distinct()
    ideal = sum(((points[40 * g : 40 * g + 40] - points[40 * g : 40 * g + 40].mean(axis=0)) ** 2).sum() for g in range(8))
    found = labels.clustered(df, totals, (8, 400), dim=2, iterations=30, starts=3, seeding="oversampled")
    assert inertia(spark, points, found, 8) == pytest.approx(ideal, rel=1e-6)
    again = labels.clustered(df, totals, (8, 400), dim=2, iterations=30, starts=3, seeding="oversampled")
    assert sorted(found.collect(), key=str) == sorted(again.collect(), key=str)
    assert inertia(spark, points, found, 400) < 0.6 * ideal


def test_more_starts_are_never_worse_and_runs_settle(spark):
    draw = np.random.default_rng(9)
    points = draw.random((150, 2))
    df = spark.createDataFrame([("d", t, 150, [float(v) for v in x]) for t, x in enumerate(points)], "domain_id string, frame_global bigint, n_total bigint, e array<double>")
    totals = df.select("domain_id", "n_total").distinct()
    one, five = (inertia(spark, points, labels.clustered(df, totals, (6,), dim=2, iterations=40, starts=n), 6) for n in (1, 5))
    assert five <= one + 1e-9
    start = labels.first_centroids(df, labels.resolution_plan(totals, (6,), 5))
    settled = labels.settled_centroids(df, start, 2, 60)
    assert settled.count() == 30
    assert labels.lloyd_step(df, settled, 2).agg(F.max("moved")).first()[0] <= labels.SETTLED


def test_equal_points_and_one_point_cluster(spark):
    rows = [("d", t, 9, [1.0, 2.0]) for t in range(9)] + [("e", 0, 1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "domain_id string, frame_global bigint, n_total bigint, e array<double>")
    for seeding in ("stretches", "oversampled"):
        found = labels.clustered(df, df.select("domain_id", "n_total").distinct(), (1, 4), dim=2, iterations=5, starts=2, seeding=seeding)
        assert {(r.domain_id, r.state) for r in found.collect()} == {("d", 0), ("e", 0)}


def test_packed_steps_equal_joined_steps(spark, monkeypatch):
    """centroids travel to the tasks; sums, ties and the best run are those of the joined form."""
    draw = np.random.default_rng(7)
    rows = [(f"d{i % 3}", i // 3, [float(x) for x in np.round(draw.normal(size=4), 1)]) for i in range(240)]
    points = spark.createDataFrame(rows, "domain_id string, frame_global bigint, e array<double>").localCheckpoint()
    plan = labels.resolution_plan(points.groupBy("domain_id").count().withColumnRenamed("count", "n_total"), (2, 5), 3)
    start = labels.first_centroids(points, plan).localCheckpoint()
    assert labels.uniform(points, 4) and not labels.uniform(points, 3)
    steps = []
    for packed in (False, True):
        step = labels.lloyd_step(points, start, 4, packed=packed)
        steps.append({(r.domain_id, r.resolution, r.run, r.cluster): r.e for r in step.collect()})
    assert steps[0].keys() == steps[1].keys() and len(steps[0]) == 63
    assert all(np.allclose(steps[0][key], steps[1][key], rtol=1e-12, atol=1e-15) for key in steps[0])
    best = [sorted((r.domain_id, r.resolution, r.run, r.cluster) for r in labels.best_runs(points, start, packed=p).collect()) for p in (0, 4)]
    assert best[0] == best[1]
