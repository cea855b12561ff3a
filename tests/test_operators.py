import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moltraj import schema
from moltraj.functions import codes, numeric
from moltraj.functions import geometry as geo
from moltraj.operators import checks, features, fingerprint, labels, metrics, packed, pairs, sasa, selection, splits, topology
from moltraj.sources import landing
from moltraj.streaming import runs

ATOM = "domain_id string, atom_index int, atom_name string, chain string, resid int, resname string, element string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def numpy_dihedral(p):
    b0, b1, b2 = p[0] - p[1], p[2] - p[1], p[3] - p[2]
    b1 = b1 / max(np.linalg.norm(b1), 1e-8)
    v, w = b0 - b0 @ b1 * b1, b2 - b2 @ b1 * b1
    return math.atan2(np.cross(b1, v) @ w, v @ w)


# --- columns ---------------------------------------------------------------------------------------------------------


def test_dihedral_sign(spark):
    points = [tuple(f"DOUBLE({v})" for v in p) for p in ((1, 0, 0), (0, 0, 0), (0, 0, 1), (0, 1, 1))]
    assert one(spark, geo.dihedral(*points)) == pytest.approx(math.pi / 2)


def test_dihedrals_match_numpy_and_survive_rotation(spark):
    rng = np.random.default_rng(1)
    sets = rng.normal(size=(200, 4, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    both = np.concatenate([sets, sets @ turn.T + 5.0])
    names = [f"p{i}_{a}" for i in range(4) for a in "xyz"]
    df = spark.createDataFrame([(i, *map(float, s.ravel())) for i, s in enumerate(both)], ["i", *names])
    angle = geo.dihedral(*[geo.vector(f"p{i}") for i in range(4)])
    got = [r.a for r in df.select("i", angle.alias("a")).orderBy("i").collect()]
    expected = [numpy_dihedral(s) for s in sets]
    assert got[:200] == pytest.approx(expected, abs=1e-9)
    assert got[200:] == pytest.approx(expected, abs=1e-6)


def test_half_precision_matches_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([
        rng.normal(size=300), rng.normal(size=300) * 1e-6, rng.normal(size=300) * 5e4,
        [0.0, -0.0, 65504.0, 65519.9, 65520.0, 2049.0, 2051.0, 6e-8, 2.9e-8, math.inf, -math.inf, math.nan],
    ])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    once = df.select("i", numeric.quantize_f16(F.col("v")).alias("q"))
    got = np.array([r.q for r in once.orderBy("i").collect()])
    with np.errstate(over="ignore"):
        np.testing.assert_array_equal(got, values.astype(np.float16).astype(float))
    again = once.select(numeric.quantize_f16(F.col("q")).alias("r"), "q").filter("NOT (r <=> q)")
    assert again.count() == 0


def test_round_up(spark):
    assert [one(spark, numeric.round_up(F.lit(v), 256)) for v in (-1, 0, 1, 256, 257)] == [256, 256, 256, 256, 512]


def test_decoding_replaces_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b" CA\xff "),), (bytearray(b"  N "),)], "raw binary")
    assert [r.v for r in df.select(codes.decode_text(F.col("raw")).alias("v")).collect()] == ["CA�", "N"]


def test_codes(spark):
    labels_ = ["H", " E ", "", "  ", "-", "C", "B", "G", "I", "T", "S", "x", "Helix"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels_)], "i int, v string")
    got = [r.c for r in df.select("i", codes.dssp_code(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == [1, 3, 0, 0, 0, 0, 2, 4, 5, 6, 7, 0, 1]
    names = spark.createDataFrame([("ALA",), ("VAL",), ("HSE",), ("ala",)], "v string")
    assert [r.c for r in names.select(codes.residue_code(F.col("v")).alias("c")).collect()] == [1, 20, 0, 0]


def test_unfolded_gate_is_single_precision_and_drops_nan(spark):
    rows = [(450, True, 0.4), (450, True, 0.41), (450, True, math.nan), (450, False, 0.9), (320, True, 0.9), (450, True, None)]
    df = spark.createDataFrame(rows, "t int, has boolean, rmsd float")
    keep = features.is_folded(F.col("t"), F.col("has"), features.rmsd_angstrom(F.col("rmsd"), F.lit("nm")))
    assert [r.k for r in df.select(keep.alias("k")).collect()] == [True, False, False, True, True, False]


# --- topology --------------------------------------------------------------------------------------------------------


def test_interleaved_and_duplicated_atoms(spark):
    atoms = spark.createDataFrame([
        ("d", 0, "N", "A", 1, "ALA", "N"), ("d", 1, "CA", "A", 2, "HSE", "C"), ("d", 2, "CA", "A", 1, "ALA", "C"),
        ("d", 3, "CA", "A", 1, "ALA", "C"), ("d", 4, "C", "B", 1, "GLY", "C"),
    ], ATOM)
    table = topology.residues(atoms)
    rows = table.orderBy("residue_index").collect()
    assert [(r.resid, r.resname, r.ca_index, r.n_index, r.n_atoms) for r in rows] == [
        (1, "ALA", 3, 0, 3), (2, "HSE", 1, None, 1), (1, "GLY", None, None, 1)
    ]
    assert [r.residue_type for r in rows] == [1, 0, 8]
    with pytest.raises(ValueError, match="without a C-alpha"):
        topology.require_ca(table)


def test_chain_break_option(spark):
    atoms = spark.createDataFrame(
        [("d", 3 * r + k, name, chain, r, "ALA", name[0]) for r, chain in enumerate("AB") for k, name in enumerate(("N", "CA", "C"))], ATOM
    )
    table = topology.residues(atoms)
    joined = topology.residue_sites(table).first().sites
    split = topology.residue_sites(table, break_on_chain=True).first().sites
    assert joined[0].n_after == 3 and joined[1].c_before == 2
    assert split[0].n_after is None and split[1].c_before is None


def test_pdb_names(spark):
    text = "REMARK x\nATOM      1  N   ALA A   1\r\nHETATM    2  CA  ALA A   1\nTER"
    df = spark.createDataFrame([("d", text)], "domain_id string, pdb_text string")
    rows = landing.pdb_atom_names(df, ["domain_id"], "pdb_text").collect()
    assert [(r.atom_index, r.atom_name) for r in rows] == [(0, "N"), (1, "CA")]


def test_file_resolution_prefers_the_root(spark):
    domains = spark.createDataFrame([(i, d) for i, d in enumerate("abc")], "pos int, domain_id string")
    files = spark.createDataFrame([("/r/x_a.h5",), ("/r/data/x_a.h5",), ("/r/data/x_b.h5",), ("/r/other/x_c.h5",)], "path string")
    rows = {r.domain_id: r.source_path for r in landing.resolve_files(domains, files, "/r", "x_").collect()}
    assert rows == {"a": "/r/x_a.h5", "b": "/r/data/x_b.h5", "c": None}


def test_catalog_skips_names_that_are_not_temperatures(spark):
    groups = spark.createDataFrame([("d", "320", 0), ("d", "meta", 0), ("d", "450", 1)], "domain_id string, temperature string, replicate int")
    coords = groups.filter("temperature <> '450'")
    assert [r.traj_id for r in landing.trajectory_catalog(groups, coords).collect()] == ["d_320_0"]


# --- hashes and splits ------------------------------------------------------------------------------------------------


def test_flat_dataset_hash_golden(spark):
    df = spark.createDataFrame([("b",), ("a",)], "content_hash string")
    expected = "fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"
    assert fingerprint.flat_dataset_hash(df).first().dataset_hash == expected
    assert fingerprint.EMPTY == hashlib.sha256(b"").hexdigest()


def test_tree_hash_counts_copies_and_ignores_order(spark):
    def value(items):
        return fingerprint.tree_dataset_hash(spark.createDataFrame([(i,) for i in items], "content_hash string")).first().dataset_hash

    a, b = hashlib.sha256(b"a").hexdigest(), hashlib.sha256(b"b").hexdigest()
    assert value([a, b, a]) == value([a, a, b]) != value([a, b])


def test_trajectory_hash_depends_on_frame_order(spark):
    def value(digests):
        rows = [("d", 320, 0, i, d) for i, d in enumerate(digests)]
        df = spark.createDataFrame(rows, "domain_id string, temperature int, replicate int, frame int, digest string")
        return fingerprint.trajectory_digests(df, fan_out=2).first().content_hash

    assert value("abcde") == value("abcde") != value("abced")


@pytest.mark.parametrize("n,train,val", [(1, 0, 0), (2, 1, 0), (3, 2, 0), (5, 4, 0), (10, 8, 1), (50, 40, 5)])
def test_split_counts(spark, n, train, val):
    metadata = spark.createDataFrame([(f"t{i:03d}",) for i in range(n)], "cath_topology string")
    counts = dict(splits.topology_split(metadata).groupBy("split").count().collect())
    assert (counts.get("train", 0), counts.get("val", 0), counts.get("test", 0)) == (train, val, n - train - val)


def test_listed_order_is_the_seeded_shuffle(spark):
    names = [f"t{i}" for i in range(10)]
    metadata = spark.createDataFrame([(n,) for n in names], "cath_topology string")
    got = [r.cath_topology for r in splits.shuffled_as_listed(splits.topologies(metadata)).orderBy("pos").collect()]
    assert got == [f"t{i}" for i in (4, 2, 3, 8, 9, 5, 1, 7, 6, 0)]
    expected = list(names)
    random.Random(1729).shuffle(expected)
    assert got == expected


def test_split_is_complete_and_leak_free(spark):
    rows = [(f"x{i}", f"t{i % 17}") for i in range(200)]
    metadata = spark.createDataFrame(rows, "traj_id string, cath_topology string")
    assigned = splits.assigned(metadata, splits.topology_split(metadata))
    assert assigned.count() == 200
    assert assigned.groupBy("cath_topology").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


# --- labels ----------------------------------------------------------------------------------------------------------


def test_sample_indices_match_linspace(spark):
    df = spark.range(1, 120).selectExpr("CAST(id AS INT) AS r").select("r", F.expr(labels.sample_indices("r", 32)).alias("k"))
    for row in df.collect():
        assert row.k == np.linspace(0, row.r - 1, min(32, row.r), dtype=np.int64).tolist()
    assert df.select(F.expr(labels.sample_indices("r", 1)).alias("k")).distinct().count() == 1


def test_offsets_are_contiguous_and_capped(spark):
    metadata = spark.createDataFrame([("d", f"t{i}", i, 40) for i in range(5)], "domain_id string, traj_id string, traj_index int, n_frames bigint")
    rows = labels.frame_offsets(metadata, cap=100).orderBy("traj_index").collect()
    assert [(r.start, r.stop) for r in rows] == [(0, 40), (40, 80), (80, 100)]
    assert labels.frame_offsets(metadata, cap=0).count() == 5


def test_requested_domains(spark):
    metadata = spark.createDataFrame([("a",), ("b",), ("b",)], "domain_id string")
    asked = spark.createDataFrame([(0, "b"), (1, "a")], "pos int, domain_id string")
    assert labels.selected_domains(metadata, asked, 1).first().domain_id == "b"
    assert [r.domain_id for r in labels.selected_domains(metadata).orderBy("domain_id").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="no processed data"):
        labels.selected_domains(metadata, spark.createDataFrame([(0, "z")], "pos int, domain_id string"))


def scored(spark, walks):
    rows = [(d, d, t, t, len(z), [float(v) for v in x]) for d, z in walks.items() for t, x in enumerate(z)]
    return spark.createDataFrame(rows, "domain_id string, traj_id string, frame int, frame_global bigint, n_total bigint, z array<double>")


def numpy_models(z, lag, dim):
    x, y = z[:-lag], z[lag:]
    mean = (x.mean(0) + y.mean(0)) / 2
    x, y = x - mean, y - mean
    c00, c0t = (x.T @ x + y.T @ y) / (2 * len(x)), (x.T @ y + y.T @ x) / (2 * len(x))
    return np.sort(np.abs(np.linalg.eigvals(np.linalg.inv(c00) @ c0t)))[::-1][:dim]


def test_slow_directions_over_many_blocks_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(0)
    walk = np.cumsum(rng.normal(size=(500, 4)), axis=0) * [0.1, 0.2, 0.05, 1] + rng.normal(size=(500, 4))
    monkeypatch.setattr(labels, "with_halo", lambda df, at, lag: __import__("moltraj.scale", fromlist=["x"]).with_halo(df, at, lag, 64))
    df = scored(spark, {"d": walk})
    model = labels.slow_models(labels.lagged_products(df, 3), dim=3).first()
    assert np.abs(model.singular_values) == pytest.approx(numpy_models(walk, 3, 3), rel=1e-8)
    assert model.score == pytest.approx(float(np.sum(np.square(model.singular_values))))
    points = labels.embedded(df, labels.slow_models(labels.lagged_products(df, 3), dim=3))
    e = np.array([r.e for r in points.orderBy("frame_global").collect()])
    np.testing.assert_allclose(e, (walk - np.array(model.mean)) @ np.array(model.weights).T, atol=1e-9)


def test_single_frame_domain_is_degenerate(spark):
    df = scored(spark, {"d": np.ones((1, 3))})
    models = labels.slow_models(labels.lagged_products(df, 1))
    assert models.count() == 0
    points = labels.embedded(df, models)
    states = labels.clustered(points, points.select("domain_id", "n_total"), (4,), iterations=1).collect()
    assert [(r.resolution, r.state) for r in states] == [(4, 0)]


def test_clusters_of_separated_groups(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [20, 0], [0, 20], [20, 20]])
    truth = np.repeat(np.arange(4), 50)
    e = centres[truth] + rng.normal(size=(200, 2))
    rows = [("d", t, 200, [float(v) for v in x]) for t, x in enumerate(e)]
    points = spark.createDataFrame(rows, "domain_id string, frame_global bigint, n_total bigint, e array<double>")
    result = labels.clustered(points, points.select("domain_id", "n_total").distinct(), (1, 4), dim=2, iterations=5)
    got = {(r.resolution, r.frame_global): r.state for r in result.collect()}
    assert [got[4, t] for t in range(200)] == truth.tolist()
    assert {got[1, t] for t in range(200)} == {0}


# --- areas and pairs -------------------------------------------------------------------------------------------------


def sphere_frames(spark, points, names):
    atoms = spark.createDataFrame([("d", i, n, "A", i, "ALA", n[0]) for i, n in enumerate(names)], ATOM)
    frames = spark.createDataFrame([("d", "320", 0, 0, 0.1, ["C"], [tuple(map(float, p)) for p in points])], schema.FRAMES)
    return frames, atoms


def test_areas_match_a_direct_count(spark):
    rng = np.random.default_rng(4)
    points, names = rng.uniform(0, 14, size=(40, 3)).astype(np.float32), ["CA", "N", "O", "SG"] * 10
    frames, atoms = sphere_frames(spark, points, names)
    spheres = sasa.atom_spheres(frames, atoms, topology.residues(atoms))
    got = {r.residue_index: r.area for r in sasa.residue_areas(spheres).collect()}
    reach = np.array([sasa.RADII[n[0]] + sasa.PROBE for n in names])
    at = points.astype(float)
    for i in range(40):
        probes = at[i] + reach[i] * sasa.sphere(100)
        inside = (((probes[:, None] - at[None]) ** 2).sum(-1) < reach**2)
        inside[:, i] = False
        assert got[i] == pytest.approx(4 * math.pi * reach[i] ** 2 * np.count_nonzero(~inside.any(1)) / 100)


def test_lone_atom_is_fully_exposed(spark):
    frames, atoms = sphere_frames(spark, [(0, 0, 0)], ["CA"])
    area = sasa.residue_areas(sasa.atom_spheres(frames, atoms, topology.residues(atoms))).first().area
    assert area == pytest.approx(4 * math.pi * 3.1**2)
    for n_points in (20, 50, 170):
        again = sasa.residue_areas(sasa.atom_spheres(frames, atoms, topology.residues(atoms)), n_points=n_points).first().area
        assert again == pytest.approx(area, rel=1e-6)


def test_length_bucket(spark):
    assert [one(spark, pairs.length_bucket(F.lit(n))) for n in (1, 128, 129, 320, 321)] == [128, 128, 192, 320, None]


# --- ranks, visits, streams --------------------------------------------------------------------------------------------


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.integers(-3, 3), min_size=1, max_size=60))
def test_positions_and_ranks_with_heavy_ties(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "traj_index bigint, v double")
    got = [r.traj_index for r in selection.positions(df, "v", "traj_index", "place").orderBy("place").collect()]
    assert got == sorted(range(len(values)), key=lambda i: (values[i], i))
    ranks = {r.v: r["rank"] for r in metrics.tie_ranks(df, [], "v", {}).collect()}
    for v in set(values):
        less, same = sum(x < v for x in values), sum(x == v for x in values)
        assert ranks[float(v)] == less + (same + 1) / 2


def test_visits_within_matches_a_direct_count(spark):
    rng = np.random.default_rng(5)
    cloud = np.round(np.concatenate([rng.normal(size=(150, 2)), np.zeros((80, 2))]), 2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cloud)], "id int, x double, y double")
    got = {r.id: r.n_visits for r in selection.visits_within(df, df, "id", ["x", "y"], 0.505).collect()}
    for i, p in enumerate(cloud):
        assert got[i] == np.count_nonzero(((cloud - p) ** 2).sum(1) <= 0.505**2)


def test_budget_respects_share_and_floor(spark):
    rows = [(f"t{i % 6}", i, float(100 * (i % 6) + i)) for i in range(600)]
    df = spark.createDataFrame(rows, "traj_id string, item int, score double")
    picked = selection.budgeted(df, 40).collect()
    assert len(picked) == 40 and len({r.item for r in picked}) == 40
    assert sum(r.reason == "random" for r in picked) == 2
    assert max(sum(r.traj_id == t for r in picked) for t in {r.traj_id for r in picked}) <= 10


def test_discovery_by_accumulated_time(spark):
    df = spark.createDataFrame([("r", i, "s") for i in range(3, 9)], "run string, frame bigint, state string")
    row = metrics.discoveries(df, "run", 250.0).first()
    assert (row.first_ps, row.accumulated_ps, row.discovered_ps) == (1000.0, 1750.0, 1000.0)


def test_checksum_states(spark, folder):
    with open(f"{folder}/a.bin", "wb") as handle:
        handle.write(b"abc")
    held = checks.file_digests(spark, folder, "*.bin").withColumn("path", F.element_at(F.split("path", "/"), -1))
    published = spark.createDataFrame([("a.bin", hashlib.sha256(b"abc").hexdigest()), ("b.bin", "0")], "path string, digest string")
    assert dict(checks.checksum_audit(held, published).collect()) == {"a.bin": "ok", "b.bin": "missing"}


def test_progress_stream_equals_its_batch_twin(spark, folder):
    rows = [(f"t{i % 3}", i, 2, "u") for i in range(30)]
    spark.createDataFrame(rows, schema.FRAME_WINDOWS).repartition(4).write.parquet(f"{folder}/in")
    query = runs.snapshots(runs.frame_progress(runs.frame_windows(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/cp", once=True)
    query.awaitTermination()
    latest = spark.read.parquet(f"{folder}/out").drop("snapshot")
    expected = runs.frame_progress(spark.read.parquet(f"{folder}/in"))
    assert sorted(latest.collect()) == sorted(expected.collect())


def test_run_state_stream_equals_its_batch_twin(spark, folder):
    rows = [("a", "submit", 5.0, 1.0, 0), ("b", "submit", 1.0, 2.0, 1), ("a", "extend", 2.5, None, 2), ("b", "terminate", None, None, 3)]
    spark.createDataFrame(rows, schema.RUN_EVENTS).write.parquet(f"{folder}/in")
    runs.snapshots(runs.run_state(runs.run_events(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/cp", once=True).awaitTermination()
    streamed = spark.read.parquet(f"{folder}/out").filter("active").select("trajectory_id", "budget_ns", "priority", "last_kind")
    assert [tuple(r) for r in streamed.collect()] == [("a", 7.5, 1.0, "extend")]
    assert sorted(streamed.collect()) == sorted(runs.active_runs(spark.read.parquet(f"{folder}/in")).collect())


def test_ingest_drops_repeated_frames(spark, folder):
    rows = [("t", i % 10, "2024-01-01 00:00:00") for i in range(20)]
    df = spark.createDataFrame(rows, "traj_id string, frame int, arrived string").withColumn("arrived", F.to_timestamp("arrived"))
    df.write.parquet(f"{folder}/in")
    stream = runs.read_folder(spark, f"{folder}/in", df.schema)
    runs.ingest(runs.fresh_frames(stream, "arrived", ["traj_id", "frame"]), f"{folder}/out", f"{folder}/cp", once=True).awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 10


def test_effective_rank_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "e array<float>")
    p = np.linalg.eigvalsh(np.cov(x.T))
    p = p / p.sum()
    assert metrics.effective_rank(df, "e", 5).first().effective_rank == pytest.approx(float(np.exp(-np.sum(p * np.log(p)))), rel=1e-4)


def test_worker_functions_do_not_need_the_package(folder):
    """Task-side code must load where only Spark's own Python packages are installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    functions = [
        labels.block_products(), *labels.moment_parts(), labels.recluster(0), packed.packing_kernel(True, True, 100), packed.digest_kernel(True),
        packed.flat_points(), packed.numbers_of(),
    ]
    with open(f"{folder}/code.bin", "wb") as handle:
        handle.write(cloudpickle.dumps(functions))
    script = f"import sys, pickle; fs = pickle.load(open('{folder}/code.bin', 'rb')); assert len(fs) == 8 and 'moltraj' not in sys.modules"
    subprocess.run([sys.executable, "-c", script], cwd=folder, check=True, env={"PATH": "/usr/bin"})


def test_bootstrap_finds_a_clear_difference(spark):
    rng = np.random.default_rng(7)
    rows = [(f"u{i}", float(v)) for i, v in enumerate(rng.normal(loc=1.0, scale=0.5, size=40))]
    df = spark.createDataFrame(rows, "unit string, delta double")
    row = metrics.paired_bootstrap(df, F.col("unit"), "delta", resamples=200).first()
    assert row.ci_low < row.mean_delta < row.ci_high and row.excludes_zero


def test_padded_grid_fills(spark, landed):
    sites = topology.residue_sites(topology.residues(landed.atoms))
    rows = features.residue_features(landed.frames, sites)
    fills = {"ca_x": F.lit(math.nan), "phi_cos": F.lit(0.0), "dssp": F.lit(0), "residue_mask": F.lit(False)}
    grid = features.padded_grid(rows, fills)
    assert grid.count() == 2 * 256 * 512
    assert grid.filter("residue_mask").count() == 2 * 3 * 3
    empty = grid.filter("NOT residue_mask").select("ca_x", "phi_cos", "dssp").distinct().collect()
    assert len(empty) == 1 and math.isnan(empty[0].ca_x) and (empty[0].phi_cos, empty[0].dssp) == (0.0, 0)


def test_membership_ranges_are_closed_and_open_ended(spark):
    df = spark.createDataFrame([(0, -90.0), (1, 0.0), (2, None), (3, 200.0)], "i int, psi double")
    states = {"in": {"psi": (-90.0, 0.0)}, "high": {"psi": (0.0, None)}}
    assert sorted((r.i, r.state) for r in metrics.state_membership(df, states).collect()) == [(0, "in"), (1, "high"), (1, "in"), (3, "high")]


def test_describe_source_and_schema_dump(spark, folder):
    df = spark.createDataFrame([(1, [1, 2]), (None, [3])], "a int, b array<int>")
    rows = {r.column_name: r for r in landing.describe_source(df).collect()}
    assert (rows["a"].n_nulls, rows["b"].min_size, rows["b"].max_size) == (1, 1, 2)
    landing.schema_dump(df, f"{folder}/schema")
    assert spark.read.json(f"{folder}/schema").filter("column_name = 'b'").first().data_type == "array<int>"


def test_rankings_keep_every_row(spark):
    from moltraj.operators import selection

    frames = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 5.0), (3, 0, 1.0), (3, 1, 1.5)], "run long, frame int, rmsd double")
    rows = {r.run: (r.place, r.velocity) for r in selection.rmsd_velocity(frames, "run", "rmsd", 1.0).collect()}
    assert rows == {1: (1, 2.0), 3: (2, 0.5), 2: (3, None)}
    latest = spark.createDataFrame([(1, "a"), (2, "b"), (3, "never")], "run long, state string")
    counts = spark.createDataFrame([("a", 5), ("b", 2)], "state string, n_visits long")
    rows = {r.run: (r.place, r.weight) for r in selection.rare_states(latest, counts, "run", "state").collect()}
    assert rows == {3: (1, 1.0), 2: (2, 0.5), 1: (3, 0.2)}


def test_budget_above_a_thousand_a_trajectory(spark):
    from moltraj.operators import selection

    rows = spark.range(9000).selectExpr("if(id < 6000, 'hot', concat('t', id % 40)) AS traj_id", "id AS item", "cast(id % 977 AS double) AS score")
    picked = selection.budgeted(rows, 8000, epsilon=0.0).collect()
    of_hot = sorted((r.score, -r.item) for r in picked if r.traj_id == "hot")
    assert len(picked) == 5000 and len(of_hot) == 2000
    assert of_hot == sorted(sorted((float(i % 977), -i) for i in range(6000))[-2000:])
