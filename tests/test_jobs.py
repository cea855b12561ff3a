import json
import shutil

import pytest
from pyspark.sql import functions as F

from moltraj.plans import jobs
from moltraj.sources import landing, sinks
from tests import fixtures


@pytest.fixture(scope="module")
def store(spark, landed, listed, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("store") / "out")
    jobs.prepare(landed, listed, out, nested=True)
    return out


def test_dry_run_reports_sizes_and_writes_nothing(landed, listed, folder):
    row = jobs.prepare(landed, listed, f"{folder}/none", dry_run=True).first()
    assert row.asDict() == {"n_domains": 1, "n_trajectories": 2, "max_frames": 3, "max_residues": 3}


def test_store_values(spark, store):
    rows = sinks.read_features(spark, store).filter("temperature = '320'").orderBy("frame", "residue_index").collect()
    assert [(r.ca_x, r.ca_y, r.ca_z) for r in rows[:3]] == [(1.0, 0.0, 0.0), (2.0, 2.0, 0.0), (4.0, 3.0, 0.0)]
    assert rows[3].ca_x == pytest.approx(1.1, abs=2e-3)
    assert [r.dssp for r in rows[:3]] == [1, 3, 0]
    assert [r.residue_type for r in rows[:3]] == [1, 8, 16]
    assert all(r.residue_mask for r in rows)
    assert (rows[1].cb_x, rows[1].cb_y, rows[1].cb_z) == pytest.approx((1.45932534, 2.56802827, 0.58273431), abs=2e-3)
    assert [(r.phi_sin, r.phi_cos) for r in rows[:3]] == [(0, 0), pytest.approx((0, -1), abs=1e-6), pytest.approx((0, -1), abs=1e-6)]
    assert (rows[2].psi_sin, rows[2].psi_cos, rows[2].omega_sin, rows[2].omega_cos) == (0, 0, 0, 0)


def test_metadata_and_manifest(spark, store):
    metadata = spark.read.parquet(f"{store}/metadata").orderBy("traj_index").collect()
    assert [m.traj_id for m in metadata] == ["12asA00_320_0", "12asA00_450_0"]
    assert [m.n_frames for m in metadata] == [3, 3]
    assert metadata[0].frame_dt_ps == 1000.0
    document = json.loads(spark.read.text(f"{store}/manifest").first()[0])
    assert document["n_trajectories"] == 2 and len(document["trajectories"]) == 2
    assert len(spark.read.json(document["trajectories_path"]).collect()) == 2
    assert (document["max_frames"], document["max_residues"]) == (256, 512)
    assert list(document) == sorted(document)


def test_same_input_gives_same_dataset_hash(spark, landed, listed, store, folder):
    shuffled = jobs.Landed(landed.domains, landed.atoms.orderBy(F.rand(3)), landed.trajectories, landed.frames.orderBy(F.rand(5)))
    jobs.prepare(shuffled, listed, f"{folder}/again")
    hashes = [jobs.read_manifest(spark, f"{out}/manifest").first().dataset_hash for out in (store, f"{folder}/again")]
    assert hashes[0] == hashes[1]


def test_existing_output_is_refused_without_force(landed, listed, store):
    with pytest.raises(FileExistsError):
        jobs.prepare(landed, listed, store)


def test_unknown_domain_and_atom_mismatch_are_errors(spark, landed, folder):
    other = spark.createDataFrame([(0, "1abcA00")], "pos bigint, domain_id string")
    with pytest.raises(FileNotFoundError):
        jobs.plan(landed, other)
    short = jobs.Landed(
        landed.domains.withColumn("pdb_text", F.lit(fixtures.pdb_text(fixtures.ATOMS[:5]))), landed.atoms, landed.trajectories, landed.frames
    )
    with pytest.raises(ValueError, match="lists 5 atoms"):
        jobs.check_atoms(short)


def test_unfolded_frames_leave_the_hot_trajectory_only(spark, listed, folder):
    landed = fixtures.landed(spark, rmsd=(0.4, 0.41, float("nan"), 0.1), n_frames=4)
    jobs.prepare(landed, listed, f"{folder}/out")
    counts = {r.traj_id: (r.n_frames_raw, r.n_frames) for r in spark.read.parquet(f"{folder}/out/metadata").collect()}
    assert counts == {"12asA00_320_0": (4, 4), "12asA00_450_0": (4, 2)}
    frames = sinks.read_features(spark, f"{folder}/out").filter("temperature = '450'").select("frame").distinct()
    assert sorted(r.frame for r in frames.collect()) == [0, 1]


def test_trajectory_emptied_by_the_filter_stays_in_metadata(spark, listed, folder):
    landed = fixtures.landed(spark, rmsd=(0.9, 0.9, 0.9))
    jobs.prepare(landed, listed, f"{folder}/out")
    rows = {r.traj_id: r for r in spark.read.parquet(f"{folder}/out/metadata").collect()}
    assert rows["12asA00_450_0"].n_frames == 0


def test_domain_listed_twice_is_planned_twice(spark, landed):
    twice = spark.createDataFrame([(0, "12asA00"), (1, "12asA00")], "pos bigint, domain_id string")
    rows = jobs.plan(landed, twice).orderBy("traj_index").collect()
    assert [(r.traj_index, r.traj_id) for r in rows] == [
        (0, "12asA00_320_0"), (1, "12asA00_450_0"), (2, "12asA00_320_0"), (3, "12asA00_450_0")
    ]


CHECKS = ["domain_list", "manifest_hash", "content_hash", "roundtrip_rmsd", "window_latency", "all"]


def outcome(landed, listed, path):
    found = jobs.validate(landed, listed, path, n_windows=2, window_frames=2, p50_ms=1e6, p99_ms=1e6)
    return {r.check_name: r.passed for r in found.collect()}


def test_validation_passes_and_notices_a_changed_hash(spark, landed, listed, store, folder):
    assert outcome(landed, listed, store) == dict.fromkeys(CHECKS, True)
    shutil.copytree(store, f"{folder}/bad")
    metadata = spark.read.parquet(f"{store}/metadata").withColumn("content_hash", F.lit("0" * 64))
    metadata.write.mode("overwrite").parquet(f"{folder}/bad/metadata")
    result = outcome(landed, listed, f"{folder}/bad")
    assert not result["manifest_hash"] and not result["content_hash"] and not result["all"] and result["domain_list"]


@pytest.mark.parametrize("damage", ["frame", "residue", "trajectory", "coordinate"])
def test_validation_notices_lost_and_changed_rows(spark, landed, listed, store, folder, damage):
    hit = {
        "frame": "temperature = '320' AND frame = 2", "residue": "temperature = '320' AND frame = 1", "trajectory": "temperature <> '320'",
        "coordinate": "frame = 1",
    }[damage]
    shutil.copytree(store, f"{folder}/bad")
    rows = sinks.read_frames(spark, store)
    if damage == "residue":
        parts = {"ca": 3, "cb": 3, "torsions": 6, "dssp": 1, "residue_type": 1}
        rows = rows.withColumns({name: F.when(F.expr(hit), F.slice(name, 1, 2 * n)).otherwise(F.col(name)) for name, n in parts.items()})
    elif damage == "coordinate":
        moved = F.transform("ca", lambda v, i: F.when(i == 0, v + 1).otherwise(v).cast("float"))
        rows = rows.withColumn("ca", F.when(F.expr(hit), moved).otherwise(F.col("ca")))
    else:
        rows = rows.filter(f"NOT ({hit})")
    rows.write.mode("overwrite").partitionBy("domain_id").parquet(f"{folder}/bad/frames")
    result = outcome(landed, listed, f"{folder}/bad")
    assert not result["content_hash"] and not result["roundtrip_rmsd"] and not result["all"]
    assert result["domain_list"] and result["manifest_hash"]


def test_groups_that_are_no_temperatures_are_passed_over(spark, landed, listed, folder):
    other = jobs.Landed(
        landed.domains, landed.atoms,
        landed.trajectories.unionByName(landed.trajectories.limit(1).withColumn("temperature", F.lit("meta"))),
        landed.frames.unionByName(landed.frames.limit(2).withColumn("temperature", F.lit("meta"))),
    )
    jobs.prepare(other, listed, f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out/metadata").count() == 2
    assert outcome(other, listed, f"{folder}/out") == dict.fromkeys(CHECKS, True)


def test_every_frame_of_a_long_domain_is_in_reach():
    import inspect

    assert inspect.signature(jobs.label).parameters["cap"].default == 0


def test_labels(spark, store, folder):
    results = jobs.label(spark, store, f"{folder}/labels", resolutions=(2, 64), iterations=2)
    rows = {r.resolution: r for r in results.collect()}
    assert rows[2].n_frames == 6 and rows[2].n_states == 2 and rows[64].n_states == 6
    assert rows[2].feature_dim == 96
    labels = spark.read.parquet(f"{folder}/labels/labels").filter("resolution = 2").collect()
    assert sorted(r.frame_global for r in labels) == list(range(6))
    assert all(0 <= r.state < 2 for r in labels)
    document = json.loads(spark.read.text(f"{folder}/labels/manifest").first()[0])
    assert document["label_type"] == "vampnet_tier1_pilot" and "domains" not in document
    assert len(spark.read.json(document["domains_path"]).collect()) == 2
    with pytest.raises(FileExistsError):
        jobs.label(spark, store, f"{folder}/labels", resolutions=(2,))


def test_gate_that_cannot_pass_falls_back(spark, store, folder):
    row = jobs.label(spark, store, f"{folder}/labels", resolutions=(2,), margin=1000.0, iterations=1).first()
    assert row.method == "tica_kmeans" and not row.health_passed
    assert row.fallback_reason == "health_score_not_above_random_projection_baseline"


def test_round_trip_of_the_fixture(spark, landed, listed, store):
    from moltraj.operators import features, packed, topology

    arrays = packed.domain_arrays(topology.residue_sites(topology.residues(landed.atoms)))
    raw = packed.packed_frames(packed.with_domain_arrays(features.kept_frames(landed.frames, landed.trajectories), arrays))
    rows = packed.roundtrip_rmsd(packed.beside(raw, sinks.read_frames(spark, store)), 0.05).collect()
    assert all(r.rmsd_angstrom == pytest.approx(4.531059e-4, rel=1e-4) for r in rows)


def test_domain_list_file(spark, folder):
    path = f"{folder}/list.txt"
    with open(path, "w") as handle:
        handle.write("# header\n\n 1abcA00 \n2xyzB01\n1abcA00\n")
    rows = landing.read_domain_list(spark, path).orderBy("pos").collect()
    assert [(r.pos, r.domain_id) for r in rows] == [(0, "1abcA00"), (1, "2xyzB01"), (2, "1abcA00")]
    with open(path, "w") as handle:
        handle.write("# nothing\n")
    with pytest.raises(ValueError):
        landing.read_domain_list(spark, path)


def test_domain_without_trajectories_leaves_a_report(spark, landed, listed, folder):
    renamed = landed.trajectories.withColumn("temperature", F.lit("meta"))
    broken = jobs.Landed(landed.domains, landed.atoms, renamed, landed.frames)
    with pytest.raises(ValueError, match="no trajectory groups"):
        jobs.prepare(broken, listed, f"{folder}/out")
    assert spark.read.json(f"{folder}/out/frames_schema").filter("column_name = 'xyz'").first().max_size == 12


def test_store_with_areas_and_mapped_topologies(spark, landed, listed, folder):
    mapped = spark.createDataFrame([("12asA00", "3.30.930")], "domain_id string, cath_topology string")
    jobs.prepare(landed, listed, f"{folder}/out", with_sasa=True, topologies=mapped)
    assert spark.read.parquet(f"{folder}/out/metadata").select("cath_topology").distinct().first()[0] == "3.30.930"
    areas = sinks.read_features(spark, f"{folder}/out").agg(F.min("sasa"), F.max("sasa")).first()
    assert 0 <= areas[0] <= areas[1] < 1000


def test_report_says_what_was_found(spark, landed, listed, store, folder):
    """All summary values, the default thresholds, and the report beside the store."""
    jobs.validate(landed, listed, store, n_windows=50, window_frames=2)
    report = json.loads(spark.read.text(f"{store}/validation").first()[0])
    assert (report["n_domains"], report["n_trajectories"], report["max_frames"], report["max_residues"]) == (1, 2, 256, 512)
    assert {s["array_name"]: [s.get(k) for k in ("n_trajectories", "n_frames", "n_residues", "n_parts")] for s in report["shapes"]}["backbone_torsions"] == [2, 256, 512, 6]
    assert report["missing"] == [] and report["unexpected"] == []
    assert report["domain_list"] == {"expected_count": 1, "observed_count": 1, "n_missing": 0, "n_unexpected": 0, "passed": True}
    assert report["manifest_hash"]["expected"] == report["manifest_hash"]["recomputed"] == report["dataset_hash"]
    assert report["roundtrip_rmsd"]["worst"]["rmsd_angstrom"] == pytest.approx(4.531059e-4, rel=1e-4)
    assert report["roundtrip_rmsd"]["threshold_angstrom"] == 0.05 and report["roundtrip_rmsd"]["n_wrong"] == 0
    latency = report["window_latency"]
    assert (latency["n_windows"], latency["window_frames"], latency["p50_threshold_ms"], latency["p99_threshold_ms"]) == (50, 2, 50.0, 200.0)
    assert 0 < latency["p50_ms"] <= latency["p99_ms"] <= latency["max_ms"]
    two = spark.createDataFrame([(0, "12asA00"), (1, "1abcA00")], "pos bigint, domain_id string")
    row = jobs.validation_report(landed, two, store, n_windows=1, window_frames=2).first()
    assert row.missing == ["1abcA00"] and not row.domain_list.passed and not row.passed


def exchanges_with(df, column):
    """How many shuffles of the plan carry a column."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec" and f"{column}#" in node.output().mkString(","):
            found.append(node)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.initialPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan)
    return len(found)


def test_coordinates_take_part_in_one_shuffle_at_most(spark, landed, listed, monkeypatch):
    from moltraj import scale
    from moltraj.operators import packed, topology

    planned = scale.cut_lineage(jobs.plan(landed, listed))
    sites = scale.cut_lineage(topology.residue_sites(topology.residues(landed.atoms)))
    expected = sorted(packed.packed_frames(jobs.kept_payload(landed, planned, sites)).drop("sasa").collect(), key=str)
    assert exchanges_with(jobs.kept_payload(landed, planned, sites), "xyz") == 0
    monkeypatch.setattr(scale, "fits", lambda *args: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = jobs.kept_payload(landed, planned, sites)
        # The two branches, folded and high-temperature frames, are shuffled once each, so that a row moves once.
        assert exchanges_with(spread, "xyz") == 2
        assert sorted(packed.packed_frames(spread).drop("sasa").collect(), key=str) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
