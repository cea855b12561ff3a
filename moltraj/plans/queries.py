"""The registered queries: each operator applied to whole test tables through the surrogate views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.functions import geometry as geo
from moltraj.functions.codes import decode_text, dssp_code
from moltraj.functions.numeric import clean, quantize_f16
from moltraj.operators import checks, features, fingerprint, labels, metrics, packed, pairs, sasa, selection, splits, topology
from moltraj.plans import surrogates as views
from moltraj.scale import BLOCK, cut_lineage, ranked, working_folder
from moltraj.schema import FRAME_KEY, TRAJECTORY_KEY
from moltraj.sources import landing
from moltraj.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
RESIDUE_ROW = [*FRAME_KEY, "residue_index"]


def registered(query: Query) -> Query:
    REGISTERED[query.__name__] = query
    return query


def sites(spark: SparkSession, sf: str) -> DataFrame:
    return topology.residue_sites(topology.residues(views.frame_atoms(spark, sf)))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return features.kept_frames(views.frames(spark, sf), views.rmsd_series(spark, sf))


def kept_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.residue_features(kept(spark, sf), sites(spark, sf))


def kept_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The kept frames as packed rows, before they lose precision in the store."""
    return packed.packed_frames(packed.with_domain_arrays(kept(spark, sf), sites(spark, sf)))


def all_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.residue_features(views.frames(spark, sf), sites(spark, sf))


# --- sources and plans ---------------------------------------------------------------------------------------------


@registered
def domain_list_scan(spark, sf):
    return landing.list_entries(views.table(spark, sf, "documents"), ["doc_id"], "text")


def listing(spark, sf):
    orders = views.table(spark, sf, "orders")
    folder = F.when(F.col("o_orderkey") % 3 == 0, "root/traj_c").otherwise("root/data/traj_c")
    return orders.select(F.concat(folder, F.col("o_custkey").cast("string"), F.lit(".h5")).alias("path")).distinct()


def wanted(spark, sf):
    return views.table(spark, sf, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("domain_id"))


@registered
def file_resolution(spark, sf):
    return landing.resolve_files(wanted(spark, sf), listing(spark, sf), "root", "traj_")


@registered
def missing_files(spark, sf):
    return landing.missing_files(file_resolution(spark, sf))


@registered
def domain_list_audit(spark, sf):
    named = F.regexp_extract("path", "traj_(.*)[.]h5$", 1)
    return checks.domain_list_check(wanted(spark, sf), listing(spark, sf).select(named.alias("domain_id")))


@registered
def trajectory_catalog(spark, sf):
    events = views.with_names(views.table(spark, sf, "events"))
    temperature = F.col("temperature").cast("string")
    found = events.withColumn("temperature", F.when(F.col("event_type") == "error", "meta").otherwise(temperature))
    held = events.withColumn("temperature", temperature).filter("value > 20")
    return landing.trajectory_catalog(found.select(*TRAJECTORY_KEY).distinct(), held)


@registered
def plan_summary(spark, sf):
    events = views.with_names(views.table(spark, sf, "events")).withColumn("temperature", F.col("temperature").cast("string"))
    counted = events.groupBy(*TRAJECTORY_KEY).agg(F.count(F.lit(1)).alias("counted_frames"))
    # Trajectories with an even replicate carry a stored length, which may differ from the rows that are there.
    stored = F.when(F.col("replicate") % 2 == 0, F.col("counted_frames") + F.col("replicate")).cast("int")
    attributes = counted.select(*TRAJECTORY_KEY, stored.alias("num_frames"))
    planned = landing.plan_trajectories(trajectory_catalog(spark, sf), attributes, counted)
    sizes = events.groupBy("domain_id").agg(F.count_distinct(F.col("event_id") % 7).cast("int").alias("n_residues"))
    return landing.plan_summary(events.select("domain_id").distinct(), planned.join(sizes, "domain_id"))


@registered
def pdb_atom_names(spark, sf):
    atoms = views.event_atoms_raw(spark, sf)
    record = F.when(F.col("value") < 5, "REMARK").when(F.col("value") < 100, "ATOM  ").otherwise("HETATM")
    line = F.format_string("%s%5d %-4s MOL A   1", record, (F.col("frame") % 99999).cast("int"), F.col("atom_name"))
    chunk = F.floor(F.col("frame") / 64)
    texts = atoms.groupBy("user_id", chunk.alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", line.alias("line")))), lambda a: a["line"]), "\n")
        .alias("pdb_text")
    )
    return landing.pdb_atom_names(texts, ["user_id", "chunk"], "pdb_text")


@registered
def atom_count_audit(spark, sf):
    """Domains whose structure text lists another number of atoms than their atom table: a user's lines and events."""
    lines = pdb_atom_names(spark, sf).select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain_id"))
    return topology.atom_count_mismatch(lines, views.event_atoms(spark, sf).select("domain_id"))


@registered
def text_decode(spark, sf):
    text = decode_text(F.encode("text", "UTF-8"))
    return views.table(spark, sf, "documents").select(
        "doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("n_chars")
    )


@registered
def source_report(spark, sf):
    return landing.describe_source(views.table(spark, sf, "embeddings"))


# --- topology and features -----------------------------------------------------------------------------------------


@registered
def residue_topology(spark, sf):
    return topology.residues(views.event_atoms(spark, sf)).select(
        "domain_id", "residue_index", "resid", "resname", "first_atom", "n_atoms",
        *topology.BACKBONE, "residue_type",
    )


@registered
def residue_atoms(spark, sf):
    atoms = views.event_atoms(spark, sf)
    return topology.residue_atoms(atoms, cut_lineage(topology.residues(atoms)))


@registered
def missing_ca(spark, sf):
    return topology.missing_ca(topology.residues(views.event_atoms(spark, sf)))


@registered
def unfolded_filter(spark, sf):
    return kept(spark, sf).select(*TRAJECTORY_KEY, "source_frame", "frame")


@registered
def virtual_cb(spark, sf):
    return all_features(spark, sf).select(*RESIDUE_ROW, *[clean(F.col(c)).alias(c) for c in features.CB])


@registered
def backbone_torsions(spark, sf):
    return all_features(spark, sf).select(*RESIDUE_ROW, *[clean(F.col(c)).alias(c) for c in features.TORSIONS])


@registered
def dihedral_angles(spark, sf):
    points = features.residue_points(views.frames(spark, sf), sites(spark, sf)).filter("has_psi")
    angle = geo.dihedral(*[geo.vector(name) for name in features.TORSION_POINTS["psi"]])
    return points.select(*RESIDUE_ROW, clean(angle).alias("psi"))


@registered
def torsion_coherence(spark, sf):
    means = [clean(F.avg(f"{name}_cos")).alias(f"{name}_coherence") for name in features.TORSION_POINTS]
    return kept_features(spark, sf).groupBy(*TRAJECTORY_KEY).agg(F.count(F.lit(1)).alias("n_rows"), *means)


@registered
def dssp_codes(spark, sf):
    label = F.concat(F.lit(" "), F.upper("event_type"), F.lit("\t"))
    return views.table(spark, sf, "events").select("event_id", dssp_code(label).alias("dssp"))


@registered
def f16_quantize(spark, sf):
    values = views.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return values.select("vec_id", "pos", quantize_f16(F.col("v")).alias("stored"))


@registered
def dense_grid(spark, sf):
    fills = {"ca_x": F.lit(float("nan")), "phi_cos": F.lit(0.0), "dssp": F.lit(0), "residue_mask": F.lit(False)}
    grid = features.padded_grid(kept_features(spark, sf), fills)
    return grid.groupBy(*FRAME_KEY).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if("residue_mask").alias("n_real"),
        F.sum("dssp").alias("dssp_sum"),
        clean(F.sum("phi_cos")).alias("phi_sum"),
    )


# --- fingerprints and splits ---------------------------------------------------------------------------------------


@registered
def trajectory_hash(spark, sf):
    return fingerprint.trajectory_digests(packed.frame_digests(kept_packed(spark, sf)))


@registered
def dataset_hash(spark, sf):
    metadata = views.metadata(spark, sf)
    text = F.concat_ws(":", "traj_id", F.col("n_frames").cast("string"))
    digests = metadata.select(F.sha2(text, 256).alias("content_hash"))
    return fingerprint.dataset_hash(digests, layout="flat")


@registered
def dataset_hash_tree(spark, sf):
    text = F.concat_ws(":", "event_type", F.floor("value").cast("string"))
    return fingerprint.tree_dataset_hash(views.table(spark, sf, "events").select(F.sha2(text, 256).alias("content_hash")))


@registered
def topology_split(spark, sf):
    return splits.topology_split(views.metadata(spark, sf))


@registered
def topology_split_listed(spark, sf):
    return splits.topology_split(views.metadata(spark, sf), order="listed")


@registered
def split_assignment(spark, sf):
    metadata = views.metadata(spark, sf)
    return splits.assigned(metadata, splits.topology_split(metadata)).select("traj_id", "cath_topology", "split")


# --- checks --------------------------------------------------------------------------------------------------------


@registered
def shape_report(spark, sf):
    return checks.shape_report(kept_packed(spark, sf))


def roundtrip(spark, sf):
    rows = kept_packed(spark, sf).select(*FRAME_KEY, "ca")
    return packed.roundtrip_rmsd(rows.withColumn("stored_ca", packed.half_precision(F.col("ca"))), checks.RMSD_THRESHOLD)


@registered
def roundtrip_rmsd(spark, sf):
    return roundtrip(spark, sf).withColumn("rmsd_angstrom", clean(F.col("rmsd_angstrom"), 9))


@registered
def roundtrip_damaged(spark, sf):
    """Raw frames against a store that lost some frames and in which one trajectory's coordinates moved."""
    raw = kept_packed(spark, sf).select(*FRAME_KEY, "ca")
    moved = F.when((F.col("temperature") == 320) & (F.col("replicate") == 1), F.lit(0.125)).otherwise(F.lit(0.0))
    lost = (F.col("temperature") == 450) & (F.col("replicate") == 0) & (F.col("frame") % 3 == 1)
    stored = raw.filter(~lost).withColumn("_by", moved).withColumn("ca", F.transform("ca", lambda v: v + F.col("_by"))).drop("_by")
    stored = stored.withColumn("ca", packed.half_precision(F.col("ca")))
    found = packed.roundtrip_rmsd(packed.beside(raw, stored), checks.RMSD_THRESHOLD)
    return found.withColumn("rmsd_angstrom", clean(F.col("rmsd_angstrom"), 9))


@registered
def random_windows(spark, sf):
    return checks.random_windows(views.metadata(spark, sf))


@registered
def window_rows(spark, sf):
    rows = checks.window_rows(views.event_frames(spark, sf).drop("traj_id"), random_windows(spark, sf), "traj_index", 100)
    return rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_frames"), clean(F.sum("value")).alias("value_sum"))


@registered
def window_percentiles(spark, sf):
    timings = checks.latency_summary(views.table(spark, sf, "events"), "value")
    return timings.withColumns({name: F.round(name, 6) for name in ("p50_ms", "p99_ms")})


def counted_hash(counts):
    text = F.concat_ws(":", "traj_id", F.col("n_frames").cast("string"))
    return fingerprint.dataset_hash(counts.select(F.sha2(text, 256).alias("content_hash")), layout="flat")


def verdict_of(spark, sf, expected_domains, recomputed, trips):
    """Checks of a store: the manifest holds the hash of counted rows, and `recomputed` is told from frame numbers."""
    latency = checks.latency_summary(views.table(spark, sf, "events"), "value").withColumn(
        "passed", (F.col("p50_ms") < 50) & (F.col("p99_ms") < 200)
    )
    observed = views.frames(spark, sf).select("domain_id").distinct()
    manifest = counted_hash(views.metadata(spark, sf)).scalar()
    return checks.verdict([
        ("domain_list", checks.domain_list_check(expected_domains, observed)),
        ("manifest_hash", checks.manifest_hash_check(recomputed, manifest)),
        ("roundtrip_rmsd", trips),
        ("window_latency", latency),
    ])


def numbered_hash(spark, sf, more=0):
    last = views.event_frames(spark, sf).groupBy("traj_id").agg((F.max("frame") + 1 + F.lit(more)).alias("n_frames"))
    return counted_hash(last)


@registered
def check_verdict(spark, sf):
    expected = views.frame_atoms(spark, sf).select("domain_id").distinct()
    return verdict_of(spark, sf, expected, numbered_hash(spark, sf), roundtrip(spark, sf))


@registered
def check_verdict_failing(spark, sf):
    """The same checks on a list with a domain that is not there, one frame too many, and a damaged store."""
    expected = views.frame_atoms(spark, sf).select(F.concat("domain_id", F.lit("x")).alias("domain_id")).distinct()
    return verdict_of(spark, sf, expected, numbered_hash(spark, sf, 1), roundtrip_damaged(spark, sf))


# --- labels --------------------------------------------------------------------------------------------------------

FEATURE_SAMPLE = 8


@registered
def selected_domains(spark, sf):
    requested = views.metadata(spark, sf).groupBy("domain_id").agg(F.max("traj_index").alias("pos"))
    return labels.selected_domains(views.metadata(spark, sf), requested, max_domains=20).select("pos", "domain_id")


@registered
def frame_cap_offsets(spark, sf):
    return labels.frame_offsets(views.metadata(spark, sf), cap=100)


def scored_vectors(spark, sf):
    """Every point of a frame taken as a C-alpha, as standardised vectors."""
    metadata = views.frame_metadata(spark, sf)
    n = metadata.count()
    frames = views.frames(spark, sf).withColumn("traj_id", F.concat_ws("_", *TRAJECTORY_KEY))
    capped = labels.capped_frames(frames, labels.frame_offsets(metadata, cap=0), n_trajectories=n)
    sampled = labels.sampled_points(capped, "xyz", FEATURE_SAMPLE)
    vectors = labels.frame_vectors(sampled, FEATURE_SAMPLE).select(
        "domain_id", "traj_id", "frame", "frame_global", "n_total", "vector"
    )
    return labels.standardised(vectors, n_trajectories=n), n


@registered
def frame_features(spark, sf):
    scored, _ = scored_vectors(spark, sf)
    return scored.select("traj_id", "frame", "frame_global", F.posexplode("z").alias("component", "z")).withColumn(
        "z", clean(F.col("z"))
    )


@registered
def lagged_pairs(spark, sf):
    lagged = labels.lagged_pairs(
        views.event_frames(spark, sf), ["user_id"], "frame", 3, {"event_id": "later_event", "value": "later_value"}
    )
    return lagged.select("event_id", "later_event", "value", "later_value")


def covariance(spark, sf, scope):
    scored, _ = scored_vectors(spark, sf)
    products = labels.lagged_products(scored, 1, pair_scope=scope)
    return labels.lagged_covariance(cut_lineage(products)).withColumns({c: clean(F.col(c)) for c in ("c00", "c0t")})


@registered
def lagged_covariance(spark, sf):
    return covariance(spark, sf, "domain")


@registered
def lagged_covariance_within(spark, sf):
    return covariance(spark, sf, "trajectory")


def slow_points(spark, sf):
    scored, n = scored_vectors(spark, sf)
    scored = cut_lineage(scored)
    return labels.embedded(scored, labels.slow_models(labels.lagged_products(scored, 1)), n_domains=n)


@registered
def tica_embedding(spark, sf):
    points = slow_points(spark, sf)
    return points.select("traj_id", "frame", F.posexplode("e").alias("coordinate", "e")).withColumn("e", clean(F.col("e")))


@registered
def tica_scores(spark, sf):
    scored, _ = scored_vectors(spark, sf)
    gated = labels.health_gate(labels.slow_models(labels.lagged_products(scored, 1)))
    return gated.select(
        "domain_id", "n_total", "dim", clean(F.col("score")).alias("score"), clean(F.col("baseline")).alias("baseline"),
        "health_passed", "method", "fallback_reason",
    )


@registered
def tica_scores_planar(spark, sf):
    """The score of the first two components, where eigenvalues have a closed form."""
    scored, _ = scored_vectors(spark, sf)
    models = labels.slow_models(labels.lagged_products(scored.withColumn("z", F.slice("z", 1, 2)), 1))
    return models.select("domain_id", "n_total", "dim", clean(F.col("score")).alias("score"), clean(F.col("baseline")).alias("baseline"))


@registered
def health_gate(spark, sf):
    scores = views.event_rows(spark, sf).groupBy("domain_id").agg(
        F.avg("value").alias("score"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("baseline")
    )
    return labels.health_gate(scores, 0.5).select("domain_id", "health_passed", "method", "fallback_reason")


@registered
def lloyd_step(spark, sf):
    raw = views.table(spark, sf, "embeddings")
    shaped = raw.selectExpr("concat('d', label) AS domain_id", "vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS e")
    points = ranked(shaped, ["domain_id"], F.floor(F.col("vec_id") / BLOCK), ["vec_id"], "frame_global")
    totals = raw.groupBy(F.concat(F.lit("d"), "label").alias("domain_id")).agg(F.count(F.lit(1)).alias("n_total"))
    start = labels.first_centroids(points, labels.resolution_plan(totals, (4, 16)))
    moved = labels.lloyd_step(points, start, 64)
    return moved.select("domain_id", "resolution", "cluster", *[clean(F.col("e")[c]).alias(f"e{c}") for c in range(64)])


@registered
def kmeans_labels(spark, sf):
    points = cut_lineage(slow_points(spark, sf).select("domain_id", "traj_id", "frame", "frame_global", "n_total", "e"))
    totals = points.groupBy("domain_id").agg(F.max("n_total").alias("n_total"))
    result = labels.clustered(points, totals, (4, 16), iterations=5)
    return result.select("domain_id", "resolution", "traj_id", "frame", "frame_global", "state")


@registered
def kmeans_best_of_five(spark, sf):
    """Whole vectors as points: five seeded starts, three steps, and the labels of the start with the least inertia."""
    raw = views.table(spark, sf, "embeddings")
    shaped = raw.selectExpr("concat('d', label) AS domain_id", "vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS e")
    points = cut_lineage(ranked(shaped, ["domain_id"], F.floor(F.col("vec_id") / BLOCK), ["vec_id"], "frame_global"))
    totals = points.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n_total"))
    found = labels.clustered(points, totals, (4, 16), dim=64, iterations=3, starts=labels.STARTS)
    return found.select("domain_id", "resolution", "vec_id", "state")


# --- solvent exposure and contacts -----------------------------------------------------------------------------------

SPREAD = 20.0


def spread_frames(spark, sf):
    """Frames with coordinates stretched to molecular distances."""
    stretched = f"transform(xyz, p -> struct(p.x * FLOAT({SPREAD}) AS x, p.y * FLOAT({SPREAD}) AS y, p.z * FLOAT({SPREAD}) AS z))"
    return views.frames(spark, sf).withColumn("xyz", F.expr(stretched))


@registered
def residue_sasa(spark, sf):
    atoms = views.frame_atoms(spark, sf)
    spheres = sasa.atom_spheres(spread_frames(spark, sf), atoms, topology.residues(atoms))
    return sasa.residue_areas(spheres).withColumn("area", clean(F.col("area")))


@registered
def contact_graph(spark, sf):
    return pairs.contact_graph(spread_frames(spark, sf), radius=6.0, neighbours=4).withColumn("distance", clean(F.col("distance")))


@registered
def positive_pairs(spark, sf):
    frames = views.event_frames(spark, sf).withColumn("t_ps", F.col("frame") * 250.0)
    return pairs.positive_pairs(frames, "user_id", "t_ps", "event_id", 1000.0)


@registered
def length_buckets(spark, sf):
    words = F.size(F.split("text", " "))
    return views.table(spark, sf, "documents").select("doc_id", pairs.length_bucket(words).alias("bucket"))


# --- states, transitions, comparison ---------------------------------------------------------------------------------

# A made-up set of named states over torsions in degrees.
STATES = {
    "folded": {"psi_deg": (-90.0, 90.0), "ca_x": (-0.1, 0.1)},
    "open": {"psi_deg": (90.0, None)},
    "closed": {"psi_deg": (None, -90.0), "ca_x": (0.0, None)},
}
FRAME_PS = 100.0


@registered
def state_membership(spark, sf):
    points = features.residue_points(views.frames(spark, sf), sites(spark, sf)).filter("has_psi")
    angle = F.degrees(geo.dihedral(*[geo.vector(name) for name in features.TORSION_POINTS["psi"]]))
    return metrics.state_membership(points.withColumn("psi_deg", angle), STATES).select(*RESIDUE_ROW, "state")


def found_states(spark, sf):
    return metrics.discoveries(views.event_frames(spark, sf).withColumnRenamed("event_type", "state"), "traj_index", FRAME_PS)


@registered
def state_discovery(spark, sf):
    return found_states(spark, sf)


@registered
def discovery_curve(spark, sf):
    return metrics.discovery_curve(found_states(spark, sf), "traj_index")


@registered
def discovery_auc(spark, sf):
    return metrics.discovery_auc(found_states(spark, sf), "traj_index", 5000.0).withColumn("auc", clean(F.col("auc")))


@registered
def transition_matrix(spark, sf):
    counts = metrics.transition_counts(views.event_frames(spark, sf), "traj_index", ["domain_id"], "event_type", 2)
    return metrics.transition_matrix(counts, ["domain_id"]).withColumn("p", clean(F.col("p")))


@registered
def chapman_kolmogorov(spark, sf):
    result = metrics.chapman_kolmogorov(views.event_frames(spark, sf), "traj_index", ["domain_id"], "event_type", 1, 3)
    return result.withColumn("residual", clean(F.col("residual")))


@registered
def coverage_entropy(spark, sf):
    result = metrics.coverage_entropy(views.event_rows(spark, sf), ["temperature"], "event_type")
    return result.withColumn("entropy", clean(F.col("entropy")))


@registered
def mutual_information(spark, sf):
    rows = views.event_rows(spark, sf).withColumn("bin", F.floor(F.col("value") / 25))
    return metrics.mutual_information(rows, ["domain_id"], "event_type", "bin").withColumn("bits", clean(F.col("bits")))


def scored_events(events):
    return events.withColumn("hit", F.col("event_type") == "purchase")


@registered
def auroc_by_domain(spark, sf):
    return metrics.auroc(scored_events(views.event_rows(spark, sf)), ["domain_id"], "value", F.col("hit")).withColumn("auroc", clean(F.col("auroc")))


@registered
def auroc_time_shuffled(spark, sf):
    shuffled = metrics.time_shuffled(scored_events(views.event_frames(spark, sf)), "traj_index", "value")
    return metrics.auroc(shuffled, ["domain_id"], "shuffled", F.col("hit")).withColumn("auroc", clean(F.col("auroc")))


@registered
def auroc_drop(spark, sf):
    """AUROC of each domain before and after its time axis is shuffled, and whether it drops by the share it must."""
    ordered = metrics.auroc(scored_events(views.event_rows(spark, sf)), ["domain_id"], "value", F.col("hit"))
    moved = metrics.time_shuffled(scored_events(views.event_frames(spark, sf)), "traj_index", "value")
    mixed = metrics.auroc(moved, ["domain_id"], "shuffled", F.col("hit"))
    table = metrics.auroc_drop(ordered, mixed, ["domain_id"])
    return table.withColumns({name: clean(F.col(name)) for name in ("auroc", "shuffled_auroc", "drop_share")})


@registered
def calibration_error(spark, sf):
    rows = scored_events(views.event_rows(spark, sf)).withColumn("p", F.col("value") / 500.0)
    return metrics.calibration_error(rows, ["domain_id"], "p", "hit").withColumn("ece", clean(F.col("ece")))


@registered
def spearman_by_domain(spark, sf):
    rows = views.event_rows(spark, sf).withColumns({"a": F.floor("value"), "b": F.col("event_id") % 97})
    return metrics.spearman(rows, ["domain_id"], "a", "b").withColumn("rho", clean(F.col("rho")))


def paired_units(spark, sf):
    """Two policies measured on every protein and seed."""
    unit = views.event_rows(spark, sf).withColumn("seed", F.col("replicate") % 5)
    def policy(kind):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return unit.groupBy("domain_id", "seed").agg(F.round(policy("purchase") - policy("signup"), 4).alias("delta")).dropna()


@registered
def paired_bootstrap(spark, sf):
    result = metrics.paired_bootstrap(paired_units(spark, sf), F.concat_ws(":", "domain_id", F.col("seed").cast("string")), "delta")
    return result.withColumns({c: clean(F.col(c)) for c in ("mean_delta", "ci_low", "ci_high")})


@registered
def wilcoxon(spark, sf):
    return metrics.wilcoxon(paired_units(spark, sf), "delta").withColumn("z", clean(F.col("z")))


@registered
def effective_rank(spark, sf):
    result = metrics.effective_rank(views.table(spark, sf, "embeddings"), "embedding", 64)
    return result.withColumn("effective_rank", clean(F.col("effective_rank")))


@registered
def effective_rank_planar(spark, sf):
    """Effective rank of the first two components of each label, by closed-form eigenvalues."""
    rows = views.table(spark, sf, "embeddings").selectExpr("label", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y")
    return metrics.effective_rank_planar(rows, ["label"], "x", "y").withColumn("effective_rank", clean(F.col("effective_rank")))


# --- selection ---------------------------------------------------------------------------------------------------------


def candidates(spark, sf):
    return views.event_frames(spark, sf).groupBy("traj_index").agg(
        (F.avg("value") / 100).alias("mean"), (F.stddev_pop("value") / 100).alias("spread"),
        F.max_by("event_type", "frame").alias("region"),
    )


def region_visits(spark, sf):
    return views.table(spark, sf, "events").groupBy(F.col("event_type").alias("region")).agg(F.count(F.lit(1)).alias("n_visits"))


@registered
def acquisition_score(spark, sf):
    scored = selection.acquisition(candidates(spark, sf), region_visits(spark, sf), "region")
    return scored.select("traj_index", "region", "n_visits", clean(F.col("score")).alias("score"))


PLACES = [f"p{i}" for i in range(3 * views.ATOMS_PER_FRAME)]


def placed_frames(spark, sf):
    """Frames as places in a space with an axis for each coordinate of each point."""
    axes = [F.round(F.col("xyz")[i // 3]["xyz"[i % 3]].cast("double"), 3).alias(name) for i, name in enumerate(PLACES)]
    return views.frames(spark, sf).select(*TRAJECTORY_KEY, "frame", "vec_id", *axes)


def last_places(frames):
    return frames.groupBy(*TRAJECTORY_KEY).agg(F.max_by(F.struct("vec_id", *PLACES), "frame").alias("l")).select("l.*")


VISIT_RADIUS = 1.25


@registered
def visits_within(spark, sf):
    frames = placed_frames(spark, sf)
    return selection.visits_within(last_places(frames), frames, "vec_id", PLACES, VISIT_RADIUS)


@registered
def visits_within_hashed(spark, sf):
    frames = placed_frames(spark, sf)
    return selection.visits_within_hashed(last_places(frames), frames, "vec_id", PLACES, VISIT_RADIUS)


@registered
def budgeted_selection(spark, sf):
    rows = views.event_rows(spark, sf).select("traj_id", F.col("event_id").alias("item"), F.col("value").alias("score"))
    return selection.budgeted(rows, 40)


@registered
def rank_round_robin(spark, sf):
    return selection.round_robin(views.metadata(spark, sf))


@registered
def rank_random(spark, sf):
    return selection.random_with_replacement(views.metadata(spark, sf), 100)


@registered
def rank_rmsd_velocity(spark, sf):
    ranks = selection.rmsd_velocity(views.event_frames(spark, sf), "traj_index", "value", FRAME_PS)
    return ranks.withColumn("velocity", clean(F.col("velocity")))


@registered
def rank_distance_to_known(spark, sf):
    # log10 of zero is NULL here; it is minus infinity, so such a run is infinitely far and comes first.
    depth = F.when(F.col("value") == 0, F.lit(float("-inf"))).otherwise(F.log10("value"))
    events = views.event_frames(spark, sf).withColumn("depth", depth)
    latest = events.groupBy("traj_index").agg(F.max_by(F.struct("value", "depth"), "frame").alias("l")).select("traj_index", "l.*")
    ranks = selection.distance_to_known(latest, "traj_index", ["value", "depth"], [(10.0, 1.0), (60.0, 1.8), (200.0, 2.3)])
    return ranks.withColumn("distance", clean(F.col("distance")))


@registered
def rank_rare_states(spark, sf):
    ranks = selection.rare_states(candidates(spark, sf), region_visits(spark, sf), "traj_index", "region")
    return ranks.select("traj_index", "region", "place", clean(F.col("weight"), 9).alias("weight"))


# --- runs and audits ---------------------------------------------------------------------------------------------------


@registered
def frame_progress(spark, sf):
    windows = views.event_frames(spark, sf).select(
        F.col("traj_id").alias("trajectory_id"), F.col("frame").alias("start_frame"), F.lit(1).alias("frame_count")
    )
    return runs.frame_progress(windows)


@registered
def frame_ingest(spark, sf):
    """Events read as a stream of files, repeats of a key dropped, stored batch by batch and read back."""
    events = views.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/event[s].parquet")
    keyed = stream.select(F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", F.floor("value").alias("whole"))
    # No key is old here: every repeat in the table counts as one.
    fresh = runs.fresh_frames(keyed, "at", ["user_id", "event_type", "whole"], "36500 days")
    folder = working_folder(spark)
    runs.ingest(fresh, f"{folder}/stored", f"{folder}/progress", once=True).awaitTermination()
    return spark.read.schema(fresh.schema).parquet(f"{folder}/stored/batch=*").select("user_id", "event_type", "whole")


@registered
def active_runs(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "error", "terminate").otherwise("extend")
    log = views.event_rows(spark, sf).select(
        F.col("traj_id").alias("trajectory_id"), kind.alias("kind"), F.col("value").alias("ns"),
        F.floor("value").cast("double").alias("priority"), F.col("event_id").alias("seq"),
    )
    return runs.active_runs(log).withColumn("budget_ns", clean(F.col("budget_ns"), 4))


@registered
def checksum_audit(spark, sf):
    documents = views.table(spark, sf, "documents")
    held = documents.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    calls = views.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.sha2("html", 256).alias("digest"))
    published = documents.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2(F.btrim("text"), 256).alias("digest"))
    extra = views.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("path"), F.sha2("text", 256).alias("digest"))
    return checks.checksum_audit(held.unionByName(calls), published.unionByName(extra))
