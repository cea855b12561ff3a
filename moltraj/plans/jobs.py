"""The three complete jobs: prepare a feature store, validate it, label its frames."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.functions.codes import trajectory_id
from moltraj.functions.numeric import round_up
from moltraj.operators import checks, features, fingerprint, labels, packed, sasa, splits, topology
from moltraj.scale import BLOCK, cut_lineage, lookup_join, ranked, running_total
from moltraj.schema import FRAME_MULTIPLE, RESIDUE_MULTIPLE, TRAJECTORY_KEY
from moltraj.sources import landing, sinks

#: Random windows that one job reads.
WINDOW_BATCH = 25
METADATA = [
    "traj_index", "traj_id", "domain_id", "cath_topology", "temperature_kelvin", "replicate", "n_frames", "n_frames_raw",
    "n_res", "frame_dt_ps", "ff_tag", "source_path", "content_hash",
]


@dataclass(frozen=True)
class Landed:
    """Landed input tables of one dataset (see `moltraj.schema`)."""

    domains: DataFrame
    atoms: DataFrame
    trajectories: DataFrame
    frames: DataFrame

    @staticmethod
    def read(spark: SparkSession, root: str) -> Landed:
        tables = (spark.read.parquet(f"{root}/{name}") for name in ("domains", "atoms", "trajectories"))
        return Landed(*tables, landing.read_frames(spark, f"{root}/frames"))


def first_ids(df: DataFrame, column: str = "domain_id") -> list[str]:
    return [row[0] for row in df.select(column).distinct().orderBy(column).limit(10).collect()]


def plan(landed: Landed, listed: DataFrame) -> DataFrame:
    """Trajectories to process, in list order, then temperature as text, then replicate as number."""
    absent = first_ids(listed.join(landed.domains.select("domain_id"), "domain_id", "left_anti"))
    if absent:
        raise FileNotFoundError(f"no landed data for domains {absent}")
    wanted = landed.trajectories.join(listed.select("domain_id").distinct(), "domain_id", "left_semi")
    counted = landed.frames.groupBy(*TRAJECTORY_KEY).agg(F.count(F.lit(1)).alias("counted_frames"))
    catalog = landing.trajectory_catalog(wanted, counted)
    bare = first_ids(landing.domains_without_trajectories(listed, catalog))
    if bare:
        raise ValueError(f"no trajectory groups found for domains {bare}")
    planned = landing.plan_trajectories(catalog, wanted.select(*TRAJECTORY_KEY, "num_frames"), counted)
    sizes = landed.domains.select("domain_id", F.col("num_residues").alias("n_residues"))
    placed = planned.join(sizes, "domain_id").join(listed, "domain_id")
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """traj_index over (pos, temperature, replicate): offsets of (pos, temperature) groups, then places in a group."""
    group = ["pos", "temperature"]
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_total(sizes, [], F.floor(F.col("pos") / BLOCK), group, F.col("_n"), "_from").drop("_n")
    inside = ranked(placed, group, F.floor(F.col("replicate") / BLOCK), ["replicate"], "_in")
    return inside.join(offsets, group).withColumn("traj_index", F.col("_from") + F.col("_in")).drop("_from", "_in")


def check_atoms(landed: Landed) -> None:
    texts = landed.domains.filter("pdb_text IS NOT NULL")
    named = landing.pdb_atom_names(texts, ["domain_id"], "pdb_text")
    atoms = landed.atoms.join(texts.select("domain_id"), "domain_id", "left_semi")
    wrong = topology.atom_count_mismatch(named, atoms).orderBy("domain_id").limit(1).collect()
    if wrong:
        row = wrong[0]
        raise ValueError(
            f"{row.domain_id}: structure text lists {row.listed_atoms} atoms, atom table has {row.stored_atoms}"
        )


def prepare(
    landed: Landed, listed: DataFrame, out: str, *, force: bool = False, dry_run: bool = False, frame_dt_ps: float = 1000.0,
    filter_unfolded: bool = True, with_sasa: bool = False, topologies: DataFrame | None = None, source_root: str = "",
    dataset: str = "", source_repo: str = "", domains_path: str = "", labels_of_dataset: dict[str, str] | None = None,
    split_order: str = "hash", nested: bool = False,
) -> DataFrame:
    """Write features, metadata, splits and manifest below `out`; returns the plan summary, or only that in a dry run.

    `listed` is (pos, domain_id); a domain listed twice is planned twice. `topologies` maps domain_id to cath_topology
    and defaults to the domain itself; `nested` puts the trajectory rows into the manifest document as well. If a listed domain has no trajectories, a report on the frame table is left below
    `out` before the error.
    """
    spark = landed.frames.sparkSession
    try:
        planned = plan(landed, listed)
    except ValueError:
        landing.schema_dump(landed.frames, f"{out}/frames_schema")
        raise
    summary = landing.plan_summary(listed, planned)
    if dry_run:
        return summary
    if planned.isEmpty():
        raise ValueError("nothing to do: the plan has no trajectories")
    sinks.guard(spark, f"{out}/manifest", force)
    check_atoms(landed)

    planned = cut_lineage(planned)
    atoms = landing.decoded_atoms(landed.atoms).join(listed.select("domain_id").distinct(), "domain_id", "left_semi")
    residue_table = topology.residues(atoms)
    topology.require_ca(residue_table)
    spheres = sasa.domain_spheres(atoms, residue_table) if with_sasa else None
    kept = kept_payload(landed, planned, topology.residue_sites(residue_table), spheres, filter_unfolded=filter_unfolded)
    sinks.write_frames(packed.packed_frames(kept, precise=False), f"{out}/frames", force=True)

    metadata = store_metadata(
        spark, planned, residue_table, out, frame_dt_ps=frame_dt_ps, with_sasa=with_sasa, topologies=topologies,
        source_root=source_root,
    )
    sinks.write_table(metadata, f"{out}/metadata", force=True)
    metadata = spark.read.parquet(f"{out}/metadata")
    topology_splits = splits.topology_split(metadata, order=split_order)
    write_splits(metadata, topology_splits, f"{out}/splits")
    write_manifest(
        metadata, f"{out}/manifest",
        {
            "dataset": dataset, "source_repo": source_repo, "domains_path": domains_path, **(labels_of_dataset or {}),
            "frame_dt_default_ps": frame_dt_ps, "filter_high_temp_unfolded": filter_unfolded,
            "frame_dt_policy": "fixed by parameter", "with_sasa": with_sasa,
        },
        nested=nested,
    )
    return summary


def kept_payload(
    landed: Landed, planned: DataFrame, sites: DataFrame, spheres: DataFrame | None = None, *, filter_unfolded: bool = True,
    max_rows: int | None = None,
) -> DataFrame:
    """Kept frames of the planned trajectories next to their domain's arrays. Coordinates take part in one join."""
    carried = planned.select(*TRAJECTORY_KEY).distinct().join(packed.domain_arrays(sites, spheres), "domain_id")
    return features.kept_frames(
        landed.frames, landed.trajectories, filter_unfolded=filter_unfolded, carried=carried, max_rows=max_rows
    )


def store_metadata(
    spark: SparkSession, planned: DataFrame, residue_table: DataFrame, out: str, *, frame_dt_ps: float, with_sasa: bool,
    topologies: DataFrame | None, source_root: str,
) -> DataFrame:
    """Metadata rows from the written store: kept frames, residues and content hash of every planned trajectory."""
    stored = sinks.read_frames(spark, out)
    digests = packed.frame_digests(stored, include_sasa=with_sasa)
    hashes = fingerprint.trajectory_digests(digests).select(
        trajectory_id(F.col("domain_id"), F.col("temperature"), F.col("replicate")).alias("traj_id"), "content_hash"
    )
    kept = stored.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_frames"))
    sizes = residue_table.groupBy("domain_id").agg(F.count(F.lit(1)).cast("int").alias("n_res"))
    rows = planned.join(sizes, "domain_id").join(kept, "traj_id", "left").join(hashes, "traj_id", "left")
    if topologies is None:
        rows = rows.withColumn("cath_topology", F.col("domain_id"))
    else:
        rows = rows.join(topologies.select("domain_id", "cath_topology"), "domain_id", "left")
    return rows.withColumns({
        "cath_topology": F.coalesce("cath_topology", "domain_id"),
        "temperature_kelvin": F.col("temperature").cast("int"),
        "n_frames": F.coalesce("n_frames", F.lit(0)),
        "frame_dt_ps": F.lit(float(frame_dt_ps)),
        "ff_tag": F.lit(0),
        "source_path": F.concat(F.lit(source_root), F.col("domain_id")),
        "content_hash": F.coalesce("content_hash", F.lit(fingerprint.EMPTY)),
    }).select(*METADATA)


def write_splits(metadata: DataFrame, topology_splits: DataFrame, out: str) -> None:
    """Topologies and trajectories with their split as JSON lines, and the seed they were drawn with."""
    assigned = splits.assigned(metadata, topology_splits)
    sinks.write_lines(sinks.json_rows(topology_splits.withColumns({"seed": F.lit(splits.SEED), "split_unit": F.lit("cath_topology")})), f"{out}/topologies", force=True)
    sinks.write_lines(sinks.json_rows(assigned.sort("split", "traj_id")), f"{out}/trajectories", force=True)


def write_manifest(metadata: DataFrame, path: str, header: dict, *, nested: bool = False) -> None:
    """One JSON document that names the file of trajectory rows beside it; `nested` also repeats them in the document."""
    hashed = fingerprint.dataset_hash(metadata)
    sizes = metadata.agg(
        round_up(F.max("n_frames_raw"), FRAME_MULTIPLE).alias("max_frames"),
        round_up(F.max("n_res"), RESIDUE_MULTIPLE).alias("max_residues"),
    )
    document = hashed.withColumns({
        **{name: F.lit(value) for name, value in header.items()},
        "n_trajectories": metadata.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "hash_layout": F.lit("tree"),
        "trajectories_path": F.lit(f"{path}_trajectories"),
        "max_frames": sizes.select("max_frames").scalar(),
        "max_residues": sizes.select("max_residues").scalar(),
    })
    if nested:
        rows = metadata.agg(F.array_sort(F.collect_list(F.struct(*METADATA))).alias("t"))
        document = document.withColumn("trajectories", rows.scalar())
    sinks.write_lines(sinks.json_rows(metadata), f"{path}_trajectories", force=True)
    sinks.write_lines(sinks.json_rows(document), path, force=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def validation_report(
    landed: Landed, listed: DataFrame, out: str, *, n_windows: int = 100, window_frames: int = 64, seed: int = 0,
    filter_unfolded: bool = True, rmsd_threshold: float = checks.RMSD_THRESHOLD, p50_ms: float = 50.0, p99_ms: float = 200.0,
) -> DataFrame:
    """One row that holds what was found, per check, next to its verdict: sizes, shapes, missing and unexpected domains,
    hashes, the worst round trip, window latencies and their thresholds.

    Round trips and content hashes are checked for every trajectory. Names of domains are listed up to NAMES each.
    """
    spark = landed.frames.sparkSession
    metadata, stored = spark.read.parquet(f"{out}/metadata"), sinks.read_frames(spark, out)
    manifest = read_manifest(spark, f"{out}/manifest")
    with_sasa = bool(manifest.select("with_sasa").first()[0])
    atoms = landing.decoded_atoms(landed.atoms).join(listed.select("domain_id").distinct(), "domain_id", "left_semi")
    planned = planned_trajectories(landed.trajectories, metadata)
    raw = kept_payload(landed, planned, topology.residue_sites(topology.residues(atoms)), filter_unfolded=filter_unfolded)
    digests = fingerprint.trajectory_digests(packed.frame_digests(stored, include_sasa=with_sasa))
    contents = checks.content_hash_check(identified(digests), metadata, fingerprint.EMPTY)
    trips = cut_lineage(identified(packed.roundtrip_rmsd(packed.beside(packed.packed_frames(raw), stored), rmsd_threshold)))
    latency = checks.latency_summary(timed_windows(stored, metadata, n_windows, window_frames, seed))

    def one(rows: DataFrame, **columns) -> F.Column:
        return rows.agg(F.first(F.struct(*[value.alias(name) for name, value in columns.items()]))).scalar()

    def names(finding: str) -> F.Column:
        found = checks.set_difference(listed, metadata, "domain_id").filter(F.col("finding") == finding)
        return found.orderBy("domain_id").limit(NAMES).agg(F.array_sort(F.collect_list("domain_id"))).scalar()

    recomputed = checks.manifest_hash_check(fingerprint.dataset_hash(metadata), manifest.select("dataset_hash").scalar())
    worst = trips.agg(F.max_by(F.struct("traj_id", "n_frames", "rmsd_angstrom"), F.coalesce(F.col("rmsd_angstrom"), F.lit(float("inf")))))
    covered = checks.coverage_check(trips, metadata)
    parts = {
        "domain_list": one(
            checks.domain_list_check(listed, metadata),
            **{name: F.col(name) for name in ("expected_count", "observed_count", "n_missing", "n_unexpected", "passed")},
        ),
        "manifest_hash": one(recomputed, expected=F.col("expected"), recomputed=F.col("recomputed"), passed=F.coalesce("passed", F.lit(False))),
        "content_hash": contents.agg(F.struct(
            F.count(F.lit(1)).alias("n_trajectories"), F.count_if(~F.col("passed")).alias("n_wrong"),
            F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))).scalar(),
        "roundtrip_rmsd": covered.agg(F.struct(
            F.count(F.lit(1)).alias("n_trajectories"), F.count_if(~F.col("passed")).alias("n_wrong"), worst.scalar().alias("worst"),
            F.lit(rmsd_threshold).alias("threshold_angstrom"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))).scalar(),
        "window_latency": one(
            latency, n_windows=F.lit(n_windows), window_frames=F.lit(window_frames), seed=F.lit(seed), p50_ms=F.col("p50_ms"), p99_ms=F.col("p99_ms"),
            max_ms=F.col("max_ms"), p50_threshold_ms=F.lit(p50_ms), p99_threshold_ms=F.lit(p99_ms),
            passed=F.coalesce((F.col("p50_ms") < p50_ms) & (F.col("p99_ms") < p99_ms), F.lit(False)),
        ),
    }
    report = manifest.select(
        "dataset_hash", metadata.agg(F.count_distinct("domain_id")).scalar().alias("n_domains"),
        metadata.agg(F.count(F.lit(1))).scalar().alias("n_trajectories"), "max_frames", "max_residues",
        checks.shape_report(stored).agg(F.array_sort(F.collect_list(F.struct("array_name", "n_trajectories", "n_frames", "n_residues", "n_parts")))).scalar().alias("shapes"),
        names("missing").alias("missing"), names("unexpected").alias("unexpected"), *[part.alias(name) for name, part in parts.items()],
    )
    whole = F.lit(True)
    for name in parts:
        whole = whole & F.col(f"{name}.passed")
    return cut_lineage(report.withColumn("passed", whole))


#: Fixed order of the checks.
CHECKS = ("domain_list", "manifest_hash", "content_hash", "roundtrip_rmsd", "window_latency")
#: Domains that a report lists by name for each finding.
NAMES = 100


def validate(landed: Landed, listed: DataFrame, out: str, **options) -> DataFrame:
    """(check_name, passed) of a written store; the row `all` is the verdict. The report is left at `out`/validation."""
    report = validation_report(landed, listed, out, **options)
    sinks.write_lines(sinks.json_rows(report), f"{out}/validation", force=True)
    rows = [F.struct(F.lit(name).alias("check_name"), F.col(f"{name}.passed").alias("passed")) for name in CHECKS]
    return report.select(F.inline(F.array(*rows, F.struct(F.lit("all").alias("check_name"), F.col("passed").alias("passed")))))


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("traj_id", trajectory_id(F.col("domain_id"), F.col("temperature"), F.col("replicate")))


def planned_trajectories(trajectories: DataFrame, metadata: DataFrame) -> DataFrame:
    """Trajectories of the metadata; groups that were never planned have no stored rows to compare."""
    return identified(trajectories).join(metadata.select("traj_id").distinct(), "traj_id", "left_semi").select(*TRAJECTORY_KEY)


def fetched_windows(stored: DataFrame, windows: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """C-alpha arrays of the frames in each of a few windows, in one job.

    Folders are pruned by domain; row groups and pages by the trajectories and frame ranges that the windows name.
    """
    wanted = [F.col("domain_id").isin(sorted({domain for domain, _ in names})), F.col("traj_id").isin(sorted({traj for _, traj in names}))]
    rows = stored.filter(wanted[0] & wanted[1]).select("traj_id", "frame", "ca")
    inside = (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop"))
    return rows.join(F.broadcast(windows), "traj_id").filter(inside).select("window_id", "frame", "ca")


def timed_windows(
    stored: DataFrame, metadata: DataFrame, n_windows: int, window_frames: int, seed: int, *, batch: int = WINDOW_BATCH
) -> DataFrame:
    """Time to read each random window. Windows are read in batches of one job each; a window's time is its share.

    The windows are drawn and kept first, so that drawing them is not part of the time. The first batch is read once
    before it is timed, as a reader's connection and code are warm in use. A batch that lacks frames takes for ever.
    """
    spark = stored.sparkSession
    windows = checks.random_windows(metadata, n_windows=n_windows, window_frames=window_frames, seed=seed)
    domains = metadata.select("traj_index", "domain_id")
    rows = windows.join(domains, "traj_index").orderBy("window_id").collect()
    if not rows:
        raise ValueError(f"every trajectory is shorter than {window_frames} frames")
    spent = []
    for low in range(0, len(rows), batch):
        part = rows[low : low + batch]
        table = spark.createDataFrame([(r.window_id, r.traj_id, r.start, r.stop) for r in part], "window_id bigint, traj_id string, start bigint, stop bigint")
        names = [(r.domain_id, r.traj_id) for r in part]
        for _ in range(2 if low == 0 else 1):
            begun = time.perf_counter()
            found = fetched_windows(stored, table, names).toArrow().num_rows
            each = (time.perf_counter() - begun) * 1000.0 / len(part)
        whole = found == sum(r.stop - r.start for r in part)
        spent += [(int(r.window_id), each if whole else float("inf")) for r in part]
    return spark.createDataFrame(spent, "window_id bigint, ms double")


def label(
    spark: SparkSession, data: str, out: str, *, requested: DataFrame | None = None, max_domains: int | None = None,
    resolutions: Sequence[int] = labels.RESOLUTIONS, lag: int = 1, dim: int = labels.SLOW_DIM,
    feature_residues: int = labels.FEATURE_RESIDUES, cap: int = 0, margin: float = 0.0, seed: int = 0,
    iterations: int = 10, starts: int = labels.STARTS, seeding: str = "oversampled", pair_scope: str = "domain", force: bool = False,
    nested: bool = False,
) -> DataFrame:
    """Label every frame of the selected domains at every resolution; returns the per-domain results.

    Frame vectors are materialised once, for the covariance pass and the projection, and the projected points once for
    the clustering steps.
    """
    sinks.guard(spark, f"{out}/manifest", force)
    metadata = spark.read.parquet(f"{data}/metadata")
    chosen = labels.selected_domains(metadata, requested, max_domains)
    if chosen.isEmpty():
        raise ValueError("no domains selected")
    # A domain listed twice is labelled once.
    metadata = metadata.join(chosen.select("domain_id").distinct(), "domain_id", "left_semi")
    first = metadata.groupBy("traj_id").agg(F.min("traj_index").alias("traj_index"))
    metadata = metadata.join(first, ["traj_id", "traj_index"], "left_semi")
    offsets = cut_lineage(labels.frame_offsets(metadata, cap))
    stored = sinks.read_frames(spark, data).select("domain_id", "traj_id", "frame", "ca")
    n = offsets.count()
    points = labels.points_from_store(labels.capped_frames(stored, offsets, n_trajectories=n), feature_residues)
    scored = cut_lineage(labels.standardised(labels.frame_vectors(points, feature_residues), n_trajectories=n))
    models = cut_lineage(labels.slow_models(labels.lagged_products(scored, lag, pair_scope=pair_scope), dim=dim, seed=seed))
    embedded = cut_lineage(labels.embedded(scored, models, n_domains=models.count()))
    totals = embedded.groupBy("domain_id").agg(F.max("n_total").alias("n_total"))
    states = labels.clustered(
        embedded, totals, resolutions, dim=dim, seed=seed, iterations=iterations, starts=starts, seeding=seeding
    )
    block = F.floor(F.col("frame_global") / BLOCK)
    (
        states.select("domain_id", "resolution", "traj_id", "frame", "frame_global", "state")
        .repartition("domain_id", "resolution", block).sortWithinPartitions("domain_id", "resolution", "frame_global")
        .write.mode("overwrite").partitionBy("domain_id", "resolution").parquet(f"{out}/labels")
    )
    sinks.write_table(offsets, f"{out}/offsets", force=True)
    results = domain_results(totals, models, resolutions, margin, 3 * feature_residues)
    sinks.write_table(results, f"{out}/results", force=True)
    results = spark.read.parquet(f"{out}/results")
    header = {
        "stage": labels.STAGE, "label_type": labels.LABEL_TYPE, "data_root": data, "out_root": out, "lagtime": lag,
        "tica_dim": dim, "health_margin": margin, "seed": seed, "starts": starts, "seeding": seeding,
    }
    document = read_manifest(spark, f"{data}/manifest").select("dataset_hash").withColumns({
        **{name: F.lit(value) for name, value in header.items()},
        "resolutions": F.array(*[F.lit(r) for r in resolutions]),
        "domains_path": F.lit(f"{out}/manifest_domains"),
    })
    sinks.write_lines(sinks.json_rows(results), f"{out}/manifest_domains", force=True)
    if nested:
        rows = results.agg(F.array_sort(F.collect_list(F.struct(*results.columns))).alias("d"))
        document = document.withColumn("domains", rows.scalar())
    sinks.write_lines(sinks.json_rows(document), f"{out}/manifest", force=True)
    return results


def domain_results(
    totals: DataFrame, models: DataFrame, resolutions: Sequence[int], margin: float, feature_dim: int
) -> DataFrame:
    """One row per domain and resolution: states, scores, gate and method. A domain without a model is `degenerate`."""
    gated = labels.health_gate(models, margin).drop("n_total", "mean", "weights", "singular_values", "dim")
    rows = labels.resolution_plan(totals, resolutions)
    joined = lookup_join(rows, gated, ["domain_id"], "left", salt_by=["resolution"])
    return joined.select(
        "domain_id", "resolution", F.col("n_total").alias("n_frames"), F.lit(feature_dim).alias("feature_dim"),
        F.least(F.col("resolution").cast("bigint"), F.col("n_total")).alias("n_states"),
        F.coalesce("method", F.lit("degenerate")).alias("method"),
        F.col("score").alias("health_score"), F.col("baseline").alias("random_projection_baseline"),
        F.lit(float(margin)).alias("health_margin"), F.coalesce("health_passed", F.lit(False)).alias("health_passed"),
        "fallback_reason",
    )
