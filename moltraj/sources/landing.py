"""Reading landed inputs: domain lists, file listings, structure text, atom tables, trajectory catalogues."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltraj import schema
from moltraj.functions.codes import decode_text, strip, trajectory_id
from moltraj.scale import lookup_join, ranked
from moltraj.schema import TRAJECTORY_KEY

LINE_BREAK = "\r\n|\r|\n"


def listed(line: Column) -> Column:
    """True for a list line that names something: not blank, not a comment."""
    return (F.length(line) > 0) & ~F.startswith(line, F.lit("#"))


def list_entries(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Entries of list texts in order, duplicates kept: (keys, pos, entry)."""
    lines = texts.select(*keys, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("_line", "_raw"))
    kept = lines.withColumn("entry", strip(F.col("_raw"))).filter(listed(F.col("entry")))
    return kept.select(*keys, F.col("_line").alias("pos"), "entry")


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, domain_id) of a list file, in file order.

    Lines are read as ordinary text splits; order is the split's offset in the file, then the row in the split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
        strip(F.col("value")).alias("domain_id"),
    ).filter(listed(F.col("domain_id")))
    domains = ranked(lines, [], F.col("_split"), ["_row"], "pos").select("pos", "domain_id")
    if domains.isEmpty():
        raise ValueError(f"domain list is empty: {path}")
    return domains


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths below `root` that match a glob; only the listing is read, never the contents."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(root).select("path")
    )


def resolve_files(domains: DataFrame, files: DataFrame, root: str, prefix: str, suffix: str = ".h5") -> DataFrame:
    """Source path of each listed domain: directly under the root if there, else in its data folder, else NULL."""
    base = root.rstrip("/")
    name = F.element_at(F.split("path", "/"), -1)
    own = F.startswith(name, F.lit(prefix)) & F.endswith(name, F.lit(suffix))
    bare = F.substr(name, F.lit(len(prefix) + 1), F.length(name) - F.lit(len(prefix) + len(suffix)))
    direct = F.col("path") == F.concat(F.lit(f"{base}/"), name)
    nested = F.col("path") == F.concat(F.lit(f"{base}/data/"), name)
    found = (
        files.filter(own & (direct | nested))
        .select(bare.alias("domain_id"), F.when(direct, 0).otherwise(1).alias("_place"), "path")
        .groupBy("domain_id")
        .agg(F.min_by("path", "_place").alias("source_path"))
    )
    return domains.join(found, "domain_id", "left")


def missing_files(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("source_path").isNull()).select("domain_id").distinct()


def trajectory_catalog(groups: DataFrame, coords: DataFrame) -> DataFrame:
    """Groups that are trajectories: an all-digit temperature name and coordinates; temperatures sort as text."""
    named = groups.filter(F.col("temperature").rlike("^[0-9]+$"))
    return named.join(coords.select(*TRAJECTORY_KEY).distinct(), TRAJECTORY_KEY, "left_semi").select(
        *TRAJECTORY_KEY, trajectory_id(F.col("domain_id"), F.col("temperature"), F.col("replicate")).alias("traj_id")
    )


def domains_without_trajectories(domains: DataFrame, catalog: DataFrame) -> DataFrame:
    return domains.join(catalog.select("domain_id").distinct(), "domain_id", "left_anti").select("domain_id").distinct()


def pdb_atom_names(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Atom names in columns 13-16 of ATOM and HETATM lines, numbered in order from 0 in each text."""
    lines = F.filter(
        F.split(F.col(text), LINE_BREAK),
        lambda line: F.startswith(line, F.lit("ATOM")) | F.startswith(line, F.lit("HETATM")),
    )
    named = texts.select(*keys, F.posexplode(lines).alias("atom_index", "_line"))
    return named.select(*keys, "atom_index", strip(F.substring("_line", 13, 4)).alias("atom_name"))


def decoded_atoms(atoms: DataFrame, columns: Sequence[str] = ("atom_name", "chain", "resname", "element")) -> DataFrame:
    """Atom text columns decoded from bytes or text and stripped."""
    return atoms.withColumns({name: decode_text(F.col(name)) for name in columns if name in atoms.columns})


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Landed frames; `domain_id` is the partition folder, so domain filters prune files."""
    return spark.read.schema(schema.FRAMES).parquet(path)


def frame_payload(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coordinates, labels and RMSD of the catalogued trajectories only."""
    keyed = catalog.select(*TRAJECTORY_KEY).distinct()
    return lookup_join(frames, keyed, TRAJECTORY_KEY, "left_semi", salt_by=["frame"])


def plan_trajectories(catalog: DataFrame, attributes: DataFrame, counted: DataFrame) -> DataFrame:
    """Planned trajectories with raw frame counts: the stored attribute if present, else the counted rows."""
    return (
        catalog.join(counted, TRAJECTORY_KEY, "left")
        .join(attributes, TRAJECTORY_KEY, "left")
        .withColumn("n_frames_raw", F.coalesce(F.col("num_frames").cast("bigint"), F.col("counted_frames")))
        .drop("num_frames", "counted_frames")
    )


def plan_summary(domains: DataFrame, planned: DataFrame) -> DataFrame:
    """The dry-run row: how many domains and trajectories, and the largest sizes (0 when nothing is planned)."""
    return planned.agg(
        F.count(F.lit(1)).alias("n_trajectories"),
        F.coalesce(F.max("n_frames_raw"), F.lit(0)).alias("max_frames"),
        F.coalesce(F.max("n_residues"), F.lit(0)).alias("max_residues"),
    ).select(
        domains.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_domains"),
        "n_trajectories", "max_frames", "max_residues",
    )


def describe_source(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, NULLs and array sizes, from a single aggregate over the data."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        sized = isinstance(field.dataType, (T.ArrayType, T.MapType))
        size = F.size(F.col(field.name)) if sized else F.lit(None).cast("int")
        parts += [
            F.count_if(F.col(field.name).isNull()).alias(f"nulls_{i}"),
            F.min(size).alias(f"least_{i}"),
            F.max(size).alias(f"most_{i}"),
        ]
    report = [
        F.struct(
            F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("data_type"),
            F.col("rows").alias("n_rows"), F.col(f"nulls_{i}").alias("n_nulls"),
            F.col(f"least_{i}").alias("min_size"), F.col(f"most_{i}").alias("max_size"),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return df.agg(*parts).select(F.inline(F.array(*report)))


def schema_dump(df: DataFrame, path: str) -> None:
    """Write the schema and the column report next to a source that could not be used."""
    report = describe_source(df).withColumn("schema", F.lit(json.dumps(df.schema.jsonValue(), sort_keys=True)))
    report.coalesce(1).write.mode("overwrite").json(path)
