"""Trajectory-shaped views over the general test tables, and the same views as SQL text.

The test tables hold no molecules. Embedding vectors stand in for frames of coordinates, and event logs for long
trajectories of states. Each view is derived from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.functions.codes import trajectory_id
from moltraj.scale import BLOCK, ranked
from moltraj.schema import TRAJECTORY_KEY

ATOMS_PER_FRAME = 20
ATOM_NAMES = ("N", "CA", "C", "CB")
RESIDUE_NAMES = ("ALA", "GLY", "SER", "TRP", "VAL")
# (residue, atom) pairs that a frame has points for but the topology does not name.
UNNAMED = ((1, "CB"), (3, "CB"), (3, "N"))
# Trajectory key of an embedding vector.
TRAJECTORY_SQL = (
    "concat('d', label) AS domain_id",
    "if(vec_id % 2 = 0, 320, 450) AS temperature",
    "CAST(floor((vec_id % 4) / 2) AS INT) AS replicate",
)
TEMPERATURES = (320, 348, 379, 413, 450)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames in the landing layout, with 20 points each, plus the vector itself."""
    vectors = table(spark, sf_dir, "embeddings")
    points = ", ".join(
        "struct(" + ", ".join(f"embedding[{3 * a + k}] AS {axis}" for k, axis in enumerate("xyz")) + ")"
        for a in range(ATOMS_PER_FRAME)
    )
    labels = ", ".join(
        f"CASE WHEN embedding[{k}] > 0 THEN 'H' WHEN embedding[{k}] < -0.1 THEN 'E' ELSE ' ' END"
        for k in range(len(RESIDUE_NAMES))
    )
    shaped = vectors.selectExpr(
        *TRAJECTORY_SQL,
        "abs(embedding[60]) * FLOAT(4) AS rmsd",
        f"array({labels}) AS dssp",
        f"array({points}) AS xyz",
        "vec_id",
    )
    return numbered(shaped)


def numbered(shaped: DataFrame) -> DataFrame:
    block = F.floor(F.col("vec_id") / F.lit(BLOCK))
    return ranked(shaped, TRAJECTORY_KEY, block, ["vec_id"], "frame").withColumn("frame", F.col("frame").cast("int"))


def rmsd_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory attributes of the frames: RMSD is in nm everywhere."""
    series = table(spark, sf_dir, "embeddings").selectExpr(*TRAJECTORY_SQL).distinct()
    return series.withColumns({"rmsd_unit": F.lit("nm"), "has_rmsd": F.lit(True)})


def frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trajectory of the frames with its length; trajectories of a domain follow each other by temperature."""
    counts = table(spark, sf_dir, "embeddings").selectExpr(*TRAJECTORY_SQL).groupBy(*TRAJECTORY_KEY).agg(
        F.count(F.lit(1)).alias("n_frames")
    )
    return counts.withColumns({
        "traj_id": F.concat_ws("_", *TRAJECTORY_KEY),
        "traj_index": F.col("temperature") * 1000 + F.col("replicate"),
    })


def frame_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom table of the frames: one fixed set of names for every domain found in the data."""
    named = [
        (4 * r + a, name, r, RESIDUE_NAMES[r])
        for r in range(len(RESIDUE_NAMES)) for a, name in enumerate(ATOM_NAMES) if (r, name) not in UNNAMED
    ]
    atoms = ", ".join(
        f"struct({i} AS atom_index, '{name}' AS atom_name, 'A' AS chain, {r} AS resid, '{resname}' AS resname, "
        f"'{name[0]}' AS element)" for i, name, r, resname in named
    )
    domains = table(spark, sf_dir, "embeddings").select("label").distinct()
    return domains.selectExpr("concat('d', label) AS domain_id", f"inline(array({atoms}))")


FRAMES_SQL = """
frames AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY domain_id, temperature, replicate ORDER BY vec_id) - 1 AS INTEGER) AS frame
  FROM (SELECT 'd' || label AS domain_id, CASE WHEN vec_id % 2 = 0 THEN 320 ELSE 450 END AS temperature,
               CAST(floor((vec_id % 4) / 2) AS INTEGER) AS replicate,
               abs(embedding[61]) * CAST(4 AS FLOAT) AS rmsd, embedding AS e, vec_id
        FROM embeddings) v)
"""

KEPT_SQL = FRAMES_SQL + """,
kept AS (
  SELECT * EXCLUDE (frame), frame AS source_frame,
         CAST(row_number() OVER (PARTITION BY domain_id, temperature, replicate ORDER BY frame) - 1 AS INTEGER) AS frame
  FROM frames WHERE temperature <> 450 OR rmsd * CAST(10 AS FLOAT) <= CAST(4 AS FLOAT))
"""


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one trajectory per user, numbered by time.

    Numbered in one-minute blocks, so that a user with a large share of the events is spread over many tasks.
    """
    events = table(spark, sf_dir, "events")
    block = (F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")) * 60 + F.minute("ts")
    placed = ranked(
        events.select("event_id", "user_id", "ts", "event_type", "value"),
        ["user_id"], block, ["ts", "event_id"], "frame",
    )
    return with_names(placed)


def with_names(events: DataFrame) -> DataFrame:
    temperature = F.get(F.array(*[F.lit(t) for t in TEMPERATURES]), (F.col("user_id") % 5).cast("int"))
    named = events.withColumns({
        "traj_index": F.col("user_id"),
        "domain_id": F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string")),
        "temperature": temperature,
        "replicate": F.floor(F.col("user_id") / 50).cast("int"),
    })
    return named.withColumn("traj_id", trajectory_id(F.col("domain_id"), F.col("temperature"), F.col("replicate")))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their trajectory names but without frame numbers, for measures that do not need an order."""
    return with_names(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user as trajectory metadata; topology is the domain itself."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_frames"))
    return with_names(counts).withColumn("cath_topology", F.col("domain_id")).drop("user_id")


EVENTS_SQL = """
event_frames AS (
  SELECT event_id, user_id, ts, event_type, value, user_id AS traj_index, 'd' || (user_id % 50) AS domain_id,
         CASE user_id % 5 WHEN 0 THEN 320 WHEN 1 THEN 348 WHEN 2 THEN 379 WHEN 3 THEN 413 ELSE 450 END AS temperature,
         CAST(floor(user_id / 50) AS INTEGER) AS replicate,
         'd' || (user_id % 50) || '_' || CASE user_id % 5 WHEN 0 THEN 320 WHEN 1 THEN 348 WHEN 2 THEN 379 WHEN 3 THEN 413
              ELSE 450 END || '_' || CAST(floor(user_id / 50) AS INTEGER) AS traj_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
  FROM events),
meta AS (
  SELECT traj_index, domain_id, temperature, replicate, traj_id, domain_id AS cath_topology, count(*) AS n_frames
  FROM event_frames GROUP BY ALL)
"""


def event_atoms_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event frames with the atom name each event type stands for."""
    # Fixed values of this view: atom names by event type.
    kinds = {"click": "N", "view": "CA", "purchase": "C", "signup": "CB"}
    atom = F.lit("O")
    for kind, name in kinds.items():
        atom = F.when(F.col("event_type") == kind, name).otherwise(atom)
    return event_frames(spark, sf_dir).withColumn("atom_name", atom)


def event_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as atoms: interleaved residues, repeated names, missing backbone atoms."""
    resid = (F.col("event_id") % 7).cast("int")
    # Fixed values of this view: residue names by number.
    names = F.array(*[F.lit(n) for n in ("ALA", "GLY", "HSE", "SER", "TRP", "VAL", "MSE")])
    return event_atoms_raw(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain_id"),
        F.col("frame").alias("atom_index"), "atom_name", F.lit("A").alias("chain"), resid.alias("resid"),
        F.get(names, resid).alias("resname"), F.substring("atom_name", 1, 1).alias("element"),
    )


ATOMS_SQL = EVENTS_SQL + """,
atoms AS (
  SELECT 'd' || user_id AS domain_id, frame AS atom_index,
         CASE event_type WHEN 'click' THEN 'N' WHEN 'view' THEN 'CA' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'CB' ELSE 'O' END
           AS atom_name,
         'A' AS chain, CAST(event_id % 7 AS INTEGER) AS resid,
         list_extract(['ALA', 'GLY', 'HSE', 'SER', 'TRP', 'VAL', 'MSE'], CAST(event_id % 7 AS INTEGER) + 1) AS resname
  FROM event_frames),
residues AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY domain_id ORDER BY first_atom) - 1 AS INTEGER) AS residue_index
  FROM (SELECT domain_id, chain, resid, resname, min(atom_index) AS first_atom, CAST(count(*) AS INTEGER) AS n_atoms,
               max(CASE WHEN atom_name = 'N' THEN atom_index END) AS n_index,
               max(CASE WHEN atom_name = 'CA' THEN atom_index END) AS ca_index,
               max(CASE WHEN atom_name = 'C' THEN atom_index END) AS c_index,
               max(CASE WHEN atom_name = 'CB' THEN atom_index END) AS cb_index
        FROM atoms GROUP BY ALL) g)
"""
