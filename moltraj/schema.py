"""Table layouts and the fixed code tables of the trajectory data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Residue-type codes (0 = any other residue name).
RESIDUE_CODES = {
    "ALA": 1, "ARG": 2, "ASN": 3, "ASP": 4, "CYS": 5, "GLN": 6, "GLU": 7, "GLY": 8, "HIS": 9, "ILE": 10,
    "LEU": 11, "LYS": 12, "MET": 13, "PHE": 14, "PRO": 15, "SER": 16, "THR": 17, "TRP": 18, "TYR": 19, "VAL": 20,
}

# Secondary-structure codes (0 = coil, blank, dash and any other label).
DSSP_CODES = {"H": 1, "B": 2, "E": 3, "G": 4, "I": 5, "T": 6, "S": 7}

# Virtual C-beta weights of (b x c), b and c, where b = CA - N and c = C - CA.
VIRTUAL_CB = (-0.58273431, 0.56802827, -0.54067466)

# The temperature whose frames are filtered, and the RMSD bound in Angstrom.
UNFOLDING_TEMPERATURE = 450
FOLDED_RMSD_ANGSTROM = 4.0

# Frame and residue multiples of the padded grid.
FRAME_MULTIPLE = 256
RESIDUE_MULTIPLE = 512

POINT = T.StructType([T.StructField(axis, T.FloatType()) for axis in "xyz"])

DOMAINS = T.StructType([
    T.StructField("domain_id", T.StringType()),
    T.StructField("num_residues", T.IntegerType()),
    T.StructField("num_atoms", T.IntegerType()),
    T.StructField("pdb_text", T.StringType()),
])

ATOMS = T.StructType([
    T.StructField("domain_id", T.StringType()),
    T.StructField("atom_index", T.IntegerType()),
    T.StructField("atom_name", T.StringType()),
    T.StructField("chain", T.StringType()),
    T.StructField("resid", T.IntegerType()),
    T.StructField("resname", T.StringType()),
    T.StructField("element", T.StringType()),
])

TRAJECTORIES = T.StructType([
    T.StructField("domain_id", T.StringType()),
    T.StructField("temperature", T.StringType()),
    T.StructField("replicate", T.IntegerType()),
    T.StructField("num_frames", T.IntegerType()),
    T.StructField("rmsd_unit", T.StringType()),
    T.StructField("has_rmsd", T.BooleanType()),
])

FRAMES = T.StructType([
    T.StructField("domain_id", T.StringType()),
    T.StructField("temperature", T.StringType()),
    T.StructField("replicate", T.IntegerType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("rmsd", T.FloatType()),
    T.StructField("dssp", T.ArrayType(T.StringType())),
    T.StructField("xyz", T.ArrayType(POINT)),
])

FRAME_WINDOWS = T.StructType([
    T.StructField("trajectory_id", T.StringType()),
    T.StructField("start_frame", T.LongType()),
    T.StructField("frame_count", T.IntegerType()),
    T.StructField("payload_uri", T.StringType()),
])

RUN_EVENTS = T.StructType([
    T.StructField("trajectory_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("ns", T.DoubleType()),
    T.StructField("priority", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])

TRAJECTORY_KEY = ["domain_id", "temperature", "replicate"]
FRAME_KEY = [*TRAJECTORY_KEY, "frame"]
