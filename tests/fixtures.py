"""A three-residue protein with two trajectories of three frames, each frame shifted by 0.1."""

from __future__ import annotations

import numpy as np

from moltraj import schema
from moltraj.plans.jobs import Landed

DOMAIN = "12asA00"
# Atom name, residue number and position of the twelve atoms of the fixture.
ATOMS = [
    ("N", 1, "ALA", (0.0, 0.0, 0.0)), ("CA", 1, "ALA", (1.0, 0.0, 0.0)), ("C", 1, "ALA", (1.0, 1.0, 0.0)), ("CB", 1, "ALA", (1.0, 0.0, 1.0)),
    ("N", 2, "GLY", (2.0, 1.0, 0.0)), ("CA", 2, "GLY", (2.0, 2.0, 0.0)), ("C", 2, "GLY", (3.0, 2.0, 0.0)),
    ("N", 3, "SER", (3.0, 3.0, 0.0)), ("CA", 3, "SER", (4.0, 3.0, 0.0)), ("C", 3, "SER", (4.0, 4.0, 0.0)), ("CB", 3, "SER", (4.0, 3.0, 1.0)),
    ("OG", 3, "SER", (4.0, 3.0, 2.0)),
]


def pdb_text(atoms=ATOMS) -> str:
    return "\n".join(
        f"ATOM  {i + 1:5d} {name:^4s} {resname:3s} A{resid:4d}    {x:8.3f}{y:8.3f}{z:8.3f}"
        for i, (name, resid, resname, (x, y, z)) in enumerate(atoms)
    )


def landed(spark, rmsd=(0.1, 0.2, 0.3), n_frames=3) -> Landed:
    atoms = [(DOMAIN, i, name, "A", resid, resname, name[0]) for i, (name, resid, resname, _) in enumerate(ATOMS)]
    base = np.array([at for *_, at in ATOMS], dtype=np.float32)
    frames = []
    for temperature in ("320", "450"):
        for frame in range(n_frames):
            points = [tuple(float(v) for v in p) for p in base + np.float32(0.1 * frame)]
            frames.append((DOMAIN, temperature, 0, frame, float(rmsd[frame % len(rmsd)]), ["H", "E", "C"], points))
    trajectories = [(DOMAIN, t, 0, n_frames, "nm", True) for t in ("320", "450")]
    return Landed(
        spark.createDataFrame([(DOMAIN, 3, len(ATOMS), pdb_text())], schema.DOMAINS),
        spark.createDataFrame(atoms, schema.ATOMS),
        spark.createDataFrame(trajectories, schema.TRAJECTORIES),
        spark.createDataFrame(frames, schema.FRAMES),
    )
