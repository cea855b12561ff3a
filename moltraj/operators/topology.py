"""Residue topology from atom tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltraj.functions.codes import residue_code, strip
from moltraj.scale import lookup_join

RESIDUE_KEY = ["domain_id", "chain", "resid", "resname"]
BACKBONE = {"n_index": "N", "ca_index": "CA", "c_index": "C", "cb_index": "CB"}


def clean_atoms(atoms: DataFrame) -> DataFrame:
    names = ("atom_name", "chain", "resname", "element")
    return atoms.withColumns({name: strip(F.col(name)) for name in names if name in atoms.columns})


def residues(atoms: DataFrame) -> DataFrame:
    """One row per residue: ordinal by first appearance, backbone atom indices (last duplicate wins), type code.

    All columns come from one aggregate with map-side combine; the ordinal window then sees one row per residue.
    Atom membership stays in long form (`residue_atoms`).
    """
    picks = [F.max(F.when(F.col("atom_name") == name, F.col("atom_index"))).alias(out) for out, name in BACKBONE.items()]
    grouped = atoms.groupBy(*RESIDUE_KEY).agg(
        F.min("atom_index").alias("first_atom"), F.count(F.lit(1)).cast("int").alias("n_atoms"), *picks
    )
    order = Window.partitionBy("domain_id").orderBy("first_atom")
    return grouped.withColumns({
        "residue_index": (F.row_number().over(order) - 1).cast("int"),
        "residue_type": residue_code(F.col("resname")),
    })


def residue_atoms(atoms: DataFrame, residue_table: DataFrame) -> DataFrame:
    """Every atom with the ordinal and name of its residue; an atom without a residue is named UNK."""
    names = residue_table.select(*RESIDUE_KEY, "residue_index")
    paired = lookup_join(atoms, names, RESIDUE_KEY, "left", salt_by=["atom_index"])
    resname = F.when(F.col("residue_index").isNull(), F.lit("UNK")).otherwise(F.col("resname"))
    return paired.select("domain_id", "residue_index", "atom_index", resname.alias("resname"), "atom_name")


def missing_ca(residue_table: DataFrame) -> DataFrame:
    return residue_table.filter(F.col("ca_index").isNull()).select("domain_id", "residue_index", "resname")


def require_ca(residue_table: DataFrame) -> None:
    bad = missing_ca(residue_table).orderBy("domain_id", "residue_index").limit(10).collect()
    if bad:
        raise ValueError(f"residues without a C-alpha atom: {[(row.domain_id, row.residue_index) for row in bad]}")


def atom_count_mismatch(named: DataFrame, atoms: DataFrame) -> DataFrame:
    """Domains whose structure text lists another number of atoms than the atom table."""
    listed = named.groupBy("domain_id").agg(F.count(F.lit(1)).alias("listed_atoms"))
    stored = atoms.groupBy("domain_id").agg(F.count(F.lit(1)).alias("stored_atoms"))
    both = listed.join(stored, "domain_id", "full").na.fill(0, ["listed_atoms", "stored_atoms"])
    return both.filter(F.col("listed_atoms") != F.col("stored_atoms"))


def residue_sites(residue_table: DataFrame, *, break_on_chain: bool = False) -> DataFrame:
    """One row per domain with its residues as an array that already knows each residue's neighbours.

    The array is no larger than a single frame row of the same domain, which holds a point per atom. Neighbour atoms
    are looked up here, once per domain, so that torsions need no window over frames.
    """
    order = Window.partitionBy("domain_id").orderBy("residue_index")

    def beside(shift, column):
        value = shift(column, 1).over(order)
        if break_on_chain:
            return F.when(shift("chain", 1).over(order) == F.col("chain"), value)
        return value

    linked = residue_table.withColumns({
        "c_before": beside(F.lag, "c_index"),
        "n_after": beside(F.lead, "n_index"),
        "ca_after": beside(F.lead, "ca_index"),
    })
    site = F.struct(
        "residue_index", "residue_type", "n_index", "ca_index", "c_index", "cb_index", "c_before", "n_after", "ca_after"
    )
    return linked.groupBy("domain_id").agg(F.array_sort(F.collect_list(site)).alias("sites"))
