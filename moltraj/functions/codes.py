"""Text and code columns: decoding, residue types, secondary structure, trajectory names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moltraj.schema import DSSP_CODES, RESIDUE_CODES

BLANKS = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def decode_text(raw: Column) -> Column:
    """Bytes or text to stripped text; bytes that are not UTF-8 become U+FFFD."""
    return strip(F.make_valid_utf8(raw.cast("string")))


def _code(table: dict[str, int], key: Column) -> Column:
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(0))


def residue_code(resname: Column) -> Column:
    return _code(RESIDUE_CODES, resname)


def dssp_code(label: Column) -> Column:
    """First character of the stripped label; blank counts as coil."""
    return _code(DSSP_CODES, F.substring(strip(label), 1, 1))


def trajectory_id(domain: Column, temperature: Column, replicate: Column) -> Column:
    return F.concat_ws("_", domain, temperature.cast("string"), replicate.cast("string"))
