"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit positions get the non-zero vectors of {0,1}^(radius+1) in turn. For each non-zero vector v, a mask keeps the
positions whose vector has an odd product with v. Any `radius` differing positions have a common orthogonal v, so that
two fingerprints within the radius agree under its mask: no pair is missed, whatever the data.

Equal fingerprints are one node from the start. In each table, groups of two are compared by expressions, groups up to
GROUP as one array, and larger ones are covered again over the positions their mask leaves out. The last level is that
whose masks leave at most FREE positions, so that none of its groups can hold more than 2^FREE fingerprints, whatever
GROUP and the radius are. Groups give a spanning forest of their links, not all pairs.

Texts without words have fingerprint zero; null texts are empty; repeated rows share a class; rows with a null id get
the class of their fingerprint (null if no row of it has an id). An empty table gives an empty result. Other columns
of the input are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.components import components
from moltraj.llm.shared import arrow_map, table, utf8, written

RADIUS = 3
SHINGLE = 3
SEED = 42
GROUP = 1024
#: Free positions of the last level.
FREE = 10
CHUNK = 65_536


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, size: at + 1 + size))
    starts = [0, *[end + 1 for end in ends[:-1]]]
    spans = zip(starts, ends[width - 1 :]) if len(words) >= width else [(0, len(joined))]
    spans, digest, total, votes = iter(spans), xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    while hashes := [digest(joined[a:b], SEED) for a, b in itertools.islice(spans, CHUNK)]:
        total += len(hashes)
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """`key` and `bits` (signed 64-bit fingerprint) of every row."""

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(value, width) for value in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[key, "bits"])

    return arrow_map(docs.select(F.col(key), utf8(text).alias("_text")), convert, f"`{key}` {dict(docs.dtypes)[key]}, bits long")


def covering(positions: list[int], radius: int) -> list[int]:
    """A mask over `positions` for each non-zero vector of radius + 1 bits."""
    size = 1 << (radius + 1)
    return [
        sum(1 << at for i, at in enumerate(positions) if ((1 + i % (size - 1)) & v).bit_count() & 1)
        for v in range(1, size)
    ]


def refined(masks: list[int], radius: int) -> list[int]:
    """For each mask, the masks that also keep a cover of the positions it leaves out; all in one list."""
    return [mask | more for mask in masks for more in covering([i for i in range(64) if not mask >> i & 1], radius)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius of one another, one for each node but the first of a component."""
    left, links = np.array(values, "<i8").view("<u8"), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            near = np.bitwise_count(left ^ node) <= radius
            if near.any():
                links += [(int(node.view("<i8")), int(x)) for x in left[near].view("<i8")]
                front += list(left[near])
                left = left[~near]
    return links


def group_links(groups: DataFrame, radius: int) -> DataFrame:
    """Links a, b of the arrays in column `members`."""

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        links = [link for members in batch.column(0).to_pylist() for link in forest(members, radius)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return arrow_map(groups.select("members"), convert, "a long, b long")


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b between distinct fingerprints (column `bits`) that connect all those within the radius."""
    found, masks = [], covering(list(range(64)), radius)
    branch, level = len(masks), nodes.select("bits", F.lit(0).cast("long").alias("path"))
    while True:
        last = all(64 - mask.bit_count() <= FREE for mask in masks)
        table_masks = F.array(*[F.lit(signed(mask)) for mask in masks])
        chosen = F.slice(table_masks, (F.col("path") * branch + 1).cast("int"), F.lit(branch))
        keyed = (
            level.select("bits", "path", F.posexplode(chosen).alias("at", "mask"))
            .select("bits", (F.col("path") * branch + F.col("at")).alias("path"), F.col("bits").bitwiseAND(F.col("mask")).alias("key"))
        )
        groups = keyed.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b"))
        groups = written(groups.where("n > 1"))
        found.append(groups.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b"))
        whole = groups.where((F.col("n") > 2) & (F.lit(last) | (F.col("n") <= GROUP)))
        members = keyed.join(whole.select("path", "key"), ["path", "key"])
        found.append(group_links(members.groupBy("path", "key").agg(F.collect_list("bits").alias("members")), radius))
        hot = groups.where(F.col("n") > GROUP)
        if last or hot.isEmpty():
            break
        level = written(keyed.join(hot.select("path", "key"), ["path", "key"]).select("bits", "path"))
        masks = refined(masks, radius)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def roots_of(nodes: DataFrame, radius: int) -> DataFrame:
    """`nodes` (one row for each fingerprint `bits`) with `_root`, the same for all fingerprints in reach."""
    roots = components(near_links(nodes, radius))
    return nodes.join(roots, nodes["bits"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "bits")).drop("node", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """`key`, fingerprint (16 hexadecimal digits) and component_id (the smallest key in reach) of every row."""
    marked = written(fingerprints(docs, key, text, width))
    classed = roots_of(written(marked.groupBy("bits").agg(F.min(key).alias("_first"))), radius)
    smallest = classed.groupBy("_root").agg(F.min("_first").alias("component_id"))
    classes = classed.join(smallest, "_root").select("bits", "component_id")
    return marked.join(classes, "bits").select(key, hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """`docs` with one row of each group in reach: that with the smallest key, null last; of repeated rows, any.

    Rows are told apart by a number that is written with them, so repeated rows and null keys need no special care.
    """

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: fingerprint(bytes(value), width)).astype("int64")

    rows = written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row"), bits(utf8(text)).alias("bits")))
    order = F.struct(F.col(f"_doc.{key}").isNull().alias("none"), F.col(f"_doc.{key}").alias("key"), "_row")
    classed = roots_of(written(rows.groupBy("bits").agg(F.min(order).alias("_first"))), radius)
    kept = classed.groupBy("_root").agg(F.min("_first").alias("_first")).select(F.col("_first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*")


def op5_covering_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))
