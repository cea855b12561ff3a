"""Packing by minimum bin slack.

Texts are cut into full windows and one remainder each. Only the number of remainders of each length (at most as many
numbers as a window has tokens) goes to the driver. There the largest remaining length opens a window, and a bitset
over the reachable sums picks the multiset of remaining lengths that fills it closest to capacity; backtracking gives
the counts, and the multiset is used as often as the counts allow, so each step uses up a length. The pieces then find
their place by their rank among those of their length, which is counted in blocks, never in one task.

Null texts are empty: one piece with the end id. Repeated rows are packed one by one, an empty table gives an empty
result. Other columns of the input are not read. Pieces of equal length are interchangeable and ordered by a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import arrow_map, table, text_or_empty, written
from moltraj.llm.token_counts import BYTE_BPE
from moltraj.llm.vocabulary import ByteLevelIds, vocabulary_text, worker_encoder
from moltraj.scale import ranked

CAPACITY = 1024
END_ID = 0
BLOCKS = 1024


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = BYTE_BPE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`key`, start, length, doc_tokens and `ids` (little-endian unsigned 32-bit integers) of every piece."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = worker_encoder(ByteLevelIds, sent.value).encode
        rows, starts, lengths, totals, ids = [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            encoded = encode(text) + end
            for at in range(0, len(encoded), width):
                part = encoded[at : at + width]
                rows.append(row), starts.append(at // 4), lengths.append(len(part) // 4), totals.append(len(encoded) // 4), ids.append(part)
        keys = batch.column(0).take(pa.array(rows, pa.int64()))
        counts = [pa.array(x, pa.int64()) for x in (starts, lengths, totals)]
        return pa.RecordBatch.from_arrays([keys, *counts, pa.array(ids, pa.binary())], names=[key, "start", "length", "doc_tokens", "ids"])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, start long, length long, doc_tokens long, ids binary"
    return arrow_map(docs.select(F.col(key), text_or_empty(text).alias("_text")), convert, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to `room`, by a bitset over sums and backtracking."""
    reach, steps, all_sums = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            taken = min(group, left)
            steps.append((length, taken, reach))
            reach |= reach << (length * taken) & all_sums
            left, group = left - taken, group * 2
    best, chosen = reach.bit_length() - 1, {}
    for length, taken, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + taken
            best -= length * taken
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Multisets of lengths and how many windows use each, together exactly `counts`."""
    left, plan = {length: n for length, n in counts.items() if n}, []
    while left:
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        window = fill(rest, capacity - largest)
        window[largest] = window.get(largest, 0) + 1
        times = min(left[length] // n for length, n in window.items())
        plan.append((window, times))
        for length, n in window.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, pieces a window, first window, first offset) for each length of each multiset."""
    rows, ranks, first = [], {}, 0
    for window, times in plan:
        offset = 0
        for length in sorted(window, reverse=True):
            n, rank = window[length], ranks.get(length, 0)
            rows.append((length, rank, rank + n * times, n, first, offset))
            ranks[length], offset = rank + n * times, offset + n * length
        first += times
    return rows


def packed(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces with `key`, start and length; other columns pass through.

    The pieces are read twice, so hand over a written table. The table of places has a few rows for each length.
    """
    spark = cut.sparkSession
    counts = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    rows = places(minimum_bin_slack(counts, capacity))
    found = spark.createDataFrame(rows, "length long, _low long, _high long, _each long, _first long, _at long")
    block = F.pmod(F.xxhash64(F.col(key), F.col("start")), F.lit(BLOCKS))
    numbered = ranked(cut.withColumn("_hash", block), ["length"], F.col("_hash"), ["_hash", key, "start"], "_rank").drop("_hash")
    inside = (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")) & (numbered["length"] == found["length"])
    joined = numbered.join(F.broadcast(found), inside).drop(found["length"])
    step = F.col("_rank") - F.col("_low")
    return (
        joined.withColumn("sequence_id", F.col("_first") + F.floor(step / F.col("_each")))
        .withColumn("offset", F.col("_at") + F.pmod(step, F.col("_each")) * F.col("length"))
        .drop("_rank", "_low", "_high", "_each", "_first", "_at")
    )


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and the ids of every sequence, from packed pieces that carry `ids`. A group holds one window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.concat(F.lit(b""), F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))).alias("ids"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Every piece with its place, and a checksum instead of its ids. The cut pieces are written once, without ids."""
    cut = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(written(cut)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_minimum_bin_slack(spark: SparkSession, sf: str) -> DataFrame:
    return packed_digests(table(spark, sf, "documents"))
