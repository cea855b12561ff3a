"""Token ids as ORC: integer run-length encoding, row indexes, and Bloom filters on the document id.

A store is a folder of ORC files in ascending order of the id. Stripes are read in parallel; a filter on the id skips
files and stripes by their statistics and row groups by the Bloom filter. Null texts are empty and hold the end id
only, rows with a null id come first, repeated rows are kept, an empty table gives an empty store, and other columns
of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltraj.llm.shared import WRITTEN, arrow_map, shared_folder, table, text_or_empty, written
from moltraj.llm.vocabulary import WordIds, vocabulary_text, worker_encoder

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
STRIPE_BYTES = 64 << 20


def id_lists(encoded: list[bytes]) -> pa.Array:
    """Little-endian ids of each row as one Arrow list array, without a Python object per id."""
    ends = np.cumsum([0, *[len(ids) // 4 for ids in encoded]]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def token_rows(docs: DataFrame, vocabulary: str, end_id: int, key: str, text: str) -> DataFrame:
    """`key` and `ids` (array of int) of every row, in the order of the rows."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    end = np.array([end_id], "<u4").tobytes()

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = worker_encoder(WordIds, sent.value).encode
        encoded = [encode(text) + end for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), id_lists(encoded)], names=[key, "ids"])

    return arrow_map(docs.select(F.col(key), text_or_empty(text).alias("_text")), convert, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>")


def write_token_store(
    docs: DataFrame, path: str, vocabulary: str = WORD_BPE, end_id: int = END_ID, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every text and write `shard`, `key` and `ids` under `path`; shards and the ids in them ascend.

    The texts are dealt by ranges of the id before they are encoded, so that they are encoded once.
    """
    ranges = docs.select(key, text).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first())
    rows = token_rows(ranges, vocabulary, end_id, key, text)
    (
        rows.select(F.spark_partition_id().alias("shard"), key, "ids").write
        .option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.compress", "ZSTD").orc(path)
    )


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store. Filters on the id reach the ORC reader."""
    return spark.read.orc(path)


def document_digests(store: DataFrame, key: str = "doc_id") -> DataFrame:
    """`shard`, `key`, n_tokens and ids_crc32 (of the little-endian ids) of every stored row."""

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype("i8")), pa.array(sums, pa.int64())],
            names=["shard", key, "n_tokens", "ids_crc32"],
        )

    return arrow_map(store.select("shard", key, "ids"), convert, f"shard int, `{key}` {dict(store.dtypes)[key]}, n_tokens long, ids_crc32 long")


def with_starts(digests: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add `start`, the ids of all rows before: the sum of the shards before, then the sum within the shard.

    One window row for each shard, and one window group for each shard, whose size the writer bounds.
    """
    totals = digests.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("shard").orderBy(F.col(key).asc_nulls_first(), "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    local = digests.withColumn("_local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    joined = local.join(totals.select("shard", before.alias("_before")), "shard")
    return joined.withColumn("start", F.col("_before") + F.col("_local")).drop("_before", "_local")


def op9_orc_token_store(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    write_token_store(table(spark, sf, "documents"), path)
    WRITTEN.append(path)
    # Starts need the digests twice; the store is read once.
    return with_starts(written(document_digests(read_token_store(spark, path)))).select("doc_id", "start", "n_tokens", "ids_crc32")
