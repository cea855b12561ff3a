"""Benchmark decontamination with a broadcast hash set of test windows.

Words are runs of ASCII digits, lower-cased ASCII letters and all other non-ASCII characters. Every window of WINDOW
consecutive words of an item is hashed; an item with fewer words is one window. The hash set is broadcast in blocks of
at most BLOCK_WORDS item words, so its size is bounded whatever the number of items: each block is one more scan of
the texts, and the scans are united per row. Documents look up the hashes of all their windows, and hits are verified
word by word.

Null texts have no words, rows with no words have no hits, items without words have no windows, repeated items and
repeated rows count one by one, empty tables give empty results or no hits. Null item ids are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import arrow_map, table, utf8, written

WINDOW = 13
BLOCK_WORDS = 200_000
SHARE = 20

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Upper to lower case, and a blank for every byte outside words.
WORD_BYTES = bytes(byte + 32 if 0x41 <= byte <= 0x5A else byte if byte in _KEPT else 0x20 for byte in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WindowSet:
    """The windows of one block of items: rolling hashes of word numbers, with the words and items behind them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, found in items:
            ids = [self.numbers.setdefault(word, len(self.numbers) + 1) for word in found]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1):
                self.items[tuple(ids[at : at + size])].add(item)
        self.hashes: dict[int, np.ndarray] = {}
        for size in sorted({len(ids) for ids in self.items}):
            rows = np.array([ids for ids in self.items if len(ids) == size], np.uint64)
            self.hashes[size] = np.unique(np.concatenate([rolled(row, size) for row in rows]))

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint ascending word spans (end exclusive) that windows cover, and the items of these windows."""
        number = self.numbers.get
        ids = np.array([number(word, 0) for word in found], np.uint64)
        spans, items = [], set()
        for size, known in self.hashes.items():
            if len(ids) < size:
                continue
            hashed = rolled(ids, size)
            near = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            for at in np.flatnonzero(known[near] == hashed).tolist():
                behind = self.items.get(tuple(ids[at : at + size].tolist()))
                if behind:
                    spans.append((at, at + size))
                    items |= behind
        return merged(spans), items


def rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash, modulo 2^64, of each run of `size` numbers."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for at in range(size):
        out = out * _ODD + ids[at : at + len(out)]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if done and a <= done[-1][1]:
            done[-1] = (done[-1][0], max(done[-1][1], b))
        else:
            done.append((a, b))
    return done


def blocks_of(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (id, words), at most about `most` words a block; one partition of the benchmark is held at a time."""
    block, held = [], 0
    rows = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), utf8(text).alias("text"))
    for row in rows.toLocalIterator():
        found = words(bytes(row["text"]))
        if found:
            if held and held + len(found) > most:
                yield block
                block, held = [], 0
            block.append((row["item"], found))
            held += len(found)
    yield block


class Hits:
    """Documents with three columns more, under names that they do not use: word count, spans, items."""

    def __init__(self, rows: DataFrame, n_words: str, spans: str, items: str):
        self.rows, self.n_words, self.spans, self.items = rows, n_words, spans, items

    def hit_words(self) -> Column:
        return F.aggregate(self.spans, F.lit(0).cast("long"), lambda done, span: done + span["b"] - span["a"])

    def contaminated(self) -> Column:
        return (self.hit_words() > 0) & (SHARE * self.hit_words() >= F.col(self.n_words))


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in [other.lower() for other in taken]:
        name += "_"
    return name


def window_hits(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, most: int = BLOCK_WORDS,
) -> Hits:
    """All rows and columns of `docs` with their words, disjoint ascending hit spans (end exclusive) and items hit.

    With several blocks, each scan adds to the spans of the one before, which is written in between so that a worker
    never holds more than one block.
    """
    names = docs.columns
    n_words, spans, items = (free_name(name, names) for name in ("n_words", "spans", "items"))
    added = {n_words: F.lit(0).cast("long"), spans: F.array().cast("array<struct<a:long,b:long>>"), items: F.array().cast("array<string>")}
    found = docs.withColumns(added)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in found.dtypes)
    span_type, place = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), names.index(text)

    def add(rows: DataFrame, block: list[tuple[str, list[bytes]]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(WindowSet(block, window))

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, all_spans, all_items = [], [], []
            before = zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist())
            for value, (old_spans, old_items) in zip(batch.column(place).cast(pa.binary()).to_pylist(), before):
                split = words(value or b"")
                covered, behind = sent.value.hits(split)
                covered = merged(covered + [(span["a"], span["b"]) for span in old_spans])
                counts.append(len(split)), all_spans.append([{"a": a, "b": b} for a, b in covered])
                all_items.append(sorted(behind.union(old_items)))
            columns = [pa.array(counts, pa.int64()), pa.array(all_spans, span_type), pa.array(all_items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, n_words, spans, items])

        return arrow_map(rows, convert, schema)

    for number, block in enumerate(blocks_of(benchmark, item, item_text, most)):
        found = add(written(found) if number else found, block)
    return Hits(found, n_words, spans, items)


def without_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose hit words are less than one in SHARE."""
    hits = window_hits(docs, benchmark, **options)
    return hits.rows.where(~hits.contaminated()).select(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All rows of `docs`, with the hit spans cut out of `text`, from the first to the last byte of their words."""
    hits = window_hits(docs, benchmark, text=text, **options)
    names = hits.rows.columns
    at, spans_at = names.index(text), names.index(hits.spans)

    def cut(value: str | None, spans: list[dict]) -> str | None:
        if not spans:
            return value
        raw = value.encode()
        places = [word.span() for word in WORD.finditer(raw)]
        for span in reversed(spans):
            raw = raw[: places[span["a"]][0]] + raw[places[span["b"] - 1][1] :]
        return raw.decode()

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = map(cut, batch.column(at).to_pylist(), batch.column(spans_at).to_pylist())
        return batch.set_column(at, batch.schema.field(at), pa.array(list(texts), batch.column(at).type))

    return arrow_map(hits.rows, convert, ", ".join(f"`{name}` {kind}" for name, kind in hits.rows.dtypes)).select(*docs.columns)


def op8_benchmark_windows(spark: SparkSession, sf: str) -> DataFrame:
    hits = window_hits(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return hits.rows.select(
        "doc_id", hits.n_words, hits.hit_words().alias("n_hit"), F.size(hits.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits.items, ","), 256).alias("items_sha256"), hits.contaminated().alias("contaminated"),
    )


def sql_words(column: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"regexp_extract_all(translate(coalesce({column}, ''), {letters}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {sql_words("text")} AS w FROM documents),
b AS (SELECT item_id, {sql_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
placed AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS j FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, list_slice(w, j, j + k - 1) AS g FROM placed),
sizes AS (SELECT DISTINCT k FROM windows),
slid AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, sizes WHERE len(w) >= k),
found AS (
    SELECT slid.doc_id, slid.j, slid.k, windows.item_id
    FROM slid JOIN windows ON slid.k = windows.k AND list_slice(slid.w, slid.j, slid.j + slid.k - 1) = windows.g
),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM found) GROUP BY doc_id),
behind AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AND {SHARE} * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN behind USING (doc_id)
"""
