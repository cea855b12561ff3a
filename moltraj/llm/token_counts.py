"""Token counts by a whole-token shortcut.

Offline, every vocabulary string is run through the merges once; those that come out as one token are proven whole.
A pre-token found among them counts as one without any merging, and only the rest is merged. Nulls count as empty
texts, empty texts have no tokens, repeated rows are counted one by one, an empty table gives an empty result, and
other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import arrow_map, table, text_or_empty
from moltraj.llm.vocabulary import (
    BEYOND_LATIN, SEPARATORS, SPACED_CHUNK, Cache, blank_cuts, byte_alphabet, loaded, plain_word, vocabulary_text,
    worker_encoder,
)

BYTE_BPE = "byte_bpe_50k.json"
LIMIT = 1024
PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)


def whole_tokens(definition: str) -> frozenset[str]:
    """The vocabulary strings that the merges turn into exactly one token, in the byte alphabet of the pre-tokens."""
    tokenizer = loaded(definition)
    merged = tokenizer.model.tokenize
    return frozenset(string for string in tokenizer.get_vocab(with_added_tokens=False) if len(merged(string)) == 1)


class ChunkCounts(Cache):
    """chunk -> its number of tokens, with chunks as in `ByteLevelIds`."""

    def __init__(self, definition: str, whole: frozenset[str]):
        super().__init__()
        self.tokenizer = loaded(definition)
        self.model = self.tokenizer.model
        self.whole = whole
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = {chr(byte): character for byte, character in byte_alphabet().items()}

    def compute(self, chunk: str) -> int:
        return self.exact(chunk if chunk[:1] == "\n" else " " + chunk)

    def exact(self, chunk: str) -> int:
        return self.without_special(chunk, self.special)

    def without_special(self, piece: str, special: list[str]) -> int:
        if not special:
            return self.plain(piece)
        parts = piece.split(special[0])
        return len(parts) - 1 + sum(self.without_special(part, special[1:]) for part in parts)

    def pre_tokens(self, piece: str) -> list[str]:
        if BEYOND_LATIN.search(piece) or SEPARATORS.search(piece):
            return [pre for pre, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)] if piece else []
        shown = self.alphabet
        return ["".join([shown[c] for c in pre.encode().decode("latin-1")]) for pre in PRE_TOKEN.findall(piece)]

    def plain(self, piece: str) -> int:
        count = 0
        for pre in self.pre_tokens(piece):
            count += 1 if pre in self.whole else len(self.model.tokenize(pre))
        return count

    def count(self, text: str) -> int:
        chunks = blank_cuts(text)
        if chunks is None:
            chunks = [text] if SEPARATORS.search(text) else SPACED_CHUNK.findall(text)
            return sum([self[c[1:]] if plain_word(c) else self.exact(c) for c in chunks])
        return self.exact(chunks[0]) + sum(map(self.__getitem__, chunks[1:]))


def token_counts(docs: DataFrame, vocabulary: str = BYTE_BPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_bytes and n_tokens of every row. The vocabulary and the proven set (at most its size) are broadcast."""
    definition = vocabulary_text(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))
    kind = dict(docs.dtypes)[key]

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = worker_encoder(ChunkCounts, *sent.value).count
        found = [count(text) for text in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    source = docs.select(F.col(key), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), text_or_empty(text).alias("_text"))
    return arrow_map(source, convert, f"`{key}` {kind}, n_bytes long, n_tokens long")


def op2_whole_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
