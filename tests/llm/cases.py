"""Small tables that hold the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import re

ODD_TEXTS = [
    None, "", " ", "\n\n", "one", "one two", "  lead and trail  ", "a\tb\x0bc\x0cd\re", "x " * 3000, "é" * 5000, "中文 テキスト 😀 ok",
    "it's <|endoftext|> here<|startoftext|>", "tab\x1cseparated\x1ftext", "nb\xa0sp \xa0   wide　", "UPPER CASE!! LOUD!!",
]
BODY = (
    "The quick brown fox jumps over the lazy dog near the river bank while seven small boats drift slowly towards the old stone bridge"
)


def variant(number: int) -> str:
    words = BODY.split()
    words[number % len(words)] = f"changed{number}"
    return " ".join(words)


def document_rows():
    texts = list(ODD_TEXTS) + [BODY, BODY, BODY.upper(), BODY + "\n" + BODY] + [variant(i) + "\n" + BODY + "\nshort" for i in range(6)]
    rows = [(i, text, "en", f"s{i % 2}", None if text is None else len(text)) for i, text in enumerate(texts)]
    return rows + [rows[16], rows[3], (None, BODY, None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their own columns.
CLASHES = ["n_words", "spans", "items", "counts", "bits", "path", "key", "length", "start", "shard", "node", "root", "mask", "score", "ids", "_row", "_line"]


def documents(spark, clashing=False):
    df = spark.createDataFrame(document_rows(), SCHEMA).repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit(f"own {name}") for name in CLASHES})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
