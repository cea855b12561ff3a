"""Quality rules: likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Unigrams and bigrams of words are hashed into BUCKETS. Two multinomials are counted over all rows: the target's (rows
whose id is trusted) and the raw corpus's (every row). A row's score is the mean over its n-grams of
log(target / raw), with add-one smoothing; a row is kept if it passes the base rules and its score reaches THRESHOLD.
Everything is built from DataFrame expressions. The ratios are one array of BUCKETS numbers, read as a scalar subquery.

Null and empty texts have no words, a null score, and fail the base rules. Repeated rows are judged alike, rows with a
null id are never trusted, an empty table gives an empty result, and other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import table, text_or_empty
from moltraj.scale import fits

BUCKETS = 1 << 14
THRESHOLD = -0.1
#: Trusted ids up to this number are broadcast; beyond, texts and ids are shuffled.
BROADCAST_IDS = 500_000
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEATED_PERCENT = 50
WINDOW = 3


def without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARACTERS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARACTERS)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `_text` and `_words`. Later expressions use the words many times, so Spark computes them once."""
    return docs.select(F.col(key), text_or_empty(text).alias("_text")).withColumn("_words", split_words(F.col("_text")))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in windows that occur twice or more.

    A window's hash and place share one 64-bit number: sorted, equal windows are neighbours. Places take only as many
    bits as the text needs, and neighbours are compared word by word, so that a shortened hash cannot mislead.
    """
    size, last = F.size("_words"), F.size("_words") - WINDOW
    words = F.col("_words")
    bits = F.ceil(F.log2(F.greatest(size, F.lit(2)) + 1)).cast("int")
    rows = rows.withColumn("_bits", bits)
    rows = rows.withColumn(
        "_sorted",
        F.when(last >= 1, F.sort_array(F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.call_function("shiftleft", F.xxhash64(words[i], words[i + 1], words[i + 2]), F.col("_bits")).bitwiseOR(i.cast("long")),
        ))).otherwise(F.array().cast("array<bigint>")),
    )
    packed, bits = F.col("_sorted"), F.col("_bits")
    high = lambda x: F.call_function("shiftrightunsigned", x, bits)
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    def same(x: Column, y: Column) -> Column:
        a, b = place(x), place(y)
        alike = [words[a + k] == words[b + k] for k in range(WINDOW)]
        return (high(x) == high(y)) & alike[0] & alike[1] & alike[2]

    rows = rows.withColumn("_again", F.filter(
        packed, lambda x, k: ((k > 0) & same(x, packed[F.greatest(k - 1, F.lit(0))]))
        | ((k < F.size(packed) - 1) & same(x, packed[F.least(k + 1, F.size(packed) - 1)])),
    ))
    places = F.sort_array(F.transform("_again", place))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda done, at: F.struct(at.alias("at"), (done["n"] + F.least(F.lit(WINDOW), at - done["at"])).alias("n")),
        lambda done: done["n"],
    )
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("_sorted", "_again", "_bits")


def hashed_grams(words: Column, buckets: int) -> Column:
    """The bucket of every unigram and bigram."""
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    single = F.transform(words, lambda w: bucket(w))
    pairs = F.transform(words, lambda w, i: bucket(w, F.when(i > 0, words[F.greatest(i - 1, F.lit(0))]).otherwise(F.lit(""))))
    return F.concat(single, pairs)


def log_ratios(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row with `ratios`, an array of log(target / raw) by bucket. `trusted` has a column `key`."""
    ids = trusted.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_trusted", F.lit(1))
    small = fits(ids, BROADCAST_IDS)
    rows = docs.select(key, text).join(F.broadcast(ids) if small else ids, key, "left")
    split = rows.select("_trusted", split_words(text_or_empty(text)).alias("_words"))
    grams = split.select("_trusted", F.explode(hashed_grams(F.col("_words"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(counts, "bucket", "left").select("bucket", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("raw", "target")])
    whole = dense.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"),
        (F.sum("raw") + buckets).alias("all_raw"), (F.sum("target") + buckets).alias("all_target"),
    )
    ratio = lambda c: F.log((c["target"] + 1) / F.col("all_target")) - F.log((c["raw"] + 1) / F.col("all_raw"))
    return whole.select(F.transform("cells", ratio).alias("ratios"))


def quality(
    docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD
) -> DataFrame:
    """Counts, base_failed, score and kept of every row."""
    scored = with_words(docs, key, text).withColumn("_ratios", log_ratios(docs, trusted, key=key, text=text, buckets=buckets).scalar())
    scored = scored.withColumn("_grams", hashed_grams(F.col("_words"), buckets))
    score = F.aggregate("_grams", F.lit(0.0), lambda done, at: done + F.col("_ratios")[at]) / F.size("_grams")
    scored = scored.withColumn("score", F.when(F.size("_grams") > 0, score)).drop("_grams", "_ratios")
    bare = F.octet_length("_text")
    scored = with_repeats(scored).select(
        key, F.size("_words").cast("long").alias("n_words"),
        F.length(without(F.col("_text"), SPACE_CHARACTERS)).cast("long").alias("word_chars"),
        (bare - F.octet_length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"), "n_repeat_words", "score",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= threshold))


def op1_likelihood_ratio(spark: SparkSession, sf: str) -> DataFrame:
    trusted = table(spark, sf, "labels").where("quality = 1")
    return quality(table(spark, sf, "documents"), trusted)
