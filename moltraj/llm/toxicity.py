"""Toxicity by weak supervision.

Voters are words of a lexicon, word stems and text patterns; each says "toxic" or abstains. Stems are mined from a
bounded sample of labelled rows, so that insults outside the lexicon's language are found. A generative model estimates
from the votes of all rows how often each voter votes on toxic and on other texts (expectation and maximisation over
the counts of vote patterns, started from the sample), and the correlations of voters given the class, by which it
discounts those that say the same thing twice. A logistic regression on the voters' counts is then trained on the
posterior labels of a bounded sample and scores every row.

Labels are read only from rows whose crc32(id as text) mod FOLDS is not 0; labels, language, source and id are no
inputs of a score. Null texts are empty; a text without votes gets the score of the intercept. Repeated rows get equal
scores, rows with a null id are not held out, and without labels only the lexicon and patterns vote. Empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import arrow_map, table, text_or_empty, written
from moltraj.llm.vocabulary import Cache

FOLDS = 5
#: Labelled rows used to mine stems, and rows with posterior labels used to fit the classifier.
LABELLED_ROWS = 20_000
FITTED_ROWS = 20_000
STEM_CHARS = range(3, 10)
LEAST_SUPPORT = 3
LEAST_PRECISION = 0.8
PRIOR = 0.1
ROUNDS = 12
CORRELATED = 0.5
RIDGE = 1.0

#: Insults that vote by themselves.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile",
    "retard", "bastard", "jerk", "filth", "vermin", "garbage", "coward", "liar", "parasite", "degenerate", "freak", "creep",
)
PATTERNS = ("shouting", "exclaiming")
WORD = re.compile(r"[^\W\d_]+")


def voters(stems: list[str]) -> list[str]:
    """The names of all voters, in the order of their bits."""
    return [*LEXICON, *[f"{stem}*" for stem in stems], *PATTERNS]


class WordVotes(Cache):
    """word -> the voter that it counts for, or None."""

    def __init__(self, stems: list[str]):
        super().__init__()
        self.words = {word: at for at, word in enumerate(LEXICON)}
        self.stems = {stem: len(LEXICON) + at for at, stem in enumerate(stems)}

    def compute(self, word: str) -> int | None:
        if word in self.words:
            return self.words[word]
        return next((self.stems[word[:n]] for n in STEM_CHARS if word[:n] in self.stems), None)

    def count(self, text: str, width: int) -> list[int]:
        counts = [0] * width
        found = WORD.findall(text.lower())
        for at in map(self.__getitem__, found):
            if at is not None:
                counts[at] += 1
        letters = sum(map(len, found))
        shouting = text.isupper() and letters > 20
        counts[-2] = int(shouting)
        counts[-1] = text.count("!!") if letters else 0
        return counts


def fold(key: str) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(FOLDS))


def learnable(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Labelled rows that may be learned from: `key` and `_label`, at most LABELLED_ROWS, by the order of a hash."""
    rows = labels.where((fold(key) != 0) & F.col(label).isNotNull()).select(F.col(key), F.col(label).cast("int").alias("_label"))
    return rows.orderBy(F.xxhash64(key), key, "_label").limit(LABELLED_ROWS)


def stem_counts(docs: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """stem, toxic, other: in how many sampled texts of either label a stem occurs, aggregated per batch first."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for value, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(WORD.findall(value.lower()))
                (toxic if label else other).update({word[:n] for word in found for n in STEM_CHARS if len(word) >= n})
            stems = list(toxic.keys() | other.keys())
            columns = [pa.array(stems, pa.string()), *[pa.array([c[s] for s in stems], pa.int64()) for c in (toxic, other)]]
            yield pa.RecordBatch.from_arrays(columns, names=["stem", "toxic", "other"])

    picked = docs.join(F.broadcast(sample), key).select(text_or_empty(text).alias("_text"), "_label")
    rows = picked.mapInArrow(convert, "stem string, toxic long, other long")
    return rows.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def mined_stems(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> list[str]:
    """All stems that nearly always mean a toxic label, none the start of another."""
    precise = F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("other") + 1)
    rows = stem_counts(docs, sample, key, text).where((F.col("toxic") >= LEAST_SUPPORT) & precise)
    best = rows.orderBy(F.desc("toxic"), F.desc(F.length("stem")), "stem").select("stem").collect()
    chosen: list[str] = []
    taken, starts = set(LEXICON), {word[:n] for word in LEXICON for n in range(len(word) + 1)}
    for row in best:
        stem = row["stem"]
        if stem not in starts and not any(stem[:n] in taken for n in range(len(stem) + 1)):
            chosen.append(stem)
            taken.add(stem)
            starts |= {stem[:n] for n in range(len(stem) + 1)}
    return chosen


def votes(docs: DataFrame, stems: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `counts` (of each voter) and `mask` (the numbers of the voters that vote) of every row."""
    width = len(voters(stems))
    tables: list[WordVotes] = []

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:
            tables.append(WordVotes(stems))
        counts = [tables[0].count(value, width) for value in batch.column(1).to_pylist()]
        masks = [[at for at, n in enumerate(row) if n] for row in counts]
        columns = [batch.column(0), pa.array(counts, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=[key, "counts", "mask"])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, counts array<int>, mask array<int>"
    return arrow_map(docs.select(F.col(key), text_or_empty(text).alias("_text")), convert, schema)


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def posterior(prior: float, weights: np.ndarray) -> Column:
    """Probability of "toxic" given the votes; abstaining says nothing."""
    each = F.lit([float(w) for w in weights])
    logits = F.aggregate("mask", F.lit(float(np.log(prior / (1 - prior)))), lambda done, at: done + F.get(each, at))
    return probability(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logits)))


def label_model(patterns: DataFrame, known: np.ndarray, prior: float) -> np.ndarray:
    """The weight of each voter's vote. `patterns` has `mask` and `n`; only sums over it reach the driver.

    `known` holds the same sums over the sampled labelled rows; they start the estimates and stay part of them.
    """
    width = (len(known) - 2) // 2
    values = known
    before = None
    for _ in range(ROUNDS):
        toxic, other = (values[2::2] + 0.2) / (values[0] + 1), (values[3::2] + 0.002) / (values[1] + 1)
        if before is not None and np.abs(np.log(toxic / other) - before).max() < 1e-3:
            break
        before = np.log(toxic / other)
        values = known + class_sums(patterns.withColumn("_p", posterior(prior, np.maximum(before, 0))), width)
    weights = np.maximum(before, 0)
    return weights / (1 + redundancy(patterns, width, prior, weights))


def class_sums(rows: DataFrame, width: int) -> np.ndarray:
    """Texts of both classes by `_p`, then for each voter its votes on both."""
    p, q = F.col("_p") * F.col("n"), (1 - F.col("_p")) * F.col("n")
    weighted = rows.select(p.alias("p"), q.alias("q"), F.explode(F.concat(F.array(F.lit(-1)), "mask")).alias("at"))
    sums = np.zeros(2 * width + 2)
    for row in weighted.groupBy("at").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect():
        sums[2 * row["at"] + 2 : 2 * row["at"] + 4] = row["p"] or 0.0, row["q"] or 0.0
    return sums


def redundancy(patterns: DataFrame, width: int, prior: float, weights: np.ndarray) -> np.ndarray:
    """For each voter the sum of its strong correlations with others, given "toxic" by the posterior."""
    weighted = patterns.withColumn("_w", posterior(prior, weights) * F.col("n"))
    pairs = (
        weighted.select("_w", F.explode("mask").alias("i"), F.col("mask").alias("j")).select("_w", "i", F.explode("j").alias("j"))
        .groupBy("i", "j").agg(F.sum("_w").alias("w")).collect()
    )
    total = weighted.agg(F.sum("_w")).first()[0]
    joint = np.zeros((width, width))
    if not total:
        return np.zeros(width)
    for row in pairs:
        joint[row["i"], row["j"]] = row["w"] / total
    rate = np.diag(joint).copy()
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    correlation = (joint - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    return np.where(correlation > CORRELATED, correlation, 0).sum(axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights with the intercept last, by Newton steps on soft labels with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([RIDGE] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Stems and the weights of the classifier, the intercept last."""

    def __init__(self, stems: list[str], weights: np.ndarray):
        self.stems, self.weights = stems, weights

    def score(self, counts: Column) -> Column:
        weighted = F.zip_with(counts, F.array(*[F.lit(float(w)) for w in self.weights[:-1]]), lambda n, w: F.log1p(n) * w)
        margin = F.aggregate(weighted, F.lit(float(self.weights[-1])), lambda done, part: done + part)
        return probability(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin)))

    def score_text(self, text: str = "text") -> Column:
        """The score of a row's own text, without a join."""
        stems, width, tables = self.stems, len(voters(self.stems)), []

        @F.pandas_udf("array<int>")
        def counts(texts: pd.Series) -> pd.Series:
            if not tables:
                tables.append(WordVotes(stems))
            return texts.map(lambda value: tables[0].count(value, width))

        return self.score(counts(text_or_empty(text)))


def fitted(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Model, DataFrame]:
    """The model, and the written votes of all rows (`key`, counts, mask)."""
    sample = written(learnable(labels, key, label))
    share = sample.agg(F.avg("_label")).first()[0]
    prior = min(max(PRIOR if share is None else float(share), 0.01), 0.5)
    stems = mined_stems(docs, sample, key, text)
    width = len(voters(stems))
    cast = written(votes(docs, stems, key, text))
    patterns = written(cast.groupBy("mask").agg(F.count("*").alias("n")))
    learned = cast.join(F.broadcast(sample), key).select("mask", F.col("_label").cast("double").alias("_p"), F.lit(1).alias("n"))
    weights = label_model(patterns, class_sums(learned, width), prior)
    chosen = cast.where(F.coalesce(fold(key), F.lit(1)) != 0).orderBy(F.xxhash64(key, "mask"), key).limit(FITTED_ROWS)
    rows = chosen.select("counts", posterior(prior, weights).alias("p")).toArrow()
    if not rows.num_rows:
        return Model(stems, np.zeros(width + 1)), cast
    x = np.log1p(np.array(rows.column("counts").to_pylist(), float))
    return Model(stems, fit_logistic(x, rows.column("p").to_numpy())), cast


def scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The key and `score` of every row; options as in `fitted`."""
    model, cast = fitted(docs, labels, **options)
    return cast.select(options.get("key", "doc_id"), model.score(F.col("counts")).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` that score below the threshold."""
    model, _ = fitted(docs, labels, **options)
    return docs.where(model.score_text(options.get("text", "text")) < threshold)


def op4_weak_supervision(spark: SparkSession, sf: str) -> DataFrame:
    found = scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
