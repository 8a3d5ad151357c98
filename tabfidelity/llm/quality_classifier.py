"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from one aggregation of sums and products; the covariances are shrunk towards
the pooled one and its mean variance, factored once by Cholesky, and scores are logistic values of the difference
of the Mahalanobis log-densities. Rows of the held-out fold are never learnt from.

Defined results: null and empty texts have statistics of zero and get a score; several labels of one doc_id
count as their majority (a tie as 1); with one class or none among the labels all scores are 0.5; a null doc_id has
no label and isn't held out; rows that repeat a doc_id are scored each by their own text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, table, words_of, written


@dataclass(frozen=True)
class Discriminant:
    #: Weight of the pooled covariance, and of the mean variance, in each class covariance.
    to_pooled: float = 0.1
    to_sphere: float = 0.02


STATISTICS = ("length", "word_length", "upper", "digit", "punctuation", "symbol", "shout", "distinct", "dup_lines", "line_words", "stutter", "short_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the transformed statistics: logarithms of sizes, square roots of shares."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", text.alias("text"), words_of(F.col("text"), SPACE_WORD).alias("words"), lines.alias("lines"))
    n_words, n_chars, n_lines = F.size("words"), F.char_length("text"), F.size("lines")

    def share(part: Column, whole: Column) -> Column:
        return F.sqrt(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)))

    def among(pattern: str) -> Column:
        """Characters of runs of the pattern."""
        return n_chars - F.char_length(F.regexp_replace("text", pattern, ""))

    letters = F.aggregate("words", F.lit(0), lambda acc, w: acc + F.char_length(w))
    stutter = F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get("words", F.greatest(i - 1, F.lit(0))))))
    return rows.select(
        "doc_id",
        F.log1p(n_words).alias("length"),
        F.log1p(F.coalesce(letters / F.nullif(n_words, F.lit(0)), F.lit(0.0))).alias("word_length"),
        share(among("[A-Z]+"), n_chars).alias("upper"),
        share(among("[0-9]+"), n_chars).alias("digit"),
        share(among(r"[!-/:-@\[-`{-~]+"), n_chars).alias("punctuation"),
        share(among(r"[#*$%&|<>]+"), n_chars).alias("symbol"),
        share(among("!+"), n_chars).alias("shout"),
        share(F.size(F.array_distinct("words")), n_words).alias("distinct"),
        share(n_lines - F.size(F.array_distinct("lines")), n_lines).alias("dup_lines"),
        F.log1p(F.coalesce(n_words / F.nullif(n_lines, F.lit(0)), F.lit(0.0))).alias("line_words"),
        share(stutter, n_words).alias("stutter"),
        share(F.size(F.filter("words", lambda w: F.char_length(w) <= 3)), n_words).alias("short_words"),
    )


@dataclass(frozen=True)
class Model:
    """For each class: log prior, mean, inverse of the covariance's Cholesky factor, log-determinant."""

    classes: tuple[tuple[float, np.ndarray, np.ndarray, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), 0.5)
        densities = [prior - 0.5 * np.square((x - mean) @ whiten.T).sum(axis=1) - 0.5 * log_det for prior, mean, whiten, log_det in self.classes]
        return 1 / (1 + np.exp(-np.clip(densities[1] - densities[0], -500, 500)))


def fit(labelled: DataFrame, p: Discriminant = Discriminant()) -> Model:
    """labelled: the statistics and label (0 or 1). Only sums and products reach the driver."""
    names = STATISTICS
    sums = [F.sum(a).alias(f"s_{a}") for a in names] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    rows = {r["label"]: r for r in labelled.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    if set(rows) != {0, 1}:
        return Model(())
    d, moments = len(names), {}
    for label, r in rows.items():
        mean = np.array([r[f"s_{a}"] for a in names]) / r["n"]
        second = np.array([[r[f"p_{a}_{b}"] if i <= j else r[f"p_{b}_{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)]) / r["n"]
        moments[label] = (r["n"], mean, second - np.outer(mean, mean))
    total = sum(n for n, *_ in moments.values())
    pooled = sum(n * cov for n, _, cov in moments.values()) / total
    classes = []
    for label in (0, 1):
        n, mean, cov = moments[label]
        cov = (1 - p.to_pooled) * cov + p.to_pooled * pooled
        cov = (1 - p.to_sphere) * cov + p.to_sphere * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        classes.append((float(np.log(n / total)), mean, np.linalg.solve(factor, np.eye(d)), float(2 * np.log(np.diag(factor)).sum())))
    return Model(tuple(classes))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x), type=pa.float64())], ["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, p: Discriminant = Discriminant()) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted."""
    stats = written(statistics(docs).withColumn("doc_id", F.col("doc_id").cast("long")), "document-statistics")
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    model = fit(stats.join(known.where(~held_out(F.col("doc_id"))), "doc_id"), p)
    scored = stats.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
