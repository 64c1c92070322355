"""Counts, histograms, summaries and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_elements(df: DataFrame, c: str) -> DataFrame:
    return df.select(F.explode(c).alias("element")).where("element is not null").distinct()


def global_tags(df: DataFrame, c: str, limit: int) -> DataFrame:
    """The first ``limit`` distinct elements by name."""
    return distinct_elements(df, c).orderBy("element").limit(limit)


def element_counts(df: DataFrame, c: str) -> DataFrame:
    return df.select(F.explode(c).alias("element")).where("element is not null").groupBy("element").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def score_histogram(df: DataFrame, score: str, width: float = 0.05) -> DataFrame:
    """Counts per bucket of the score, by its lower end."""
    bucket = F.round(F.floor(F.col(score) / width + 1e-9) * width, 6)
    return df.where(F.col(score).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def at_least(df: DataFrame, score: str, thresholds: Sequence[float], distinct: str) -> DataFrame:
    """Rows and distinct keys at or above each threshold, in one pass."""
    aggs = [F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when(F.col(score) >= t, 1)).alias("n"), F.count_distinct(F.when(F.col(score) >= t, F.col(distinct))).alias("n_keys")) for t in thresholds]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("r")).select("r.*")


def run_summary(df: DataFrame, by: Sequence[str], measures: Sequence[str], low: float = 0.38) -> DataFrame:
    """Count, least, greatest and mean of measures, and how many rows have low confidence (of the first measure)."""
    aggs = [F.count("*").alias("n"), F.count(F.when(F.col(measures[0]) < low, 1)).alias("low")]
    for m in measures:
        aggs += [F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"), F.round(F.avg(m), 6).alias(f"mean_{m}")]
    return df.groupBy(*by).agg(*aggs)


def extremes(df: DataFrame, score: str, key: str, k: int = 5) -> DataFrame:
    """The top and bottom ``k`` rows by score."""
    best = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k).withColumn("side", F.lit("top"))
    worst = df.where(F.col(score).isNotNull()).orderBy(score, key).limit(k).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def compare_runs(a: DataFrame, b: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The best ``k`` rows of two runs side by side, by rank."""
    def ranked(df: DataFrame, side: str) -> DataFrame:
        best = df.orderBy(F.desc(score), key).limit(k)
        w = Window.orderBy(F.desc(score), key)  # over k rows
        return best.select(F.row_number().over(w).alias("rank"), F.col(key).alias(f"{key}_{side}"), F.col(score).alias(f"{score}_{side}"))

    return ranked(a, "a").join(ranked(b, "b"), "rank", "full")


def best_per_key(df: DataFrame, key, score: str, carry: Sequence[str]) -> DataFrame:  # noqa: ANN001
    """One row per key, that of the greatest score (ties: the greatest carried values)."""
    return df.groupBy(key.alias("key")).agg(F.max(F.struct(score, *carry)).alias("v")).select("key", "v.*")


def best_second(df: DataFrame, by: str, score: str, key: str) -> DataFrame:
    """Best and second score of each group and their difference."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return df.withColumns({"rank": F.row_number().over(w), "second": F.lead(score).over(w)}).where("rank = 1").select(by, F.col(key).alias("best"), F.col(score).alias("score"), "second", F.round(F.col(score) - F.coalesce("second", F.lit(0.0)), 6).alias("delta"))
