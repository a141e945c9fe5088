"""Comparison of result sets and of clusterings, and telemetry series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["genome1", "genome2", "seq1", "seq2", "a1", "b1", "a2", "b2", "score"]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).subtract(b.select(*KEY))


def symmetric(a: DataFrame, b: DataFrame) -> DataFrame:
    return minus(a, b).union(minus(b, a))


def duplicates(a: DataFrame) -> DataFrame:
    return a.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def recall(reference: DataFrame, other: DataFrame) -> DataFrame:
    """n_both, n_reference_only, n_other_only, recall_percent (null without a reference)."""
    r, o = reference.select(*KEY).distinct().withColumn("r", F.lit(1)), other.select(*KEY).distinct().withColumn("o", F.lit(1))
    full = r.join(o, KEY, "full_outer")
    counts = full.agg(F.count_if(F.expr("r = 1 and o = 1")).alias("n_both"), F.count_if(F.expr("r = 1 and o is null")).alias("n_reference_only"), F.count_if(F.expr("r is null")).alias("n_other_only"))
    return counts.withColumn("recall_percent", F.expr("try_divide(100.0D * n_both, n_both + n_reference_only)"))


def missed_scores(reference: DataFrame, other: DataFrame) -> DataFrame:
    """n, mean and upper median of the scores that `other` lacks."""
    m = minus(reference, other)
    rank = m.groupBy("score").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("score")))
    total = m.agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    median = rank.join(F.broadcast(total), F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min("score").alias("median"))
    return total.join(F.broadcast(median), F.lit(True)).select("n", "mean", "median")


def missed_sorted(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Matches that `other` lacks, highest score first, with their rank (equal scores share it). Only distinct scores meet in one place."""
    m = minus(reference, other)
    scores = m.groupBy("score").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = scores.select("score", (F.coalesce(before, F.lit(0)) + 1).alias("rank"))
    return m.join(ranks, "score").select(*KEY, "rank").orderBy(F.desc("score"), *KEY)


def missed_histogram(reference: DataFrame, other: DataFrame, width: int = 50) -> DataFrame:
    """Numbers of missed matches by ranges of score."""
    low = (F.floor(F.col("score") / width) * width).cast("long").alias("low")
    return minus(reference, other).groupBy(low).agg(F.count("*").alias("n"))


def totals(seqs: DataFrame, *by: str) -> DataFrame:
    """Sequences and residues, in all or by groups."""
    return seqs.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("residues"))


def residues(seqs: DataFrame) -> DataFrame:
    """How often each letter stands in all sequences."""
    counts = [F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(chr(65 + k)), F.lit("")))).alias(chr(65 + k)) for k in range(26)]
    long = seqs.agg(*counts).unpivot([], [chr(65 + k) for k in range(26)], "residue", "n")
    return long.where("n > 0")


def averages(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Number and mean of the values of each group."""
    return runs.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def cluster_report(clusters: DataFrame) -> DataFrame:
    sets = F.array_sort("members")
    return clusters.agg(F.count("*").alias("n_clusters"), F.count_distinct(sets).alias("n_distinct"), F.count_distinct(F.col("members")[0]).alias("n_representatives"))


def size_histogram(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy(F.size("members").alias("size")).agg(F.count("*").alias("n_clusters"))


def biggest(clusters: DataFrame, k: int = 5) -> DataFrame:
    return clusters.select("pos", F.size("members").alias("size")).orderBy(F.desc("size"), "pos").limit(k)


def clusters_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    s = F.array_sort("members").alias("members")
    return a.select(s).subtract(b.select(s))


def common_representatives(a: DataFrame, b: DataFrame) -> DataFrame:
    r = F.col("members")[0].alias("representative")
    return a.select(r).intersect(b.select(r))


def rates(samples: DataFrame, key: str, time: str, value: str, order: str) -> DataFrame:
    """Change of a counter per second since the sample before, null for the first or at equal times."""
    w = Window.partitionBy(key).orderBy(time, order)
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w)) / F.lit(1e6)
    return samples.withColumn("rate", F.when(seconds > 0, (F.col(value) - F.lag(value).over(w)) / seconds))


def elapsed(samples: DataFrame, key: str, time: str) -> DataFrame:
    """Microseconds since the first sample of each series."""
    first = F.min(F.unix_micros(F.col(time).cast("timestamp"))).over(Window.partitionBy(key))
    return samples.withColumn("elapsed_us", F.unix_micros(F.col(time).cast("timestamp")) - first)
