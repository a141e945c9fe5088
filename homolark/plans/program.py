"""The whole run: genomes to clusters, to similar pairs, to files."""

from __future__ import annotations

import json
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.matrices import Params
from ..operators import clustering as C
from ..sources import genomes as G


@dataclass
class Result:
    """Data frames of the run, and its counters."""

    sequences: DataFrame
    clusters: DataFrame
    matches: DataFrame
    counters: dict[str, int]
    seconds: dict[str, float]


def run(spark: SparkSession, paths: list[str], out: str, params: Params = Params(), mode: str = "sequential", prior: str | None = None, duplicate_threshold: int | None = None, only_clusters: bool = False, log_pam1: np.ndarray | None = None, group: str | None = None) -> Result:
    """Reads genomes, clusters them (on top of a prior document's clusters, whose datasets come first), writes out/clusters.json.gz, aligns candidate pairs and writes out/matches/<genome1>/<genome2>.

    Jobs carry the job group `group`, so `cancel` stops the run. Intermediate results are checkpointed in the shared folder.
    """
    spark.sparkContext.setJobGroup(group or uuid.uuid4().hex, "clustering", interruptOnCancel=True)
    began, seconds = time.perf_counter(), {}
    if prior is None:
        names, seqs = list(paths), C.cut(G.read_genomes(spark, *paths))
        clusters = C.cluster(seqs, params, mode)
    else:
        old, old_names = G.read_clusters(spark, prior)
        names = old_names + list(paths)
        seqs = C.cut(G.read_genomes(spark, *names))
        known = C.cut(old.select(F.explode("members").alias("abs_id")).distinct())
        first = known.agg(F.coalesce(F.max("abs_id") + 1, F.lit(0)).alias("n")).first().n
        clusters = C.add_genomes(old, seqs.where(F.col("abs_id") < first), seqs.where(F.col("abs_id") >= first), params)
    clusters = C.cut(C.drop_repeated_clusters(clusters, ordered=True, threshold=duplicate_threshold) if duplicate_threshold is not None else clusters)
    G.write_clusters(clusters, seqs, f"{out}/clusters.json", names)
    seconds["clustering"] = time.perf_counter() - began
    counters = {"sequences": seqs.count(), "clusters": clusters.count()}
    empty = spark.createDataFrame([], C.MATCH)
    if only_clusters:
        return Result(seqs, clusters, empty, counters, seconds | {"total": time.perf_counter() - began})
    counted = Observation("alignments")
    pairs = C.candidate_pairs(clusters, seqs)
    matches = C.cut(C.matches(pairs, seqs, params, log_pam1, counted))
    G.write_matches(matches, f"{out}/matches")
    counters |= counted.get
    return Result(seqs, clusters, matches, counters, seconds | {"total": time.perf_counter() - began})


def cancel(spark: SparkSession, group: str) -> None:
    """Stops all jobs of a run."""
    spark.sparkContext.cancelJobGroup(group)


@contextmanager
def queue_log(spark: SparkSession, path: str, every: float = 0.5):
    """Samples how many tasks of running stages wait or run, every half second, and writes [[seconds, number], ...] as JSON when the block ends."""
    samples, done, tracker = [], threading.Event(), spark.sparkContext.statusTracker()

    def sample() -> None:
        infos = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        samples.append([time.time(), sum(i.numTasks - i.numCompletedTasks for i in infos if i)])

    def watch() -> None:
        while not done.wait(every):
            sample()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield samples
    finally:
        done.set()
        watcher.join()
        sample()
        Path = spark._jvm.org.apache.hadoop.fs.Path
        out = Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).create(Path(path), True)
        out.write(bytearray(json.dumps(samples).encode()))
        out.close()
