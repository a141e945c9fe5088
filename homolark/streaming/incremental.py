"""Incremental clustering fed by a stream of genomes, which may come whole or in parts.

State under a folder, a version for each micro-batch that held rows:

    sequences/epoch=<e>     the rows of the batch with their numbers; appended, never rewritten
    genomes/v<e>            how many sequences each genome has so far
    clusters/v<e>           the clustering of all sequences so far

A batch numbers its rows on from the version before it: abs_id over all, genome_index within their genome, by (genome, genome_index, meta, seq). `genomes` is written last and
marks the version as whole, so a batch that is run again after a failure starts from the same version and writes the same numbers; what it left unfinished is replaced.
A batch without rows makes no version. Versions older than the one before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrices import Params
from ..operators.clustering import add_genomes, cluster
from ..sources.genomes import genome_sizes, numbered_on


def _fs(spark: SparkSession, path: str):
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), Path


def versions(spark: SparkSession, state: str) -> list[int]:
    """Whole versions, oldest first."""
    fs, Path = _fs(spark, state)
    root = Path(f"{state}/genomes")
    found = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and fs.exists(Path(p, "_SUCCESS")))


def sequences(spark: SparkSession, state: str, version: int | None = None) -> DataFrame:
    """All sequences up to a version (the latest one) with their genomes' sizes."""
    version = versions(spark, state)[-1] if version is None else version
    rows = spark.read.parquet(f"{state}/sequences").where(F.col("epoch") <= version).drop("epoch")
    return rows.join(spark.read.parquet(f"{state}/genomes/v{version}").select("genome", F.col("genome_size").cast("int").alias("genome_size")), "genome")


def clusters(spark: SparkSession, state: str, version: int | None = None) -> DataFrame:
    """(pos, members) of a version (the latest one)."""
    return spark.read.parquet(f"{state}/clusters/v{versions(spark, state)[-1] if version is None else version}")


def add_batch(batch: DataFrame, epoch: int, state: str, params: Params = Params()) -> None:
    """Adds rows (genome, genome_index, meta, seq) as version `epoch`; the same rows and epoch again give the same state."""
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    before = max((v for v in versions(spark, state) if v < epoch), default=None)
    rows = batch.select("genome", "genome_index", "meta", "seq")
    order = ("genome_index", "meta", "seq")
    if before is None:
        new, sizes = numbered_on(rows, *order), None
        found = cluster(new, params)
    else:
        sizes = spark.read.parquet(f"{state}/genomes/v{before}")
        n = sizes.agg(F.sum("genome_size").alias("n")).first().n
        new = numbered_on(rows, *order, known=sizes, first=n)
        found = add_genomes(clusters(spark, state, before), sequences(spark, state, before), new, params)
    new.write.mode("overwrite").parquet(f"{state}/sequences/epoch={epoch}")
    found.write.mode("overwrite").parquet(f"{state}/clusters/v{epoch}")
    genome_sizes(new, sizes).write.mode("overwrite").parquet(f"{state}/genomes/v{epoch}")
    fs, Path = _fs(spark, state)
    for old in versions(spark, state)[:-2]:
        for part in ("genomes", "clusters"):
            fs.delete(Path(f"{state}/{part}/v{old}"), True)


def cluster_stream(genomes: DataFrame, state: str, params: Params = Params(), **writer):
    """Merges each micro-batch of (genome, genome_index, meta, seq) into the clustering kept under `state`."""
    return genomes.writeStream.foreachBatch(lambda batch, epoch: add_batch(batch, epoch, state, params)).option("checkpointLocation", f"{state}/checkpoint").start(**writer)
