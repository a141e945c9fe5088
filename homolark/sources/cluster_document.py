"""Cluster documents {datasets, clusters}, read in parallel: a file that Spark can split is read by many tasks, and a folder of part files in name order is one document.

The text reader cuts the document at every "]". A piece ends an array unless that bracket stands in a string, which the number of quotes before it tells.
Pieces are counted in runs of `RUN` neighbours, so only a row for each run meets in one place, and what one task read (a gzipped file) is spread before it is parsed. Whether
a run begins inside a string is known from the runs before; each run is counted for both cases. Arrays are then numbered through the document, in order, and each cluster is parsed
alone; the few that a bracket in a name has cut are put together first.

Layout is free, keys may come in any order, and further keys with plain values or arrays of them are passed over. A document without clusters has no rows. What is not a cluster within
`clusters`, or is cut short, fails the query.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = 16  # a run is 2^16 pieces

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PLAIN = rf'(?:{_STRING}|[^"\[\]{{}},]++)'
HEAD = rf"(?s)^\s*[{{,]\s*(?:{_STRING}\s*:\s*{_PLAIN}\s*,\s*)*+({_STRING})\s*:\s*\["  # a key whose array begins in this piece
MEMBERS = "array<struct<Genome:string,Index:int,AbsoluteIndex:long>>"


def _quotes(text: Column) -> Column:
    """Quotes that are not escaped; no escape is cut, as none holds a bracket."""
    bare = F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)
    return F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(f, at, run, k, value, odd, last): the document between brackets; odd: whether a string is open after the piece, if none was before the run; last: in its run."""
    raw = spark.read.option("lineSep", "]").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    run = Window.partitionBy("f", "at", "run").orderBy("k")
    raw = raw.withColumn("run", F.shiftright("k", RUN))
    return raw.withColumns({"odd": F.sum(_quotes(F.col("value"))).over(run) % 2 == 1, "last": F.lead("k").over(run).isNull()})


def _runs(parts: DataFrame) -> DataFrame:
    """(f, at, run, inside, base, final): whether a run begins in a string, the arrays that ended before it, and whether it is its file's last, whose end is no bracket."""
    n = parts.groupBy("f", "at", "run").agg(F.count_if(~F.col("odd")).alias("n0"), F.count_if(F.col("odd")).alias("n1"), F.bool_or(F.col("last") & F.col("odd")).alias("turn"))
    order = Window.orderBy("f", "at", "run")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumns({"inside": F.coalesce(F.sum(F.col("turn").cast("int")).over(before), F.lit(0)) % 2 == 1, "final": F.coalesce(F.lead("f").over(order) != F.col("f"), F.lit(True))})
    ended = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    unended = (F.col("final") & (F.col("inside") == F.col("turn"))).cast("long")
    return n.withColumn("base", F.coalesce(F.sum(ended - unended).over(before), F.lit(0))).select("f", "at", "run", "inside", "base", "final")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(e, value): what stands before the e-th closing bracket of the document, from the one before on."""
    parts = pieces(spark, path)
    own = parts.join(_runs(parts), ["f", "at", "run"])
    ends = (F.col("odd") == F.col("inside")) & ~(F.col("final") & F.col("last"))
    run = Window.partitionBy("f", "at", "run").orderBy("k")
    own = own.withColumn("ends", ends)
    earlier = F.coalesce(F.sum(F.col("ends").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumns({"e": F.col("base") + earlier, "whole": F.col("ends") & F.coalesce(F.lag("ends").over(run), F.lit(False))})
    # the first of a run may go on from the run before, and a bracket in a name has cut those on its sides
    cut = own.where(~F.col("whole")).groupBy("e").agg(F.array_sort(F.collect_list(F.struct("f", "at", "k", "value", (F.col("final") & F.col("last")).alias("bare")))).alias("ps"))
    text = F.aggregate("ps", F.lit(""), lambda a, p: F.concat(a, p["value"], F.when(p["bare"], "").otherwise("]")))
    whole = own.where("whole").select("e", F.concat("value", F.lit("]")).alias("value"))
    return whole.unionByName(cut.select("e", text.alias("value")))


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(pos, members) and the datasets of a document, a file or a folder of part files, gzipped or not. The driver reads the keys of the document alone."""
    rows = arrays(spark, path)
    key, datasets = F.regexp_extract("value", HEAD, 1), '"datasets"'
    heads = rows.where(F.col("value").rlike(HEAD)).select("e", key.alias("key"), F.when(key == datasets, F.concat(F.lit("["), F.regexp_replace("value", HEAD, ""))).alias("value")).orderBy("e").collect()
    names = next((json.loads(r.value) for r in heads if r.key == datasets), [])
    at = next((i for i, r in enumerate(heads) if r.key == '"clusters"'), None)
    if at is None:
        return spark.createDataFrame([], "pos int, members array<long>"), names
    first, after = heads[at].e, (heads[at + 1].e if at + 1 < len(heads) else None)
    inside = (F.col("e") >= first) & (F.lit(True) if after is None else F.col("e") < after)
    body = F.when(F.col("e") == first, F.regexp_replace("value", HEAD, "")).otherwise(F.regexp_replace("value", r"^\s*,", ""))
    body = F.when(inside & ~body.rlike(r"^\s*[\]}]"), body)  # null at the end of clusters and outside; conditions stand in the values, as a filter may be moved behind what fails
    wrong = F.raise_error(F.concat(F.lit("not a cluster: "), F.substring("value", 1, 80))).cast(MEMBERS)
    members = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", MEMBERS, {"mode": "FAILFAST"})).when(F.col("value").isNotNull(), wrong)
    rows = rows.select((F.col("e") - first).cast("int").alias("pos"), body.alias("value")).where(F.col("value").isNotNull())
    return rows.select("pos", F.transform(members, lambda m: m["AbsoluteIndex"]).alias("members")), names
