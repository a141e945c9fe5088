"""Sequence sources and sinks: FASTA, chunked columnar (AGD) datasets, cluster documents and match files."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from .agd import EVERY, AgdSource
from .cluster_document import read_clusters  # noqa: F401
from .match_sink import MatchSink
from .formats import BASES, BZIP2, GZIP, HEADER, RAW, TEXT, decode_chunk, encode_chunk, pack_bases, unpack_bases  # noqa: F401

DOWN = bytes(max(0, k - 65) for k in range(256))  # residues are stored as 0 to 25


def genome_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_fasta(spark: SparkSession, *paths: str, strict: bool = False) -> DataFrame:
    """(genome, genome_index, meta, seq): records are split by the text reader itself, so a large file is read in parallel.

    Letters are upper-cased; other characters are dropped, or with `strict` fail the query.
    """
    raw = spark.read.option("lineSep", "\n>").text(list(paths)).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    raw = raw.withColumn("value", F.regexp_replace("value", "^>", "")).where(F.length(F.trim("value")) > 0)
    body = F.upper(F.array_join(F.slice(F.split("value", "\n"), 2, 1 << 30), ""))
    clean = F.regexp_replace(body, r"[\s]", "")
    bad = F.regexp_replace(clean, "[A-Z]", "")
    seq = F.when((F.length(bad) > 0) & F.lit(strict), F.raise_error(F.concat(F.lit("not a residue: "), bad)).cast("string")).otherwise(F.regexp_replace(clean, "[^A-Z]", ""))
    # records are numbered within their split; only the splits' counts meet in one place
    splits = raw.groupBy("f", "at").agg(F.count("*").alias("n"))
    splits = splits.select("f", "at", F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("f", "at").orderBy("k")) - 1
    raw = raw.withColumns({"value": F.col("value"), "__n": within}).withColumn("__seq", seq).join(splits, ["f", "at"])
    return raw.select(genome_name(F.col("f")).alias("genome"), (F.col("base") + F.col("__n")).cast("int").alias("genome_index"), F.trim(F.regexp_replace(F.element_at(F.split("value", "\n"), 1), "\r", "")).alias("meta"), F.col("__seq").alias("seq"))


def write_fasta(seqs: DataFrame, path: str) -> None:
    """One folder of text files per genome, records in order."""
    lines = seqs.select("genome", "genome_index", F.concat(F.lit(">"), F.coalesce("meta", F.lit("")), F.lit("\n"), "seq").alias("value"))
    lines.repartition("genome").sortWithinPartitions("genome", "genome_index").drop("genome_index").write.partitionBy("genome").mode("overwrite").text(path)


def write_agd(seqs: DataFrame, path: str, name: str, rows: int = 10_000, compression: int = GZIP) -> str:
    """Chunks of `rows` consecutive ordinals of (ordinal, meta, seq), each a file a column in a folder that all workers share, and the manifest; its path.

    A task writes whole chunks, which it names by their first ordinal, so a task that runs again writes the same files.
    """
    chunked = seqs.select(F.floor(F.col("ordinal") / rows).cast("long").alias("chunk"), F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("meta", F.lit("")).alias("meta"), "seq")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, base = pdf.sort_values("ordinal"), f"{path}/{name}-{key[0]:012d}"
        first = int(pdf["ordinal"].iloc[0])
        for column, records in (("prot", [s.encode().translate(DOWN) for s in pdf["seq"]]), ("metadata", [m.encode() for m in pdf["meta"]])):
            fs, at = pa_fs.FileSystem.from_uri(f"{base}.{column}")
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(at) as out:
                out.write(encode_chunk(records, compression=compression, first=first, name=name))
        return pd.DataFrame({"chunk": [key[0]], "first": [first], "n": [len(pdf)]})

    chunks = chunked.groupBy("chunk").applyInPandas(run, "chunk long, first long, n long").orderBy("chunk").collect()  # a row a file
    doc = {"name": name, "columns": ["prot", "metadata"], "records": [{"path": f"{path}/{name}-{r.chunk:012d}", "first": r.first, "last": r.first + r.n} for r in chunks]}
    fs, at = pa_fs.FileSystem.from_uri(f"{path}/{name}.json")
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(json.dumps(doc).encode())
    return f"{path}/{name}.json"


def read_agd(spark: SparkSession, manifest: str, columns: tuple[str, ...] = ("prot", "metadata"), first: int = EVERY[0], last: int = EVERY[1]) -> DataFrame:
    """(ordinal, one binary column per requested column) of the ordinals first to last: other columns' files and chunks outside are not read, nothing is shuffled."""
    spark.dataSource.register(AgdSource)
    doc = spark.read.option("multiLine", True).json(manifest).first()
    missing = set(columns) - set(doc["columns"])
    if missing:
        raise ValueError(f"dataset has no column {sorted(missing)}")
    schema = ", ".join(["ordinal long", *[f"`{c}` binary" for c in columns]])
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("agd_chunks").schema(schema).options(first=first, last=last, push=push).load(manifest)


def at(spark: SparkSession, manifest: str, ordinal: int, columns: tuple[str, ...] = ("prot", "metadata")) -> DataFrame:
    """The record of one ordinal; no row where there is none."""
    return read_agd(spark, manifest, columns, ordinal, ordinal)


def read_agd_files(spark: SparkSession, manifest: str, columns: tuple[str, ...] = ("prot", "metadata")) -> DataFrame:
    """As `read_agd` for stores that only Spark reaches: whole chunk files come through Spark's reader, and columns meet in a shuffle."""
    doc = spark.read.option("multiLine", True).json(manifest).first()
    missing = set(columns) - set(doc["columns"])
    if missing:
        raise ValueError(f"dataset has no column {sorted(missing)}")
    base = manifest.rpartition("/")[0]
    full = lambda p: p if p.startswith("/") or "://" in p else f"{base}/{p}"

    def run(batches):
        for pdf in batches:
            for path, blob in zip(pdf["path"], pdf["content"], strict=True):
                records, first, kind = decode_chunk(bytes(blob))
                if kind == BASES:
                    records = [unpack_bases(r).encode() for r in records]
                yield pd.DataFrame({"column": path.rpartition(".")[2], "ordinal": range(first, first + len(records)), "data": records})

    files = [f"{full(r['path'])}.{c}" for r in doc["records"] for c in columns]
    if not files:
        return spark.createDataFrame([], "ordinal long, " + ", ".join(f"{c} binary" for c in columns))
    long = spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, "column string, ordinal long, data binary")
    return long.groupBy("ordinal").pivot("column", list(columns)).agg(F.first("data"))


def read_agd_proteins(spark: SparkSession, manifest: str) -> DataFrame:
    """As read_fasta; residues are stored as 0 to 25."""
    name = spark.read.option("multiLine", True).json(manifest).first()["name"]
    shift = {chr(k): chr(65 + k) for k in range(26)}
    letters = F.translate(F.decode("prot", "utf-8"), "".join(shift), "".join(shift.values()))
    return read_agd(spark, manifest).select(F.lit(name).alias("genome"), F.col("ordinal").cast("int").alias("genome_index"), F.decode("metadata", "utf-8").alias("meta"), letters.alias("seq"))


def read_genomes(spark: SparkSession, *paths: str) -> DataFrame:
    """Any mix of FASTA files and datasets, told apart by extension, numbered over all in path order."""
    parts = []
    for k, p in enumerate(paths):
        kind = p.rpartition(".")[2].lower()
        if kind not in ("json", "fa", "fasta"):
            raise ValueError(f"not a dataset: {p}")
        parts.append((read_agd_proteins(spark, p) if kind == "json" else read_fasta(spark, p)).withColumn("__file", F.lit(k)))
    return numbered(reduce(DataFrame.unionByName, parts))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Genomes named by a JSON array of paths."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    return read_genomes(spark, *json.loads(text))


def numbered(seqs: DataFrame) -> DataFrame:
    """Adds abs_id (from 0), genome_size and len. Only the per-genome sizes meet in one place; rows are numbered within their genome, whose indexes must run from 0 without gaps.

    Fails where a genome's indexes do not fit their number; `numbered_on` numbers rows that come in parts.
    """
    key = ["__file", "genome"] if "__file" in seqs.columns else ["genome"]
    i, n = F.col("genome_index").cast("long"), F.col("genome_size").cast("long")
    sizes = seqs.groupBy(*key).agg(F.count("*").cast("int").alias("genome_size"), F.min(i).alias("low"), F.max(i).alias("high"), F.sum(i).alias("total"))
    dense = (F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("total") * 2 == n * (n - 1))
    sizes = sizes.withColumn("genome_size", F.when(dense, F.col("genome_size")).otherwise(F.raise_error(F.concat(F.lit("indexes have gaps in genome "), "genome")).cast("int")))
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("genome_size").over(before), F.lit(0)))
    return seqs.join(sizes, key).select((F.col("base") + F.col("genome_index")).cast("int").alias("abs_id"), "genome", "genome_size", "genome_index", "meta", "seq", F.length("seq").alias("len"))


def numbered_on(seqs: DataFrame, *order: str, known: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Adds abs_id (from `first`) and genome_index by the order of (genome, order...), and len; genomes go on from the sizes in `known` (genome, genome_size).

    Whatever indexes the rows have, each gets a number of its own. Rows are ranked by range, so that a genome of any size is spread over many tasks.
    """
    rank = ranked(seqs, "genome", *order, name="__rank")
    start = rank.groupBy("genome").agg(F.min("__rank").alias("__first"))
    if known is not None:
        start = start.join(known.select("genome", F.col("genome_size").alias("__size")), "genome", "left")
    else:
        start = start.withColumn("__size", F.lit(0))
    index = F.col("__rank") - F.col("__first") + F.coalesce("__size", F.lit(0))
    rows = rank.drop("genome_index").join(start, "genome").withColumns({"abs_id": (F.col("__rank") + first).cast("int"), "genome_index": index.cast("int"), "len": F.length("seq")})
    return rows.drop("__rank", "__first", "__size")


def genome_sizes(seqs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(genome, genome_size) of known sizes and further rows."""
    sizes = seqs.groupBy("genome").agg(F.count("*").alias("genome_size"))
    return sizes if known is None else known.select("genome", "genome_size").unionByName(sizes).groupBy("genome").agg(F.sum("genome_size").alias("genome_size"))


def clusters_document(clusters: DataFrame, seqs: DataFrame) -> DataFrame:
    """(pos, value): each cluster as JSON."""
    each = clusters.select("pos", F.posexplode("members").alias("o", "abs_id")).join(seqs.select("abs_id", "genome", "genome_index"), "abs_id")
    row = F.struct("o", F.struct(F.col("genome").alias("Genome"), F.col("genome_index").alias("Index"), F.col("abs_id").alias("AbsoluteIndex")).alias("m"))
    return each.groupBy("pos").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["m"])).alias("value"))


def _joined(spark: SparkSession, parts: str, path: str) -> None:
    """The files of a folder, one after the other, as one file; bytes pass through the driver in pieces, never all at once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(conf)
    out = fs.create(Path(path), True)
    for f in sorted((f.getPath() for f in fs.listStatus(Path(parts))), key=lambda f: f.getName()):
        if f.getName().startswith("part-"):
            source = fs.open(f)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    out.close()
    fs.delete(Path(parts), True)


def write_clusters(clusters: DataFrame, seqs: DataFrame, path: str, datasets: list[str], joined: bool = True) -> None:
    """One gzipped document {datasets, clusters} at path + ".gz". Parts are written and compressed in parallel, in order of pos; gzip files may follow each other.

    Without `joined` the folder `path` of the parts is the document, which no one process writes and which `read_clusters` reads in parallel.
    """
    spark = clusters.sparkSession
    body = clusters_document(clusters, seqs).select(F.col("pos").cast("long").alias("pos"), "value")
    first = body.agg(F.min("pos").alias("first"))
    body = body.join(F.broadcast(first), F.lit(True)).select("pos", F.concat(F.when(F.col("pos") > F.col("first"), ",").otherwise(""), "value").alias("value"))
    ends = spark.createDataFrame([(-(1 << 62), '{"clusters": ['), (1 << 62, f'], "datasets": {json.dumps(datasets)}}}')], "pos long, value string")
    parts = f"{path}.parts" if joined else path
    ends.unionByName(body).repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.mode("overwrite").option("compression", "gzip").text(parts)
    if joined:
        _joined(spark, parts, f"{path}.gz")


def match_row(df: DataFrame) -> Column:
    """A match as text: places from 1; large distances are cut to whole numbers, smaller ones rounded to four or eight places."""
    d = F.col("distance")
    distance = F.when(d >= 45, F.format_string("%d", F.floor(d))).when(d > 0.1, F.format_string("%.4f", d)).otherwise(F.format_string("%.8f", d))
    one = lambda c: F.col(c) + 1
    return F.format_string("[%d, %d, %.7f, %s, %d..%d, %d..%d, %.8f, %d]", one("idx1"), one("idx2"), "score", distance, one("seq1_min"), one("seq1_max"), one("seq2_min"), one("seq2_max"), "variance", "cluster_size")


PART_ROWS = 1 << 18


def write_matches(matches: DataFrame, path: str) -> None:
    """A file path/genome1/genome2 for each pair of genomes, by index; earlier output is replaced at the end, or kept if the job fails. Rows stream through a sort into the tasks' files.

    A pair of more than `PART_ROWS` matches is a folder of that name instead, whose parts are such files in the order of their names; it is dealt by ranges of its indexes, so no task sorts
    a large pair whole. The matches are read once to count them, and twice more where a pair is large.
    """
    matches.sparkSession.dataSource.register(MatchSink)
    pair, index = ["genome1", "genome2"], ["idx1", "idx2"]
    sizes = matches.groupBy(*pair).agg(F.count("*").alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    rows = matches.select(*pair, *index, match_row(matches).alias("value"))
    if largest > PART_ROWS:
        large = F.broadcast(sizes.where(F.col("n") > PART_ROWS).select(*[F.col(c).alias(f"__{c}") for c in pair]))  # no more of them than parts
        rows = rows.join(large, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in pair]), "left").withColumn("split", F.col("__genome1").isNotNull())
        place = [F.when(F.col("split"), F.col(c)) for c in (*index, "value")]  # rows of other pairs are equal to the ranges, so they stay together
        rows = rows.repartitionByRange(-(-total // PART_ROWS), *pair, *place)
    else:
        rows = rows.withColumn("split", F.lit(False)).repartition(*pair)
    rows.sortWithinPartitions(*pair, *index).select(*pair, "value", "split").write.format("match_files").mode("overwrite").save(path)


def read_matches(spark: SparkSession, path: str, min_score: float | None = None) -> DataFrame:
    """(genome1, genome2, seq1, seq2, a1, b1, a2, b2, score, distance, variance, cluster_size); scores are cut to whole numbers."""
    number = r"([-0-9.e+]+)"
    pattern = rf"\[?\[(\d+), (\d+), {number}, {number}, (\d+)\.\.(\d+), (\d+)\.\.(\d+), {number}(?:, (\d+))?\]"
    get = lambda k, t: F.regexp_extract("value", pattern, k).cast(t)
    place = F.regexp_replace("_metadata.file_path", "/part-[^/]*$", "")  # path/genome1/genome2, or folders of that name
    genome = lambda k: F.regexp_replace(F.url_decode(F.replace(F.element_at(F.split("file", "/"), k), F.lit("+"), F.lit("%2B"))), r"^genome\d=", "")
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", place.alias("file")).where(F.col("value").rlike(pattern))
    names = (("seq1", 1, "int"), ("seq2", 2, "int"), ("score", 3, "double"), ("distance", 4, "double"), ("a1", 5, "int"), ("b1", 6, "int"), ("a2", 7, "int"), ("b2", 8, "int"), ("variance", 9, "double"))
    out = rows.select(F.lower(genome(-2)).alias("genome1"), F.lower(genome(-1)).alias("genome2"), *[get(k, t).alias(n) for n, k, t in names], F.expr("try_cast(regexp_extract(value, '" + pattern.replace("\\", "\\\\") + "', 10) as int)").alias("cluster_size"))
    out = out if min_score is None else out.where(F.col("score") >= min_score)
    return out.withColumn("score", F.col("score").cast("int"))
