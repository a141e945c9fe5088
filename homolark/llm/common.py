"""What the operators of this subpackage share: session helpers, bucketed documents, byte-level hashing.

Documents are handled as UTF-8 byte buffers straight from Arrow: words and their hashes are found with
numpy over a whole buffer, so no Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import session

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20  # of stored input, a partition
GROUPS = 2  # buckets a partition, so that few partitions stay empty
CHUNK = 1 << 20
U = np.uint64
NULL_ID = -(1 << 63)
FIRST_ID = -(1 << 62)  # orders below belong to rows without an id

WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = bytes(LOWER)


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and bytes, so that a worker holds few long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), where checkpoints go too; only a local session may leave it unset."""
    found = session.shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(Path(path), True)


def n_buckets(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many partitions as keep each at about `bucket_bytes` of stored input, at least one per shuffle partition."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 60 else max(least, -(-size // bucket_bytes))


MOST_PARTS = 20_000


def few(n: int) -> int:
    """Partitions for n groups: beyond `MOST_PARTS` a partition holds several groups, which Spark sorts (and spills) and hands on one by one."""
    return min(n, MOST_PARTS)


def on_key(df: DataFrame, n: int, key: str, f, schema: str) -> DataFrame:
    """f, a function of batches that gathers them, on n groups of rows by hash of a key."""
    if few(n) == n:
        return df.repartition(n, key).mapInArrow(f, schema)
    grouped = df.withColumn("__g", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition(few(n), "__g").groupBy("__g")
    return _grouped(grouped, f, schema)


def on_blocks(dealt: DataFrame, n: int, f, schema: str) -> DataFrame:
    """f, a function of batches that gathers them, on all blocks of `bucketed`."""
    return dealt.mapInArrow(f, schema) if few(n) == n else _grouped(dealt.groupBy("b"), f, schema)


def _grouped(grouped, f, schema: str) -> DataFrame:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    empty = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(table: pa.Table) -> pa.Table:
        got = list(f(iter(table.combine_chunks().to_batches())))
        return pa.Table.from_batches(got) if got else empty.empty_table()

    return grouped.applyInArrow(run, schema)


def bucketed(docs: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """(doc_id, text, columns..., ord, b), dealt by b; the exchange is reused by every pass.

    ord tells documents apart and puts them in order: it is doc_id, or for a null one a hash of the text within the lowest quarter of all
    integers. b depends on ord alone, so rows without an id spread over all buckets. Rows of one doc_id are one document and stay together.
    """
    n = n_buckets(docs)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)
    unnamed = F.lit(NULL_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    kept = kept.withColumn("ord", F.coalesce("doc_id", unnamed))
    return kept.withColumn("b", F.pmod(F.xxhash64("ord"), F.lit(GROUPS * n)).cast("int")).repartition(few(n), "b"), n


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    if a.null_count:
        a = a.fill_null("")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def longs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False)


_frozen = False


def trim() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task otherwise keeps its peak."""
    global _frozen
    gc.collect()
    if not _frozen:  # modules stay; later collections need not look at them
        gc.freeze()
        _frozen = True
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from those of its two parts."""
    return mix(a * U(0xD6E8FEB86659FD93) + b)


def fold(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for each run of hashes, runs of n >= 1 end to end: neighbours are joined again and again."""
    size = n
    while len(n) and n.max() > 1:
        start = np.cumsum(n) - n
        place = np.arange(len(h)) - np.repeat(start, n)
        even = np.flatnonzero(place & 1 == 0)
        paired = place[even] + 1 < np.repeat(n, n)[even]
        out = h[even]
        out[paired] = join_hash(out[paired], h[even[paired] + 1])
        h, n = out, (n + 1) >> 1
    return mix(h + size.astype(U) * U(0xE7037ED1A0B428DB))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_ODD = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_SIZE = (U(0xC2B2AE3D27D4EB4F), U(0x9FB21C651E98DF25))
LONG_WORD = 128


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time go through the finaliser, long ranges through XXH3. Seeds 0 and 1 give independent hashes."""
    n = ends - starts
    padded = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    eights = padded.view("<u8")

    def load(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        q, r = at >> 3, ((at & 7) << 3).astype(U)
        return ((eights[q] >> r) | ((eights[q + 1] << U(1)) << (U(63) - r))) & _MASK[np.minimum(size, 8)]

    h = mix((load(starts, n) ^ _ODD[seed]) * _ODD[1 - seed] + n.astype(U) * _SIZE[seed])
    i, k = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
    while len(i):
        h[i] = mix((h[i] ^ load(starts[i] + k, n[i] - k)) * _SIZE[seed] + _ODD[seed])
        k += 8
        i = i[n[i] > k]
    raw = memoryview(padded)
    for j in np.flatnonzero(n > LONG_WORD).tolist():
        h[j] = xxhash.xxh3_64_intdigest(raw[starts[j] : ends[j]], seed)
    return h


def words(data: np.ndarray, off: np.ndarray, seeds: int = 1) -> tuple[np.ndarray, ...]:
    """Starts and ends of all words, the index of each document's first word (one more at the end), and word hashes of each of the first `seeds` seeds."""
    n = len(data)
    starts, ends, found = [], [], [[] for _ in range(seeds)]
    is_doc = np.zeros(n + 1, bool)
    is_doc[off[:-1]] = True
    a = 0
    while a < n:
        b = min(n, a + CHUNK)
        while b < n and not (is_doc[b] or WS[data[b]]):  # grow to the next break, so no word is cut
            gap = np.flatnonzero(WS[data[b : b + 4096]] | is_doc[b : b + len(data[b : b + 4096])])
            b = b + int(gap[0]) if len(gap) else min(n, b + 4096)
        part = data[a:b]
        in_word = ~WS[part]
        fresh = in_word.copy()
        fresh[1:] &= ~in_word[:-1] | is_doc[a + 1 : b]
        s = np.flatnonzero(fresh)
        if len(s):
            last = in_word
            last[:-1] &= ~in_word[1:] | is_doc[a + 1 : b]
            e = np.flatnonzero(last) + 1
            for seed in range(seeds):
                found[seed].append(word_hashes(part, s, e, seed))
            starts.append(s + a)
            ends.append(e + a)
        a = b
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, off), *(np.concatenate(h) if h else np.zeros(0, U) for h in found)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and where each x is among them."""
    d = pa.array(x).dictionary_encode()
    u, at = d.dictionary.to_numpy(), d.indices.to_numpy()
    by = np.argsort(u)
    place = np.empty(len(u), np.int64)
    place[by] = np.arange(len(u))
    return u[by], place[at]


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted array `of`; a bitmap answers most of the noes."""
    if not len(of) or not len(x):
        return np.zeros(len(x), bool)
    x, of = x.view(U), of.view(U)
    bits = U((1 << max(10, int(len(of)).bit_length() + 3)) - 1)
    seen = np.zeros(int(bits) + 1, bool)
    seen[of & bits] = True
    out = seen[x & bits]
    may = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(of, x[may]), len(of) - 1)
    out[may] = of[at] == x[may]
    return out


def gathered(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    """A whole partition, for partitions whose size the caller bounds by their number."""
    got = [x for x in batches if x.num_rows]
    return pa.Table.from_batches(got) if got else None


def as_batches(table: pa.Table | None, rest: bool = True) -> Iterator[pa.RecordBatch]:
    """A task's output; `rest`: its last, after which memory is given back."""
    if table is not None:
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)
        del table
        if rest:
            trim()


def trimmed(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of groups that gives memory back after every few megabytes of groups, as it cannot see its task end."""
    seen = 0

    @functools.wraps(f)
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nonlocal seen
        out = f(left, right)
        seen += left.nbytes + right.nbytes
        if seen >= BATCH_BYTES:
            seen = 0
            trim()
        return out

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b long), for every node that an edge names.

    Alternates large-star and small-star steps; minima are taken with map-side combining and joined back, so a
    node of many links is never gathered. Each round is checkpointed.
    """
    spark = edges.sparkSession
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_forest, "a long, b long").distinct())
    before = None
    while True:
        sums = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        now = (sums.n, sums.s)
        if now == before or not sums.n:
            break
        before = now
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))  # large-star
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # small-star
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small)
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch replaced by links to the smallest node that the batch connects."""
    for x in batches:
        if x.num_rows:
            a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = roots(len(nodes), at[: len(a)], at[len(a) :])
            far = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1, by repeated minimum and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new
