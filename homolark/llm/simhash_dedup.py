"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprint: lower-case A-Z, words between ASCII white space, shingles of three words (repeats count), XXH64 (seed
42) of each; a bit is set if it is set in over half the hashes. Two fingerprints are linked at `RADIUS` = 3 or
fewer differing bits, and a component is everything that links reach.

Candidates: the bits fall into three blocks. Of three differing bits some block has one or more, so with that block
left out two fingerprints differ in two bits or fewer. So for each block left out every fingerprint emits all variants of
its other bits within half the radius (one bit): 131 keys of 42 or 43 bits. A pair is a candidate where a variant of one
meets a variant of the other; the shuffle on variants brings them together, and the whole distance
decides. Pairs are deduplicated in the task that finds them, and only links that are needed to connect are written, so a dense group of near copies yields no more rows
than it has members. Groups of a key are checked in blocks; those over `HUB` pairs are connected
by balls again, this time in the block left out, which is linear in the group. A group holds distinct fingerprints that agree in all but two of those bits,
not documents: copies have been collapsed before. By chance a key is shared only beyond some 10^11 fingerprints.

Null or wordless text has fingerprint 0 and is linked like any other. A null doc_id is no candidate for the smallest
doc_id. Rows with the same doc_id are fingerprinted separately. Dedup tells rows apart by doc_id and a 64-bit hash of the text. Texts of any
length are read whole, an empty table gives an empty result, and a column of docs may have any name.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, U, as_batches, connected_components, cut, few, gathered, n_buckets, on_key, roots, trim, tune

RADIUS = 3
HUB = 1 << 24
BROADCAST_ROWS = 100_000


def fingerprint(text: bytes) -> int:
    w = text.translate(LOWER_BYTES).split()
    if not w:
        return 0
    s = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) > 2 else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(42)), "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for x in batches:
        fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in x.column(1).cast(pa.binary())), U, x.num_rows)
        yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fp.view(np.int64)), *x.columns[2:]], names=["doc_id", "fp", *x.schema.names[2:]])
    trim()


def fingerprints(docs: DataFrame, **keys: Column) -> DataFrame:
    """(doc_id, fp long, keys as long), one row per row."""
    tune(docs.sparkSession)
    more = [c.cast("long").alias(k) for k, c in keys.items()]
    schema = ", ".join(f"{k} long" for k in ("doc_id", "fp", *keys))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(_fingerprints, schema)


BLOCKS = ((0, 21), (21, 21), (42, 22))  # lowest bit and number of bits of what is left out


def _without(fp: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (fp & U((1 << shift) - 1)) | (fp >> U(shift + width) << U(shift)) if shift + width < 64 else fp & U((1 << shift) - 1)


def _variants(batches):
    """key: block left out << 60 | other bits, as they are and with each one flipped."""
    for x in batches:
        fp = x.column(0).to_numpy().view(U)
        for k, (shift, width) in enumerate(BLOCKS):
            flips = np.concatenate([[0], 1 << np.arange(64 - width)]).astype(U)
            key = ((_without(fp, shift, width)[:, None] ^ flips) | U(k << 60)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["key", "fp"])


def _hubs(other: np.ndarray, center: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Connects a large group without comparing pairs, by balls in the block left out (other: its bits).

    center: the other bits are the key itself. Two centers may differ in three bits here, a center and another member in two,
    two others in one (or, if equal in the other bits, they are centers of another key).
    """
    a, b = [], []
    none = np.zeros(1, U)
    one = (1 << np.arange(width)).astype(U)
    i, j = np.triu_indices(width, 1)
    two = one[i] | one[j]
    even = np.bitwise_count(other) % 2 == 0

    def link(groups, passes):
        """groups: (members, flips, is head); in each hub that has a head, all join the first head."""
        for p in range(passes):
            keys, who, head = [], [], []
            for m, flips, is_head in groups:
                k = (other[m][:, None] ^ flips).ravel()
                at = np.flatnonzero((k * U(0x9E3779B97F4A7C15) >> U(40)) % U(passes) == U(p))
                keys.append(k[at])
                who.append(m[at // len(flips)])
                head.append(np.full(len(at), is_head))
            k, w, h = np.concatenate(keys), np.concatenate(who), np.concatenate(head)
            order = np.lexsort((w, ~h, k))
            k, w, h = k[order], w[order], h[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            ok = h[first] & (w != w[first])
            a.append(w[ok])
            b.append(w[first][ok])

    n = len(other)
    every, c, p = np.arange(n), np.flatnonzero(center), np.flatnonzero(~center)
    ball = np.concatenate([none, one])
    link([(c, ball, True), (p, ball, False)], 1 + len(ball) * n // (1 << 22))
    odd, ev = c[~even[c]], c[even[c]]
    link([(odd, one, True), (ev, two, False)], 1 + len(two) * len(ev) // (1 << 22))
    link([(every, none, True)], 1)
    link([(every[~even], one, False), (every[even], none, True)], 1 + width * n // (1 << 22))
    return np.concatenate(a), np.concatenate(b)


SMALL = 48


def _links(radius: int):
    def connect(fp: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of a group that connect what its pairs within the radius connect."""
        n = len(fp)
        if n * n > HUB and radius == RADIUS:
            shift, width = BLOCKS[key >> 60]
            a, b = _hubs((fp >> U(shift)) & U((1 << width) - 1), _without(fp, shift, width) == U(key & ((1 << 60) - 1)), width)
        else:
            found = []
            step = max(1, (1 << 20) // n)
            for k in range(0, n, step):
                i, j = np.nonzero(np.bitwise_count(fp[k : k + step][:, None] ^ fp) <= radius)
                found.append(((k + i)[k + i < j], j[k + i < j]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        root = roots(n, a, b)
        far = np.flatnonzero(root != np.arange(n))
        return fp[far], fp[root[far]]

    def run(batches):
        table = gathered(batches)
        if table is None:
            return
        key, fp = table["key"].to_numpy(), table["fp"].to_numpy().view(U)
        del table
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(new, len(key)))
        pairs = [np.zeros((0, 2), U)]
        for n in range(2, SMALL + 1):  # most groups: all of a size at once
            at = new[size == n]
            for k in range(0, len(at), 1 << 16):
                f = fp[at[k : k + (1 << 16), None] + np.arange(n)]
                for i in range(n - 1):
                    g, j = np.nonzero(np.bitwise_count(f[:, i : i + 1] ^ f[:, i + 1 :]) <= radius)
                    pairs.append(np.unique(np.stack([f[g, i], f[g, i + 1 + j]], 1), axis=0) if len(g) else pairs[0])
        for s, n in zip(new[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            pairs.append(np.stack(connect(fp[s : s + n], int(key[s])), 1))
        x, y = np.concatenate(pairs).T
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)  # a pair meets in many keys
        root = roots(len(nodes), at[: len(x)], at[len(x) :])
        far = np.flatnonzero(root != np.arange(len(nodes)))
        if len(far):
            yield from as_batches(pa.table({"a": nodes[far].view(np.int64), "b": nodes[root[far]].view(np.int64)}))
        del key, fp, pairs
        trim()

    return run


def _named(fps: DataFrame, n: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges = on_key(distinct.select("fp").repartition(few(n), "fp").mapInArrow(_variants, "key long, fp long"), n, "key", _links(RADIUS), "a long, b long")
    nodes = distinct.join(connected_components(edges), F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return nodes.join(nodes.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id), one row per row of `docs`."""
    fps = cut(fingerprints(docs))
    return fps.join(_named(fps, n_buckets(docs)), "fp").select("doc_id", "fp", "component_id")


def _few(df: DataFrame) -> tuple[int, DataFrame]:
    """How many rows there are, up to one over BROADCAST_ROWS, and the rows, marked for broadcast if they are that few."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    return n, F.broadcast(df) if n <= BROADCAST_ROWS else df


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """Rows of `docs` with one of each component left: the one with the smallest doc_id; of rows that share it, the first by text.

    A component without any doc_id keeps its first row by text. Of rows with the same doc_id and text any one stays.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    fps = cut(fingerprints(docs, th=F.xxhash64(text)))
    named = _named(fps, n_buckets(docs)).withColumnRenamed("fp", "__fp")
    rows = fps.groupBy("doc_id", "fp", "th").agg(F.count("*").alias("n"))
    first = cut(rows.join(named, (F.col("fp") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("component_id"))).select("root", "doc_id", "th", "n"))
    # a text has one fingerprint and so one root; most roots have one text left
    picks = cut(first.groupBy("root").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id"), F.min("th").alias("th"), F.sum("n").alias("n")))
    key = lambda df: df.select(F.coalesce("doc_id", F.lit(0)).alias("__d"), F.col("doc_id").isNull().alias("__z"), F.col("th").alias("__th"), *[c for c in df.columns if c not in ("doc_id", "th")])
    keys = ["__d", "__z", "__th"]
    own = docs.withColumns({"__d": F.coalesce(doc_id, F.lit(0)), "__z": doc_id.isNull(), "__th": F.xxhash64(text)})
    keep = key(picks.where("k = 1").select("doc_id", "th", "n"))
    tied = key(first.join(picks.where("k > 1").select("root"), "root"))
    n, part = _few(tied)
    if n:
        low = own.select(*keys, text.alias("t")).join(part, keys).groupBy("root").agg(F.min(F.struct(F.col("t").isNotNull(), F.col("t"))).alias("m"))
        chosen = low.select("root", F.xxhash64("m.t").alias("__th"))
        keep = cut(keep.union(tied.join(chosen, ["root", "__th"]).select(*keep.columns)))
    out = own.join(keep.where("n = 1").select(*keys), keys, "left_semi").select(*docs.columns)
    n, part = _few(keep.where("n > 1").select(*keys))
    if n:
        out = out.union(own.join(part, keys, "left_semi").dropDuplicates(keys).select(*docs.columns))
    return out


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
