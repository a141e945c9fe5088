"""Token-id files compressed by Re-Pair.

Documents are range-partitioned by doc_id and encoded; every partition is a shard of blocks of whole documents. A block
is compressed by Re-Pair: the most frequent pairs of neighbouring symbols become nonterminals, again and again,
many pairs in a round where they do not overlap. The file format is a Parquet table of blocks:

  shard, block           ascending with doc_id
  block_start, n_ids     ids of the shard before the block, ids in it
  doc_ids, doc_lens      its documents in order
  vocab                  symbols below are ids, from here on nonterminals
  rules                  two symbols for each nonterminal
  lengths                ids that each nonterminal expands to, for decoding from any place
  symbols                the sequence
(binaries hold little-endian integers of `width` bytes, lengths of 4). It is written by Spark into any store.

Null text is an empty document (only the end id). Null doc_ids come first; rows that share a doc_id follow in
text order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_buckets, scratch, tune
from .tokens import encoder

BLOCK_IDS = 1 << 19
LEAST = 8  # a pair must occur so often to become a rule
ROUND_RULES = 2048
STORE = "shard long, block int, block_start long, n_ids long, doc_ids array<long>, doc_lens array<long>, vocab int, width int, rules binary, lengths binary, symbols binary"
_SLOTS = 17  # bits of a place in the table of a round's rules


def _frequent(key: np.ndarray, least: int, most: int) -> np.ndarray:
    """Pairs that occur `least` times or more, the most frequent first."""
    if len(key) < least:
        return key[:0]
    s = np.sort(key)
    hit = np.flatnonzero(s[least - 1 :] == s[: len(s) - least + 1])
    first = hit[np.append(True, s[hit[1:]] != s[hit[:-1]])] if len(hit) else hit
    n = np.searchsorted(s, s[first], "right") - first
    return s[first[np.argsort(-n, kind="stable")[:most]]]


def compress(ids: np.ndarray, vocab: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules of shape (k, 2), expansion lengths), symbols from `vocab` on being nonterminals.

    Rounds go on until no pair occurs `least` times without a rule (pairs whose places overlap others so that fewer than three can be
    replaced stay). After the first rounds only pairs with a symbol of the last round are counted, until a count of all pairs finds none.
    """
    seq, rules, lengths, made = ids.astype(np.uint32), [], np.ones(0, np.int64), vocab
    none, latest = np.uint32(0xFFFFFFFF), -1  # latest: symbols from here on are new; -1: all pairs are counted
    spent = np.zeros(0, np.uint64)  # pairs that overlap too much, as long as nothing changes
    while len(seq) >= 2 * least:
        kind, shift, factor = (np.uint64, 32, 0x9E3779B97F4A7C15) if made >= 1 << 16 else (np.uint32, 16, 0x9E3779B1)
        seq = seq.astype(kind, copy=False)
        if latest < 0:
            at, key = None, (seq[:-1] << kind(shift)) | seq[1:]
        else:
            new = np.flatnonzero(seq >= latest)
            at = np.unique(np.concatenate([new[new > 0] - 1, new[new < len(seq) - 1]]))
            key = (seq[at] << kind(shift)) | seq[at + 1]
        pairs = _frequent(key, least, ROUND_RULES + len(spent))
        if len(spent):
            pairs = pairs[~np.isin((pairs >> kind(shift)).astype(np.uint64) << np.uint64(32) | (pairs & kind((1 << shift) - 1)).astype(np.uint64), spent)]
        if made < 1 << 16:
            pairs = pairs[: (1 << 16) - made]
        if not len(pairs):
            if latest < 0:
                break
            latest = -1
            continue
        slot = lambda k: ((k * kind(factor)) >> kind(2 * shift - _SLOTS)).astype(np.intp)  # noqa: B023, E731
        table, rank = np.zeros(1 << _SLOTS, kind), np.full(1 << _SLOTS, none)
        back = slot(pairs)[::-1]
        table[back], rank[back] = pairs[::-1], np.arange(len(pairs), dtype=np.uint32)[::-1]  # the most frequent wins a slot; the other's turn comes
        where = slot(key)
        some = np.flatnonzero(table.take(where) == key)
        r, at = rank.take(where[some]), some if at is None else at[some]
        near = np.diff(at) == 1
        left, right = np.append(none, np.where(near, r[:-1], none)), np.append(np.where(near, r[1:], none), none)
        place = np.arange(len(r))
        place -= np.maximum.accumulate(np.where(left == r, 0, place))  # in a run of one symbol every other place is taken
        hit = np.flatnonzero((place & 1 == 0) & ((left == r) | (r < left)) & (r <= right))  # where rules overlap, the more frequent one
        got, hit = r[hit], at[hit]
        uses = np.bincount(got, minlength=len(pairs))
        ok = uses >= 3
        lost = pairs[(uses < 3) & (table[slot(pairs)] == pairs)]
        spent = np.append(spent, (lost >> kind(shift)).astype(np.uint64) << np.uint64(32) | (lost & kind((1 << shift) - 1)).astype(np.uint64))
        hit, got = hit[ok[got]], got[ok[got]]
        if not len(hit):
            continue
        name = np.cumsum(ok) - 1 + made
        seq[hit] = name[got].astype(kind)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, spent = seq[keep], spent[:0]
        own = pairs[ok]
        lr = np.stack([own >> kind(shift), own & kind((1 << shift) - 1)], axis=1).astype(np.int64)
        size = lambda x: np.where(x < vocab, 1, lengths[np.maximum(x - vocab, 0)] if len(lengths) else 1)  # noqa: B023, E731
        lengths = np.append(lengths, size(lr[:, 0]) + size(lr[:, 1]))
        rules.append(lr)
        latest = made if len(own) < ROUND_RULES // 8 else -1
        made += len(own)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), lengths


def expansions(rules: np.ndarray, lengths: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """All nonterminals' ids end to end, and where each starts."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.zeros(int(start[-1]), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):  # a rule names earlier ones only
        at = start[k]
        for x in (a, b):
            if x < vocab:
                flat[at] = x
                at += 1
            else:
                n = lengths[x - vocab]
                flat[at : at + n] = flat[start[x - vocab] : start[x - vocab] + n]
                at += n
    return flat, start


class Stored:
    """One block of a file: any range of its ids without decoding the rest."""

    def __init__(self, vocab: int, width: int, rules: bytes, lengths: bytes, symbols: bytes):
        kind = f"<u{width}"
        self.vocab, self.symbols = vocab, np.frombuffer(symbols, kind).astype(np.int32)
        self.lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
        self.flat, self.start = expansions(np.frombuffer(rules, kind).astype(np.int64).reshape(-1, 2), self.lengths, vocab)
        self.table = np.concatenate([np.arange(vocab), self.flat]).astype("<u4")
        self.sizes = np.concatenate([np.ones(vocab, np.int32), self.lengths.astype(np.int32)])
        self.places = np.concatenate([np.arange(vocab, dtype=np.int32), (vocab + self.start[:-1]).astype(np.int32)])
        self.ends = np.cumsum(self.sizes.take(self.symbols))

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        total = int(self.ends[-1]) if len(self.ends) else 0
        b = total if b is None else min(b, total)
        if a >= b:
            return np.zeros(0, "<u4")
        i, j = np.searchsorted(self.ends, a, "right"), np.searchsorted(self.ends, b, "left") + 1
        x = self.symbols[i:j]
        size = self.sizes.take(x)
        ends = np.cumsum(size, dtype=np.int32)
        out = self.table.take(np.repeat(self.places.take(x) - ends + size, size) + np.arange(ends[-1], dtype=np.int32))
        skip = a - (int(self.ends[i]) - int(size[0]))
        return out[skip : skip + b - a]


def _write(path: str, vocab: int, end: int):
    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, lens, docs, size = [], [], [], 0

        def flush():
            nonlocal block, before, ids, lens, docs, size
            symbols, rules, lengths = compress(np.concatenate(ids), vocab)
            width = 2 if vocab + len(rules) <= 1 << 16 else 4
            kind = f"<u{width}"
            row = {"shard": shard, "block": block, "block_start": before, "n_ids": size, "doc_ids": docs, "doc_lens": lens, "vocab": vocab, "width": width, "rules": rules.astype(kind).tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype(kind).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=ARROW)
            block, before = block + 1, before + size
            ids, lens, docs, size = [], [], [], 0

        for x in batches:
            flat, off = encoder(path).encode(x.column(1), end)
            a, names, n = 0, x.column(0).to_pylist(), np.diff(off).tolist()
            while a < x.num_rows:  # whole documents until the block is full
                b = a
                while b < x.num_rows and size < BLOCK_IDS:
                    size += n[b]
                    b += 1
                ids.append(flat[off[a] : off[b]])
                lens += n[a:b]
                docs += names[a:b]
                if size >= BLOCK_IDS:
                    yield from flush()
                a = b
        if docs:
            yield from flush()
        encoder(path).rest()

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in STORE.split(", ")])


def write_store(docs: DataFrame, path: str, tokenizer: str, vocab: int, end: int) -> None:
    """Writes the documents' ids, in ascending doc_id order, as a store at `path`."""
    tune(docs.sparkSession)
    n = n_buckets(docs)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(tokenizer, vocab, end), STORE).write.option("compression", "zstd").parquet(path)


def _read(batches):
    for x in batches:
        for r in x.to_pylist():
            ids = Stored(r["vocab"], r["width"], r["rules"], r["lengths"], r["symbols"]).ids()
            off = np.concatenate([[0], np.cumsum(r["doc_lens"])])
            n = len(r["doc_ids"])
            blob = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * off).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(np.full(n, r["shard"])), pa.array(r["block_start"] + off[:-1]), pa.array(np.diff(off)), blob], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, shard_start, n_tokens, ids): ids as little-endian 32-bit integers."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    return spark.read.parquet(path).mapInArrow(_read, "doc_id long, shard long, shard_start long, n_tokens long, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): ids in all shards before; one row a shard, from two columns of the files."""
    totals = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def op1_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "op1-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 50257, 2)
    found = read_store(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return found.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard")
