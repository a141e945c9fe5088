"""Language-model scoring by prediction by partial matching (PPM) over bytes.

Training counts, over the whole training part, each symbol after each context of `ORDER` bytes or fewer (a text is
padded in front and ends with an end symbol). Every context counts, however rare. Escape is by method C (distinct symbols), and
symbols of longer contexts are excluded from shorter ones; what no context has seen is uniform over the symbols left.

The model is never in one place. Each block of documents asks for its distinct codes (a context and a symbol) and says how
often its training texts hold them; a code goes to the part that has all contexts with the same last `NEAR` bytes, which adds
up the counts of orders `NEAR` to `ORDER` and answers each block with code lengths. Only counts of orders below `NEAR` are broadcast:
they are bounded by the number of byte triples, whatever the corpus.

`adaptive_bits` is the model without pretraining: it learns from the text while it codes it.

The base score is an add-one unigram model over words. Its vocabulary is not broadcast: each block asks for its distinct
words in the same way and gets their corpus counts back.

A-Z are lower-cased for both. Null text is empty: only the end token. Held out: crc32 of doc_id as text mod 7 is 2; a
null doc_id is never held out. Words are compared by 64-bit hashes. Rows are scored independently.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, as_batches, distinct, gathered, mix, n_buckets, signed, trim, tune, utf8, words

ORDER = 6
NEAR = 3
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never has
SYMBOLS = 257  # 256 bytes and the end


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts lower-cased, each with ORDER pads before and an end after; where each starts (with pads)."""
    n, size = len(off) - 1, np.diff(off)
    out = np.full(len(data) + n * (ORDER + 1), PAD, np.uint8)
    start = off[:-1] + np.arange(n) * (ORDER + 1)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * (ORDER + 1) - 1, size)] = LOWER[data] if len(data) else data
    out[start + ORDER + size] = END
    return out, np.append(start, len(out))


def coded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each symbol, its context and itself, end to end; where each text's codes start (one more at the end)."""
    buf, start = padded(data, off)
    code = np.zeros(max(0, len(buf) - ORDER), np.int64)
    for k in range(ORDER + 1):
        code = code << 8 | buf[k : k + len(code)]
    return code[buf[ORDER:] != PAD], start - ORDER * np.arange(len(start))


def _low(batches):
    """Counts of (context, symbol) codes of order NEAR - 1 of this partition, and at -1 and -2 the numbers of words and of texts."""
    held = np.zeros((2, 0), np.int64)
    n_words = n_texts = 0
    for x in batches:
        data, off = utf8(x.column(0))
        n_texts += x.num_rows
        n_words += len(words(data, off, 0)[0])
        u, at = distinct((coded(data, off)[0] & ((1 << 8 * NEAR) - 1)).astype(np.int32))
        code, n = np.concatenate([held[0], u]), np.concatenate([held[1], np.bincount(at, minlength=len(u))])
        u, at = np.unique(code, return_inverse=True)
        held = np.stack([u, np.bincount(at, n, len(u)).astype(np.int64)])
    if n_texts:
        yield from as_batches(pa.table({"code": np.append(held[0], [-1, -2]), "n": np.append(held[1], [n_words, n_texts])}))


class Level:
    """Contexts of one order: how often each was seen, with how many symbols, and how often those symbols follow the next shorter context."""

    def __init__(self, code: np.ndarray, n: np.ndarray, shorter: np.ndarray | None = None):
        self.code, self.n = code, n
        ctx = code >> 8
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
        self.ctx = ctx[first]
        self.total = np.add.reduceat(n, first) if len(first) else n
        self.distinct = np.diff(np.append(first, len(ctx)))
        self.shared = None if shorter is None else np.add.reduceat(shorter, first) if len(first) else n


def _at(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each x is in the sorted array `of`, or -1."""
    if not len(of):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return np.where(of[at] == x, at, -1)


def _shorter(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of order k with their counts, and which of them each code becomes."""
    u, at = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return u, np.bincount(at, n, len(u)).astype(np.int64), at


def levels(code: np.ndarray, n: np.ndarray, top: int, bottom: int, below: list[Level]) -> list[Level]:
    """Levels of orders 0 to `top` from the sorted codes of order `top`; those under `bottom` are `below`."""
    out: list[Level] = []
    for k in range(top, bottom - 1, -1):
        if k > bottom:
            c, m, at = _shorter(code, n, k - 1)
            out.append(Level(code, n, m[at]))
            code, n = c, m
        elif below:
            out.append(Level(code, n, below[k - 1].n[_at(code & ((1 << 8 * k) - 1), below[k - 1].code)]))
        else:
            out.append(Level(code, n))
    return [*below, *out[::-1]]


def code_logs(code: np.ndarray, model: list[Level]) -> np.ndarray:
    """log10 probability of each code's symbol after its context."""
    out = np.zeros(len(code))
    left, longer = np.arange(len(code)), np.full(len(code), -1)  # codes no order has held yet, and the longer context of each if seen
    for k in range(len(model) - 1, -1, -1):
        m, own = model[k], code[left] & ((1 << 8 * (k + 1)) - 1)
        ctx = _at(own >> 8, m.ctx)
        t, d = np.where(ctx < 0, 0, m.total[ctx]) if len(m.ctx) else np.zeros(len(own)), np.where(ctx < 0, 0, m.distinct[ctx]) if len(m.ctx) else np.zeros(len(own))
        seen = longer >= 0
        if seen.any():  # then the shorter context has been seen too
            t[seen] -= model[k + 1].shared[longer[seen]]
            d[seen] -= model[k + 1].distinct[longer[seen]]
        entry = _at(own, m.code)
        hit = entry >= 0
        out[left[hit]] += np.log10(m.n[entry[hit]] / (t[hit] + d[hit]))
        some = ~hit & (d > 0)
        out[left[some]] += np.log10(d[some] / (t[some] + d[some]))
        left, longer = left[~hit], ctx[~hit]
    out[left] -= math.log10(max(1, SYMBOLS - len(model[0].code)))
    return out


def adaptive_bits(text: str, order: int = ORDER) -> float:
    """Code length in bits of one text by PPM (method C, exclusion) that starts empty; symbol by symbol, for single texts."""
    table: dict[bytes, dict[int, int]] = {}
    s = text.encode().translate(bytes(LOWER))
    bits = 0.0
    for i in range(len(s) + 1):
        x = s[i] if i < len(s) else 256
        out: set[int] = set()
        p = 1.0
        for k in range(min(order, i), -1, -1):
            c = {y: n for y, n in table.get(s[i - k : i], {}).items() if y not in out}
            if not c:
                continue
            t = sum(c.values()) + len(c)
            if x in c:
                p *= c[x] / t
                break
            p *= len(c) / t
            out |= set(c)
        else:
            p /= max(1, SYMBOLS - len(out))
        bits -= math.log2(p)
        for k in range(min(order, i) + 1):
            own = table.setdefault(s[i - k : i], {})
            own[x] = own.get(x, 0) + 1
    return bits


def train_low(texts: DataFrame) -> tuple[list[Level], int, int]:
    """Levels of orders below NEAR, and the numbers of words and texts, of a one-column DataFrame."""
    got = texts.mapInArrow(_low, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = got["code"].to_numpy(), got["n"].to_numpy()
    by = np.argsort(code)
    code, n = code[by], n[by]
    real = code >= 0
    sums = dict(zip(code[~real].tolist(), n[~real].tolist(), strict=True))
    return levels(code[real], n[real], NEAR - 1, 0, []), sums.get(-1, 0), sums.get(-2, 0)


def _lower(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(table["text"] if isinstance(table, pa.Table) else table.column("text"))
    return (LOWER[data] if len(data) else data), off


_ZSTD = pa.Codec("zstd", 1)


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, compressed."""
    return _ZSTD.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), asbytes=True)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(_ZSTD.decompress(data, n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _parts(code: np.ndarray, n: int) -> np.ndarray:
    """The part of each code: it has all contexts that share their last NEAR bytes."""
    return (mix(((code >> 8) & ((1 << 8 * NEAR) - 1)).astype(U) + U(1)) % U(n)).astype(np.int32)


def asked(table: pa.Table, n: int):
    """What a block asks: for codes (0) and words (1), the sorted distinct values, the part of each, where each place's value is among them; texts' starts."""
    data, off = _lower(table)
    code, start = coded(data, off)
    u, at = distinct(code)
    yield 0, u, _parts(u, n), at, start
    del code, u, at
    _, _, first, h = words(data, off)
    u, at = distinct(signed(h))
    yield 1, u, (u.view(U) % U(n)).astype(np.int32), at, first


def _ask(slots: list[int]):
    """Of each block and kind: a row for each part, with the values and how often the block's training texts hold them."""

    def run(batches):
        table = gathered(batches)
        if table is None:
            return
        for b in np.unique(table["b"].to_numpy()):
            own = table.filter(pa.compute.equal(table["b"], int(b)))
            train = ~own["held"].to_numpy(zero_copy_only=False)
            for kind, u, part, at, first in asked(own, len(slots)):
                n = np.bincount(at, np.repeat(train, np.diff(first)), len(u)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                cuts = np.append(np.flatnonzero(np.append(True, np.diff(part[by]) != 0)), len(u)) if len(u) else [0]
                rows = [(slots[part[by[i]]], j - i, pack(np.diff(u[by[i:j]], prepend=0)), pack(n[by[i:j]])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                for k in range(0, len(rows), 500):
                    to, size, x, m = zip(*rows[k : k + 500], strict=True)
                    columns = [pa.array(to, pa.int32()), pa.array([b] * len(to), pa.int32()), pa.array([kind] * len(to), pa.int32()), pa.array(size, pa.int32()), pa.array(x, pa.binary()), pa.array(m, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["to", "b", "kind", "size", "x", "n"])
        del table
        trim()

    return run


def _merged(table: pa.Table, kind: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a kind; distinct values asked, their counts, and where those of each row are among them, end to end."""
    own = table.filter(pa.compute.equal(table["kind"], kind))
    size = own["size"].to_pylist()
    if not size:
        return own, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.concatenate([np.cumsum(unpack(v.as_py(), k, np.int64)) for v, k in zip(own["x"], size, strict=True)])
    n = np.concatenate([unpack(v.as_py(), k, np.int32) for v, k in zip(own["n"], size, strict=True)])
    u, at = distinct(x)
    return own, u, np.bincount(at, n, len(u)).astype(np.int64), at


def _answer(low):
    """Per row asked: log10 probabilities of codes as float32, corpus counts of words as int64."""

    def run(batches):
        table = gathered(batches)
        if table is None:
            return
        for to in np.unique(table["to"].to_numpy()):
            part = table.filter(pa.compute.equal(table["to"], int(to)))
            for kind in (0, 1):
                own, u, c, at = _merged(part, kind)
                if kind == 0 and len(u):
                    known = c > 0
                    c = code_logs(u, levels(u[known], c[known], ORDER, NEAR, low.value)).astype(np.float32)
                cuts = np.concatenate([[0], np.cumsum(own["size"].to_numpy())])
                for k in range(0, own.num_rows, 500):
                    few = own.slice(k, 500)
                    y = [pack(c[at[i:j]]) for i, j in zip(cuts[k : k + few.num_rows], cuts[k + 1 : k + 1 + few.num_rows], strict=True)]
                    yield pa.RecordBatch.from_arrays([few[x].combine_chunks() for x in ("to", "b", "kind", "size")] + [pa.array(y, pa.binary())], names=["to", "b", "kind", "size", "y"])
        del table
        trim()

    return run


def _vocabulary(batches):
    table = gathered(batches)
    if table is not None:
        for to in np.unique(table["to"].to_numpy()):
            _, _, n, _ = _merged(table.filter(pa.compute.equal(table["to"], int(to))), 1)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())])], names=["v"])


def _score(slots: list[int], ends: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {}
        for r in right.to_pylist():
            got[r["kind"], r["to"]] = unpack(r["y"], r["size"], np.int64 if r["kind"] else np.float32)
        out = {"doc_id": left["doc_id"], "held_out": left["held"]}
        n = left.num_rows
        for kind, u, part, at, first in asked(left, len(slots)):
            answer = np.zeros(len(u), np.int64 if kind else np.float32)
            by = np.argsort(part, kind="stable")
            if len(u):
                answer[by] = np.concatenate([got[kind, slots[p]] for p in np.unique(part)])
            row = np.repeat(np.arange(n), np.diff(first))
            if kind == 0:
                score = np.bincount(row, answer[at], n)
            else:
                out["n_tokens"] = np.diff(first) + 1
                out["n_known"] = np.bincount(row, answer[at] > 0, n).astype(np.int64) + (ends > 0)
                out["logs"] = np.bincount(row, np.log10(answer + 1.0)[at], n) + math.log10(ends + 1)
        return pa.table(out | {"score": score})

    return run


def _slots(spark, n: int) -> list[int]:
    """A value for each of n partitions that Spark deals to that partition alone, so that parts and blocks are dealt evenly."""
    to = spark.range(32 * n, numPartitions=1).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to")).toArrow()["to"].to_numpy()
    return np.unique(to, return_index=True)[1].tolist()


def ppm_scores(docs: DataFrame) -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    tune(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held")
    low, n_words, n_texts = train_low(docs.where(~held).select(F.col("text").cast("string").alias("text")))
    n = n_buckets(docs)
    slots = _slots(spark, n)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held)
    block = F.get(F.lit(slots), F.pmod(F.xxhash64("doc_id", "text"), F.lit(len(slots))).cast("int"))
    dealt = kept.withColumn("b", block.cast("int")).repartition(n, "b")
    questions = dealt.mapInArrow(_ask(slots), "to int, b int, kind int, size int, x binary, n binary").repartition(n, "to")
    answers = questions.mapInArrow(_answer(spark.sparkContext.broadcast(low)), "to int, b int, kind int, size int, y binary")
    vocab = questions.mapInArrow(_vocabulary, "v long").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")).scalar()
    out = dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(_score(slots, n_texts), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    total = n_words + n_texts
    denominator = F.log10((F.lit(total) + vocab + F.lit(int(n_texts > 0)) + 1).cast("double"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * denominator).alias("base_score"), "score")


def op5_ppm_scoring(spark, sf_dir: str) -> DataFrame:
    return ppm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
