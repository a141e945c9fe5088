"""Compression of vectors into one byte a part: a codebook for each part position, fitted in rounds over all vectors.

Components become integers (floor of 1024 x), so that distances, sums and means are whole numbers and results do not depend on the order of rows. A
vector is cut into equal parts; each part takes the nearest entry of its position's codebook (ties: the lower index), and a round replaces each entry by
the floor of the mean of its parts. Entries that no part took stay.

The nearest entry is found by a vantage-point tree over a codebook's entries: a node keeps an entry, and for the entries nearer and farther than the
median the range of their distances to it. A part first goes down to the side where it lies, for a first bound; then it visits every side whose
range, by the triangle inequality, may hold an entry as near as the best. Ranges are widened by more than their rounding, sides that can only tie are
visited, and what decides is the squared distance in integers.

A task sums its parts by entry, so that a round shuffles one row for each task, entry and component; the driver holds the codebooks alone, of
`entries` times the vectors' dimension.

Vectors that are null, empty or hold null, NaN or infinite components are dropped. A null vec_id stays and never seeds a codebook before others do; rows
that share a vec_id are all coded and seed in the order of their components. Fewer vectors than entries make smaller codebooks. All vectors must have one
length that the parts divide, and components below 2^15 in size, else the job fails. Null labels are one label. An empty table gives an empty result,
and columns other than the id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, trim, tune

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 25  # of an integer component, so that no squared distance of up to 1024 components leaves 62 bits
LEAF = 8
ROWS = 16_384  # vectors that are searched together
SLACK = 1e-9  # more than the rounding of a root and a product
FEW_LABELS = 100_000


class Tree:
    """Vantage-point tree over integer points; `nearest` is exact."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.top = self._node(np.arange(len(points)))

    def _node(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        d = np.sqrt(((self.points[at] - self.points[at].mean(0)) ** 2).sum(1))
        pivot = at[int(d.argmax())]  # far from the middle, so that the ranges differ
        rest = at[at != pivot]
        d = np.sqrt(self._squares(self.points[rest], self.points[pivot][None])[:, 0].astype(float))
        median = np.partition(d, len(d) // 2)[len(d) // 2]
        near = d < median
        sides = [(d[s].min() * (1 - SLACK), d[s].max() * (1 + SLACK), self._node(rest[s])) for s in (near, ~near) if s.any()]
        return pivot, median, sides

    @staticmethod
    def _squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = q[:, None, :] - c[None]
        return np.einsum("ijk,ijk->ij", d, d)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point (ties: the lower index) and its squared distance, of each row of integers."""
        best, entry = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), len(self.points))

        def offer(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            d = self._squares(q[rows], self.points[at])
            k = d.argmin(1)  # `at` ascends, so the first is the lowest
            low, e = d[np.arange(len(rows)), k], at[k]
            up = (low < best[rows]) | ((low == best[rows]) & (e < entry[rows]))
            best[rows[up]], entry[rows[up]] = low[up], e[up]
            return d

        def descend(node, rows: np.ndarray) -> None:
            while len(rows):
                if isinstance(node, np.ndarray):
                    offer(rows, node)
                    return
                pivot, median, sides = node
                d = np.sqrt(offer(rows, np.array([pivot]))[:, 0].astype(float))
                for (_, _, child), own in zip(sides[:-1], (rows[d < median],), strict=False):
                    descend(child, own)
                node, rows = sides[-1][2], rows[d >= median] if len(sides) > 1 else rows

        def search(node, rows: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                offer(rows, node)
                return
            pivot, _, sides = node
            d = np.sqrt(offer(rows, np.array([pivot]))[:, 0].astype(float))
            for low, high, child in sides:
                gap = np.maximum(low - d * (1 + SLACK), d * (1 - SLACK) - high)
                may = (gap <= 0) | (gap * gap <= best[rows] * (1 + SLACK))
                if may.any():
                    search(child, rows[may])

        if len(q) and len(self.points):
            every = np.arange(len(q))
            descend(self.top, every)
            search(self.top, every)
        return entry, best


@dataclass
class Codebooks:
    """books[part]: integer entries (entries x width)."""

    books: list[np.ndarray]
    scale: int = SCALE

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances (rows x parts) of integer vectors."""
        width = x.shape[1] // len(self.books)
        found = [Tree(b).nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width])) for p, b in enumerate(self.books)]
        return np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors that codes stand for: the middle of each integer component's interval."""
        return (np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1) + 0.5) / self.scale

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the vectors that are whole."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def integers(column: pa.Array, scale: int, dim: int | None = None) -> np.ndarray:
    """Integer components (rows x dimension)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.floor(a.flatten().to_numpy(zero_copy_only=False) * scale)
    if len(x) % max(1, len(a)) or len(np.unique(np.diff(a.offsets.to_numpy()))) > 1 or (dim and len(x) != dim * len(a)):
        raise ValueError("vectors differ in length")
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST // scale}")
    return x.astype(np.int64).reshape(len(a), -1)


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to `ROWS` rows."""
    some, n = [], 0
    for b in batches:
        if b.num_rows:
            some.append(b)
            n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def seeds(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Parts of the vectors of the smallest ids."""
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not first:
        return Codebooks([np.zeros((0, 0), np.int64)] * parts, scale)
    x = integers(pa.array([r.v for r in first], pa.list_(pa.float64())), scale)
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} components cannot be cut into {parts} equal parts")
    return Codebooks([b.copy() for b in np.split(x, parts, 1)], scale)


def refit(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floor of the mean of the parts that take them."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # entries x dimension
    parts, (entries, width) = len(books.books), books.books[0].shape

    def sums(batches):
        own, total, n = shared.value, np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for t in _batches(batches):
            x = integers(t["v"], own.scale, parts * width)
            codes, _ = own.encode(x)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])
        trim()

    each = rows.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    each = each.select("part", "entry", "n", F.posexplode("total").alias("k", "total")).groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = [b.copy() for b in books.books]
    for r in each.collect():  # at most entries x dimension
        out[r.part][r.entry, r.k] = r.total // r.n
    return Codebooks(out, books.scale)


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of kept rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    dim = sum(b.shape[1] for b in books.books)
    kind = dict(rows.dtypes)["label"]

    def run(batches):
        for t in _batches(batches):
            codes, squares = shared.value.encode(integers(t["v"], shared.value.scale, dim))
            texts = codes.astype(np.uint8).tobytes().hex()
            step = 2 * codes.shape[1]
            code = pa.array([texts[i : i + step] for i in range(0, len(texts), step)], pa.string())
            yield from pa.table({"vec_id": t["vec_id"], "label": t["label"], "code": code, "error": pa.array(squares.sum(1))}).combine_chunks().to_batches()
        trim()

    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding") -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of all whole vectors, checkpointed, and the codebooks; two hex digits a part, so 256 entries at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    tune(vectors.sparkSession)
    rows = kept(vectors, vector)
    books = seeds(rows, parts, entries, scale)
    if books.books[0].size:
        for _ in range(rounds):
            books = refit(rows, books)
    return cut(coded(rows, books)), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with the error summed over rows of equal label; sums are made in each task first, and few labels are sent to all tasks."""
    totals = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    return codes.join(totals, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [f"""with u as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select row_number() over (order by vec_id nulls last, v) as r, * from u),
x as materialized (select r, vec_id, label, p, v[(p * len(v) // {PARTS} + 1):((p + 1) * len(v) // {PARTS})] as q from v, unnest(range({PARTS})) as t(p)),
b0 as materialized (select p, r - 1 as e, q as c from x where r <= {ENTRIES})"""]
    near = "list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c)"
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} as materialized (select r, p, any_value(q) as q, min(({near})::hugeint * {ENTRIES} + e) as m from x join b{k} using (p) group by r, p)")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} as materialized (select p, e, coalesce(n.c, b.c) as c from b{k} b left join (select p, e, list(floor(s / n) order by i) as c from (
  select p, (m % {ENTRIES})::bigint as e, i, sum(q[i]) as s, count(*) as n from a{k}, unnest(range(1, len(q) + 1)) as t(i) group by 1, 2, 3) group by p, e) n using (p, e))""")
    last = ROUNDS
    steps.append(f"""d as (select any_value(vec_id) as vec_id, any_value(label) as label, string_agg(lower(printf('%02x', (m % {ENTRIES})::bigint)), '' order by p) as code, sum(m // {ENTRIES})::bigint as error
  from a{last} join x using (r, p) group by r),
h as (select sha256(string_agg(array_to_string(list_transform(c, lambda y: y::bigint::varchar), ','), ',' order by p, e)) as codebooks_sha256 from b{last})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from d, h""")
    return ",\n".join(steps)


ORACLE_SQL = _sql()
