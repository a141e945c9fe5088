"""The chunked dataset as a data source: partitions, columns and ranges of ordinals that are asked for are what is read.

A partition is a chunk. Its task opens the files of the asked columns only, reads a header, and goes on only if the chunk holds an ordinal that is asked for. Of an
uncompressed chunk it reads the lengths and the bytes of the asked records; a gzipped one is inflated up to the last of them. Columns of a chunk come side by side from
one task, so nothing is shuffled.

    spark.dataSource.register(AgdSource)
    spark.read.format("agd_chunks").schema("ordinal long, prot binary").option("first", 5).option("last", 9).load(manifest)

Without a schema all columns are read. With the option push=true, conditions on `ordinal` are taken from a query as well, which asks for spark.sql.python.filterPushdown.enabled. Where the manifest's records name their
first and last ordinals, chunks outside are no partitions at all. Files are opened by the tasks through Arrow's file systems; `genomes.read_agd_files` reads stores that only Spark reaches.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .formats import BASES, GZIP, HEADER, RAW, unpack_bases

EVERY = (0, 1 << 62)
STEP = 1 << 20


def opened(path: str):
    fs, at = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (pa_fs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def manifest_of(path: str) -> dict:
    with opened(path) as f:
        return json.loads(f.read())


@dataclass
class Chunk(InputPartition):
    base: str


def inflated(read, upto: int) -> bytes:
    """The first bytes of a gzipped body, read in steps."""
    engine, out, n = zlib.decompressobj(31), [], 0
    while n < upto and not engine.eof:
        raw = read(STEP)
        if not raw:
            break
        out.append(engine.decompress(raw))
        n += len(out[-1])
        while engine.eof and engine.unused_data and n < upto:  # gzip members may follow each other
            rest, engine = engine.unused_data, zlib.decompressobj(31)
            out.append(engine.decompress(rest))
            n += len(out[-1])
    return b"".join(out)


def read_records(path: str, low: int, high: int) -> tuple[int, list[bytes], int] | None:
    """(first ordinal, records, bytes read) of a column's chunk within low..high, or None where it holds none."""
    with opened(path) as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size:
            raise ValueError("chunk is shorter than its header")
        *_, kind, packed, start, _pad, first, last, _name = HEADER.unpack(head)
        if packed not in (RAW, GZIP):
            raise ValueError("compression of this kind is not supported")
        a, b = max(low, first), min(high, last - 1)
        if a > b:
            return None
        n, i, j = last - first, a - first, b - first + 1
        f.seek(start)
        if packed == GZIP:
            body = inflated(f.read, 4 * n)
            ends = _ends(body, n)
            if len(body) < 4 * n + ends[j]:
                f.seek(start)
                body = inflated(f.read, 4 * n + int(ends[j]))
            data = body[4 * n + int(ends[i]) : 4 * n + int(ends[j])]
        else:
            ends = _ends(f.read(4 * n), n)
            f.seek(start + 4 * n + int(ends[i]))
            data = f.read(int(ends[j] - ends[i]))
        if len(data) < ends[j] - ends[i]:
            raise ValueError("chunk is cut short")
        got = f.tell()
    cuts = (ends[i : j + 1] - ends[i]).tolist()
    records = [data[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
    return a, [unpack_bases(r).encode() for r in records] if kind == BASES else records, got


def _ends(index: bytes, n: int) -> np.ndarray:
    if len(index) < 4 * n:
        raise ValueError("chunk is cut short")
    return np.concatenate([[0], np.cumsum(np.frombuffer(index[: 4 * n], "<u4").astype(np.int64))])


class AgdReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, low: int, high: int):
        self.columns, self.path, self.low, self.high = [f.name for f in schema.fields], path, low, high
        self.doc = manifest_of(path)
        missing = set(self.columns) - set(self.doc["columns"]) - {"ordinal"}
        if missing:
            raise ValueError(f"dataset has no column {sorted(missing)}")

    def partitions(self):
        folder = self.path.rpartition("/")[0]
        full = lambda p: p if p.startswith("/") or "://" in p else f"{folder}/{p}"
        own = [r for r in self.doc["records"] if r.get("first", 0) <= self.high and r.get("last", EVERY[1]) > self.low]
        return [Chunk(full(r["path"])) for r in own] or [Chunk("")]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.base:
            return
        named = [c for c in self.columns if c != "ordinal"] or self.doc["columns"][:1]  # ordinals alone are those of any column
        found = [read_records(f"{partition.base}.{c}", self.low, self.high) for c in named]
        if found[0] is None:
            return
        if len({(f[0], len(f[1])) for f in found if f}) > 1 or None in found:
            raise ValueError("columns of a chunk differ in their records")
        by = dict(zip(named, found, strict=True))
        first, records, _ = found[0]
        ordinals = pa.array(np.arange(first, first + len(records)))
        yield pa.RecordBatch.from_arrays([ordinals if c == "ordinal" else pa.array(by[c][1], pa.binary()) for c in self.columns], names=self.columns)


class FilteringReader(AgdReader):
    """Takes conditions on ordinals; a session that does not push filters refuses readers that can, so it has a class of its own."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("ordinal",):
                low, high = self.low, self.high
                match f:
                    case EqualTo(value=v):
                        low, high = v, v
                    case In(value=v):
                        low, high = (min(v), max(v)) if v else (1, 0)
                    case GreaterThan(value=v):
                        low = v + 1
                    case GreaterThanOrEqual(value=v):
                        low = v
                    case LessThan(value=v):
                        high = v - 1
                    case LessThanOrEqual(value=v):
                        high = v
                self.low, self.high = max(self.low, low), min(self.high, high)
                if not isinstance(f, In) and type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                    continue  # done here in full
            yield f


class AgdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agd_chunks"

    def schema(self) -> StructType:
        return StructType([StructField("ordinal", LongType()), *[StructField(c, BinaryType()) for c in manifest_of(self.options["path"])["columns"]]])

    def reader(self, schema: StructType) -> AgdReader:
        kind = FilteringReader if self.options.get("push") == "true" else AgdReader
        return kind(schema, self.options["path"], int(self.options.get("first", EVERY[0])), int(self.options.get("last", EVERY[1])))
