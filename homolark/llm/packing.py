"""Hierarchical multi-length packing of documents into training sequences.

A document's ids are cut into full windows of the longest tier; the rest is routed to the smallest tier that holds
it. Each tier is packed, the longest first: an item opens a window of its tier, and the gap is filled from shorter tiers, whole items
first, longest first, then a cut one. Where shorter tiers have run out, items are laid end to end in windows of their own tier,
cut at the seams; what does not fill a window waits for the task's next batch. What a task has left in the end is laid in the next shorter
tier and at last cut at powers of two, so no sequence needs padding.

A step group holds `STEP_TOKENS` tokens in sequences of one tier; groups that a task cannot complete are joined over tiers, so at
most one group a task holds fewer. Rows of an open group are held back (at most `STEP_TOKENS` tokens a tier).

Documents are packed where they are read: no shuffle, memory of one batch, and the same result when a task is run
again on the same file split. sequence_id is the task's number << 32 plus a running number.

Null text is an empty document (only the end id). A text of any length is cut, never dropped. Rows are independent: repeated or null doc_ids are
kept, and ties in length go in order of arrival. An empty table gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .tokens import encoder

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 1 << 16
JOINED = 15  # in place of a window's logarithm in the number of a step that joins tiers
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step long"


class Packer:
    """Packs items (document, start, length); `out` gets (item, start, length, sequence, offset) and `tier_of` each sequence's window.

    `left` are items of which no window of their tier can be filled; there are none after the `last` batch.
    """

    def __init__(self, tiers=TIERS):
        self.tiers = tiers
        self.top = tiers[-1]
        self.out: list[tuple[int, int, int, int, int]] = []
        self.tier_of: list[int] = []
        self.left: list[tuple[int, int, int]] = []

    def _open(self, window: int) -> int:
        self.tier_of.append(window)
        return len(self.tier_of) - 1

    def pack(self, lengths: list[int], last: bool = True) -> None:
        tiers = self.tiers
        rest: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        for doc, n in enumerate(lengths):
            a = 0
            while n - a >= self.top:
                self.out.append((doc, a, self.top, self._open(self.top), 0))
                a += self.top
            if n > a:
                rest[next(t for t in tiers if n - a <= t)].append((doc, a, n - a))
        for t in tiers:
            rest[t].sort(key=lambda x: x[2])  # the longest is taken first
        for i in range(len(tiers) - 1, -1, -1):
            t, shorter = tiers[i], tiers[:i]
            while rest[t] and any(rest[s] for s in shorter):
                doc, a, n = rest[t].pop()
                s, at = self._open(t), n
                self.out.append((doc, a, n, s, 0))
                while 0 <= at < t:
                    at = self._fill(rest, shorter, s, at, t)
                if at < 0:  # shorter tiers ran out
                    self._close(s, rest, t)
            over = self._lay(rest[t][::-1], t)
            if not last:
                self.left += over
            elif i:
                rest[tiers[i - 1]] += over[::-1]
            else:
                self._halve(over)

    def _fill(self, rest, shorter, s, at, t) -> int:
        gap = t - at
        for k in reversed(shorter):
            own = rest[k]
            if own and own[0][2] <= gap:  # some whole item fits: the longest that does
                lo, hi = 0, len(own)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if own[mid][2] <= gap else (lo, mid)
                doc, a, n = own.pop(lo - 1)
                self.out.append((doc, a, n, s, at))
                return at + n
        for k in shorter:
            if rest[k]:
                doc, a, n = rest[k].pop()
                self.out.append((doc, a, gap, s, at))
                back = (doc, a + gap, n - gap)
                own = rest[next(x for x in self.tiers if back[2] <= x)]
                lo = next((i for i, x in enumerate(own) if x[2] > back[2]), len(own))
                own.insert(lo, back)
                return t
        return -1

    def _close(self, s, rest, t) -> None:
        """Takes the open window's items back; they are laid end to end in the tier that opened it."""
        while self.out and self.out[-1][3] == s:
            doc, a, n, _, _ = self.out.pop()
            rest[t].insert(0, (doc, a, n))
        self.tier_of.pop()
        rest[t].sort(key=lambda x: x[2])

    def _lay(self, items: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
        """End to end in full windows; what is over."""
        full = sum(x[2] for x in items) // window * window
        s, room, at, over = -1, 0, 0, []
        for doc, a, n in items:
            while n and full:
                if not room:
                    s, room, at = self._open(window), window, 0
                take = min(n, room)
                self.out.append((doc, a, take, s, at))
                a, n, room, at, full = a + take, n - take, room - take, at + take, full - take
            if n:
                over.append((doc, a, n))
        return over

    def _halve(self, items: list[tuple[int, int, int]]) -> None:
        """What is over in the end, in powers of two."""
        window = self.tiers[0]
        while items:
            window >>= 1
            if sum(x[2] for x in items) >= window:
                items = self._lay(items, window)


def _pack(path: str, end: int, tiers: tuple[int, ...], group: int):
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        done = 0  # sequences
        count: dict[int, int] = {}  # sequences of each window
        held: pa.Table | None = None  # pieces of open step groups
        over = None  # ids, doc_id, start, length and tokens of the document of the items that wait

        def flush(ids: list[pa.Array], texts: list[pa.Array], last: bool):
            nonlocal done, held, over
            flat, off = encoder(path).encode(pa.concat_arrays(texts) if texts else pa.array([], pa.string()), end)
            flat, names_of, starts, tokens = flat.astype("<u4"), pa.chunked_array(ids, pa.int64()).combine_chunks(), np.zeros(len(off) - 1, np.int64), np.diff(off)
            size = tokens
            if over:
                flat, off = np.concatenate([over[0], flat]), np.concatenate([[0], np.cumsum(np.append(over[3], size))])
                names_of, starts, size, tokens = pa.concat_arrays([over[1], names_of]), np.append(over[2], starts), np.append(over[3], size), np.append(over[4], tokens)
            p = Packer(tiers)
            p.pack(size.tolist(), last)
            at_left = np.array(sorted(p.left), np.int64).reshape(-1, 3)
            doc, a, n = at_left.T
            over = (_ranges(flat, off[doc] + a, n), names_of.take(pa.array(doc)), starts[doc] + a, n, tokens[doc]) if len(doc) else None
            doc, a, n, s, at = np.array(p.out, np.int64).reshape(-1, 5).T
            first = off[doc] + a
            order = np.argsort(first)
            doc, a, n, s, at, first = doc[order], a[order], n[order], s[order], at[order], first[order]
            blob = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * np.concatenate([[0], np.cumsum(n)])).astype(np.int32)), pa.py_buffer(_ranges(flat, first, n))])
            step = np.zeros(len(p.tier_of), np.int64)
            for i, t in enumerate(p.tier_of):
                step[i] = count.get(t, 0) * t // STEP_TOKENS
                count[t] = count.get(t, 0) + 1
            tier = np.array(p.tier_of, np.int32)
            cols = [names_of.take(pa.array(doc)), pa.array(starts[doc] + a), pa.array(n), blob, pa.array(tokens[doc]), pa.array(base + done + s), pa.array(at), pa.array(tier[s]), pa.array(step[s])]
            done += len(p.tier_of)
            found = pa.table(cols, names=names)
            found = found if held is None else pa.concat_tables([held, found])
            window, step = found["tier"].to_numpy().astype(np.int64), found["step"].to_numpy()
            complete = np.zeros(tiers[-1] + 1, np.int64)
            for t, k in count.items():
                complete[t] = k * t // STEP_TOKENS
            ready = step < complete[window]
            held = found.filter(pa.array(~ready))
            step = base + (step << 4) + np.log2(window).astype(np.int64)
            if last:  # incomplete groups of all tiers follow each other, longest windows first, so none spans a seam
                seq, at = np.unique(found["sequence_id"].to_numpy()[~ready], return_index=True)
                wide = window[~ready][at]
                by = np.argsort(-wide, kind="stable")
                group = np.zeros(len(seq), np.int64)
                group[by] = (np.cumsum(wide[by]) - wide[by]) // STEP_TOKENS
                step[~ready] = base + (group[np.searchsorted(seq, found["sequence_id"].to_numpy()[~ready])] << 4) + JOINED
                ready = np.ones(len(ready), bool)
            found = found.set_column(len(names) - 1, "step", pa.array(step)).filter(pa.array(ready))
            yield from found.combine_chunks().to_batches()

        ids, texts, size, rows = [], [], 0, 0
        for x in batches:
            if x.num_rows:
                ids.append(x.column(0))
                texts.append(x.column(1))
                size += x.nbytes
                rows += x.num_rows
                if size >= group:
                    yield from flush(ids, texts, False)
                    ids, texts, size = [], [], 0
        if rows:
            yield from flush(ids, texts, True)
        ids, texts, held, over = [], [], None, None
        encoder(path).rest()

    return run


def _ranges(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ranges of an array, one after the other."""
    return flat.take(np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()))


def pack(docs: DataFrame, tokenizer: str, end: int, tiers: tuple[int, ...] = TIERS, group_bytes: int = 4 << 20) -> DataFrame:
    """Pieces of all documents: ids are little-endian 32-bit; `tier` is the window of the piece's sequence, `step` its step group."""
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(tokenizer, end, tiers, group_bytes), PIECES)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")
