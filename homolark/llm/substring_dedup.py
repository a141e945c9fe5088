"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

The corpus is dealt into blocks (buckets of documents). Every block is indexed by sampled anchors: minimisers of
`ANCHOR`-word hashes, of which each window of `window` words holds one, so equal windows share an anchor. Where an
anchor occurs in more than one place, the windows around it are looked up exactly, over all blocks, and get their earliest source. A
document is then parsed into factors: a factor starts at the first window that has an earlier occurrence and grows while the next
window continues the same source; where it ends, the windows across the boundary begin factors of their own sources, so
no repeated window is missed at a seam. Factors are the duplicate spans, and what they cover is removed.

A factor follows the earliest source of its first window, not the longest match: whether another source of that window would
match further is known only where its text is, and the words that factors cover together do not depend on that choice.

Passes over the text read one exchange of the documents; only hashes travel otherwise, one row per hash and block,
so a passage that a third of all documents share costs one row per block.

Order of occurrences: (doc_id, start). Rows with a null doc_id come first, in order of a hash of the text (ids below -2^62 share their
order), each a document. Rows that share a doc_id count as one document whose texts follow each other in text order, without windows
across them. Null text has no words. Texts of any length are parsed whole, an empty table gives an empty result, and columns other than
doc_id and text are not read. Windows are compared by 96 bits from two independent hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST_ID, U, as_batches, bucketed, gathered, join_hash, longs, member, mix, on_blocks, on_key, signed, trim, trimmed, tune, utf8, words

WINDOW = 20
ANCHOR = 8

FIRST = "h long, b int, multi boolean"
WINDOWS = "h long, c int, b int, doc long, pos long, multi boolean"
FOUND = "b int, h long, c int, here boolean, doc long, pos long"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:long,length:long,src_doc:long,src_start:long>>"


_Q = 0xA0761D6478BD642F
_QI = pow(_Q, -1, 1 << 64)


def geometric(q: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(U(1), np.full(max(0, n - 1), q, U)))[:n]


class Block:
    """A block's rows in document order, with the hashes of its windows."""

    def __init__(self, table: pa.Table, window: int):
        ids = longs(table["ord"])
        text = table["text"].fill_null("")
        order = np.argsort(ids, kind="stable")
        twice = np.flatnonzero(np.diff(ids[order]) == 0)
        if len(twice):
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i].as_py())), np.int64)
        self.table = table.take(pa.array(order))
        self.ids = ids[order]
        self.data, self.off = utf8(self.table["text"])
        self.starts, self.ends, self.first, h, check = words(self.data, self.off, 2)
        self.window = window
        n = len(h)
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        base = np.searchsorted(self.ids, self.ids)  # first row of the same doc_id
        self.pos = np.arange(n) - self.first[base][self.row] if n else np.zeros(0, np.int64)
        room = self.first[1:][self.row] - np.arange(n) if n else np.zeros(0, np.int64)
        self.whole = room >= window  # a window starts here
        grams: dict[int, np.ndarray] = {1: h}
        power = geometric(_Q, n)
        self.sums, self.back = np.concatenate([np.zeros(1, U), np.cumsum(check * power)]), geometric(_QI, n)

        def gram(k: int) -> np.ndarray:  # of k words from each position; short at the end
            if k not in grams:
                half = 1 << (k.bit_length() - 1)
                half = half // 2 if half == k else half
                a, b = gram(half), gram(k - half)
                m = max(0, n - k + 1)
                grams[k] = join_hash(a[:m], b[half : half + m])
            return grams[k]

        self.gram = gram

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all windows."""
        g = self.gram(self.window)
        at = np.flatnonzero(self.whole[: len(g)])
        return at, g[at]

    def checks(self, at: np.ndarray) -> np.ndarray:
        """32 more bits of the windows at these places, from independent word hashes."""
        return (mix((self.sums[at + self.window] - self.sums[at]) * self.back[at]) >> U(32)).astype(np.uint32).view(np.int32)

    def minimisers(self, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """Each window's smallest anchor hash (by position), and the anchor hashes that some window selects."""
        g = self.gram(anchor)
        span = self.window - anchor + 1
        m = max(0, len(g) - span + 1)
        low, width = g, 1
        while width * 2 <= span:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        low = np.minimum(low[:m], low[span - width : span - width + m])
        held = np.where(self.whole[:m], low, U(0))
        top, width = np.concatenate([np.zeros(span - 1, U), held, np.zeros(span - 1, U)]), 1
        while width * 2 <= span:
            top, width = np.maximum(top[:-width], top[width:]), width * 2
        top = np.maximum(top[: len(g)], top[span - width : span - width + len(g)])
        return low, g[(top == g) & (g > 0)]


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Of sorted columns: where a group of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _anchors(window: int, anchor: int):
    def run(batches):
        table = gathered(batches)
        if table is None:
            return
        for b in np.unique(table["b"].to_numpy()):
            block = Block(table.filter(pa.compute.equal(table["b"], int(b))), window)
            h, n = np.unique(block.minimisers(anchor)[1], return_counts=True)
            yield from as_batches(pa.table({"h": signed(h), "b": np.full(len(h), b, np.int32), "multi": n > 1}), rest=False)
        del table, block
        trim()

    return run


def _repeated(batches):
    """Of one row for each hash and block: those whose hash is in several places."""
    table = gathered(batches)
    if table is None:
        return
    h, b, multi = table["h"].to_numpy(), table["b"].to_numpy(), table["multi"].to_numpy(zero_copy_only=False)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    many = multi[order].copy()
    many[1:] |= same
    many[:-1] |= same
    at = order[many]
    yield from as_batches(pa.table({"b": b[at], "h": h[at]}))


def _windows(window: int, anchor: int):
    @trimmed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"h": np.zeros(0, np.int64), "c": np.zeros(0, np.int32), "b": np.zeros(0, np.int32), "doc": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64), "multi": np.zeros(0, bool)}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        block = Block(left, window)
        low, _ = block.minimisers(anchor)
        at, h = block.hashes()
        hit = member(low[at], np.unique(right["h"].to_numpy().view(U)))
        at, h = at[hit], h[hit]
        c = block.checks(at)
        order = np.lexsort((c, h))  # stable: the first place of a window comes first
        head = np.flatnonzero(_fresh(h[order], c[order]))
        n, where = np.diff(np.append(head, len(order))), order[head]
        order = np.argsort(where)  # in text order, neighbours differ little and pack well
        n, where = n[order], where[order]
        first, c, p = h[where], c[where], at[where]
        return pa.table({"h": signed(first), "c": c, "b": np.full(len(p), left["b"][0].as_py(), np.int32), "doc": block.ids[block.row[p]], "pos": block.pos[p], "multi": n > 1})

    return run


def _earliest(batches):
    """For each window hash found in several places: to every block with a later one, whether the first is its own, and that one's place."""
    table = gathered(batches)
    if table is None:
        return
    h, check, b, doc, pos = (table[x].to_numpy() for x in ("h", "c", "b", "doc", "pos"))
    multi = table["multi"].to_numpy(zero_copy_only=False)
    order = np.lexsort((pos, doc, check, h))
    s = h[order]
    new = _fresh(s, check[order])
    head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    size = np.diff(np.append(np.flatnonzero(new), len(s)))
    many = (np.repeat(size, size) > 1) | multi[order]
    at, src = order[many], order[head[many]]
    here = b[at] == b[src]
    later = multi[at] | ~here  # a block that holds only the first has nothing to remove
    at, src = at[later], src[later]
    pack = np.lexsort((pos[src], doc[src], b[at]))
    at, src = at[pack], src[pack]
    yield from as_batches(pa.table({"b": b[at], "h": h[at], "c": check[at], "here": b[at] == b[src], "doc": doc[src], "pos": pos[src]}))


def _parse(window: int):
    @trimmed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, window)
        n = len(block.starts)
        at, h = block.hashes()
        dup = src_doc = src_pos = np.zeros(0, np.int64)
        if right.num_rows and len(at):
            key, check = right["h"].to_numpy().view(U), right["c"].to_numpy()
            order = np.lexsort((check, key))
            key, check = key[order], check[order]
            hit = np.flatnonzero(member(h, key))
            own = block.checks(at[hit])
            k = np.searchsorted(key, h[hit])
            while ((off := check[k] != own) & (more := (k + 1 < len(key)) & (key[np.minimum(k + 1, len(key) - 1)] == key[k]))).any():
                k[off & more] += 1  # windows of equal hash stand next to each other
            hit, k = hit[~off], k[~off]
            here = right["here"].to_numpy(zero_copy_only=False)[order][k]
            src_doc, src_pos = right["doc"].to_numpy()[order][k], right["pos"].to_numpy()[order][k]
            p = at[hit]
            own = here & (block.ids[block.row[p]] == src_doc) & (block.pos[p] == src_pos)
            dup, src_doc, src_pos = p[~own], src_doc[~own], src_pos[~own]
        # a factor goes on while the next window follows in the text and in the source; where it ends, the windows across the boundary
        # may begin factors of other sources, which overlap it
        fresh = np.ones(len(dup), bool)
        fresh[1:] = (np.diff(dup) != 1) | (np.diff(src_pos) != 1) | (np.diff(src_doc) != 0) | (np.diff(block.row[dup]) != 0)
        f = np.flatnonzero(fresh)
        length = np.diff(np.append(f, len(dup))) + window - 1
        gone = np.zeros(n + 1, np.int64)  # factors are the duplicate spans
        np.add.at(gone, dup[f], 1)
        np.add.at(gone, dup[f] + length, -1)
        removed = np.cumsum(gone[:n]) > 0
        per_row = np.bincount(block.row[dup[f]], minlength=len(block.ids)) if len(f) else np.zeros(len(block.ids), np.int64)
        local = dup[f] - block.first[block.row[dup[f]]] if len(f) else dup
        struct = pa.StructArray.from_arrays([pa.array(local), pa.array(length, pa.int64()), pa.array(src_doc[f], mask=src_doc[f] < FIRST_ID), pa.array(src_pos[f])], ["start", "length", "src_doc", "src_start"])
        factors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), struct)
        lost = np.concatenate([[0], np.cumsum(removed)])
        n_removed = lost[block.first[1:]] - lost[block.first[:-1]]
        raw = block.data.tobytes()
        kept = []
        for i in range(len(block.ids)):
            w = raw[block.off[i] : block.off[i + 1]].split()
            if n_removed[i]:
                w = [x for x, r in zip(w, removed[block.first[i] : block.first[i + 1]].tolist(), strict=True) if not r]
            kept.append(b" ".join(w))
        return pa.table({"doc_id": block.table["doc_id"], "n_words": np.diff(block.first), "n_removed": n_removed, "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "factors": factors})

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of `docs`: n_words, n_removed, kept_text (kept words, one space between) and its factors."""
    tune(docs.sparkSession)
    dealt, n = bucketed(docs)
    places = on_key(on_blocks(dealt, n, _anchors(window, anchor), FIRST), n, "h", _repeated, "b int, h long")
    seen = dealt.groupBy("b").cogroup(places.groupBy("b")).applyInArrow(_windows(window, anchor), WINDOWS)
    found = on_key(seen, n, "h", _earliest, FOUND)
    return dealt.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(_parse(window), RESULT)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as (
  select doc_id, i, array_to_string(ws[i:i + 19], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
d as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as k from g) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from d),
lost as (select doc_id, list(p) as ps from gone group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(array_to_string(case when ps is null then ws else
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: not list_contains(ps, x[2])), lambda x: x[1]) end, ' ')) as kept_sha256
from w left join lost using (doc_id)
"""
