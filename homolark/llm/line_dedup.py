"""Line dedup by a deletion-neighbourhood join.

A line is what stands between line feeds; its words (ASCII white space between, A-Z lower-cased) are compared. A
line goes if an earlier line has the same words or is within one word edit (insert, delete, replace) of it; lines
of fewer than `MIN_WORDS` words go only for equal words, which keeps one edit at a similarity of 0.8 or more. The
earliest line by (doc_id, line number) stays, and lines without words always stay.

Steps, all on hashes, one row per hash and block:
1. equal lines are told by 128 bits, two independent non-linear hashes of the words in order; a line that could have a neighbour is
   found by its halves, since two lines within one edit share their first or their last half (keys for their own length and for one less);
2. lines with a shared half emit their deletion neighbourhood: the whole line and the line without each word, keyed
   by the hash of what is left and carrying the position. Equal keys at equal positions are replacements; a key that
   equals a whole line is an insertion or deletion;
3. each match to the earliest line is verified: the source's words are fetched once per asking block, and the word
   edit distance is computed.

Keys of parts are sums of word hashes, each times a fixed random odd number that belongs to its place counted from the
line's start or end; they propose candidates only.

Rows with a null doc_id come first, in order of a hash of the text (ids below -2^62 share their order), each a document. Rows that share a doc_id count as one document, texts in text order. Null text
has no lines and is returned as null. A line's earliest neighbour may itself go; it is a repeat all the same. Texts and lines of any
length are handled whole. An empty table gives an empty result. Further columns come back in a struct, so their names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST_ID, LOWER, U, as_batches, bucketed, fold, gathered, longs, member, mix, on_blocks, on_key, trim, trimmed, tune, utf8, words

MIN_WORDS = 5

KEYS = "key long, kind int, lh long, b int, doc long, line int"  # lh: the line's hash; for kind 0 the key is that and lh its second hash
REPLY = "b int, kind int, lh long, lv long, doc long"
VARIANTS = "key long, pos int, b int, doc long, line int, sb int, sdoc long, sline int"
MATCH = "b int, doc long, line int, sb int, sdoc long, sline int"
FINAL = "b int, kind int, lh long, lv long, doc long, line int, sdoc long, sline int, words string"
RESULT = "doc_id long, n_lines long, n_removed long, kept_text string, removed array<struct<line:int,src_doc:long,src_line:int>>"

_factors = np.zeros(0, U)


def factors(n: int) -> np.ndarray:
    """Odd random numbers of places 0 to n - 1."""
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1, max(n, 4096) + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)
    return _factors


class Lines:
    """A block's lines in (doc_id, line) order.

    lh, lv: two hashes of a whole line. pre, moved, back: running sums of word hash times the number of the word's place, of the place
    before it, and of its place from the line's end.
    """

    def __init__(self, table: pa.Table):
        ids = longs(table["ord"])
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            text = table["text"]
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i].as_py() or "", not text[i].is_valid)), np.int64)
        self.table = table.take(pa.array(order))
        self.ids = ids[order]
        raw, self.off = utf8(self.table["text"])
        self.raw = raw
        self.starts, self.ends, self.first, h, check = words(LOWER[raw] if len(raw) else raw, self.off, 2)
        self.nl = np.flatnonzero(raw == 10)
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        # a text of k line feeds has k + 1 lines
        before = np.searchsorted(self.nl, self.off)
        lines_of = np.diff(before) + 1
        self.line0 = np.concatenate([[0], np.cumsum(lines_of)])  # running line number of each row's first line
        at = np.searchsorted(self.nl, self.starts) - before[row] + self.line0[row] if len(row) else np.zeros(0, np.int64)
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1]
        self.w0 = np.flatnonzero(fresh)  # of lines with words: first word
        self.n = np.diff(np.append(self.w0, len(at)))
        self.at = at[self.w0]
        self.row = row[self.w0]
        self.doc = self.ids[self.row]
        base = np.searchsorted(self.ids, self.ids)
        self.line = (self.at - self.line0[base[self.row]]).astype(np.int32)
        self.lh, self.lv = (fold(x, self.n) for x in (h, check)) if len(self.n) else (h, check)
        f = factors(int(self.n.max()) + 1 if len(self.n) else 1)
        place = np.arange(len(at)) - np.repeat(self.w0, self.n)
        sums = lambda x: np.concatenate([np.zeros(1, U), np.cumsum(x)])
        self.pre, self.moved, self.rear = sums(h * f[place]), sums(h * f[np.maximum(place - 1, 0)]), sums(h * f[np.repeat(self.n, self.n) - 1 - place])

    def distinct(self) -> np.ndarray:
        """Indexes of the first of each set of equal lines, in order of hash."""
        if not len(self.lh):
            return np.zeros(0, np.int64)
        order = np.lexsort((self.lv, self.lh))  # stable: the earliest of equal lines comes first
        return order[_heads(self.lh[order], self.lv[order]) == np.arange(len(order))]

    def front(self, i: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Key of the first m words of lines i."""
        w = self.w0[i]
        return mix(self.pre[w + m] - self.pre[w] + (2 * m).astype(U) * U(0x9FB21C651E98DF25))

    def back(self, i: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Key of the last m words of lines i."""
        z = self.w0[i] + self.n[i]
        return mix(self.rear[z] - self.rear[z - m] + (2 * m + 1).astype(U) * U(0x9FB21C651E98DF25))

    def without(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Key of lines i without word k; that of a whole line is `front` of all its words."""
        w, n = self.w0[i], self.n[i]
        return mix(self.pre[w + k] - self.pre[w] + self.moved[w + n] - self.moved[w + k + 1] + (2 * (n - 1)).astype(U) * U(0x9FB21C651E98DF25))

    def words(self, i: int) -> bytes:
        a, b = self.w0[i], self.w0[i] + self.n[i] - 1
        return b" ".join(LOWER[self.raw[self.starts[a] : self.ends[b]]].tobytes().split())

    def find(self, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Indexes of lines by document and number, which must be there."""
        lo = np.searchsorted(self.doc, doc)
        hi = np.searchsorted(self.doc, doc, "right")
        return np.array([a + np.searchsorted(self.line[a:b], x) for a, b, x in zip(lo, hi, line, strict=True)], np.int64)


def _only(table: pa.Table, docs: np.ndarray) -> pa.Table:
    """Rows of these documents."""
    return table.filter(pa.array(np.isin(longs(table["ord"]), docs)))


def _keys(batches):
    table = gathered(batches)
    if table is None:
        return
    for b in np.unique(table["b"].to_numpy()):
        x = Lines(table.filter(pa.compute.equal(table["b"], int(b))))
        i = x.distinct()
        lh = x.lh[i]
        key, kind, own, second = [lh], [np.zeros(len(i), np.int32)], [np.arange(len(i))], [x.lv[i]]
        for less in (0, 1):
            o = np.flatnonzero(x.n[i] - less >= MIN_WORDS)
            t = x.n[i[o]] - less
            for side, half in ((x.front, t // 2), (x.back, t - t // 2)):
                key.append(mix(side(i[o], half) + t.astype(U) * U(0x8EBC6AF09C88C6E3)))
                kind.append(np.ones(len(o), np.int32))
                own.append(o)
                second.append(lh[o])
        o = np.concatenate(own)
        yield from as_batches(pa.table({"key": np.concatenate(key).view(np.int64), "kind": np.concatenate(kind), "lh": np.concatenate(second).view(np.int64), "b": np.full(len(o), b, np.int32), "doc": x.doc[i][o], "line": x.line[i][o]}), rest=False)
    del table, x
    trim()


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Of sorted columns: the index at which each row's group of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _meet(batches):
    """kind 0: the line is elsewhere earlier; kind 1: the line shares a half with a different one."""
    table = gathered(batches)
    if table is None:
        return
    key, kind, lh, b, doc, line = (table[c].to_numpy() for c in ("key", "kind", "lh", "b", "doc", "line"))
    e = np.flatnonzero(kind == 0)
    e = e[np.lexsort((line[e], doc[e], lh[e], key[e]))]
    e = e[_heads(key[e], lh[e]) != np.arange(len(e))]
    s = np.flatnonzero(kind == 1)
    s = s[np.lexsort((lh[s], key[s]))]
    if len(s):
        head = _heads(key[s])
        differs = lh[s] != lh[s][head]
        s = s[np.isin(head, head[differs])]
    at = np.concatenate([e, s])
    whole = kind[at] == 0
    yield from as_batches(pa.table({"b": b[at], "kind": kind[at], "lh": np.where(whole, key[at], lh[at]), "lv": np.where(whole, lh[at], 0), "doc": doc[at]}))


def _equal(x: Lines, i: np.ndarray, right: pa.Table) -> np.ndarray:
    """Which of lines i equal an earlier one elsewhere, by both hashes of replies of kind 0."""
    right = right.filter(pa.compute.equal(right["kind"], 0))
    lh, lv = (right[c].to_numpy().view(U) for c in ("lh", "lv"))
    order = np.lexsort((lv, lh))
    lh, lv = lh[order], lv[order]
    if not len(lh):
        return np.zeros(len(i), bool)
    out = np.zeros(len(i), bool)
    may = np.flatnonzero(member(x.lh[i], lh))
    at = np.searchsorted(lh, x.lh[i[may]])
    while len(may):  # lines of equal first hash stand next to each other
        hit = lv[at] == x.lv[i[may]]
        out[may[hit]] = True
        left = ~hit & (at + 1 < len(lh)) & (lh[np.minimum(at + 1, len(lh) - 1)] == x.lh[i[may]])
        may, at = may[left], at[left] + 1
    return out


@trimmed
def _variants(left: pa.Table, right: pa.Table) -> pa.Table:
    none = {"key": pa.array([], pa.int64()), "pos": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "doc": pa.array([], pa.int64()), "line": pa.array([], pa.int32()), "sb": pa.array([], pa.int32()), "sdoc": pa.array([], pa.int64()), "sline": pa.array([], pa.int32())}
    if not left.num_rows or not right.num_rows:
        return pa.table(none)
    kind, asked = right["kind"].to_numpy(), right["lh"].to_numpy().view(U)
    x = Lines(_only(left, right["doc"].to_numpy()[kind == 1]))
    i = x.distinct()
    i = np.sort(i[member(x.lh[i], np.unique(asked[kind == 1])) & ~_equal(x, i, right)])
    each = np.repeat(i, x.n[i])
    place = np.arange(len(each)) - np.repeat(np.cumsum(x.n[i]) - x.n[i], x.n[i])
    who = np.concatenate([i, each])
    pos = np.concatenate([np.full(len(i), -1), place]).astype(np.int32)
    key = np.concatenate([x.front(i, x.n[i]), x.without(each, place)]).view(np.int64)
    order = np.lexsort((who, pos, key))
    who, pos, key = who[order], pos[order], key[order]
    head = _heads(key, pos) if len(key) else np.zeros(0, np.int64)
    src, b = who[head], left["b"][0].as_py()
    known = src != who  # a repeat within the block needs no shuffle to be seen
    mask = ~known
    return pa.table({"key": key, "pos": pos, "b": pa.array(np.full(len(who), b, np.int32)), "doc": x.doc[who], "line": x.line[who], "sb": pa.array(np.full(len(who), b, np.int32), mask=mask), "sdoc": pa.array(x.doc[src], mask=mask), "sline": pa.array(x.line[src], mask=mask)})


def _matches(batches):
    """Earliest neighbours: at equal key and place, and between whole lines and lines with a word left out."""
    table = gathered(batches)
    if table is None:
        return
    known = table.filter(table["sb"].is_valid())
    yield from as_batches(known.select(["b", "doc", "line", "sb", "sdoc", "sline"]))
    table = table.filter(table["sb"].is_null())
    key, pos, b, doc, line = (table[c].to_numpy() for c in ("key", "pos", "b", "doc", "line"))
    order = np.lexsort((line, doc, pos, key))
    key, pos, b, doc, line = (a[order] for a in (key, pos, b, doc, line))
    if not len(key):
        return
    dst, src = [], []

    def earlier(at, of):
        ok = (doc[of] < doc[at]) | ((doc[of] == doc[at]) & (line[of] < line[at]))
        dst.append(at[ok])
        src.append(of[ok])

    here = np.arange(len(key))
    earlier(here, _heads(key, pos))
    head = _heads(key)
    whole = pos[head] == -1  # pos -1 sorts first: the earliest whole line of this key
    cut_at = here[whole & (pos >= 0)]
    earlier(cut_at, head[cut_at])
    if len(cut_at):
        by = cut_at[np.lexsort((line[cut_at], doc[cut_at], key[cut_at]))]
        first = by[np.unique(key[by], return_index=True)[1]]  # earliest cut line of each key that has a whole one
        full = here[whole & (pos == -1)]
        k = np.minimum(np.searchsorted(key[first], key[full]), len(first) - 1)
        ok = key[first][k] == key[full]
        earlier(full[ok], first[k[ok]])
    d, s = np.concatenate(dst), np.concatenate(src)
    yield from as_batches(pa.table({"b": b[d], "doc": doc[d], "line": line[d], "sb": b[s], "sdoc": doc[s], "sline": line[s]}))


@trimmed
def _fetch(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.table({"b": pa.array([], pa.int32()), "sdoc": pa.array([], pa.int64()), "sline": pa.array([], pa.int32()), "words": pa.array([], pa.string())})
    x = Lines(_only(left, right["sdoc"].to_numpy()))
    at = x.find(right["sdoc"].to_numpy(), right["sline"].to_numpy())
    return pa.table({"b": right["b"], "sdoc": right["sdoc"], "sline": right["sline"], "words": pa.array([x.words(i) for i in at], pa.binary()).cast(pa.string())})


def within_one(a: list, b: list) -> bool:
    """Word edit distance of one or less."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def _nullable(t: pa.DataType) -> pa.DataType:
    """The type with nulls allowed everywhere, as a declared schema has it."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in t])
    if pa.types.is_list(t):
        return pa.list_(_nullable(t.value_type))
    return pa.map_(t.key_type, _nullable(t.item_type)) if pa.types.is_map(t) else t


@trimmed
def _apply(left: pa.Table, right: pa.Table) -> pa.Table:
    x = Lines(left)
    gone = np.ones(len(x.lh), bool)
    gone[x.distinct()] = False
    source: dict[int, tuple[int, int]] = {}
    if right.num_rows:
        kind = right["kind"].to_numpy()
        gone |= _equal(x, np.arange(len(gone)), right)
        texts = right.filter(pa.array(kind == 3))
        text = {(d, n): w.encode().split() for d, n, w in zip(*(texts[c].to_pylist() for c in ("sdoc", "sline", "words")), strict=True)}
        near = right.filter(pa.array(kind == 2))
        if near.num_rows:
            at = x.find(near["doc"].to_numpy(), near["line"].to_numpy())
            for i, d, n in zip(at.tolist(), near["sdoc"].to_pylist(), near["sline"].to_pylist(), strict=True):
                if within_one(x.words(i).split(), text[d, n]):
                    source[i] = (d, n)
    # later equal lines of a near match go already, as repeats of it
    gone[list(source)] = True
    raw, kept, removed, n_removed = x.raw.tobytes(), [], [], np.zeros(len(x.ids), np.int64)
    bad = np.flatnonzero(gone)
    per = np.searchsorted(x.row[bad], np.arange(len(x.ids) + 1))
    valid = x.table["text"].is_valid().to_pylist()
    for r in range(len(x.ids)):
        own = bad[per[r] : per[r + 1]]
        text = raw[x.off[r] : x.off[r + 1]]
        if len(own):
            drop = set((x.at[own] - x.line0[r]).tolist())
            text = b"\n".join(t for k, t in enumerate(text.split(b"\n")) if k not in drop)
        n_removed[r] = len(own)
        kept.append(text if valid[r] else None)
        removed.append([(int(x.line[i]), *((None if (s := source.get(i)) is None or s[0] < FIRST_ID else s[0]), s and s[1])) for i in own.tolist()])
    struct = pa.struct([("line", pa.int32()), ("src_doc", pa.int64()), ("src_line", pa.int32())])
    flat = [dict(zip(("line", "src_doc", "src_line"), t, strict=True)) for rows in removed for t in rows]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_removed)]), pa.int32()), pa.array(flat, struct))
    n_lines = np.diff(x.line0) * np.array(valid, np.int64)
    rest = {"rest": (own := x.table["rest"].combine_chunks()).cast(_nullable(own.type))} if "rest" in x.table.column_names else {}
    return pa.table({"doc_id": x.table["doc_id"], "n_lines": n_lines, "n_removed": n_removed, "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed": lists} | rest)


def line_dedup(docs: DataFrame, *carry: str) -> DataFrame:
    """Per row of `docs`: n_lines, n_removed, kept_text, removed (near repeats name their source), and a struct `rest` of the columns `carry`, if any, so that names cannot clash."""
    tune(docs.sparkSession)
    rest = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("rest")] if carry else []
    full, n = bucketed(docs, *rest)
    dealt = full  # every pass reads the same exchange
    reply = on_key(on_blocks(dealt, n, _keys, KEYS), n, "key", _meet, REPLY).groupBy("b", "kind", "lh", "lv").agg(F.min("doc").alias("doc"))
    met = on_key(dealt.groupBy("b").cogroup(reply.groupBy("b")).applyInArrow(_variants, VARIANTS), n, "key", _matches, MATCH)
    best = met.groupBy("b", "doc", "line").agg(F.min(F.struct("sdoc", "sline", "sb")).alias("s")).select("b", "doc", "line", "s.*")
    asked = best.select("sb", "sdoc", "sline", F.col("b").alias("to")).distinct().select(F.col("sb"), F.col("to").alias("b"), "sdoc", "sline")
    texts = dealt.groupBy("b").cogroup(asked.groupBy("sb")).applyInArrow(_fetch, "b int, sdoc long, sline int, words string")
    null = lambda t: F.lit(None).cast(t)
    # all replies with all columns: a filter or fewer columns would move below the aggregate, and the replies would be computed twice
    answer = (
        reply.select("b", "kind", "lh", "lv", "doc", null("int").alias("line"), null("long").alias("sdoc"), null("int").alias("sline"), null("string").alias("words"))
        .union(best.select("b", F.lit(2), null("long"), null("long"), "doc", "line", "sdoc", "sline", null("string")))
        .union(texts.select("b", F.lit(3), null("long"), null("long"), null("long"), null("int"), "sdoc", "sline", "words"))
    )
    kinds = dict((f.name, f.dataType) for f in docs.schema.fields)
    schema = RESULT + (", rest struct<" + ",".join(f"c{i}:{kinds[c].simpleString()}" for i, c in enumerate(carry)) + ">" if carry else "")
    out = dealt.groupBy("b").cogroup(answer.groupBy("b")).applyInArrow(_apply, schema)
    named = [F.struct(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(carry)]).alias("rest")] if carry else []
    return out.select("doc_id", "n_lines", "n_removed", "kept_text", "removed", *named)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda r: r["line"].cast("string")), ",").alias("removed_lines"), F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with t as (select doc_id, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as raw, unnest(range(len(ls))) as line from t),
w as (
  select doc_id, line, raw, list_filter(regexp_split_to_array(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from l),
d as (
  select row_number() over () as id, ws, len(ws) as n, f from (select ws, min({'doc': doc_id, 'line': line}) as f from w where len(ws) > 0 group by ws)),
k as (select id, ws, n, n - less as t from d, (values (0), (1)) as v(less) where n - less >= 5),
halves as (
  select id, t, 0 as side, ws[1:t // 2] as part from k
  union all
  select id, t, 1, ws[n - (t - t // 2) + 1:] from k),
pairs as (select distinct a.id as i, b.id as j from halves a join halves b using (t, side, part) where a.id <> b.id),
near as (
  select i, j from (
    select i, j, a.ws as x, b.ws as y, list_filter(range(1, b.n + 1), lambda p: a.ws[p] <> b.ws[p]) as diff
    from pairs join d a on a.id = i join d b on b.id = j where a.n in (b.n, b.n + 1))
  where (len(x) = len(y) and len(diff) = 1) or (len(x) > len(y) and (len(diff) = 0 or x[diff[1] + 1:] = y[diff[1]:]))),
sides as (select i, j from near union select j, i from near),
origin as (select d.id, d.ws, least(d.f, coalesce(min(o.f), d.f)) as f from d left join sides on sides.i = d.id left join d o on o.id = sides.j group by d.id, d.ws, d.f),
judged as (select w.*, coalesce(origin.f < {'doc': w.doc_id, 'line': w.line}, false) as gone from w left join origin on origin.ws = w.ws),
out as (
  select doc_id, count(*) filter (where gone) as n_removed, string_agg(line::varchar, ',' order by line) filter (where gone) as removed_lines,
    string_agg(raw, chr(10) order by line) filter (where not gone) as kept
  from judged group by doc_id)
select t.doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed_lines, '') as removed_lines, sha256(coalesce(kept, '')) as kept_sha256
from t left join out using (doc_id)
"""
