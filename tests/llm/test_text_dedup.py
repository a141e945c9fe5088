import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from homolark.llm import common
from homolark.llm import simhash_dedup as simhash
from homolark.llm.line_dedup import line_dedup, within_one
from homolark.llm.simhash_dedup import _hubs, fingerprint, simhash_components, simhash_dedup
from homolark.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, b string, rest long, h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, None) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [line(25) for _ in range(4)]
    out = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "\n" * 5), (5, shared[0]), (6, shared[0]), (None, shared[1])]
    for i in range(10, 60):
        parts = [line(r.choice([1, 3, 5, 8, 12])) for _ in range(6)]
        if r.random() < 0.6:
            p = r.choice(shared).split()
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "Changed"
            if r.random() < 0.3:
                p.insert(3, "extra")
            parts.insert(2, " ".join(p))
        out.append((i, "\n".join(parts)))
    out += [(60, out[20][1]), (60, out[21][1]), (60, out[20][1]), (61, line(6000)), (62, "é ü " * 300)]
    return out


def ordered(texts):
    return sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[1] is not None))


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda x: str(x))


def thue_morse(n, *pair):
    """Two sequences that polynomial hashes modulo a power of two cannot tell apart."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return " ".join(pair[b] for b in bits), " ".join(pair[1 - b] for b in bits)


def test_sequences_of_equal_polynomials(spark):
    long = [x.replace(" ", "") for x in thue_morse(2048, "a", "b")]
    lines = [*thue_morse(512, "x", "y"), *thue_morse(2048, "p", "q"), *(f"one two three {w} five" for w in long)]
    docs = docs_of(spark, list(enumerate(lines)))
    assert line_dedup(docs.where("doc_id < 4")).agg(F.sum("n_removed")).first()[0] == 0
    words = [x.split() for x in lines]
    seen, n = set(), 0
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        n += sum(gone)
    assert substring_dedup(docs).agg(F.sum("n_removed")).first()[0] == n
    pair = docs_of(spark, [(1, " ".join([long[0]] * 20)), (2, " ".join([long[1]] * 20))])
    assert substring_dedup(pair).agg(F.sum("n_removed")).first()[0] == 0


def test_substring_brute_force(spark, texts):
    seen, want, place = set(), [], {}
    for i, t in ordered(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        want.append((i, len(w), sum(gone), " ".join(x for x, d in zip(w, gone) if not d)))
    out = substring_dedup(docs_of(spark, texts))
    assert rows(out.select("doc_id", "n_words", "n_removed", "kept_text")) == sorted(want, key=str)
    for r in out.where(F.size("factors") > 0).collect():
        assert sum(f.length for f in r.factors) >= r.n_removed and all(f.length >= 20 for f in r.factors)


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_line_brute_force(spark, texts):
    seen, want = [], []
    for i, t in ordered(texts):
        kept, gone = [], 0
        for x in (t or "").split("\n"):
            w = WORD.findall(x.lower())
            hit = bool(w) and any(w == s or (min(len(w), len(s)) >= 5 and abs(len(w) - len(s)) < 2 and edits(w, s) <= 1) for s in seen)
            seen += [w] if w else []
            gone += hit
            kept += [] if hit else [x]
        want.append((i, 0 if t is None else t.count("\n") + 1, gone, None if t is None else "\n".join(kept)))
    out = line_dedup(docs_of(spark, texts), "b", "rest")
    assert rows(out.select("doc_id", "n_lines", "n_removed", "kept_text")) == sorted(want, key=str)
    assert out.select("rest.*").distinct().collect() == [("x", 1)]


def test_within_one():
    r = random.Random(1)
    for _ in range(2000):
        a = [r.choice("ab") for _ in range(r.randrange(6))]
        b = [r.choice("ab") for _ in range(r.randrange(6))]
        assert within_one(a, b) == (edits(a, b) <= 1)


def slow_fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_brute_force(spark, texts):
    fps = [slow_fingerprint(t) for _, t in texts]
    assert fps == [fingerprint((t or "").encode()) for _, t in texts]
    comp = list(range(len(fps)))
    for _ in fps:
        for a, x in enumerate(fps):
            for b, y in enumerate(fps):
                if (x ^ y).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    low = {}
    for c, (i, _) in zip(comp, texts):
        low[c] = min((v for v in (low.get(c), i) if v is not None), default=None)
    want = sorted(((i, f - (f >> 63 << 64), low[c]) for c, f, (i, _) in zip(comp, fps, texts)), key=str)
    docs = docs_of(spark, texts)
    assert rows(simhash_components(docs)) == want
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({v for v in low.values() if v is not None})


def test_simhash_keeps_one_row_a_component(spark):
    r = random.Random(8)
    text = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(60))
    apart, shared, copied, clean = [text() for _ in range(4)], [text() for _ in range(3)], "a " + text(), "b " + text()
    some = [(None, t) for t in apart + apart[:2]] + [(5, t) for t in shared] + [(1, copied), (7, copied), (7, clean), (7, clean)]
    some += [(None, copied), (8, clean), (None, "\t"), (None, ""), (None, None), (9, "x y"), (9, "X Y")]
    fps = {t: slow_fingerprint(t) for _, t in some if t}
    near = {t: min(u for u in fps if (fps[u] ^ fps[t]).bit_count() <= 3) for t in fps}
    assert near == {t: "X Y" if t == "x y" else t for t in fps}
    want = [(None, t) for t in apart] + [(5, t) for t in shared] + [(1, copied), (7, clean), (None, None), (9, "X Y")]
    got = simhash_dedup(docs_of(spark, some)).select("doc_id", "text")
    assert rows(got) == sorted(want, key=str)


def groups(n, a, b):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for x, y in zip(a, b):
            root[x] = root[y] = min(root[x], root[y])
        if root == before:
            return root


def test_hubs_connect_what_pairs_connect():
    rng = np.random.default_rng(3)
    other = rng.integers(0, 1 << 21, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 12, (400, 3)).astype(np.uint64)
    other = np.bitwise_xor.reduce(np.column_stack([rng.choice(other, 400), flips]), axis=1)
    center = rng.random(len(other)) < 0.3
    d = np.bitwise_count(other[:, None] ^ other)
    a, b = np.nonzero((center[:, None] & center & (d <= 3)) | (center[:, None] & ~center & (d <= 2)) | (d <= 1))
    assert groups(len(other), a, b) == groups(len(other), *_hubs(other, center, 21))


@pytest.mark.parametrize("hub", [simhash.HUB, 100])
def test_links_connect_all_near_fingerprints(monkeypatch, hub):
    monkeypatch.setattr(simhash, "HUB", hub)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    flips = np.uint64(1) << rng.integers(0, 64, (900, 3)).astype(np.uint64)
    near = np.bitwise_xor.reduce(np.column_stack([rng.choice(base[:20], 900), flips[:, :2], np.where(rng.random(900) < 0.5, flips[:, 2], np.uint64(0))]), axis=1)
    fp = np.unique(np.concatenate([base, near]))
    keys = pa.Table.from_batches(list(simhash._variants([pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])])))
    assert keys.num_rows == 131 * len(fp)
    links = pa.Table.from_batches(list(simhash._links(3)(iter(keys.to_batches()))))
    a, b = (np.searchsorted(fp, links[c].to_numpy().view(np.uint64)) for c in "ab")
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp) <= 3)
    assert groups(len(fp), a, b) == groups(len(fp), x[x != y], y[x != y]) and links.num_rows < len(fp)


def test_few_partitions_of_many_groups(spark, texts, monkeypatch):
    docs = docs_of(spark, texts)
    want = [rows(f(docs).drop("removed", "factors")) for f in (line_dedup, substring_dedup, simhash_components)]
    monkeypatch.setattr(common, "MOST_PARTS", 2)
    assert [rows(f(docs).drop("removed", "factors")) for f in (line_dedup, substring_dedup, simhash_components)] == want


def test_rows_without_id_are_spread(spark):
    r = random.Random(8)
    line = lambda: " ".join(r.choice("abcdefghij") + str(r.randrange(99)) for _ in range(25))
    some = [(None, f"{line()}\n{line()}") for _ in range(60)] + [(1, "x y z")]
    some += [(None, t + "\nlast line of this one") for _, t in some[:5]]
    docs = docs_of(spark, some)
    dealt, _ = common.bucketed(docs)
    assert dealt.select("b").distinct().count() > 4
    assert line_dedup(docs).agg(F.sum("n_removed")).first()[0] == 10 + 4
    assert substring_dedup(docs).agg(F.sum("n_removed")).first()[0] == 5 * 50


def test_empty(spark):
    none = docs_of(spark, [(1, "x")]).where("doc_id > 9")
    assert substring_dedup(none).count() == line_dedup(none, "b").count() == simhash_components(none).count() == simhash_dedup(none).count() == 0


def test_kept_hash_of_no_words(spark):
    out = substring_dedup(docs_of(spark, [(1, None)])).first()
    assert hashlib.sha256(out.kept_text.encode()).hexdigest().startswith("e3b0c442")
