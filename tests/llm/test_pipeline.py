import re

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from test_native import ITEMS, slow_contaminated
from test_text_dedup import WORD, docs_of, edits, ordered, slow_fingerprint, texts  # noqa: F401
from test_tokens import plain


@pytest.fixture()
def sf(spark, texts, tmp_path):  # noqa: F811
    some = [t for t in texts if t[0] is not None and t[0] < 60] + [(200 + i, t) for i, (_, t) in enumerate(ITEMS) if t]
    docs_of(spark, some).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return some, str(tmp_path)


def brute(some):
    docs, df = [], {}
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    for _, t in {t: (0, t or "") for _, t in some}.values():
        for x in {norm(x) for x in t.split("\n")} - {""}:
            df[x] = df.get(x, 0) + 1
    hosts = len({t or "" for _, t in some})
    bad = {x for x, n in df.items() if n > 10 and n > 0.01 * hosts}
    for i, t in some:
        w = WORD.findall(t or "")
        g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        rep = {k + j for k, x in enumerate(g) if g.count(x) > 1 for j in range(5)}
        kept = [x for x in (t or "").split("\n") if norm(x) not in bad]
        left = sum(len(WORD.findall(x)) for x in kept)
        if len(w) >= 10 and 100 * len(rep) <= 20 * len(w) and (left == len(w) or left >= 10):
            docs.append((i, "\n".join(kept)))
    seen, after = [], []
    for i, t in ordered(docs):
        kept, gone = [], 0
        for x in t.split("\n"):
            w = WORD.findall(x.lower())
            hit = bool(w) and any(w == s or (min(len(w), len(s)) >= 5 and abs(len(w) - len(s)) < 2 and edits(w, s) <= 1) for s in seen)
            seen += [w] if w else []
            gone += hit
            kept += [] if hit else [x]
        if not gone or WORD.search("\n".join(kept)):
            after.append((i, "\n".join(kept)))
    f = {i: slow_fingerprint(t) for i, t in after}
    comp = {i: i for i in f}
    for _ in f:
        for a in f:
            for b in f:
                if (f[a] ^ f[b]).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    after = [(i, t) for i, t in after if comp[i] == i]
    hit = {x[0] for x in slow_contaminated(after, ITEMS)}
    return {i: t for i, t in after if i not in hit}


def test_run(spark, sf):
    some, path = sf
    want = brute(some)
    ids = dict(zip(want, plain("word_bpe_49k.json", list(want.values()))))
    got = C.run(spark, path).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in ids.items()}
    assert sum(r.length for r in got) == sum(map(len, ids.values())) and len(want) > 10
    assert re.match("quality", C.STAGES[0][0]) and [k for k, _ in C.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def test_clashing_columns(spark, sf):
    """Columns named as the operators' own, and never null, pass every stage that returns documents."""
    _, path = sf
    names = "n_words kept n_removed removed_lines n_removed_words kept_text removed rest b fp component_id pos h slots item_id".split()
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({n: F.lit("own") for n in names} | {"c0": F.array(F.lit(1))})
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == "own" for r in rows for n in names) and all(r["c0"] == [1] for r in rows)
