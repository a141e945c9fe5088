import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_text_dedup import docs_of, texts  # noqa: F401

from homolark.llm import license_scan as L
from homolark.llm import ppm_scoring as P
from homolark.llm import url_filter as U


def slow_ppm(train, text):
    """log10 probability by the definition: longest context first, method C, exclusion."""
    counts = {}
    for t in train:
        s = bytes([P.PAD] * P.ORDER) + t.encode().lower() + bytes([P.END])
        for i in range(P.ORDER, len(s)):
            for k in range(P.ORDER + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    s = bytes([P.PAD] * P.ORDER) + text.encode().lower() + bytes([P.END])
    total = 0.0
    for i in range(P.ORDER, len(s)):
        out = set()
        for k in range(P.ORDER, -1, -1):
            c = {y: n for y, n in counts.get(s[i - k : i], {}).items() if y not in out}
            if not c:
                continue
            t = sum(c.values()) + len(c)
            if s[i] in c:
                total += math.log10(c[s[i]] / t)
                break
            total += math.log10(len(c) / t)
            out |= set(c)
        else:
            total -= math.log10(P.SYMBOLS - len(out))
    return total


def test_ppm(spark, texts):  # noqa: F811
    some = [(i, (t or "")[:700]) for i, t in texts] + [(500, "unseen # bytes \u00df"), (501, "abc")]
    got = {(r.doc_id, r.n_tokens): r for r in P.ppm_scores(docs_of(spark, some)).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in some if not held(i)]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in some:
        r = got[i, len(words(t)) + 1]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.held_out == held(i) and r.train_tokens == n and abs(r.base_score - base) < 1e-6
        assert r.n_known == sum(c[w] > 0 for w in words(t)) + 1
    for i in (5, 12, 500, 501):
        t = dict(some)[i]
        assert abs(got[i, len(words(t)) + 1].score - slow_ppm(train, t)) < 1e-3
    assert P.adaptive_bits("abababababab" * 20) < P.adaptive_bits("qwertyuiopas" * 20) + 200
    assert P.ppm_scores(docs_of(spark, some).where("doc_id > 9999")).count() == 0


def test_ppm_keeps_rare_contexts(spark):
    """Over 262,144 symbols, so contexts seen once or twice are under 1/131072 of them; they count like any other."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh\u00e9") for _ in range(r.randrange(2, 9))) for _ in range(5000)]
    some = [(i, " ".join(r.choice(vocab) for _ in range(450))) for i in range(120)]
    held = [i for i, _ in some if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [t for i, t in some if i not in held]
    assert sum(map(len, train)) > 2 * 131072
    got = {x.doc_id: x.score for x in P.ppm_scores(docs_of(spark, some)).collect()}
    assert len(got) == len(some) and len(held) > 3
    for i in held[:3] + [i for i, _ in some if i not in held][:2]:
        assert abs(got[i] - slow_ppm(train, some[i][1])) < 1e-2


def test_url_rules_and_edges(spark):
    cases = [
        ("https://a.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://xcom/de/", "xcom", "/de/", None, None),
        ("http://notexample.org?a://b/c", "notexample.org", "", None, None),
        ("nothing", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
    ]
    df = spark.createDataFrame([(None if i == 3 else i, c[0], "h", 1) for i, c in enumerate(cases)], "page_id long, url string, html string, host int")
    got = {(r.page_id, r.host, r.path): r for r in U.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[None if i == 3 else i, host, path]
        assert r.rule == rule and (r.verdict == verdict if rule else r.verdict in ("allow", "block"))
    assert U.judge(df.where("page_id > 99")).count() == 0


def test_boosting_learns():
    r = np.random.default_rng(0)
    x = r.random((3000, 5))
    x[:, -1] = r.integers(0, U.SUFFIXES, 3000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = U.fit(x[:2000], y[:2000])
    assert ((m.margin(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


def test_licences(spark, texts):  # noqa: F811
    lines = [(i, f"some words of a body that says nothing at all\n{t}\nand more words", f) for i, (f, t) in enumerate((f, t) for f, ts in L.TEMPLATES.items() for t in ts)]
    other = [(500, "the licence fee of a television set is under debate by the public"), (501, "apache helicopters fly under version two"), (502, "long " * 3000 + " Released under the MIT License. " + "tail " * 100)]
    docs = docs_of(spark, texts + [(1000 + i, t) for i, t, _ in lines] + other)
    got = {r.doc_id: r for r in L.license_scan(docs).collect() if r.doc_id is not None}
    assert all(got[1000 + i].families == [f] and [n.line for n in got[1000 + i].notices] == [1] for i, _, f in lines)
    assert got[500].families == got[501].families == [] and got[502].families == ["MIT"]
    assert all(not got[i].families for i, _ in texts if i is not None)
    assert L.license_scan(docs.where("doc_id = 9999")).count() == 0
    assert L.Paragraphs(np.zeros(0, np.uint8), np.zeros(1, np.int64)).of_row.tolist() == []
    assert isinstance(L.utf8(pa.array(["a"]))[0], np.ndarray)


def test_several_licences_in_a_line(spark, texts):  # noqa: F811
    apache, mit, rights = L.TEMPLATES["Apache-2.0"][1], L.TEMPLATES["MIT"][0], L.TEMPLATES["All-rights-reserved"][0]
    body = "some words of a body that says nothing at all " * 20
    cases = {
        700: (f"{body}{apache} {body}{mit} {body}", ["Apache-2.0", "MIT"]),
        701: (f"{mit} {rights}", ["MIT", "All-rights-reserved"]),
        702: (f"{body}\n{body}{mit} {body}{mit} {body}", ["MIT", "MIT"]),
        703: (f"\u00dc\u00e9 {rights} {apache} {L.TEMPLATES['BSD-3-Clause'][0]}", ["All-rights-reserved", "Apache-2.0", "BSD-3-Clause"]),
    }
    got = {r.doc_id: r for r in L.license_scan(docs_of(spark, texts + [(i, t) for i, (t, _) in cases.items()])).collect()}
    for i, (_, want) in cases.items():
        assert [n.family for n in got[i].notices] == want and got[i].families == sorted(set(want))
        assert {n.line for n in got[i].notices} == {int(i == 702)} and all(n.agreement >= L.CONFIRM for n in got[i].notices)
