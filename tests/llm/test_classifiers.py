import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa

from homolark.llm import license_scan as L
from homolark.llm import url_filter as U

DATA = "/root/testdata"
RULE_SQL = """
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
r(verdict, rule) as (values ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
m as (
  select page_id, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict from p join r
  on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, instr(rule, '/'))) group by page_id)
select page_id, host, path, rule, verdict from p left join m using (page_id)
"""


def walk(model, row):
    """Margin of one URL's features, node by node."""
    total = model.base
    bins = [int(np.searchsorted(e, model.suffix[int(v)] if k == len(row) - 1 else v, "right")) for k, (e, v) in enumerate(zip(model.edges, row, strict=True))]
    for feature, cut, left, value in model.trees:
        node = 0
        while left[node]:
            node = left[node] + (bins[feature[node]] > cut[node])
        total += value[node]
    return total


def test_url_rules_equal_sql(spark):
    """host, path, rule and the rules' verdicts over the whole table; the trees' verdicts are held against a walk of each tree."""
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{DATA}/sf0.01/pages.parquet'")
    want = con.sql(RULE_SQL).fetchall()
    got = U.judge(pages).collect()
    assert sorted(str((r.page_id, r.host, r.path, r.rule)) for r in got) == sorted(str(w[:4]) for w in want)
    assert {(r.page_id, r.verdict) for r in got if r.rule} == {(w[0], w[4]) for w in want if w[3]}
    assert any(r.rule for r in got) and any(r.rule is None for r in got)
    model = U.train(pages.select("url"))
    url = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    for r in [r for r in got if r.rule is None][:200]:
        assert r.verdict == ("block" if walk(model, U.features(url[r.page_id])) > 0 else "allow")


def labelled(n, seed):
    """URLs whose label follows digits and parameters, not a rule; one in twenty is wrong."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randrange(3, 9)))
    out = []
    for _ in range(n):
        host, bad = f"{word()}.{r.choice(['net', 'info', 'io'])}", r.random() < 0.4
        path = f"{word()}{r.randrange(10**8)}?id={r.randrange(999)}&s={r.randrange(999)}" if bad else f"{word()}/{word()}-{word()}"
        out.append((f"http://{host}/{path}", bad != (r.random() < 0.05)))
    return out


def test_url_trees_learn_given_labels(spark):
    """Hosts of the held-out fifth are not in training; a second set with labels of its own is judged as well."""
    model = U.train(spark.createDataFrame([], "url string"), labelled=spark.createDataFrame(labelled(3000, 1), "url string, block boolean"))
    n, right, largest = model.held_out
    assert n > 300 and right > 0.9 > 0.7 > largest
    other = labelled(1000, 2)
    x = U.matrix([u for u, _ in other])
    margin = model.margin(x)
    assert np.mean((margin > 0) == np.array([b for _, b in other])) > 0.9
    assert np.allclose(margin[:100], [walk(model, row) for row in x[:100]])
    long = "http://a.net/" + "x" * 300_000
    rows = [(1, long), (1, long), (2, other[0][0]), (2, other[0][0])]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(), labelled=spark.createDataFrame(other, "url string, block boolean")).collect()
    assert len(got) == 4 and len({(r.page_id, r.verdict, r.p_block) for r in got}) == 2 and got[0].path in (long[12:], other[0][0][other[0][0].index("/", 8) :].split("?")[0])


def test_licence_classifier_is_calibrated(spark):
    """On notices varied by another seed, and on paragraphs of documents that training did not see."""
    model = L.train(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text"))
    texts, y = L.variations(seed=99, each=20)
    p = L.Paragraphs(*L.utf8(pa.array(texts)))
    prob = model.probabilities(p)
    sure = 1 - prob[:, 0]
    top = np.zeros(len(texts))
    np.maximum.at(top, p.row, sure)
    known = np.array(y) > 0
    assert np.mean(top[known] >= L.CONFIDENT) > 0.95 and np.mean(top[~known] >= L.CONFIDENT) < 0.05
    assert abs(top.mean() - known.mean()) < 0.05
    edges = np.linspace(0, 1, 11)
    at = np.minimum(np.digitize(top, edges) - 1, 9)
    gap = sum((at == k).sum() * abs(top[at == k].mean() - known[at == k].mean()) for k in range(10) if (at == k).any()) / len(top)
    assert gap < 0.05


def test_licence_scan_against_templates_everywhere(spark):
    """Families over a whole table against a search of every window of every paragraph, without the classifier: none but those, and nearly all.

    The classifier is not sure of one of 46 documents: three words of notice at the end of a window of sixteen.
    """
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = {r.doc_id: set(r.families) for r in L.license_scan(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    want = {i: {x[0] for part in t.split("\n\n") for x in L.places(L.plain(part))} for i, t in texts.items()}
    assert all(got[i] <= want[i] for i in texts)
    there = [i for i in texts if want[i]]
    assert len(there) > 30 and sum(got[i] == want[i] for i in there) >= 0.95 * len(there)


# Written by hand; no word of training was taken from here.
NOTICES = [
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Licensed under the MIT license."),
    ("BSD-3-Clause", "This file is distributed under the 3-Clause BSD License."),
    ("GPL-3.0", "Code released under the GPLv3."),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    ("Apache-2.0", "Distributed under the Apache 2.0 license."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "This library is made available under the Apache License, Version 2.0, see the file."),
    ("MPL-2.0", "Our code is published under MPL 2.0."),
    ("LGPL-3.0", "The library is covered by the GNU Lesser General Public License v3."),
    ("AGPL-3.0", "The server is offered under the AGPLv3; contact us for other terms."),
    ("ISC", "Released under the terms of the ISC license."),
    ("Unlicense", "This is released under the Unlicense."),
    ("EPL-2.0", "Provided under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License."),
    ("CC0-1.0", "The data are shared under CC0 1.0."),
    ("CC-BY-4.0", "All figures are licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Photos: licensed under CC BY-NC 4.0, no commercial use."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "You may redistribute it; it is licensed under the GNU GPL version 3 or later."),
    ("BSD-3-Clause", "NumPy is released under a modified BSD license."),
]
OTHERS = [
    "Researchers at MIT released a study under pressure from the press.",
    "The apache helicopter was distributed under cover of night.",
    "Room is available under the stairs, ask the clerk.",
    "The work is governed by the laws of physics and of Massachusetts.",
    "He was licensed under state law to drive a bus.",
    "General public access to the library is free.",
    "The mozilla team and the eclipse in May.",
    "Creative people, common attributes and zero cost.",
    "Permission was granted to leave the building early.",
]


def test_licence_notices_in_ordinary_words(spark):
    """Alone and in the middle of a long paragraph: nine in ten at least, and no other family anywhere."""
    around = "The quarterly report shows that sales of tea went up while coffee fell, which nobody had seen coming. "
    rows = [(i, t) for i, (_, t) in enumerate(NOTICES)] + [(100 + i, around * 3 + t + " " + around * 3) for i, (_, t) in enumerate(NOTICES) if len(t.split()) > 4 and "v3.0" not in t]
    rows += [(200 + i, t) for i, t in enumerate(OTHERS)] + [(300 + i, around * 2 + t + " " + around) for i, t in enumerate(OTHERS)]
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    model = L.train(docs.select("text"))
    p = L._scan(SimpleNamespace(value=model))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    found = next(p([batch]))
    got = {i: {x["family"] for x in n} for i, n in zip(found["doc_id"].to_pylist(), found["notices"].to_pylist(), strict=True)}
    right = [got[i] == {NOTICES[i % 100][0]} for i in got if i < 200]
    assert len(right) > 40 and sum(right) >= 0.9 * len(right)
    assert all(got[i] <= {NOTICES[i % 100][0]} for i in got if i < 200) and not any(got[i] for i in got if i >= 200)


def test_named_licences_against_plain_search():
    """Every name after every lead, tried at every place."""

    def plain_search(w):
        out = set()
        for family, names in L.NAMES.items():
            for name in map(L.plain, names):
                for i in range(len(w) - len(name) + 1):
                    if w[i : i + len(name)] == name:
                        j = i - 1
                        while j >= max(0, i - L.GAP) and w[j] in L.BETWEEN:
                            j -= 1
                        if (j >= 1 and w[j - 1] in L.LEADS and w[j] == "under") or (j >= 0 and w[j] == "spdx-license-identifier"):
                            out.add((family, i, i + len(name)))
        return {x for x in out if not any(y != x and y[1] <= x[1] and x[2] <= y[2] for y in out)}

    r = random.Random(3)
    for _ in range(2000):
        w = [x for _ in range(3) for x in [*r.choices(["tea", "under", "licensed", "the", "mit"], k=r.randrange(4)), *L.plain(L.drawn(r, r.choice(list(L.NAMES))))]] + ["end"] * L.HEADING
        assert {f for f, *_ in plain_search(w)} == {f for f, *_ in L.named(w)}
