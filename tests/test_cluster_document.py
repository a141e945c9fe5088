import json
import random

import pytest

from homolark.sources import cluster_document as D
from homolark.sources import genomes as G

NAMES = ["plain", "a]b", 'q"]"', "back\\", "]]", "\\]\\\"", "új ], [", '"clusters": [', "x" * 300]


def document(n, seed):
    r = random.Random(seed)
    return [[{"Genome": r.choice(NAMES), "Index": r.randrange(99), "AbsoluteIndex": r.randrange(1 << 40)} for _ in range(r.choice([0, 1, 1, 2, 5, 30]))] for _ in range(n)]


def positions(df):
    return [(r.pos, r.members) for r in df.orderBy("pos").collect()]


def wanted(clusters):
    return [(i, [m["AbsoluteIndex"] for m in c]) for i, c in enumerate(clusters)]


@pytest.mark.parametrize("split", [600, 1 << 27])
def test_split_documents(spark, tmp_path, split, monkeypatch):
    """Every layout and order of keys, cut at any byte, runs of four pieces: as the whole document parsed at once."""
    monkeypatch.setattr(D, "RUN", 2)
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": 1}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, str(v))
        for i, indent in enumerate((None, 1, 4)):
            clusters = document(40, i)
            doc = {"datasets": ["d]", 'e"'], "n": 3, "clusters": clusters} if i % 2 else {"clusters": clusters, "note": 'a "]" b', "other": [1, 2], "datasets": ["d]", 'e"']}
            path = tmp_path / f"{i}.json"
            path.write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(i)))
            back, names = G.read_clusters(spark, str(path))
            assert names == ["d]", 'e"'] and positions(back) == wanted(clusters)
            if split == 600:
                assert D.pieces(spark, str(path)).select("at").distinct().count() > 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("doc", [{}, {"datasets": ["a"]}, {"clusters": [], "datasets": ["a"]}, {"datasets": None, "clusters": [[]]}, {"datasets": [], "clusters": [[], [], []]}, {"clusters": [[{"AbsoluteIndex": None}]]}])
def test_small_documents(spark, tmp_path, doc):
    (tmp_path / "d.json").write_text(json.dumps(doc))
    back, names = G.read_clusters(spark, str(tmp_path / "d.json"))
    assert names == (doc.get("datasets") or []) and positions(back) == wanted(doc.get("clusters") or [])


@pytest.mark.parametrize("text", ['{"clusters": [[{"AbsoluteIndex": 1}], 7, [{"AbsoluteIndex": 2}]]}', '{"clusters": [[{"AbsoluteIndex": 1}], [{"AbsoluteIndex": ', '{"clusters": [[{"AbsoluteIndex": 1, "more": [1]}]]}'])
def test_broken_documents(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception, match="not a cluster|alformed|Bad|cut short"):
        G.read_clusters(spark, str(tmp_path / "d.json"))[0].collect()


def test_folder_of_parts(spark, tmp_path):
    """Gzipped parts that together are the document, empty ones among them."""
    n = 40
    seqs = spark.createDataFrame([(i, NAMES[i % len(NAMES)], i, "ACD") for i in range(n)], "abs_id int, genome string, genome_index int, seq string")
    clusters = spark.createDataFrame([(p, [p, (p * 7) % n]) for p in range(n)], "pos int, members array<long>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        G.write_clusters(clusters, seqs, str(tmp_path / "c"), ["one", "t]wo"], joined=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "c").glob("part-*.gz"))) > 1
    back, names = G.read_clusters(spark, str(tmp_path / "c"))
    assert names == ["one", "t]wo"] and positions(back) == [(p, [p, (p * 7) % n]) for p in range(n)]
