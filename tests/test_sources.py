import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from homolark.functions import matrices as M
from homolark.functions.alignment import encode, passes
from homolark.functions.matrices import ORDER, Environments, Params
from homolark.operators import clustering as C
from homolark.operators import evaluation as V
from homolark.plans import program
from homolark.sources import genomes as G
from homolark.sources.agd import read_records
from homolark.sources.match_sink import MatchWriter
from homolark.streaming import incremental
from homolark.streaming.incremental import cluster_stream


@pytest.fixture()
def fasta(tmp_path):
    (tmp_path / "alpha.fa").write_text(">one first\nMKVL\nAAGI\n>two\nwwww\r\nWW*W\n>three\n\n")
    (tmp_path / "beta.x.fasta").write_text(">b1\nACDEFGHIKL\n>b2\nMNPQ")
    return str(tmp_path)


def test_fasta(spark, fasta):
    rows = G.read_genomes(spark, f"{fasta}/alpha.fa", f"{fasta}/beta.x.fasta").orderBy("abs_id").collect()
    assert [(r.abs_id, r.genome, r.genome_size, r.genome_index, r.meta, r.seq) for r in rows] == [
        (0, "alpha", 3, 0, "one first", "MKVLAAGI"), (1, "alpha", 3, 1, "two", "WWWWWWW"), (2, "alpha", 3, 2, "three", ""),
        (3, "beta.x", 2, 0, "b1", "ACDEFGHIKL"), (4, "beta.x", 2, 1, "b2", "MNPQ")]
    with pytest.raises(Exception, match="not a residue"):
        G.read_fasta(spark, f"{fasta}/alpha.fa", strict=True).collect()
    with pytest.raises(ValueError, match="not a dataset"):
        G.read_genomes(spark, "x.csv")
    G.write_fasta(G.read_fasta(spark, f"{fasta}/alpha.fa"), f"{fasta}/out")
    back = spark.read.text(f"{fasta}/out").where("genome = 'alpha'")
    assert back.count() == 6
    (open(f"{fasta}/list.json", "w")).write(json.dumps([f"{fasta}/beta.x.fasta"]))
    assert G.read_list(spark, f"{fasta}/list.json").count() == 2


@pytest.mark.parametrize("packed", [G.RAW, G.GZIP])
def test_agd(spark, tmp_path, packed):
    seqs = [["MKV", "", "ACDW"], ["YY"]]
    doc = {"name": "set", "columns": ["prot", "metadata", "unused"], "records": []}
    first = 0
    for k, chunk in enumerate(seqs):
        (tmp_path / f"c{k}.prot").write_bytes(G.encode_chunk([bytes(ord(c) - 65 for c in s) for s in chunk], compression=packed, first=first))
        (tmp_path / f"c{k}.metadata").write_bytes(G.encode_chunk([f"m{first + i}".encode() for i in range(len(chunk))], compression=packed, first=first))
        doc["records"].append({"path": f"c{k}"})
        first += len(chunk)
    (tmp_path / "set.json").write_text(json.dumps(doc))
    rows = G.read_genomes(spark, str(tmp_path / "set.json")).orderBy("abs_id").collect()
    assert [(r.genome, r.genome_size, r.meta, r.seq) for r in rows] == [("set", 4, f"m{i}", s) for i, s in enumerate(sum(seqs, []))]
    with pytest.raises(ValueError, match="no column"):
        G.read_agd(spark, str(tmp_path / "set.json"), ("qual",))
    with pytest.raises(ValueError, match="not supported"):
        G.decode_chunk(G.HEADER.pack(1, 0, 0, G.BZIP2, 56, 0, 0, 1, b""))
    for text in ("", "A", "ACGTN" * 9, "ACGTACGTACGTACGTACGTA"):
        assert G.unpack_bases(G.pack_bases(text)) == text


def test_clusters_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([(i, f"g{i // 2}", i % 2, "A") for i in range(5)], "abs_id int, genome string, genome_index int, seq string")
    clusters = spark.createDataFrame([(0, [3, 1]), (1, [4]), (2, [0, 2, 4])], "pos int, members array<long>")
    G.write_clusters(clusters, seqs, str(tmp_path / "c"), ["a.fa", "b.fa"])
    with gzip.open(tmp_path / "c.gz", "rt") as f:
        doc = json.load(f)
    assert doc["datasets"] == ["a.fa", "b.fa"] and [[m["AbsoluteIndex"] for m in c] for c in doc["clusters"]] == [[3, 1], [4], [0, 2, 4]]
    assert doc["clusters"][0][0] == {"Genome": "g1", "Index": 1, "AbsoluteIndex": 3} and len(list(tmp_path.glob("c*"))) == 1
    G.write_clusters(clusters.where("pos > 9"), seqs, str(tmp_path / "none"), [])
    assert G.read_clusters(spark, str(tmp_path / "none.gz"))[0].count() == 0
    back, names = G.read_clusters(spark, str(tmp_path / "c.gz"))
    assert sorted((r.pos, list(r.members)) for r in back.collect()) == [(0, [3, 1]), (1, [4]), (2, [0, 2, 4])] and names == ["a.fa", "b.fa"]
    (tmp_path / "prior.json").write_text(json.dumps({"datasets": ["d"], "clusters": [[{"Genome": "g", "Index": 0, "AbsoluteIndex": 7}]]}, indent=2))
    back, names = G.read_clusters(spark, str(tmp_path / "prior.json"))
    assert [(r.pos, list(r.members)) for r in back.collect()] == [(0, [7])] and names == ["d"]


def test_matches_round_trip(spark, tmp_path):
    rows = [("Ga", "gb", 0, 1, 0, 9, 2, 11, 181.98765432, 51.4, 2.5, 4), ("Ga", "gb", 2, 3, 5, 9, 1, 7, 117.0, 7.12345678, 0.5, 2), ("Ga", "gc", 0, 0, 0, 1, 0, 1, 300.0, 0.05, 1.0, 2)]
    m = spark.createDataFrame(rows, "genome1 string, genome2 string, idx1 int, idx2 int, seq1_min int, seq1_max int, seq2_min int, seq2_max int, score double, distance double, variance double, cluster_size int")
    G.write_matches(m, str(tmp_path / "m"))
    lines = (tmp_path / "m" / "Ga" / "gb").read_text().splitlines()
    assert lines[:3] == ["# AllAll of Ga vs gb;", "RefinedMatches(", "[[1, 2, 181.9876543, 51, 1..10, 3..12, 2.50000000, 4],"] and lines[3].endswith("2] ]):") and len(lines) == 4
    G.write_matches(m, str(tmp_path / "m"))  # replaces
    assert not (tmp_path / "m.parts").exists()
    back = sorted(map(tuple, G.read_matches(spark, str(tmp_path / "m")).collect()))
    assert back == [("ga", "gb", 1, 2, 181, 51.0, 1, 10, 3, 12, 2.5, 4), ("ga", "gb", 3, 4, 117, 7.1235, 6, 10, 2, 8, 0.5, 2), ("ga", "gc", 1, 1, 300, 0.05, 1, 2, 1, 2, 1.0, 2)]
    assert G.read_matches(spark, str(tmp_path / "m"), 181).count() == 2
    a = G.read_matches(spark, str(tmp_path / "m"))
    r = V.recall(a, a.where("score < 300")).first()
    assert (r.n_both, r.n_reference_only, r.n_other_only) == (2, 1, 0)


def test_parameters_and_text_matrix():
    p = M.Params.from_json('{"min_score": 117.85, "max_aa_uncovered": 9}')
    assert (p.min_score, p.max_uncovered, p.min_full_merge_score) == (117, 9, 200.0)
    m = M.matrix_from_text("# c\n A R\nA 4 -1\nR -1 5\n")
    assert m[0, 17] == -1 and m[17, 17] == 5
    with pytest.raises(ValueError):
        M.matrix_from_json('{"scores": [[1]], "column_order": ["A", "R"], "gap_open": -1, "gap_ext": -1}', 10)


def test_length_guard(spark):
    df = spark.createDataFrame([(0, "A" * (C.LONGEST + 1))], "abs_id int, seq string")
    with pytest.raises(Exception, match="too long"):
        C.checked(df).collect()


def test_length_guard_keeps_every_row(spark, tmp_path):
    texts = [(0, "a" * C.LONGEST, "x"), (1, "a-" * (C.LONGEST + 1), "x"), (2, None, None), (3, "", "y")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(0, 0), (1, C.LONGEST), (2, C.LONGEST + 1), (3, 0)}
    assert {(r.abs_id, r.len) for r in entry.queries()["length_guard"](spark, str(tmp_path)).collect()} == want
    got = C.guarded(spark.createDataFrame([(k, "A" * n) for k, n in want], "abs_id int, seq string"))
    assert {(r.abs_id, r.fits) for r in got.collect()} == {(0, True), (1, True), (2, False), (3, True)}


def test_agd_written_and_read(spark, tmp_path):
    seqs = spark.createDataFrame([(i, f"m{i}" if i % 3 else None, "ACDW" * (i % 4)) for i in range(25)], "ordinal long, meta string, seq string")
    manifest = G.write_agd(seqs, str(tmp_path / "agd"), "set", rows=7)
    rows = G.read_genomes(spark, manifest).orderBy("abs_id").collect()
    assert [(r.genome, r.meta, r.seq) for r in rows] == [("set", f"m{i}" if i % 3 else "", "ACDW" * (i % 4)) for i in range(25)]


@pytest.mark.parametrize("packed", [G.RAW, G.GZIP])
def test_only_what_is_asked_for_is_read(spark, tmp_path, packed):
    seqs = spark.createDataFrame([(i, f"m{i}", "ACDEFGHIKL" * (i % 9) * 40) for i in range(60)], "ordinal long, meta string, seq string")
    manifest = G.write_agd(seqs, str(tmp_path / "agd"), "set", 20, packed)
    whole = sorted((r.ordinal, bytes(r.prot), bytes(r.metadata)) for r in G.read_agd(spark, manifest).collect())
    assert whole == sorted((r.ordinal, bytes(r.prot), bytes(r.metadata)) for r in G.read_agd_files(spark, manifest).collect()) and len(whole) == 60
    ranged = G.read_agd(spark, manifest, first=15, last=41)
    assert sorted((r.ordinal, bytes(r.prot), bytes(r.metadata)) for r in ranged.collect()) == whole[15:42]
    assert ranged.rdd.getNumPartitions() == 3 and "Exchange" not in ranged._jdf.queryExecution().toString()
    one = G.at(spark, manifest, 33)
    assert [(r.ordinal, bytes(r.prot)) for r in one.collect()] == [whole[33][:2]] and one.rdd.getNumPartitions() == 1
    assert G.at(spark, manifest, 60).collect() == []
    for f in (tmp_path / "agd").glob("*.prot"):  # another column's files and other chunks are not opened
        if "000000000001" not in f.name:
            f.write_bytes(b"broken")
    assert [bytes(r.metadata) for r in G.read_agd(spark, manifest, ("metadata",)).orderBy("ordinal").collect()] == [w[2] for w in whole]
    assert [bytes(r.prot) for r in G.at(spark, manifest, 20, ("prot",)).collect()] == [whole[20][1]]
    with pytest.raises(Exception, match="shorter than its header"):
        G.read_agd(spark, manifest, ("prot",)).collect()
    # of an uncompressed chunk only the index and the asked bytes are read
    first, records, read = read_records(f"{tmp_path}/agd/set-000000000001.prot", 21, 22)
    assert (first, records) == (21, [whole[21][1], whole[22][1]])
    if packed == G.RAW:
        assert read == G.HEADER.size + 4 * 20 + sum(len(w[1]) for w in whole[20:23])


def test_conditions_reach_the_reader(spark, tmp_path):
    seqs = spark.createDataFrame([(i, f"m{i}", "ACD") for i in range(30)], "ordinal long, meta string, seq string")
    manifest = G.write_agd(seqs, str(tmp_path / "agd"), "set", 5)
    for f in (tmp_path / "agd").glob("*.prot"):
        if f.name != "set-000000000002.prot":
            f.write_bytes(b"broken")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        prot = lambda where: sorted(r.ordinal for r in G.read_agd(spark, manifest, ("prot",)).where(where).collect())
        assert prot("ordinal = 12") == [12] and prot("ordinal > 10 and ordinal <= 13") == [11, 12, 13]
        assert prot("ordinal in (10, 14)") == [10, 14] and prot("ordinal >= 12 and ordinal < 15 and length(prot) = 3") == [12, 13, 14]
        assert prot("ordinal = 12 and ordinal = 13") == []
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_large_fasta_is_numbered_over_splits(spark, tmp_path):
    (tmp_path / "big.fa").write_text("".join(f">r{i}\n{'MKVL' * (i % 7 + 1)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = G.read_fasta(spark, str(tmp_path / "big.fa"))
        assert df.select("genome_index", F.expr("'r' || genome_index = meta").alias("ok")).where("ok").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_run(spark, tmp_path):
    r = random.Random(5)
    base = ["".join(r.choice(M.ORDER) for _ in range(90)) for _ in range(3)]
    vary = lambda s: "".join(c if r.random() > 0.1 else r.choice(M.ORDER) for c in s)
    for g in "abc":
        (tmp_path / f"{g}.fa").write_text("".join(f">{g}{i}\n{vary(base[i % 3])}\n" for i in range(4)))
    params = M.Params(min_score=117)
    with program.queue_log(spark, str(tmp_path / "queue.json"), 0.05) as samples:
        got = program.run(spark, [str(tmp_path / f"{g}.fa") for g in "ab"], str(tmp_path / "out"), params, group="whole")
    assert len(samples) > 2 and json.loads((tmp_path / "queue.json").read_text()) == samples
    counters = got.counters
    assert counters["sequences"] == 8 and counters["matches"] == got.matches.count() <= counters["full_alignments"] <= counters["threshold_alignments"]
    pairs = C.candidate_pairs(got.clusters, got.sequences).collect()
    seqs = {r.abs_id: encode(r.seq) for r in got.sequences.collect()}
    aligned = passes([seqs[r.abs1] for r in pairs], [seqs[r.abs2] for r in pairs], Environments(params).log_pam)
    assert (counters["threshold_alignments"], counters["full_alignments"]) == (len(pairs), aligned.sum())
    files = {str(p.relative_to(tmp_path / "out/matches")) for p in (tmp_path / "out/matches").glob("*/*") if not p.name.startswith(".")}
    assert files <= {"a/a", "a/b", "b/b"} and "a/b" in files
    back = G.read_matches(spark, str(tmp_path / "out/matches"))
    assert back.count() == got.matches.count() > 3
    more = program.run(spark, [str(tmp_path / "c.fa")], str(tmp_path / "more"), params, prior=str(tmp_path / "out/clusters.json.gz"), duplicate_threshold=0)
    assert more.counters["sequences"] == 12 and {i for x in more.clusters.collect() for i in x.members} == set(range(12))
    assert G.read_clusters(spark, str(tmp_path / "more/clusters.json.gz"))[1] == [str(tmp_path / f"{g}.fa") for g in "abc"]
    alone = program.run(spark, [str(tmp_path / "c.fa")], str(tmp_path / "alone"), params, only_clusters=True)
    assert alone.matches.count() == 0 and not (tmp_path / "alone/matches").exists()
    program.cancel(spark, "whole")


STREAM = "genome string, genome_index int, meta string, seq string"


def test_stream(spark, tmp_path):
    """A genome cut over two batches, a batch without rows, and a restart."""
    src = tmp_path / "in"
    w = "ACDEFGHIKLMNPQRSTVWY" * 4
    for rows in ([("a", 0, "", w), ("b", 0, "", w[::-1])], [], [("a", 1, "", w), ("b", 1, "", w[::-1])]):
        spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(str(src))
        q = cluster_stream(spark.readStream.schema(STREAM).parquet(str(src)), str(tmp_path / "state"))
        q.processAllAvailable()
        q.stop()
    state = str(tmp_path / "state")
    assert {i for r in incremental.clusters(spark, state).collect() for i in r.members} == {0, 1, 2, 3}
    got = sorted((r.abs_id, r.genome, r.genome_index, r.genome_size) for r in incremental.sequences(spark, state).collect())
    assert got == [(0, "a", 0, 2), (1, "b", 0, 2), (2, "a", 1, 2), (3, "b", 1, 2)]


def test_batches_add_up(spark, tmp_path):
    """Genomes cut over three batches, indexes with gaps, an empty and a repeated batch: ids, sequences and clusters of a plain run over the same parts."""
    r = random.Random(4)
    base = ["".join(r.choice(ORDER) for _ in range(50)) for _ in range(2)]
    near = lambda k: "".join(c if r.random() > 0.2 else r.choice(ORDER) for c in base[k % 2])
    parts = [[(f"g{i % 2}", 10 * k + 5 + i, f"{k}.{i}", near(i)) for i in range(4)] for k in range(3)]
    params, state = Params(min_score=80, min_full_merge_score=1e9), str(tmp_path / "state")
    frame = lambda rows: spark.createDataFrame(rows, STREAM)
    incremental.add_batch(frame(parts[0]), 0, state, params)
    incremental.add_batch(frame([]), 1, state, params)
    incremental.add_batch(frame(parts[1]), 2, state, params)
    before = incremental.clusters(spark, state).orderBy("pos").collect()
    (tmp_path / "state/genomes/v2/_SUCCESS").unlink()  # the batch failed before its version was whole
    assert incremental.versions(spark, state) == [0]
    incremental.add_batch(frame(parts[1][::-1]), 2, state, params)
    assert incremental.clusters(spark, state).orderBy("pos").collect() == before
    incremental.add_batch(frame(parts[2]), 5, state, params)
    assert incremental.versions(spark, state) == [2, 5]
    count, old, clusters = {}, [], None
    for part in parts:
        new = []
        for genome, _, meta, seq in sorted(part):
            new.append((len(old) + len(new), genome, count.get(genome, 0), meta, seq))
            count[genome] = count.get(genome, 0) + 1
        cols = "abs_id int, genome string, genome_index int, meta string, seq string"
        more = spark.createDataFrame(new, cols)
        clusters = C.cluster(more, params) if clusters is None else C.add_genomes(clusters, spark.createDataFrame(old, cols), more, params)
        old += new
    got = sorted((x.abs_id, x.genome, x.genome_index, x.meta, x.seq) for x in incremental.sequences(spark, state).collect())
    assert got == old and {x.genome_size for x in incremental.sequences(spark, state).collect()} == {6}
    assert incremental.clusters(spark, state).orderBy("pos").collect() == clusters.orderBy("pos").collect()


def test_gaps_in_a_genome_fail(spark):
    rows = lambda *index: spark.createDataFrame([("a", i, "", "ACD") for i in index], STREAM)
    for index in ((5, 6), (0, 0, 1), (0, 2)):
        with pytest.raises(Exception, match="gaps in genome a"):
            G.numbered(rows(*index)).collect()
        assert sorted(r.genome_index for r in G.numbered_on(rows(*index), "genome_index").collect()) == list(range(len(index)))
    assert [r.abs_id for r in G.numbered(rows(1, 0)).orderBy("genome_index").collect()] == [0, 1]


MATCHES = "genome1 string, genome2 string, idx1 int, idx2 int, score double, distance double, seq1_min int, seq1_max int, seq2_min int, seq2_max int, variance double, cluster_size int"


def test_match_files_are_whole_or_not_there(spark, tmp_path):
    out = tmp_path / "m"
    rows = lambda *pairs: spark.createDataFrame([(a, b, i, i, 5.0, 1.0, 0, 1, 0, 1, 0.5, 2) for a, b, n in pairs for i in range(n)], MATCHES).repartition(5)
    files = lambda: sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file())
    G.write_matches(rows(("a", "b", 40), ("a", "c d%", 1), ("ü", "a", 3)), str(out))
    assert files() == ["a/b", "a/c d%", "ü/a"]
    text = (out / "a/b").read_text()
    assert text.startswith("# AllAll of a vs b;\nRefinedMatches(\n[[1, 1, ") and text.endswith("] ]):\n") and text.count(",\n[") == 39
    assert G.read_matches(spark, str(out)).count() == 44
    bad = rows(("a", "b", 3), ("x", "y", 3)).withColumn("score", F.when(F.col("genome1") == "x", F.raise_error(F.lit("no score")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="no score"):
        G.write_matches(bad, str(out))
    assert files() == ["a/b", "a/c d%", "ü/a"] and (out / "a/b").read_text() == text  # earlier output is as it was
    assert [p.name for p in tmp_path.iterdir()] == ["m"]
    G.write_matches(rows(("a", "b", 2)), str(out))  # replaced, nothing of the earlier run stays
    assert files() == ["a/b"]
    G.write_matches(rows(), str(out))
    assert files() == [] and out.is_dir()


def test_a_large_pair_is_written_in_parts(spark, tmp_path, monkeypatch):
    """No partition that is sorted holds many more rows than a part; small pairs stay one file each, and parts by name are in the order of indexes."""
    monkeypatch.setattr(G, "PART_ROWS", 100)
    out, sorted_rows = tmp_path / "m", []
    rows = [("a", "b", i // 3, i % 3 if i % 50 else 7, 5.0, 1.0, 0, 1, 0, 1, 0.5, i) for i in range(1500)] + [(f"s{k}", g, i, i, 5.0, 1.0, 0, 1, 0, 1, 0.5, 2) for k in range(9) for g in ("b", "c") for i in range(30)]
    df = spark.createDataFrame(rows, MATCHES).repartition(5)
    G.write_matches(df, str(out))
    assert sorted(str(p.relative_to(out)) for p in out.glob("s*/*")) == [f"s{k}/{g}" for k in range(9) for g in "bc"] and all(p.is_file() for p in out.glob("s*/*"))
    parts = sorted((out / "a/b").iterdir())
    for p in parts:
        text = p.read_text()
        assert text.startswith("# AllAll of a vs b;\nRefinedMatches(\n[[") and text.endswith("] ]):\n")
        sorted_rows.append([tuple(map(int, re.match(r"\[*(\d+), (\d+)", x).groups())) for x in text.splitlines()[2:]])
    assert len(parts) > 8 and max(map(len, sorted_rows)) < 250
    assert sum(sorted_rows, []) == sorted((r[2] + 1, r[3] + 1) for r in rows if r[0] == "a")
    back = lambda: sorted((r.genome1, r.genome2, r.seq1, r.seq2, r.cluster_size) for r in G.read_matches(spark, str(out)).collect())
    want = sorted((r[0], r[1], r[2] + 1, r[3] + 1, r[-1]) for r in rows)
    assert back() == want
    monkeypatch.setattr(G, "PART_ROWS", 1 << 18)  # replaced by one file
    G.write_matches(df, str(out))
    assert (out / "a/b").is_file() and back() == want


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    writer = MatchWriter(str(tmp_path / "m"))
    rows = [{"genome1": "a", "genome2": b, "value": f"[{k}]"} for b in "bc" for k in range(3)]

    def broken():
        yield from rows[:2]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    first, again = writer.write(iter(rows)), writer.write(iter(rows))
    assert first.files == again.files == ["a/b", "a/c"]
    writer.commit([again, None])
    assert (tmp_path / "m/a/b").read_text() == "# AllAll of a vs b;\nRefinedMatches(\n[[0],\n[1],\n[2] ]):\n"
    with pytest.raises(ValueError, match="more than one partition"):
        writer.commit([first, again])


def test_scan_lines(spark):
    scores = spark.createDataFrame([(0, 1, 12.0), (0, 2, 60.0), (1, 0, 12.3456789), (2, 0, 1234567.5), (1, 1, 0.00001)], "query long, target long, score double")
    names = spark.createDataFrame([(0, "q 0"), (1, None), (2, "z")], "id long, meta string")
    got = {(r.query, r.target): r.line for r in C.scan_lines(scores, names, names, 1e6).collect()}
    assert got == {(0, 1): "12\t x q 0", (0, 2): "60\tz x q 0", (1, 0): "12.3457\tq 0 x ", (2, 0): ">threshold\tq 0 x z", (1, 1): "1e-05\t x "}


def test_distances_are_cut(spark):
    rows = [(45.99, "45"), (45.0, "45"), (44.99996, "45.0000"), (0.1, "0.10000000"), (0.012345678, "0.01234568"), (300.5, "300")]
    df = spark.createDataFrame([(0, 0, 1.0, d, 0, 1, 0, 1, 0.5, 2) for d, _ in rows], "idx1 int, idx2 int, score double, distance double, seq1_min int, seq1_max int, seq2_min int, seq2_max int, variance double, cluster_size int")
    assert [r[0].split(", ")[3] for r in df.select(G.match_row(df)).collect()] == [t for _, t in rows]


def test_registry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert entry.entry(spark).columns[:2] == ["abs1", "abs2"]
