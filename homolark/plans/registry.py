"""Registered queries of the engine's own operators, each with its DuckDB SQL where SQL can express it.

Sequences come from whole tables: residues are the letters of a text, upper-cased. Alignment queries use the `benchmark` table,
whose texts are of protein length; `documents` serves the queries without a kernel. Clusterings for the set queries are lists
that plain grouping makes, so that both sides can build them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.matrices import GAP_EXTEND, GAP_OPEN, Environment, Params, blosum62
from ..operators import clustering as C
from ..operators import evaluation as V
from ..operators.merging import Cluster, meet, schedule
from ..sources.genomes import genome_sizes, match_row, numbered_on, pack_bases, read_agd, read_clusters, read_fasta, read_genomes, read_matches, unpack_bases, write_agd, write_clusters, write_fasta, write_matches
from . import alignment_sql as A
from . import merge_sql as G
from .session import cut, shared_dir

PARAMS = Params(min_score=181, min_full_merge_score=250.0)  # prose is of low complexity for a protein matrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(text: str = "text") -> F.Column:
    return F.coalesce(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), F.lit(""))


def _sized(rows: DataFrame) -> DataFrame:
    sizes = genome_sizes(rows).select("genome", F.col("genome_size").cast("int").alias("genome_size"))
    return rows.join(sizes, "genome").select("abs_id", "genome", "genome_size", "genome_index", "meta", "seq", "len")


def unnumbered(spark, sf_dir) -> DataFrame:
    """documents as genomes by source."""
    d = table(spark, sf_dir, "documents")
    own = d.select("doc_id", F.coalesce("source", F.lit("")).alias("genome"), F.col("doc_id").cast("string").alias("meta"), _letters().alias("seq"))
    return own.withColumn("len", F.length("seq"))


def sequences(spark, sf_dir) -> DataFrame:
    return _sized(numbered_on(unnumbered(spark, sf_dir), "doc_id"))


def items(spark, sf_dir) -> DataFrame:
    """benchmark as genomes of eight items."""
    b = table(spark, sf_dir, "benchmark")
    own = b.select("item_id", F.concat(F.lit("g"), F.floor(F.col("item_id") / 8)).alias("genome"), F.col("item_id").cast("string").alias("meta"), _letters().alias("seq"))
    return _sized(numbered_on(own, "item_id"))


def incremental_ids(spark, sf_dir) -> DataFrame:
    """documents that come in three batches, which cut every genome: ids and indexes go on from batch to batch."""
    rows, sizes, first, out = unnumbered(spark, sf_dir), None, 0, None
    for k in range(3):
        new = cut(numbered_on(rows.where(F.pmod("doc_id", F.lit(3)) == k), "doc_id", known=sizes, first=first).select("doc_id", "genome", "abs_id", "genome_index"))
        sizes, first = cut(genome_sizes(new, sizes)), first + new.count()
        out = new if out is None else out.unionByName(new)
    return out.join(sizes, "genome").select("doc_id", "abs_id", "genome", "genome_index", F.col("genome_size").cast("int").alias("genome_size"))


SEQ = """with raw as (select doc_id, coalesce(source, '') as genome, coalesce(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '') as seq from documents),
seqs as (select (row_number() over (order by genome, doc_id) - 1)::int as abs_id, genome, count(*) over (partition by genome)::int as genome_size,
  (row_number() over (partition by genome order by doc_id) - 1)::int as genome_index, doc_id::varchar as meta, seq, length(seq)::int as len from raw)
"""

# lists of items by order: customers of a nation as a cluster, and the same by order count
LISTS = """with c as (select (o_orderkey % 97)::int as pos, list(distinct o_custkey order by o_custkey) as members from orders group by 1)
"""


def lists(spark, sf_dir, by: int = 97) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_orderkey") % by).cast("int").alias("pos")).agg(F.array_sort(F.collect_set("o_custkey")).alias("members"))


def result_rows(spark, sf_dir, shift: int) -> DataFrame:
    """Match-like rows from lineitem: two runs that differ where the quantity does."""
    x = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    return x.where(q % 7 != shift).select(F.col("l_returnflag").alias("genome1"), F.col("l_linestatus").alias("genome2"), F.col("l_orderkey").cast("int").alias("seq1"), F.col("l_linenumber").cast("int").alias("seq2"), F.lit(1).alias("a1"), q.alias("b1"), F.lit(1).alias("a2"), (q + F.when(q % 11 == shift, 1).otherwise(0)).alias("b2"), (q * 10).alias("score"))


def _rows_sql(shift: int) -> str:
    return f"""select l_returnflag as genome1, l_linestatus as genome2, l_orderkey::int as seq1, l_linenumber::int as seq2, 1 as a1, trunc(l_quantity)::int as b1, 1 as a2,
  (trunc(l_quantity)::int + case when trunc(l_quantity)::int % 11 = {shift} then 1 else 0 end)::int as b2, (trunc(l_quantity)::int * 10)::int as score
  from lineitem where trunc(l_quantity)::int % 7 <> {shift}"""


RUNS = f"with a as ({_rows_sql(0)}), b as ({_rows_sql(1)})\n"
COLS = ", ".join(V.KEY)


def _runs(f):
    return lambda s, d: f(result_rows(s, d, 0), result_rows(s, d, 1))


_SCALED = Environment(blosum62(), GAP_OPEN, GAP_EXTEND, PARAMS.min_score).scaled()
SELF = " + ".join(f"{int(blosum62()[k, k])} * length(regexp_replace(seq, '[^{chr(65 + k)}]', '', 'g'))" for k in range(26) if blosum62()[k, k])


def _pairs(spark, sf_dir) -> DataFrame:
    s = items(spark, sf_dir)
    side = lambda n: s.select(*[F.col(c).alias(c + n) for c in ("abs_id", "genome", "genome_size", "genome_index", "len")])
    return side("1").join(side("2"), F.col("abs_id1") < F.col("abs_id2"))


ITEMS = """with raw as (select item_id, 'g' || (item_id // 8) as genome, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as seq from benchmark),
seqs as (select (row_number() over (order by genome, item_id) - 1)::int as abs_id, genome, count(*) over (partition by genome)::int as genome_size,
  (row_number() over (partition by genome order by item_id) - 1)::int as genome_index, item_id, seq, length(seq)::int as len from raw)
"""


def pair_orientation(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    swap = C.oriented_second(*[F.col(c) for c in ("genome_size1", "genome1", "genome_index1", "genome_size2", "genome2", "genome_index2")])
    return p.select(F.when(swap, F.col("abs_id2")).otherwise(F.col("abs_id1")).alias("first"), F.when(swap, F.col("abs_id1")).otherwise(F.col("abs_id2")).alias("second"))


def length_constraint(spark, sf_dir):
    """The rule of a match, as if a third and a quarter of the residues were aligned."""
    a, b = (F.floor(F.col(c) / k) for c, k in (("len1", 3), ("len2", 4)))
    return _pairs(spark, sf_dir).select("abs_id1", "abs_id2", C.long_enough(a, b, F.col("len1"), F.col("len2")).alias("passes"))


def merge_schedule(spark, sf_dir):
    rows = schedule(table(spark, sf_dir, "benchmark").count())
    return spark.createDataFrame(rows, "merge_id int, left_item int, right_item int, level int").drop("level")


def customers(spark, sf_dir) -> DataFrame:
    """customer as sequences of genomes by nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("abs_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("genome"))
    w = Window.partitionBy("genome")
    return c.withColumns({"genome_size": F.count("*").over(w).cast("int"), "genome_index": F.row_number().over(w.orderBy("abs_id")) - 1})


def pair_dedup(spark, sf_dir):
    """Pairs within clusters of customers, each once, oriented, with the size of the largest cluster that holds it."""
    clusters = lists(spark, sf_dir, 997).withColumn("members", F.transform("members", lambda m: m.cast("long")))
    return C.candidate_pairs(clusters, customers(spark, sf_dir), named=False)


def scratch(spark, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fasta_round_trip(spark, sf_dir):
    """Sequences of documents, written as FASTA and read back."""
    path = scratch(spark, "fasta")
    write_fasta(sequences(spark, sf_dir), path)
    return read_fasta(spark, path, strict=True).select("meta", "seq")


def agd_round_trip(spark, sf_dir):
    """Items, written in chunks of 16 and read back, numbered as a dataset."""
    path = scratch(spark, "agd")
    manifest = write_agd(items(spark, sf_dir).select(F.col("abs_id").alias("ordinal"), "meta", "seq"), path, "set", 16)
    return read_genomes(spark, manifest).select("abs_id", "genome", "genome_size", "meta", "seq")


def agd_range(spark, sf_dir):
    """Items in chunks of 8, of which one column and the middle half of the ordinals are read back."""
    own = items(spark, sf_dir).select(F.col("abs_id").alias("ordinal"), "meta", "seq")
    manifest, n = write_agd(own, scratch(spark, "agd"), "set", 8), own.count()
    return read_agd(spark, manifest, ("metadata",), n // 4, 3 * n // 4).select("ordinal", F.decode("metadata", "utf-8").alias("meta"))


def bases_round_trip(spark, sf_dir):
    """Sequences of documents, packed as bases of three bits and unpacked."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(bases=[unpack_bases(pack_bases(s)) for s in pdf["seq"]])[["abs_id", "bases"]]

    return sequences(spark, sf_dir).select("abs_id", "seq").mapInPandas(run, "abs_id int, bases string")


def _text(members) -> F.Column:
    return F.array_join(F.transform(members, lambda m: m.cast("string")), ",")


def clusters_round_trip(spark, sf_dir):
    """Clusters of customers, written as the document and read back."""
    path = scratch(spark, "clusters")
    write_clusters(lists(spark, sf_dir), customers(spark, sf_dir), path, ["customer"])
    return read_clusters(spark, f"{path}.gz")[0].select("pos", _text("members").alias("members"))


def clusters_parts_round_trip(spark, sf_dir):
    """As clusters_round_trip, the document left as a folder of the parts that tasks wrote."""
    path = scratch(spark, "clusters")
    write_clusters(lists(spark, sf_dir), customers(spark, sf_dir), path, ["customer"], joined=False)
    return read_clusters(spark, path)[0].select("pos", _text("members").alias("members"))


def match_rows(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    return x.select(F.col("l_returnflag").alias("genome1"), F.col("l_linestatus").alias("genome2"), F.col("l_orderkey").cast("int").alias("idx1"), F.col("l_linenumber").cast("int").alias("idx2"), (q + 0.25).cast("double").alias("score"), (q / 8).cast("double").alias("distance"), F.lit(0).alias("seq1_min"), q.alias("seq1_max"), F.lit(2).alias("seq2_min"), q.alias("seq2_max"), F.lit(0.5).alias("variance"), F.lit(3).alias("cluster_size"))


def matches_round_trip(spark, sf_dir):
    """Matches from line items, written as a file for each pair of genomes and read back, with the score cut at 5."""
    path = scratch(spark, "matches")
    write_matches(match_rows(spark, sf_dir), path)
    return read_matches(spark, path, 5)


def quantized_matrix(spark, sf_dir):
    """The whole-number BLOSUM62 and gap costs of threshold 181."""
    m, gap_open, gap_extend = _SCALED
    rows = [(chr(65 + i), chr(65 + j), int(m[i, j])) for i in range(26) for j in range(26)]
    return spark.createDataFrame([*rows, ("open", "", gap_open), ("extend", "", gap_extend)], "a string, b string, scaled long")


def merge_outcomes(spark, sf_dir):
    """What happens to two clusters of one member, with scores and uncovered residues from line items."""

    class One:
        def __init__(self, ok, *edge):
            self.ok, self.edge = ok, edge

        def passes(self, a, b):
            return self.ok

        def align(self, a, b):
            return self.edge

    def run(batches):
        for pdf in batches:
            pdf["outcome"] = [meet(Cluster([0]), Cluster([1]), One(ok, s, a, b), 15, 200.0) for ok, s, a, b in zip(pdf["ok"], pdf["s"], pdf["ua"], pdf["ub"], strict=True)]
            yield pdf[["o", "n", "outcome"]]

    q = F.col("l_quantity").cast("int")
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("int").alias("n"), (q % 5 != 0).alias("ok"), (195 + q / 4).cast("double").alias("s"), (F.col("l_orderkey") % 31).cast("int").alias("ua"), (F.col("l_partkey") % 31).cast("int").alias("ub"))
    return x.mapInPandas(run, "o long, n int, outcome string")


def formatted(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    m = x.select(F.col("l_orderkey").cast("int").alias("idx1"), F.col("l_linenumber").cast("int").alias("idx2"), q.cast("double").alias("score"), (q * 4).cast("double").alias("distance"), F.lit(0).alias("seq1_min"), q.alias("seq1_max"), F.lit(2).alias("seq2_min"), q.alias("seq2_max"), F.lit(0.5).alias("variance"), F.lit(3).alias("cluster_size"))
    return m.select(match_row(m).alias("row"))


def _unsorted(spark, sf_dir) -> DataFrame:
    """Two lines a list: equal sets of an order and its reverse are different lists."""
    o = table(spark, sf_dir, "orders").where("o_custkey <> o_orderkey % 50")
    a = o.select(F.col("o_orderkey").cast("int").alias("pos"), F.array(F.col("o_custkey").cast("long"), (F.col("o_orderkey") % 50).cast("long")).alias("members"))
    return a.unionByName(a.where("o_orderkey % 2 = 0").select((F.col("pos") + (1 << 24)).alias("pos"), F.reverse("members").alias("members")))


def clusters(spark, sf_dir, mode: str = "sequential"):
    return C.cluster(items(spark, sf_dir), PARAMS, mode).select("pos", _text("members").alias("members"))


def scan_text(spark, sf_dir):
    """All items against all items as lines of text, with a threshold of 60."""
    own = cut(items(spark, sf_dir).select(F.col("abs_id").cast("long").alias("id"), "meta", "seq"))
    return C.scan_lines(C.query_scan(own, own, PARAMS), own, own, 60.0)


def set_meets_one(spark, sf_dir):
    """All items but the first as clusters of one, and the first as the cluster that they meet: positional diffs."""
    s = items(spark, sf_dir).select(F.col("abs_id").cast("long").alias("abs_id"), "seq")
    left = s.where("abs_id > 0").select((F.col("abs_id") - 1).cast("int").alias("pos"), F.array("abs_id").alias("members"))
    return C.merge_with_one(left, [0], s, PARAMS)[0].select("pos", _text("added").alias("added"), "fully_merged")


def cluster_matches(spark, sf_dir):
    s = items(spark, sf_dir)
    return C.matches(C.candidate_pairs(C.cluster(s, PARAMS), s), s, PARAMS)


def events_rate(spark, sf_dir):
    e = V.rates(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")
    return e.select("event_id", "rate")


QUERIES = {
    "sequences_load": lambda s, d: sequences(s, d),
    "genome_sizes": lambda s, d: V.totals(unnumbered(s, d), "genome"),
    "sequence_totals": lambda s, d: V.totals(unnumbered(s, d)),
    "residue_histogram": lambda s, d: V.residues(unnumbered(s, d)),
    "length_guard": lambda s, d: C.guarded(sequences(s, d)).select("abs_id", "len"),
    "db_lengths": lambda s, d: unnumbered(s, d).select("len", "meta"),
    "substitution_self_score": lambda s, d: sequences(s, d).select("abs_id", C.self_score(F.col("seq"), blosum62()).alias("self_score")),
    "pair_orientation": pair_orientation,
    "length_constraint": length_constraint,
    "merge_schedule": merge_schedule,
    "sw_similar_pairs": lambda s, d: C.similar_pairs(items(s, d), PARAMS),
    "query_scan": lambda s, d: (lambda x: C.query_scan(x, x, PARAMS))(items(s, d).select(F.col("abs_id").cast("long").alias("id"), "seq")),
    "clusters_sequential": clusters,
    "clusters_parallel": lambda s, d: clusters(s, d, "parallel"),
    "scan_text": scan_text,
    "set_meets_one": set_meets_one,
    "incremental_ids": incremental_ids,
    "cluster_matches": cluster_matches,
    "cluster_dedup_sorted": lambda s, d: C.drop_repeated_clusters(lists(s, d)).select("pos", F.size("members").alias("size")),
    "cluster_size_histogram": lambda s, d: V.size_histogram(lists(s, d)),
    "biggest_clusters": lambda s, d: V.biggest(lists(s, d)),
    "cluster_report": lambda s, d: V.cluster_report(lists(s, d)),
    "cluster_diff": lambda s, d: V.clusters_minus(lists(s, d), lists(s, d, 89)).select(F.size("members").alias("size")),
    "rep_intersection": lambda s, d: V.common_representatives(lists(s, d), lists(s, d, 89)),
    "pair_dedup_first_cluster": pair_dedup,
    "match_format": formatted,
    "match_union": _runs(V.union),
    "match_intersect": _runs(V.both),
    "match_minus": _runs(V.minus),
    "match_symdiff": _runs(V.symmetric),
    "match_duplicates": lambda s, d: V.duplicates(result_rows(s, d, 0).drop("seq1").withColumn("seq1", F.lit(1))),
    "recall_report": _runs(V.recall),
    "missed_score_stats": _runs(V.missed_scores),
    "rate_from_counters": events_rate,
    "elapsed_since_first": lambda s, d: V.elapsed(table(s, d, "events"), "user_id", "ts").select("event_id", "elapsed_us"),
    "avg_by_group": lambda s, d: V.averages(table(s, d, "events"), "event_type", "value").select("event_type", "n", F.round("mean", 6).alias("avg_value")),
    "fasta_round_trip": fasta_round_trip,
    "agd_round_trip": agd_round_trip,
    "agd_range": agd_range,
    "bases_round_trip": bases_round_trip,
    "clusters_round_trip": clusters_round_trip,
    "clusters_parts_round_trip": clusters_parts_round_trip,
    "matches_round_trip": matches_round_trip,
    "quantized_matrix": quantized_matrix,
    "merge_outcomes": merge_outcomes,
    "cluster_dedup_ordered": lambda s, d: C.drop_repeated_clusters(_unsorted(s, d), ordered=True, threshold=10).select("pos", F.size("members").alias("size")),
    "clusters_marshalled": lambda s, d: C.marshalled(lists(s, d)).select("pos", F.size("members").alias("size")),
    "missed_sorted": _runs(V.missed_sorted),
    "missed_histogram": _runs(V.missed_histogram),
}

_MERGE = ITEMS.replace("with raw", "with recursive raw") + ", " + G.edges(_SCALED, blosum62(), int(GAP_OPEN), int(GAP_EXTEND), PARAMS.max_uncovered, PARAMS.min_full_merge_score)
_LAST = " select (x - 1)::int as pos, array_to_string(q[1][x], ',') as members from done, unnest(range(1, len(q[1]) + 1)) as t(x)"
_A89 = LISTS + ", e as (select (o_orderkey % 89)::int as pos, list(distinct o_custkey order by o_custkey) as members from orders group by 1)\n"
ORACLES = {
    "sequences_load": SEQ + "select * from seqs",
    "genome_sizes": SEQ + "select genome, count(*) as n, sum(len)::bigint as residues from seqs group by genome",
    "residue_histogram": SEQ + "select residue, count(*) as n from (select unnest(string_split(seq, '')) as residue from seqs) where residue <> '' group by residue",
    "sequence_totals": SEQ + "select count(*) as n, sum(len)::bigint as residues from seqs",
    "length_guard": SEQ + "select abs_id, len from seqs",
    "db_lengths": SEQ + "select len, meta from seqs",
    "substitution_self_score": SEQ + f"select abs_id, ({SELF})::bigint as self_score from seqs",
    "pair_orientation": ITEMS + """select case when s then y else x end as first, case when s then x else y end as second from (select a.abs_id as x, b.abs_id as y,
  case when a.genome = b.genome then b.genome_index < a.genome_index else b.genome_size < a.genome_size or (b.genome_size = a.genome_size and b.genome < a.genome) end as s
  from seqs a join seqs b on a.abs_id < b.abs_id)""",
    "length_constraint": ITEMS + "select a.abs_id as abs_id1, b.abs_id as abs_id2, least(a.len // 3, b.len // 4) >= greatest(30.0, 0.3 * least(a.len, b.len)) as passes from seqs a join seqs b on a.abs_id < b.abs_id",
    "sw_similar_pairs": ITEMS.replace("with raw", "with recursive raw") + ", " + ",\n".join([
        A.CODES, A.pairs("p", "a.abs_id < b.abs_id"), A.aligned("whole", "p", _SCALED[0], _SCALED[1], _SCALED[2]),
        "ok as (select p.* from p join whole using (x, y) where score >= 65535)", A.aligned("ahead", "ok", blosum62(), int(GAP_OPEN), int(GAP_EXTEND)),
        A.backwards("back", "ok", "ahead"), A.aligned("behind", "back", blosum62(), int(GAP_OPEN), int(GAP_EXTEND))])
        + """ select x as abs1, y as abs2, a.score::double as score, (a.e1 - b.e1)::int as seq1_min, a.e1::int as seq1_max, (a.e2 - b.e2)::int as seq2_min, a.e2::int as seq2_max
  from ahead a join behind b using (x, y)""",
    "query_scan": ITEMS.replace("with raw", "with recursive raw") + ", " + ",\n".join([A.CODES, A.pairs("p", "true"), A.aligned("whole", "p", blosum62(), int(GAP_OPEN), int(GAP_EXTEND))])
        + " select x::bigint as query, y::bigint as target, score::double as score from whole",
    "scan_text": ITEMS.replace("with raw", "with recursive raw") + ", " + ",\n".join([A.CODES, A.pairs("p", "true"), A.aligned("whole", "p", blosum62(), int(GAP_OPEN), int(GAP_EXTEND))])
        + """ select x::bigint as query, y::bigint as target, case when score >= 60 then '>threshold' else score::varchar end || chr(9) || b.item_id || ' x ' || a.item_id as line
  from whole join seqs a on a.abs_id = x join seqs b on b.abs_id = y""",
    "merge_schedule": "select k::int as merge_id, (2 * k)::int as left_item, (2 * k + 1)::int as right_item from (select unnest(range((select count(*) from benchmark) - 1)) as k)",
    "clusters_sequential": f"{_MERGE}, {G.merged('sequential', G.SINGLES)} {_LAST}",
    "clusters_parallel": f"{_MERGE}, {G.merged('parallel', G.SINGLES)} {_LAST}",
    "set_meets_one": f"""{_MERGE}, {G.merged('one', "select [list([abs_id] order by abs_id) filter (abs_id > 0), [[0]]] as q, list(len order by abs_id) as lens from seqs")}
  select (x - 1)::int as pos, array_to_string(l[x][2:], ',') as added, ld[x] as fully_merged from done, unnest(range(1, len(l) + 1)) as t(x) where len(l[x]) > 1 or ld[x]
  union all select -1, array_to_string(r[1][2:], ','), false from done where not rd[1]""",
    "incremental_ids": """with d as (select doc_id, coalesce(source, '') as genome, (doc_id % 3 + 3) % 3 as batch from documents)
  select doc_id, (row_number() over (order by batch, genome, doc_id) - 1)::int as abs_id, genome, (row_number() over (partition by genome order by batch, doc_id) - 1)::int as genome_index,
  count(*) over (partition by genome)::int as genome_size from d""",
    "cluster_dedup_sorted": LISTS + "select min(pos) as pos, any_value(len(members))::int as size from c group by members",
    "cluster_size_histogram": LISTS + "select len(members)::int as size, count(*) as n_clusters from c group by 1",
    "biggest_clusters": LISTS + "select pos, len(members)::int as size from c order by size desc, pos limit 5",
    "cluster_report": LISTS + "select count(*) as n_clusters, count(distinct members) as n_distinct, count(distinct members[1]) as n_representatives from c",
    "cluster_diff": _A89 + "select len(members)::int as size from (select members from c except select members from e)",
    "rep_intersection": _A89 + "select members[1] as representative from c intersect select members[1] from e",
    "pair_dedup_first_cluster": """with c as (select distinct o_orderkey % 997 as pos, o_custkey as m from orders), z as (select pos, count(*)::int as size from c group by pos),
  s as (select c_custkey as m, 'n' || c_nationkey as g, count(*) over (partition by c_nationkey) as n, c_custkey as i from customer),
  e as (select pos, size, m, g, n, i from c join z using (pos) join s using (m)),
  p as (select a.size, a.m as x, b.m as y, case when a.g = b.g then b.i < a.i else b.n < a.n or (b.n = a.n and b.g < a.g) end as swap from e a join e b on a.pos = b.pos and a.m < b.m)
  select case when swap then y else x end::bigint as abs1, case when swap then x else y end::bigint as abs2, max(size)::int as cluster_size from p group by 1, 2""",
    "fasta_round_trip": SEQ + "select meta, seq from seqs",
    "agd_round_trip": ITEMS + "select abs_id, 'set' as genome, (select count(*) from seqs)::int as genome_size, item_id::varchar as meta, seq from seqs",
    "agd_range": ITEMS + "select abs_id::bigint as ordinal, item_id::varchar as meta from seqs, (select count(*) as n from seqs) where abs_id between n // 4 and 3 * n // 4",
    "bases_round_trip": SEQ + "select abs_id, regexp_replace(seq, '[^ACGT]', 'N', 'g') as bases from seqs",
    "clusters_parts_round_trip": LISTS + "select (row_number() over (order by pos) - 1)::int as pos, array_to_string(members, ',') as members from c",
    "clusters_round_trip": LISTS + "select (row_number() over (order by pos) - 1)::int as pos, array_to_string(members, ',') as members from c",
    "matches_round_trip": """select lower(l_returnflag) as genome1, lower(l_linestatus) as genome2, (l_orderkey + 1)::int as seq1, (l_linenumber + 1)::int as seq2, q as score, q / 8.0::double as distance,
  1 as a1, q + 1 as b1, 3 as a2, q + 1 as b2, 0.5::double as variance, 3 as cluster_size from (select *, trunc(l_quantity)::int as q from lineitem) where q + 0.25 >= 5""",
    "quantized_matrix": f"""with m as (select unnest(range(676))::int as k, unnest([{', '.join(str(int(v)) for v in blosum62().ravel())}]) as v), f as (select 65535.0::double / {PARAMS.min_score} as f)
  select chr(65 + k // 26) as a, chr(65 + k % 26) as b, greatest(ceil(v * f), -32767)::bigint as scaled from m, f
  union all select 'open', '', ceil({int(GAP_OPEN)} * f)::bigint from f union all select 'extend', '', ceil({int(GAP_EXTEND)} * f)::bigint from f""",
    "merge_outcomes": """with x as (select l_orderkey::bigint as o, l_linenumber::int as n, trunc(l_quantity)::int % 5 <> 0 as ok, 195 + trunc(l_quantity)::int / 4.0::double as s, l_orderkey % 31 as ua, l_partkey % 31 as ub from lineitem)
  select o, n, case when not ok then 'none' when ua < 15 and s > 200 then 'into_other' when ub < 15 and s > 200 then 'into_own' else 'partial' end as outcome from x""",
    "cluster_dedup_ordered": """with o as (select o_orderkey as pos, [o_custkey::bigint, (o_orderkey % 50)::bigint] as members from orders where o_custkey <> o_orderkey % 50),
  u as (select pos, members from o union all select pos + (1 << 24), list_reverse(members) from o where pos % 2 = 0)
  select min(pos)::int as pos, any_value(len(members))::int as size from u group by members""",
    "clusters_marshalled": LISTS + "select pos, len(members)::int as size from c order by size desc, pos desc",
    "missed_sorted": RUNS + f"select *, rank() over (order by score desc) as rank from (select {COLS} from a except select {COLS} from b)",
    "missed_histogram": RUNS + f"select (score // 50 * 50)::bigint as low, count(*) as n from (select {COLS} from a except select {COLS} from b) group by 1",
    "match_format": """select '[' || (l_orderkey + 1) || ', ' || (l_linenumber + 1) || ', ' || printf('%.7f', q::double) || ', ' || case when 4 * q >= 45 then (4 * q)::varchar else printf('%.4f', (4 * q)::double) end
  || ', 1..' || (q + 1) || ', 3..' || (q + 1) || ', 0.50000000, 3]' as row from (select *, trunc(l_quantity)::int as q from lineitem)""",
    "match_union": RUNS + f"select {COLS} from a union select {COLS} from b",
    "match_intersect": RUNS + f"select {COLS} from a intersect select {COLS} from b",
    "match_minus": RUNS + f"select {COLS} from a except select {COLS} from b",
    "match_symdiff": RUNS + f"(select {COLS} from a except select {COLS} from b) union all (select {COLS} from b except select {COLS} from a)",
    "match_duplicates": RUNS + "select genome1, genome2, 1 as seq1, seq2, a1, b1, a2, b2, score, count(*) as n from a group by all having count(*) > 1",
    "recall_report": RUNS + f""", x as (select (select count(*) from (select {COLS} from a intersect select {COLS} from b)) as n_both,
  (select count(*) from (select {COLS} from a except select {COLS} from b)) as n_reference_only, (select count(*) from (select {COLS} from b except select {COLS} from a)) as n_other_only)
  select *, 100.0::double * n_both / (n_both + n_reference_only) as recall_percent from x""",
    "missed_score_stats": RUNS + f", m as (select score from (select {COLS} from a except select {COLS} from b)) select count(*) as n, avg(score) as mean, list_sort(list(score))[(count(*) // 2) + 1] as median from m",
    "rate_from_counters": """select event_id, case when dt > 0 then dv / (dt / 1e6) end as rate from (select event_id, epoch_us(ts) - lag(epoch_us(ts)) over w as dt, value - lag(value) over w as dv
  from events window w as (partition by user_id order by ts, event_id))""",
    "elapsed_since_first": "select event_id, epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as elapsed_us from events",
    "avg_by_group": "select event_type, count(*) as n, round(avg(value), 6) as avg_value from events group by event_type",
}
