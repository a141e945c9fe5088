"""Quality rules by cross-document line frequency, in DataFrame functions only.

Base rules look at one text. The method's rule looks at lines across documents: lines are normalised (words joined by
one space, lower case) and hashed, and for each host (`source`) the distinct documents that hold a line are counted.
A line in over `MIN_DOCS` documents and over `SHARE` of the host's documents is above the limit and is removed; a
document left with fewer than `MIN_LEFT` words by that is depleted and rejected. Documents with equal texts count
once, so that a page copied as a whole is not taken for boilerplate.

A line's documents are counted in two steps, first distinct (host, line, document), then per line, both combined
before the shuffle; the texts themselves are never shuffled. Lines that exceed the limit meet their documents in an
equi-join on (host, line), which AQE splits where a line is hot.

Null text has no words and fails the base rules. Null source is a host of its own. Rows equal in doc_id, source and
text get equal verdicts. Further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
MIN_WORDS = 10
REPEAT_PERCENT = 20
MIN_DOCS = 10
SHARE = 0.01
MIN_LEFT = 10


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def grams(hashes: str, k: int) -> Column:
    """Hashes of all runs of k elements of an array column of hashes."""
    at = F.sequence(F.lit(0), F.size(hashes) - k)
    one = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= k, one).otherwise(F.array().cast("array<bigint>"))


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, computed in the scan's stage."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    out = docs.select(
        "*",
        F.transform(words_of(t), lambda w: F.xxhash64(w)).alias("__h"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    out = out.withColumn("__g", grams("__h", 5)).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    # only a text that repeats a window has its windows sorted
    again = F.size(F.array_distinct("__g")) < F.size("__g")
    ordered = F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(again, ordered))
    same = lambda a, b: F.coalesce(F.get(F.col("__s"), a)["h"] == F.get(F.col("__s"), b)["h"], F.lit(False))
    where = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    places = F.sort_array(F.transform(where, lambda i: F.get(F.col("__s"), i)["i"]))
    out = out.withColumn("__p", F.when(F.col("__s").isNotNull(), places))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("__p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).withColumn("n_words", F.size("__h").cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    return out.drop("__h", "__g", "__l", "__s", "__p")


def _line(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, SPACE, " ")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, host, text, and __t, the text's hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("__host"), text.alias("__x"), F.xxhash64(text).alias("__t"))


def frequent_lines(docs: DataFrame) -> DataFrame:
    """(__host, __line hash) of lines above the limit."""
    keyed = _keyed(docs)
    lines = keyed.select("__host", "__t", F.explode(F.array_distinct(F.transform(F.filter(F.split("__x", "\n"), lambda x: x.rlike(NOT_SPACE)), lambda x: F.xxhash64(_line(x))))).alias("__line"))
    n = lines.distinct().groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(f"__n > {MIN_DOCS}")
    hosts = keyed.select("__host", "__t").distinct().groupBy("__host").agg(F.count("*").alias("__docs"))
    return n.join(hosts, "__host").where(F.col("__n") > SHARE * F.col("__docs")).select("__host", "__line")


def removed_lines(docs: DataFrame) -> DataFrame:
    """Per (doc_id, __host, __t) that loses lines: their numbers (from 0), and the words in them."""
    each = F.posexplode(F.transform(F.split("__x", "\n"), lambda x: F.struct(F.xxhash64(_line(x)).alias("h"), F.size(words_of(x)).alias("n"))))
    lines = _keyed(docs).select("doc_id", "__host", "__t", each).select("doc_id", "__host", "__t", "pos", F.col("col.h").alias("__line"), F.col("col.n").alias("n")).where("n > 0")
    hit = lines.join(frequent_lines(docs), ["__host", "__line"])
    # of rows that are the same document, each line counts once
    return hit.distinct().groupBy("doc_id", "__host", "__t").agg(F.sum("n").alias("n_removed_words"), F.sort_array(F.collect_set("pos")).alias("removed_lines"))


def _with_removed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = docs.withColumns({"__host0": F.coalesce(F.col("source").cast("string"), F.lit("\x00")), "__t0": F.xxhash64(text), "__id0": F.col("doc_id").cast("long")})
    r = removed_lines(docs).withColumnRenamed("doc_id", "__id")
    both = left.join(r, (F.col("__id0").eqNullSafe(F.col("__id"))) & (F.col("__t0") == F.col("__t")) & (F.col("__host0") == F.col("__host")), "left")
    return both.drop("__host0", "__t0", "__id0", "__id", "__host", "__t")


def verdict() -> Column:
    """kept, from features and n_removed_words."""
    depleted = F.coalesce(F.col("n_words") - F.col("n_removed_words") < MIN_LEFT, F.lit(False))
    return ~F.col("base_failed") & ~depleted


def quality_rules(docs: DataFrame) -> DataFrame:
    """Features, kept, n_removed_words and removed_lines, one row per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rated = features(docs.select("doc_id", "source", "text")).withColumn("__h0", F.xxhash64(text))
    small = rated.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("__s0"), "__h0", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    r = removed_lines(docs).withColumnRenamed("doc_id", "__id")
    both = small.join(r, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h0") == F.col("__t")) & (F.col("__s0") == F.col("__host")), "left")
    out = both.withColumn("kept", verdict())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.coalesce("n_removed_words", F.lit(0).cast("long")).alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """Kept rows of docs, without their lines above the limit."""
    # a filter does not move below a non-deterministic column: below, it would write out the features' lambdas again and again
    own = {c: c if c in ("doc_id", "source", "text") else f"__c{i}" for i, c in enumerate(docs.columns)}  # names of ours may clash with names of docs
    fenced = features(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])).withColumn("__row", F.monotonically_increasing_id())
    rated = _with_removed(fenced).where(verdict() & (F.col("__row") >= 0))
    gone = F.col("removed_lines")
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return rated.withColumn("text", F.when(gone.isNotNull(), text).otherwise(F.col("text"))).select(*[F.col(n).alias(c) for c, n in own.items()])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed_lines")


ORACLE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(source, chr(0)) as host from documents),
w as (select r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
l as (select r, host, text, unnest(range(len(string_split(text, chr(10))))) as p, unnest(string_split(text, chr(10))) as line from d),
ln as (select r, host, text, p, line, lower(array_to_string(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ')) as norm
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct line) as n from ln group by r),
g as (select r, i, array_to_string(ws[i:i + 4], ' ') as win from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select r, count(distinct q) as n from (select r, unnest(range(i, i + 5)) as q from
  (select r, i, count(*) over (partition by r, win) as k from g) where k > 1) group by r),
hosts as (select host, count(distinct text) as n from d group by host),
freq as (select f.host, f.norm from (select host, norm, count(distinct text) as n from ln group by host, norm) f join hosts h on h.host = f.host
  where f.n > {MIN_DOCS} and f.n > {SHARE} * h.n),
lost as (select r, sum(len(string_split(norm, ' '))) as n from ln join freq using (host, norm) group by r),
f as (select d.r, doc_id, len(ws)::bigint as n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_removed_words
  from d join w using (r) left join dup using (r) left join rep using (r) left join lost using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) and not (n_removed_words > 0 and n_words - n_removed_words < {MIN_LEFT}) as kept,
  n_removed_words
from f
"""
