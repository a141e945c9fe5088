"""Spelling variants: rare words meet the frequent word from which one edit made them.

Words come from maximal runs of letters, of which every `MISSPELT`-th (by a checksum of doc_id and run) loses a code point. Words of `LEAST_LENGTH`
code points and `LEAST_COUNT` occurrences over all documents take part.

The join follows the even-partition pigeonhole: a word of L code points is indexed under its two halves, each with L, its place and its text. One edit
leaves one half of the shorter word whole, so a word probes the halves of its own length at their places, and those of words one shorter at their places
and, for the second half, one place further on. Pairs are verified by edit distance on the part that the key leaves open, and made distinct.

A half that very many words share would meet all of them with each other. Where a key has more than `PAIRS` pairs, its open part is halved in turn: one
of the two quarters must be whole as well, so both make keys of their own, until a key has few pairs or leaves one code point open, where no more words
than letters can meet. Nothing is dropped: each edit lies in one of the open parts.

A null text has no words, and a null doc_id counts as an empty text in the checksum. Texts of any length are read whole, in slices cut between runs.
Repeated rows count as often as they stand. Ties between forms go to the smaller word in code-point order. An empty table gives an empty result, and
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, trim, tune

MISSPELT = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
PAIRS = 4096  # of one key, before its open part is halved
SLICE = 1 << 20
FLUSH = 200_000  # distinct words that a task holds
KEY = ["size", "low", "high", "rest"]

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def _counted(text: str) -> Counter:
    """Lower-cased (A to Z) runs of a text."""
    text, out, at = text.encode().lower().decode(), Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = gap.start() if gap else len(text)
        out.update(_RUN.findall(text, at, end))
        at = end
    return out


def _words(batches: Iterable[pa.RecordBatch], least_length: int, misspelt: int) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if not text:
                continue
            seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for word, n in _counted(text).items():
                h = zlib.crc32(word.encode(), seed)
                if h % misspelt == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                if len(word) >= least_length:
                    found[word] += n
            if len(found) >= FLUSH:
                yield out()
                found.clear()
    if found:
        yield out()
    found.clear()
    trim()


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n) of all documents; counts are summed in each task before the shuffle."""
    tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = own.mapInArrow(lambda b: _words(b, least_length, misspelt), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _open(word: Column, longer: Column, low: Column, high: Column) -> Column:
    """The part of a word that a key leaves open: one code point more where the word is the longer one."""
    return F.substring(word, low + 1, high - low + longer)


def _keyed(rows: DataFrame, *parts: tuple[Column, Column]) -> DataFrame:
    """A key (size, low, high, rest) for each open part [low, high) of the shorter word: rest is what stands around it."""
    spans = F.explode(F.array(*[F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")) for a, b in parts]))
    out = rows.withColumn("__s", spans).withColumns({"low": F.col("__s.low"), "high": F.col("__s.high")}).drop("__s")
    after = F.col("high") + F.col("longer")
    rest = F.concat(F.substring("word", F.lit(1), F.col("low")), F.substring("word", after + 1, F.length("word")))
    return out.withColumn("rest", rest)


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words one edit apart, each once; words: distinct (word, n)."""
    half = F.floor(F.col("size") / 2)
    own = words.withColumns({"size": F.length("word"), "longer": F.lit(0)})
    whole = F.lit(0), half
    rows = _keyed(own, (half, F.col("size")), whole)
    probes = words.withColumns({"size": F.length("word") - 1, "longer": F.lit(1)}).where("size > 0")
    rows = cut(rows.unionByName(_keyed(probes, (half, F.col("size")), whole)))
    done = None
    while True:
        # words of a key's own length are both indexed and probing, longer ones probe only
        count = rows.groupBy(*KEY).agg(F.sum(1 - F.col("longer")).alias("own"), F.count("*").alias("all")).where("own > 0 and all > 1")
        full = (F.col("own") * F.col("all") > pairs) & (F.col("high") - F.col("low") > 1)
        met = cut(rows.join(count.select(*KEY, full.alias("full")), KEY))
        cold = met.where(~F.col("full"))
        index = cold.where("longer = 0").select(*KEY, F.col("word").alias("a"), F.col("n").alias("n_a"))
        probe = cold.select(*KEY, F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
        near = F.levenshtein(_open(F.col("a"), F.lit(0), F.col("low"), F.col("high")), _open(F.col("b"), F.col("longer"), F.col("low"), F.col("high")), 1) == 1
        found = index.join(probe, KEY).where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & near).select("a", "n_a", "b", "n_b")
        done = found if done is None else done.unionByName(found)
        hot = met.where("full").select("word", "n", "size", "longer", F.col("low").alias("from"), F.col("high").alias("to"))
        if hot.isEmpty():
            return done.distinct()
        middle = F.floor((F.col("from") + F.col("to")) / 2)
        rows = cut(_keyed(hot, (F.col("from"), middle), (middle, F.col("to"))).drop("from", "to"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last; each round doubles the way. Forms grow in count, so there is no circle."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = RATIO, pairs: int = PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from distinct (word, n)."""
    words = cut(words)
    found = near_pairs(words, pairs)
    both = found.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m"))
    both = both.unionByName(found.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    judged = words.join(best, "word", "left")
    good = -F.col("best.m") >= ratio * F.col("n")
    judged = cut(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")))
    root = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _crc_table() -> str:
    rows = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        rows.append(str(c))
    return "[" + ",".join(rows) + "]"


#: Counts, checksums by table, and a deletion join instead of the pigeonhole's.
ORACLE_SQL = f"""with recursive runs as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, n from
  (select doc_id, r, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as r from documents) group by 1, 2)),
each as (select doc_id, r, sum(n) as n, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || r, ''),
  lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as bytes from runs group by 1, 2),
hashed as (select r, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]::bigint))) as h from each),
cut as (select case when h % {MISSPELT} = 0 then r[1:(h % length(r))::int] || r[(h % length(r))::int + 2:] else r end as word, n from hashed),
w as (select word, sum(n)::bigint as n from cut where length(word) >= {LEAST_LENGTH} group by 1 having sum(n) >= {LEAST_COUNT}),
v as (select word, n, k, word[1:k] || word[k + 2:] as v from w, unnest(range(length(word))) as t(k)),
swapped as (select a.word as a, b.word as b, b.n as m from v a join v b on a.v = b.v and a.k = b.k and a.word <> b.word),
longer as (select distinct w.word as short, w.n as short_n, v.word as long, v.n as long_n from w join v on w.word = v.v),
p as (select * from swapped union all select short, long, long_n from longer union all select long, short, short_n from longer),
best as (select a as word, count(*) as n_near, min((-m, b)) as best, min(-m) as m from p group by 1),
j as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when -m >= {RATIO} * n then best[2] end as form, case when -m >= {RATIO} * n then (-m)::bigint end as form_n from w left join best using (word)),
up as (select word, coalesce(form, word) as root, form is null as ends from j union all select u.word, coalesce(j.form, u.root), j.form is null from up u join j on u.root = j.word where not u.ends)
select word, form, root, n, n_near, form_n from j join (select word, root from up where ends) using (word)"""
