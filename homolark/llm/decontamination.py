"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers in digits or English words ("twenty-five" is one), units that follow a number, and names (a capitalised word inside a sentence) become typed placeholders; the
rest is lower-cased words of letters and digits. Windows of `WINDOW` canonical words of documents and benchmark items
are hash-joined. Hits of one alignment (document place less item place) must fill slots consistently: equal values
of the item stand for equal values of the document, else the windows with slots do not count. A document is
contaminated by an item if `SHARE` of the item's distinct windows are found, so a question asked again with other numbers
or names is caught.

Whether a capitalised word that opens a sentence or quotation, or is all capitals, is a name cannot be told. So there are two
views: it is a literal word in the first and a name in the second, on both sides. The second counts for items that the first
does not find. Items shorter than a window are one whole window, which matches the same words and values only.

If the benchmark has `SIFT_ROWS` distinct windows or fewer, their hashes are part of the query, and documents' windows are
sifted by them before rows are made. The benchmark's windows are broadcast only if they are counted to be `BROADCAST_ROWS` or fewer; otherwise the same
join shuffles. Documents are exploded to hashes and slot values, never to copies of the text, and only hits are shuffled.

Null text has no windows. Rows that share a doc_id are matched apart (by text); a null doc_id is carried as null. Items without words are
never found. Texts of any length are read whole; an empty table of documents or items gives an empty result. In `decontaminate` columns of
docs may have any name but those that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SHARE = 0.5
BROADCAST_ROWS = 500_000
SIFT_ROWS = 20_000

NUMBER, UNIT, NAME, OPEN = "\ue000", "\ue001", "\ue002", "\ue003"  # private-use characters, blanked in input
BOTH, LITERAL, NAMED = 0, 1, 2  # views that a window belongs to
# fixed values: number words, unit words
NUMBER_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen"
UNITS = "percent|kilometers|kilometres|kilometer|kilometre|meters|metres|meter|metre|centimeters|miles|mile|feet|foot|inches|inch|kilograms|kilogram|grams|gram|pounds|pound|liters|litres|liter|litre|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|cent|euros|euro|km|cm|mm|kg|mg|ml|lb|lbs|ft|hr|hrs|min|sec|usd|eur|m|g|l|s|h"


def tokens(text: Column) -> Column:
    """Words in lower case; a slot's word is its type's mark followed by its value, and what may be a name has a mark too."""
    t = F.translate(F.coalesce(text, F.lit("")), NUMBER + UNIT + NAME + OPEN, "    ")
    word, before, after = f"(?i:{NUMBER_WORDS})", r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    spelled = F.regexp_replace(t, rf"[ -](?=[a-zA-Z])(?={word}{after})(?<={before}{word}[ -])", "_")
    t = F.regexp_replace(spelled, rf"{before}(?=[a-zA-Z])({word}(?:_{word})*){after}", f"{NUMBER}$1")
    joined = F.regexp_replace(t, r"(?<=[0-9])[.,:](?=[0-9])", "_")
    t = F.when(t.rlike("[0-9]"), F.regexp_replace(joined, rf"{before}([0-9][0-9_]*)", f"{NUMBER}$1")).otherwise(t)
    unit = F.regexp_replace(t, rf"({NUMBER}(?:[0-9_]+ ?|[a-zA-Z_]+ ))(?i)({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    t = F.when(t.contains(NUMBER), unit).otherwise(t)
    t = F.regexp_replace(t, r"(\p{Lu})(?<=[\p{L}\p{N},;] \p{Lu})(?=\p{Ll})", f"{NAME}$1")
    t = F.regexp_replace(t, rf"(\p{{Lu}})(?<![\p{{L}}\p{{N}}_{NUMBER}-{NAME}]\p{{Lu}})", f"{OPEN}$1")
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}_{NUMBER}-{OPEN}]+"), "")


def _mark(w: Column) -> Column:
    return F.substring(w, 1, 1)


def _word(w: Column) -> Column:
    return F.when((w >= NUMBER) & (w < chr(ord(OPEN) + 1)), F.substring(w, 2, 1 << 30)).otherwise(w)


def windows(df: DataFrame, text: str, *keys: str, short: list[int] | None = None, among: list[int] | None = None) -> DataFrame:
    """keys, pos, h (hash of the canonical window), slots (hashes of the values in it, null if it has none), view.

    Of documents (`short` is given) also all windows of the lengths in `short`; of items, the whole item if it is shorter than a window.
    `among`: only windows with one of these hashes; they are sifted as arrays, before any row is made.
    """
    some = df.select(*keys, tokens(F.col(text)).alias("__w"))
    marked = lambda w: (w >= NUMBER) & (w < chr(ord(OPEN) + 1))
    is_open = lambda w: (w >= OPEN) & (w < chr(ord(OPEN) + 1))
    is_slot = lambda w: (w >= NUMBER) & (w < OPEN)
    slotted, opened = F.exists("__w", is_slot), F.exists("__w", is_open)
    bare = lambda w: F.substring(w, 2, 1 << 30)
    literal = lambda w: F.when(~marked(w), w).when(w < OPEN, _mark(w)).otherwise(bare(w))
    named = lambda w: F.when(~marked(w), w).when(w < OPEN, _mark(w)).otherwise(F.lit(NAME))
    value = lambda w: F.when(is_slot(w), F.xxhash64(w)).when(is_open(w), F.xxhash64(F.concat(F.lit(NAME), bare(w))))
    arrays = {
        "__c": F.transform("__w", lambda w: F.xxhash64(literal(w))),
        "__v": F.when(slotted, F.transform("__w", lambda w: F.when(is_slot(w), F.xxhash64(w)))),
        "__n": F.when(opened, F.transform("__w", lambda w: F.xxhash64(named(w)))),
        "__u": F.when(opened, F.transform("__w", value)),
        "__o": F.when(opened, F.transform("__w", is_open)),
        "__s": F.transform("__w", lambda w: F.xxhash64(_word(w))) if short is None or short else F.lit(None).cast("array<bigint>"),
    }
    some = some.withColumns(arrays).drop("__w")
    hashed = lambda c, i, n=WINDOW: F.xxhash64(*[F.get(F.col(c), i + j) for j in range(n)])
    none = F.lit(None).cast("array<bigint>")
    filled = lambda c, i: F.filter(F.slice(c, i + 1, WINDOW), lambda x: x.isNotNull())
    row = lambda i, h, slots, view: F.struct(i.alias("pos"), h.alias("h"), slots.alias("slots"), view.alias("view"))

    def has_open(i: Column) -> Column:
        out = F.get("__o", i)
        for j in range(1, WINDOW):
            out = out | F.get("__o", i + j)
        return out

    size = F.size("__c")
    no_place = F.array().cast("array<int>")
    at = F.when(size >= WINDOW, F.sequence(F.lit(0), size - WINDOW)).otherwise(no_place)
    opens = F.when(F.col("__o").isNull(), no_place).otherwise(F.filter(at, has_open))
    lengths = range(1, WINDOW) if short is None else short
    shorts = {f"__k{n}": F.when(size == n if short is None else size >= n, F.sequence(F.lit(0), size - n)).otherwise(no_place) for n in lengths}
    some = some.withColumns({"__a": at, "__b": opens} | shorts)
    whole = lambda n: lambda i: F.xxhash64(F.lit(n), hashed("__s", i, n))
    whole_row = lambda n: lambda i: row(i, whole(n)(i), none, F.lit(BOTH))
    if among is not None:
        values = ", ".join(f"{h}L" if h > -(1 << 63) else f"({h + 1}L - 1L)" for h in among) or "NULL"
        # one pass over places: a column of hashes would be written into the lambda and be computed again for each place
        window = lambda c, n=WINDOW: f"xxhash64({', '.join(f'get({c}, i + {j})' for j in range(n))})"
        places = {"__a": window("__c"), "__b": window("__n")} | {f"__k{n}": f"xxhash64({n}, {window('__s', n)})" for n in lengths}
        some = some.withColumns({p: F.expr(f"array_compact(transform({p}, i -> if({h} in ({values}), i, null)))") for p, h in places.items()})
    view = lambda i: F.when(F.col("__o").isNull(), BOTH).when(has_open(i), LITERAL).otherwise(BOTH)
    slots = lambda i: F.when(F.size(filled("__v", i)) > 0, filled("__v", i))
    plain = F.transform("__a", lambda i: row(i, hashed("__c", i), none, view(i)))
    full = F.transform("__a", lambda i: row(i, hashed("__c", i), slots(i), view(i)))
    each = [F.when(F.col("__v").isNull(), plain).otherwise(full), F.transform("__b", lambda i: row(i, hashed("__n", i), filled("__u", i), F.lit(NAMED)))]
    each += [F.transform(f"__k{n}", whole_row(n)) for n in lengths]
    return some.select(*keys, F.explode(F.concat(*each)).alias("__x")).select(*keys, "__x.*")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, refilled, __t): an item found in a document; refilled: some slot has another value. __t: hash of the text."""
    bench = windows(items.select(F.col("item_id").alias("__item"), F.col("text").cast("string").alias("__y")), "__y", "__item")
    bench = bench.select("__item", F.col("pos").alias("__ipos"), "h", F.col("slots").alias("__islots"), F.col("view").alias("__iview"))
    views = lambda v: F.when(v == BOTH, F.array(F.lit(LITERAL), F.lit(NAMED))).otherwise(F.array(v))
    sizes = bench.select("__item", "h", F.explode(views(F.col("__iview"))).alias("__view")).groupBy("__item", "__view").agg(F.count_distinct("h").alias("n_windows"))
    length = F.size(tokens(F.col("text").cast("string")))
    short = [r.n for r in items.select(length.alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    few = [r.h for r in bench.select("h").distinct().limit(SIFT_ROWS + 1).collect()]
    own = windows(docs.select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64(text).alias("__t"), text.alias("__x")), "__x", "__doc", "__t", short=sorted(short), among=few if len(few) <= SIFT_ROWS else None)
    small = bench.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = own.join(F.broadcast(bench) if small else bench, "h").withColumn("__view", F.explode(F.array_intersect(views(F.col("view")), views(F.col("__iview")))))
    diagonal = [F.col("__doc"), F.col("__t"), F.col("__item"), F.col("__view"), (F.col("pos") - F.col("__ipos")).alias("__d")]
    pairs = F.arrays_zip(F.col("__islots").alias("a"), F.col("slots").alias("b"))
    lined = hits.groupBy(*diagonal).agg(
        F.collect_set(F.when(F.col("slots").isNull(), F.col("h"))).alias("plain"),  # at most the item's windows
        F.collect_set(F.when(F.col("slots").isNotNull(), F.col("h"))).alias("filled"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    firsts = lambda c: F.size(F.array_distinct(F.transform("pairs", lambda p: p[c])))
    consistent = F.size("pairs") == firsts("a")
    lined = lined.withColumn("hs", F.when(consistent, F.concat("plain", "filled")).otherwise(F.col("plain")))
    changed = consistent & F.exists("pairs", lambda p: p["a"] != p["b"])
    found = lined.select("__doc", "__t", "__item", "__view", changed.alias("changed"), F.explode("hs").alias("h"))
    n = found.groupBy("__doc", "__t", "__item", "__view").agg(F.count_distinct("h").alias("n_matched"), F.max(F.col("changed").cast("int")).alias("changed"))
    out = n.join(F.broadcast(sizes) if small else sizes, n["__item"].eqNullSafe(sizes["__item"]) & (n["__view"] == sizes["__view"])).where(F.col("n_matched") >= SHARE * F.col("n_windows"))
    first = out.groupBy("__doc", "__t", n["__item"]).agg(F.min(F.struct(n["__view"], "n_matched", "n_windows", (F.col("changed") == 1).alias("refilled"))).alias("__m"))
    return first.select(F.col("__doc").alias("doc_id"), F.col("__item").alias("item_id"), "__m.n_matched", "__m.n_windows", "__m.refilled", "__t")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of docs that hold no item of the benchmark."""
    bad = contaminated(docs, items).select(F.col("doc_id").alias("__doc"), F.col("__t").alias("__bad")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & (own == F.col("__bad")), "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).drop("__t")
