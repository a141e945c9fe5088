import random

import regex
import pytest
from pyspark.sql import functions as F
from test_text_dedup import SCHEMA, docs_of, texts  # noqa: F401

from homolark.llm import decontamination as D
from homolark.llm import quality_rules as Q

ITEMS = [
    (1, "A train leaves Boston at 9 and travels 120 miles in 3 hours so how fast does it go on average"),
    (2, "Maria has 5 apples and Maria gives 2 apples to her friend how many apples are left now"),
    (3, "short item only four"),
    (4, None),
    (None, "an item without any id but with enough words to be matched in a text"),
]


def spelled(t):
    """Runs of number words, one blank or hyphen between, as one marked word; what an underscore joins already goes on no further."""
    out, end, last, known = [], 0, None, set(D.NUMBER_WORDS.split("|"))
    for m in regex.finditer(r"[\p{L}\p{N}_]+", t):
        gap, parts = t[end : m.start()], m[0].lower().split("_")
        number = all(p in known for p in parts)
        out.append("_" if number and last and len(parts) == 1 and gap in (" ", "-") else gap + ("\ue000" if number else ""))
        out.append(m[0])
        end, last = m.end(), number and len(parts) == 1
    return "".join(out) + t[end:]


def slow_tokens(text):
    t = spelled((text or "").translate({0xE000: " ", 0xE001: " ", 0xE002: " "}))
    if regex.search("[0-9]", t):
        t = regex.sub(r"(?<=[0-9])[.,:](?=[0-9])", "_", t)
        t = regex.sub(r"(?<![\p{L}\p{N}_])([0-9][0-9_]*)", "\ue000\\1", t)
    t = regex.sub(rf"(\ue000(?:[0-9_]+ ?|[a-zA-Z_]+ ))((?i:{D.UNITS}))(?![\p{{L}}\p{{N}}])", "\\1 \ue001\\2", t)
    t = regex.sub(r"(?<=[\p{L}\p{N},;] )(\p{Lu})(?=\p{Ll})", "\\1", t)
    w = [x for x in regex.split("[^\\p{L}\\p{N}_-]+", t.lower()) if x]
    return [(x[0], x) if x[0] in "" else (x, None) for x in w]


def slow_contaminated(docs, items):
    out = []
    for i, text in items:
        w = slow_tokens(text)
        total = {tuple(c for c, _ in w[k : k + 5]) for k in range(len(w) - 4)}
        for d, t in docs:
            x = slow_tokens(t)
            lines = {}
            for p in range(len(x) - 4):
                for q in range(len(w) - 4):
                    a, b = w[q : q + 5], x[p : p + 5]
                    if [c for c, _ in a] == [c for c, _ in b]:
                        lines.setdefault(p - q, []).append((tuple(c for c, _ in a), {(u, v) for (_, u), (_, v) in zip(a, b) if u}))
            found, changed = set(), False
            for hits in lines.values():
                pairs = set().union(*(s for _, s in hits))
                ok = len(pairs) == len({a for a, _ in pairs})
                found |= {h for h, s in hits if ok or not s}
                changed |= ok and any(a != b for a, b in pairs)
            if total and len(found) >= D.SHARE * len(total):
                out.append((d, i, len(found), len(total), changed))
    return out


def test_decontamination(spark, texts):  # noqa: F811
    some = texts + [
        (200, "Before it. " + ITEMS[0][1].replace("Boston", "Denver").replace("120", "360.5").replace("3 hours", "4 hours") + ". After it"),
        (201, ITEMS[1][1].replace("Maria has", "Peter has").replace("and Maria", "and Peter").replace("5", "7")),
        (202, ITEMS[1][1].replace("Maria has", "He saw Peter has").replace("and Maria", "and Paul")),
        (203, "plain " * 500 + ITEMS[4][1].upper()),
        (203, ITEMS[0][1] + "\n" + ITEMS[0][1].replace("9", "8")),
        (None, ITEMS[0][1]),
    ]
    docs = docs_of(spark, some)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"h": F.lit(1), "doc_id": F.lit(1)})
    got = sorted(map(tuple, D.contaminated(docs, items).drop("__t").collect()), key=str)
    assert got == sorted(slow_contaminated(some, ITEMS), key=str)
    assert (200, 1) in {x[:2] for x in got} and (201, 2) in {x[:2] for x in got}
    left = D.decontaminate(docs, items)
    assert left.columns == docs.columns
    bad = {x[0] for x in got}
    assert sorted([r.doc_id for r in left.collect()], key=str) == sorted([i for i, t in some if i not in bad or (i is None and t != ITEMS[0][1])], key=str)
    assert D.contaminated(docs, items.where("item_id = 99")).count() == D.contaminated(docs.where("doc_id = 9999"), items).count() == 0


def test_number_words(spark):
    item = "Maria has five apples and Maria gives two of them to her friend how many are left after twenty minutes"
    again = item.replace("five", "forty-seven").replace("two", "Twelve").replace("twenty", "90")
    texts = [(1, item), (2, again), (3, again.replace("forty-seven", "forty seven hundred")), (4, item.replace("five", "some").replace("two", "a few").replace("twenty", "some")), (5, "No one has seen it for one day or two, said nobody.")]
    got = {r.doc_id: r.refilled for r in D.contaminated(docs_of(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: True, 3: True}
    words = docs_of(spark, [(k, t) for k, t in enumerate(["One hundred-and two hundred  three", "oneself one_two TWENTY-FIVE km, ten", "five-six_seven eight.nine one5 5one one -two", "four\nfive feet 3 six km"])])
    for r in words.select("text", D.tokens(F.col("text")).alias("w")).collect():
        assert [w.lstrip("\ue003\ue002") for w in r.w] == [v or c for c, v in slow_tokens(r.text)], r.text


@pytest.mark.parametrize("sift", [D.SIFT_ROWS, 0])
def test_names_that_open_and_short_items(spark, sift, monkeypatch):
    monkeypatch.setattr(D, "SIFT_ROWS", sift)
    item = "Alice has 5 apples. Bob gives her 3 more."
    each = "Alice bakes 5 fresh loaves for the market. Bob sells 3 loaves there before noon today. Alice wants to know how many remain unsold."
    items = spark.createDataFrame([(1, item), (2, each), (3, "Mix 5 g salt"), (4, "Yes")], "item_id long, text string")
    swap = lambda t, a, b: t.replace("Alice", a).replace("Bob", b)
    some = [
        (1, swap(item, "Carol", "Dave")), (2, swap(item, "CAROL", "Dave") + " How many?"), (3, "He said so, and Carol has 5 apples. \u201cDave gives her 3 more.\u201d"),
        (4, swap(each, "Carol", "Dave")), (5, swap(each, "Carol", "Dave").replace("Carol wants", "Erin wants")),
        (6, "now mix 5 g salt in"), (7, "now mix 6 g salt in"), (8, "oh yes it is"), (9, "yesterday"), (10, item),
        (11, "Nobody has 5 pears. Then we give them away for 3 others."),
    ]
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs_of(spark, some), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 3), (8, 4), (10, 1)}
    assert got[1, 1].refilled and got[4, 2].refilled and not got[10, 1].refilled and not got[6, 3].refilled


def test_quality_edges(spark, texts):  # noqa: F811
    r = random.Random(4)
    boiler = "Subscribe  to our\tnewsletter for more"
    body = lambda: " ".join(f"b{r.randrange(10**6)}" for _ in range(12))
    some = texts + [(300 + i, f"{body()}\n{boiler.upper()}") for i in range(12)] + [(400 + i, f"{boiler}\nand six other words are here {i}") for i in range(3)]
    docs = docs_of(spark, some)
    out = {(x.doc_id, x.n_words): x for x in Q.quality_rules(docs).collect()}
    assert Q.quality_rules(docs).count() == len(some)
    assert all(out[300 + i, 18].kept and out[300 + i, 18].removed_lines == [1] for i in range(12))
    assert all(not out[400 + i, 13].kept and not out[400 + i, 13].base_failed for i in range(3))
    assert out[1, 0].base_failed and not out[1, 0].kept
    left = Q.quality_filter(docs)
    assert left.columns == docs.columns
    assert {x.text.count("newsletter") + x.text.count("NEWSLETTER") for x in left.where("doc_id >= 300").collect()} == {0}
    assert left.count() == sum(x.kept for x in Q.quality_rules(docs).collect())
    odd = spark.createDataFrame([(1, "one two " * 20, None, None, None, None, None, None), (2, "a" * 9 + " b", None, None, None, None, None, None)], SCHEMA)
    got = {x.doc_id: x for x in Q.quality_rules(odd).collect()}
    assert got[1].n_repeat_words == 40 and got[1].base_failed and got[2].word_chars == 10
    assert Q.quality_rules(docs.where("doc_id = 9999")).count() == 0
