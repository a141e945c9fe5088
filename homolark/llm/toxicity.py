"""Toxicity by a weighted grammar of finite-state transducers over clauses.

A token is an insult or a threat (with a weight), a target, a negation, a word of reporting, or none of these. Four transducers read a clause one after the
other, composed into one machine: reported speech weakens what follows its word to the end of the clause; a negation weakens insults and threats within
its reach; a target anywhere in the clause strengthens insults, and a threat counts little without one (the machine guesses that a target comes, and a
guess that fails is no accepted path); the last one adds up what is left. A clause's score is that of its best accepted path, and a document is judged by its
matched clauses: their sum, their best, their density and the number of different words in them, in a logistic model.

The words of the closed classes are parameters. Insults are learned: words and word beginnings (3 to 8 letters) that labelled toxic documents hold more often
than others, with the logarithm of that ratio as weight; a word takes the longest entry that fits, and an entry without weight takes it from its shorter
ones. Known insults have a weight before anything is learned. Training takes a sample of `SAMPLE` labelled documents by hash at most; a lexicon has `ENTRIES`
entries at most, found in one half of the sample when it serves the other half's features, from which the logistic model is fitted.

A null text is empty; texts are read whole, in slices cut between words. Repeated rows get equal scores, and the last step knows no ties. Labels that are
null are ignored, and a doc_id with several labels counts as toxic if one of them says so; a null doc_id has no label and is not held out. Without labels of both
kinds every score is the (smoothed) share of toxic labels. An empty table gives an empty result, and columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, trim, tune

SAMPLE = 20_000
ENTRIES = 4000
EVIDENCE = 25.0  # twice the log-likelihood ratio that an entry needs
LEAST_WEIGHT = 1.0
BEGINNINGS = range(3, 9)
KNOWN_WEIGHT, THREAT_WEIGHT = 2.5, 3.0
REACH = 3  # tokens that a negation weakens
THRESHOLD = 0.7
SLICE = 1 << 20
FLUSH = 300_000

CLASSES = {
    "insult": "idiot idiots moron morons stupid loser losers trash scum worthless pathetic disgusting clown dumb garbage filth idiota basura estúpido imbécile ordure trottel dummkopf abschaum",
    "threat": "kill hurt destroy stab shoot strangle punch töten umbringen tuer frapper matar golpear",
    "target": "you your yours he she him they them du dich dir ihr euch tu toi te vous tú usted ustedes",
    "negation": "not never no isn't aren't don't nicht kein keine nie pas jamais nunca",
    "reporting": "said says told wrote quoted called claimed reported sagte schrieb nannte dit écrit dijo escribió",
}

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
_GAP = re.compile(r"[\W\d_]")


@dataclass
class Transducer:
    """arcs: (state, symbol) -> [(next state, symbol given out, factor of the token's weight), ...]; not deterministic. A pair without arcs passes the symbol on unchanged."""

    start: object
    finals: frozenset
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol: str) -> list[tuple]:
        return self.arcs.get((state, symbol)) or [(state, symbol, 1.0)]


SYMBOLS = ("insult", "threat", "target", "negation", "reporting", "other")


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what `first` gives out to `second`; states that can be reached only."""
    start = (first.start, second.start)
    arcs, seen, todo = {}, {start}, deque([start])
    while todo:
        state = todo.popleft()
        for s in SYMBOLS:
            out = [((p, q), t, f * g) for p, mid, f in first.step(state[0], s) for q, t, g in second.step(state[1], mid)]
            arcs[state, s] = out
            for nxt, _, _ in out:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
    return Transducer(start, frozenset(s for s in seen if s[0] in first.finals and s[1] in second.finals), arcs)


def reported(weak: float = 0.4) -> Transducer:
    arcs = {(0, "reporting"): [(1, "other", 1.0)]} | {(1, s): [(1, s, weak)] for s in ("insult", "threat")}
    return Transducer(0, frozenset((0, 1)), arcs)


def negated(weak: float = 0.3, reach: int = REACH) -> Transducer:
    arcs = {(k, "negation"): [(reach, "other", 1.0)] for k in range(reach + 1)}
    for k in range(1, reach + 1):
        arcs |= {(k, s): [(k - 1, s, weak if s in ("insult", "threat") else 1.0)] for s in SYMBOLS if s != "negation"}
    return Transducer(0, frozenset(range(reach + 1)), arcs)


def targeted(strong: float = 1.5, alone: float = 0.2) -> Transducer:
    """0: no target is claimed; 1: one is claimed and must still come; 2: it came."""
    arcs = {(0, "threat"): [(0, "threat", alone)], (0, "target"): [(0, "other", 1.0)], (1, "target"): [(2, "other", 1.0)], (2, "target"): [(2, "other", 1.0)]}
    arcs |= {(k, "insult"): [(k, "insult", strong)] for k in (1, 2)}
    start = Transducer("begin", frozenset(("begin", 0, 2)), arcs)
    for s in SYMBOLS:  # the first token decides between both claims
        start.arcs["begin", s] = [*start.step(0, s), *start.step(1, s)]
    return start


def grammar() -> Transducer:
    return compose(compose(reported(), negated()), targeted())


def clause_score(machine: Transducer, tokens: list[tuple[str, float]]) -> float:
    """Sum of weights on the best accepted path of (symbol, weight) tokens."""
    now = {machine.start: 0.0}
    for symbol, weight in tokens:
        then: dict = {}
        for state, total in now.items():
            for nxt, out, factor in machine.step(state, symbol):
                value = total + (weight * factor if out in ("insult", "threat") else 0.0)
                if value > then.get(nxt, -1.0):
                    then[nxt] = value
        now = then
    return max((v for s, v in now.items() if s in machine.finals), default=0.0)


def slices(text: str) -> Iterator[str]:
    """A lower-cased text in pieces that cut no word."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[at:end].lower()
        at = end


class Lexicon:
    """Weights of words by their longest entry: whole words end with $, beginnings do not."""

    def __init__(self, entries: dict[str, float], classes: dict[str, str] = CLASSES):
        self.kind = {w: k for k, words in classes.items() for w in words.split()}
        self.entries = {f"{w}$": KNOWN_WEIGHT for w, k in self.kind.items() if k == "insult"} | entries
        self.known: dict[str, tuple[str, float]] = {}

    def token(self, word: str) -> tuple[str, float]:
        """(symbol, weight); closed classes come before learned entries, but for insults."""
        got = self.known.get(word)
        if got is None:
            kind = self.kind.get(word, "other")
            if kind == "threat":
                got = kind, THREAT_WEIGHT
            elif kind in ("target", "negation", "reporting"):
                got = kind, 0.0
            else:
                weight = self.entries.get(f"{word}$")
                for k in reversed(BEGINNINGS):
                    if weight is not None:
                        break
                    weight = self.entries.get(word[:k]) if k <= len(word) else None
                got = ("insult", weight) if weight and weight > 0 else ("other", 0.0)
            if len(self.known) > FLUSH:
                self.known.clear()
            self.known[word] = got
        return got


N_FEATURES = 5


def features(text: str | None, lexicon: Lexicon, machine: Transducer) -> tuple[list[float], int]:
    """Document features from its matched clauses, and their number."""
    n = 0
    hits = False
    for piece in slices(text or ""):
        words = _WORD.findall(piece)
        n += len(words)
        hits = hits or any(lexicon.token(w)[1] > 0 for w in set(words))
    if not hits:
        return [0.0] * (N_FEATURES - 1) + [math.log1p(n)], 0
    total = top = 0.0
    clauses, found, clause = 0, set(), []

    def close() -> None:
        nonlocal total, top, clauses
        if any(w > 0 for _, w in clause):
            score = clause_score(machine, clause)
            total, top, clauses = total + score, max(top, score), clauses + (score > 0)
        clause.clear()

    for piece in slices(text):
        for word in _TOKEN.findall(piece):
            if word in ".!?;\n":
                close()
                continue
            clause.append(lexicon.token(word))
            if clause[-1][1] > 0:
                found.add(word)
    close()
    return [math.log1p(total), math.log1p(top), math.log1p(len(found)), math.log1p(1000 * total / (n + 50)), math.log1p(n)], clauses


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, fold, toxic, clean): documents of each kind that hold it."""
    found: Counter = Counter()

    def out():
        rows = list(found.items())
        cols = [pa.array([k[0] for k, _ in rows]), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n * k[2] for k, n in rows], pa.int64()), pa.array([n * (1 - k[2]) for k, n in rows], pa.int64())]
        found.clear()
        return pa.RecordBatch.from_arrays(cols, names=["entry", "fold", "toxic", "clean"])

    for batch in batches:
        for text, toxic, fold in zip(*(batch[c] for c in ("text", "toxic", "fold")), strict=True):
            words = {w for piece in slices(text.as_py() or "") for w in _WORD.findall(piece)}
            own = {f"{w}$" for w in words} | {w[:k] for w in words for k in BEGINNINGS if k <= len(w)}
            fold, toxic = fold.as_py(), toxic.as_py()
            found.update((e, fold, toxic) for e in own)
            if len(found) > FLUSH:
                yield out()
    if found:
        yield out()
    trim()


def _lexicon(counts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Weights from (entry, t, c): entries with evidence, and well-known ones that begin like one of those but say less."""
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    share = toxic / max(1, toxic + clean)
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((t + c) * p))).otherwise(0.0)
    judged = counts.withColumns({"weight": weight, "g": 2 * (part(t, share) + part(c, 1 - share))})
    good = judged.where((F.col("g") >= EVIDENCE) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(F.desc("g"), "entry").limit(ENTRIES).select("entry", "weight").collect()
    out = {r.entry: r.weight for r in good}
    first = BEGINNINGS[0]
    heads = sorted({e[:first] for e in out})
    if heads:
        head = counts.sparkSession.createDataFrame([(h,) for h in heads], "head string")
        weak = judged.where((F.col("t") + F.col("c") >= 8) & (F.col("weight") < LEAST_WEIGHT)).withColumn("head", F.substring("entry", 1, first)).join(F.broadcast(head), "head", "left_semi")
        weak = weak.orderBy(F.desc(F.col("t") + F.col("c")), "entry").limit(ENTRIES).collect()
        out |= {r.entry: 0.0 for r in weak if any(r.entry[:k] in out for k in BEGINNINGS)}
    return out


@dataclass
class Model:
    """A lexicon and the logistic model on document features."""

    entries: dict[str, float]
    coef: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))]) @ self.coef
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (the last is the constant) on standardised features, by Newton's method."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, own = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], l2), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(own), z.T @ (y - p) - own * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, spread


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): what to learn from, at most about `sample` labelled ids by hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = known.count()
    share = min(1.0, sample / max(1, total))
    h = F.xxhash64("doc_id")
    known = known.where(F.shiftrightunsigned(h, 1) <= int(share * ((1 << 63) - 1024))).withColumn("fold", F.pmod(F.shiftright(h, 3), F.lit(2)).cast("int"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(own.join(F.broadcast(known), "doc_id"))  # texts of the sample
    kinds = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n = lambda toxic, *folds: sum(kinds.get((f, toxic), 0) for f in folds)
    if not n(1, 0, 1) or not n(0, 0, 1):
        p = (n(1, 0, 1) + 0.5) / (n(0, 0, 1) + n(1, 0, 1) + 10)
        return Model({}, np.append(np.zeros(N_FEATURES), math.log(p / (1 - p))), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    each = rows.select("text", "toxic", "fold").mapInArrow(_entries, "entry string, fold int, toxic long, clean long")
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("toxic", "clean")]
    counts = cut(each.groupBy("entry").agg(*sums).where("toxic0 + toxic1 + clean0 + clean1 >= 3"))
    of = lambda f: _lexicon(counts.select("entry", F.col(f"toxic{f}").alias("t"), F.col(f"clean{f}").alias("c")), n(1, f), n(0, f))
    other = [of(1), of(0)]  # a fold's features come from the other fold's lexicon
    entries = _lexicon(counts.select("entry", (F.col("toxic0") + F.col("toxic1")).alias("t"), (F.col("clean0") + F.col("clean1")).alias("c")), n(1, 0, 1), n(0, 0, 1))
    shared = rows.sparkSession.sparkContext.broadcast(other)

    def measured(batches):
        own, machine = [Lexicon(e) for e in shared.value], grammar()
        for b in batches:
            x = [features(t.as_py(), own[f.as_py()], machine)[0] for t, f in zip(b["text"], b["fold"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b["toxic"]], names=["x", "y"])
        trim()

    got = rows.select("text", "fold", "toxic").mapInArrow(measured, "x array<double>, y int").collect()  # a few numbers for each row of the sample
    got = sorted((tuple(r.x), r.y) for r in got)
    x, y = np.array([g[0] for g in got]), np.array([g[1] for g in got], float)
    return Model(entries, *logistic(x, y))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_clauses) of every document: its toxicity from 0 to 1, and how many clauses matched."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        lexicon, machine = Lexicon(shared.value.entries), grammar()
        for b in batches:
            got = [features(t.as_py(), lexicon, machine) for t in b["text"]]
            x = np.array([g[0] for g in got]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(shared.value.score(x)), pa.array([g[1] for g in got], pa.int32())], names=["doc_id", "score", "n_clauses"])
        trim()

    return own.mapInArrow(run, "doc_id long, score double, n_clauses int")


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    tune(spark)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    model = train(docs, labels.where(~held))
    return judge(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")
