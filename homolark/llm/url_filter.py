"""URL filter: allow and block rules by host and path, and gradient-boosted trees for the rest.

A rule fits a host and its subdomains if the path starts with the rule's; the longest one wins. Rules are indexed by host suffix and path prefix, so a
URL looks up its own suffixes instead of every rule. The trees are trained from labelled URLs that the caller gives; without them, the
URLs that a rule fits are the labelled ones. A bounded sample trains them: of the distinct URLs those whose hash lies in the share `SAMPLE` /
number of rows, so about `SAMPLE` at most, a documented bound. All URLs that no rule fits get the trees' verdict.

Features are lexical: lengths, path depth, digit and upper-case ratios, entropy, parameter count, punctuation, and
how often the host's last labels (hashed) were blocked in training; a training URL's statistic comes from other hosts' folds than its own. What the
rules look at themselves, the last label and the first segment, is no feature. Trees are histogram-based with second-order gain. A fifth of the hosts
is held out; `held_out` has the number of their URLs, the share judged right and the share of the larger class.

Null or malformed URLs have empty host and path, no rule, and are judged by the trees like any other. Without
labelled URLs of both kinds the verdict is the majority label, or allow if there is none; a tie at a probability of one half allows. URLs of any length are
read whole, rows are judged one by one (repeated ones alike), an empty table gives an empty result, and columns other than page_id and url are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

SAMPLE = 20_000
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SUFFIXES = 1024
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_WORDS = re.compile(r"[A-Za-z]+")


def parts(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


class Rules:
    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        for own in self.by_host.values():
            own.sort(key=lambda r: -len(r[0]))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, labels = None, host.split(".")
        for k in range(len(labels)):
            for prefix, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(prefix):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
        return best or (None, None)


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.bincount(np.frombuffer(s.encode(), np.uint8))
    p = n[n > 0] / n.sum()
    return float(-(p * np.log2(p)).sum())


def features(url: str | None) -> list[float]:
    """Lexical features; the last one is the bucket of the host's last two labels, to be replaced by its statistic."""
    u = url or ""
    host, path = parts(u)
    query = u.partition("?")[2]
    n = max(1, len(u))
    words = _WORDS.findall(path)
    return [
        len(u), len(host), len(path), len(query), path.count("/"), host.count("."), query.count("=") + query.count("&"),
        sum(c.isdigit() for c in u) / n, sum(c.isdigit() for c in path), sum(c.isupper() for c in u) / n, u.count("-"), u.count("_") + u.count("%"),
        _entropy(u), _entropy(host), float("#" in u), float(u.startswith("https")), max(map(len, words), default=0), len(words),
        float(zlib.crc32(".".join(host.split(".")[-2:]).encode()) % SUFFIXES),
    ]


N_FEATURES = len(features(None))


@dataclass
class Boosted:
    """Trees over binned features; a tree is arrays feature, bin, left child, value, level by level."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    base: float
    suffix: np.ndarray
    held_out: tuple[int, float, float] | None = None

    def _bins(self, x: np.ndarray, statistic: np.ndarray | None = None) -> np.ndarray:
        x = x.copy()
        x[:, -1] = self.suffix[x[:, -1].astype(int)] if statistic is None else statistic
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)])

    def margin(self, x: np.ndarray, bins: np.ndarray | None = None) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b, out = self._bins(x) if bins is None else bins, np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, value in self.trees:
            node = np.zeros(len(x), int)
            while (left[node] > 0).any():
                inner = left[node] > 0
                node = np.where(inner, left[node] + (b[rows, feature[node]] > cut[node]), node)
            out += value[node]
        return out


FOLDS = 5


def _statistic(at: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Share of block among the rows of each suffix, drawn towards the whole share."""
    return (np.bincount(at, y, SUFFIXES) + share * 10) / (np.bincount(at, minlength=SUFFIXES) + 10)


def fit(x: np.ndarray, y: np.ndarray, hosts: np.ndarray | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: int = 5, bins: int = 64) -> Boosted:
    """Logistic boosting; y is 1 for block. hosts: a number for each row; rows of a number share a fold."""
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return Boosted([np.zeros(0)] * x.shape[1] if x.ndim == 2 else [], [], 1.0 if share == 1 else -1.0, np.zeros(SUFFIXES))
    at = x[:, -1].astype(int)
    model = Boosted([], [], float(np.log(share / (1 - share))), _statistic(at, y, share))
    z = x.copy()
    fold = (np.arange(len(y)) if hosts is None else hosts) % FOLDS
    for f in range(FOLDS):
        z[fold == f, -1] = _statistic(at[fold != f], y[fold != f], share)[at[fold == f]]
    model.edges = [np.unique(np.quantile(z[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(z.shape[1])]
    b = model._bins(x, z[:, -1])
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, cut, left, value = [0], [0], [0], [0.0]
        level = [(0, np.arange(len(y)))]
        for d in range(depth + 1):
            nxt = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + l2)
                best = (1e-6, 0, 0)
                for k in range(b.shape[1]) if d < depth and len(rows) >= 2 * least else ():
                    own = b[rows, k]
                    gl, hl, nl = (np.cumsum(np.bincount(own, w, bins + 1)) for w in (g[rows], h[rows], None))
                    ok = (nl >= least) & (len(rows) - nl >= least)
                    gain = np.where(ok, gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2), 0)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], k, j)
                if best[0] > 1e-6:
                    feature[node], cut[node], left[node] = best[1], best[2], len(value)
                    go = b[rows, best[1]] > best[2]
                    for part in (rows[~go], rows[go]):
                        nxt.append((len(value), part))
                        feature.append(0), cut.append(0), left.append(0), value.append(0.0)
            level = nxt
        tree = (np.array(feature), np.array(cut), np.array(left), np.array(value))
        model.trees.append(tree)
        score = score + Boosted(model.edges, [tree], 0.0, model.suffix).margin(x, b)
    return model


def matrix(urls) -> np.ndarray:
    return np.array([features(u) for u in urls], float).reshape(len(urls), N_FEATURES)


def train(urls: DataFrame, rules=RULES, sample: int = SAMPLE, labelled: DataFrame | None = None) -> Boosted:
    """Trees from a sample of labelled URLs: (url, block boolean), or those of `urls` that a rule fits."""

    def by_rule(batches):
        own = Rules(rules)
        for pdf in batches:
            verdicts = [own.match(*parts(u))[1] for u in pdf["url"]]
            yield pd.DataFrame({"url": pdf["url"], "block": [v == "block" for v in verdicts]})[[v is not None for v in verdicts]]

    known = urls.select("url") if labelled is None else labelled.select(F.col("url").cast("string").alias("url"), F.col("block").cast("boolean").alias("block")).where("url is not null and block is not null")
    total = known.count()
    share = min(1.0, sample / total) if total else 1.0
    known = known.where(F.shiftrightunsigned(F.xxhash64("url"), 1) <= int(share * ((1 << 63) - 1024))).distinct()
    rows = known.mapInPandas(by_rule, "url string, block boolean") if labelled is None else known
    rows = sorted((r.url or "", bool(r.block)) for r in rows.collect())  # about `sample` rows at most
    host = np.array([zlib.crc32(parts(u)[0].encode()) for u, _ in rows], np.int64)
    x, y = matrix([u for u, _ in rows]), np.array([v for _, v in rows], float)
    held = host // FOLDS % 5 == 0
    model = fit(x[~held], y[~held], host[~held])
    if held.any():
        right = ((model.margin(x[held]) > 0) == (y[held] > 0)).mean()
        model.held_out = int(held.sum()), float(right), float(max(y[held].mean(), 1 - y[held].mean()))
    return model


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, labelled: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict and p_block (null where a rule decides); labelled: (url, block) to train from."""
    spark = pages.sparkSession
    tune(spark)
    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    model = spark.sparkContext.broadcast(train(some, rules, sample, labelled))

    def run(batches):
        own = Rules(rules)
        for pdf in batches:
            urls = [u if isinstance(u, str) else None for u in pdf["url"]]
            at = [parts(u) for u in urls]
            found = [own.match(*a) for a in at]
            free = [i for i, f in enumerate(found) if f[1] is None]
            p = np.full(len(urls), np.nan)
            p[free] = 1 / (1 + np.exp(-model.value.margin(matrix([urls[i] for i in free]))))
            verdict = [f[1] or ("block" if p[i] > 0.5 else "allow") for i, f in enumerate(found)]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "host": [a[0] for a in at], "path": [a[1] for a in at], "rule": [f[0] for f in found], "verdict": verdict, "p_block": pd.Series(p).astype("Float64")})

    return some.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, p_block double")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
