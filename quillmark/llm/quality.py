"""Generalised additive quality model with pairwise interactions."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows to learn from at most, by class: those with the least hash of their id.
MAX_ROWS = 6000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 300, 150, 8
RATE = 0.1
#: Weight of second derivatives below which a leaf is not split off.
LEAST_WEIGHT = 4.0
RIDGE = 1.0

FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "distinct_trigrams", "upper", "digits", "symbols",
    "bangs", "marks", "letters", "line_words", "short_lines", "distinct_lines", "compressed", "ended_lines", "long_words",
)
SYMBOLS = b"#*$%&|<>@{}[]=_~^\\"


def features(text: str | None) -> tuple[float, ...]:
    """FEATURES of a whole text; a text without words has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = len(raw)
    lacks = lambda chars: size - len(raw.translate(None, chars))
    upper = lacks(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = upper + lacks(b"abcdefghijklmnopqrstuvwxyz") + lacks(bytes(range(128, 256)))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    short = sum(1 for x in lines if x.count(b" ") < 3)
    ended = sum(1 for x in lines if x.rstrip()[-1:] in b".!?:;\"'")
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2)
    return (
        math.log1p(n),
        (size - lacks(b" \t\n\x0b\x0c\r")) / n,
        len(counts) / n,
        max(counts.values()) / n,
        trigrams if n > 2 else 1.0,
        upper / max(1, letters),
        lacks(b"0123456789") / size,
        lacks(SYMBOLS) / size,
        raw.count(b"!") / n,
        lacks(b".,;:?") / n,
        letters / size,
        math.log1p(n / len(lines)),
        short / len(lines),
        len(set(lines)) / len(lines),
        len(zlib.compress(raw, 1)) / size,
        ended / len(lines),
        sum(1 for w in counts if len(w) > 24) / len(counts),
    )


class GA2M:
    """Intercept, a table of scores for each feature's bins, and one for each of some pairs' cells."""

    def __init__(self, edges, intercept, tables, pair_edges, pairs, pair_tables):
        self.edges, self.intercept, self.tables = edges, intercept, tables
        self.pair_edges, self.pairs, self.pair_tables = pair_edges, pairs, pair_tables

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of the tables' scores by row: bin lookups and additions only."""
        out = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Distinct inner quantiles."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf value of each bin: the best cuts of an ordered histogram, taken greedily, up to so many leaves."""
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(hess)))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            cuts = np.arange(a + 1, b)
            cuts = cuts[(h[cuts] - h[a] >= LEAST_WEIGHT) & (h[b] - h[cuts] >= LEAST_WEIGHT)]
            if len(cuts):
                more = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(more.argmax())
                if more[k] > best[0]:
                    best = (float(more[k]), (a, b), int(cuts[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def cross_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf value of each cell): one cut on either axis, four leaves, the best of all."""
    g, h = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n, m = grad.shape
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")

    def corners(s):
        whole, top, left, both = s[n, m], s[i, m], s[n, j], s[i, j]
        return both, top - both, left - both, whole - top - left + both

    gs, hs = corners(g), corners(h)
    gain = sum(x * x / (y + RIDGE) for x, y in zip(gs, hs, strict=True)) - g[n, m] ** 2 / (h[n, m] + RIDGE)
    out = np.zeros((n, m))
    if not gain.size:
        return 0.0, out
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    a, b = int(i[k]), int(j[k])
    leaf = [x[k] / (y[k] + RIDGE) for x, y in zip(gs, hs, strict=True)]
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = leaf
    return float(gain[k]), out


def fit_ga2m(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> GA2M:
    """Cyclic boosting: each round adds a shallow tree of every feature in turn, then of the best pairs."""
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    edges = [bin_edges(x[:, f], BINS) for f in range(d)]
    pair_edges = [bin_edges(x[:, f], PAIR_BINS) for f in range(d)]
    tables, at = [np.zeros(len(e) + 1) for e in edges], [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    share = (weight[y == 1].sum() + 0.5) / (weight.sum() + 1)
    margin = np.full(n, math.log(share / (1 - share)))
    intercept = float(margin[0]) if n else 0.0

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS if n else 0):
        for f in range(d):
            g, h = slopes()
            size = len(tables[f])
            step = RATE * shallow_tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size))
            tables[f] += step
            margin += step[at[f]]
    pat = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    shape = lambda a, b: (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)

    def cells(a, b, v):
        s = shape(a, b)
        return np.bincount(pat[a] * s[1] + pat[b], v, s[0] * s[1]).reshape(s)

    ranked = []
    if n:
        g, h = slopes()
        ranked = sorted(((cross_tree(cells(a, b, g), cells(a, b, h))[0], -a, -b) for a in range(d) for b in range(a + 1, d)), reverse=True)[:PAIRS]
    pairs = [(-a, -b) for gain, a, b in ranked if gain > 0]
    pair_tables = [np.zeros(shape(a, b)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            step = RATE * cross_tree(cells(a, b, g), cells(a, b, h))[1]
            pair_tables[k] += step
            margin += step[pat[a], pat[b]]
    return GA2M(edges, intercept, tables, pair_edges, pairs, pair_tables)


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, weights) of at most max_rows labelled documents of either class, outside the held-out fold.

    Weights bring the classes back to their shares of all labelled rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.where(~held_out(5, 0)).withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    some = known.where("y = 1").orderBy("h").limit(max_rows).union(known.where("y = 0").orderBy("h").limit(max_rows)).select("doc_id", "y")
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": list(feature_matrix(b["text"]))})

    # At most 2 * max_rows rows are broadcast and come back, a few numbers each.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("y", "text").mapInPandas(run, "y int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    weight = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weight[y == c] = share[c] / (y == c).sum()
    return x, y, weight / weight.mean() if len(y) else weight


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.3).

    The model learns from at most max_rows labelled documents of either class.  Null and empty texts have
    the features of a text without words and are scored like any other; without labels every score is 0.5.
    A null id isn't held out; conflicting labels of one id count as their mean; repeated rows repeat; other
    columns are ignored; an empty table gives no rows.  Equal features give equal scores; among cuts of equal gain
    the first is taken.  Scoring is per row, of whole texts however long, without a shuffle.
    """
    x, y, weight = training_rows(docs, labels, max_rows)
    model = docs.sparkSession.sparkContext.broadcast(fit_ga2m(x, y, weight))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = model.value.scores(feature_matrix(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.3).astype("int32")})

    return docs.select("doc_id", held_out(5, 0).alias("held_out"), "text").mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
