"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Every text gives a dozen numeric features.  They are cut into quantile bins; cyclic boosting visits the features in
turn, fits a shallow tree (four leaves) to the logistic loss on the feature's histogram and adds it to that feature's
lookup table.  The pairs whose two-way histogram explains most of what is left get tables too, boosted by trees of one
cut on each axis.  A score is then the logistic of an intercept plus one table entry per feature and pair: vectorised
additions, no tree is walked.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled rows (all, when there are fewer), chosen by a hash of
doc_id; only their features reach the driver.  Scoring covers every row.  Labels, lang, source and doc_id are no inputs.

Defined results: a null text is the empty text and gets a score like any other.  Labels that are null are not learned
from, repeated label rows count as often as they occur; with no usable label, or one class only, the score is the share
of label 1 (0.5 without labels).  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilebook.llm.common import bounded_sample, fold, text_of

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 40, 0.15, 4
FEATURES = ["log_chars", "word_length", "distinct_words", "repeated_next", "upper", "digits", "symbols", "bangs", "stops", "breaks", "bars", "top_word"]

_SYMBOL = np.zeros(256)
_SYMBOL[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_/"]] = 1
_UPPER, _LOWER, _DIGIT, _STOP = (np.zeros(256) for _ in range(4))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = 1, 1, 1
_STOP[[ord(c) for c in ".,;:?"]] = 1
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP])


def features(text: str) -> list[float]:
    """The numeric features of one whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(len(words), 1)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) if raw else np.zeros(256)
    upper, lower, digits, symbols, stops = _CLASSES @ counts
    size = max(len(raw), 1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return [np.log1p(len(text)), (size - counts[32] - counts[10]) / n, len(seen) / n, sum(map(operator.eq, words, words[1:])) / n,
            upper / max(upper + lower, 1), digits / size, symbols / size, counts[33] / size, stops / n, counts[10] / n, counts[124] / size,
            max(seen.values(), default=0) / n]


class Gam:
    """Bin edges, one table per feature and per chosen pair, and an intercept."""

    def __init__(self, edges, tables, pairs, pair_edges, pair_tables, intercept):
        self.edges, self.tables, self.pairs, self.pair_edges, self.pair_tables, self.intercept = edges, tables, pairs, pair_edges, pair_tables, intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            total += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step per bin of a tree of at most LEAVES leaves over ordered bins."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return step


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Step per cell of the best tree with one cut on each axis, and its gain."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    best, cut = -1.0, None
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            q = [(cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j])]
            q.append((cg[-1, -1] - sum(x[0] for x in q), ch[-1, -1] - sum(x[1] for x in q)))
            gain = sum(_gain(*x) for x in q)
            if gain > best:
                best, cut = gain, (i + 1, j + 1)
    step = np.zeros_like(g)
    if cut:
        for r in (slice(0, cut[0]), slice(cut[0], None)):
            for c in (slice(0, cut[1]), slice(cut[1], None)):
                step[r, c] = g[r, c].sum() / (h[r, c].sum() + 1.0)
    return step, best - _gain(g.sum(), h.sum())


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    intercept = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Gam([], [], [], [], [], intercept)
    d = x.shape[1]
    edges = [_edges(x[:, j], BINS) for j in range(d)]
    pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(d)]
    code = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)]
    coarse = [np.searchsorted(pair_edges[j], x[:, j], side="right") for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            step = RATE * _tree(np.bincount(code[j], g, len(tables[j])), np.bincount(code[j], h, len(tables[j])))
            tables[j] += step
            total += step[code[j]]
    cells = lambda a, b: (coarse[a] * (len(pair_edges[b]) + 1) + coarse[b], (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1))
    grid = lambda at, shape, v: np.bincount(at, v, shape[0] * shape[1]).reshape(shape)
    g, h = slopes()
    ranked = sorted(((_cross(grid(*cells(a, b), g), grid(*cells(a, b), h))[1], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)
    pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    pair_tables = [np.zeros(cells(a, b)[1]) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            at, shape = cells(a, b)
            step = RATE * _cross(grid(at, shape, g), grid(at, shape, h))[0]
            pair_tables[k] += step
            total += step.ravel()[at]
    return Gam(edges, tables, pairs, pair_edges, pair_tables, intercept)


def feature_table(docs: DataFrame, extra: list[str]) -> DataFrame:
    """The columns ``extra`` and x, the features of every text."""
    arrow = docs.select(*extra)

    def run(batches):
        for b in batches:
            rows = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), pa.array(rows, type=pa.list_(pa.float64()))], names=[*extra, "x"])

    return docs.select(*extra, text_of().alias("text")).mapInArrow(run, arrow.schema.add("x", T.ArrayType(T.DoubleType())))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Gam:
    """Fit on at most ``sample`` labelled documents."""
    rows = bounded_sample(labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")), "doc_id", sample)
    known = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most ``sample`` narrow rows
    got = sorted(feature_table(known, ["doc_id", "y"]).collect(), key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], dtype=float))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    arrow = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        gam = Gam(**shared.value)
        for b in batches:
            if b.num_rows:
                x = np.array([features(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(gam.score(x))], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows whose id fold (modulo 4) is not 2."""
    model = train(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
