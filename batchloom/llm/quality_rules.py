"""Quality rules: base rules on exact text statistics, then an isolation forest over them.

A forest for each set of FEATURE_SETS is fitted on at most ``SAMPLE_ROWS`` rows that pass the base, the
smallest by a hash. Every document is scored by the mean path length to isolate it; the set and threshold
are those that best separate all labelled rows, from histograms of their scores.

Defined cases: null text has no words and fails the base; ties in text give equal statistics and equal
verdicts; repeated rows each give a row; without labels of both kinds the verdict is to keep; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw, map_arrow, materialise

#: Bound of the fitting sample, rows a tree, trees, and bins of the score histogram.
SAMPLE_ROWS = 4096
TREE_ROWS = 64
TREES = 100
BINS = 2000
#: A good row refused weighs as so many bad rows kept, as shares of their kinds.
CAUTION = 4

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share", "digit_share", "punctuation_share")

FEATURE_SETS = (("symbol_share", "word_length"), ("symbol_share", "word_length", "upper_share", "punctuation_share"), FEATURES)

_BLANK = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_POINTS = b"!?;:@=~^_\"'()[]{}/\\+`"


def repeat_words(words: list, size: int = 5) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    n = len(words)
    if n <= size:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    key, kinds = ids, len(known)
    for k in range(1, size):  # exact: a prefix's rank and the next word make one number
        key = key[: n - k] * len(known) + ids[k:]
        kinds *= len(known)
        if kinds * len(known) >= 2**62 and k < size - 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            kinds = n
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[back] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The exact counts (BASE) and the shares that the forest sees (FEATURES)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    size = len(raw)
    chars = len(text) - (size - len(raw.translate(None, _BLANK)))
    without = lambda s: size - len(raw.translate(None, s))
    symbols = without(_SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeat_words(words)
    n, c = max(len(words), 1), max(chars, 1)
    shares = (symbols / c, dup / max(lines, 1), repeat / n, chars / n, without(_UPPER) / c, without(_DIGITS) / c, without(_POINTS) / c)
    return (len(words), chars, symbols, dup, repeat), shares


def _measure(batches):
    for b in batches:
        out: dict[str, list] = {"doc_id": b["doc_id"]} | {k: [] for k in (*BASE, *FEATURES)}
        for text in b["text"]:
            counts, shares = statistics(text)
            for k, v in zip((*BASE, *FEATURES), (*counts, *shares)):
                out[k].append(v)
        yield out


class Forest:
    """Random axis splits; a node is (feature, cut, left, right), a leaf points to itself."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean path of an unsuccessful search in a binary tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def node(x: np.ndarray, depth: int) -> int:
            me = len(feature)
            for part, v in ((feature, 0), (cut, np.inf), (left, me), (right, me), (path, depth + self.mean_path(len(x)))):
                part.append(v)
            low, high = x.min(axis=0), x.max(axis=0)
            can = np.flatnonzero(high > low)
            if depth < self.depth and len(x) > 1 and len(can):
                f = int(rng.choice(can))
                c = rng.uniform(low[f], high[f])
                under = x[:, f] < c
                if under.any() and not under.all():
                    feature[me], cut[me] = f, c
                    left[me] = node(x[under], depth + 1)
                    right[me] = node(x[~under], depth + 1)
            return me

        node(rows, 0)
        return tuple(np.array(v) for v in (feature, cut, left, right, path))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the minus of mean path over expected path: near 1 for rows that few splits isolate."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = np.where(rows[at, feature[node]] < cut[node], left[node], right[node])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(self.mean_path(self.size), 1e-9))


def _table(b: dict[str, list], features: tuple[str, ...]) -> np.ndarray:
    """Square roots, so that small shares are told apart."""
    return np.sqrt(np.array([b[f] for f in features], dtype=np.float64).T.reshape(-1, len(features)))


def _scored(shared):
    def rows(batches):
        for b in batches:
            scores = {f"score{k}": forest.score(_table(b, features)).tolist() if b["doc_id"] else [] for k, (features, forest) in enumerate(shared.value)}
            yield b | scores

    return rows


def best_cut(histogram: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(gain, score from which rows are refused) from (bin, bad rows, good rows)."""
    bad, good = sum(x[1] for x in histogram), sum(x[2] for x in histogram)
    if not bad or not good:
        return 0.0, 2.0
    best, cut, b, g = 0.0, 2.0, 0, 0
    for bin_, x, y in sorted(histogram, reverse=True):
        b, g = b + x, g + y
        if (gain := b / bad - CAUTION * g / good) > best:
            best, cut = gain, bin_ / BINS
    return best, cut


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, BASE counts, base_failed, score, kept) of every document."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    counts = ", ".join(f"{k} long" for k in BASE)
    shares = ", ".join(f"{k} double" for k in FEATURES)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    measured = materialise(map_arrow(source, _measure, f"doc_id {kind}, {counts}, {shares}"), "quality-statistics")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).alias("__label")).filter("__label is not null").groupBy("__id").agg(F.max("__label").cast("int").alias("__label"))

    sample = draw(measured.filter(~failed), SAMPLE_ROWS, "doc_id", *BASE).select(*FEATURES).collect()
    columns = {f: [r[f] for r in sample] for f in FEATURES}
    forests = [(features, Forest(_table(columns, features))) for features in FEATURE_SETS] if len(sample) > 1 else []
    shared = spark.sparkContext.broadcast(forests)
    names = [f"score{k}" for k in range(len(forests))]
    # Labelled rows only, before any is scored; all rows are scored once, by the forest that parts these best.
    labelled = measured.filter(~failed).join(known, F.col("doc_id") == F.col("__id")).select(*measured.columns, "__label")
    labelled = map_arrow(labelled, _scored(shared), ", ".join([f"doc_id {kind}", counts, shares, "__label int", *[f"{n} double" for n in names]]))
    bad, good = F.count_if(F.col("__label") == 0).alias("bad"), F.count_if(F.col("__label") == 1).alias("good")
    which = F.posexplode(F.array(*names) if names else F.array().cast("array<double>")).alias("k", "score")
    bins = labelled.select("__label", which).groupBy("k", F.floor(F.col("score") * BINS).alias("bin")).agg(bad, good).collect()
    cuts = [best_cut([(r["bin"], r["bad"], r["good"]) for r in bins if r["k"] == k]) for k in range(len(names))]
    best = max(range(len(names)), key=lambda k: cuts[k][0], default=None)
    scored = measured.withColumn("score", F.lit(0.0))
    if best is not None:
        chosen = spark.sparkContext.broadcast([forests[best]])
        scored = map_arrow(measured, _scored(chosen), f"doc_id {kind}, {counts}, {shares}, score0 double").withColumnRenamed("score0", "score")
    cut = 2.0 if best is None else cuts[best][1]
    return scored.withColumn("base_failed", failed).select("doc_id", *BASE, "base_failed", "score", (~F.col("base_failed") & (F.col("score") < cut)).alias("kept"))
