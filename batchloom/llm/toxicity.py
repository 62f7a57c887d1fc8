"""Toxicity by compression distance: one zstandard dictionary of toxic and one of ordinary text.

A text is lower-cased, reduced to words of letters, and cut before words into windows of about
``WINDOW_BYTES``; letters are turned by their place in the word, so that words match by how they begin. Each window is compressed with both dictionaries under the same parameters; what the
toxic one saves is the window's distance. Windows begin with a key that both dictionaries hold, so the
fixed costs of a frame don't hide small savings, and are too short for entropy coding of literals, so
windows without toxic matters compress alike.

A class's dictionary is trained by coverage, as the library's trainer does, but of word stems that the
other class's text all but lacks: they are taken while they cover documents of the class that are little
covered yet. The dictionaries are filled up to one size. A logistic model of the windows' distances (how
many reach each of STEPS, in all and by length) is calibrated on labelled rows that training left out.

Labelled rows: at most ``FIT_TOXIC`` and ``FIT_ORDINARY``, drawn by a hash, never of fold 0, with ``FIT_BYTES`` of
text at most; every text is scored whole, however long. Defined
cases: null or wordless text has distances 0, and a text whose distances are all 0 is never called toxic; without labels of both
kinds, or if no labelled toxic text has a distance, every score is 0; a document with several labels is toxic if one is; of
repeated ids with different texts the fit takes the least text; equal stems by gain go by their bytes; a null id is in no fold and has no label;
repeated rows each give a row, scored by its own text; other columns are never read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_within, draw, fold, map_arrow, ship

WINDOW_BYTES = 32
FIT_TOXIC, FIT_ORDINARY = 1500, 4000
#: Bytes of all texts of the fit; beyond it the longest are left out.
FIT_BYTES = 32 << 20
#: Shortest match and longest stem; stems of a dictionary, those weighed, and how much rarer the other class must have one.
K = 6
STEM_BYTES = 12
RUNS = 96
CANDIDATES = 1500
CONTRAST = 5
#: Savings of a window that are counted, as the calibration's features.
STEPS = (2, 3, 4, 5, 6, 7, 8)
#: Log odds, at most, of a text without a window that the toxic dictionary saves.
NO_EVIDENCE = -1.0
_KEY = bytes(range(1, 9)) * 4
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_compressors: dict[bytes, tuple] = {}


def normal(text: str | None) -> bytes:
    """The lower-cased words of letters, with a blank before and after each."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def placed(raw: bytes) -> bytes:
    """Letters turned by their place in the word, so that only words that begin alike match."""
    a = np.frombuffer(raw, dtype=np.uint8)
    at = np.arange(len(a))
    blank = a == 32
    place = at - np.maximum.accumulate(np.where(blank, at, 0))
    return np.where(blank, 32, (a + 37 * np.minimum(place, 200)) & 255).astype(np.uint8).tobytes()


def windows(raw: bytes) -> list[bytes]:
    """Parts of the normal text, placed; each begins with a word."""
    out, at, find, turned = [], 0, raw.find, placed(raw)
    while 0 <= (end := find(b" ", at + WINDOW_BYTES)) and end < len(raw) - 1:
        out.append(turned[at:end])
        at = end
    if at < len(raw):
        out.append(turned[at:])
    return out


def _stems(raw: bytes) -> set[bytes]:
    """The beginnings of a text's words, and the words."""
    out = set()
    for w in set(raw.split()):
        w = b" " + w + b" "
        out.update(w[:size] for size in range(K, min(len(w), STEM_BYTES) + 1))
        out.add(w[:24])
    return out


def train(own: list[bytes], other: list[bytes]) -> list[bytes]:
    """Stems of ``own`` that ``other`` all but lacks, the most covering first; a stem of a chosen one is left out."""
    mine: Counter = Counter()
    for t in own:
        mine.update(_stems(t))
    n, m = max(len(own), 1), max(len(other), 1)
    least = max(3, 0.006 * n)
    theirs = dict.fromkeys((g for g, c in mine.items() if c >= least and len(g) >= K), 0)
    for t in other:
        for g in _stems(t):
            if g in theirs:
                theirs[g] += 1
    share = {g: theirs[g] / m for g in theirs if CONTRAST * (theirs[g] + 0.5) / m < mine[g] / n}
    share = {g: x for g, x in share.items() if g[:K] in share}  # what already matches has to be rare
    # A stem stands for its endings; one that nearly always goes on alike is taken with what follows.
    longer = {g[:-1] for g, c in mine.items() if len(g) > K and c >= 0.8 * mine.get(g[:-1], c + c) and g in share}
    best = sorted((g for g in share if g not in longer), key=lambda g: (share[g] * CONTRAST - mine[g] / n, -len(g), g))[:CANDIDATES]
    have = {g: [i for i, t in enumerate(own) if g in t] for g in best}
    out: list[bytes] = []
    weight = np.ones(n)
    while have and len(out) < RUNS:
        gain = {g: weight[v].sum() - CONTRAST * share[g] * n for g, v in have.items()}
        top = max(gain, key=lambda g: (gain[g], len(g), g))
        if gain[top] < max(2.0, 0.003 * n):  # a few chance stems must not get in
            break
        weight[have.pop(top)] /= 2
        have = {g: v for g, v in have.items() if not g.startswith(top) and not top.startswith(g)}
        out.append(top)
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the two, of one size: the most covering runs last, nearest to the window, then the key."""
    parts = [b"\0".join(map(placed, reversed(train(a, b)))) for a, b in ((toxic, ordinary), (ordinary, toxic))]
    size = max(map(len, parts), default=0) + 8
    return tuple(p.rjust(size, b"\0") + b"\0" + _KEY for p in parts)  # type: ignore[return-value]


def _compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=14, search_log=6, min_match=K, target_length=64, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress


def distances(raw: bytes, contents: tuple[bytes, bytes]) -> list[int]:
    """The text's bytes, and how many windows save each number of bytes (the last: that or more) by the toxic dictionary."""
    key = contents[0] + contents[1]
    if key not in _compressors:
        _compressors.clear()
        _compressors[key] = (_compressor(contents[0]), _compressor(contents[1]))
    toxic, ordinary = _compressors[key]
    out = [0] * (STEPS[-1] + 1)
    for w in windows(raw):
        w = _KEY + w
        d = len(ordinary(w)) - len(toxic(w))
        if d > 0:
            out[min(d, STEPS[-1])] += 1
    return [len(raw), *out[1:]]


def features(found: list[int]) -> np.ndarray:
    size, counts = max(found[0], 1), found[1:]
    reach = [sum(counts[t - 1 :]) for t in STEPS]
    return np.array([1.0, *[np.log1p(r) for r in reach], *[np.log1p(3000 * r / (size + 300)) for r in reach]])


def calibrate(rows: list[tuple[list[int], int]]) -> list[float]:
    """Weights of a logistic model by Newton's method with a light ridge; classes weigh alike."""
    x = np.array([features(found) for found, _ in rows])
    y = np.array([c for _, c in rows], dtype=float)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-4, *[3e-3] * (x.shape[1] - 1)]) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def log_odds(found: list[int], w: list[float]) -> float:
    """A text of which the toxic dictionary saves nothing has shown nothing, and is never called toxic."""
    z = float(np.dot(features(found), w))
    return z if any(found[1:]) else min(z, NO_EVIDENCE)


def _score(shared):
    def rows(batches):
        model = shared.value
        for b in batches:
            scores = []
            for text in b["text"]:
                if model is None:
                    scores.append(0.0)
                    continue
                contents, w = model
                z = log_odds(distances(normal(text), contents), w)
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple | None:
    """((toxic, ordinary dictionary), weights), or None if the labels can't teach: then every score is 0 and nothing is rejected."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).alias("toxic")).filter("toxic is not null").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    part = fold(F.col("__id"))
    known = known.filter(part != 0).withColumn("part", part)
    chosen = draw(known.filter("toxic = 1"), FIT_TOXIC, "__id").unionAll(draw(known.filter("toxic = 0"), FIT_ORDINARY, "__id"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text")).select("toxic", "part", "text")
    rows = collect_within(rows, "toxicity-fit", FIT_BYTES, "text")
    seen: dict[bytes, tuple[int, int]] = {}
    for r in sorted(rows, key=lambda r: (r["toxic"], r["text"])):
        seen[normal(r["text"])] = (r["toxic"], r["part"])
    split = lambda kind, check: [t for t, (k, p) in seen.items() if k == kind and (p == 1) == check]
    toxic, ordinary = split(1, False), split(0, False)
    if not toxic or not ordinary:
        return None
    contents = dictionaries(toxic, ordinary)
    check = [(distances(t, contents), kind) for kind in (0, 1) for t in split(kind, True)]
    if len({kind for _, kind in check}) < 2:
        check = [(distances(t, contents), kind) for kind, part in ((0, ordinary), (1, toxic)) for t in part]
    if not any(any(found[1:]) for found, kind in check if kind):
        return None  # no toxic text was told by its windows: nothing is learned, and the classes' numbers alone decide nothing
    return contents, calibrate(check)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    shared = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(source, _score(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        model = shared.value
        if model is None:
            return pd.Series([False] * len(texts))
        contents, w = model
        return pd.Series([log_odds(distances(normal(t), contents), w) >= 0 for t in texts])

    return docs.filter(~toxic(F.col(text_col)))
