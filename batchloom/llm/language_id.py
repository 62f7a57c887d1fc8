"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Features are 1- to 3-grams of the lower-cased text's code points, hashed to ``BUCKETS``; a feature's value
is its share of the text's n-grams times its inverse document frequency, and document frequencies cover
all learnable rows. Weights are fitted by follow-the-regularised-leader with elastic-net penalties on at
most ``FIT_ROWS`` labelled rows with ``FIT_BYTES`` of features; a temperature is then calibrated on rows that the fit left out. The fit
sees text and language only; prediction sees text only.

Defined cases: null text, or one without a letter, is ``und`` with score 0; so is every text when nothing
can be learned; rows without a language are predicted but not learned from; ties go to the first
language in alphabetical order; repeated rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_within, fold, map_arrow

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
SCALE = 100.0
#: Bounds of the fit: labelled rows (shared evenly by languages) and languages (the most frequent).
FIT_ROWS = 2400
MOST_LANGUAGES = 256
#: Bytes of the fit's features; beyond it the texts with the most distinct n-grams are left out.
FIT_BYTES = 128 << 20
#: Code points hashed at once; a longer text is taken in parts that overlap.
PART = 1 << 18

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def grams(text: str):
    """The hashed n-grams of a text, in parts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, max(len(codes), 1), PART):
        part = codes[at : at + PART + max(SIZES) - 1]
        for size in SIZES:
            end = min(len(part), PART + size - 1)
            count = end - size + 1
            if count <= 0:
                continue
            h = part[:count] * _MIX[0] + np.uint32(size)
            for k in range(1, size):
                h = (h ^ (h >> np.uint32(15))) * _MIX[1] + part[k : k + count] * _MIX[2]
            h = (h ^ (h >> np.uint32(13))) * _MIX[0]
            yield (h >> np.uint32(16)).astype(np.uint16)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _frequencies(batches):
    """Document frequencies of this task's rows, one row a bucket."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    docs = 0
    for b in batches:
        for text in b["text"]:
            if text:
                seen = np.zeros(BUCKETS, dtype=bool)
                for h in grams(text):
                    seen[h] = True
                total += seen
                docs += 1
    at = np.flatnonzero(total)
    yield {"bucket": [-1, *at.tolist()], "docs": [docs, *total[at].tolist()]}


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for h in grams(text):
        counts += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


def _vectors(batches):
    for b in batches:
        found = [vector(t) for t in b["text"]]
        yield {"lot": b["lot"], "lang": b["lang"], "part": b["part"], "at": [x[0].astype(np.int32).tobytes() for x in found], "share": [x[1].astype(np.float32).tobytes() for x in found]}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader for a softmax, with L1 and L2 penalties and a step per coordinate."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list, idf: np.ndarray, langs: list[str], epochs: int = 4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights by bucket (idf included) and the temperature; part 1 calibrates, the other parts fit."""
    index = {v: k for k, v in enumerate(langs)}
    data = []
    for r in rows:
        at = np.frombuffer(r["at"], dtype=np.int32)
        data.append((at, np.frombuffer(r["share"], dtype=np.float32) * idf[at] * SCALE, index[r["lang"]], r["part"]))
    learn = [d for d in data if d[3] != 1] or data
    check = [d for d in data if d[3] == 1]
    model = Leader(BUCKETS, len(langs))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(learn)):
            model.learn(*learn[k][:3])
    w = model.weights()
    t = temperature(np.array([x @ w[at] for at, x, _, _ in check]).reshape(-1, len(langs)), np.array([d[2] for d in check], dtype=int))
    return (w * idf[:, None] * SCALE).astype(np.float32), t


def _predict(shared):
    def rows(batches):
        langs, weights, t = shared.value
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [], "score": []}
            for text in b["text"]:
                if not langs or not has_letter(text):
                    out["lang_pred"].append("und")
                    out["score"].append(0.0)
                    continue
                total, count = np.zeros(len(langs)), 0
                for h in grams(text):
                    total += weights[h].sum(axis=0, dtype=np.float64)
                    count += len(h)
                p = softmax(total / max(count, 1) / t)
                best = int(p.argmax())
                out["lang_pred"].append(langs[best])
                out["score"].append(float(p[best]))
            yield out

    return rows


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; fold 0 of the ids is never learned from."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    part = fold(F.col(id_col)).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), part.alias("part"))
    known = rows.filter("part != 0 and lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    langs = sorted(counts)
    model: tuple = ([], None, 1.0)
    if langs:
        frequency = map_arrow(known.select("text"), _frequencies, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()
        df = np.zeros(BUCKETS)
        for r in frequency:
            if r["bucket"] >= 0:
                df[r["bucket"]] = r["docs"]
        total = max(r["docs"] for r in frequency)
        idf = np.log((1 + total) / (1 + df)) + 1
        quota = max(8, FIT_ROWS // len(langs))
        share = F.create_map(*[F.lit(x) for v in langs for x in (v, min(1.0, quota / counts[v]))])
        lot = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 20))
        sample = known.filter(lot / float(1 << 20) < share[F.col("lang")]).orderBy(lot, "doc_id", "text").select(lot.alias("lot"), "text", "lang", "part").limit(2 * quota * len(langs))
        drawn = collect_within(map_arrow(sample, _vectors, "lot long, lang string, part int, at binary, share binary"), "language-fit", FIT_BYTES, "at", "share")
        weights, t = fit(sorted(drawn, key=lambda r: (r["lot"], r["at"], r["share"], r["lang"])), idf, langs)
        model = (langs, weights, t)
    shared = spark.sparkContext.broadcast(model)
    return map_arrow(rows.select("doc_id", F.coalesce(F.col("part") == 0, F.lit(False)).alias("held_out"), "text"), _predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
