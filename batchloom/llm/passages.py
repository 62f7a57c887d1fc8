"""Passages of many words that stand in more than one document.

A window is ``words`` consecutive words (runs of anything but ASCII blanks, as they are). Each window has an
anchor: the ``words // 2 + 1`` of its consecutive words whose hash is the least. Equal windows hold equal anchors at
equal places, so only windows round anchors that two different texts share can be shared themselves; just
those are hashed as a whole and counted. Hashes have 64 bits.

Texts that are equal are one text here: their rows share all their words, if these make a window.

Defined cases: null text has no words; shorter texts have no window; a window that only one text holds is no
passage, however often it stands there; repeated rows are copies; a null id takes part; other columns are not
read; texts are hashed whole, in one pass of a few arrays as long as the text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

WORDS = 51
#: Bytes of text that are hashed at once (a longer text alone).
PART_BYTES = 4_000_000
#: Words whose hashes a worker remembers.
CACHE_WORDS = 100_000

_PLACE = np.uint64((1 << 28) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, put together from runs of powers of two."""
    out, size = None, 0
    part, width = _mix(words), 1
    while True:
        if n & width:
            if out is None:
                out, size = part, width
            else:
                many = max(len(words) - size - width + 1, 0)
                out = _mix(out[:many] * np.uint64(3) + _mix(part[size : size + many]) + np.uint64(width))
                size += width
        if 2 * width > n:
            return out[: max(len(words) - n + 1, 0)]
        many = max(len(part) - width, 0)
        part = _mix(part[:many] * np.uint64(5) + _mix(part[width : width + many]) + np.uint64(1))
        width *= 2


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(v)
    x = np.concatenate([v, np.full(-n % w, ~np.uint64(0))]).reshape(-1, w)
    before = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    after = np.minimum.accumulate(x, axis=1).ravel()
    return np.minimum(before[: n - w + 1], after[w - 1 : n])


def _parts(raws: list[bytes]):
    """(first, last) of some texts in a row, of about PART_BYTES."""
    first, size = 0, 0
    for k, raw in enumerate(raws):
        if size and size + len(raw) > PART_BYTES:
            yield first, k
            first, size = k, 0
        size += len(raw)
    if first < len(raws):
        yield first, len(raws)


def _anchored(raws: list[bytes], n: int):
    """Of the texts together: where each one's words begin, the windows inside a text, the anchor of each, and the hashes of runs as long as an anchor; and the words."""
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    split = [raw.split() for raw in raws]
    count = np.array([len(s) for s in split], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    words = np.fromiter((_hashes[w] for s in split for w in s), np.uint64, int(begin[-1]))
    gram = n // 2 + 1
    starts = np.flatnonzero(np.repeat(begin[1:], count) - np.arange(len(words)) >= n)
    if not len(starts):
        return begin, starts, starts, np.empty(0, np.uint64), words
    runs = run_hashes(words, gram)
    least = _least((runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64), n - gram + 1)
    return begin, starts, (least[starts] & _PLACE).astype(np.int64), runs, words


def _anchors(n: int):
    def rows(batches):
        for b in batches:
            out: dict[str, list] = {"doc": b["doc"], "version": b["version"], "ref": b["ref"], "n_words": [], "place": [], "key": []}
            for low, high in _parts(b["raw"]):
                begin, _, anchor, runs, _ = _anchored(b["raw"][low:high], n)
                anchor = np.unique(anchor)
                cut = np.searchsorted(anchor, begin)
                for k in range(high - low):
                    own = anchor[cut[k] : cut[k + 1]]
                    out["n_words"].append(int(begin[k + 1] - begin[k]))
                    out["place"].append((own - begin[k]).astype(np.int32))
                    out["key"].append(runs[own].view(np.int64))
            yield out

    return rows


def _windows(n: int):
    def rows(batches):
        for b in batches:
            for low, high in _parts(b["raw"]):
                begin, starts, anchor, _, words = _anchored(b["raw"][low:high], n)
                wanted = np.concatenate([np.asarray(p, dtype=np.int64) + begin[k] for k, p in enumerate(b["places"][low:high])])
                starts = starts[np.isin(anchor, wanted)]
                whole = run_hashes(words, n)
                cut = np.searchsorted(starts, begin)
                out: dict[str, list] = {"ref": b["ref"][low:high], "start": [], "hash": []}
                for k in range(high - low):
                    own = starts[cut[k] : cut[k + 1]]
                    out["start"].append((own - begin[k]).astype(np.int32))
                    out["hash"].append(whole[own].view(np.int64))
                yield out

    return rows


def _covered(n: int):
    """Passages and their words, of the starts of shared windows."""

    def rows(batches):
        for b in batches:
            out: dict[str, list] = {"ref": b["ref"], "n_passages": [], "n_passage_words": []}
            for starts in b["starts"]:
                s = np.unique(np.asarray(starts, dtype=np.int64))
                gap = s[1:] - s[:-1]
                out["n_passages"].append(int(1 + (gap > n).sum()))
                out["n_passage_words"].append(int(n + np.minimum(gap, n).sum()))
            yield out

    return rows


def shared_passages(source: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """(doc, version, n_passages, n_passage_words) of every row of (doc, version, raw) that shares a window of words
    with another: the maximal runs of shared words, and how many words are in them."""
    kind = dict(source.dtypes)["doc"]
    source = source.withColumn("ref", F.xxhash64("raw"))
    found = scratch.table(map_arrow(source, _anchors(words), f"doc {kind}, version long, ref long, n_words long, place array<int>, key array<long>"), "word-anchors")
    one = found.groupBy("ref").agg(F.first("place").alias("place"), F.first("key").alias("key"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"))
    one = scratch.table(one, "word-texts")
    each = one.select("ref", F.inline(F.arrays_zip("place", "key")))
    keys = each.groupBy("key").agg(F.min("ref").alias("a"), F.max("ref").alias("b")).filter("a <> b").select("key")
    live = each.join(keys, "key").groupBy(F.col("ref").alias("at")).agg(F.collect_list("place").alias("places"))
    # Sorted and merged at every size, as the plan for a corpus would be.
    texts = source.select("ref", "raw").join(live.hint("merge"), F.col("ref") == F.col("at")).dropDuplicates(["ref"]).select("ref", "raw", "places")
    windows = scratch.table(map_arrow(texts, _windows(words), "ref long, start array<int>, hash array<long>"), "word-windows")
    each = windows.select("ref", F.inline(F.arrays_zip("start", "hash")))
    shared = each.groupBy("hash").agg(F.min("ref").alias("a"), F.max("ref").alias("b")).filter("a <> b").select("hash")
    marks = each.join(shared.hint("merge"), "hash").groupBy("ref").agg(F.collect_list("start").alias("starts"))
    marks = scratch.table(map_arrow(marks, _covered(words), "ref long, n_passages long, n_passage_words long"), "word-marks")
    scratch.drop("word-windows")
    copies = one.filter((F.col("copies") > 1) & (F.col("n_words") >= words)).select("ref", F.lit(1).cast("long").alias("n_passages"), F.col("n_words").alias("n_passage_words"))
    marks = marks.join(copies.select("ref"), "ref", "left_anti").unionByName(copies)
    out = scratch.table(found.select("doc", "version", "ref").join(marks, "ref").drop("ref").dropDuplicates(["doc", "version"]), "word-passages")
    scratch.drop("word-anchors", "word-texts", "word-marks")
    return out
