"""Removal of long repeated byte strings with a run-compressed Burrows-Wheeler index.

Every string of ``length`` bytes contains an anchor: the ``GRAM`` bytes whose hash is the least among the
string's own. Equal strings hold equal anchors at equal places, so strings can only repeat around anchors
that repeat, and there the bytes before and after align. That gives small independent indexes:

1. Each text's anchors are found in one pass, with a digest of the segment around each.
2. Anchors are counted; equal segments are one row from here on, and all of such a segment is repeated.
3. Where segments around one anchor differ, they are fetched once and indexed together. The transform is
   positional, for aligned strings: a column lists the bytes of all rows in the order of what precedes
   them. It is held as runs; the step to the next column moves whole runs, and only run ends are looked
   at to find how far neighbours agree. Streaming the columns gives each row's matching statistic with
   any other row, and marks the windows where it reaches ``length``.

An anchor with more than ``GROUP_ROWS`` different segments is split: windows that begin in the first and
in the second half of the range share more bytes, whose digest tells the rows apart, and so on until a
group is small; rows that agree in a whole range become one. No group is capped.

Defined cases: null text is empty; shorter texts have no such string; long texts are read whole, PART starts at a time; of equal strings none is kept; matches never cross documents, and
overlapping repeats inside one count; repeated rows are copies; a null id takes part; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, raw_text
from .passages import shared_passages

LENGTH = 400
GRAM = 200
#: Most rows of a group before it is split, and rows indexed at once.
GROUP_ROWS = 4096
BATCH_ROWS = 8192
#: Window starts that one pass over a text takes at once.
PART = 1 << 17

_BITS = 18
_PLACE = np.uint64((1 << _BITS) - 1)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, PART + 4 * 1024)
_DOWN = _powers(pow(_BASE, -1, 2**64), PART + 4 * 1024)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, by running minima of blocks from both sides."""
    n = len(v)
    x = np.concatenate([v, np.full(-n % w, ~np.uint64(0))]).reshape(-1, w)
    before = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    after = np.minimum.accumulate(x, axis=1).ravel()
    return np.minimum(before[: n - w + 1], after[w - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, hashes of their bytes, and digests of the segments around them.

    Segments of one digest count as equal, so it is a cryptographic one: texts can be built that collide under the rolling hash.
    """
    a = np.frombuffer(raw, dtype=np.uint8)
    n, found = len(a), []
    for at in range(0, n - length + 1, PART):
        low = max(0, at - length)
        part = a[low : at + PART + 2 * length]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[part] * _UP[: len(part)], out=total[1:])
        starts = slice(at - low, min(at + PART + length - 1, n) - gram + 1 - low)
        first = np.arange(len(part) + 1)[starts]
        h = _mix((total[first + gram] - total[first]) * _DOWN[first])
        least = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        place = np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])] & _PLACE).astype(np.int64)
        p = place + at - low  # in the part
        x, y = np.maximum(p + low - (length - gram), 0) - low, np.minimum(p + low + length, n) - low
        body, before = part.tobytes(), (p - x).tolist()
        digest = [hashlib.blake2b(body[s:e], digest_size=8, salt=b"%d" % b).digest() for s, e, b in zip(x.tolist(), y.tolist(), before)]
        found.append((p + low, h[place], np.frombuffer(b"".join(digest), dtype=np.uint64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    places = np.concatenate([f[0] for f in found])
    places, first = np.unique(places, return_index=True)
    return places, np.concatenate([f[1] for f in found])[first], np.concatenate([f[2] for f in found])[first]


def _anchors(batches):
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("doc", "version", "place", "key", "digest")}
        for doc, version, raw in zip(b["doc"], b["version"], b["raw"]):
            if len(raw) < LENGTH:
                continue
            place, key, digest = anchors(raw)
            out["doc"].append(doc)
            out["version"].append(version)
            out["place"].append(place.astype(np.int32))
            out["key"].append(key.view(np.int64))
            out["digest"].append(digest.view(np.int64))
        yield out


class Index:
    """A positional Burrows-Wheeler transform of aligned rows in groups, column by column, as runs.

    ``order`` has the rows sorted by group and by what precedes the column, last byte first; ``match``
    has how many bytes before the column each row shares with the row before it in that order.
    """

    NONE = 256

    def __init__(self, group: np.ndarray):
        self.group = group  # by place in the order: groups stay where they are
        self.order = np.arange(len(group))
        self.match = np.zeros(len(group) + 2, dtype=np.int32)

    def step(self, column: np.ndarray) -> None:
        """Take in a column's bytes, given by row; rows that have none there agree with no row."""
        rows = len(self.order)
        symbol = column[self.order].astype(np.int64)
        key = self.group * 512 + symbol
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.append(head[1:], rows)
        run = key[head]
        moved = np.argsort(run, kind="stable")
        size = (end - head)[moved]
        start = np.cumsum(size) - size
        take = np.repeat(head[moved] - start, size) + np.arange(rows)
        match = self.match[take] + 1
        match[start] = 0
        # A run that follows one of its own symbol agrees as far as all rows between them did.
        again = np.flatnonzero(run[moved][1:] == run[moved][:-1])
        if len(again):
            low, high = end[moved[again]], head[moved[again + 1]] + 1
            by = np.argsort(-low, kind="stable")
            pairs = np.column_stack([low[by], high[by]]).ravel()
            match[start[again[by] + 1]] = np.minimum.reduceat(self.match, pairs)[::2] + 1
        match[symbol[take] == self.NONE] = 0
        self.order = self.order[take]
        self.match[:rows] = match
        self.match[rows:] = 0

    def same(self, columns: int) -> None:
        """Columns in which all rows of a group agree."""
        inside = np.concatenate([[False], self.group[1:] == self.group[:-1]])
        self.match[: len(inside)][inside] += columns

    def statistics(self) -> np.ndarray:
        """By row, the longest match before the column with any other row."""
        out = np.empty(len(self.order), dtype=np.int32)
        out[self.order] = np.maximum(self.match[: len(out)], self.match[1 : len(out) + 1])
        return out


def repeated_windows(segments: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """[row, c]: whether the window that begins length - gram - c bytes before the anchor stands in another row of its group.

    Segments are (group, bytes before the anchor, segment), sorted by group.
    """
    side = length - gram
    rows = np.full((len(segments), 2 * side), Index.NONE, dtype=np.uint16)
    for k, (_, left, body) in enumerate(segments):
        a = np.frombuffer(body, dtype=np.uint8)
        rows[k, side - left : side] = a[:left]
        after = a[left + gram :]
        rows[k, side : side + len(after)] = after
    columns = np.ascontiguousarray(rows.T)
    _, group = np.unique(np.array([s[0] for s in segments], dtype=np.int64), return_inverse=True)
    index = Index(group.astype(np.int64))
    for c in range(side):
        index.step(columns[c])
    index.same(gram)
    out = np.empty((side + 1, len(segments)), dtype=bool)
    out[0] = index.statistics() >= length
    for c in range(side):
        index.step(columns[side + c])
        out[c + 1] = index.statistics() >= length
    return out.T


def _spans(marks: np.ndarray, side: int, length: int) -> list[dict]:
    """Runs of marked windows as [start, end) from the anchor."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return [{"s": int(a) - side, "e": int(b) - 1 - side + length} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _indexed(batches):
    """Rows come sorted by group; whole groups are indexed together, some at a time."""
    side = LENGTH - GRAM

    def flush(held):
        out: dict[str, list] = {"key": [], "digest": [], "spans": []}
        if held:
            for (_, key, digest, *_), marks in zip(held, repeated_windows([(r[0], r[3], r[4]) for r in held])):
                if marks.any():
                    out["key"].append(key)
                    out["digest"].append(digest)
                    out["spans"].append(_spans(marks, side, LENGTH))
        return out

    held: list = []
    for b in batches:
        for r in zip(b["grp"], b["key"], b["digest"], b["left"], b["body"]):
            if len(held) >= BATCH_ROWS and r[0] != held[-1][0]:
                yield flush(held)
                held = []
            held.append(r)
    yield flush(held)


def _bodies(batches):
    side = LENGTH - GRAM
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("key", "digest", "left", "body")}
        for raw, wanted in zip(b["raw"], b["wanted"]):
            for w in wanted:
                p = w["place"]
                left = min(p, side)
                out["key"].append(w["key"])
                out["digest"].append(w["digest"])
                out["left"].append(left)
                out["body"].append(raw[p - left : p + LENGTH])
        yield out


def _split(bodies: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Groups of at most GROUP_ROWS rows (grp, key, digest, left, body), and spans (key, digest, spans) found on the way.

    Rows that agree in all bytes of a range's windows are repeated there; just one of them goes on, so a
    passage that very many texts share soon is one row, in each range that lies inside it.
    """
    side = LENGTH - GRAM
    rows = bodies.select(F.col("key").alias("grp"), "key", "digest", "left", "body", F.lit(0).alias("x0"), F.lit(side).alias("x1"))
    ready, spans, level = [], [], 0
    while True:
        hot = rows.groupBy("grp").agg(F.count("*").alias("__n")).filter(F.col("__n") > GROUP_ROWS).select("grp")
        if not hot.limit(1).count():
            ready.append(rows)
            break
        ready.append(rows.join(hot, "grp", "left_anti"))
        level += 1
        middle = F.floor((F.col("x0") + F.col("x1")) / 2).cast("int")
        halves = F.filter(F.array(F.struct(F.col("x0"), middle.alias("x1")), F.struct((middle + 1).alias("x0"), F.col("x1"))), lambda h: h["x0"] <= h["x1"])
        rest = rows.join(hot, "grp", "left_semi").select("grp", "key", "digest", "left", "body", F.inline(halves))
        left, x0, x1 = F.col("left"), F.col("x0"), F.col("x1")
        rest = rest.filter((left >= x0) & (F.octet_length("body") - left >= LENGTH - x1))
        core = F.substring("body", left - x0 + 1, LENGTH - x1 + x0)
        first = F.greatest(left - x1, F.lit(0))
        whole = F.substring("body", first + 1, left + LENGTH - x0 - first)
        rest = rest.select(F.xxhash64("grp", "x0", "x1", core).alias("grp"), "key", "digest", "left", "body", "x0", "x1", F.xxhash64(left - first, whole).alias("whole"))
        rest = scratch.table(rest, f"split-{level}")
        alike = rest.groupBy("grp", "whole").agg(F.count("*").alias("__n"), F.min(F.struct("key", "digest")).alias("__one")).filter("__n > 1").select("grp", "whole", "__one")
        alike = scratch.table(alike, f"alike-{level}")
        span = F.array(F.struct((-F.col("x1")).alias("s"), (LENGTH - F.col("x0")).alias("e")))
        found = rest.select("grp", "whole", "key", "digest", "left", "x0", "x1", F.octet_length("body").alias("size")).join(alike, ["grp", "whole"])
        inside = F.transform(span, lambda x: F.struct(F.greatest(x["s"], -F.col("left")).alias("s"), F.least(x["e"], F.col("size") - F.col("left")).alias("e")))
        spans.append(found.select("key", "digest", inside.alias("spans")))
        rows = rest.join(alike, ["grp", "whole"], "left").filter(F.col("__one").isNull() | (F.struct("key", "digest") == F.col("__one")))
        rows = scratch.table(rows.select("grp", "key", "digest", "left", "body", "x0", "x1"), f"rows-{level}")
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out.select("grp", "key", "digest", "left", "body"), spans


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union, inside [0, n)."""
    out: list[list[int]] = []
    for s, e in sorted((max(s, 0), min(e, n)) for s, e in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_spans(source: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, version, spans): byte spans, unmerged, of every row of (doc, version, raw) that holds repeats of LENGTH bytes."""
    spark = source.sparkSession
    kind = dict(source.dtypes)["doc"]
    found = scratch.table(map_arrow(source, _anchors, f"doc {kind}, version long, place array<int>, key array<long>, digest array<long>"), "anchors")
    each = found.select("doc", "version", F.inline(F.arrays_zip("place", "key", "digest")))
    keys = each.groupBy("key").agg(F.count("*").alias("__n"), F.min("digest").alias("__a"), F.max("digest").alias("__b")).filter("__n > 1").select("key", (F.col("__a") != F.col("__b")).alias("differ"))
    members = scratch.table(each.join(keys, "key"), "members")
    scratch.drop("anchors")
    equal = members.filter("differ").groupBy("key", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "version", "place")).alias("at"))
    equal = scratch.table(equal, "segments")
    wanted = equal.groupBy(F.col("at.doc").alias("__doc"), F.col("at.version").alias("__version")).agg(F.collect_list(F.struct("key", "digest", F.col("at.place").alias("place"))).alias("wanted"))
    # Sorted and merged at every size, as the plan for a corpus would be.
    texts = source.join(wanted.hint("merge"), (F.col("version") == F.col("__version")) & F.col("doc").eqNullSafe(F.col("__doc"))).dropDuplicates(["version", "__doc"])
    bodies = scratch.table(map_arrow(texts.select("raw", "wanted"), _bodies, "key long, digest long, left int, body binary"), "bodies")
    rows, spans = _split(bodies, scratch)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp").sortWithinPartitions("grp", "digest")
    marked = scratch.table(map_arrow(dealt, _indexed, "key long, digest long, spans array<struct<s:int,e:int>>"), "marked")
    for s in spans:
        marked = marked.unionByName(s)
    # One row a segment: a segment with copies is repeated as a whole, others gather their groups' spans.
    copied = equal.filter("copies > 1").select("key", "digest")
    marked = marked.join(copied, ["key", "digest"], "left_anti").groupBy("key", "digest").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    whole = F.array(F.struct(F.lit(GRAM - LENGTH).alias("s"), F.lit(LENGTH).alias("e")))
    marked = marked.unionByName(copied.withColumn("spans", whole))
    in_group = members.filter("differ").select("doc", "version", "place", "key", "digest").join(marked, ["key", "digest"]).select("doc", "version", "place", "spans")
    alike = members.filter("not differ").select("doc", "version", "place", whole.alias("spans"))
    moved = F.transform("spans", lambda x: F.struct((x["s"] + F.col("place")).alias("s"), (x["e"] + F.col("place")).alias("e")))
    out = in_group.unionByName(alike).select("doc", "version", moved.alias("spans"))
    out = scratch.table(out.groupBy("doc", "version").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    scratch.keep("spans", "word-passages")
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("version"), raw_text(text_col).alias("raw"))


def _removed(batches):
    for b in batches:
        out: dict[str, list] = {"doc_id": b["doc"]} | {k: b[k] for k in ("n_passages", "n_passage_words")} | {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for raw, spans in zip(b["raw"], b["spans"]):
            runs = merged([(s["s"], s["e"]) for s in spans or ()], len(raw))
            kept, at = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(e - s for s, e in runs))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(kept.hexdigest())
            out["spans"].append([{"s": s, "e": e} for s, e in runs])
        yield out


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_passages, n_passage_words) of every document; spans are
    the maximal removed runs. Passages are shared runs of more than 50 words: words may be short, so such a run may have
    less than LENGTH bytes; it is counted, and nothing of it is removed for that."""
    source = _source(docs, id_col, text_col)
    kind = dict(source.dtypes)["doc"]
    scratch = Scratch(docs.sparkSession, "repeats")
    passages = shared_passages(source, scratch)
    spans = repeated_spans(source, scratch)
    same = F.col("doc").eqNullSafe(F.col("p_doc")) & (F.col("version") == F.col("p_version"))
    marks = spans.join(passages.withColumnsRenamed({"doc": "p_doc", "version": "p_version"}), same, "full").select(
        F.when(F.col("version").isNull(), F.col("p_doc")).otherwise(F.col("doc")).alias("__doc"), F.coalesce("version", "p_version").alias("__version"), "spans", "n_passages", "n_passage_words"
    )
    joined = source.join(marks.hint("merge"), (F.col("version") == F.col("__version")) & F.col("doc").eqNullSafe(F.col("__doc")), "left")
    zero = F.lit(0).cast("long")
    rows = joined.select("doc", "raw", "spans", F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("n_passage_words", zero).alias("n_passage_words"))
    return map_arrow(rows, _removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>, n_passages long, n_passage_words long")
