"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``; only longer documents are cut, the first piece
takes the remainder. Pieces of one length are interchangeable, so the plan needs only how many pieces
each length has: at most ``capacity`` numbers, whatever the corpus. Per bin, a bitset dynamic program
over the available lengths finds the fullest combination that holds the longest one; it is removed as
often as the counts allow. Pieces then find their place by their rank within their length.

Ranks are counted within (length, bucket) and shifted by the counts of the buckets before, so that a
length that a third of all pieces share is not ranked in one task.

Defined cases: null text is empty and gives one piece with only the end id; repeated rows are packed
each; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow, materialise

#: Pieces of a bucket, about: what a task sorts to rank them.
BUCKET_ROWS = 20_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    return ([(0, rest)] if rest else []) + [(i, capacity) for i in range(rest, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    def rows(batches):
        encoder = bpe.load(bpe.Ids, path)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(b["doc_id"], b["text"]):
                body = array("I", encoder.ids(text or ""))
                body.append(end_id)
                raw = body.tobytes()
                for k, (start, size) in enumerate(cut(len(body), capacity)):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * start : 4 * (start + size)]))
            yield out

    return rows


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, _pieces(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The subset of the available lengths with the largest sum of at most ``room``: {length: times}."""
    reach, steps, full = 1, [], 1 << room
    keep = (1 << (room + 1)) - 1
    for size in sorted((s for s, c in counts.items() if c and s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left:
            take = min(take, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & keep
            left -= take
            take *= 2
            if reach & full:
                break
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[size] = chosen.get(size, 0) + take
            at -= size * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(bins, {length: pieces in each})]: minimum bin slack, each pattern as often as the counts allow."""
    left = {s: c for s, c in counts.items() if c}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = fullest(left, capacity - seed)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[s] // k for s, k in chosen.items())
        for s, k in chosen.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
        out.append((times, chosen))
    return out


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """By length: first rank of each pattern that uses it, and (pieces in a bin, first sequence, offset)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, chosen in bins:
        offset = 0
        for size in sorted(chosen, reverse=True):
            ranks, where = out.setdefault(size, ([], []))
            ranks.append(used.get(size, 0))
            where.append((chosen[size], sequence, offset))
            used[size] = used.get(size, 0) + times * chosen[size]
            offset += size * chosen[size]
        sequence += times
    return out


def _place(shared):
    def rows(batches):
        table = shared.value
        for b in batches:
            out = {k: b[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": [], "offset": []}
            for size, rank in zip(b["length"], b["rank"]):
                ranks, where = table[size]
                k = bisect_right(ranks, rank) - 1
                each, sequence, offset = where[k]
                bin_, slot = divmod(rank - ranks[k], each)
                out["sequence_id"].append(sequence + bin_)
                out["offset"].append(offset + slot * size)
            yield out

    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        F.col("length").alias("at_length"), F.col("bucket").alias("at_bucket"), (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    )
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(before, (F.col("length") == F.col("at_length")) & (F.col("bucket") == F.col("at_bucket")))
    source = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    kind = dict(pieces.dtypes)["doc_id"]
    return map_arrow(source, _place(shared), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
