"""Benchmark decontamination with one Aho-Corasick automaton over normalised words.

Text is cut into words (runs of 0-9, a-z after lower-casing A-Z, and everything beyond ASCII). A window
is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. The words of all
items are numbered, all windows go into one automaton over the numbers' digits, and a text, numbered the same
way, is scanned once; the hit words are mapped back to code point offsets of the original.

The items' words go to the workers, once, and each builds the automaton from them: it is as large as the
benchmark asks, whatever the documents. A benchmark of more than ``BENCHMARK_BYTES`` of normalised text is an error, not cut.

Defined cases: null or wordless texts have no words and no hits; items without words or with a null id
are no items; repeated items count once per id, and windows that several items share count for each; long texts
are scanned whole; repeated documents each give a row; other columns, whatever their names, are kept by ``clean`` and
not read otherwise; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw_text

#: Most bytes of the items' normalised text: a worker needs some 200 times as much for the automaton.
BENCHMARK_BYTES = 8_000_000
#: Digits of word numbers have so many values, so that no node has many branches.
BASE = 128

#: Lower-cases A-Z, keeps 0-9, a-z and bytes of other scripts, and turns the rest into blanks.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_automata: dict[str, object] = {}

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


def item_words(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words) of every item that has words: its normalised text."""

    def rows(batches):
        for b in batches:
            found = [(item, b" ".join(w)) for item, raw in zip(b["item"], b["raw"]) if (w := words_of(raw))]
            yield {"item": [x[0] for x in found], "words": [x[1] for x in found]}

    source = benchmark.select(F.col(item_col).cast("string").alias("item"), raw_text(text_col).alias("raw")).filter("item is not null")
    return map_arrow(source, rows, "item string, words binary").distinct()


class Automaton:
    """All windows of the items, over their words' numbers; each number has ``width`` digits, and 0 is any other word."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        import ahocorasick

        words = sorted({w for _, text in items for w in text.split()})
        self.width = 1
        while BASE**self.width <= len(words):
            self.width += 1
        self.codes = {w: "".join(chr(1 + k // BASE**d % BASE) for d in range(self.width)) for k, w in enumerate(words)}
        self.other = "\0" * self.width
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        self.tree = ahocorasick.Automaton()
        for item, text in items:
            w = text.split()
            numbers = "".join([self.codes[x] for x in w])
            size = min(n, len(w))
            for i in range(len(w) - size + 1):
                window = numbers[i * self.width : (i + size) * self.width]
                known = self.tree.get(window, None)
                if known is None:
                    self.tree.add_word(window, (size, [number[item]]))
                elif number[item] not in known[1]:
                    known[1].append(number[item])
        if len(self.tree):
            self.tree.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """Which words are hit (None: none), and the items that occur."""
        mask, found = None, set()
        if words and len(self.tree):
            get, other, width = self.codes.get, self.other, self.width
            for end, (size, own) in self.tree.iter("".join([get(w, other) for w in words])):
                if (end + 1) % width:  # digits of two numbers
                    continue
                if mask is None:
                    mask = bytearray(len(words))
                last = (end + 1) // width
                mask[last - size : last] = b"\1" * size
                found.update(own)
        return mask, {self.names[k] for k in found}


def _automaton(shared: tuple[str, int, list[tuple[str, bytes]]]) -> Automaton:
    """One a worker: ``shared`` has its key, the window's words, and the items."""
    key, n, items = shared
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(items, n)
    return _automata[key]


def _spans(raw: bytes, mask: bytearray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as code point offsets [start, end) of the original."""
    out: list[tuple[int, int]] = []
    chars = last = 0
    open_at = None
    end = 0
    for k, m in enumerate(_WORD.finditer(raw)):
        if not mask[k]:
            if open_at is not None:
                out.append((open_at, end))
                open_at = None
            continue
        chars += len(raw[last : m.start()].decode("utf-8", "replace"))
        start = chars
        chars += len(m.group().decode("utf-8", "replace"))
        last, end = m.end(), chars
        if open_at is None:
            open_at = start
    if open_at is not None:
        out.append((open_at, end))
    return out


def _scan(shared):
    def rows(batches):
        automaton = None
        for b in batches:
            automaton = automaton or _automaton(shared.value)
            out: dict[str, list] = {"doc_id": b["doc_id"], "n_words": [], "n_hit": [], "items": [], "spans": []}
            for raw in b["raw"]:
                words = words_of(raw)
                mask, items = automaton.hits(words)
                out["n_words"].append(len(words))
                out["n_hit"].append(sum(mask) if mask else 0)
                out["items"].append(sorted(items))
                out["spans"].append([{"start": x, "end": y} for x, y in _spans(raw, mask)] if mask else [])
            yield out

    return rows


def _shared(benchmark: DataFrame, n: int, most_bytes: int):
    """The items as a broadcast, after a check of their size."""
    found = item_words(benchmark).persist()
    try:
        size = found.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        if size > most_bytes:
            raise ValueError(f"the benchmark has {size} bytes of normalised text; the automaton is for {most_bytes}")
        items = sorted((r["item"], bytes(r["words"])) for r in found.collect())
    finally:
        found.unpersist()
    return benchmark.sparkSession.sparkContext.broadcast((hashlib.sha256(repr((n, items)).encode()).hexdigest(), n, items))


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document; spans are offsets in the original text."""
    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), raw_text(text_col).alias("raw")), _scan(_shared(benchmark, n, most_bytes)), f"doc_id {kind}, {HITS}")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", most_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows without any benchmark window."""
    shared = _shared(benchmark, n, most_bytes)

    @F.pandas_udf("boolean")
    def hit(raws: pd.Series) -> pd.Series:
        automaton = _automaton(shared.value)
        return pd.Series([automaton.hits(words_of(raw))[0] is not None for raw in raws], dtype="bool")

    return docs.filter(~hit(raw_text(text_col)))
