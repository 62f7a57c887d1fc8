"""Passages of many words, against brute force."""

import random

import numpy as np

from batchloom.llm import passages, queries, repeats

from ..conftest import SF
from . import brute
from .test_queries import documents
from .test_text_operators import EDGE, docs, words


def found(rows):
    return [(r["doc_id"], r["n_passages"], r["n_passage_words"]) for r in rows]


def test_passages(spark, monkeypatch):
    monkeypatch.setattr(passages, "PART_BYTES", 20_000)
    rng = random.Random(5)
    shared = [words(rng, n) for n in (50, 51, 52, 60, 150)]
    rows = list(EDGE)
    for k in range(60):
        parts = [words(rng, rng.randrange(80)) for _ in range(3)]
        if k % 3 == 0:
            parts[1:1] = [shared[k % 5], "\n", shared[(k // 3) % 5]]
        rows.append((100 + k, " ".join(parts)))
    base = rows[-1][1].split()
    for k in range(8):  # near copies, and copies
        near = list(base)
        if k % 2:
            near[rng.randrange(len(near))] = "else"
        rows.append((300 + k, "  ".join(near)))
    one = words(rng, 70)
    rows.append((400, one + " " + one))  # twice in one text only
    rows += [(401, "to " * 200), (402, "to " * 60 + "be")]
    got = repeats.find_repeats(docs(spark, rows)).collect()
    want = brute.passages([t for _, t in rows], passages.WORDS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found(got), key=key) == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=key)
    assert sum(1 for w in want if w[0]) > 20
    assert dict((d, n) for d, n, _ in found(got))[400] == 0


def test_whole_table(spark):
    rows = documents(spark)
    got = found(queries.op5_repeats(spark, SF).collect())
    assert sorted(got) == sorted((d, *w) for (d, _), w in zip(rows, brute.passages([t for _, t in rows], 51)))


def test_run_hashes():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, 300).astype(np.uint64)
    for n in (1, 2, 3, 26, 51, 64, 300, 301):
        h = passages.run_hashes(w, n)
        assert len(h) == max(0, 300 - n + 1)
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(x, w[i : i + n].tobytes()) == w[i : i + n].tobytes()
        assert len(seen) == len({w[i : i + n].tobytes() for i in range(len(h))})
