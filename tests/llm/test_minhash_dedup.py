"""MinHash near-dedup against all pairs: copies, chains of edits, border similarities, blocks, and odd rows."""

import random

import numpy as np
import pytest

from batchloom.llm import minhash_dedup

from . import brute


def texts(seed):
    """Groups that meet at every similarity near the bound, chains whose ends don't link, and words that all share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = [None, "", "  ", "one", "One", "two words", "x y z " * 3000]
    for _ in range(4):
        base = [word() for _ in range(60)]
        out += [" ".join(base)] * 3
        for edits in range(1, 16):
            t = list(base)
            for k in r.sample(range(60), edits):
                t[k] = word()
            out.append(" ".join(t))
        step = list(base)
        for _ in range(12):  # each links with the one before
            for k in r.sample(range(60), 2):
                step[k] = word()
            out.append(" ".join(step))
    return out + [" ".join(word() for _ in range(40)) + " shared passage of some words" for _ in range(30)]


@pytest.mark.parametrize("block", [4, 1200])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", block)
    rows = texts(block)
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in enumerate(rows)], "doc_id long, text string, cid string, version int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_copies(df, 2, 80).collect()}
    sets, pairs, roots = brute.links(rows, 2, 80)
    assert got == {k: (len(s), r, k == r) for k, (s, r) in enumerate(zip(sets, roots))}
    assert len(set(roots)) < len(rows) - 40 and any(roots[i] == roots[j] and (i, j) not in set(pairs) for j in range(len(rows)) for i in range(j))


def test_odd_rows(spark):
    rows = [(None, "same old words"), (5, "same old words"), (5, "same old words"), (5, "quite another text"), (None, "alone in here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_copies(df, 2, 80).collect())))
    assert got == sorted(map(str, [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (5, 2, 5, True), (None, 2, None, True), (None, 0, None, True)]))
    assert minhash_dedup.near_copies(df.limit(0), 2, 80).collect() == []
    with pytest.raises(ValueError):
        minhash_dedup.near_copies(df, 2, 70)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(5)
    for share in (0.3, 0.8, 0.95):
        both = r.integers(0, 1 << 63, int(3000 * share), dtype=np.uint64)
        rest = lambda: r.integers(0, 1 << 63, (3000 - len(both)) // 2, dtype=np.uint64)
        a, b = minhash_dedup.signature(np.concatenate([both, rest()])), minhash_dedup.signature(np.concatenate([both, rest()]))
        assert abs((a == b).mean() - share) < 0.13


def test_a_product_needs_rows_on_both_sides():
    grams = np.arange(9, dtype=np.uint64)
    row = lambda side, root: (1, side, root, minhash_dedup.signature(grams).tobytes(), grams.tobytes())
    assert minhash_dedup._product([row(0, 1), row(0, 2)], 80) == []
    assert minhash_dedup._product([row(0, 1), row(1, 2), row(1, 2)], 80) == [(1, 2)]
    assert minhash_dedup._product([row(-1, 1), row(-1, 2), row(-1, 3)], 80) == [(1, 2), (1, 3)]
