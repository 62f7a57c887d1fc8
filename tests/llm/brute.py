"""Brute-force versions, straight from the contracts."""

from __future__ import annotations

import hashlib
import re
import zlib


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def links(texts, n, percent):
    """Rows' sets, linked pairs and component roots (row numbers)."""
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                pairs.append((j, i))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, pairs, [find(i) for i in range(len(texts))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, n=10):
    w = bench_words(text)
    hit, found = set(), set()
    for item, t in items:
        if item is None:
            continue
        q = bench_words(t)
        size = min(n, len(q))
        wins = {tuple(q[i : i + size]) for i in range(len(q) - size + 1)} if q else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def repeats(texts, length):
    """(removed bytes, runs, digest of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for p in range(len(r) - length + 1):
            seen[r[p : p + length]] = seen.get(r[p : p + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def repeat_words(words, size=5):
    wins = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len({k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(i, i + size)})


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def kept_lines(rows, least):
    """rows of (doc_id, text): texts without lines that an earlier line equals or nearly equals."""
    all_lines = sorted((d, n, line) for d, t in rows if t is not None for n, line in enumerate(t.split("\n")) if len(line) >= least)
    gone = set()
    for k, (d, n, line) in enumerate(all_lines):
        if any(abs(len(x) - len(line)) <= 1 and edits(x, line) <= 1 for *_, x in all_lines[:k]):
            gone.add((d, n))
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def passages(texts, size):
    """(passages, words in them) of each text: runs of words covered by windows that another text, or a copy, holds too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = {}
    for k, w in enumerate(split):
        for i in range(len(w) - size + 1):
            holders.setdefault(tuple(w[i : i + size]), set()).add(k)
    out = []
    for k, w in enumerate(split):
        hit = bytearray(len(w))
        for i in range(len(w) - size + 1):
            if len(holders[tuple(w[i : i + size])]) > 1:
                hit[i : i + size] = b"\1" * size
        out.append((sum(1 for i, h in enumerate(hit) if h and (not i or not hit[i - 1])), sum(hit)))
    return out
