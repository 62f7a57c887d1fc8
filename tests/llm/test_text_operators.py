import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from batchloom.llm import bpe, chat_format, decontaminate, line_dedup, ngram_join, packing, quality_rules, repeats, token_counts

from . import brute

DOC = "doc_id long, text string"


def clashing(df):
    """Columns that operators might use themselves."""
    names = ("doc", "version", "raw", "n", "key", "line", "no", "digest", "content", "length", "bucket", "score", "__row", "n_words")
    return df.select("*", *[F.lit(7).alias(c) for c in names])


def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, DOC))


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Ünïcode ✓   x"), (5, "Ünïcode ✓   x"), (None, "one"), (7, "word " * 30_000)]


# ---- token counts


def test_token_counts(spark, tmp_path):
    rows = EDGE + [(8, "a<|endoftext|>b"), (9, "one")]
    cache = f"file://{tmp_path}/cache"
    got = token_counts.count_tokens(docs(spark, rows), bpe.default_path(), cache, limit=1024).collect()
    want = sorted(((d, len((t or "").encode()), n) for (d, t), n in zip(rows, bpe.Counter(bpe.default_path()).counts([t or "" for _, t in rows]))), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    # Every distinct text is encoded once; a second run finds all of them.
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in rows})
    token_counts.count_tokens(docs(spark, rows), bpe.default_path(), cache).collect()
    assert spark.read.parquet(cache).count() == stored


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = bpe.default_path(name)
    got = token_counts.count_tokens(docs(spark, [(1, "Hello there, wörld"), (2, None)]), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: bpe.Counter(path).counts(["Hello there, wörld"])[0], 2: 0}


def test_ids_are_the_librarys(spark):
    both = bpe.Ids(bpe.default_path())
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "é", "中", "'s", "7", "!?", " ", "🙂", "<|endoftext|>"]) for _ in range(rng.randrange(40)))
        assert both.ids(text) == both.own.encode(text, add_special_tokens=False).ids


# ---- n-gram join


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    rng = random.Random(n)
    rows = list(EDGE[:-1])
    for g in range(12):
        base = words(rng, rng.choice([4, 12, 25, 80, 200])).split()
        for k in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 20])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(3)]
            rows.append((100 + 10 * g + k, " ".join(w).upper() if k == 5 else " ".join(w)))
    rng.shuffle(rows)
    got = ngram_join.join(docs(spark, rows), n, percent).collect()
    sets, pairs, roots = brute.links([t for _, t in rows], n, percent)
    members, linked = defaultdict(list), defaultdict(int)
    for k, r in enumerate(roots):
        members[r].append(rows[k][0])
    for i, j in pairs:
        linked[i] += 1
        linked[j] += 1
    ids = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    want = sorted(((d, len(sets[k]), ids[roots[k]] if sets[k] else d, linked[k]) for k, (d, _) in enumerate(rows)), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == want


def test_ngram_join_splits_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    rng = random.Random(3)
    base = words(rng, 120, 5000).split()
    rows = []
    for k in range(60):
        w = list(base[: 120 - rng.randrange(12)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.join(docs(spark, rows), 3, 90).collect()}
    _, pairs, roots = brute.links([t for _, t in rows], 3, 90)
    assert got == {k: (roots[k], sum(k in p for p in pairs)) for k in range(60)}


def test_ngram_join_counts_once_where_a_block_is_empty(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 100)
    rng = random.Random(4)
    rows = []
    for k in range(24):  # pairs of near copies, each in two row blocks; in about half of them one block stays empty
        w = words(rng, 120, 100_000).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-1]))]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.join(docs(spark, rows), 3, 90).collect()}
    assert got == {d: (d - d % 2, 1) for d, _ in rows}


@pytest.fixture
def tables(monkeypatch):
    """Tables that an operator writes, by name: their plans, and their rows if asked for."""
    from batchloom.llm.common import Scratch

    write, seen = Scratch.table, {}

    def table(self, df, name):
        out = write(self, df, name)
        seen[name] = (df._jdf.queryExecution().executedPlan().toString(), out.columns, [tuple(r) for r in out.collect()] if name in ("clustered", "row-blocks") else None)
        return out

    monkeypatch.setattr(Scratch, "table", table)
    return seen


def test_ngram_join_sends_no_table_through_the_driver(spark, tables):
    rng = random.Random(6)
    rows = [(k, words(rng, 40, 30)) for k in range(40)] + [(100 + k, "one two three four five six seven eight nine ten " + "x" * k) for k in range(4)]
    ngram_join.keep_one(docs(spark, rows), 3, 80).count()
    assert len(tables) > 10 and not [name for name, (plan, _, _) in tables.items() if "Broadcast" in plan]


def test_ngram_join_clusters_by_size(spark, tables):
    """A rare shingle that texts of all sizes hold connects those alone that may be linked."""
    rng = random.Random(7)
    common = next(w for w in (words(rng, 3, 1 << 30) for _ in range(10_000)) if ngram_join.gram_set(w.encode(), 3)[0] < 1 << 55)
    rows = [(k, " ".join([common, words(rng, k, 1 << 30)]) if k else common) for k in range(20)] + [(50, common + " y"), (51, common + " z y")]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.join(docs(spark, rows), 3, 90).collect()}
    _, pairs, roots = brute.links([t for _, t in rows], 3, 90)
    assert got == {d: (rows[roots[k]][0], sum(k in p for p in pairs)) for k, (d, _) in enumerate(rows)}
    sizes = Counter(root for _, root in tables["clustered"][2])
    assert max(sizes.values()) <= 5  # 22 texts hold it


@pytest.mark.parametrize("copies", [1, 100])
def test_ngram_join_in_rounds(spark, tables, monkeypatch, copies):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    monkeypatch.setattr(ngram_join, "ROUND_COPIES", copies)
    rng = random.Random(8)
    base = words(rng, 90, 5000).split()
    rows = []
    for k in range(40):  # sizes of two classes
        w = list(base[: 90 - rng.randrange(16)])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.join(docs(spark, rows), 3, 90).collect()}
    _, pairs, roots = brute.links([t for _, t in rows], 3, 90)
    assert got == {k: (roots[k], sum(k in p for p in pairs)) for k in range(40)} and pairs
    rounds = [name for name in tables if name.startswith("products-")]
    assert len(rounds) == (1 if copies == 100 else -(-len(tables["row-blocks"][2]) // 40)) and not [name for name in ("sketch", "rows") if "first" in tables[name][1]]


def test_first_columns_hold_the_common_ones():
    rng = random.Random(11)
    for percent in (50, 80, 90):
        s = ngram_join.Sizes(percent)
        for _ in range(4000):
            base = rng.sample(range(200), rng.randrange(1, 60))
            a, b = set(base), set(base)
            for x in (a, b):
                for _ in range(rng.randrange(6)):
                    x.discard(rng.choice(base)) if rng.random() < 0.5 else x.add(rng.randrange(200))
            if not a or not b or a == b or 100 * len(a & b) < percent * len(a | b):
                continue
            first = [set(sorted(x)[: s.first_columns(len(x))]) for x in (a, b)]
            common = first[0] & first[1]
            assert len(common) >= max(s.needed(len(a)), s.needed(len(b))) >= 1
            assert len(b) <= s.largest_partner(len(a)) and len(a) <= s.largest_partner(len(b))


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (9, "p q r s t u v"), (4, None), (4, None), (6, ""), (None, "a b c d e f g h"), (None, "z z z z z z")]
    out = ngram_join.keep_one(docs(spark, rows), 5, 80)
    assert out.columns == docs(spark, rows).columns
    more = {"__one": F.lit(1), "__doc": F.lit("d"), "__version": F.lit(2.5), "others": F.lit(3)}
    again = ngram_join.keep_one(docs(spark, rows).withColumns(more), 5, 80).collect()
    assert len(again) == out.count() and {(r["__row"], r["__one"], r["__doc"], r["__version"], r["others"], r["key"]) for r in again} == {(7, 1, "d", 2.5, 3, 7)}
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(3, "a b c d e f g h"), (9, "p q r s t u v"), (4, None), (4, None), (6, ""), (None, "z z z z z z")], key=str)


# ---- benchmark decontamination


@pytest.mark.parametrize("base", [128, 2, 5])
def test_decontamination(spark, monkeypatch, base):
    monkeypatch.setattr(decontaminate, "BASE", base)  # numbers of one digit, and of several
    rng = random.Random(5)
    items = [(k, words(rng, rng.choice([3, 9, 10, 11, 30]), 60)) for k in range(12)] + [(12, None), (13, "!!"), (None, "w1 w2"), (3, "extra item text"), (14, "É1 ü")]
    rows = list(EDGE)
    for k in range(40):
        w = words(rng, rng.randrange(40), 60).split()
        if k % 2:
            q = rng.choice(items[:12])[1].split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = q[rng.randrange(3) :]
        rows.append((100 + k, rng.choice([" ", "-", "\n", " , "]).join(w).title()))
    rows.append((200, "w0! é1 É1 Ü é1 ü"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = decontaminate.scan_benchmark(docs(spark, rows), bench, 10).collect()
    want = sorted(((d, *brute.contamination(t, items)) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == want
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for r in got:
        if len(texts[r["doc_id"]]) == 1 and r["n_hit"]:
            spans = [texts[r["doc_id"]][0][s["start"] : s["end"]] for s in r["spans"]]
            assert sum(len(brute.bench_words(s)) for s in spans) == r["n_hit"]
            assert all(s == s.strip(" ,-\n!") for s in spans)


def test_clean(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = [(1, "x a b c y"), (2, "a b"), (2, "a b"), (3, None), (None, "A-B-C"), (None, "ok")]
    df = docs(spark, rows).withColumns({"__hit": F.lit(1), "hit": F.lit(2), "raw": F.lit(3)})
    out = decontaminate.clean(df, bench)
    assert out.columns == df.columns
    assert {(r["__hit"], r["hit"], r["raw"], r["__row"]) for r in out.collect()} == {(1, 2, 3, 7)}
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(2, "a b"), (2, "a b"), (3, None), (None, "ok")], key=str)
    with pytest.raises(ValueError, match="normalised"):
        decontaminate.clean(df, bench, most_bytes=4)


def test_long_text_and_many_windows():
    rng = random.Random(2)
    items = [(str(k), words(rng, 40, 100_000).encode()) for k in range(800)]
    a = decontaminate.Automaton(items, 10)
    assert a.width == 3 and len(a.tree) == len({tuple(t.split()[i : i + 10]) for _, t in items for i in range(31)})
    text = [b"x"] * 100_000 + items[7][1].split()[5:16] + [b"x"] * 100_000
    mask, found = a.hits(text)
    assert (sum(mask), found) == (11, {"7"}) and mask[100_000 : 100_011] == b"\1" * 11


# ---- long repeats


@pytest.mark.parametrize("rows_a_group", [4096, 3])
def test_repeats(spark, monkeypatch, rows_a_group):
    monkeypatch.setattr(repeats, "GROUP_ROWS", rows_a_group)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, long_one = noise(420), noise(900)
    rows = [(1, None), (2, ""), (3, "a" * 399), (4, "b" * 400), (5, "b" * 401), (6, noise(300)), (None, passage), (8, noise(50) + passage + noise(70)), (9, passage[5:] + noise(20)), (9, passage[5:] + noise(20))]
    rows += [(20 + k, noise(rng.randrange(200)) + long_one[: rng.randrange(300, 900)] + noise(rng.randrange(200))) for k in range(14)]
    rows += [(40 + k, long_one[:k] + "#" + long_one[k:]) for k in range(100, 800, 90)] + [(60, (noise(37) + "\n") * 60)]
    got = repeats.find_repeats(docs(spark, rows)).collect()
    want = brute.repeats([t for _, t in rows], 400)
    assert sorted(((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=str)


def test_index_matches():
    rng = random.Random(2)
    side = repeats.LENGTH - repeats.GRAM
    core = bytes(rng.randrange(97, 99) for _ in range(repeats.GRAM))
    segs = []
    for g in range(3):
        left, right = bytes(rng.randrange(97, 99) for _ in range(side)), bytes(rng.randrange(97, 99) for _ in range(side))
        for _ in range(12):
            a, b = bytearray(left), bytearray(right)
            for x in (a, b):
                for _ in range(rng.randrange(3)):
                    x[rng.randrange(side)] = 122
            a, b = bytes(a)[rng.randrange(side) :], bytes(b)[: rng.randrange(side)]
            if len(a) + len(b) + len(core) >= repeats.LENGTH:
                segs.append((g, len(a), a + core + b))
    got = repeats.repeated_windows(segs)
    for k, (g, left, body) in enumerate(segs):
        for c in range(side + 1):
            lo = left - side + c
            inside = lo >= 0 and lo + repeats.LENGTH <= len(body)
            w = body[lo : lo + repeats.LENGTH] if inside else None
            other = any(j != k and h == g and m - side + c >= 0 and b[m - side + c : m - side + c + repeats.LENGTH] == w for j, (h, m, b) in enumerate(segs)) if inside else False
            assert got[k, c] == other


# ---- quality rules


def test_statistics():
    rng = random.Random(4)
    texts = [None, "", "a b c", "x\nx\n\nx y\nx", "a b c d e a b c d e", "#* $%&|<> é b", words(rng, 300, 6), "a b c d e f " * 4000]
    for t in texts:
        (n, chars, symbols, dup, repeat), _ = quality_rules.statistics(t)
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.split(" ") and x.encode().split()]
        assert n == len(w) and chars == sum(len(x.decode()) for x in w) and symbols == sum(t.count(x) for x in "#*$%&|<>") and dup == len(lines) - len(set(lines))
        assert repeat == (brute.repeat_words(w) if len(w) < 1000 else n)


def test_repeat_words_of_many_kinds():
    w = [str(i) for i in range(9000)]
    assert quality_rules.repeat_words(w) == 0
    assert quality_rules.repeat_words(w + w[100:105]) == 10
    assert quality_rules.repeat_words(w + w[100:104]) == 0


def test_quality_verdicts(spark):
    rng = random.Random(6)
    rows, labels = list(EDGE), []
    for k in range(400):
        text = words(rng, 60, 500)
        bad = k % 8 == 0
        rows.append((100 + k, " ".join(x + "###$$" for x in text.split()) if bad else text))
        labels.append((100 + k, 0 if bad else 1))
    lab = spark.createDataFrame(labels + [(1, None), (100, 0)], "doc_id long, quality int")
    got = quality_rules.judge(docs(spark, rows), lab).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(not r["kept"] for r in got if r["base_failed"])
    verdict = [by[d]["kept"] == bool(q) for d, q in labels]
    assert sum(verdict) > 0.97 * len(verdict)
    none = quality_rules.judge(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)


# ---- line dedup


def test_line_dedup(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([19, 20, 21, 40, 90, 300]))) for _ in range(12)] + ["é" * 25]
    rows = [(1, None), (2, ""), (3, "\n\n")]
    for d in range(10, 60):
        lines = []
        for _ in range(rng.randrange(4)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(x))
                x = rng.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "y" + x[i + 1 :], "ü" + x, x + "!"])
            lines.append(x)
        rows.append((d, "\n".join([*lines, "short"])))
    found = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in found} == brute.kept_lines(rows, line_dedup.MIN_CHARS)
    each = {d: [x for x in (t or "").split("\n") if len(x) >= line_dedup.MIN_CHARS] for d, t in rows}
    every = {x for xs in each.values() for x in xs}
    near = {x: sum(x != y and abs(len(x) - len(y)) <= 1 and brute.edits(x, y) <= 1 for y in every) for x in every}
    assert {r["doc_id"]: r["__n_links"] for r in found} == {d: sum(near[x] for x in xs) for d, xs in each.items()}
    for r in found:
        assert all(s <= r["doc_id"] for s in r["__sources"]) and bool(r["__sources"]) == bool(r["__n_copies"] + r["__n_near"])


@pytest.mark.parametrize("block", [1000, 2])
def test_line_dedup_by_length(spark, monkeypatch, block):
    """One edit for each 20 code points, at most three: near lines, links and sources by brute force; with small blocks too."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (19, 20, 21, 39, 40, 41, 59, 60, 62, 64, 130)] + ["ab" * 30, "-" * 61, "😀x" * 31]
    rows = [(1, None), (2, "")]
    for d in range(10, 110):
        lines = []
        for _ in range(rng.randrange(4)):
            x = rng.choice(base)
            for _ in range(rng.randrange(6)):
                i = rng.randrange(len(x))
                x = rng.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "y" + x[i + 1 :], "ü" + x, x + "!", x[1:]])
            lines.append(x)
        rows.append((d, "\n".join([*lines, "short"])))
    each = {d: [x for x in (t or "").split("\n") if len(x) >= 20] for d, t in rows}
    first = {}
    for d, xs in each.items():
        for no, x in enumerate(xs):
            first.setdefault(x, (d, no))
    edits = {(x, y): brute.edits(x, y) for x in first for y in first if x < y and abs(len(x) - len(y)) <= 3}
    linked = {p: e for p, e in edits.items() if e <= min(3, len(p[0]) // 20, len(p[1]) // 20)}
    assert sum(e > 1 for e in linked.values()) > 50, "pairs that one edit doesn't find"
    near = {x: [y for p in linked for y in p if x in p and x != y] for x in first}
    found = line_dedup.dedup_lines(docs(spark, rows), edits=3).collect()
    want = {}
    for d, t in rows:
        kept, n_near, n_links, sources = [], 0, 0, set()
        seen = set()
        for x in (t or "").split("\n"):
            n_links += len(near.get(x, ()))
            earlier = min((first[y] for y in near.get(x, ()) if first[y] < first[x]), default=None)
            copy = x in first and (first[x][0] < d or x in seen)
            seen.add(x)
            n_near += earlier is not None
            sources |= {earlier[0]} if earlier else {first[x][0]} if copy else set()
            kept += [] if earlier or copy else [x]
        want[d] = (None if t is None else "\n".join(kept), n_near, n_links, sorted(sources))
    assert {r["doc_id"]: (r["text"], r["__n_near"], r["__n_links"], r["__sources"]) for r in found} == want


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_edits(spark, k):
    rng = random.Random(k)
    pairs = [("", ""), ("a", ""), ("", "abcd"), ("é", "e")]
    for _ in range(200):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(14)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "x"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), k).alias("w")).collect():
        assert r["w"] == (brute.edits(r["a"], r["b"]) <= k), r


def test_line_plan_is_native(spark):
    df = line_dedup.dedup_lines(docs(spark, [(1, "a line that is long enough\nx")]))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


# ---- chat formatting


def test_reply_trees(spark):
    m = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good <|im_end|> & &lt;|", 0.9), ("t", 4, 3, "user", "more", None), ("t", 5, 4, "assistant", None, 0.9), ("t", 6, 99, "user", "orphan", 0.0),
         ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0)]
    df = spark.createDataFrame(m, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["path"]): r for r in chat_format.format_paths(df, 3).collect()}
    assert sorted(got) == [("t", 1), ("t", 2), ("t", 3)]  # a cycle has no root and no path
    best = got["t", 1]
    assert chat_format.read_back(best["formatted"]) == [("user", "q"), ("assistant", "good <|im_end|> & &lt;|"), ("user", "more"), ("assistant", "")]
    assert [chat_format.unescape(best["formatted"][s["start"] : s["end"]]) for s in best["loss"]] == ["good <|im_end|> & &lt;|", ""]
    assert [t for _, t in chat_format.read_back(got["t", 2]["formatted"])] == ["q", "bad"]


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 5, "assist\nant", "x"), (None, 0, "user", "lost")] + [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i} <|im_start|>") for i in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_paths(chat_format.chain(df))).collect()}
    assert sorted(got) == [1, 2, 3]
    for c, r in got.items():
        turns = sorted(((t, ro, tx) for cc, t, ro, tx in rows if cc == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{ro or ''}\n{tx or ''}\n" for _, ro, tx in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(tx or "" for _, ro, tx in turns if ro == "assistant").encode()).hexdigest()


# ---- packing


def test_cut():
    assert packing.cut(1, 10) == [(0, 1)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(30)
        chosen = packing.fullest(counts, room)
        sums = {0}
        for s, c in counts.items():
            sums = {x + s * k for x in sums for k in range(c + 1) if x + s * k <= room}
        assert sum(s * k for s, k in chosen.items()) == max(sums) and all(k <= counts[s] for s, k in chosen.items())


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    rng = random.Random(2)
    rows = EDGE + [(100 + k, words(rng, rng.choice([0, 3, 50, 200, 900]))) for k in range(150)] + [(400, "same text")] * 40
    got = packing.pack(docs(spark, rows), bpe.default_path()).collect()
    ids = bpe.Ids(bpe.default_path())
    pieces = defaultdict(int)
    for d, t in rows:
        body = [*ids.ids(t or ""), 2]
        for k, (s, n) in enumerate(packing.cut(len(body), 1024)):
            pieces[d, k, s, n, zlib.crc32(struct.pack(f"<{n}I", *body[s : s + n]))] += 1
    found = defaultdict(int)
    for r in got:
        found[tuple(r)[:5]] += 1
    assert found == pieces
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    # Never more than first-fit decreasing needs.
    room = []
    for n in sorted((r["length"] for r in got), reverse=True):
        k = next((k for k, free in enumerate(room) if free >= n), None)
        if k is None:
            room.append(1024 - n)
        else:
            room[k] -= n
    assert len(bins) <= len(room)


# ---- empty tables


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert token_counts.count_tokens(none, bpe.default_path()).count() == 0
    assert ngram_join.join(none, 3, 90).count() == 0
    assert decontaminate.scan_benchmark(none, bench).count() == 0
    assert [r["n_hit"] for r in decontaminate.scan_benchmark(docs(spark, [(1, "a b")]), bench).collect()] == [0]
    assert repeats.find_repeats(none).count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert packing.pack(none, bpe.default_path()).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_paths(chat_format.chain(turns))).count() == 0


# ---- ids by the faster library


def test_both_files_hold_one_vocabulary():
    """Ranks are ids, merges are tried in the order of ids, and single bytes are the only other entries."""
    import base64
    import json

    path = bpe.default_path()
    with open(path) as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Bytes stand as printable characters: those that are printable stand for themselves, the others follow from 256 on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
    shown = {"".join(char[b] for b in token): rank for token, rank in ranks.items()}
    assert vocab == shown
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    assert [vocab[a + b] for a, b in merges] == list(range(256, 256 + len(merges)))
    assert len(vocab) == 256 + len(merges)


def test_both_libraries_split_plain_text_alike():
    """Every pair of the plain code points, alone and between letters, digits, signs and blanks."""
    both = bpe.Ids(bpe.default_path())
    plain = [chr(c) for c in range(0x3000) if not bpe._PLAIN.search(chr(c))]
    assert len(plain) > 300
    for x in plain:
        for text in ("".join(f"{x}{y}" for y in plain), "".join(f"a{x}{y}1" for y in plain), " ".join(f"{x}{y}" for y in plain), "".join(f"{x}'{y}  " for y in plain)):
            assert both.fast(text) == both.own.encode(text, add_special_tokens=False).ids


def test_the_file_asks_for_the_pattern_that_is_used():
    """The file's own steps before its merges: nothing but the byte-level split by its library's pattern; and long mixed runs split alike."""
    import json
    import random

    path = bpe.default_path()
    with open(path) as f:
        model = json.load(f)
    step = model["pre_tokenizer"]
    assert (step["type"], step["use_regex"], step["add_prefix_space"], model["normalizer"]) == ("ByteLevel", True, False, None)
    both = bpe.Ids(path)
    plain = [chr(c) for c in range(0x3000) if not bpe._PLAIN.search(chr(c))]
    r = random.Random(8)
    kinds = (plain, "0123456789", "  \n\t", ["'ll", "'ve", "'s", "'S", "don't"], "abcXYZé", ".,;!?-_()")
    for _ in range(20_000):
        text = "".join(r.choice(r.choice(kinds)) * r.choice((1, 1, 2, 5)) for _ in range(r.randrange(1, 30)))
        assert both.fast(text) == both.own.encode(text, add_special_tokens=False).ids
