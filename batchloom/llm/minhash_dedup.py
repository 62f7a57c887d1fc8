"""MinHash near-dedup: many universal hash minima, banding, signature and full-set verification, components by stars.

A row's signature holds, for each of HASHES universal hash functions (multiply, add, take the high half), the least value
over its n-gram set. Rows that agree in all minima of one of BANDS bands share a bucket. At 0.8, the least similarity that
links, a pair misses all bands with a probability of 1.3e-7.

Documents with equal sets are one row. Each row of a bucket is first paired with the bucket's least row, so pairs grow with
rows and bands, not with the square of a bucket; pairs whose signatures agree enough are confirmed on full sets and joined to
components. A bucket whose rows are of one component then needs nothing more, nor does one of two rows. Rows of the other buckets,
joined to clusters, are compared across components only: a cluster's largest component is cut into blocks, the other
rows into blocks of their own, and each product compares signatures, then full sets of rows that aren't joined yet. No
task holds more than two blocks, and a cluster with few rows beside its largest component costs in proportion to its rows.

Defined cases: null text, or one without words, has the empty set and is its own component; fewer words than an n-gram are one
n-gram; very long texts count whole; repeated rows are linked like copies; a null id takes part, component ids are the
smallest non-null ids, and a null id alone has a null component and is kept; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, raw_text
from .graph import components
from .ngram_join import gram_set, row_version

BANDS = 40
BAND_ROWS = 5
HASHES = BANDS * BAND_ROWS
#: How far a signature's agreement may lie below the similarity that it estimates: six of its standard deviations at 0.8.
SLACK = 0.17
#: Bounds of a block: rows and n-grams.
BLOCK_DOCS = 1200
BLOCK_GRAMS = 1_000_000
#: Pairs of a row up to which sets are met one by one.
FEW = 8
#: N-grams hashed at once.
CHUNK = 1024

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit numbers."""
    least = np.full(HASHES, 0xFFFFFFFF_FFFFFFFF, dtype=np.uint64)
    for at in range(0, len(grams), CHUNK):
        h = np.multiply.outer(_A, grams[at : at + CHUNK])
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(n: int):
    def rows(batches):
        for b in batches:
            out: dict[str, list] = {"doc": b["doc"], "version": b["version"], "n": [], "key": [], "sig": []}
            for raw in b["raw"]:
                g = gram_set(raw, n)
                out["n"].append(len(g))
                out["key"].append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                out["sig"].append(signature(g).tobytes() if len(g) else None)
            yield out

    return rows


def _grams(n: int):
    def rows(batches):
        for b in batches:
            yield {"cid": b["cid"], "grams": [gram_set(raw, n).tobytes() for raw in b["raw"]]}

    return rows


def _alike(percent: int):
    """Pairs whose signatures agree enough."""
    least = (percent / 100 - SLACK) * HASHES

    def rows(batches):
        for b in batches:
            hit = [k for k, (x, y) in enumerate(zip(b["sig_u"], b["sig_v"])) if (np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum() >= least]
            yield {c: [b[c][k] for k in hit] for c in ("u", "v")}

    return rows


def _confirmed(percent: int):
    def rows(batches):
        for b in batches:
            hit = [k for k, (x, y) in enumerate(zip(b["grams_u"], b["grams_v"])) if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield {c: [b[c][k] for k in hit] for c in ("u", "v")}

    return rows


def _products(percent: int):
    """Rows come sorted by task; those of one task, of two blocks at most, are held at a time."""

    def rows(batches):
        task, held = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for r in zip(b["task"], b["side"], b["root"], b["sig"], b["grams"]):
                if r[0] != task:
                    out += _product(held, percent)
                    task, held = r[0], []
                held.append(r)
            yield {"u": [x[0] for x in out], "v": [x[1] for x in out]}
        out = _product(held, percent)
        yield {"u": [x[0] for x in out], "v": [x[1] for x in out]}

    return rows


def _product(held: list, percent: int) -> list[tuple[int, int]]:
    """Pairs of roots that some rows of theirs link: a forest over the roots of one task."""
    a = [r for r in held if r[1] <= 0]
    b = [r for r in held if r[1] > 0] or (a if held and held[0][1] < 0 else [])
    if not a or not b:
        return []
    sigs = lambda part: np.array([np.frombuffer(r[3], np.uint32) for r in part])
    sets = lambda part: [np.frombuffer(r[4], np.uint64) for r in part]
    left, right, sets_a, sets_b = sigs(a), sigs(b), sets(a), sets(b)
    size = np.array([len(s) for s in sets_b])
    roots = np.array([r[2] for r in b])
    # Columns of the incidence matrix of b: a row of a marks its own, and each row of b counts the marked ones.
    grams, column = np.unique(np.concatenate(sets_b), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    marked = np.zeros(len(grams), dtype=np.uint8)
    top: dict[int, int] = {}
    out = []

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for i, r in enumerate(a):
        n = len(sets_a[i])
        near = np.flatnonzero((roots != r[2]) & (100 * size >= percent * n) & (100 * n >= percent * size))
        near = near[(right[near] == left[i]).sum(axis=1) >= (percent / 100 - SLACK) * HASHES]
        if not len(near):
            continue
        if len(near) > FEW:
            at = np.searchsorted(grams, sets_a[i])
            at = at[grams[np.minimum(at, len(grams) - 1)] == sets_a[i]]
            marked[at] = 1
            both = np.add.reduceat(marked[column], starts, dtype=np.int64)[near]
            marked[at] = 0
            near = near[100 * both >= percent * (n + size[near] - both)]
        else:
            near = [j for j in near if linked(sets_a[i], sets_b[j], percent)]
        for j in near:
            x, y = find(r[2]), find(int(roots[j]))
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((r[2], int(roots[j])))
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """(cid, root, task, side) of (cid, cluster, root, n): the products that each row takes part in; side is -1 in a block's product with itself."""
    parts = members.groupBy("cluster", "root").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    wide = parts.groupBy("cluster").agg(
        F.max_by("root", F.struct("docs", F.col("root"))).alias("main"), F.max("docs").alias("main_docs"), F.max_by("grams", F.struct("docs", F.col("root"))).alias("main_grams"),
        F.sum("docs").alias("docs"), F.sum("grams").alias("grams"),
    )
    salts = lambda docs, grams: F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(grams / BLOCK_GRAMS), F.lit(1)).cast("int")
    c = F.col
    wide = wide.select(
        "cluster", "main", ((c("docs") <= BLOCK_DOCS) & (c("grams") <= BLOCK_GRAMS)).alias("one"), salts(c("main_docs"), c("main_grams")).alias("n_main"),
        salts(c("docs") - c("main_docs"), c("grams") - c("main_grams")).alias("n_rest"),
    )
    rows = members.join(wide.hint("merge"), "cluster")
    salt = lambda n: F.pmod(F.xxhash64("cid", F.lit(7)), c(n)).cast("int")
    entry = lambda kind, i, j, side: F.struct(F.xxhash64("cluster", F.lit(kind), i, j).alias("task"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), c(n) - 1)
    i, j = salt("n_rest"), salt("n_main")
    rest = F.concat(
        F.transform(upto("n_rest"), lambda k: entry("rest", F.least(i, k), F.greatest(i, k), F.when(i == k, -1).when(i > k, 1).otherwise(0))),
        F.transform(upto("n_main"), lambda k: entry("main", i, k, F.lit(0))),
    )
    main = F.transform(upto("n_rest"), lambda k: entry("main", k, j, F.lit(1)))
    tasks = F.when(c("one"), F.array(entry("one", F.lit(0), F.lit(0), F.lit(-1)))).when(c("root") == c("main"), main).otherwise(rest)
    return rows.select("cid", "root", F.inline(tasks))


def _rooted(rows: DataFrame, roots: DataFrame, name: str = "cid") -> DataFrame:
    """Adds ``root``: the row's component, itself if it is in none."""
    return rows.join(roots.select(F.col("node").alias(name), "root").hint("merge"), name, "left").withColumn("root", F.coalesce("root", name))


def near_copies(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; links are made at 100 * intersection >= percent * union of n-word shingles.

    ``percent`` must be 80 at least: the bands are laid out for it.
    """
    if percent < 80:
        raise ValueError("the bands find pairs of 80 percent or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc"), row_version(id_col, text_col).alias("version"), raw_text(text_col).alias("raw"))
    sketch = scratch.table(map_arrow(source, _sketch(n), f"doc {kind}, version long, n long, key binary, sig binary"), "sketch")
    rows = sketch.filter("n > 0").groupBy("key").agg(
        F.min("doc").alias("least"), F.min(F.struct("doc", "version")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    rows = scratch.table(rows.withColumn("cid", F.monotonically_increasing_id()), "rows")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * 4 * BAND_ROWS + 1, F.lit(4 * BAND_ROWS))))
    entries = rows.select("cid", F.explode(bands).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("cid").alias("pivot"), F.count("*").alias("met")).filter("met > 1")
    members = scratch.table(entries.join(shared.hint("merge"), "bucket"), "members")

    signs = lambda name: rows.select(F.col("cid").alias(name), F.col("sig").alias(f"sig_{name}")).hint("merge")
    stars = members.filter("cid != pivot").select(F.col("cid").alias("u"), F.col("pivot").alias("v")).distinct()
    near = scratch.table(map_arrow(stars.join(signs("u"), "u").join(signs("v"), "v"), _alike(percent), "u long, v long"), "near")

    def gram_sets(of: DataFrame, name: str) -> DataFrame:
        wanted = rows.select("cid", "at").join(of.hint("merge"), "cid", "left_semi")
        # Rows of one id and text would come several times.
        texts = source.join(wanted.hint("merge"), (F.col("version") == F.col("at.version")) & F.col("doc").eqNullSafe(F.col("at.doc"))).select("cid", "raw").dropDuplicates(["cid"])
        return scratch.table(map_arrow(texts, _grams(n), "cid long, grams binary"), name)

    sets = gram_sets(near.select(F.col("u").alias("cid")).unionAll(near.select("v")).distinct(), "near-sets")
    full = lambda name: sets.select(F.col("cid").alias(name), F.col("grams").alias(f"grams_{name}")).hint("merge")
    edges = scratch.table(map_arrow(near.join(full("u"), "u").join(full("v"), "v"), _confirmed(percent), "u long, v long"), "edges")
    roots = scratch.table(components(edges, scratch, "stars"), "roots")
    scratch.drop("near-sets", "near")

    known = _rooted(members, roots)
    open_ = known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    left = scratch.table(known.filter("met > 2").join(open_.hint("merge"), "bucket").select("cid", "pivot", "root"), "left")
    scratch.drop("members")
    clusters = components(left.filter("cid != pivot").select(F.col("cid").alias("u"), F.col("pivot").alias("v")), scratch, "clusters")
    clustered = _rooted(left.select("cid", F.col("root").alias("of")).distinct(), clusters).select("cid", F.col("root").alias("cluster"), F.col("of").alias("root"))
    clustered = scratch.table(clustered.join(rows.select("cid", "n").hint("merge"), "cid"), "clustered")
    sets = gram_sets(clustered.select("cid"), "sets")
    dealt = _blocks(clustered).join(rows.select("cid", "sig").hint("merge"), "cid").join(sets.hint("merge"), "cid").select("task", "side", "root", "sig", "grams")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task", "side")
    across = scratch.table(map_arrow(dealt, _products(percent), "u long, v long"), "across")
    scratch.drop("sets", "left", "clustered")
    tops = components(across, scratch, "tops").select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge")

    named = _rooted(rows.select("cid", "key", "least"), roots).join(tops, "root", "left").withColumn("top", F.coalesce("top", "root"))
    least = named.groupBy("top").agg(F.min("least").alias("component"))
    named = scratch.table(named.select("key", "top").join(least.hint("merge"), "top").select("key", "component"), "named")
    scratch.keep("sketch", "named")
    out = sketch.select("doc", "n", "key").join(named.hint("merge"), "key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))
