"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence matrix.

Columns (n-grams, as 64-bit hashes) have one order for all rows. Two linked rows agree in their first k
common columns, and these lie in each row's first columns, whose number follows from its size; so only
those columns are counted and matched. Of them a row needs its rarest ones alone: as many as it can have
without a partner, and one more. A row with too few columns that any other row has there is out, so a
line or passage that very many documents share brings no candidates by itself.

Documents of one class of sizes, or of a class and the next, that are connected by such columns make a
cluster; so documents whose sizes rule out a link connect nothing, and a cluster does not run through all
sizes as the corpus grows. Only clusters are multiplied: in row blocks of bounded weight, in rounds that deal
out a few times the texts each, overlaps are accumulated over column blocks, and a pair is discarded as soon
as the overlap it could still reach is below the bound that its two sizes give.

Documents with equal sets are one row of the matrix, so copies make no pairs. Every product of row blocks
gives links as counts and a spanning forest; components follow by star rounds. Nothing grows with a
cluster but the number of row block pairs. Joins are sorted and merged at every size, so no table passes through
the driver.

Defined cases: null text, or one without words, has the empty set and is its own component without
links; fewer words than an n-gram are one n-gram; repeated rows are linked like copies; a null id takes
part, and component ids are the smallest non-null ids; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, raw_text
from .graph import components

#: Bounds of a row block: documents and n-grams. A row's columns that are looked up at once.
BLOCK_DOCS = 1200
BLOCK_GRAMS = 1_000_000
COLUMNS = 512
#: Products that a text goes to in one round, on average.
ROUND_COPIES = 4
#: Words whose hashes a worker remembers.
CACHE_WORDS = 100_000

_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _K[0]
    x = (x ^ (x >> np.uint64(32))) * _K[2]
    return x ^ (x >> np.uint64(31))


def gram_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles (A-Z lower-cased)."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    ids = np.empty(len(words), dtype=np.uint64)
    get = _words.get
    for k, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        ids[k] = h
    size = min(n, len(words))
    count = len(words) - size + 1
    h = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        h = h * _K[1] + ids[k : k + count]
        h ^= h >> np.uint64(30)
    return np.unique(_mix(h))


class Sizes:
    """What a threshold of ``percent`` means for set sizes, in whole numbers."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        #: Starts of the classes of sizes: the largest partner of a size is at most in the next class.
        self.starts = [1]
        while self.starts[-1] <= most:
            self.starts.append(max(self.starts[-1] + 1, -(-self.starts[-1] * 100 // percent)))

    def least_overlap(self, n: int) -> int:
        """Fewest n-grams that a set of n shares with any set it is linked with."""
        return -(-self.percent * n // 100)

    def common(self, n: int) -> int:
        """k: how many common columns the first columns of a row of n reach at least."""
        return 1 + (n - self.least_overlap(n)) // 2

    def first_columns(self, n: int) -> int:
        """Columns of a row of n that hold its first ``common(n)`` common ones; none if only equal sets can be linked."""
        if n == self.least_overlap(n) and self.largest_partner(n) == n:
            return 0
        return min(n, n - self.least_overlap(n) + self.common(n))

    def needed(self, n: int) -> int:
        """Common columns that a row of n shares with a partner of any size."""
        return self.common(self.least_overlap(n))

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent


def _sketch(n: int, percent: int):
    sizes = Sizes(percent)

    def rows(batches):
        for b in batches:
            out: dict[str, list] = {"doc": b["doc"], "version": b["version"], "n": [], "key": [], "need": [], "first": []}
            for raw in b["raw"]:
                g = gram_set(raw, n)
                out["n"].append(len(g))
                out["key"].append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                out["need"].append(sizes.needed(len(g)) if len(g) else 0)
                out["first"].append(g[: sizes.first_columns(len(g)) if len(g) else 0].view(np.int64))
            yield out

    return rows


def multiply(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Linked pairs (i of a, j of b), or pairs i < j of a if b is None.

    A sparse product, row by row: a row's columns, ``COLUMNS`` at a time, are looked up among the other block's entries, which are kept by column, and each
    entry met adds one to its row's overlap. Only entries that meet cost anything. A pair is out once the row's columns that are left can't lift its overlap to the bound.
    """
    other = a if b is None else b
    if not a or not other:
        return []
    size = np.array([len(s) for s in other], dtype=np.int64)
    value = np.concatenate(other)
    order = np.argsort(value, kind="stable")
    doc = np.repeat(np.arange(len(other)), size)[order]
    grams, first = np.unique(value[order], return_index=True)
    ends = np.append(first[1:], len(value))
    out: list[tuple[int, int]] = []
    for i, row in enumerate(a):
        n = len(row)
        need = -(-percent * (n + size) // (100 + percent))
        alive = need <= np.minimum(n, size)
        if b is None:
            alive[: i + 1] = False
        if not n or not alive.any():
            continue
        overlap = np.zeros(len(other), dtype=np.int64)
        for low in range(0, n, COLUMNS):
            part = row[low : low + COLUMNS]
            at = np.searchsorted(grams, part)
            at = at[grams[np.minimum(at, len(grams) - 1)] == part]
            count = ends[at] - first[at]
            start = np.repeat(first[at] - (np.cumsum(count) - count), count)
            overlap += np.bincount(doc[start + np.arange(len(start))], minlength=len(other))
            alive &= overlap + max(0, n - low - COLUMNS) >= need
            if not alive.any():
                break
        out += [(i, int(j)) for j in np.flatnonzero(alive)]
    return out


def _products(n: int, percent: int):
    """Rows come sorted by group; one group of at most two row blocks is held at a time."""

    def rows(batches):
        key, held = None, []
        for b in batches:
            out: list = []
            for r in zip(b["task"], b["side"], b["cid"], b["copies"], b["raw"]):
                if r[0] != key:
                    out += _product(held, n, percent)
                    key, held = r[0], []
                held.append(r)
            yield {"u": [x[0] for x in out], "v": [x[1] for x in out], "links": [x[2] for x in out]}
        out = _product(held, n, percent)
        yield {"u": [x[0] for x in out], "v": [x[1] for x in out], "links": [x[2] for x in out]}

    return rows


def _product(held: list, n: int, percent: int) -> list[tuple[int, int | None, int]]:
    """(u, v, 0) for the edges of a spanning forest, (u, None, links) for a row's number of links."""
    if len(held) < 2:
        return []
    square = held[0][1] < 0
    a = [r for r in held if r[1] <= 0]
    b = [r for r in held if r[1] > 0]
    if not a or not (b or square):  # a row block that no row was dealt to
        return []
    load = lambda part: [gram_set(r[4], n) for r in part]
    left = load(a)
    pairs = [(a[i], a[j]) for i, j in multiply(left, None, percent)] if square else []
    pairs += [(a[i], b[j]) for i, j in multiply(left, load(b), percent)] if b else []
    root: dict[int, int] = {}
    links: dict[int, int] = {}
    out = []

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for u, v in pairs:
        links[u[2]] = links.get(u[2], 0) + v[3]
        links[v[2]] = links.get(v[2], 0) + u[3]
        x, y = find(u[2]), find(v[2])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((u[2], v[2], 0))
    return out + [(u, None, n) for u, n in links.items()]


def _class(percent: int):
    """The class of a size n: how many starts are at most the size."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in Sizes(percent).starts]), lambda x: x <= F.col("n")))


def _meets(chosen: DataFrame) -> DataFrame:
    """Edges (u, v) between rows of (cid, klass, gram) that share a column and whose sizes may be linked.

    Rows of a class and those of the next one meet by themselves, whatever they share with other sizes: so a row is two nodes, 2 * cid beside the
    rows of its own class and the next, and 2 * cid + 1 as one of the next. Of the latter none meet each other, as they do so in their own class.
    """
    nodes = chosen.select("gram", F.explode(F.array(F.lit(0), F.lit(1))).alias("upper"), "cid", "klass").select("gram", (F.col("klass") - F.col("upper")).alias("window"), (2 * F.col("cid") + F.col("upper")).alias("node"), "upper")
    least = nodes.groupBy("gram", "window").agg(F.min(F.when(F.col("upper") == 0, F.col("node"))).alias("least"), F.count("*").alias("__n")).filter("__n > 1 and least is not null")
    return nodes.join(least.select("gram", "window", "least").hint("merge"), ["gram", "window"]).filter("node != least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()


def _row_blocks(members: DataFrame) -> DataFrame:
    """(cid, cluster, copies, task, side): the products that each row of (cid, upper, cluster, n, copies) takes part in.

    Of a cluster, rows that aren't ``upper`` are multiplied with each other and with those that are. Side is -1 in a block's product with itself, which may
    have rows of side 1 besides; else the rows of side 0 are multiplied with those of side 1.
    """
    whole = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("grams"))
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("grams") <= BLOCK_GRAMS)
    rows = members.join(whole.select("cluster", small.alias("small")).hint("merge"), "cluster")
    task = lambda *parts: F.xxhash64("cluster", *parts)
    one = rows.filter("small").select("cid", "cluster", "copies", task(F.lit(0)).alias("task"), F.when(F.col("upper"), 1).otherwise(-1).alias("side"))
    rest = rows.filter("not small")
    salts = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK_DOCS), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_GRAMS)).cast("int")
    parts = rest.groupBy("cluster").agg(salts(~F.col("upper")).alias("lowers"), salts(F.col("upper")).alias("uppers"))
    rest = rest.join(parts.hint("merge"), "cluster")
    mine = F.pmod(F.xxhash64("cid", F.lit(5)), F.when(F.col("upper"), F.col("uppers")).otherwise(F.col("lowers"))).cast("int")
    rest = rest.withColumn("mine", mine)
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    entry = lambda kind, i, j, side: F.struct(task(F.lit(kind), i, j).alias("task"), side.cast("int").alias("side"))
    i, lowers, uppers = F.col("mine"), F.col("lowers"), F.col("uppers")
    lower = F.concat(
        F.transform(upto(lowers), lambda j: entry(1, F.least(i, j), F.greatest(i, j), F.when(i == j, -1).when(i > j, 1).otherwise(0))),
        F.transform(upto(uppers), lambda j: entry(2, i, j, F.lit(0))),
    )
    upper = F.transform(upto(lowers), lambda j: entry(2, j, i, F.lit(1)))
    return one.unionByName(rest.select("cid", "cluster", "copies", F.inline(F.when(F.col("upper"), upper).otherwise(lower))))


def row_version(id_col: str = "doc_id", text_col: str = "text"):
    """Tells rows apart that share an id."""
    return F.xxhash64(id_col, text_col)


def join(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n_shingles, component_id, n_links, component) of every document.

    ``version`` tells rows apart that share an id, ``component`` is null for empty sets. Documents link
    when 100 * intersection >= percent * union of their n-gram sets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc"), row_version(id_col, text_col).alias("version"), raw_text(text_col).alias("raw"))
    wide = scratch.table(map_arrow(source, _sketch(n, percent), f"doc {kind}, version long, n long, key binary, need int, first array<long>"), "sketched")
    # Equal sets are one row of the matrix; at names one of its documents.
    at = F.struct("doc", "version")
    firsts = wide.filter("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc").alias("least"), F.min(at).alias("at"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("first").alias("first"))
    firsts = scratch.table(firsts.withColumn("cid", F.monotonically_increasing_id()), "firsts")
    # First columns take most of the disk: they stay in one table only, and only until the columns are chosen.
    sketch = scratch.table(wide.drop("first", "need"), "sketch")
    scratch.drop("sketched")
    rows = scratch.table(firsts.drop("first").withColumn("klass", _class(percent)), "rows")
    # One exchange, from which columns are counted and matched.
    entries = firsts.select("cid", F.explode("first").alias("gram")).repartition("gram")
    met = entries.groupBy("gram").agg(F.count("*").alias("rows")).filter("rows > 1")
    shared = entries.join(met.hint("merge"), "gram").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("rows", "gram"))).alias("shared"))
    rarest = F.slice("shared", 1, F.size("shared") - F.col("need") + 1)
    chosen = shared.join(rows.select("cid", "need", "klass").hint("merge"), "cid").filter(F.size("shared") >= F.col("need")).select("cid", "klass", F.explode(rarest).alias("g")).select("cid", "klass", F.col("g.gram").alias("gram"))
    chosen = scratch.table(chosen, "columns")
    scratch.drop("firsts")
    meets = scratch.table(_meets(chosen), "meets")
    scratch.drop("columns")
    clusters = components(meets, scratch, "clusters")
    clusters = scratch.table(clusters.unionAll(clusters.select(F.col("root").alias("node"), "root").distinct()), "clustered")
    nodes = clusters.select(F.shiftright("node", 1).alias("cid"), (F.col("node") % 2 == 1).alias("upper"), F.col("root").alias("cluster"))
    members = rows.select("cid", "n", "copies", "at").join(nodes.hint("merge"), "cid")

    # Rows of one id and text would come several times; they meet by the join's own key.
    # Sorted and merged at every size, as the plan for a corpus would be.
    wanted = members.select("cid", "at").distinct()
    texts = source.join(wanted.hint("merge"), (F.col("version") == F.col("at.version")) & F.col("doc").eqNullSafe(F.col("at.doc")))
    texts = scratch.table(texts.select("version", "cid", "raw").dropDuplicates(["version", "cid"]).select("cid", "raw"), "texts")
    blocks = scratch.table(_row_blocks(members.select("cid", "upper", "cluster", "n", "copies")), "row-blocks")
    # Rows of a large cluster are in many products: these come in rounds, so that no round deals out much more than the texts.
    rounds = max(1, -(-blocks.count() // (ROUND_COPIES * max(1, texts.count()))))
    found = []
    for k in range(rounds):
        dealt = blocks.filter(F.pmod("task", F.lit(rounds)) == k).join(texts.hint("merge"), "cid").select("task", "side", "cid", "copies", "raw")
        dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task", "side", "cid")
        found.append(scratch.table(map_arrow(dealt, _products(n, percent), "u long, v long, links long"), f"products-{k}"))
    found = reduce(DataFrame.unionAll, found)
    scratch.drop("meets", "clustered", "texts", "row-blocks")
    roots = components(found.filter("v is not null").select("u", "v"), scratch, "components")
    links = found.filter("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    named = rows.select("cid", "key", "copies", F.col("least").alias("first")).join(roots.hint("merge"), F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = scratch.table(named.join(least.hint("merge"), "root").join(links.hint("merge"), "cid", "left").select("key", "root", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    scratch.keep("sketch", "named")
    out = sketch.select("doc", "version", "n", "key").join(named.hint("merge"), "key", "left")
    return out.select(
        F.col("doc").alias("doc_id"), "version", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("root").alias("component"),
    )


def keep_one(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without near copies: of each component the one with the least id stays, and every row without words."""
    found = join(docs, n, percent, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("version").alias("row"))
    least = found.filter("component is not null").groupBy("component").agg(F.min(rank).alias("least"))
    stay = least.select(F.col("least.row").alias("version"), F.col("least.id").alias("doc"), F.lit(True).alias("one"))
    empty = found.filter("component is null").select("version", F.col("doc_id").alias("doc"), F.lit(False).alias("one")).distinct()
    # Other columns are packed, so that no name clashes.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select((F.struct(*others) if others else F.lit(None).cast("int")).alias("others"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_version(id_col, text_col).alias("row"))
    kept = rows.join(stay.unionByName(empty).hint("merge"), (F.col("row") == F.col("version")) & F.col("id").eqNullSafe(F.col("doc")))
    both = kept.filter("one").dropDuplicates(["row", "id"]).unionByName(kept.filter("not one"))
    return both.select(*[F.col("text").alias(c) if c == text_col else F.col("id").alias(c) if c == id_col else F.col(f"others.`{c}`").alias(c) for c in docs.columns])
