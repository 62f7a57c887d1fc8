"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line of at least ``MIN_CHARS`` code points is removed if the same line stands earlier, or if a line at
most one edit (insertion, deletion, substitution of a code point) away does; earlier is by (doc_id,
line number). With ``edits`` above 1 longer lines may differ by more: by one edit for each ``MIN_CHARS``
code points of the shorter line, at most ``edits``.

For one edit the join takes three rounds, and a line leaves as soon as it has no partner:

1. Each line is split into threshold-plus-one = 2 segments by its length. It goes into the index of its
   own length, and probes the index of the next length with the segments that a line without one of the
   partner's code points would have.
2. Where a segment met, the other one is cut into short pieces, and the key becomes all but one piece.
3. Where those met, the piece without its i-th code point completes the key. Lines that share it differ
   in just that code point, so a group needs its earliest line, never its pairs.

The earliest partner of each line is then verified with a banded bit-parallel edit distance, one pair a
line; links are counted by the groups' sizes. Counts precede every join back, so hot segments are pre-aggregated, and no round makes pairs.

For more edits, k of them, a line of n code points is indexed by k + 1 segments. It probes the indexes of its own length and of
those up to k less at each place where, with k edits in all, the first segment left whole may stand. Lines that meet
are paired, in blocks where a segment is hot; pairs whose code points' counts differ in too many parities go, all
others are verified by Spark's own banded distance. Their number grows with the square of a hot segment's lines.

Defined cases: null text has no lines and stays null; empty text stays empty; shorter lines are kept;
rows equal in id and text are treated alike; other columns are kept as they are, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MIN_CHARS = 20
#: Pieces of a segment have about this many code points; a segment has at most so many pieces.
PIECE_CHARS = 8
MOST_PIECES = 32
#: Lines of a hot segment that one task's block pairs with the segment's others.
BLOCK_LINES = 1000


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Whether two strings are at most ``k`` edits apart.

    Bit d+k of ``r[e]`` says that the first j+d code points of ``a`` and the first j of ``b`` are at most
    e edits apart; each code point of ``b`` moves all diagonals of the band at once.
    """
    band = (1 << (2 * k + 1)) - 1
    state = lambda parts: F.struct(*[p.cast("long").alias(f"r{e}") for e, p in enumerate(parts)])
    start = state([F.lit(((1 << (e + 1)) - 1) << k) for e in range(k + 1)])
    x, y = F.split(a, ""), F.split(b, "")

    def move(r: Column, j: Column) -> Column:
        same = F.lit(0).cast("long")
        inside = F.lit(0).cast("long")
        for d in range(-k, k + 1):
            bit = F.lit(1 << (d + k)).cast("long")
            same = same.bitwiseOR(F.when((j + d >= 0) & F.get(x, j + d).eqNullSafe(F.get(y, j)), bit).otherwise(F.lit(0).cast("long")))
            inside = inside.bitwiseOR(F.when((j + 1 + d >= 0) & (j + 1 + d <= F.length(a)), bit).otherwise(F.lit(0).cast("long")))
        out: list[Column] = []
        for e in range(k + 1):
            now = r[f"r{e}"].bitwiseAND(same)
            if e:
                below = r[f"r{e - 1}"]
                now = now.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(out[-1], 1))
            out.append(now.bitwiseAND(inside).bitwiseAND(F.lit(band).cast("long")))
        return state(out)

    steps = F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b) - 1)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(steps, start, move)
    at = F.length(a) - F.length(b)
    return (F.abs(at) <= k) & (F.shiftright(end[f"r{k}"], 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(2 * k + 1)]), F.least(F.greatest(at + k, F.lit(0)), F.lit(2 * k)) + 1)) != 0)


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("version"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("no", "line"))
    return rows.filter(F.length("line") >= MIN_CHARS).withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key another row has too, at least one of them by its own length."""
    met = rows.groupBy(key).agg(F.count("*").alias("__n"), F.max("own").alias("__own")).filter("__n > 1 and __own").select(key)
    return rows.join(met, key, "left_semi")


def _segments(lines: DataFrame) -> DataFrame:
    """(id, key, side, own): the segments by the line's own length and as one code point less than the next."""
    line, n = F.col("line"), F.length("line")

    def entry(size: Column, side: int, own: bool) -> Column:
        half = F.floor(size / 2).cast("int")
        part = F.substring(line, F.lit(1), half) if side == 0 else F.substring(line, n - (size - half) + 1, size - half)
        return F.struct(F.xxhash64(size, F.lit(side), part).alias("key"), F.lit(side).cast("byte").alias("side"), F.lit(own).alias("own"))

    entries = F.array(*[entry(n if own else n + 1, side, own) for own in (True, False) for side in (0, 1)])
    return lines.select("id", F.inline(entries))


def _pieces(found: DataFrame) -> DataFrame:
    """(id, at, own, key2, piece): all but one piece of the segment that didn't meet, and that piece."""
    line, n = F.col("line"), F.length("line")
    size = F.when(F.col("own"), n).otherwise(n + 1)
    half = F.floor(size / 2).cast("int")
    other = F.when(F.col("side") == 0, size - half).otherwise(half)
    have = F.when(F.col("own"), other).otherwise(other - 1)
    rest = F.when(F.col("side") == 0, F.substring(line, n - have + 1, have)).otherwise(F.substring(line, F.lit(1), have))
    rows = found.select("id", "at", "own", "key", other.alias("other"), have.alias("have"), rest.alias("rest"))
    many = F.least(F.lit(MOST_PIECES), F.greatest(F.lit(1), F.floor(F.col("other") / PIECE_CHARS).cast("int")))
    rows = rows.withColumn("many", many).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    low = F.floor(F.col("j") * F.col("other") / F.col("many")).cast("int")
    after = F.col("other") - F.floor((F.col("j") + 1) * F.col("other") / F.col("many")).cast("int")
    rows = rows.withColumns({"low": low, "after": after})
    text, size = F.col("rest"), F.col("have")
    key = F.xxhash64("key", "j", F.substring(text, F.lit(1), F.col("low")), F.lit("\n"), F.substring(text, size - F.col("after") + 1, F.col("after")))
    return rows.select("id", "at", "own", key.alias("key2"), F.substring(text, F.col("low") + 1, size - F.col("low") - F.col("after")).alias("piece"))


def _partners(pieces: DataFrame) -> DataFrame:
    """(id, at, kind, own, near, others, short): each key that a line shares; ``near`` is the earliest partner there, ``others``
    how many lines differ from it in that code point, ``short`` the line that has one code point less."""
    piece, n = F.col("piece"), F.length("piece")
    without = lambda i: F.concat(F.substring(piece, F.lit(1), i), F.substring(piece, i + 2, n))
    # "s": all but the i-th code point; "d": one code point less, which a shorter line has by itself.
    own = F.flatten(
        F.transform(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.array(
                F.struct(F.xxhash64("key2", F.lit("s"), i, without(i)).alias("key3"), F.lit("s").alias("kind")),
                F.struct(F.xxhash64("key2", F.lit("d"), F.lit(-1), without(i)).alias("key3"), F.lit("d").alias("kind")),
            ),
        )
    )
    short = F.array(F.struct(F.xxhash64("key2", F.lit("d"), F.lit(-1), piece).alias("key3"), F.lit("d").alias("kind")))
    rows = pieces.select("id", "at", "own", F.inline(F.when(F.col("own"), own).otherwise(short)))
    me = F.struct("at", "id")
    first = rows.groupBy("key3").agg(F.count("*").alias("n"), F.min(F.when(F.col("own"), me)).alias("long"), F.min(F.when(~F.col("own"), me)).alias("short")).filter("n > 1")
    near = F.when(F.col("kind") == "s", F.col("long")).when(F.col("own"), F.col("short")).otherwise(F.col("long"))
    # Lines that lose the same code point to the same rest are "s" partners; "d" is for a line and a shorter one.
    real = (F.col("kind") == "s") | (F.col("long").isNotNull() & F.col("short").isNotNull())
    others = F.when(F.col("kind") == "s", F.col("n") - 1).otherwise(0)
    return rows.join(first, "key3").filter(real).select("id", "at", "kind", "own", near.alias("near"), others.alias("others"), F.when((F.col("kind") == "d") & F.col("own"), F.col("short.id")).alias("short"))


def _links(partners: DataFrame) -> DataFrame:
    """(id, links): how many lines are one edit away, by group sizes and by pairs of a line and one it becomes by a deletion."""
    pairs = partners.filter("short is not null").select("id", "short").distinct()
    both = pairs.select("id").unionAll(pairs.select(F.col("short").alias("id"))).withColumn("links", F.lit(1).cast("long"))
    return partners.filter("others > 0").select("id", F.col("others").cast("long").alias("links")).unionAll(both).groupBy("id").agg(F.sum("links").alias("links"))


def allowed_edits(n: Column, edits: int) -> Column:
    """The edits that a line of ``n`` code points may be away from a line that isn't shorter."""
    return F.least(F.lit(edits), F.floor(n / MIN_CHARS).cast("int"))


def _probes(lines: DataFrame, edits: int) -> DataFrame:
    """(id, key, own): a line's segments, and the places where it may hold those of lines of its length or up to ``edits`` less."""
    line, n = F.col("line"), F.col("n")

    def entries(less: int, k: int) -> Column:
        size, out = n - less, []
        for j in range(k + 1):
            low, high = (F.floor(size * e / (k + 1)).cast("int") for e in (j, j + 1))
            # Of k edits at most j lie before segment j and k - j after it, or an other segment is whole.
            for shift in range(max(-j, less - (k - j)), min(j, less + k - j) + 1):
                key = F.xxhash64(size, F.lit(j), F.substring(line, low + shift + 1, high - low))
                out.append(F.struct(key.alias("key"), F.lit(not less and not shift).alias("own")))
        return F.array(*out)

    none = F.array().cast("array<struct<key:bigint,own:boolean>>")
    each = [F.when(allowed_edits(n - less, edits) == k, entries(less, k)).otherwise(none) for less in range(edits + 1) for k in range(max(1, less), edits + 1)]
    return lines.select("id", "line", F.length("line").alias("n")).select("id", F.inline(F.concat(*each)))


def _parities(line: Column) -> Column:
    """64 bits, of which an edit turns two at most: whether the code points of each hash occur an odd number of times."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def _pairs(entries: DataFrame, edits: int) -> DataFrame:
    """(x, y): pairs of lines that share a segment and may be as near as their length allows, each pair once."""
    parts = F.ceil(F.col("many") / BLOCK_LINES).cast("int")
    own = entries.filter("own").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("abits"))
    other = entries.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bbits"))
    k = allowed_edits(F.col("na"), edits)
    near = (F.col("nb") - F.col("na")).between(0, k) & (F.bit_count(F.col("abits").bitwiseXOR(F.col("bbits"))) <= 2 * k)
    met = own.join(other.hint("merge"), ["key", "part"]).filter((F.col("a") != F.col("b")) & near)
    return met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def near_lines_by_length(lines: DataFrame, scratch: Scratch, edits: int) -> tuple[DataFrame, DataFrame]:
    """What ``near_lines`` gives, for lines with one edit for each ``MIN_CHARS`` code points, at most ``edits``."""
    same = Window.partitionBy("key")
    met = _probes(lines, edits).withColumns({"many": F.count("*").over(same), "first": F.min("id").over(same), "last": F.max("id").over(same), "any": F.max("own").over(same)})
    met = scratch.table(met.filter("any and first < last").select("id", "key", "own", "many"), "segments")
    entries = met.groupBy("id").agg(F.collect_set(F.struct("key", "own", "many")).alias("entries"))
    texts = lines.select("id", "k1", "k2", "at", "line").join(entries.hint("merge"), "id").withColumn("bits", _parities(F.col("line")))
    texts = scratch.table(texts, "candidates")
    scratch.drop("segments")
    pairs = scratch.table(_pairs(texts.select("id", F.length("line").alias("n"), "bits", F.inline("entries")), edits), "pairs")
    # Not broadcast, as for one edit.
    for end in ("x", "y"):
        pairs = pairs.join(texts.select(F.col("id").alias(end), F.col("at").alias(f"{end}_at"), F.col("line").alias(f"{end}_line")).hint("merge"), end)
    a, b = F.col("x_line"), F.col("y_line")
    k = allowed_edits(F.least(F.length(a), F.length(b)), edits)
    linked = pairs.filter(reduce(Column.__or__, [(k == e) & (F.levenshtein(a, b, e) >= 0) for e in range(1, edits + 1)]))
    linked = scratch.table(linked.select("x", "y", "x_at", "y_at"), "linked")
    ends = linked.select(F.col("x").alias("id"), F.col("y_at").alias("other")).unionAll(linked.select(F.col("y").alias("id"), F.col("x_at").alias("other")))
    found = ends.groupBy("id").agg(F.count("*").alias("links"), F.min("other").alias("first"))
    found = scratch.table(found.join(texts.select("id", "k1", "k2", "at").hint("merge"), "id").drop("id"), "near")
    scratch.drop("candidates", "pairs", "linked")
    return found.filter("first < at").select("k1", "k2", "at", F.col("first.doc").alias("source")), found.select("k1", "k2", "at", "links")


def near_lines(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, at, source): lines of the table of distinct lines with an earlier one within one edit, verified, and that one's
    document; and (k1, k2, at, links): how many lines are within one edit of each."""
    met = scratch.table(_shared(_segments(lines.select("id", "line")), "key"), "segments")
    # Whole lines are shuffled here only, at every size: at most four entries a line travel with it.
    entries = met.groupBy("id").agg(F.collect_list(F.struct("key", "side", "own")).alias("entries"))
    texts = scratch.table(lines.select("id", "k1", "k2", "at", "line").join(entries.hint("merge"), "id"), "candidates")
    pieces = scratch.table(_shared(_pieces(texts.select("id", "at", "line", F.inline("entries"))), "key2"), "pieces")
    partners = scratch.table(_partners(pieces), "partners")
    named = texts.select("id", "k1", "k2", "at")
    links = scratch.table(_links(partners).join(named.hint("merge"), "id").drop("id"), "links")
    scratch.drop("segments", "pieces")
    first = partners.filter("near.at < at").groupBy("id").agg(F.min("near").alias("near"))
    texts = texts.select("id", "k1", "k2", "at", "line")
    other = texts.select(F.col("id").alias("other"), F.col("line").alias("earlier"))
    # Not broadcast: long lines of one pattern make small files but large rows.
    pairs = first.select("id", F.col("near.id").alias("other"), F.col("near.at.doc").alias("source")).join(texts.hint("merge"), "id").join(other.hint("merge"), "other")
    found = scratch.table(pairs.filter(within_edits(F.col("line"), F.col("earlier"), 1)).select("k1", "k2", "at", "source"), "near")
    scratch.drop("candidates", "partners")
    return found, links


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """(doc, version, copies, near, sources, links) of each document with lines that aren't alone: the numbers of its removed
    lines, the documents that hold the earlier ones, and its lines' links with other lines."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    at = F.struct("doc", "version", "no")
    occurrences = _occurrences(docs, id_col, text_col)
    grouped = occurrences.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.count("*").alias("n"), F.first("line").alias("line"))
    lines = scratch.table(grouped.withColumn("id", F.monotonically_increasing_id()), "lines")
    near, links = near_lines(lines, scratch) if edits == 1 else near_lines_by_length(lines, scratch, edits)
    no, none = F.lit(False).alias("near"), F.lit(None).cast(dict(near.dtypes)["source"]).alias("source")
    zero = F.lit(0).cast("long").alias("links")
    marks = lines.filter("n > 1").select("k1", "k2", "at", no, none, zero)
    marks = marks.unionAll(near.select("k1", "k2", "at", F.lit(True), "source", zero)).unionAll(links.select("k1", "k2", "at", no, none, "links"))
    touched = marks.groupBy("k1", "k2", "at").agg(F.max("near").alias("near"), F.max("source").alias("source"), F.max("links").alias("links"))
    hit = occurrences.select("doc", "version", "no", "k1", "k2").join(touched, ["k1", "k2"])
    copy = ~F.col("near") & (F.col("at") < at)
    out = hit.groupBy("doc", "version").agg(
        F.collect_set(F.when(copy, F.col("no"))).alias("copies"), F.collect_set(F.when(F.col("near"), F.col("no"))).alias("near"),
        F.array_sort(F.collect_set(F.when(copy, F.col("at.doc")).when(F.col("near"), F.col("source")))).alias("sources"), F.sum("links").alias("links"),
    )
    out = scratch.table(out, "gone")
    scratch.keep("gone")
    return out


def _deduped(docs: DataFrame, id_col: str, text_col: str, edits: int = 1) -> DataFrame:
    """(others, id, text, new, n_lines, n_copies, n_near, sources, n_links): other columns are packed, so that no name clashes."""
    gone = removals(docs, id_col, text_col, edits)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select((F.struct(*others) if others else F.lit(None).cast("int")).alias("others"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    none = F.array().cast("array<int>")
    text = F.col("text")
    # Sorted and merged at every size, as the plan for a corpus would be.
    joined = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("version")), "left")
    removed = F.concat(F.coalesce("copies", none), F.coalesce("near", none))
    # Bound to names first: an expression inside a lambda would be evaluated again for each line.
    joined = joined.withColumn("all_lines", F.split(text, "\n", -1))
    joined = joined.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), removed))
    new = F.when(text.isNull() | (F.size(removed) == 0), text).otherwise(F.array_join(F.transform("kept", lambda i: F.get(F.col("all_lines"), i)), "\n"))
    return joined.select(
        "others", "id", "text", new.alias("new"), F.coalesce(F.size("all_lines"), F.lit(0)).cast("long").alias("n_lines"), F.size(F.coalesce("copies", none)).cast("long").alias("n_copies"),
        F.size(F.coalesce("near", none)).cast("long").alias("n_near"), F.coalesce("sources", F.array().cast(dict(gone.dtypes)["sources"])).alias("sources"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def _unpacked(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.col("new").alias(c) if c == text_col else F.col("id").alias(c) if c == id_col else F.col(f"others.`{c}`").alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """The rows with their lines deduplicated, and beside the columns of ``docs`` __n_lines, __n_copies, __n_near, __sources and
    __n_links, in place of columns that have these names."""
    added = ("n_lines", "n_copies", "n_near", "sources", "n_links")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {f"__{a}" for a in added}])
    return _deduped(docs, id_col, text_col, edits).select(*_unpacked(docs, id_col, text_col), *[F.col(a).alias(f"__{a}") for a in added])


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS, edits: int = 1) -> DataFrame:
    """The rows with their lines deduplicated; a row goes if it lost lines and none of ``least`` code points is left, or none but blank ones."""
    done = _deduped(docs, id_col, text_col, edits)
    lost = F.col("n_copies") + F.col("n_near") > 0
    left = F.col("new").rlike(f"[^\n]{{{least}}}") & F.col("new").rlike(r"\S")
    return done.filter(~lost | left).select(*_unpacked(docs, id_col, text_col))
