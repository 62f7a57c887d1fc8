"""Chat formatting of reply trees.

Messages point to their parent. Iterative self-joins with doubling jumps find each node's distance to its
root and the score on the way; a tree's leaves are ranked by mean score, then length, then id; the chosen
leaves' paths are unrolled by the same jumps, so that a path of n turns takes log2(n) joins. A path
becomes one conversation::

    <|im_start|>role\\ntext<|im_end|>\\n ...

Inside roles and texts "&" is written "&amp;" and "<|" is written "&lt;|" (and in roles a line feed
"&#10;"), so no text can open or close a turn, and reading back restores it.

Defined cases: rows that repeat a tree's node are one message, the least by parent, role, text and score; other columns are not
read; a conversation is one row, so its text may have 2 GB at most; a null role or text is empty; a null score is 0; a parent that isn't in its tree makes its
child a root; messages that hang on a cycle of parents have no root and form no path; rows without a tree
or node id belong to no conversation; ties of rank go to the smaller leaf id; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(s: str) -> str:
    return s.replace("&lt;|", "<|").replace("&#10;", "\n").replace("&amp;", "&")


def chain(turns: DataFrame, tree_col: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Conversations by turn as trees: each message answers the one before."""
    w = W.partitionBy(tree_col).orderBy(*order)
    rows = turns.filter(F.col(tree_col).isNotNull()).select(F.col(tree_col).alias("tree"), F.row_number().over(w).cast("long").alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _once(messages: DataFrame) -> DataFrame:
    """One row a (tree, node): the least of those that repeat it."""
    rest = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return messages.filter("tree is not null and node is not null").groupBy("tree", "node").agg(rest).select("tree", "node", "m.*")


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, path, depth, node): the nodes of the best ``paths`` root-to-leaf paths of each tree."""
    scratch = Scratch(messages.sparkSession, "reply-trees")
    nodes = scratch.table(_once(messages).select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    known = nodes.select(F.col("tree").alias("__t"), F.col("node").alias("__n"))
    start = nodes.join(known, (F.col("tree") == F.col("__t")) & (F.col("parent") == F.col("__n")), "left")
    start = scratch.table(start.select("tree", "node", F.col("__n").alias("up"), F.lit(1).cast("long").alias("hops"), "score"), "jumps-0")
    # Nodes that have reached their root are set aside; only the others jump again.
    done, active = [start.filter("up is null")], start.filter("up is not null")
    jumps: list[DataFrame] = []
    rounds = math.ceil(math.log2(max(nodes.count(), 2))) + 1
    while len(jumps) < rounds and active.limit(1).count():
        jumps.append(active.select("tree", "node", "up"))
        now = functools.reduce(DataFrame.unionByName, done, active)
        far = now.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("hops").alias("__hops"), F.col("score").alias("__score"))
        moved = active.join(far, (F.col("tree") == F.col("__t")) & (F.col("up") == F.col("__n"))).select(
            "tree", "node", F.col("__up").alias("up"), (F.col("hops") + F.col("__hops")).alias("hops"), (F.col("score") + F.col("__score")).alias("score")
        )
        moved = scratch.table(moved, f"jumps-{len(jumps)}")
        done.append(moved.filter("up is null"))
        active = moved.filter("up is not null")
    parents = nodes.filter("parent is not null").select(F.col("tree").alias("__t"), F.col("parent").alias("__n"))
    leaves = functools.reduce(DataFrame.unionByName, done).join(parents, (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__n")), "left_anti")
    rank = W.partitionBy("tree").orderBy((F.col("score") / F.col("hops")).desc(), F.col("hops").desc(), "node")
    chosen = leaves.withColumn("path", F.row_number().over(rank)).filter(F.col("path") <= paths)
    found = chosen.select("tree", "path", "node", (F.col("hops") - 1).alias("depth"))
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("up").alias("__up"))
        above = found.join(step, (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__n"))).select("tree", "path", F.col("__up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        found = scratch.table(found.unionByName(above), f"paths-{k}")
    found = scratch.table(found, "paths")
    scratch.keep("paths")
    return found


def format_paths(messages: DataFrame, paths: int = 1, train_on: str = "assistant") -> DataFrame:
    """(tree, path, n_turns, formatted, loss): one conversation a chosen path; ``loss`` has the code point spans to train on."""
    nodes = best_paths(messages, paths)
    texts = _once(messages).select(F.col("tree").alias("__t"), F.col("node").alias("__n"), "role", "text")
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = nodes.join(texts, (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__n"))).select(
        "tree", "path", "depth", head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").eqNullSafe(F.lit(train_on)).alias("train")
    )
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = F.sum(size.cast("long")).over(W.partitionBy("tree", "path").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)) - size
    start = before + F.length("head")
    rows = rows.select("tree", "path", "depth", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "train", start.alias("start"), (start + F.length("body")).alias("end"))
    turns = F.sort_array(F.collect_list(F.struct("depth", "piece", "train", "start", "end")))
    grouped = rows.groupBy("tree", "path").agg(turns.alias("turns"))
    return grouped.select(
        "tree", "path", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["train"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"),
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, text = part.removesuffix(CLOSE).partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def digests(conversations: DataFrame) -> DataFrame:
    """What reading the output back gives, as digests."""

    def rows(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for tree, text, spans in zip(b["tree"], b["formatted"], b["loss"]):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out["conv_id"].append(tree)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield out

    kind = dict(conversations.dtypes)["tree"]
    return map_arrow(conversations.select("tree", "formatted", "loss"), rows, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
