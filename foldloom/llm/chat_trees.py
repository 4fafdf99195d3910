"""Reply trees as chats: self-joins that double their stride find every root-to-leaf path, branches are ranked by score,
and each chosen path is formatted as one conversation. DataFrame functions only.

Round k joins each row's ancestor 2 ** k steps up with that ancestor's own, so a tree of depth d takes log2(d) rounds and
each holds one slim row a turn; sums of scores ride along. Chosen paths are then enumerated from the leaves, halving the
stride. Every round is a written table. A formatted conversation is one row, so that its turns meet in one task; nothing
else is gathered.

The format: ``### role: text</turn>`` and a line feed for each turn. In roles and texts a backslash becomes two, ``###``
becomes ``\\h``, ``</turn>`` becomes ``\\e``, and in roles ``:`` becomes ``\\c``; :func:`turns_of` reads it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Marks of the template, and what stands for them inside texts.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LEARNED = "assistant"


def escaped(text: Column, marks=ESCAPES) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark, code in marks:
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescaped(text: Column, marks=ESCAPES) -> Column:
    """Pairs of backslashes part the text first, so that what is between holds codes only."""

    def plain(x: Column) -> Column:
        for mark, code in marks:
            x = F.replace(x, F.lit(code), F.lit(mark))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, COLON, 1)
        text = F.substr(x, F.length(role) + F.lit(len(COLON) + 1))
        return F.struct(unescaped(F.substr(role, F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"), unescaped(text).alias("text"))

    return F.transform(parts, turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text of the masked spans, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """``nodes``: c (not null), node, parent, score; (c, node) unique. Rows (c, branch, node, depth, branch_rank,
    branch_score) of the ``best`` branches of each c: greatest sum of scores first, then the longer, then the least leaf.

    A parent that isn't there makes its child a root. Turns on a cycle lead to no root and are in no branch.
    """
    there = nodes.select("c", F.col("node").alias("parent")).withColumn("found", F.lit(True))
    own = nodes.join(there, ["c", "parent"], "left").select("c", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth"))
    # rows that have reached their root take no part in later rounds but as ancestors
    first = written(own, "reply-0")
    active, roots = [first.where("up is not null")], first.where("up is null")
    most = first.count().bit_length() + 1  # a path has no more turns than there are: what goes on longer is on a cycle
    while len(active) < most and not active[-1].isEmpty():
        now = active[-1]
        above = now.union(roots).select("c", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("steps"))
        step = now.join(above, ["c", "up"]).select("c", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), F.least(F.col("depth") + F.col("steps"), F.lit(1 << 61)).alias("depth"))
        step = written(step, f"reply-{len(active)}")
        active.append(step.where("up is not null"))
        roots = roots.union(step.where("up is null"))
    leaves = roots.join(active[0].select("c", F.col("up").alias("node")).distinct(), ["c", "node"], "left_anti")
    order = Window.partitionBy("c").orderBy(F.desc("total"), F.desc("depth"), "node")
    chosen = leaves.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= best)
    rows = chosen.select("c", F.col("node").alias("branch"), "node", F.col("depth").alias("steps"), "depth", "branch_rank", F.col("total").alias("branch_score"))
    for k in reversed(range(len(active) - 1)):
        stride = 1 << k
        rows = written(rows, f"reply-path-{k}")
        up = active[k].select("c", "node", "up")
        above = rows.where(F.col("steps") > stride).join(up, ["c", "node"]).select("c", "branch", F.col("up").alias("node"), (F.col("steps") - stride).alias("steps"), (F.col("depth") - stride).alias("depth"), "branch_rank", "branch_score")
        rows = rows.withColumn("steps", F.least("steps", F.lit(stride).cast("long"))).union(above)
    return rows.drop("steps")


def formatted(nodes: DataFrame, conv: str = "conv_id", best: int = 1, learned: str = LEARNED) -> DataFrame:
    """``nodes``: ``conv``, node, parent, score, role, text. Per chosen branch: ``conv``, branch_rank, branch_score, formatted,
    and loss_spans: array<struct<start, end>> of code points that hold ``learned``'s texts.

    Null texts and roles count as empty. Rows without a ``conv`` make up one conversation with a null one. Rows that repeat
    (conv, node) must be told apart beforehand: see :func:`chain`. An empty table gives an empty result.
    """
    null = F.col(conv).isNull()
    c = F.struct(null.alias("null"), F.coalesce(F.col(conv), F.lit(0)).cast("long").alias("id"))
    slim = nodes.select(c.alias("c"), "node", "parent", F.col("score").cast("double").alias("score"))
    role, text = escaped(F.col("role"), ROLE_ESCAPES), escaped(F.col("text"))
    texts = nodes.select(c.alias("c"), "node", F.concat(F.lit(OPEN), role, F.lit(COLON)).alias("head"), text.alias("body"), F.coalesce(F.col("role") == learned, F.lit(False)).alias("learned"))
    rows = paths(slim, best).join(texts, ["c", "node"])
    size = F.length("head") + F.length("body") + len(CLOSE)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("c", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), (F.col("before") + F.length("head")).alias("start"), (F.col("before") + F.length("head") + F.length("body")).alias("end"), "learned")
    out = rows.withColumn("before", before).groupBy("c", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return out.select(F.when(~F.col("c.null"), F.col("c.id")).alias(conv), "branch_rank", "branch_score", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of ``conv``, ``turn``, role and text as trees of one branch each, in order of turn; rows of one turn follow each
    other by role and text, equal ones each on their own."""
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(conv, "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
