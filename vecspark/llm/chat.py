"""Chat formatting from reply trees, in DataFrame expressions only.

A tree's root-to-leaf paths come from self-joins that double their reach: round k finds each message's ancestor 2^k above.
Branches are ranked by the sum of their messages' scores, and each chosen path becomes one conversation:

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text</s> ...

Control strings inside roles and texts get a backslash after their first character, and each backslash is doubled, so no
control string is left there and undoing it gives the text back. Only texts of the assistant are under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.common import checkpointed, table

#: Fixed values of the template.
BEGIN, END, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"<(/?s>)", r"<\\$1"), r"\[(/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def enumerate_paths(nodes: DataFrame) -> DataFrame:
    """nodes: tree, node, parent (null at a root), unique by tree and node. Returns (tree, leaf, node, above): every message
    of every root-to-leaf path, and how far above the leaf it stands.

    A parent that isn't there makes its child a root. There are as many rounds of joins as the logarithm of the longest
    path, all keyed by single messages, so one tree with most of the rows is spread over all tasks. Messages of a cycle, and
    those that reply to one however far away, have no root and are in no path.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    links = nodes.where(F.col("parent").isNotNull()).select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi")
    up = checkpointed(links.select("tree", "node", F.col("parent").alias("to")))
    longest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels = []
    while not up.isEmpty():
        if 1 << len(levels) >= longest:  # farther up than there are messages
            return enumerate_paths(checkpointed(nodes.join(up.select("tree", "node").distinct(), ["tree", "node"], "left_anti")))
        levels.append(up)
        further = up.select("tree", F.col("node").alias("to"), F.col("to").alias("_to"))
        up = checkpointed(up.join(further, ["tree", "to"]).select("tree", "node", F.col("_to").alias("to")))
    parents = links.select("tree", F.col("parent").alias("node")).distinct()
    paths = nodes.select("tree", "node").join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k in range(len(levels) - 1, -1, -1):
        stay = F.struct("node", "above")
        jump = F.struct(F.col("to").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        both = F.explode(F.when(F.col("to").isNull(), F.array(stay)).otherwise(F.array(stay, jump))).alias("_x")
        paths = paths.join(levels[k], ["tree", "node"], "left").select("tree", "leaf", both).select("tree", "leaf", "_x.*")
    return paths


def format_chats(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """messages: tree string, node long, parent long, role, text, score. Returns a row for each of the `best` paths of each
    tree (None: all): tree, leaf, rank int, score, n_turns long, formatted string, loss array of (start, end).

    loss: spans of code points in formatted. A null role, text or score is empty or zero. Ranks go by score, then by the
    smaller leaf. A tree is one row of output for each chosen path, and is gathered for no other purpose. Of rows that share
    tree and node the least counts, by parent, role, text and score; rows without a tree or node don't. Messages of cycles
    are in no path.
    """
    one = F.min(F.struct("parent", "role", "text", "score")).alias("_m")
    messages = checkpointed(messages.where(F.col("tree").isNotNull() & F.col("node").isNotNull()).groupBy("tree", "node").agg(one).select("tree", "node", "_m.*"))
    full = enumerate_paths(messages).join(messages, ["tree", "node"])
    turns = full.select("tree", "leaf", "above", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if best is not None:
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        ranked = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        turns = turns.join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT))
    parts = turns.select("tree", "leaf", "above", "score", (F.col("role") == TRAINED).alias("trained"), head.alias("head"), escape(F.col("text")).alias("body"))
    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("above"))
    length = F.length("head") + F.length("body") + len(END)
    placed = parts.withColumn("end", len(BEGIN) + F.sum(length).over(so_far) - len(END))
    turn = F.struct((-F.col("above")).alias("at"), F.concat("head", "body", F.lit(END)).alias("turn"), "trained", (F.col("end") - F.length("body")).alias("start"), "end")
    rows = placed.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t.turn), ""))
    loss = F.transform(F.filter("turns", lambda t: t.trained), lambda t: F.struct(t.start.alias("start"), t.end.alias("end")))
    out = rows.select("tree", "leaf", "score", "n_turns", formatted.alias("formatted"), loss.alias("loss"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    turns = F.split(F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted)), END)
    parts = F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.split(t, r"\[/INST\]", 2))
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(p[0], F.lit(len(ROLE) + 1), F.length(p[0]))).alias("role"), unescape(p[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, (s.end - s.start).cast("int")))), "")


def reply_chains(turns: DataFrame) -> DataFrame:
    """Messages of conversations whose every turn replies to the one before: the reply tree of conv_id, turn, role, text.

    Turns that tie are taken by role and text. A null conv_id is a conversation of its own.
    """
    tree = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    numbered = turns.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", place)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one more, formatted and read back."""
    more = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    chats = format_chats(reply_chains(turns))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    read = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    back = chats.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("trained"))
    conv_id = F.when(F.col("tree") != "", F.substring("tree", 2, 40)).cast("long")
    return back.select(conv_id.alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), digest(read).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), digest(F.col("trained")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_EXTRA = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{s}', ''))) // {len(s)}" for s in ("\\", BEGIN, END, ROLE, TEXT))
OP3_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
    ({len(BEGIN)} + sum({len(ROLE) + len(TEXT) + len(END)} + length(role) + {_EXTRA.format("role")} + length(text) + {_EXTRA.format("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
