"""Chat formatting of reply trees, all in DataFrame functions.

Messages name their parent. Paths from each leaf to its root are enumerated by self-joins that double the distance covered
in each round, so a tree of depth d takes about log2(d) rounds. A branch's rank among its tree's leaves is by the score of its
path, best first. Each chosen path becomes one conversation.

Template: `<turn role>\\n text </turn>\\n` for each turn, with `\\`, `<` and `>` inside roles and texts written as `\\b`, `\\l`
and `\\g`; so no text can hold a control string and every text can be read back. The loss mask is a list of spans (start and
length in code points) of the texts whose role is trained on.

Defined results: a null text or role is empty; a message whose parent isn't in its tree is a root; a message that is its own
ancestor, or below one, has no root and gives no path; messages with a null tree_id (turns with a null conv_id) are one tree;
repeated turns are told apart by their order (turn, role, text); ties of score go to the smaller leaf_id. Very long texts are
escaped and read back whole; a conversation is one string, so all its turns meet in one row. Rows that repeat a message's id in
its tree are one message, the first of them by parent_id, role, text and score (nulls first), so that a path never holds an id
twice; messages without an id take no part. Only the named columns are read, whatever others are called. No rows, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, stored, table

LOSS_ROLES = ("assistant",)
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def one_each(messages: DataFrame) -> DataFrame:
    """messages(tree_id, id, parent_id, role, text, score) with one row for each id of a tree."""
    first = F.min(F.struct("parent_id", "role", "text", "score")).alias("first")
    return messages.where(F.col("id").isNotNull()).groupBy("tree_id", "id").agg(first).select("tree_id", "id", "first.*")


def paths(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, up, id) for every message `up` steps above a leaf, for leaves that reach a root.
    messages(tree_id, id, parent_id), an id once in a tree (see `one_each`). Each of the jumps holds for each message the one 2 ** k steps above it. Trees are joined
    by struct(tree_id), which is never null, so that messages without a tree_id are a tree too. All joins are merges: both sides grow
    with the messages, and broadcasts of every round would gather in the driver."""
    m = messages.select(F.struct("tree_id").alias("tree"), "id", "parent_id")
    jump = m.join(m.select("tree", F.col("id").alias("parent_id")).hint("merge"), ["tree", "parent_id"], "left_semi").select("tree", "id", F.col("parent_id").alias("above"))
    jumps = [stored(spark, jump, "jump")]
    left = [jumps[0].select("tree", "id").distinct().count()]
    # messages with 2 ** k above them: if there are as many for the next k, no chain ends between the two, and theirs never do
    while left[-1] and (len(left) < 2 or left[-1] < left[-2]):
        j = jumps[-1]
        jumps.append(stored(spark, j.join(j.select("tree", F.col("id").alias("above"), F.col("above").alias("a2")).hint("merge"), ["tree", "above"]).select("tree", "id", F.col("a2").alias("above")), "jump"))
        left.append(jumps[-1].select("tree", "id").distinct().count())
    leaves = m.join(jumps[0].select("tree", F.col("above").alias("id")).distinct().hint("merge"), ["tree", "id"], "left_anti")
    if left[-1]:
        leaves = leaves.join(jumps[-1].select("tree", "id").distinct().hint("merge"), ["tree", "id"], "left_anti")
    found = stored(spark, leaves.select("tree", F.col("id").alias("leaf_id"), F.lit(0).cast("long").alias("up"), "id"), "paths")
    for k, jump in enumerate(jumps):
        more = found.join(jump.hint("merge"), ["tree", "id"]).select("tree", "leaf_id", (F.col("up") + (1 << k)).alias("up"), F.col("above").alias("id"))
        longer = stored(spark, found.unionByName(more), "paths")
        dropped(spark, found, jump)
        found = longer
    return found.select("tree.tree_id", "leaf_id", "up", "id")


def branches(spark: SparkSession, messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, branch, turns): one row for each path, with branch 1 the best by mean score (ties: smallest leaf_id)
    and turns = array of (role, text) from the root. messages(tree_id, id, parent_id, role, text, score); best: how many
    branches of a tree to keep, all by default."""
    messages = stored(spark, one_each(messages), "messages")
    on = paths(spark, messages).select(F.struct("tree_id").alias("tree"), "leaf_id", "up", "id").join(messages.select(F.struct("tree_id").alias("tree"), "id", "role", "text", "score").hint("merge"), ["tree", "id"]).withColumn("tree_id", F.col("tree.tree_id"))
    whole = on.groupBy("tree_id", "leaf_id").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
    )
    ranked = whole.withColumn("branch", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")))
    return ranked if best is None else ranked.where(F.col("branch") <= best)


def formatted(chosen: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """chosen with `formatted` (the whole conversation) and `loss` (array of (start, length), starts from 0)."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("trained")))
    step = chosen.withColumn("c_pieces", pieces)
    close = "</turn>\n"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(state, p):
        start, size = state["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        return F.struct((start + size + len(close)).alias("at"), F.when(p["trained"], F.array_append(state["spans"], F.struct(start.alias("start"), size.alias("length")))).otherwise(state["spans"]).alias("spans"))

    return step.withColumn("formatted", F.array_join(F.transform("c_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(close))), "")).withColumn("loss", F.aggregate("c_pieces", zero, add)["spans"]).drop("c_pieces")


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(text, "</turn>\n", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(unescape(F.regexp_extract(x, "^<turn ([^>]*)>\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, ">\n") + 2)).alias("text")))


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))


def linear(turns: DataFrame) -> DataFrame:
    """Turn tables as reply trees of one branch: each row's parent is the row before it in its conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return turns.select(F.col("conv_id").alias("tree_id"), at.alias("id"), F.when(at > 1, at - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = formatted(branches(spark, linear(rows), best=1)).withColumn("turns", read_back(F.col("formatted"))).withColumn("masked", masked(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = """WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(role) + 16 + (length(text || role) - length(translate(text || role, '\\<>', '')))) ::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""
