"""Chat formatting over reply trees, in DataFrame functions only.

A reply tree is a table of messages with a parent each. ``reply_paths`` enumerates the path from
each leaf up to its root by joining the table with itself: after round k a pointer skips 2^k
parents, so that paths of length n take log2(n) rounds and the joins carry ids only, never texts.
``rank_branches`` orders the leaves of a tree by the mean score of their path, and
``format_conversations`` writes every chosen path as one string.

Template: each turn is ``<s>[INST]`` role ``[/INST]`` text ``</s>``. A control string inside a role or
a text gets a backslash after its first character (one more where it has some already), which
reading takes away again; hence every text can be read back from the output.

Defined results: null text or role counts as empty; rows without an id group as one tree; a
parent that is not in the table makes its child a root; a cycle raises ``ValueError``; an empty table
gives an empty result; ties in order are settled by role and text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

TURN, ROLE_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"
_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\])"
_UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def reply_paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree_id, leaf_id, message_id, dist): each leaf with all its ancestors, itself at dist 0.

    ``messages`` has tree_id, message_id and parent_id (null at a root), message_id unique in a tree.
    """
    nodes = messages.select("tree_id", "message_id", "parent_id")
    known = nodes.select("tree_id", F.col("message_id").alias("parent_id"))
    jump = scratch.write(nodes.join(known, ["tree_id", "parent_id"]).select("tree_id", "message_id", F.col("parent_id").alias("above")), "jump0")
    parents = jump.select("tree_id", F.col("above").alias("message_id"))
    start = nodes.join(parents, ["tree_id", "message_id"], "left_anti").select("tree_id", F.col("message_id").alias("leaf_id"), "message_id", F.lit(0).cast("long").alias("dist"))
    scratch.append(start, "paths")
    paths = scratch.read("paths", start.schema)
    total = None
    k = 0
    while not jump.isEmpty():
        step = paths.join(jump, ["tree_id", "message_id"]).select("tree_id", "leaf_id", F.col("above").alias("message_id"), (F.col("dist") + (1 << k)).alias("dist"))
        scratch.append(scratch.write(step, f"step{k}"), "paths")
        paths = scratch.read("paths", start.schema)
        far = jump.select("tree_id", F.col("message_id").alias("above"), F.col("above").alias("top"))
        jump = scratch.write(jump.join(far, ["tree_id", "above"]).select("tree_id", "message_id", F.col("top").alias("above")), f"jump{k + 1}")
        scratch.drop(f"jump{k}")
        scratch.drop(f"step{k}")
        k += 1
        if k > 6:
            total = nodes.count() if total is None else total
            if 1 << (k - 1) > total:
                raise ValueError("the reply graph has a cycle")
    return paths


def rank_branches(paths: DataFrame, scores: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, branch_score, branch_rank); rank 1 has the best mean score, ties by leaf."""
    branch = paths.join(scores, ["tree_id", "message_id"]).groupBy("tree_id", "leaf_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    order = Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf_id")
    return branch.withColumn("branch_rank", F.row_number().over(order))


def format_conversations(messages: DataFrame, top_k: int | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each chosen root-to-leaf path: tree_id, leaf_id, branch_rank, formatted, loss_spans.

    ``messages``: tree_id, message_id, parent_id, role, text, and score where branches compete.
    ``top_k``: paths for each tree, best first; all where it is None. ``loss_spans``: half-open ranges of
    code points of ``formatted`` that are trained on, one for each turn of ``loss_roles``.
    A conversation is one output value, so that one of them has to fit in a task.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    score = F.col("score").cast("double") if "score" in messages.columns else F.lit(None).cast("double")
    messages = scratch.write(messages.select("tree_id", "message_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), score.alias("score")), "messages")
    paths = reply_paths(messages, scratch)
    ranks = rank_branches(paths, messages.select("tree_id", "message_id", "score"))
    if top_k is not None:
        ranks = ranks.where(F.col("branch_rank") <= top_k)
    opening = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    turns = messages.select("tree_id", "message_id", F.concat(opening, body, F.lit(TURN_END)).alias("piece"), F.length(opening).cast("long").alias("head"), F.length(body).cast("long").alias("body"), F.col("role").isin(*loss_roles).alias("loss"))
    path = Window.partitionBy("tree_id", "leaf_id").orderBy(F.desc("dist"))
    size = F.col("head") + F.col("body") + len(TURN_END)
    placed = paths.join(turns, ["tree_id", "message_id"]).withColumn("start", F.sum(size).over(path) - size)
    whole = placed.groupBy("tree_id", "leaf_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "piece", "start", "head", "body", "loss"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct((t["start"] + t["head"]).alias("begin"), (t["start"] + t["head"] + t["body"]).alias("end")))
    whole = whole.select("tree_id", "leaf_id", F.array_join(F.col("turns.piece"), "").alias("formatted"), spans.alias("loss_spans"))
    return whole.join(ranks, ["tree_id", "leaf_id"])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, TURN_END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = F.lit(len(TURN) + 1)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, ROLE_END)
        role = F.substring(piece, head, cut - head)
        text = F.substring(piece, cut + len(ROLE_END), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees without branches: each turn answers the one before it."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    order = Window.partitionBy("tree_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    at = conversations.select(tree.alias("tree_id"), "turn", "role", "text").withColumn("message_id", F.row_number().over(order).cast("long"))
    return at.select("tree_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    formatted = format_conversations(conversation_messages(rows.unionByName(probe)))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"]))), "")
    turns = formatted.select(F.col("tree_id").try_cast("long").alias("conv_id"), read_turns(F.col("formatted")).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("loss_spans").cast("long").alias("loss_spans"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "loss_spans",
    )


OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IS NULL AS no_role, text IS NULL AS no_text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', false, false
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', false, false
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, NOT no_role, role, NOT no_text, text) AS k,
    len(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + len(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 20 AS chars
  FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  len(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS loss_spans
FROM n GROUP BY conv_id
"""
