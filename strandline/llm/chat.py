"""Reply trees: root-to-leaf paths, ranked and formatted as conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.llm.support import cut, table, with_running_totals

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that a chat template may give a meaning to; inside roles and texts they are replaced by a backslash and a digit.
CONTROLS = ["\\", "<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    """Reversible: the backslash goes first, so afterwards every backslash is followed by a code."""
    for i, control in enumerate(CONTROLS):
        text = F.replace(text, F.lit(control), F.lit(f"\\{i}"))
    return text


def unescape(text: Column) -> Column:
    for i, control in reversed(list(enumerate(CONTROLS))):
        text = F.replace(text, F.lit(f"\\{i}"), F.lit(control))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def reply_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees. ``nodes``: tree, node, parent, score. Returns tree, leaf, rank, pos, node.

    Self joins by doubling: after step k every node knows its ancestor 2^k replies up, so the number of joins is the
    logarithm of the longest path. Branches are ranked within their tree by the sum of scores along the path, the
    highest first, ties by leaf; ``top`` of them stay (None: all). The paths are then enumerated from their leaves
    through the same jumps, each position once. Joins carry keys only.

    A parent that isn't in the tree makes its reply a root. Replies on or under a cycle have no root and are left out.
    Null score counts 0. ``(tree, node)`` has to be unique and ``tree`` not null (wrap it in a struct otherwise).
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = cut(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    parents = up.filter("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = up.join(parents, ["tree", "node"], "left_anti").select("tree", "node")
    # done: replies whose root is known; active: the others, each with its ancestor 2^k replies up
    done, active = up.filter("up IS NULL"), up.filter("up IS NOT NULL")
    jumps, open_ = [], active.count()
    while open_:
        jumps.append(active.select("tree", "node", "up"))
        above = done.unionByName(active).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("more"))
        both = cut(active.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("more")).alias("score")))
        done, active = done.unionByName(both.filter("up IS NULL")), both.filter("up IS NOT NULL")
        before, open_ = open_, active.count()
        if open_ == before:  # what is left hangs on cycles
            break
    ends = leaves.join(done, ["tree", "node"])
    ends = ends.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "node")))
    if top is not None:
        ends = ends.filter(F.col("rank") <= top)
    paths = ends.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).alias("back"))
    for k, jump in reversed(list(enumerate(jumps))):
        further = paths.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("back") + F.lit(1 << k)).alias("back"))
        paths = cut(paths.unionByName(further))
    return paths.select("tree", "leaf", "rank", (-F.col("back")).alias("pos"), "node")


def format_paths(nodes: DataFrame, top: int | None = 1, trained: str = "assistant") -> DataFrame:
    """One conversation per chosen path. ``nodes``: tree, node, parent, score, role, text.

    Returns tree, leaf, rank, ``formatted`` and ``loss``: for each turn the (start, length) in code points of what
    ``formatted`` has under the loss mask, of length 0 where the role isn't ``trained``. Null text or role is empty.
    """
    paths = reply_paths(nodes.select("tree", "node", "parent", "score"), top)
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turns = nodes.select("tree", "node", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role") == trained, F.lit(False)).alias("loss"))
    turns = turns.select("tree", "node", F.concat("head", "body", F.lit(END)).alias("turn"), F.length("head").alias("skip"), F.when(F.col("loss"), F.length("body")).otherwise(0).alias("n"))
    each = paths.join(turns, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "skip", "n"))).alias("turns"))
    each = each.withColumn("lengths", F.transform("turns", lambda t: F.length(t["turn"]).cast("long")))
    each = with_running_totals(each, "lengths", "ends")
    loss = F.zip_with("turns", F.arrays_zip("ends", "lengths"), lambda t, e: F.struct((e["ends"] - e["lengths"] + t["skip"]).alias("start"), t["n"].cast("long").alias("length")))
    return each.select("tree", "leaf", "rank", F.array_join(F.col("turns.turn"), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``under_loss`` (all text under the mask, unescaped), from ``formatted`` and ``loss``."""
    pieces = F.split("formatted", F.lit(END.replace("|", "\\|")), -1)
    df = formatted.withColumn("_p", pieces).withColumn("_p", F.slice("_p", 1, F.size("_p") - 1))
    df = df.withColumn("_steps", F.transform("_p", lambda p: (F.length(p) + len(END)).cast("long")))
    df = with_running_totals(df, "_steps", "_ends")
    begin = lambda i: F.get("_ends", i) - F.get("_steps", i)
    under = lambda p, i: F.substring(p, (F.get("loss", i)["start"] - begin(i) + 1).cast("int"), F.get("loss", i)["length"].cast("int"))
    role = lambda p: F.substring_index(F.substring(p, len(START) + 1, F.length(p)), "\n", 1)
    text = lambda p: F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))
    turns = F.transform("_p", lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(text(p)).alias("text")))
    return df.withColumn("turns", turns).withColumn("under_loss", F.array_join(F.transform("_p", lambda p, i: unescape(under(p, i))), "")).drop("_p", "_steps", "_ends")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a tree whose replies follow one another by turn; rows with the same turn by role, then text.

    Null text or role is empty; rows without a conv_id are one conversation; rows that repeat are turns of their own.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    order = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    nodes = rows.unionByName(extra).withColumn("node", order)
    # ordered once: the joins of keys and the texts come from the same table
    nodes = cut(nodes.select(F.struct("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"))
    found = read_back(format_paths(nodes))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select(
        F.col("tree.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest(spoken).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        digest(F.col("under_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\0'), '<|', '\1'), '|>', '\2'), '</s>', '\3'), '<s>', '\4'), '[INST]', '\5'), '[/INST]', '\6') AS t,
         replace(replace(replace(replace(replace(replace(replace(replace(role, '\', '\0'), '<|', '\1'), '|>', '\2'), '</s>', '\3'), '<s>', '\4'), '[INST]', '\5'), '[/INST]', '\6'), chr(10), '\n') AS r
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
