"""Chat formatting (operator 2): reply trees, ranked branches and a reversible template.

Messages form trees by parent id. Iterative self-joins by pointer doubling
give every message its root and its ancestors at distances 1, 2, 4, ..., so a path of n
messages needs log2(n) joins; the same pointers sum the scores of whole
root-to-leaf paths. The branches of each tree are ranked by score (ties: smallest leaf), and the
messages of each chosen path are gathered and formatted as one conversation.

Template, for each turn: ``<|role|>`` newline text ``<|end|>`` newline. Inside roles and
texts ``~`` becomes ``~0``, ``<`` ``~1`` and ``[`` ``~2`` (in roles ``|`` ``~3`` too), so no
control string of this or of bracketed templates survives inside a text, and
``parse`` gives the turns back exactly. The loss mask lists the spans of the
assistant's texts in the formatted string; their starts are running sums over the turns, and
they are read from chunks of the string, so that all work grows in proportion to its length.

Everything is DataFrame expressions; no Python runs on executors.

Defined cases: null text and role are empty; a null conversation id is one
conversation; a message whose parent is missing is a root; a conversation with several roots is several trees;
of repeated message ids the least row stays (no parent first, then by parent, score, role, text); messages without an id are left out;
repeated turns of the query's table all stay, ordered
by turn (nulls first), role and text; a cycle of replies is an error, found after as many doublings as the
longest conversation could need; extra columns are ignored; an empty table gives no conversation but those added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentloom.llm.common import blank, materialize, table

END = "<|end|>\n"
#: Characters of a chunk of a formatted string, from which spans are read.
CHUNK = 1024


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))
    return F.replace(out, F.lit("|"), F.lit("~3")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("~3"), F.lit("|")), F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<"))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """messages (conv, msg, parent, score) -> tables of (conv, msg, up) for distances 1, 2, 4, ...,
    and (conv, msg, root, depth, total) of whole paths from the root."""
    parents = messages.select(F.col("conv").alias("_c"), F.col("msg").alias("_m"))
    joined = messages.join(parents, (F.col("parent") == F.col("_m")) & (F.col("conv") == F.col("_c")), "left")
    first = joined.select("conv", "msg", F.col("_m").alias("up"), F.when(F.col("_m").isNull(), F.col("msg")).alias("root"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("total"))
    state = materialize(first, "reply_state")
    most = state.groupBy("conv").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    jumps = []
    for _ in range(math.ceil(math.log2(most)) + 1 if most else 0):
        going = state.where("up is not null")
        if going.isEmpty():
            break
        jumps.append(going.select("conv", "msg", "up"))
        there = state.select(F.col("conv").alias("_c"), F.col("msg").alias("_m"), F.col("up").alias("_up"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("total").alias("_t"))
        pair = going.join(there, (F.col("up") == F.col("_m")) & (F.col("conv") == F.col("_c")))
        moved = pair.select("conv", "msg", F.col("_up").alias("up"), F.col("_r").alias("root"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_t")).alias("total"))
        state = materialize(moved.unionByName(state.where("up is null")), "reply_state")
    if not state.where("up is not null").isEmpty():
        raise ValueError("a cycle of replies")
    return jumps, state


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The messages of the best `branches` root-to-leaf paths of each tree: (conv, root, leaf, rank, branch_score, msg, back).

    Ids are distinct in each conversation. A path's score is the mean of its messages' scores; back counts from the leaf.
    """
    jumps, state = ancestors(messages)
    inner = messages.select(F.col("conv").alias("_c"), F.col("parent").alias("_m")).where("_m is not null").distinct()
    leaves = state.join(inner, (F.col("conv") == F.col("_c")) & (F.col("msg") == F.col("_m")), "left_anti")
    scored = leaves.select("conv", "root", F.col("msg").alias("leaf"), (F.col("total") / F.col("depth")).alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("conv", "root").orderBy(F.desc("branch_score"), "leaf"))
    path = scored.withColumn("rank", rank).where(F.col("rank") <= branches).withColumn("msg", F.col("leaf")).withColumn("back", F.lit(0).cast("long"))
    path = materialize(path, "reply_paths")
    for k, jump in enumerate(jumps):
        step = jump.select(F.col("conv").alias("_c"), F.col("msg").alias("_m"), F.col("up").alias("_up"))
        more = path.join(step, (F.col("conv") == F.col("_c")) & (F.col("msg") == F.col("_m")))
        # written in each step: the path stands on both sides of the union, so plans would double
        path = materialize(path.unionByName(more.select("conv", "root", "leaf", "branch_score", "rank", F.col("_up").alias("msg"), (F.col("back") + (1 << k)).alias("back"))), "reply_paths")
    return path


def formatted(paths: DataFrame) -> DataFrame:
    """Paths (conv, leaf, back) with role and text -> one row a path: (conv, leaf, formatted, loss_spans (start from 0, length))."""
    head = F.concat(F.lit("<|"), escape(blank(F.col("role")), role=True), F.lit("|>\n"))
    cut = paths.select("conv", "leaf", "back", (F.col("role") == "assistant").alias("_loss"), head.alias("_head"), escape(blank(F.col("text"))).alias("_body"))
    cut = cut.withColumn("_h", F.char_length("_head").cast("long")).withColumn("_n", F.char_length("_body").cast("long"))
    order = Window.partitionBy("conv", "leaf").orderBy(F.desc("back"))
    ahead = F.coalesce(F.sum(F.col("_h") + F.col("_n") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    turn = F.struct((-F.col("back")).alias("at"), (F.col("_start") + F.col("_h")).alias("start"), F.col("_n").alias("length"), "_loss", F.concat("_head", "_body", F.lit(END)).alias("piece"))
    rows = cut.withColumn("_start", ahead).groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("_p"))
    spans = F.transform(F.filter("_p", lambda p: p["_loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return rows.select("conv", "leaf", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def spans_of(text: Column, spans: Column) -> Column:
    """The strings under spans (start from 0, length) of text. A span is read from the chunks it touches, not from the start of the text."""
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))

    def piece(c: Column, s: Column) -> Column:
        first = F.floor(s["start"] / CHUNK).cast("int")
        last = F.floor((s["start"] + s["length"] - 1) / CHUNK).cast("int")
        near = F.array_join(F.slice(c, first + 1, last - first + 1), "")
        return F.when(s["length"] > 0, F.substring(near, (s["start"] - first * CHUNK + 1).cast("int"), s["length"].cast("int"))).otherwise("")

    # an array of one binds the chunks once; as a plain column they would be cut anew for each span
    return F.transform(F.array(chunks), lambda c: F.transform(spans, lambda s: piece(c, s)))[0]


def parse(chats: DataFrame) -> DataFrame:
    """chats with turns (role, text), read back from `formatted`, and loss_text, all text under the mask."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    cut = lambda x: F.instr(x, "|>\n")
    turn = lambda x: F.struct(unescape(F.substring(x, F.lit(3), cut(x) - 3)).alias("role"), unescape(F.substring(x, cut(x) + 3, F.char_length(x))).alias("text"))
    loss = F.transform(spans_of(F.col("formatted"), F.col("loss_spans")), unescape)
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(loss, ""))


def single_ids(messages: DataFrame) -> DataFrame:
    """One row of each message id of a conversation; rows without an id go."""
    whole = F.struct(F.col("parent").isNotNull().alias("_reply"), "parent", "score", "role", "text")
    some = messages.where("msg is not null").groupBy("conv", "msg").agg(F.min(whole).alias("_one"))
    return some.select("conv", "msg", "_one.parent", "_one.score", "_one.role", "_one.text")


def linear(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each replying to the one before."""
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    keyed = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "turn", "role", "text")
    numbered = keyed.withColumn("msg", F.row_number().over(order).cast("long"))
    return numbered.withColumn("parent", F.when(F.col("msg") > 1, F.col("msg") - 1)).withColumn("score", F.lit(1.0))


def format_chats(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """messages (conv, msg, parent, score, role, text) -> the chosen paths as formatted conversations.

    unique: whether ids are known to be distinct and never null, so that repeated ones need no look.
    """
    if not unique:
        messages = materialize(single_ids(messages), "messages")
    texts = messages.select(F.col("conv").alias("_c"), F.col("msg").alias("_m"), "role", "text")
    paths = chosen_paths(messages.select("conv", "msg", "parent", "score"), branches)
    return formatted(paths.join(texts, (F.col("conv") == F.col("_c")) & (F.col("msg") == F.col("_m"))))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 2: all conversations and one full of control strings, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = materialize(linear(rows), "messages")
    chats = parse(materialize(format_chats(messages, unique=True), "chats"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *, replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2') AS t,
         replace(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'), '|', '~3') AS r FROM rows
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(t) + length(r) + 13) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
