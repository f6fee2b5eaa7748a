"""Chat formatting of reply trees.

Messages point at the message they reply to. Self-joins that double their reach find each message's depth and the
score of its path; leaves are ranked by that score within their tree; the path of each chosen leaf is walked back with
the stored joins and written as one conversation.

Template: ``### Role: text </turn>`` and a line feed for each turn. In roles and texts a backslash is put before every
``\\``, ``#`` and ``<``, so no marker can stand in them unescaped and taking the backslashes out gives the text back. A
colon in a role is written ``%3A`` and a percent sign ``%25``.

Defined results: null role or text is empty; a message whose parent is not in its tree is a root; messages on a cycle
have no root and are in no path; ties between branches go to the smaller leaf; rows of one turn stand in the order of
role and text, null as empty, and a null turn comes first; a null conv_id is a conversation of its own; no rows give no
rows; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge.llm.common import query, table
from fieldgauge.sources.workspace import materialise

TURN_START, ROLE_END, TURN_END = "### ", ": ", " </turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<])", "$1")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, depth, node) for the best ``branches`` leaves of each tree; ``messages`` has tree, node, parent and
    score, node unique within its tree. Rows stay narrow and every round is written, so lineage stays short."""
    here = messages.select("tree", "node", "parent", "score")
    keys = here.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    linked = here.join(keys, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left")
    # up: the message reached so far; depth and total: of the way to it, itself left out
    state = ["tree", "node", "up", "depth", "total"]
    start = materialise(linked.select("tree", "node", F.col("_n").alias("up"), F.lit(1).cast("bigint").alias("depth"), F.col("score").alias("total")))
    done, reach = start.where("up is null"), [start.where("up is not null")]
    open_, before = reach[0].count(), None
    while open_ and open_ != before:  # as many as before: only cycles are left
        now = reach[-1]  # messages whose way to the root is known stay out of further joins
        far = now.unionByName(done).select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_s"))
        step = materialise(now.join(far, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n")))
                           .select("tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_s")).alias("total")))
        done = done.unionByName(step.where("up is null"))
        reach.append(step.where("up is not null").select(*state))
        open_, before = reach[-1].count(), open_
    whole = done
    parents = linked.where("_n is not null").select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).distinct()
    leaves = whole.join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    paths = materialise(leaves.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= branches)
             .select("tree", F.col("node").alias("leaf"), "node", "depth"))
    for k in reversed(range(len(reach))):  # each distance is one sum of powers of two, so no message comes twice
        jump = reach[k].select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        up = (paths.join(jump, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
              .select("tree", "leaf", F.col("_up").alias("node"), (F.col("depth") - 2 ** k).alias("depth")))
        paths = materialise(paths.unionByName(up))
    return paths


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, formatted): each chosen path as one conversation."""
    paths = chosen_paths(messages, branches)
    said = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.concat(F.lit(TURN_START), escape_role(F.col("role")), F.lit(ROLE_END), escape(F.col("text")), F.lit(TURN_END))
    turns = (paths.join(said, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
             .groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", turn.alias("turn")))).alias("turns")))
    return turns.select("tree", "leaf", F.array_join(F.col("turns.turn"), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation, array<struct<role, text, escaped>>."""
    bodies = F.filter(F.split(formatted, TURN_END), lambda t: t != "")

    def turn(t):
        said = F.substr(t, F.lit(len(TURN_START) + 1))
        role = F.substring_index(said, ROLE_END, 1)
        text = F.substr(said, F.length(role) + len(ROLE_END) + 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"), text.alias("escaped"))
    return F.transform(bodies, turn)


def loss_spans(turns: Column, role: str = TRAINED_ROLE) -> Column:
    """(start, end) in code points of the formatted text of each trained turn's text, from turns read back."""
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a, t):
        start = a["at"] + len(TURN_START) + len(ROLE_END) + F.length(escape_role(t["role"]))
        end = start + F.length(t["escaped"])
        span = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct((end + len(TURN_END)).cast("bigint").alias("at"), F.when(t["role"] == role, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))
    return F.aggregate(turns, first, step, lambda a: a["spans"])


def conversation_trees(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees: every row replies to the one before it. Rows of one turn are ordered
    by role and text, and repeated rows are turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    n = F.row_number().over(order).cast("bigint")
    return rows.select(F.col("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


@query("op6_chat_formatting", r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(15 + length(regexp_replace(replace(replace(role, '%', '%25'), ':', '%3A'), '([\\#<])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::bigint as formatted_chars
from c group by conv_id""")
def op6_chat_formatting(spark, sf_dir):
    own = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id bigint, turn bigint, role string, text string"))
    out = format_trees(materialise(conversation_trees(rows))).withColumn("turns", read_back(F.col("formatted")))
    out = out.withColumn("spans", loss_spans(F.col("turns")))
    masked = F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    out = out.withColumn("loss", F.array_join(masked, ""))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))
