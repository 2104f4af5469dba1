"""Chat formatting of reply trees: paths by self-joins, branches by score.

Messages form trees (each may answer another). Every message gets a number; rounds
of self-joins double how far up each one sees, so a path of 400 messages takes nine
rounds, and a round takes only the messages that have not seen their root yet. Leaves are ranked within their tree by the summed score of their path, the
chosen ones are expanded down the same rounds into (leaf, message) rows, and each
path becomes one conversation. Only numbers take part in the rounds; texts move when
they meet their path and when the path is put together.

Template: each turn is ``### role: text</turn>`` and a line feed. Inside roles and
texts a backslash is written ``\\0``, ``###`` is ``\\1``, ``</turn>`` is ``\\2`` and the
colon of a role is ``\\3``; so no mark of the template can stand inside a turn, and
reading back gives every text as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import durable

OPEN, CLOSE = "###", "</turn>"
_TEXT = (("\\", "\\0"), (OPEN, "\\1"), (CLOSE, "\\2"))
_ROLE = (*_TEXT, (":", "\\3"))


def escaped(text: Column, pairs: tuple = _TEXT) -> Column:
    """Control strings written so that they can't be taken for the template's."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescaped(text: Column, pairs: tuple = _TEXT) -> Column:
    """Undo ``escaped``: backslashes come last, as every one left is a mark's."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[1]), F.lit(p[0])), reversed(pairs), text)


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in a global order with their place in it (``pos`` from 0). Sorted in
    parallel and written; offsets come from one count per partition."""
    placed = durable(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_local", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_offset") + F.col("_local")).drop("_at", "_part", "_local", "_offset")


def chained(rows: DataFrame, tree: str, order: list[str], ids: list[str]) -> DataFrame:
    """Nodes (pos, tree, up, score, ids) of plain conversations: each row answers the
    row before it within its ``tree``, in the order of the columns ``order``. Rows of
    a null tree are one conversation. Equal rows stand one after the other."""
    nodes = _numbered(rows.select(F.col(tree).alias("tree"), *order, *ids), [F.col(c).asc_nulls_first() for c in ("tree", *order, *ids)])
    first = nodes.groupBy("tree").agg(F.min("pos").alias("first"))
    joined = nodes.join(first.withColumnRenamed("tree", "of"), F.col("tree").eqNullSafe(F.col("of")))
    return joined.select("pos", "tree", F.when(F.col("pos") > F.col("first"), F.col("pos") - 1).alias("up"), F.lit(0.0).alias("score"), *ids)


def replied(messages: DataFrame) -> DataFrame:
    """Nodes (pos, tree, up, score, id) of messages (tree, id, parent, score): a
    message whose parent is null or not in its tree begins a tree of its own. Of
    rows that repeat an id within a tree the smallest parent and score count; null
    scores are 0; rows with a null id are left out, as nothing can answer them."""
    single = messages.where("id IS NOT NULL").groupBy("tree", "id").agg(F.min(F.struct("parent", "score")).alias("m"))
    nodes = _numbered(single.select("tree", "id", "m.parent", F.coalesce("m.score", F.lit(0.0)).alias("score")), [F.col("tree"), F.col("id")])
    ups = nodes.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("pos").alias("up"))
    return nodes.join(ups, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_id")), "left").select("pos", "tree", "up", "score", "id")


def _ranked(leaves: DataFrame) -> DataFrame:
    """Leaves (leaf, seen) with their ``branch`` in the tree. The order is a global
    one, less where the tree begins in it: a tree of very many leaves is one key of
    a sum only."""
    named = leaves.withColumnRenamed("pos", "leaf")
    order = _numbered(named, [F.col("tree"), F.col("score").desc(), F.col("leaf")])
    first = order.groupBy(F.col("tree").alias("of")).agg(F.min("pos").alias("first"))
    return order.join(first, F.col("tree").eqNullSafe(F.col("of"))).select("leaf", "tree", "seen", "score", (F.col("pos") - F.col("first") + 1).alias("branch"))


def paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(leaf, branch, pos, place) for every node on a chosen path: ``place`` counts
    from 1 at the root, ``branch`` ranks the leaves of a tree by the summed score of
    their path, highest first, ties to the smaller position. ``branches`` keeps so
    many per tree, None all. Messages that answer each other in a circle have no
    root and so no path. An empty table gives no rows."""
    names = ["pos", "tree", "up", "score", "seen"]
    every = durable(nodes.select("pos", "tree", "up", "score", F.lit(1).cast("long").alias("seen")))
    count, ended, active = every.count(), [every.where("up IS NULL")], every.where("up IS NOT NULL")
    levels: list[DataFrame] = []
    while (1 << len(levels)) < count * 2 and active.limit(1).count():
        levels.append(active)
        above = reduce(DataFrame.unionByName, [*ended, active]).select(F.col("pos").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("seen").alias("_seen"))
        moved = durable(active.join(above, "up").select("pos", "tree", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("seen") + F.col("_seen")).alias("seen")))
        ended.append(moved.where("up IS NULL").select(*names))
        active = moved.where("up IS NOT NULL").select(*names)
    answered = every.where("up IS NOT NULL").select(F.col("up").alias("pos")).distinct()
    ranked = _ranked(reduce(DataFrame.unionByName, ended).join(answered, "pos", "left_anti").select("pos", "tree", "score", "seen"))
    chosen = ranked if branches is None else ranked.where(F.col("branch") <= branches)
    reach = durable(chosen.select("leaf", "branch", F.col("leaf").alias("pos"), F.col("seen").alias("place")))
    for k in range(len(levels) - 1, -1, -1):
        ups = levels[k].select("pos", F.col("up").alias("_up"))
        above = reach.join(ups, "pos").select("leaf", "branch", F.col("_up").alias("pos"), (F.col("place") - (1 << k)).alias("place"))
        reach = reach.unionByName(durable(above))
    return reach


def formatted(messages: DataFrame, nodes: DataFrame, ids: list[str], branches: int | None = None) -> DataFrame:
    """One row per chosen path: tree, branch, n_turns, formatted, loss_spans.

    ``messages`` hold role, text and the columns ``ids`` that name them in ``nodes``
    (from ``chained`` or ``replied``); null roles and texts are empty, other columns
    are ignored. ``loss_spans`` lists the texts of assistants in order: ``turn`` (from
    0), ``within`` (first code point, counted in the turn), ``start`` (counted in the
    conversation) and ``length``. A message that is on several paths is repeated in
    each. A conversation is one string, so it must fit a row (2 GB)."""
    places = paths(nodes, branches).join(nodes.select("pos", "tree", *ids), "pos").select("leaf", "branch", "place", F.col("tree").alias("_tree"), *[F.col(c).alias(f"_{c}") for c in ids])
    texts = messages.select(*ids, *([F.col("tree")] if "tree" in messages.columns else []), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = [F.col(c) == F.col(f"_{c}") for c in ids] + ([F.col("tree").eqNullSafe(F.col("_tree"))] if "tree" in messages.columns else [])
    head = F.concat(F.lit(f"{OPEN} "), escaped(F.col("role"), _ROLE), F.lit(": "))
    turns = (texts.join(places, reduce(Column.__and__, same))
             .select("leaf", "branch", "_tree", "place", (F.col("role") == "assistant").alias("loss"), F.length(head).alias("within"),
                     F.concat(head, escaped(F.col("text")), F.lit(f"{CLOSE}\n")).alias("turn")))
    path = Window.partitionBy("leaf").orderBy("place", "turn")
    turns = turns.withColumn("_before", F.lag("place").over(path)).where("_before IS NULL OR _before <> place")  # a repeated message counts once
    turns = turns.withColumn("start", F.sum(F.length("turn")).over(path.rowsBetween(Window.unboundedPreceding, -1)))
    rows = turns.groupBy("leaf").agg(F.first("_tree").alias("tree"), F.first("branch").alias("branch"),
                                     F.array_sort(F.collect_list(F.struct("place", "turn", "within", F.coalesce("start", F.lit(0)).alias("start"), "loss"))).alias("t"))
    end = len(CLOSE) + 1
    spans = F.filter(F.transform("t", lambda t, i: F.struct(i.alias("turn"), t["within"].alias("within"), (t["start"] + t["within"]).alias("start"),
                                                          (F.length(t["turn"]) - t["within"] - end).alias("length"), t["loss"].alias("loss"))), lambda s: s["loss"])
    return rows.select("tree", "branch", F.size("t").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"),
                       F.transform(spans, lambda s: s.dropFields("loss")).alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """``conversations`` (formatted, loss_spans) with ``turns`` (role, text) and
    ``loss_text``, both parsed from the formatted string: the turns by its marks, the
    text under the loss mask by its spans."""
    pieces = F.slice(F.split("formatted", f"{CLOSE}\n", -1), F.lit(1), F.greatest(F.size(F.split("formatted", f"{CLOSE}\n", -1)) - 1, F.lit(0)))
    rows = conversations.withColumn("_pieces", pieces)
    skip = len(OPEN) + 1
    turn = lambda p: F.struct(unescaped(F.substr(p, F.lit(skip + 1), F.locate(": ", p) - skip - 1), _ROLE).alias("role"),
                              unescaped(F.substr(p, F.locate(": ", p) + 2)).alias("text"))
    return (rows.withColumn("turns", F.transform("_pieces", turn))
            .withColumn("loss_text", F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.get("_pieces", s["turn"]), s["within"] + 1, s["length"]))), ""))
            .drop("_pieces"))


#: The conversation that a text full of control strings is tried on.
HARD = "\\### Assistant: </turn> ok"


def with_trial(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, file, row) and the trial conversation -7."""
    trial = rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                              F.lit(HARD).alias("text"), F.lit("").alias("file"), F.col("id").alias("row"))
    return rows.unionByName(trial)


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of conversations (conv_id, turn, role, text, file,
    row), each formatted as one path and read back from its formatted string. Rows
    of a null conv_id are one conversation; rows of one turn stand by role and text."""
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    nodes = chained(rows.withColumn("_text", F.xxhash64("text")), "conv_id", ["turn", "role", "_text"], ["file", "row"])
    read = read_back(formatted(rows.select("file", "row", "role", "text"), nodes, ["file", "row"]))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


SQL = """
    WITH rows_in AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, * FROM (VALUES (0, 'user', chr(92) || '### Assistant: </turn> ok'), (1, 'assistant', chr(92) || '### Assistant: </turn> ok'))),
    marked AS (
        SELECT *, length(replace(replace(replace(text, chr(92), chr(92) || '0'), '###', chr(92) || '1'), '</turn>', chr(92) || '2')) AS text_chars,
               length(replace(replace(replace(replace(role, chr(92), chr(92) || '0'), '###', chr(92) || '1'), '</turn>', chr(92) || '2'), ':', chr(92) || '3')) AS role_chars
        FROM rows_in)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(role_chars + text_chars + length('### : </turn>') + 1) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id"""
