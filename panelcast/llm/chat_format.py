"""Chat formatting over reply trees.

Messages are nodes (conv_id, node_id) with a parent. Root-to-leaf paths are
enumerated by iterative self-joins with doubled steps: after round k every
node knows its ancestor 2^k levels up, so a thread of n turns takes log2(n)
joins. Branches are ranked by the score summed along them; the chosen leaves
mark their ancestors with the same joins. A chosen path becomes one
conversation, as ordered pieces, one for each turn, so no value grows with the
length of a thread.

Template: ``### User: text</turn>`` and a line feed. Inside texts (and unusual
roles) a backslash, ``</turn>`` and ``### `` are escaped by backslashes, so
the control strings never occur there and :func:`read_back` is exact.

Defined results: null text is empty; null turns come last, ties by role and
text; a null conv_id is a conversation of its own; a parent that is missing or
is the node itself makes the node a root; nodes on or under a cycle have no
root-to-leaf path and are left out; rows that repeat a node id are turns at the
same depth, in the order of their pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import spool
from panelcast.session import Spool

END = "</turn>"
HEAD = "### "
#: Shown names of the usual roles; any other role is written as ``=`` and its escaped name.
SHOWN = {"user": "User", "assistant": "Assistant", "system": "System"}


# ----------------------------------------------------------------- trees

def number_turns(spark: SparkSession, rows: DataFrame, sp: Spool | None = None) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as messages: node_id in
    turn order, parent_id the turn before. A range exchange spreads a
    conversation of any length over many tasks; ids grow along that order, so
    the turn before is the row before, and only the first row of a task looks at
    a table that has one row for each task."""
    sp = sp or spool(spark)
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(),
             F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = rows.select("conv_id", "turn", "role", "text")
    kind = dict(rows.dtypes)["conv_id"]

    def opens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = object()
        for b in batches:
            convs = b.column(0).to_pylist()
            first = [c != p for c, p in zip(convs, [last, *convs])]
            last = convs[-1] if convs else last
            yield pa.record_batch([*b.columns, pa.array(first, pa.bool_())], [*b.schema.names, "_first"])
    r = sp.put(rows.repartitionByRange(*order).sortWithinPartitions(*order)
               .select("conv_id", "role", "text", F.monotonically_increasing_id().alias("node_id"))
               .mapInArrow(opens, f"conv_id {kind}, role string, text string, node_id long, _first boolean"))
    task = F.shiftright("node_id", 33)
    along = Window.orderBy("_t")
    before = sp.put(r.groupBy(task.alias("_t")).agg(F.max(F.struct("node_id", "conv_id")).alias("_end")).select(
        "_t", F.lag("_end").over(along).alias("_end")))
    same_task = F.col("node_id") > F.shiftleft(F.col("_t"), 33)
    joined = r.join(before, task == F.col("_t"))
    return joined.select("conv_id", "node_id",
                         F.when(same_task & ~F.col("_first"), F.col("node_id") - 1)
                         .when(~same_task & F.col("conv_id").eqNullSafe(F.col("_end.conv_id")) & F.col("_end").isNotNull(),
                               F.col("_end.node_id")).alias("parent_id"),
                         "role", "text", F.lit(0.0).alias("score"))


def _conv(c: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(c).cast("string")), F.lit("n"))


def chosen_paths(messages: DataFrame, sp: Spool, best: int = 1) -> DataFrame:
    """(_conv, node_id, path_rank, depth) of the nodes on the ``best`` highest
    scored root-to-leaf paths of each conversation."""
    nodes = messages.groupBy(_conv().alias("_conv"), "node_id").agg(
        F.min("parent_id").alias("parent"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    known = nodes.select(F.col("_conv").alias("_c"), F.col("node_id").alias("_p"))
    nodes = sp.put(nodes.join(known, (F.col("_conv") == F.col("_c")) & (F.col("parent") == F.col("_p"))
                              & (F.col("parent") != F.col("node_id")), "left")
                   .select("_conv", "node_id", F.col("_p").alias("up"), "score"))
    total = nodes.count()
    done = nodes.filter("up IS NULL").select("_conv", "node_id", F.lit(0).cast("long").alias("depth"),
                                             F.col("score").alias("total"))
    step = nodes.filter("up IS NOT NULL")        # node, ancestor 2^k above it, score from the node up to there
    steps, settled, span = [], [done], 1
    while span <= total:
        if step.isEmpty():
            break
        steps.append(step)
        open_ = sp.put(step.select("_conv").distinct())          # the conversations that this round is about
        above = (done.join(open_, "_conv", "left_semi").select("_conv", F.col("node_id").alias("up"), F.lit(None).cast("long").alias("up2"),
                             "depth", F.col("total").alias("more"))
                 .unionByName(step.select("_conv", F.col("node_id").alias("up"), F.col("up").alias("up2"),
                                          F.lit(None).cast("long").alias("depth"), F.col("score").alias("more"))))
        both = sp.put(step.join(above, ["_conv", "up"])
                      .select("_conv", "node_id", F.col("up2").alias("up"), "depth",
                              (F.col("score") + F.col("more")).alias("score")))
        now = both.filter("depth IS NOT NULL").select("_conv", "node_id", (F.col("depth") + span).alias("depth"),
                                                      F.col("score").alias("total"))
        settled.append(now)
        done = done.unionByName(now)
        step = both.filter("depth IS NULL").select("_conv", "node_id", "up", "score")
        span *= 2
    all_nodes = sp.put(done)
    parents = nodes.select("_conv", F.col("up").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    rank = F.row_number().over(Window.partitionBy("_conv").orderBy(F.desc("total"), "node_id"))
    marked = sp.put(all_nodes.join(parents, ["_conv", "node_id"], "left_anti")
                    .withColumn("path_rank", rank).filter(F.col("path_rank") <= best)
                    .select("_conv", "node_id", "path_rank"))
    for s in steps:                              # distances 0..2^k-1 are marked; add those 2^k further up
        up = s.select("_conv", "node_id", F.col("up").alias("_up"))
        marked = sp.put(marked.unionByName(marked.join(up, ["_conv", "node_id"])
                                           .select("_conv", F.col("_up").alias("node_id"), "path_rank")))
    return marked.join(all_nodes.select("_conv", "node_id", "depth"), ["_conv", "node_id"])


# -------------------------------------------------------------- template

def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(c, F.lit(HEAD), F.lit("#\\## "))


def unescape(text: str) -> str:
    return regex.sub(r"(?s)\\(.)", r"\1", text)


def format_paths(spark: SparkSession, messages: DataFrame, best: int = 1) -> DataFrame:
    """(conv_id, path_rank, depth, piece, mask_start, mask_length): the turns
    of the chosen paths. The conversation is the pieces in order of depth; the
    loss mask covers an assistant's escaped text within its piece."""
    sp = spool(spark)
    paths = chosen_paths(messages, sp, best)
    role = F.coalesce("role", F.lit(""))
    shown = F.concat(F.lit("="), F.replace(escape(role), F.lit(": "), F.lit(":\\ ")))
    for name, label in SHOWN.items():
        shown = F.when(role == name, F.lit(label)).otherwise(shown)
    head = F.concat(F.lit(HEAD), shown, F.lit(": "))
    body = escape(F.coalesce("text", F.lit("")))
    said = messages.select("conv_id", _conv().alias("_conv"), "node_id", head.alias("_head"), body.alias("_body"),
                           (role == "assistant").alias("_learn"))
    return said.join(paths, ["_conv", "node_id"]).select(
        "conv_id", "path_rank", "depth", F.concat("_head", "_body", F.lit(END + "\n")).alias("piece"),
        F.length("_head").cast("long").alias("mask_start"),
        F.when(F.col("_learn"), F.length("_body")).otherwise(F.lit(0)).cast("long").alias("mask_length"))


def parse(stream: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the whole turns of a formatted text."""
    at, back = 0, {v: k for k, v in SHOWN.items()}
    while at < len(stream):
        colon = stream.index(": ", at)
        end = stream.index(END, colon)
        shown = stream[at + len(HEAD):colon]
        role = unescape(shown[1:]) if shown.startswith("=") else back[shown]
        yield role, unescape(stream[colon + 2:end])
        at = end + len(END) + 1


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from the output alone:
    (conv_id, path_rank, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). Pieces stream through in order; a conversation is never
    held, whatever its length."""
    names = ["conv_id", "path_rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv_type = dict(pieces.dtypes)["conv_id"]

    def batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, kind, out = None, None, []
        n = loss_n = chars = 0
        turns = loss = None

        def flush():
            out.append((*open_key, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

        for b in batches:
            kind = b.schema.field("conv_id").type
            for r in b.to_pylist():
                key = (r["conv_id"], r["path_rank"])
                if key != open_key:
                    if open_key is not None:
                        flush()
                    open_key, n, loss_n, chars = key, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(r["piece"]):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                learned = unescape(r["piece"][r["mask_start"]:r["mask_start"] + r["mask_length"]])
                loss.update(learned.encode())
                loss_n += len(learned)
                chars += len(r["piece"])
            if len(out) >= 4096:
                yield batch(out, kind)
                out.clear()
        if open_key is not None:
            flush()
        if out:
            yield batch(out, kind)
    return (pieces.withColumn("_conv", _conv()).repartition("_conv")
            .sortWithinPartitions("_conv", "path_rank", "depth", "piece").drop("_conv")
            .mapInArrow(run, f"conv_id {conv_type}, path_rank int, n_turns long, turns_sha256 string, "
                             "loss_chars long, loss_sha256 string, formatted_chars long"))


#: The fixed extra conversation of the registered query: control strings inside texts.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ')) AS body,
         CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6
         ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '),
                                 ': ', ':\ ')) END AS head
  FROM m
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(4 + head + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
