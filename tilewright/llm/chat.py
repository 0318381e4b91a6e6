"""Chat formatting from reply trees.

Messages point to the message they reply to. Self-joins that double the distance to an
ancestor give each leaf's branch a score, the best branches of a conversation are chosen by
it, and the same tables of ancestors list the messages of each chosen branch, which become
one conversation each. The template writes a turn as `### role: text</turn>` and a newline;
backslashes, `###` and `</turn>` in roles and texts are escaped, so that reading back gives
every turn exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import drop_scratch, scratch

OPEN, CLOSE = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_END = re.compile(r"(?:[^\\<]|\\[\s\S]|<(?!/turn>))*+</turn>\n")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    # A colon in a role would end it early.
    return f"{OPEN}{escape(role).replace('%', '%25').replace(':', '%3A')}: {escape(text)}{CLOSE}"


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted conversation."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        colon = formatted.index(": ", at)
        role = unescape(formatted[at + len(OPEN) : colon].replace("%3A", ":").replace("%25", "%"))
        m = _END.match(formatted, colon + 2)
        if not m:
            raise ValueError(f"the turn at {at} doesn't end")
        end = m.end() - len(CLOSE)
        yield role, unescape(formatted[colon + 2 : end]), colon + 2, end
        at = m.end()


def paths(messages: DataFrame, conv: str = "conv", node: str = "node", parent: str = "parent", score: str = "score", best: int = 1, ties: list[str] | None = None) -> DataFrame:
    """The chosen branches: (conv, branch, rank, depth, node, branch_score), depth 0 being the root.

    A branch is a root-to-leaf path, named by its leaf; its score is the sum of its messages' (null: 0). Branches rank
    by score, then by the leaf. node is unique in a conversation; a parent that is null or missing makes a root. Nodes
    on a cycle belong to no branch. Conversation ids may be null: those messages form one conversation."""
    spark = messages.sparkSession
    ok = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    base = messages.select(F.col(conv).alias("conv"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(score), F.lit(0)).cast("double").alias("score"))
    known = base.select(F.col("conv").alias("c"), F.col("node").alias("p"))
    now, path = scratch(base.join(known, ok("conv", "c") & (F.col("parent") == F.col("p")), "left").select("conv", "node", F.col("p").alias("up"), "score", F.lit(1).cast("long").alias("steps")), "chat-up")
    jumps = [(now.where("up is not null").select("conv", "node", "up"), path)]
    limit = 62
    while now.where("up is not null").limit(1).count() and limit:
        far = now.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("score").alias("s"), F.col("steps").alias("k"))
        done = now.where("up is null")
        more = now.where("up is not null").join(far, ok("conv", "c") & (F.col("up") == F.col("n"))).select("conv", "node", F.col("u").alias("up"), (F.col("score") + F.col("s")).alias("score"), (F.col("steps") + F.col("k")).alias("steps"))
        before = now
        now, path = scratch(done.unionByName(more), "chat-up")
        jumps.append((now.where("up is not null").select("conv", "node", "up"), path))
        limit -= 1
        if now.count() == before.count() and not now.where("up is not null").join(before.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("u")), ok("conv", "c") & (F.col("node") == F.col("n")) & (F.col("up") != F.col("u"))).limit(1).count():
            break  # only cycles are left
    rooted = now.where("up is null")
    inner = base.where("parent is not null").select(F.col("conv").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = rooted.join(inner, ok("conv", "c") & (F.col("node") == F.col("p")), "left_anti")
    # The best few of each conversation, without its leaves in one window: maxima one after the other, kept small by best.
    top = F.sort_array(F.collect_list(F.struct(F.col("score").alias("s"), F.col("node").alias("leaf"), "steps")), asc=False) if best > 1 else F.array(F.max(F.struct(F.col("score").alias("s"), F.col("node").alias("leaf"), "steps")))
    if best > 1:
        cell = F.pmod(F.xxhash64("node"), F.lit(64))
        few = lambda df, by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("node")))).where(F.col("r") <= best).drop("r")
        leaves = few(few(leaves.withColumn("cell", cell), ["conv", "cell"]), ["conv"])
    chosen = leaves.groupBy("conv").agg(top.alias("t")).select("conv", F.posexplode(F.slice("t", 1, best)).alias("rank", "b")).select("conv", F.col("b.leaf").alias("branch"), (F.col("rank") + 1).alias("rank"), F.col("b.s").alias("branch_score"), F.col("b.steps").alias("length"))
    chosen, _ = scratch(chosen, "chat-chosen")
    members, path = chosen.select("conv", "branch", F.col("branch").alias("node"), F.lit(0).cast("long").alias("back")), None
    for power in range(len(jumps) - 1, -1, -1):
        up = jumps[power][0].select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        more = members.join(up, ok("conv", "c") & (F.col("node") == F.col("n"))).select("conv", "branch", F.col("up").alias("node"), (F.col("back") + F.lit(1 << power)).alias("back"))
        # Without a table in between each step would read the step before twice, and the plan would double with each.
        before = path
        members, path = scratch(members.unionByName(more), "chat-members")
        drop_scratch(spark, before)
    for _, p in jumps:
        drop_scratch(spark, p)
    c = chosen.select(F.col("conv").alias("c"), F.col("branch").alias("b"), "rank", "branch_score", "length")
    return members.join(c, ok("conv", "c") & (F.col("branch") == F.col("b"))).select("conv", "branch", "rank", (F.col("length") - 1 - F.col("back")).alias("depth"), "node", "branch_score")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv, branch, formatted, mask) from (conv, branch, depth, role, text): one row for each branch, mask being the
    (start, end) code points of the assistant's texts. Nulls in role and text count as empty.

    A branch is sorted into one task, as its text is one value; a task streams over its branches one by one."""
    conv_type = turns.schema["conv"].dataType.simpleString()
    masked = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, mask, size, ids = None, [], [], 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], ids), pa.array([now[1]], pa.string()), pa.array(["".join(parts)], pa.string()), pa.array([mask], masked)], names=["conv", "branch", "formatted", "mask"])

        for batch in batches:
            ids = batch.column(0).type
            for c, b, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, b) != now:
                    if now:
                        yield row()
                    now, parts, mask, size = (c, b), [], [], 0
                turn = format_turn(role or "", text or "")
                if role == "assistant":
                    end = size + len(turn) - len(CLOSE)
                    mask.append({"start": end - len(escape(text or "")), "end": end})
                parts.append(turn)
                size += len(turn)
        if now:
            yield row()

    own = turns.select("conv", F.col("branch").cast("string").alias("branch"), "depth", "role", "text").repartition("conv", "branch").sortWithinPartitions("conv", "branch", "depth")
    return own.select("conv", "branch", "role", "text").mapInArrow(run, f"conv {conv_type}, branch string, formatted string, mask array<struct<start:long,end:long>>")


def from_turns(table: DataFrame) -> DataFrame:
    """Messages of a table of numbered turns: each turn replies to the one before it. Turns of equal or no number are
    taken in the order of role and text; repeated rows are turns of their own."""
    order: list[Column] = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    numbered = table.select(F.col("conv_id").alias("conv"), n.alias("node"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def digest(table: DataFrame) -> DataFrame:
    """Digests of each conversation as read back from its formatted text and the loss mask: one row a conv_id.

    Null conv_ids form one conversation; null roles and texts are empty; repeated rows are turns of their own, and
    turns of equal number follow each other by role and text. Other columns are not read; no rows give none."""
    messages, _ = scratch(from_turns(table), "chat-messages")
    chosen = paths(messages)
    said = messages.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text")
    turns = chosen.join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv", "branch", "depth", "role", "text")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said, _, _ in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for m in mask:
                    part = unescape(text[m["start"] : m["end"]])
                    loss.update(part.encode())
                    chars += len(part)
                rows.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return formatted(turns).select("conv", "formatted", "mask").mapInArrow(run, f"conv_id {table.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
