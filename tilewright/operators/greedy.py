"""Rows that count one after the other: the first of a key, and then each first row far enough past the last that counted.

What counts depends on what counted before, but where the next one lies does not: every row has one
next row, whether or not it counts itself. So all rows look for theirs at once, in a tree of the
largest values of FAN rows, FAN * FAN rows and so on, and the rows reached from a key's first are
marked by doubling the pointers. A key's rows are in as many tasks as there are, not in one."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Children of a node of the tree.
FAN = 64


def numbered(rows: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds n, a row's place among its key's rows in the order, from 0. bucket grows with the first order column: places in
    a bucket are one window each, and what lies before a bucket comes from the buckets' counts."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_c"))
    before = counts.select(key, "_bucket", (F.sum("_c").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_c")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return rows.withColumn("_inner", inner).join(before, [key, "_bucket"]).withColumn("n", (F.col("_inner") + F.col("_before")).cast("long")).drop("_bucket", "_inner", "_before")


class Tree:
    """The largest of each of some columns over rows (key, n from 0 without gaps), of FAN rows, of FAN * FAN rows and so on."""

    def __init__(self, rows: DataFrame, key: str, values: list[Column], depth: int) -> None:
        self.key, self.levels, self.names = key, [], [f"v{j}" for j in range(len(values))]
        nodes = rows.select(key, F.col("n").alias("i"), *[v.cast("double").alias(name) for v, name in zip(values, self.names, strict=True)])
        for _ in range(depth):
            # Equal places in every level: a node's children stand in one row, FAN at most.
            level = nodes.groupBy(key, F.floor(F.col("i") / FAN).alias("_node")).agg(F.array_sort(F.collect_list(F.struct("i", *self.names))).alias("_children"))
            self.levels.append(level)
            nodes = level.select(key, F.col("_node").alias("i"), *[F.array_max(F.col("_children")[name]).alias(name) for name in self.names])

    def first_at_least(self, asked: DataFrame, start: str, least: list[str], out: str) -> DataFrame:
        """Adds the first place from `start` on where one of the values is its `least` or more; null if there is none, or
        no start."""
        rows = asked.withColumn("_at", F.col(start).cast("long")).withColumn("_level", F.lit(None).cast("int"))
        for k, level in enumerate(self.levels):
            open_ = F.col("_level").isNull() & F.col("_at").isNotNull()
            rows = self._in_level(rows, level, F.when(open_, F.floor(F.col("_at") / FAN)), F.col("_at") % FAN, least)
            found = open_ & (F.col("_found") > 0)
            rows = rows.select(*[c for c in rows.columns if c not in ("_at", "_level", "_found", "_node")], F.when(found, F.col("_node") * FAN + F.col("_found") - 1).when(open_, F.col("_node") + 1).otherwise(F.col("_at")).alias("_at"), F.when(found, k).otherwise(F.col("_level")).alias("_level"))
        for k in range(len(self.levels) - 1, 0, -1):
            here = F.coalesce(F.col("_level") == k, F.lit(False))
            rows = self._in_level(rows, self.levels[k - 1], F.when(here, F.col("_at")), F.lit(0), least)
            rows = rows.select(*[c for c in rows.columns if c not in ("_at", "_level", "_found", "_node")], F.when(here, F.col("_node") * FAN + F.col("_found") - 1).otherwise(F.col("_at")).alias("_at"), F.when(here, k - 1).otherwise(F.col("_level")).alias("_level"))
        return rows.withColumn(out, F.when(F.col("_level") == 0, F.col("_at"))).drop("_at", "_level")

    def _in_level(self, rows: DataFrame, level: DataFrame, node: Column, start: Column, least: list[str]) -> DataFrame:
        """Adds _node and _found: which of the node's children from start on is the first that has it, from 1; else 0."""
        # Rows that look for nothing here have nodes of their own below 0, so that they don't meet in one task.
        rows = rows.withColumn("_node", F.coalesce(node, -1 - F.col("n"))).withColumn("_start", start)
        rows = rows.join(level, [self.key, "_node"], "left")
        high = lambda c: reduce(or_, [c[name] >= F.col(bound) for name, bound in zip(self.names, least, strict=True)])
        hit = F.transform("_children", lambda c, i: (i >= F.col("_start")) & high(c))
        return rows.withColumn("_found", F.coalesce(F.array_position(hit, True), F.lit(0))).drop("_children", "_start")


def depth_of(rows: DataFrame) -> int:
    """Levels of a tree that has one root for each key's rows (n)."""
    most, depth = rows.agg(F.max("n")).first()[0] or 0, 1
    while most >= FAN**depth:
        depth += 1
    return depth


def reached(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the rows reached from each key's row 0 by the pointer `next`: in a round all that have been reached jump
    twice as far as in the one before, and pointers are joined with themselves."""
    got = rows.where("n = 0").select(key, "n")
    jumps = rows.where("next is not null").select(key, "n", "next").checkpoint()
    while not jumps.isEmpty():
        more = got.join(jumps, [key, "n"]).select(key, F.col("next").alias("n"))
        got = got.unionByName(more).checkpoint()
        onwards = jumps.select(key, F.col("n").alias("next"), F.col("next").alias("_next"))
        jumps = jumps.join(onwards, [key, "next"]).select(key, "n", F.col("_next").alias("next")).checkpoint()
    return got


def counting(rows: DataFrame, key: str, order: list[str], bucket: Column, gap: float, by: str | None = None, least: float = 0.0, always: Column | None = None) -> DataFrame:
    """The rows that count: a key's first in the order, and each first row that lies `gap` or more past the last that
    counted in order[0] and, if asked for, differs from it by `least` or more in `by`, or for which `always` holds.

    order[0] is a number that isn't null and doesn't fall along the order; rows have no columns next, n or with a leading
    underscore."""
    columns = rows.columns
    own = numbered(rows.withColumn("_always", (F.lit(False) if always is None else F.coalesce(always, F.lit(False))).cast("int")), key, order, bucket).checkpoint()
    depth = depth_of(own)
    asked = own.select(key, "n", (F.col("n") + 1).alias("_from"), (F.col(order[0]) + gap).alias("_late"), *([(F.col(by) + least).alias("_over"), (least - F.col(by)).alias("_under")] if by else []), F.lit(1).alias("_one"))
    # What is sought from one place on is sought in one tree.
    if always is None or by:
        asked = Tree(own, key, [F.col(order[0])], depth).first_at_least(asked, "_from", ["_late"], "_next")
    else:
        asked = Tree(own, key, [F.col(order[0]), F.col("_always")], depth).first_at_least(asked, "_from", ["_late", "_one"], "_next")
    if by:
        asked = Tree(own, key, [F.col(by), -F.col(by)], depth).first_at_least(asked.withColumnRenamed("_next", "_then"), "_then", ["_over", "_under"], "_next")
    if by and always is not None:
        asked = Tree(own, key, [F.col("_always")], depth).first_at_least(asked, "_from", ["_one"], "_soon").withColumn("_next", F.least("_next", "_soon"))
    return own.join(reached(asked.select(key, "n", F.col("_next").alias("next")), key), [key, "n"]).select(*columns)
