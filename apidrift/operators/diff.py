"""Unified diffs as windows and grouped aggregates over lines.

    files (keys, before, after)  ->  one diff text per file that differs

Lines are matched in three steps. Lines that occur once on either side and do not cross others
are anchors; within the gap between two anchors, lines that occur once there are anchors too; what is left of
a gap is matched line by line where both sides have equally many, else from both ends. The rest is removed
or added. Hunks are islands of rows within ``CONTEXT`` unchanged lines of a change. Every window and group is keyed by the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.session import settled

#: Unchanged lines around a change.
CONTEXT = 3
# What ends a line.
BREAKS = r"\n\r\f\x0b\x1c-\x1e\x85\u2028\u2029"
LINE = rf"[^{BREAKS}]*+(?:\r\n|[{BREAKS}])|[^{BREAKS}]++"
SAME, GONE, NEW = 0, 1, 2


def lines(text: Column) -> Column:
    """The lines of a text with their ends."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def _anchors(rows: DataFrame, within: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Lines that occur once on each side of a group and cross no other such line: keys, place on both sides."""
    once = rows.groupBy(*within, "line").agg(
        F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"),
        F.max(F.when(F.col("side") == 0, F.col("i"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("i"))).alias("b"),
    ).where("n0 = 1 and n1 = 1")
    order = Window.partitionBy(*within).orderBy("a")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    return once.select("*", F.max("b").over(before).alias("most"), F.min("b").over(after).alias("least")).where(
        "coalesce(most < b, true) and coalesce(least > b, true)").select(
        *keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("i")), F.struct(F.lit(1).alias("side"), F.col("b").alias("i")))).alias("x"),
    ).select(*keys, "x.side", "x.i", F.lit(True).alias("anchor"))


def _gaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``gap``: anchors so far; an anchor opens the gap that follows it."""
    sofar = Window.partitionBy(*keys, "side").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("gap", F.sum(F.col("anchor").cast("int")).over(sofar))


# What is left of a gap, from the arrays ``a`` and ``b`` of its lines: entries (off, kind, line).
_ENTRY = "named_struct('off', cast({off} as int), 'kind', {kind}, 'line', {line})"
_EQUAL = f"""
    flatten(transform(a, (x, i) -> if(x = b[i], array({_ENTRY.format(off='i', kind=SAME, line='x')}),
      array({_ENTRY.format(off='i', kind=GONE, line='x')}, {_ENTRY.format(off='i', kind=NEW, line='b[i]')}))))
"""
_SHARED = "(array_position(zip_with({0}, {1}, (x, y) -> coalesce(x = y, false)), false) - 1)"
_ENDS = f"""
    concat(
      transform(slice(a, 1, p), (x, i) -> {_ENTRY.format(off='i', kind=SAME, line='x')}),
      transform(slice(a, p + 1, size(a) - p - q), (x, i) -> {_ENTRY.format(off='p + i', kind=GONE, line='x')}),
      transform(slice(b, p + 1, size(b) - p - q), (x, i) -> {_ENTRY.format(off='p + i', kind=NEW, line='x')}),
      transform(slice(a, size(a) - q + 1, q), (x, i) -> {_ENTRY.format(off='size(a) + size(b) + i', kind=SAME, line='x')}))
"""


def _matched(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The edit script: gap, off (order within), kind, line."""
    held = rows.where("not anchor").groupBy(*keys, "gap").agg(*(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("i", "line")))), lambda x: x["line"]).alias(name)
        for side, name in ((0, "a"), (1, "b"))))
    # Sides of different length differ somewhere, so both positions below exist.
    sized = held.withColumn("p", F.expr(f"cast(if(size(a) = size(b), 0, {_SHARED.format('a', 'b')}) as int)")).withColumn("q", F.expr(
        f"cast(if(size(a) = size(b), 0, least({_SHARED.format('reverse(a)', 'reverse(b)')}, least(size(a), size(b)) - p)) as int)"))
    rest = sized.select(*keys, "gap", F.explode(F.expr(f"if(size(a) = size(b), {_EQUAL}, {_ENDS})")).alias("e")).select(
        *keys, "gap", "e.off", "e.kind", "e.line")
    fixed = rows.where("anchor and side = 0").select(*keys, "gap", F.lit(-1).alias("off"), F.lit(SAME).alias("kind"), "line")
    return rest.unionByName(fixed)


def script(files: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Rows of the edit script of each file in order: keys, seq, kind (same, gone, new), line, ``same`` (unchanged lines so far)."""
    rows = files.select(*keys, F.explode(F.array(*(
        F.struct(F.lit(side).alias("side"), lines(F.col(text)).alias("held")) for side, text in ((0, before), (1, after))))).alias("x"),
    ).select(*keys, "x.side", F.posexplode("x.held").alias("i", "line"))
    first = _anchors(rows, keys, keys)
    rows = _gaps(rows.join(first, [*keys, "side", "i"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False))), keys)
    second = _anchors(rows.where("not anchor"), [*keys, "gap"], keys).withColumnRenamed("anchor", "more")
    # matched twice below: by anchors and by what lies between
    rows = settled(_gaps(rows.drop("gap").join(second, [*keys, "side", "i"], "left").withColumn(
        "anchor", F.col("anchor") | F.coalesce("more", F.lit(False))).drop("more"), keys))
    order = Window.partitionBy(*keys).orderBy("gap", "off", "kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = _matched(rows, keys).withColumn("same", F.sum((F.col("kind") == SAME).cast("int")).over(order))
    # All removed lines between two unchanged ones come before all added ones.
    return matched.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("same", "kind", "gap", "off")))


def hunks(rows: DataFrame, keys: Sequence[str], context: int = CONTEXT) -> DataFrame:
    """The script's rows near a change, with ``hunk`` and the number of lines of either side before a row."""
    order = Window.partitionBy(*keys).orderBy("seq")
    sofar, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    changed = F.when(F.col("kind") != SAME, F.col("same"))
    near = rows.select(
        "*", F.max(changed).over(sofar).alias("last"), F.min(changed).over(on).alias("next"),
        *(F.coalesce(F.count_if(F.col("kind") != other).over(sofar), F.lit(0)).alias(name) for name, other in (("before_a", NEW), ("before_b", GONE))),
    ).where((F.col("kind") != SAME) | F.coalesce(F.col("same") - F.col("last") <= context, F.lit(False))
            | F.coalesce(F.col("next") - F.col("same") < context, F.lit(False)))
    starts = F.coalesce(F.col("seq") - F.lag("seq").over(order) > 1, F.lit(True))
    return near.withColumn("starts", starts.cast("int")).withColumn(
        "hunk", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("last", "next", "starts")


def _range(start: Column, n: Column) -> Column:
    """A hunk's range as unified diffs write it: a single line has no length, an empty range starts a line earlier."""
    first = start + F.when(n == 0, 0).otherwise(1)
    return F.when(n == 1, first.cast("string")).otherwise(F.concat_ws(",", first.cast("string"), n.cast("string")))


def unified(files: DataFrame, keys: Sequence[str], before: str, after: str, names: tuple[str, str] = ("original", "migrated")) -> DataFrame:
    """keys, diff: the unified diff of each file whose texts differ."""
    near = hunks(script(files.where(F.col(before) != F.col(after)), keys, before, after), keys)
    sign = F.element_at(F.array(*map(F.lit, " -+")), F.col("kind") + 1)
    each = near.groupBy(*keys, "hunk").agg(
        F.min("before_a").alias("a"), F.count_if(F.col("kind") != NEW).alias("na"), F.min("before_b").alias("b"), F.count_if(F.col("kind") != GONE).alias("nb"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat(sign, "line").alias("text")))), lambda x: x["text"]), "").alias("body"))
    text = F.concat(F.lit("@@ -"), _range(F.col("a"), F.col("na")), F.lit(" +"), _range(F.col("b"), F.col("nb")), F.lit(" @@\n"), "body")
    return each.groupBy(*keys).agg(F.concat(
        F.lit(f"--- {names[0]}\n+++ {names[1]}\n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hunk", text.alias("text")))), lambda x: x["text"]), "")).alias("diff"))
