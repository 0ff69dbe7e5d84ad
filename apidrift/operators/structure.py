"""Structure of source texts as window columns over their tokens.

``tokens`` explodes each file into its significant tokens; ``structure`` adds what
a syntax tree would tell: neighbours, bracket depth, logical line, statement,
enclosing bracket, argument separators. The input is expected to be hash
partitioned by ``file_id``: every window below is keyed by the file, so none of
them moves a token row across the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.functions.lexing import (
    COMPOUND_HEADS, KEYWORDS, closes, is_name, opens, starts_line, token_structs,
)

KEY = ("path_id", "file_id")


def tokens(files: DataFrame, content: Column, *carry: str) -> DataFrame:
    """One row per significant token: keys, ``pos``, ``pre`` (trivia), ``tok``."""
    return files.select(
        *carry,
        F.posexplode(token_structs(content)).alias("pos", "t"),
    ).select(*carry, "pos", F.col("t.pre").alias("pre"), F.col("t.tok").alias("tok"))


def _running(key) -> Window:
    return Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _last(condition: Column, value) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.last(F.when(condition, value), ignorenulls=True)


# Line heads are coded into the running maximum that also carries the line's position.
LINE_COMPOUND, LINE_DECORATOR, LINE_DEF = 1, 2, 4
ALL = frozenset({"depth", "lines", "statements", "alone", "definitions", "names", "blocks"})


def structure(toks: DataFrame, key=KEY, need: frozenset = ALL) -> DataFrame:
    """Neighbours, depth, lines and statements for token rows (with a flag word ``fl``).

    ``need`` limits the columns to what the rules at hand ask for. Running positions
    are kept as maxima of integers, the cheapest window there is: whatever is true of
    a line or statement travels in the low bits of its position.
    """
    c = F.col
    order = Window.partitionBy(*key).orderBy("pos")
    run = _running(key)
    opener, closer = opens(c("tok")), closes(c("tok"))
    deep = bool(need - {"names"})
    out = toks if not deep else toks.select(
        "*", (opener.cast("int") - closer.cast("int")).alias("delta"), opener.alias("opens"), starts_line(c("pre")).alias("nl"),
    )
    out = out.select(
        "*",
        F.lag("tok", 1, "").over(order).alias("prev1"),
        F.lag("tok", 2, "").over(order).alias("prev2"),
        F.lead("tok", 1, "").over(order).alias("next1"),
        *([
            F.sum("delta").over(run).cast("int").alias("depth_after"),
            F.lead("tok", 2, "").over(order).alias("next2"),
            F.lead("pre", 1).over(order).alias("next_pre"),
            F.lead("nl", 1, True).over(order).alias("nl1"),
            F.lead("nl", 2, True).over(order).alias("nl2"),
            F.lag("fl", 1, 0).over(order).alias("fl_prev"),
            F.lead("fl", 1, 0).over(order).alias("fl_next1"),
            F.lead("fl", 2, 0).over(order).alias("fl_next2"),
        ] if deep else []),
    ).select(
        "*", is_name(c("tok")).alias("word"),
        ((c("prev1") == ".") & ~c("prev2").isin("from", ".", "...")).alias("is_attr"),
    )
    if not deep:
        return out
    depth_before = c("depth_after") - c("delta")
    ls = (c("pos") == 0) | (c("nl") & (depth_before == 0))
    out = out.select(
        "*",
        # level: depth of the inside for brackets, depth for everything else
        F.when(c("delta") < 0, c("depth_after") + 1).otherwise(c("depth_after")).alias("lvl"),
        F.least(c("depth_after"), depth_before).alias("outer"),
        ls.alias("ls"), (ls | ((c("prev1") == ";") & (depth_before == 0))).alias("ss"),
    )
    # tokens that keep a statement from being one call expression
    spoils = (c("outer") == 0) & F.when(c("word"), c("tok").isin(*KEYWORDS)).otherwise(
        ~c("tok").rlike("[\"']") & ~(c("opens") & (F.length("tok") > 1)) & ~c("tok").isin(".", "(", ")", "[", "]", "{", "}", "")
    )
    compound = c("tok").isin(*COMPOUND_HEADS) & ~(
        c("tok").isin("match", "case") & c("next1").isin("(", ".", "[", "=", ",", ":")
    )
    code = (
        compound.cast("long") * LINE_COMPOUND + (c("tok") == "@").cast("long") * LINE_DECORATOR
        + c("tok").isin("def", "async").cast("long") * LINE_DEF
    )
    pos = c("pos").cast("long")
    paren0 = (c("tok") == "(") & (c("outer") == 0)
    first, then = [], []
    if need & {"lines", "alone", "definitions", "blocks"}:
        first.append(F.max(F.when(c("ls"), pos * 8 + code)).over(run).alias("line"))
    if "statements" in need:
        first.append(F.max(F.when(c("ss"), pos * 2 + (c("tok") == "from").cast("long"))).over(run).alias("stmt"))
    if "alone" in need:
        out = out.withColumn("spoils", spoils.cast("int"))
        first += [
            F.sum("spoils").over(run).alias("spoiled"),
            _last(c("ls"), F.regexp_extract("pre", r"[^\r\n]*\z", 0)).over(run).alias("line_indent"),
        ]
        then.append(F.max(F.when(c("ss"), c("spoiled") - c("spoils"))).over(run).alias("spoiled0"))
    if "definitions" in need:
        first.append(F.sum(paren0.cast("int")).over(run).alias("parens"))
        then += [
            F.max(F.when(c("prev1") == "def", pos * 64 + c("fl"))).over(run).alias("dn"),
            F.max(F.when(c("prev1") == "def", c("parens"))).over(run).alias("dn_parens"),
            _last(c("prev1") == "def", "tok").over(run).alias("dn_name"),
        ]
    if "blocks" in need:
        first.append(F.sum((c("ls") & (c("tok") != "@")).cast("int")).over(run).alias("blocks"))
        then.append(F.lag("line", 1, 0).over(order).alias("prev_line"))
    out = out.select("*", *first).select("*", *then)
    if "line" in out.columns:
        out = out.select("*", F.shiftright("line", 3).cast("int").alias("line_pos"))
    return out
