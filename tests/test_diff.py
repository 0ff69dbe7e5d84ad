"""Unified diffs: the standard library where the alignment is plain, applied patches everywhere."""

import difflib
import random
import re

from pyspark.sql import functions as F

from apidrift.operators import report
from apidrift.operators.diff import unified
from apidrift.operators.rewrite import file_edits


def diffs(spark, pairs):
    frame = spark.createDataFrame([(i, "k", a, b) for i, (a, b) in enumerate(pairs)], "n int, k string, a string, b string")
    return {r.n: r["diff"] for r in unified(frame, ["n", "k"], "a", "b").collect()}


def split(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def patched(before, diff):
    """The text after a unified diff; every context and removed line must be where the diff says."""
    lines, out, at = split(before), [], 0
    body = diff.removeprefix("--- original\n+++ migrated\n")
    for head, hunk in re.findall(r"@@ (-\d+(?:,\d+)? \+\d+(?:,\d+)?) @@\n((?:(?!@@ -)[\s\S])*)", body):
        start, length, _, added = re.fullmatch(r"-(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))?", head).groups()
        n, m = int(length or 1), int(added or 1)
        begin = int(start) - (n > 0)
        out += lines[at:begin]
        at, old, new = begin, 0, 0
        for line in split(hunk):
            if line[0] in " -":
                assert lines[at] == line[1:]
                at, old = at + 1, old + 1
            if line[0] in " +":
                out.append(line[1:])
                new += 1
        assert (old, new) == (n, m)
    return "".join(out + lines[at:])


def test_like_the_standard_library(spark):
    many = [f"line {i}\n" for i in range(60)]
    change = lambda *at: [f"new {i}\n" if i in at else x for i, x in enumerate(many)]
    pairs = [
        ("a\nb\nc\n", "a\nx\nc\n"), ("", "a\n"), ("a\n", ""), ("a", "a\n"), ("a\nb", "a\nc"), ("x\n", "# d\nx\n"), ("a\nb\nc\n", "b\nc\n"),
        ("".join(many), "".join(change(5, 30))), ("".join(many), "".join(change(5, 12))), ("".join(many), "".join(change(5, 13))),
        ("".join(many), "".join(change(0, 1, 2, 58, 59))), ("".join(many), "".join(many[:10] + ["# new\n"] + many[10:])),
        ("".join(many), "".join(many[:10] + many[14:])), ("p\nq\np\n" * 3, "p\nr\np\n" * 3), ("a\r\nb\r\n", "a\r\nc\r\n"),
    ]
    got = diffs(spark, [*pairs, ("same\n", "same\n")])
    for i, (a, b) in enumerate(pairs):
        want = "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), "original", "migrated"))
        assert got[i] == want, (a, b)
    assert len(got) == len(pairs)


def test_patches_give_the_new_text(spark):
    rnd = random.Random(11)
    pairs = []
    for _ in range(250):
        lines = [rnd.choice(["pass\n", "x\n", "y\n", f"v{rnd.randrange(30)}\n"]) for _ in range(rnd.randrange(40))]
        new = [x for x in lines]
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(new) + 1)
            new[at:at + rnd.randrange(3)] = [rnd.choice(["pass\n", "x\n", f"v{rnd.randrange(30)}\n"]) for _ in range(rnd.randrange(3))]
        pairs.append(("".join(lines), "".join(new)))
    got = diffs(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        assert (i in got) == (a != b)
        assert a == b or patched(a, got[i]) == b, (a, b)


def test_results_are_computed_once(spark, capsys):
    changed = F.col("id") > 0
    results = spark.range(3).select(
        F.lit(1).alias("path_id"), F.col("id").alias("file_id"), F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("path"),
        F.lit("a\nb\n").alias("original_code"), F.when(changed, "a\nc\n").otherwise("a\nb\n").alias("transformed_code"),
        F.array(F.lit("m")).alias("changes"), F.array().cast("array<string>").alias("errors"), changed.alias("was_modified"))
    shown, listed, diffs = report.preview(results), report.report_lines(results, "1", "2"), report.unified_diff(results)
    for frame in (shown, listed, diffs):
        frame.explain()
        assert "Range (" not in capsys.readouterr().out
    assert shown.count() == 3 and listed.count() == 7 + 4 and diffs.count() == 2


def test_edits_by_position_are_sorted_once(spark, capsys):
    edits = spark.createDataFrame([], "path_id int, file_id long, k string, pos int, end int, o int, m int, c boolean, txt string, src array<int>")
    file_edits(edits).explain()
    assert capsys.readouterr().out.count("Sort [") == 2
