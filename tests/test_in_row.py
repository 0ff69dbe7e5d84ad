"""Reading entities and merging edits within the row of a file."""

import random

from pyspark.sql import functions as F

from apidrift.functions.lexing import token_structs
from apidrift.operators.reading import reader
from apidrift.operators.rewrite import file_edits, merge, migrate, stitch
from tests.helpers import files_frame, rule, rules_frame

EDITS = "path_id int, file_id long, k string, pos int, end int, o int, m int, c boolean, txt string, src array<int>"
ALL_KINDS = [
    rule("rename_function", old_name="f", new_name="g"), rule("add_argument", function_name="g", argument_name="a", default_value="1"),
    rule("deprecate_function", old_name="old"), rule("reorder_arguments", function_name="h", new_order=["b", "a"]),
    rule("change_argument_default", argument_name="s", default_value="2"), rule("add_decorator", function_name="h", decorator_name="d"),
    rule("rename_import", old_module="m", old_name="g", new_module="n", new_name="g")]


def test_tokens_stay_in_the_row_of_their_file(spark):
    source = "from m import f\nold()\ndef h(a, b, s=1):\n    return f(a)\n"
    done = migrate(files_frame(spark, {1: source}), rules_frame(spark, {1: ALL_KINDS}))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan and "posexplode" not in plan
    assert done.collect()[0].transformed_code == (
        "from n import g\n# DEPRECATED: old() is deprecated. Use N/A instead.\nold()\n@d\ndef h(b, a, s=2):\n    return g(a, a=1)\n")


def test_texts_are_read_for_entities_once(spark):
    done = migrate(files_frame(spark, {i: f"f({i})\nold()\n" for i in range(3)}), rules_frame(spark, {i: ALL_KINDS for i in range(3)}))
    assert done.count() == 3 and len(done.collect()) == 3
    done.write.format("noop").mode("overwrite").save()
    frame = done.select("transformed_code")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("ArrowEvalPython [read(") == 1, final


def random_edits(rng, n):
    """Edits of one text with ``n`` tokens; no two removed ranges start at one place."""
    rows = []
    for pos in rng.sample(range(n - 1), k=min(n - 1, 8)):
        k = rng.choice("xrtTqwbaghHDzld")
        end = rng.randrange(pos, min(n - 1, pos + 6)) if k in "xr" else None
        o = rng.randrange(1, 5) if k in "xrhHDzb" else None
        text = rng.choice(["u", " v", "w\n"]) if k in "rtTqwbagz" else None
        rows.append((k, pos, end, o, rng.randrange(1, 3) if k in "hHDz" else None, True if k in "hHD" else None, text, [pos, pos] if k == "z" else None))
        if k in "tT":
            rows += [(e, pos, None, rng.randrange(1, 5), 1, True, None, None) for e in "hHDD"]
    if rng.random() < 0.3:
        a = rng.randrange(n - 3)
        rows.append(("S", a, a + 2, None, None, None, None, [a + 2, a + 1, a]))
    return rows


def test_edits_merge_in_the_row_as_they_do_as_rows(spark):
    rng = random.Random(5)
    texts = ["a = f(b, c)  # x\n  d(e)\r\nif g:\n    h = [1, 2]\n", "u\r\n  # c\r\nf(é, \"ß\", f'{x!r} {y}')\n@q\ndef z(): pass", "a b c d e f g"]
    files = spark.createDataFrame([(1, i, texts[i % 3]) for i in range(60)], "path_id int, file_id long, content string")
    files = files.withColumn("lexed", token_structs(F.col("content")))
    sizes = {r.file_id: (len(r.lexed), [len(x) for t in r.lexed for x in (t.pre, t.tok)]) for r in files.collect()}
    edits = spark.createDataFrame([(1, i, *e) for i, (n, _) in sizes.items() for e in random_edits(rng, n)], EDITS)
    as_rows = stitch(files.drop("lexed").join(file_edits(edits).drop("path_id"), "file_id"))
    cuts = spark.createDataFrame(
        [(i, b"".join(x.to_bytes(4, "little") for x in lengths)) for i, (_, lengths) in sizes.items()], "file_id long, cuts binary")
    grouped = edits.groupBy("file_id").agg(F.collect_list(F.struct("k", "pos", "end", "o", "m", "c", "txt", "src")).alias("edits"))
    in_row = merge(files.drop("lexed").join(cuts, "file_id").join(grouped, "file_id"))

    def found(frame):
        return {r.file_id: (r.code, sorted((h.o, h.m, h.c) for h in r.hits)) for r in frame.select("file_id", "code", "hits").collect()}

    assert found(in_row) == found(as_rows)


def test_entities_of_a_text():
    toks = ["def", "h", "(", "a", ",", "s", "=", "1", ")", ":", "f", "(", "(", "b", ")", ",", "k", "=", "2", ")", ""]
    pres = [""] + [" "] * 9 + ["\n  "] + [""] * 9 + ["\n"]
    need, kinds = frozenset({"names", "depth", "definitions", "alone"}), frozenset({"add_arg", "default", "reorder"})
    found = reader(need, kinds)(pres, toks, 7, {"f": 5, "h": 16, "s": 32}, frozenset())
    assert [(e[0], e[1], e[2], [r[0] for r in e[8]]) for e in found] == [
        ("n", 10, "f", [10]), ("c", 11, "f", [11, 15, 19]), ("d", 2, "h", [2, 4, 8]), ("p", 4, "s", [4])]
    call, parameter = found[1], found[3]
    assert call[4] and call[5:7] == (10, "  ") and parameter[7] == "h" and parameter[8][0][8:] == (6, 7)
