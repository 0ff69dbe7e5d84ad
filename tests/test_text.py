"""Lexer, files, reports and sinks."""

import ast
import difflib
import io
import tokenize

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from apidrift.functions.lexing import lexically_valid, token_pieces, token_texts
from apidrift.operators import report
from apidrift.operators.rewrite import migrate
from apidrift.sources import files, sinks
from tests.helpers import files_frame, rule, rules_frame

SOURCES = [
    'def f(a, *b, c=1, **d) -> x[int]:\n    """doc\n    "quoted" """\n    return a @ b[1:2, ...] if c else lambda: 0\n',
    "x = 0x1F + 1_000.5e-3j + .5 + 1. # c\ny: int = rb'\\'' u\"a\\\n b\"\nz = (a :=\n 1)\n",
    "class A(B, metaclass=M):\r\n\tasync def g(self):\r\n\t\tawait x; yield y\r\n",
    "é = ñ.名前(µ)\nif a \\\n   and b: pass\n",
    "x = ''''a' '''; y = \"\"\"\\\"\"\" \"\"\"; z = ''; w = \"\"\n",
    "f'{a!r:>{w}}' f\"{x['k']}\"\nx = a if not b else -c ** ~d // e << 1 >= 2 != 3\n",
]


def reference_tokens(source):
    skip = {tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT, tokenize.ENDMARKER}
    out, depth = [], 0
    for t in tokenize.generate_tokens(io.StringIO(source).readline):
        if t.type == tokenize.FSTRING_START:
            depth += 1
            if depth == 1:
                out.append("<f>")
        elif t.type == tokenize.FSTRING_END:
            depth -= 1
        elif not depth and t.type not in skip:
            out.append(t.string)
    return out


def test_tokens_agree_with_tokenize(spark):
    rows = spark.createDataFrame(list(enumerate(SOURCES)), "i int, s string").select(
        "i", token_texts(F.col("s")).alias("t"), F.array_join(token_pieces(F.col("s")), "").alias("joined"),
        lexically_valid(F.col("s")).alias("ok")).collect()
    for r in rows:
        assert r.joined == SOURCES[r.i] and r.ok
        got = ["<f>" if t[:1] in "fF" and t[-1:] in "'\"" else t for t in r.t if t]
        assert got == reference_tokens(SOURCES[r.i])


def test_long_texts_do_not_overflow(spark):
    text = '"""' + "a \\\" \" b\n" * 50_000 + '"""\n' + "# c\n  \n" * 50_000 + "x = '" + "\\'" * 50_000 + "'\n"
    row = spark.createDataFrame([(text,)], "s string").select(
        F.size(token_texts(F.col("s"))).alias("n"), lexically_valid(F.col("s")).alias("ok")).collect()[0]
    assert row.ok and row.n in (5, 6)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab_1 .,:;()[]{}=\"'\\#\n\r\tfr+-*/@!$é", max_size=60), min_size=40, max_size=40))
def test_lexer_is_lossless(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    assert rows.where(F.array_join(token_pieces(F.col("s")), "") != F.col("s")).count() == 0


def test_lexical_validity(spark):
    good = ["def bar():\n    pass\n", "", "x = '(' # )\n"]
    bad = ["def bar(: pass", "x = (]", "a)", "'abc", "x = \\ 1", '"""a']
    rows = spark.createDataFrame([(s, True) for s in good] + [(s, False) for s in bad], "s string, ok boolean")
    assert rows.where(lexically_valid(F.col("s")) != F.col("ok")).collect() == []


def test_globs(spark):
    names = {"a/test_helpers/x.py": False, "test_x.py": True, "a/test_x.py": False, "a/__pycache__/x.py": False,
             "a/x.txt": False, "a/mytest_.py": True, "__init__.py": True}
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path for r in files.scan(rows).collect()} == {n for n, ok in names.items() if ok}
    assert files.glob_regex("a[!b]?.py") == r"(?s)\Aa[^b].\.py\z"


def test_directory_to_sinks(spark, tmp_path_factory):
    # the globs see whole paths, so a folder named test_... would exclude everything in it
    tmp_path = tmp_path_factory.mktemp("work")
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "pkg" / "__init__.py").write_text("from m import old\n")
    (tmp_path / "src" / "pkg" / "test_a.py").write_text("old\n")
    (tmp_path / "src" / "top.py").write_text("keep = 1\n")
    (tmp_path / "src" / "broken.py").write_text("old(\n")
    (tmp_path / "src" / "latin.py").write_bytes(b"x = '\xe9'\n")
    source = files.read_directory(spark, str(tmp_path / "src"), repo="r").withColumn("path_id", F.lit(1))
    assert {r.path.rsplit("/", 1)[1]: r.error for r in source.collect()} == {
        "__init__.py": None, "top.py": None, "broken.py": None, "latin.py": "invalid UTF-8"}
    rules = rules_frame(spark, {1: [rule("rename_function", old_name="old", new_name="new", description="why"),
                                    rule("remove_class", old_name="x")]})
    results = migrate(source, rules)
    rows = {r.path.rsplit("/", 1)[1]: r for r in results.collect()}
    assert rows["__init__.py"].transformed_code == "from m import new\n" and rows["top.py"].success
    assert rows["broken.py"].transformed_code == "old(\n"
    assert rows["latin.py"].errors == ["invalid UTF-8"] and not rows["latin.py"].success and not rows["latin.py"].was_modified
    assert [e[:38] for e in rows["broken.py"].errors] == ["Rule 'why' failed: Syntax error in sou"]
    total = report.summarize(results, None).collect()[0]
    assert (total.files_processed, total.files_modified, total.files_failed, total.total_changes) == (4, 1, 2, 1)
    sinks.write_migrated(results, str(tmp_path / "out"))
    kinds = {r.kind: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(kinds) == {"migrated", "backup"} and kinds["migrated"].content == "from m import new\n"
    assert kinds["backup"].content == "from m import old\n" and kinds["backup"].written_path.endswith("/__init__.py.bak")
    lines = [r.line for r in report.report_lines(results, "1.0.0", "2.0.0").orderBy("part", "path", "seq").collect()]
    assert lines[:3] == ["Migration Report: v1.0.0 -> v2.0.0", "=" * 50, "Files processed : 4"]
    assert "    ✓ Renamed function: old -> new" in lines


def test_dry_run_preview_and_checks(spark):
    before = "import os\n" * 10 + "f(\n  v=1,\n  w=2)\n" + "x = 1\n" * 9 + "f(3)\nold()"
    rules = rules_frame(spark, {1: [rule("remove_argument", function_name="f", argument_name="v"),
                                    rule("deprecate_function", old_name="old", replacement="new")],
                                2: [rule("rename_function", old_name="zzz", new_name="y")]})
    source = files_frame(spark, {1: before, 2: "nothing = 1\n"})
    results = migrate(source, rules)
    after = "import os\n" * 10 + "f(\n  w=2)\n" + "x = 1\n" * 9 + (
        "f(3)\n# DEPRECATED: old() is deprecated. Use new instead.\nold()")
    got = {r.path_id: r for r in results.collect()}
    assert got[1].transformed_code == after
    ast.parse(got[1].transformed_code)
    shown = {r.path_id: r.preview for r in report.preview(results).collect()}
    diff = "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), "original", "migrated"))
    assert shown[1] == "\nChanges:\n  - Removed argument 'v' from f()\n  - Marked old() as deprecated\n\n" + diff
    assert shown[2] == "No changes would be made."
    dry = {r.path_id: r for r in migrate(source, rules, dry_run=True).collect()}
    assert dry[1].transformed_code == before and not dry[1].was_modified and dry[1].would_modify
    assert len(dry[1].changes) == 2 and not dry[2].would_modify
    only = migrate(source, rules, only_modified=True).collect()
    assert [r.path_id for r in only] == [1]


def test_validate_migration(spark):
    rows = spark.createDataFrame([
        (1, 1, "r", "p", "def foo():\n    pass\n", "def bar():\n    pass\n"),
        (1, 2, "r", "p", "def foo(): pass", "def bar(: pass"), (1, 3, "r", "p", "a\nb\nc\n", "a\n"),
    ], "path_id int, file_id int, repo string, path string, original_code string, transformed_code string")
    got = {r.file_id: (r.is_valid, list(r.issues)) for r in report.validate_migration(rows).collect()}
    assert got[1] == (True, []) and got[2][0] is False
    assert got[3] == (True, ["Warning: migrated code has significantly fewer lines (1 vs 3)"])


def test_rename_and_back(spark):
    sources = {i: s for i, s in enumerate(SOURCES)}
    there = {i: [rule("rename_function", old_name="x", new_name="fresh_name")] for i in sources}
    back = {i: [rule("rename_function", old_name="fresh_name", new_name="x")] for i in sources}
    once = migrate(files_frame(spark, sources), rules_frame(spark, there))
    twice = migrate(once.select("path_id", "file_id", "repo", "path", F.col("transformed_code").alias("content")),
                    rules_frame(spark, back))
    assert {r.path_id: r.transformed_code for r in twice.collect()} == sources
