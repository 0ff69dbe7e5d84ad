"""Whole migrations: several libraries, failures, many rules, plan size."""

import json
import time

from pyspark.sql import functions as F

from apidrift.functions.versions import version_key
from apidrift.operators import validation
from apidrift.operators.paths import plan_migrations
from apidrift.operators.rewrite import migrate
from apidrift.operators.rulebook import compile_rules
from apidrift.sources import changelogs
from tests.helpers import files_frame, rule, rules_frame


def changelog(library, *renames):
    return (library, json.dumps({"library": library, "versions": [
        {"version": f"{i + 2}.0.0", "rules": [{
            "id": f"{library}{i}", "change_type": "rename_function", "version_introduced": f"{i + 2}.0.0", "description": "d",
            "old_name": old, "new_name": new}]} for i, (old, new) in enumerate(renames)]}))


def test_libraries_of_a_repository_compose(spark):
    docs = spark.createDataFrame(
        [changelog("alpha", ("x", "xx"), ("xx", "xxx")), changelog("beta", ("y", "yy"))], "doc_id string, content string")
    pins = spark.createDataFrame(
        [("r1", "alpha", "1.0.0", "latest"), ("r1", "beta", "1.0.0", "latest"), ("r2", "beta", "1.0.0", "latest"),
         ("r4", "alpha", "3.0.0", "latest")],
        "repo string, library string, from_version string, to_version string")
    files = spark.createDataFrame(
        [(i, f"r{i}", "a.py", "x(y)\n") for i in (1, 2, 3, 4)], "file_id long, repo string, path string, content string")
    placed, rules = plan_migrations(files, pins, changelogs.versions(docs), changelogs.read_changelogs(docs))
    rows = migrate(placed, rules).collect()
    assert {r.repo: (r.transformed_code, len(r.changes), r.success) for r in rows} == {
        "r1": ("xxx(yy)\n", 3, True), "r2": ("x(yy)\n", 1, True), "r3": ("x(y)\n", 0, True), "r4": ("x(y)\n", 0, True)}
    assert len(rows) == 4


def test_a_rule_that_fails_leaves_the_others(spark):
    rules = rules_frame(spark, {1: [
        rule("add_argument", function_name="f", argument_name="a", default_value="class class", description="bad"),
        rule("rename_function", old_name="g", new_name="h")]})
    files = files_frame(spark, {1: "f(1)\ng(2)\n"}).union(
        files_frame(spark, {1: "g(3)\n"}).withColumn("file_id", F.lit(2).cast("long")))
    rows = {r.file_id: r for r in migrate(files, rules).collect()}
    assert rows[1].transformed_code == "f(1)\nh(2)\n" and not rows[1].success
    assert rows[1].errors == ["Rule 'bad' failed: Invalid expression: class class"]
    assert rows[2].transformed_code == "h(3)\n" and rows[2].success


def test_many_defaults_stay_one_round(spark):
    defaults = ["[]", "{}", "g()", "a.b", "lambda: 0"]
    rules = rules_frame(spark, {1: [
        rule("add_argument", function_name="f", argument_name=f"p{i}", default_value=defaults[i % 5]) for i in range(20)]})
    start = time.time()
    book = compile_rules(rules)
    assert book.rounds == 1
    code = migrate(files_frame(spark, {1: "f()\n"}), rules, book=book).collect()[0].transformed_code
    assert code == "f(" + ", ".join(f"p{i}={defaults[i % 5]}" for i in range(20)) + ")\n"
    assert time.time() - start < 60


def test_rounds_that_are_needed_do_not_multiply_the_plan(spark):
    rules = rules_frame(spark, {1: [r for i in range(5) for r in (
        rule("add_argument", function_name=f"f{i}", argument_name="p", default_value=f"f{i + 1}()"),)]})
    book = compile_rules(rules)
    assert book.rounds > 3
    out = migrate(files_frame(spark, {1: "f0()\n"}), rules, book=book)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") < 60
    assert out.collect()[0].transformed_code == "f0(p=f1(p=f2(p=f3(p=f4(p=f5())))))\n"


def test_long_version_numbers(spark):
    names = ["2024.1.20240115123456", "2024.1.3", "1." + "9" * 50, "1.5"]
    rows = spark.createDataFrame([(n,) for n in names], "v string").orderBy(version_key("v")).collect()
    assert [r.v for r in rows] == ["1.5", "1." + "9" * 50, "2024.1.3", "2024.1.20240115123456"]


def test_renamed_arguments_validate(spark):
    def document(**fields):
        return json.dumps({"library": "l", "versions": [{"version": "2.0.0", "rules": [{
            "id": "R", "change_type": "rename_argument", "version_introduced": "2.0.0", "description": "d", **fields}]}]})

    docs = spark.createDataFrame([
        ("good", document(function_name="f", argument_name="a", new_argument_name="b")), ("bad", document(function_name="f", argument_name="a")),
    ], "doc_id string, content string")
    assert [(r.doc_id, r.kind, r.detail) for r in validation.validate_changelogs(docs).collect()] == [("bad", "missing_field", "new_argument_name")]


def test_versions_without_rules_count_zero(spark):
    docs = spark.createDataFrame([
        changelog("alpha", ("x", "xx")), ("beta", json.dumps({"library": "beta", "versions": [{"version": "1.0.0", "rules": []}]})),
    ], "doc_id string, content string")
    rows = changelogs.versions(docs)
    assert {(r.library, r.n_rules) for r in changelogs.count_rules(rows, "library").collect()} == {("alpha", 1), ("beta", 0)}
    assert {(r.library, r.version, r.n_rules) for r in changelogs.count_rules(rows, "library", "version").collect()} == {
        ("alpha", "2.0.0", 1), ("beta", "1.0.0", 0)}
