"""Changelogs: reading, versions, merging, paths, validation."""

import json

import pytest
from pyspark.sql import functions as F

from apidrift.functions.lexing import expression_valid
from apidrift.functions.versions import version_key
from apidrift.operators import paths, validation
from apidrift.operators.rulebook import compile_rules, register_handler, HANDLERS
from apidrift.sources import changelogs


def docs(spark, **contents):
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in contents.items()]
    return spark.createDataFrame(rows, "doc_id string, content string")


def one_rule(**fields):
    return {"id": "R1", "change_type": "rename_function", "version_introduced": "2.0.0", "description": "d",
            "old_name": "foo", "new_name": "bar", **fields}


def doc(*rules, version="2.0.0", **extra):
    return {"library": "mylib", "versions": [{"version": version, "rules": list(rules)}], **extra}


def release_list(*versions):
    return {"library": "lib", "versions": [
        {"version": v, "rules": [one_rule(id=f"R-{v}", version_introduced=v, old_name=f"f{v}".replace(".", "_"),
                                          new_name=f"g{v}".replace(".", "_"))]} for v in versions]}


def test_read_object_and_bare_list(spark):
    d = docs(spark, a=doc(one_rule(id="RULE-001")), b=[{"version": "1.0.0", "rules": [one_rule()]}], c="# notes")
    rows = {r.doc_id: r for r in changelogs.read_changelogs(d).collect()}
    assert (rows["a"].library, rows["a"].id, rows["a"].old_name, rows["a"].new_name) == (
        "mylib", "RULE-001", "foo", "bar")
    assert rows["b"].library == "unknown" and "c" not in rows
    errors = {r.doc_id: r.error for r in changelogs.documents(d).collect()}
    assert errors["a"] is None and errors["b"] is None and "auto-detect" in errors["c"]
    with pytest.raises(ValueError):
        changelogs.documents(d, "yaml")


def test_version_order(spark):
    rows = spark.createDataFrame([(v,) for v in ("1.10.0", "2.0.0", "1.9.0", "1.2.1")], "v string")
    assert [r.v for r in rows.orderBy(version_key("v")).collect()] == ["1.2.1", "1.9.0", "1.10.0", "2.0.0"]


def test_merge_and_update(spark):
    old = changelogs.versions(docs(spark, a=release_list("1.0.0", "2.0.0")))
    new = changelogs.versions(docs(spark, a=release_list("1.0.0", "2.0.0", "3.0.0", "3.0.0")))
    assert [(r.version, r.vpos) for r in changelogs.merge_changelogs(old, new).collect()] == [("3.0.0", 3)]
    assert changelogs.update_changelogs(old, new).count() == 3


@pytest.fixture(scope="module")
def releases(spark):
    d = docs(spark, lib=release_list("1.0.0", "1.5.0", "2.0.0", "2.5.0", "3.0.0", "1.10.0"))
    return changelogs.versions(d), changelogs.read_changelogs(d)


def test_paths(spark, releases):
    vs, rules = releases
    pins = spark.createDataFrame([
        ("up", "lib", "1.0.0", "3.0.0"), ("down", "lib", "3.0.0", "1.0.0"), ("same", "lib", "2.0.0", "2.0.0"),
        ("latest", "lib", "0.0.0", "latest"), ("short", "lib", "1.5", "2"), ("none", "other", "1.0.0", "2.0.0"),
    ], "repo string, library string, from_version string, to_version string")
    got = {}
    for r in paths.resolve_paths(pins, vs, rules).orderBy("repo", "ordinal").collect():
        got.setdefault(r.repo, []).append((r.ordinal, r.version, r.old_name, r.description))
    assert [g[1] for g in got["up"]] == ["1.5.0", "1.10.0", "2.0.0", "2.5.0", "3.0.0"]
    assert [g[0] for g in got["up"]] == [1, 2, 3, 4, 5]
    assert [g[1] for g in got["down"]] == ["3.0.0", "2.5.0", "2.0.0", "1.10.0", "1.5.0"]
    assert got["down"][0][2:] == ("g3_0_0", "[DOWNGRADE] d")
    assert "same" not in got and "none" not in got
    assert len(got["latest"]) == 6
    assert [g[1] for g in got["short"]] == ["1.10.0", "2.0.0"]
    steps = paths.path_steps(paths.version_range(paths.resolve_pins(pins, vs), vs))
    walk = [(r.step_from, r.step_to) for r in steps.where("repo = 'down'").orderBy("step").collect()]
    assert walk == [("3.0.0", "2.5.0"), ("2.5.0", "2.0.0"), ("2.0.0", "1.10.0"), ("1.10.0", "1.5.0"), ("1.5.0", "1.0.0")]


def test_round_trip_and_export(spark):
    d = docs(spark, a=doc(one_rule(tags=["t"], extra={"k": [1, "x"]}, new_order=["b", "a"]), one_rule(id="R2")))
    vs, rules = changelogs.versions(d), changelogs.read_changelogs(d)
    out = changelogs.export_rules(vs, rules, generated="2024-01-01").collect()[0].content
    data = json.loads(out)
    assert data["library"] == "mylib" and data["generated"] == "2024-01-01"
    first = data["versions"][0]["rules"][0]
    assert first["extra"] == {"k": [1, "x"]} and first["new_order"] == ["b", "a"] and first["safety"] == "safe"
    assert "default_value" not in first and "notes" not in data["versions"][0]
    again = changelogs.read_changelogs(docs(spark, a=out))
    cols = [c for c in rules.columns if c != "raw_rule"]
    assert again.select(cols).exceptAll(rules.select(cols)).count() == 0


BAD = {
    "no_id": (doc({k: v for k, v in one_rule().items() if k != "id"}), ("missing_required", "id")),
    "version": (doc(one_rule(version_introduced="v2")), ("bad_version", "v2")),
    "newline": (doc(one_rule(version_introduced="2.0.0\n")), ("bad_version", "2.0.0\n")),
    "no_new_name": (doc(one_rule(new_name=None)), ("missing_field", "new_name")),
    "duplicate": (doc(one_rule(), one_rule(old_name="o", new_name="p")), ("duplicate_id", "2")),
    "conflict": (doc(one_rule(), one_rule(id="R2", new_name="baz")), ("conflicting_rename", "rename_function foo")),
    "default": (doc(one_rule(default_value="class class # syntax error")),
                ("bad_default", "class class # syntax error")),
    "unknown": (doc(one_rule(unknown_field="123")), ("unknown_field", "unknown_field")),
    "type": (doc(one_rule(tags="x")), ("bad_type", "tags")),
    "enum": (doc(one_rule(change_type="nope")), ("bad_value", "change_type=nope")),
    "doc_field": (doc(one_rule(), author="me"), ("unknown_field", "author")),
    "no_library": ({"versions": []}, ("missing_required", "library")),
    "not_json": ("# text", ("unreadable", "Unsupported format or could not auto-detect JSON: auto")),
}


def test_validation(spark):
    good = {"good": doc(one_rule(default_value="f(x, [1])"), one_rule(id="R2", change_type="remove_class"))}
    d = docs(spark, **good, **{k: v[0] for k, v in BAD.items()})
    found = {}
    for r in validation.validate_changelogs(d).collect():
        found.setdefault(r.doc_id, set()).add((r.kind, r.detail))
    assert found == {k: {v[1]} for k, v in BAD.items()}
    with pytest.raises(ValueError, match="unknown_field"):
        validation.validate_changelogs(docs(spark, a=BAD["unknown"][0]), strict=True)
    assert validation.validate_changelogs(docs(spark, a=good["good"]), strict=True).count() == 0


def test_report_needs_no_sorted_rows(spark, capsys):
    """The checks across rules count texts by hash; values of a rename differ, agree or are missing."""
    renames = [("a", "b"), ("a", "c"), ("a", "b"), ("d", "e"), ("d", "e"), ("d", None), ("f", None), ("f", None)]
    rules = [{"id": f"R{i % 7}", "change_type": "rename_class", "version_introduced": "1.0.0", "description": "d",
              "old_name": old, **({"new_name": new} if new else {})} for i, (old, new) in enumerate(renames)]
    out = validation.validate_changelogs(docs(spark, lib={"library": "lib", "versions": [{"version": "1.0.0", "rules": rules}]}))
    out.explain()
    assert "SortAggregate" not in capsys.readouterr().out
    assert sorted((r.kind, r.detail) for r in out.collect()) == [
        ("conflicting_rename", "rename_class a"), ("duplicate_id", "2"), *[("missing_field", "new_name")] * 3]


def test_types_by_shape_agree_with_each_field(spark, monkeypatch):
    """What a rule's shape settles at once is what a look at every field says."""
    odd = ['{"id": "a", "description": "d"}', '{"id": 5, "tags": ["x"]}', '{"tags": [], "new_order": ["a", 1]}', '{"tags": null, "argument_position": 3}',
           '{"argument_position": 3.5}', '{"argument_position": "3"}', '{"extra": {"a": 1}}', '{"extra": "x"}', '{"odd key, id: STRING": 1, "old_name": true}',
           '{"unknown": {"id": 1}, "safety": 2}', '{"unknown": "x", "safety": "safe"}', '{"idx": 1, "id": []}', "{}", "[]", "7", "no json", None]
    rows = spark.createDataFrame([(str(i), t, i, i, "r") for i, t in enumerate(odd)], "doc_id string, raw_rule string, vpos int, pos int, id string")
    found = lambda: sorted((r.doc_id, r.detail) for r in validation.bad_types(rows).collect())
    by_shape = found()
    monkeypatch.setattr(validation, "WELL_TYPED", "^never$")
    assert by_shape == found() and len({d for d, _ in by_shape}) >= 7


def test_expressions(spark):
    good = ["1", "-x", "f(a, b=1)", "[1, 2]", "'a' 'b'", "not x", "a if b else c", "lambda x: x + 1", "{'a': 1}", "None"]
    bad = ["", "class class", "f(", "a b", "1 2", "x =1", "'a", "return 1", "a +", "* a", "(]", "x;y"]
    rows = spark.createDataFrame([(e, True) for e in good] + [(e, False) for e in bad], "e string, ok boolean")
    assert rows.where(expression_valid(F.col("e")) != F.col("ok")).collect() == []


def test_register_handler(spark):
    register_handler("rename_symbol", "rename")
    try:
        rules = spark.createDataFrame([(1, 1, "rename_symbol", "a", "b")],
                                      "path_id int, ordinal int, change_type string, old_name string, new_name string")
        assert compile_rules(rules).kinds == {"rename"}
    finally:
        del HANDLERS["rename_symbol"]
    with pytest.raises(ValueError):
        register_handler("x", "unknown")
