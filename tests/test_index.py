"""Occurrence index against counting from scratch; loose versions against every pair; own operations."""

import random
import re
from collections import Counter

import pytest

from apidrift.operators import entities, index, paths, rulebook
from apidrift.operators.paths import loose_matches, resolve_pins
from apidrift.sources import changelogs
from apidrift.operators.rewrite import migrate
from apidrift.functions.versions import version_key
from tests.helpers import files_frame, rule, rules_frame


def counted(files):
    return {(k, name): n for k, text in files.items() for name, n in Counter(re.findall(r"[^\W\d]\w*", text or "")).items()}


def test_updates_equal_rebuilds(spark, tmp_path):
    rnd = random.Random(1)
    words = ["foo", "bar", "baz", "é", "x1", "1", "+", "'foo'"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(9)))
    files = {i: text() for i in range(80)} | {100: None, 101: "", 102: "foo " * 500}
    frame = lambda part: spark.createDataFrame(list(part.items()), "key int, content string")
    now = index.build(frame(files), ["key"])
    every = spark.createDataFrame([(w,) for w in ["foo", "bar", "baz", "é", "x1", "gone"]], "name string")
    for turn in range(3):
        got = {(r.key, r.name): r.n for r in index.occurrences(now, every).collect()}
        assert got == counted(files)
        assert {r.key for r in index.touched(now, every.where("name = 'é'")).collect()} == {k for k, t in files.items() if "é" in (t or "")}
        now.save(f"{tmp_path}/{turn}")
        known = {t for t in files.values() if t is not None}
        for k in rnd.sample(sorted(files), 8):  # changed, moved and deleted files
            files[k] = rnd.choice([text(), files[rnd.choice(sorted(files))]])
        del files[rnd.choice(sorted(files))]
        now, fresh = index.update(index.Index.load(spark, f"{tmp_path}/{turn}", ["key"]), frame(files))
        assert fresh.count() == len({t for t in files.values() if t is not None} - known)


def test_loose_versions_like_every_pair(spark):
    rnd = random.Random(2)
    versions = [(lib, f"{rnd.randrange(3)}.{rnd.randrange(12)}.{rnd.randrange(3)}") for lib in "ab" for _ in range(25)]
    asked = [(lib, q) for lib in "abc" for q in ["", "1", "1.1", "2.0", "1.10.2.1", "0.1.0-rc", "x", *(v for _, v in versions[:5])]]
    listed = spark.createDataFrame(sorted(set(versions)), "library string, version string").withColumn("version_key", version_key("version"))
    got = {(r.library, r.asked): r.hit.version for r in loose_matches(spark.createDataFrame(asked, "library string, asked string"), listed).collect()}
    key = lambda v: [int(x) for x in re.findall(r"\d+", v)]
    want = {}
    for lib, q in asked:
        if hits := [v for of, v in versions if of == lib and (v.startswith(q) or q.startswith(v))]:
            want[lib, q] = min(hits, key=lambda v: (key(v), v))
    assert got == want


def test_pins_of_one_library_are_answered_once(spark):
    listed = spark.createDataFrame([("a", "1.0.0"), ("a", "1.10.0"), ("a", "1.9.0")], "library string, version string").withColumn("version_key", version_key("version"))
    pins = spark.createDataFrame(
        [(f"r{i}", "a", "1.0", "latest") for i in range(500)] + [("x", "a", "0.0.0", "7"), ("y", "none", "1", "latest"), ("z", "a", None, "1.9")],
        "repo string, library string, from_version string, to_version string")
    got = {r.repo: (r.source_version, r.target_version, r.is_upgrade) for r in resolve_pins(pins, listed).collect()}
    assert {got[f"r{i}"] for i in range(500)} == {("1.0.0", "1.10.0", True)} and len(got) == 503
    assert got["x"] == ("0.0.0", "7", True) and got["y"][:2] == ("1", None) and got["z"][:2] == (None, "1.9.0")


def test_only_hot_libraries_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(paths, "HOT_PINS", 100)
    listed = spark.createDataFrame([(lib, v) for lib in "ab" for v in ("1.0.0", "1.10.0")], "library string, version string").withColumn(
        "version_key", version_key("version"))
    pins = spark.createDataFrame(
        [(f"r{i}", "a", "1.0", "latest") for i in range(200)] + [("s", "b", "1.0.0", "1.1"), ("t", None, "1", "2"), (None, "b", "1", "2")],
        "repo string, library string, from_version string, to_version string")
    got = sorted((str(r.library), r.source_version, r.target_version) for r in resolve_pins(pins, listed).collect())
    assert got[0] == ("None", None, None) and got[1:201] == [("a", "1.0.0", "1.10.0")] * 200
    assert got[201:] == [("b", "1.0.0", "1.10.0"), ("b", "1.0.0", "2")]


def test_paths_parse_versions_once(spark, capsys):
    content = '{"library": "a", "versions": [{"version": "1.0.0", "rules": []}, {"version": "2.0.0", "rules": []}]}'
    docs = spark.createDataFrame([("d", content)], "doc_id string, content string")
    pins = spark.createDataFrame([("r", "a", "1.0.0", "latest")], "repo string, library string, from_version string, to_version string")
    versions = paths.listed(changelogs.versions(docs))
    passed = paths.version_range(resolve_pins(pins, versions), versions)
    passed.explain()
    assert "from_json" not in capsys.readouterr().out
    assert [(r.version, r.n_rules, r.vpos, r.doc_id) for r in passed.collect()] == [("2.0.0", 0, 1, "d")]


def test_own_operation(spark):
    second = rulebook.CallOperation(
        acts="not attr and size(s.args) = 0", message="concat('Closed ', function_name)", callee="r.b", second="new_name")
    cases = {0: ([rule("close_call", function_name="end", new_name="shut"), rule("rename_function", old_name="shut", new_name="close")],
                 "end()\nx.end()\nend(1)\nf(end( ))\n", "close()\nx.end()\nend(1)\nf(close( ))\n")}
    with rulebook.registered("close_call", second):
        out = migrate(files_frame(spark, {k: c[1] for k, c in cases.items()}), rules_frame(spark, {k: c[0] for k, c in cases.items()}))
    with pytest.raises(ValueError):
        rulebook.register_operation("rename_function", second)
    assert "close_call" not in rulebook.HANDLERS
    r = out.collect()[0]
    assert r.changes.count("Closed end") == 2
    assert entities.drop_argument().startswith("transform(s.args")
