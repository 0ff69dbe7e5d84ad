"""Queries over the given tables, one per operator, with their check in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.functions.lexing import lexically_valid
from apidrift.operators import entities, index, paths, report, rulebook, validation
from apidrift.operators.rewrite import migrate
from apidrift.operators.rulebook import HANDLERS, handler_table
from apidrift.operators.structure import structure, tokens
from apidrift.plans import corpora
from apidrift.plans.corpora import EXAMPLE, OPERATIONS, table
from apidrift.session import settled, shared_folder, text_partitions
from apidrift.sources import changelogs, files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_RULES = corpora.RULE_ROWS.format(orders="orders")
_VERSIONS = corpora.VERSION_ROWS.format(orders="orders")
_PINS = corpora.PINS.format(orders="orders")
_KEY = "CAST(regexp_extract_all({0}, '[0-9]+') AS INT[])"


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def _docs(spark, sf_dir, **kw):
    return corpora.changelog_documents(spark, sf_dir, **kw)


def _rules(spark, sf_dir):
    return changelogs.read_changelogs(_docs(spark, sf_dir))


def _versions(spark, sf_dir):
    return changelogs.versions(_docs(spark, sf_dir))


_JOINED = f"SELECT r.*, v.vpos, v.first_k, v.n_rules FROM ({_RULES}) r JOIN ({_VERSIONS}) v USING (library, version)"

# ---------------------------------------------------------------- sources, scalars


@query("s1_read_json", f"""
    SELECT library, version, vpos, pos, id, change_type, version_introduced, description, old_name, new_name,
      function_name, argument_name, default_value, old_module, new_module, source_module, target_module,
      decorator_name, coalesce(safety, 'safe') AS safety, order_text AS new_order
    FROM ({_JOINED}) j""")
def s1(spark, sf_dir):
    return _rules(spark, sf_dir).select(
        "library", "version", "vpos", "pos", "id", "change_type", "version_introduced", "description",
        "old_name", "new_name", "function_name", "argument_name", "default_value", "old_module", "new_module",
        "source_module", "target_module", "decorator_name", "safety",
        F.when(F.col("new_order").isNotNull(), F.array_join("new_order", ",")).alias("new_order"))


@query("s2_bare_list", f"""
    SELECT library AS doc_id, 'unknown' AS library, version, vpos, n_rules FROM ({_VERSIONS}) v""")
def s2(spark, sf_dir):
    return changelogs.versions(_docs(spark, sf_dir, bare=True)).select(
        "doc_id", "library", "version", "vpos", "n_rules")


_MIXED = """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"library": "a", "versions": []}'
        WHEN 1 THEN chr(10) || '  [{"version": "1.0.0"}]' WHEN 2 THEN '# ' || text
        WHEN 3 THEN ' {"library": "b", "versions": [{"version": "1.0.0"}, {"version": "2.0.0"}]}'
        ELSE text END AS content FROM """


@query("s3_format_detection", f"""
    SELECT doc_id, regexp_matches(content, '^\\s*[\\[{{]') AS is_json,
      CASE WHEN doc_id % 5 = 1 THEN 'unknown' WHEN doc_id % 5 = 0 THEN 'a' WHEN doc_id % 5 = 3 THEN 'b' END AS library,
      CASE doc_id % 5 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS n_versions
    FROM ({_MIXED} documents) d""")
def s3(spark, sf_dir):
    docs = spark.sql(_MIXED.replace("{", "{{").replace("}", "}}") + "{documents}",
                     documents=table(spark, sf_dir, "documents"))
    return changelogs.documents(docs).select(
        "doc_id", changelogs.looks_like_json(F.col("content")).alias("is_json"),
        "library", F.size("raw_versions").alias("n_versions"))


_PATHS = """
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'pkg/m' || event_id || '.py' WHEN 1 THEN 'test_' || event_id || '.py'
        WHEN 2 THEN 'a/test_helpers/x' || event_id || '.py' WHEN 3 THEN 'a/__pycache__/x' || event_id || '.py'
        WHEN 4 THEN 'b/test_' || event_id || '.py' WHEN 5 THEN 'doc' || event_id || '.txt'
        WHEN 6 THEN 'pkg/__init__.py' ELSE 'my_test_x' || event_id || '.py' END AS path FROM """


@query("s4_scan_exclude", f"""
    SELECT event_id, path FROM ({_PATHS} events) f
    WHERE path LIKE '%.py' AND path NOT LIKE '%/test!_%.py' ESCAPE '!' AND path NOT LIKE '%/!_!_pycache!_!_/%' ESCAPE '!'""")
def s4(spark, sf_dir):
    rows = spark.sql(_PATHS + "{events}", events=table(spark, sf_dir, "events"))
    return files.scan(rows).select("event_id", "path")


@query("s6_undecodable_files", """
    SELECT doc_id, doc_id % 7 <> 0 AS readable, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(text) END AS n_chars
    FROM documents""")
def s6(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.when(
        F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C328")))
    ).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return files.decode(raw).select(
        "doc_id", F.col("error").isNull().alias("readable"), F.length("content").alias("n_chars"))


@query("s9_rules_export", f"""
    SELECT library, version, vpos, release_date, pos, id, change_type, description, default_value,
      order_text AS new_order, coalesce(safety, 'safe') AS safety, true AS no_notes
    FROM ({_JOINED}) j""")
def s9(spark, sf_dir):
    listed = settled(_docs(spark, sf_dir))
    docs = settled(changelogs.export_rules(changelogs.versions(listed), changelogs.read_changelogs(listed)))
    notes = changelogs.versions(docs).select("doc_id", "vpos", F.col("notes").isNull().alias("no_notes"))
    return changelogs.read_changelogs(docs).join(notes, ["doc_id", "vpos"]).select(
        "library", "version", "vpos", "release_date", "pos", "id", "change_type", "description", "default_value",
        F.when(F.col("new_order").isNotNull(), F.array_join("new_order", ",")).alias("new_order"),
        "safety", "no_notes")


@query("p1_version_key", f"""
    SELECT library, version, array_to_string({_KEY.format('version')}, '.') AS version_key FROM ({_VERSIONS}) v""")
def p1(spark, sf_dir):
    return _versions(spark, sf_dir).select("library", "version", F.array_join("version_key", ".").alias("version_key"))


@query("p2_flatten_rules", f"""
    SELECT library, version, pos, description,
      CAST(row_number() OVER (PARTITION BY library ORDER BY {_KEY.format('version')}, vpos, pos) AS INT) AS ordinal
    FROM ({_JOINED}) j""")
def p2(spark, sf_dir):
    return changelogs.flatten_rules(_rules(spark, sf_dir)).select("library", "version", "pos", "description", "ordinal")


@query("p3_rule_round_trip", f"""
    SELECT library, version, pos, id, change_type, description, old_name, new_name, default_value,
      coalesce(safety, 'safe') AS safety, 0 AS n_nulls FROM ({_RULES}) r""")
def p3(spark, sf_dir):
    back = changelogs.parse_rule_json(F.col("json"))
    return _rules(spark, sf_dir).select(
        "library", "version", "pos", changelogs.rule_json().alias("json")).select(
        "library", "version", "pos", back.alias("r"),
        F.size(F.expr("regexp_extract_all(json, ':null[,}]', 0)")).alias("n_nulls")).select(
        "library", "version", "pos", "r.id", "r.change_type", "r.description", "r.old_name", "r.new_name",
        "r.default_value", "r.safety", "n_nulls")


@query("p4_rule_listing", f"""
    SELECT library, version, pos, '    • [' || change_type || ']' ||
      CASE WHEN coalesce(old_name, '') <> '' AND coalesce(new_name, '') <> ''
           THEN ' [' || old_name || ' -> ' || new_name || ']' ELSE '' END || ' ' || description AS line
    FROM ({_RULES}) r""")
def p4(spark, sf_dir):
    return _rules(spark, sf_dir).select("library", "version", "pos", report.rule_line().alias("line"))


@query("p5_version_listing", f"""
    SELECT library, '  v' || version || '  (' || n_rules || ' rule' || CASE WHEN n_rules <> 1 THEN 's' ELSE '' END || ')' AS line
    FROM ({_VERSIONS}) v""")
def p5(spark, sf_dir):
    return _versions(spark, sf_dir).select("library", report.version_line().alias("line"))


@query("p7_version_range", f"""
    SELECT library, arg_min(version, {_KEY.format('version')}) || ' - ' || arg_max(version, {_KEY.format('version')}) AS versions
    FROM ({_VERSIONS}) v GROUP BY library""")
def p7(spark, sf_dir):
    return report.version_ranges(_versions(spark, sf_dir))


# ---------------------------------------------------------------- validation

_AT = "'versions -> ' || vpos || ' -> rules -> ' || pos"


def _violation(kind: str, pairs: list[tuple[str, str]]) -> str:
    """SQL: one row per (condition, detail) that holds for a rule."""
    return " UNION ALL ".join(
        f"SELECT library AS doc_id, {_AT} AS location, id AS rule_id, '{kind}' AS kind, {detail} AS detail "
        f"FROM ({_JOINED}) j WHERE {condition}"
        for condition, detail in pairs
    )


V1 = _violation("missing_required", [
    ("id IS NULL OR id = ''", "'id'"), ("change_type IS NULL", "'change_type'"), ("description IS NULL", "'description'")])
V2 = _violation("bad_version", [("version_introduced LIKE 'v%'", "version_introduced")])
V3 = _violation("bad_value", [
    ("change_type = 'rename_everything'", "'change_type=rename_everything'"), ("safety = 'unsafe'", "'safety=unsafe'")])
V4 = _violation("unknown_field", [("unknown_field IS NOT NULL", "'unknown_field'")]) + f"""
    UNION ALL SELECT library, 'versions -> ' || vpos, NULL, 'unknown_field', 'colour' FROM ({_VERSIONS}) v WHERE first_k % 5 = 0
    UNION ALL SELECT library, '', NULL, 'unknown_field', 'author' FROM ({_RULES}) r GROUP BY library HAVING min(k) % 3 = 0"""
_NO = "coalesce({0}, '') = ''"
V5 = _violation("missing_field", [
    (f"change_type IN ('rename_function','rename_class','rename_attribute','rename_import','deprecate_function',"
     f"'move_to_module','replace_with_property') AND {_NO.format('old_name')}", "'old_name'"),
    (f"change_type IN ('rename_function','rename_class','rename_attribute','rename_import','replace_with_property')"
     f" AND {_NO.format('new_name')}", "'new_name'"),
    (f"change_type = 'rename_import' AND {_NO.format('old_module')}", "'old_module'"),
    (f"change_type = 'rename_import' AND {_NO.format('new_module')}", "'new_module'"),
    (f"change_type IN ('add_argument','remove_argument','reorder_arguments','add_decorator','remove_decorator')"
     f" AND {_NO.format('function_name')}", "'function_name'"),
    (f"change_type IN ('add_argument','remove_argument','change_argument_default') AND {_NO.format('argument_name')}",
     "'argument_name'"),
    ("change_type = 'change_argument_default' AND default_value IS NULL", "'default_value'"),
    (f"change_type = 'reorder_arguments' AND {_NO.format('order_text')}", "'new_order'"),
    (f"change_type = 'move_to_module' AND {_NO.format('source_module')}", "'source_module'"),
    (f"change_type = 'move_to_module' AND {_NO.format('target_module')}", "'target_module'"),
    (f"change_type IN ('add_decorator','remove_decorator') AND {_NO.format('decorator_name')}", "'decorator_name'"),
])
V6 = _violation("bad_default", [("default_value IN ('class class # bad', 'f(x')", "default_value")])
V7 = f"""SELECT library AS doc_id, 'versions' AS location, id AS rule_id, 'duplicate_id' AS kind,
    CAST(count(*) AS VARCHAR) AS detail FROM ({_RULES}) r WHERE id IS NOT NULL GROUP BY library, id HAVING count(*) > 1"""
V8 = f"""SELECT library AS doc_id, 'versions' AS location, CAST(NULL AS VARCHAR) AS rule_id, 'conflicting_rename' AS kind,
    concat_ws(' ', change_type, old_name) AS detail FROM ({_RULES}) r
    WHERE change_type IN ('rename_function','rename_class','rename_attribute')
    GROUP BY library, change_type, old_name HAVING count(DISTINCT new_name) > 1"""


@query("v1_missing_required", V1)
def v1(spark, sf_dir):
    return validation.missing_required(_rules(spark, sf_dir))


@query("v2_bad_versions", V2)
def v2(spark, sf_dir):
    return validation.bad_versions(_rules(spark, sf_dir), _versions(spark, sf_dir))


@query("v3_bad_values", V3)
def v3(spark, sf_dir):
    return validation.bad_values(_rules(spark, sf_dir))


@query("v4_unknown_fields", V4)
def v4(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return validation.unknown_fields(
        changelogs.documents(docs), changelogs.read_changelogs(docs), changelogs.versions(docs))


@query("v5_missing_fields", V5)
def v5(spark, sf_dir):
    return validation.missing_fields(_rules(spark, sf_dir))


@query("v6_bad_defaults", V6)
def v6(spark, sf_dir):
    return validation.bad_defaults(_rules(spark, sf_dir))


@query("v7_duplicate_ids", V7)
def v7(spark, sf_dir):
    return validation.duplicate_ids(_rules(spark, sf_dir))


@query("v8_conflicting_renames", V8)
def v8(spark, sf_dir):
    return validation.conflicting_renames(_rules(spark, sf_dir))


@query("v9_validation_report", " UNION ALL ".join(f"SELECT * FROM ({v}) x" for v in (V1, V2, V3, V4, V5, V6, V7, V8)))
def v9(spark, sf_dir):
    return validation.validate_changelogs(_docs(spark, sf_dir))


@query("v10_field_types", """
    SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'old_name' WHEN 2 THEN 'tags' WHEN 3 THEN 'argument_position' END AS detail
    FROM documents WHERE doc_id % 4 <> 0""")
def v10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.lit('{"library": "x", "versions": [{"version": "1.0.0", "rules": [{"id": "a", "description": '),
        F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"),
        F.expr("""CASE doc_id % 4 WHEN 0 THEN ', "old_name": null, "tags": ["t"], "argument_position": 3'
                  WHEN 1 THEN ', "old_name": 5' WHEN 2 THEN ', "tags": "t"' ELSE ', "argument_position": "3"' END"""),
        F.lit("}]}]}")).alias("content"))
    return validation.bad_types(changelogs.read_changelogs(docs)).select("doc_id", "detail")


# ---------------------------------------------------------------- merging, paths

_OLD = "k % 3 <> 0"
_ADDED = f"""
    SELECT library, version FROM (SELECT DISTINCT library, version FROM ({_RULES}) r) n
    EXCEPT SELECT library, version FROM ({_RULES}) r WHERE {_OLD}"""


@query("j1_merge_versions", _ADDED)
def j1(spark, sf_dir):
    old = changelogs.versions(_docs(spark, sf_dir, where=_OLD))
    return changelogs.merge_changelogs(old, _versions(spark, sf_dir)).select("library", "version")


@query("u1_update_changelog", f"""
    SELECT DISTINCT library, version, 'old' AS origin FROM ({_RULES}) r WHERE {_OLD}
    UNION ALL SELECT library, version, 'new' FROM ({_ADDED}) a""")
def u1(spark, sf_dir):
    old = changelogs.versions(_docs(spark, sf_dir, where=_OLD)).withColumn("origin", F.lit("old"))
    new = _versions(spark, sf_dir).withColumn("origin", F.lit("new"))
    return changelogs.update_changelogs(old, new).select("library", "version", "origin")


# independent of the engine: candidates by join, first match by window
_PICK = """
    SELECT p.repo, p.library, p.{col} AS asked,
      CASE WHEN p.{col} = 'latest' THEN (arg_max(v.version, {key}))
           WHEN bool_or(v.version = p.{col}) OR ({zero} AND p.{col} = '0.0.0') THEN p.{col}
           ELSE coalesce(arg_min(v.version, {key}) FILTER (WHERE starts_with(v.version, p.{col}) OR starts_with(p.{col}, v.version)),
                         p.{col}) END AS version
    FROM ({pins}) p LEFT JOIN ({versions}) v ON p.library = v.library GROUP BY p.repo, p.library, p.{col}"""
_RESOLVED = f"""
    SELECT s.repo, s.library, s.asked AS from_asked, t.asked AS to_asked, s.version AS source_version,
      t.version AS target_version, {_KEY.format('s.version')} AS src_key, {_KEY.format('t.version')} AS tgt_key,
      {_KEY.format('t.version')} > {_KEY.format('s.version')} AS is_upgrade
    FROM ({_PICK.format(col='from_version', key=_KEY.format('v.version'), zero='true', pins=_PINS, versions=_VERSIONS)}) s
    JOIN ({_PICK.format(col='to_version', key=_KEY.format('v.version'), zero='false', pins=_PINS, versions=_VERSIONS)}) t
    USING (repo, library)"""
_PASSED = f"""
    SELECT r.*, v.version, v.vpos, v.n_rules, {_KEY.format('v.version')} AS vkey
    FROM ({_RESOLVED}) r JOIN ({_VERSIONS}) v USING (library)
    WHERE (is_upgrade AND {_KEY.format('v.version')} > src_key AND {_KEY.format('v.version')} <= tgt_key)
       OR (NOT is_upgrade AND {_KEY.format('v.version')} > tgt_key AND {_KEY.format('v.version')} <= src_key)"""


def _passed(spark, sf_dir, docs=None):
    vs = paths.listed(changelogs.versions(docs or _docs(spark, sf_dir)))
    return paths.version_range(paths.resolve_pins(corpora.pins(spark, sf_dir), vs), vs)


@query("j2_upgrade_range", f"SELECT repo, library, version, n_rules FROM ({_PASSED}) p WHERE is_upgrade")
def j2(spark, sf_dir):
    return _passed(spark, sf_dir).where("is_upgrade").select("repo", "library", "version", "n_rules")


@query("j3_downgrade_range", f"SELECT repo, library, version, n_rules FROM ({_PASSED}) p WHERE NOT is_upgrade")
def j3(spark, sf_dir):
    return _passed(spark, sf_dir).where("not is_upgrade").select("repo", "library", "version", "n_rules")


@query("j4_version_diff", f"""
    SELECT repo, library, from_version, to_version, version FROM ({_PINS}) p JOIN ({_VERSIONS}) v USING (library)
    WHERE {_KEY.format('version')} > {_KEY.format('from_version')} AND {_KEY.format('version')} <= {_KEY.format('to_version')}""")
def j4(spark, sf_dir):
    return paths.version_diff(corpora.pins(spark, sf_dir), _versions(spark, sf_dir)).select(
        "repo", "library", "from_version", "to_version", "version")


@query("j5_fuzzy_version", f"SELECT repo, library, from_asked, to_asked, source_version, target_version FROM ({_RESOLVED}) r")
def j5(spark, sf_dir):
    return paths.resolve_pins(corpora.pins(spark, sf_dir), paths.listed(_versions(spark, sf_dir))).select(
        "repo", "library", "from_asked", "to_asked", "source_version", "target_version")


_HANDLED = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in HANDLERS.items()) + ") h(change_type, handler)"


@query("j6_rule_handlers", f"""
    SELECT library, version, pos, r.change_type, handler FROM ({_RULES}) r JOIN {_HANDLED} USING (change_type)""")
def j6(spark, sf_dir):
    return _rules(spark, sf_dir).join(F.broadcast(handler_table(spark)), "change_type").select(
        "library", "version", "pos", "change_type", "handler")


@query("r16_skipped_rules", f"""
    SELECT library, version, pos, r.change_type FROM ({_RULES}) r
    WHERE change_type IS NOT NULL AND change_type NOT IN (SELECT change_type FROM {_HANDLED})""")
def r16(spark, sf_dir):
    return _rules(spark, sf_dir).where("change_type is not null").join(
        F.broadcast(handler_table(spark)), "change_type", "left_anti").select("library", "version", "pos", "change_type")


@query("w1_path_steps", f"""
    SELECT repo, library, is_upgrade,
      row_number() OVER (PARTITION BY repo, library ORDER BY CASE WHEN is_upgrade THEN rnk ELSE -rnk END) AS step,
      CASE WHEN is_upgrade THEN coalesce(below, source_version) ELSE version END AS step_from,
      CASE WHEN is_upgrade THEN version ELSE coalesce(below, target_version) END AS step_to
    FROM (SELECT *, row_number() OVER w AS rnk, lag(version) OVER w AS below FROM ({_PASSED}) p
          WINDOW w AS (PARTITION BY repo, library ORDER BY vkey)) q""")
def w1(spark, sf_dir):
    return paths.path_steps(_passed(spark, sf_dir))


_PATH_RULES = f"""
    SELECT p.repo, p.library, p.version, p.is_upgrade, r.pos, r.id, r.change_type,
      CASE WHEN is_upgrade THEN description ELSE '[DOWNGRADE] ' || description END AS description,
      CASE WHEN is_upgrade THEN old_name ELSE new_name END AS old_name,
      CASE WHEN is_upgrade THEN new_name ELSE old_name END AS new_name,
      CASE WHEN is_upgrade OR change_type <> 'rename_import' THEN old_module ELSE new_module END AS old_module,
      CASE WHEN is_upgrade OR change_type <> 'rename_import' THEN new_module ELSE old_module END AS new_module,
      CAST(row_number() OVER (PARTITION BY p.repo, p.library ORDER BY
        CASE WHEN is_upgrade THEN rnk ELSE -rnk END, CASE WHEN is_upgrade THEN pos ELSE -pos END) AS INT) AS ordinal
    FROM (SELECT *, row_number() OVER (PARTITION BY repo, library ORDER BY vkey) AS rnk FROM ({_PASSED}) q) p
    JOIN ({_RULES}) r ON p.library = r.library AND p.version = r.version
    WHERE is_upgrade OR change_type IN ('rename_function','rename_class','rename_attribute','rename_import')"""


def _path_rules(spark, sf_dir):
    docs = settled(_docs(spark, sf_dir))
    return paths.path_rules(_passed(spark, sf_dir, docs), settled(changelogs.read_changelogs(docs).drop("raw_rule")))


@query("q1_resolve_path", f"SELECT repo, library, is_upgrade, ordinal, version, pos, change_type FROM ({_PATH_RULES}) x")
def q1(spark, sf_dir):
    return _path_rules(spark, sf_dir).select("repo", "library", "is_upgrade", "ordinal", "version", "pos", "change_type")


@query("w2_rule_ordinal", f"""
    SELECT repo, library, is_upgrade, max(ordinal) AS last_ordinal, count(*) AS n_rules, count(DISTINCT ordinal) AS n_ordinals
    FROM ({_PATH_RULES}) x GROUP BY ALL""")
def w2(spark, sf_dir):
    return _path_rules(spark, sf_dir).groupBy("repo", "library", "is_upgrade").agg(
        F.max("ordinal").alias("last_ordinal"), F.count("*").alias("n_rules"),
        F.countDistinct("ordinal").alias("n_ordinals"))


@query("q2_reversed_rules", f"""
    SELECT repo, library, ordinal, id, change_type, description, old_name, new_name, old_module, new_module
    FROM ({_PATH_RULES}) x WHERE NOT is_upgrade""")
def q2(spark, sf_dir):
    return _path_rules(spark, sf_dir).where("not is_upgrade").select(
        "repo", "library", "ordinal", "id", "change_type", "description", "old_name", "new_name",
        "old_module", "new_module")


@query("q3_irreversible", f"""
    SELECT p.repo, p.library, r.id AS rule_id,
      CASE WHEN change_type IN ('remove_function','remove_class')
           THEN 'Cannot reverse rule: ' || description || ' (removal cannot be undone)'
           ELSE 'Cannot automatically reverse rule: ' || description END AS reason
    FROM ({_PASSED}) p JOIN ({_RULES}) r ON p.library = r.library AND p.version = r.version
    WHERE NOT is_upgrade AND change_type NOT IN ('rename_function','rename_class','rename_attribute','rename_import')""")
def q3(spark, sf_dir):
    docs = settled(_docs(spark, sf_dir))
    return paths.irreversible_rules(_passed(spark, sf_dir, docs), changelogs.read_changelogs(docs))


# ---------------------------------------------------------------- counts, orders


@query("a1_total_rules", f"SELECT library, count(*) AS n_rules FROM ({_RULES}) r GROUP BY library")
def a1(spark, sf_dir):
    return changelogs.count_rules(_versions(spark, sf_dir), "library")


@query("a2_rules_per_version", f"SELECT library, version, count(*) AS n_rules FROM ({_RULES}) r GROUP BY library, version")
def a2(spark, sf_dir):
    return changelogs.count_rules(_versions(spark, sf_dir), "library", "version")


@query("w3_version_order", f"""
    SELECT library, version, row_number() OVER (PARTITION BY library ORDER BY {_KEY.format('version')}) AS place
    FROM ({_VERSIONS}) v""")
def w3(spark, sf_dir):
    from pyspark.sql import Window

    return _versions(spark, sf_dir).select("library", "version", F.row_number().over(
        Window.partitionBy("library").orderBy("version_key")).alias("place"))


@query("w4_available_versions", f"""
    SELECT library, string_agg(version, ', ' ORDER BY {_KEY.format('version')}) AS available FROM ({_VERSIONS}) v
    GROUP BY library""")
def w4(spark, sf_dir):
    return _versions(spark, sf_dir).groupBy("library").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("version_key", "version"))), lambda v: v["version"]), ", ").alias("available"))


@query("w5_latest_version", f"SELECT library, arg_max(version, {_KEY.format('version')}) AS latest FROM ({_VERSIONS}) v GROUP BY library")
def w5(spark, sf_dir):
    return paths.latest_versions(_versions(spark, sf_dir))


@query("w6_first_fuzzy_hit", f"""
    SELECT p.repo, p.library, arg_min(v.version, {_KEY.format('v.version')}) AS first_hit
    FROM ({_PINS}) p JOIN ({_VERSIONS}) v
      ON p.library = v.library AND (starts_with(v.version, p.to_version) OR starts_with(p.to_version, v.version))
    GROUP BY p.repo, p.library""")
def w6(spark, sf_dir):
    return paths.fuzzy_hits(corpora.pins(spark, sf_dir), _versions(spark, sf_dir))


# ---------------------------------------------------------------- tokens of real text

# The same lexical grammar without possessive loops or lookahead.
_RE2 = (
    r"""(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:"""
    r'''"""(?:[^"\\]|\\(?s:.)|"{1,2}[^"\\]|"{1,2}\\(?s:.))*"""|'''
    r"""'''(?:[^'\\]|\\(?s:.)|'{1,2}[^'\\]|'{1,2}\\(?s:.))*'''|"""
    r'''"(?:[^"\\\r\n]|\\(?:\r\n|(?s:.)))*"|'''
    r"""'(?:[^'\\\r\n]|\\(?:\r\n|(?s:.)))*')"""
    r"""|[\pL\p{Nl}_][\pL\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*"""
    r"""|0[xXoObB][0-9a-fA-F_]+|(?:[0-9][0-9_]*(?:\.(?:[0-9][0-9_]*)?)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9][0-9_]*)?[jJ]?"""
    r"""|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>"""
    r"""|#[^\r\n]*|\\\r?\n|[ \t\f\r\n]+|(?s:.)"""
)
_SQL_RE2 = "'" + _RE2.replace("'", "''") + "'"


def _token_sql(source: str, key: str, text: str) -> str:
    """Significant tokens in order: everything but blanks, newlines and comments."""
    return f"""
      SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos, tok
      FROM (SELECT {key}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
            FROM (SELECT {key}, regexp_extract_all({text}, {_SQL_RE2}) AS toks FROM {source}) a) b
      WHERE NOT regexp_full_match(tok, '#[^\\r\\n]*|\\\\\\r?\\n|[ \\t\\f\\r\\n]+')"""


def _text_tokens(spark, sf_dir, name, key, text):
    rows = table(spark, sf_dir, name).select(F.col(key), F.col(text))
    rows = rows.repartition(text_partitions(rows), key)
    return tokens(rows, F.col(text), key).where("tok <> ''")


@query("w7_bracket_depth", f"""
    SELECT doc_id, count(*) AS n_tokens, max(depth) AS max_depth, min(depth) AS min_depth,
      count(*) FILTER (WHERE tok = '(' AND regexp_matches(prev, '^[\\pL\\p{{Nl}}_]') AND NOT regexp_matches(prev, '["'']$')) AS n_calls,
      count(*) FILTER (WHERE prev = '.' AND regexp_matches(tok, '^[\\pL\\p{{Nl}}_]') AND NOT regexp_matches(tok, '["'']$')) AS n_attributes
    FROM (SELECT doc_id, tok, coalesce(lag(tok) OVER w, '') AS prev,
            sum(CASE WHEN tok IN ('(','[','{{') THEN 1 WHEN tok IN (')',']','}}') THEN -1 ELSE 0 END) OVER w AS depth
          FROM ({_token_sql('documents', 'doc_id', 'text')}) t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) s
    GROUP BY doc_id""")
def w7(spark, sf_dir):
    rows = structure(
        _text_tokens(spark, sf_dir, "documents", "doc_id", "text").withColumn("fl", F.lit(0)), key=("doc_id",),
        need=frozenset({"depth"}))
    prev_word = F.col("prev1").rlike(r"^[\p{L}\p{Nl}_]") & ~F.col("prev1").rlike("[\"']$")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.max("depth_after").alias("max_depth"), F.min("depth_after").alias("min_depth"),
        F.count_if((F.col("tok") == "(") & prev_word).alias("n_calls"),
        F.count_if((F.col("prev1") == ".") & F.col("word")).alias("n_attributes"))


# Renames over frequent words of the texts and a call in page scripts.
_WORDS = (("the", "this"), ("and", "plus"), ("data", "rows"), ("track", "record"), ("model", "shape"), ("de", "du"))
_WORD_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _WORDS) + ") w(old_name, new_name)"


def _word_rules(spark):
    return spark.createDataFrame(list(_WORDS), "old_name string, new_name string")


@query("j7_rule_occurrences_documents", f"""
    SELECT doc_id, old_name, new_name, count(*) AS n FROM ({_token_sql('documents', 'doc_id', 'text')}) t
    JOIN {_WORD_SQL} ON tok = old_name GROUP BY ALL""")
def j7(spark, sf_dir):
    return _text_tokens(spark, sf_dir, "documents", "doc_id", "text").join(
        F.broadcast(_word_rules(spark)), F.col("tok") == F.col("old_name")).groupBy(
        "doc_id", "old_name", "new_name").agg(F.count("*").alias("n"))


@query("j7_rule_occurrences_pages", f"""
    SELECT page_id, old_name, new_name, count(*) AS n FROM ({_token_sql('pages', 'page_id', 'html')}) t
    JOIN {_WORD_SQL} ON tok = old_name GROUP BY ALL""")
def j7_pages(spark, sf_dir):
    return _text_tokens(spark, sf_dir, "pages", "page_id", "html").join(
        F.broadcast(_word_rules(spark)), F.col("tok") == F.col("old_name")).groupBy(
        "page_id", "old_name", "new_name").agg(F.count("*").alias("n"))


@query("j8_pruned_files", f"""
    SELECT page_id, regexp_matches(html, '(^|[^\\pL\\p{{Nl}}\\p{{Mn}}\\p{{Mc}}\\p{{Nd}}\\p{{Pc}}])({'|'.join(a for a, _ in _WORDS)})($|[^\\pL\\p{{Nl}}\\p{{Mn}}\\p{{Mc}}\\p{{Nd}}\\p{{Pc}}])') AS kept
    FROM pages""")
def j8(spark, sf_dir):
    from apidrift.functions.lexing import identifiers

    names = F.array(*[F.lit(a) for a, _ in _WORDS])
    return table(spark, sf_dir, "pages").select(
        "page_id", F.arrays_overlap(identifiers(F.col("html")), names).alias("kept"))


_NAME_SQL = "regexp_extract_all(html, '[\\pL\\p{Nl}_][\\pL\\p{Nl}\\p{Mn}\\p{Mc}\\p{Nd}\\p{Pc}]*')"


@query("j8_index_update", f"""
    WITH old AS (SELECT CASE WHEN page_id % 10 = 3 THEN html || ' changed' ELSE html END AS html FROM pages),
    t AS (SELECT page_id, html NOT IN (SELECT html FROM old WHERE html IS NOT NULL) AS fresh, unnest({_NAME_SQL}) AS name FROM pages)
    SELECT page_id, name, count(*) AS n, any_value(fresh) AS fresh FROM t JOIN {_WORD_SQL} ON name = old_name GROUP BY page_id, name""")
def j8_index(spark, sf_dir):
    """An index of the pages with a tenth of them in an older form, brought up to date, and asked for the names of some rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"))
    older = pages.withColumn("content", F.when(F.col("page_id") % 10 == 3, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.build(older, ["page_id"]).save(folder)
    now, fresh = index.update(index.Index.load(spark, folder, ["page_id"]), pages)
    found = index.occurrences(now, _word_rules(spark).select(F.col("old_name").alias("name")))
    read = now.files.join(fresh.withColumn("fresh", F.lit(True)), "digest", "left").select("page_id", F.coalesce("fresh", F.lit(False)).alias("fresh"))
    return found.join(read, "page_id").select("page_id", "name", "n", "fresh")


# brackets cancel pairwise until nothing changes
_LEXICAL = f"""
    WITH RECURSIVE t AS ({_token_sql('{source}', '{key}', '{text}')}),
    b AS (SELECT {{key}}, coalesce(string_agg(tok, '' ORDER BY pos) FILTER (WHERE tok IN ('(',')','[',']','{{{{','}}}}')), '') AS s,
                 bool_or(tok IN ('"', '''', '\\', '$', '?', '`', '!')) AS broken FROM t GROUP BY {{key}}),
    c AS (SELECT {{key}}, s, broken, 0 AS step FROM b
          UNION ALL
          SELECT {{key}}, regexp_replace(s, '\\(\\)|\\[\\]|\\{{{{\\}}}}', '', 'g'), broken, step + 1 FROM c
          WHERE regexp_matches(s, '\\(\\)|\\[\\]|\\{{{{\\}}}}'))
    SELECT {{key}}, NOT broken AND len(s) = 0 AS valid FROM (
      SELECT {{key}}, arg_max(s, step) AS s, bool_or(broken) AS broken FROM c GROUP BY {{key}}) d"""


def _lexical_sql(source, key, text):
    body = _LEXICAL
    for a, b in (("{source}", source), ("{key}", key), ("{text}", text), ("{{", "{"), ("}}", "}")):
        body = body.replace(a, b)
    return body


@query("e7_unparsable_texts", _lexical_sql(
    "(SELECT conv_id || '-' || turn AS msg, text FROM conversations)", "msg", "text"))
def e7(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("msg"), lexically_valid(F.col("text")).alias("valid"))


@query("e7_unparsable_documents", _lexical_sql("documents", "doc_id", "text"))
def e7_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lexically_valid(F.col("text")).alias("valid"))


# ---------------------------------------------------------------- rewriting


def _migrated(corpus, spark, sf_dir, **kw):
    return migrate(corpus.files(spark, sf_dir), corpora.rule_table(spark, corpus.rules), **kw)


def _register_operation(name, corpus):
    @query(name, f"SELECT path, content AS transformed_code, CAST(n_changes AS INT) AS n_changes FROM ({corpus.expected_sql()}) f")
    def run(spark, sf_dir, corpus=corpus):
        return _migrated(corpus, spark, sf_dir).select(
            "path", "transformed_code", F.size("changes").alias("n_changes"))


for _name, _corpus in OPERATIONS.items():
    _register_operation(_name, _corpus)

# A change type of the caller's own: a keyword argument that calls give gets another value.
SET_ARGUMENT = rulebook.CallOperation(
    acts="exists(s.args, a -> a.dead is null and a.kw = r.b)", expression="default_value", args=entities.drop_argument(), add=entities.append_argument(),
    message="format_string('Set argument \\'%s=%s\\' of %s()', argument_name, default_value, function_name)")
_OWN = corpora.OWN_OPERATION


@query("x1_own_operation", f"""
    SELECT path, content AS transformed_code, CASE WHEN n_changes > 0 THEN 'Set argument ''slack=LIMIT'' of moor()' ELSE '' END AS messages,
      CAST(n_changes AS INT) AS n_changes FROM ({_OWN.expected_sql()}) f""")
def x1(spark, sf_dir):
    with rulebook.registered("set_argument", SET_ARGUMENT):
        done = _migrated(_OWN, spark, sf_dir)
    return done.select("path", "transformed_code", F.array_join(F.array_distinct(F.filter(
        "changes", lambda m: m.startswith("Set"))), "|").alias("messages"), F.size("changes").alias("n_changes"))


@query("r7_scoped_default", f"SELECT path, content AS transformed_code, CAST(n_changes AS INT) AS n_changes FROM ({corpora.SCOPED.expected_sql()}) f")
def r7_scoped(spark, sf_dir):
    return _migrated(corpora.SCOPED, spark, sf_dir, scoped=True).select("path", "transformed_code", F.size("changes").alias("n_changes"))


_EXPECTED, _SOURCE = EXAMPLE.expected_sql(), EXAMPLE.source_sql()


@query("e2_migrate_corpus", f"""
    SELECT repo, path, content AS transformed_code, CAST(n_changes AS INT) AS n_changes, true AS was_modified FROM ({_EXPECTED}) f""")
def e2(spark, sf_dir):
    return _migrated(EXAMPLE, spark, sf_dir).select(
        "repo", "path", "transformed_code", F.size("changes").alias("n_changes"), "was_modified")


_PRINTS = "CAST((length(content) - length(replace(content, 'print(', ''))) / 6 AS INT)"


@query("e2_two_libraries", f"""
    SELECT repo, path, CASE WHEN u < 15 THEN replace(content, 'print(', 'emit(') ELSE content END AS transformed_code,
      CAST(n + CASE WHEN u < 15 THEN {_PRINTS} ELSE 0 END AS INT) AS n_changes
    FROM (SELECT s.repo, s.path, CAST(substr(s.repo, 2) AS INT) AS u,
            CASE WHEN CAST(substr(s.repo, 2) AS INT) < 10 THEN e.content ELSE s.content END AS content,
            CASE WHEN CAST(substr(s.repo, 2) AS INT) < 10 THEN e.n_changes ELSE 0 END AS n
          FROM ({_SOURCE}) s JOIN ({_EXPECTED}) e USING (path)) f""")
def e2_two(spark, sf_dir):
    """Repositories with two libraries, with one of them, and without any pin."""
    docs = corpora.example_changelog(spark).union(corpora.second_changelog(spark))
    users = spark.sql(corpora.REPO_PINS, events=table(spark, sf_dir, "events")).select(
        "repo", F.substring("repo", 2, 9).cast("int").alias("u"))
    pin = lambda library, most: users.where(F.col("u") < most).select(
        "repo", F.lit(library).alias("library"), F.lit("1.0.0").alias("from_version"), F.lit("latest").alias("to_version"))
    placed, rules = paths.plan_migrations(
        EXAMPLE.files(spark, sf_dir).drop("path_id"), pin("seedbank", 10).union(pin("otherlib", 15)), changelogs.versions(docs),
        changelogs.read_changelogs(docs))
    return migrate(placed, rules).select("repo", "path", "transformed_code", F.size("changes").alias("n_changes"))


@query("e2_migrate_pinned", f"""
    SELECT repo, path, content AS transformed_code, CAST(n_changes AS INT) AS n_changes FROM ({_EXPECTED}) e
    WHERE CAST(substr(repo, 2) AS INT) < 10
    UNION ALL SELECT repo, path, content, 0 FROM ({_SOURCE}) s WHERE CAST(substr(repo, 2) AS INT) >= 10""")
def e2_pinned(spark, sf_dir):
    docs = corpora.example_changelog(spark)
    repo_pins = spark.sql(corpora.REPO_PINS, events=table(spark, sf_dir, "events"))
    placed, rules = paths.plan_migrations(
        EXAMPLE.files(spark, sf_dir).drop("path_id"), repo_pins, changelogs.versions(docs),
        changelogs.read_changelogs(docs))
    return migrate(placed, rules).select("repo", "path", "transformed_code", F.size("changes").alias("n_changes"))


@query("e3_dry_run", f"""
    SELECT s.path, s.content AS transformed_code, false AS was_modified, e.content <> s.content AS would_modify,
      CAST(e.n_changes AS INT) AS n_changes FROM ({_SOURCE}) s JOIN ({_EXPECTED}) e USING (path)""")
def e3(spark, sf_dir):
    return _migrated(EXAMPLE, spark, sf_dir, dry_run=True).select(
        "path", "transformed_code", "was_modified", "would_modify", F.size("changes").alias("n_changes"))


@query("e5_validate_output", f"""
    SELECT s.path, true AS is_valid, len(s.content) - len(replace(s.content, chr(10), '')) AS lines_before,
      len(e.content) - len(replace(e.content, chr(10), '')) AS lines_after, 0 AS n_issues
    FROM ({_SOURCE}) s JOIN ({_EXPECTED}) e USING (path)""")
def e5(spark, sf_dir):
    return report.validate_migration(_migrated(EXAMPLE, spark, sf_dir)).select(
        "path", "is_valid", "lines_before", "lines_after", F.size("issues").alias("n_issues"))


@query("s8_backup_paths", f"SELECT repo, path, path || '.bak' AS backup_path, content FROM ({_SOURCE}) s")
def s8(spark, sf_dir):
    return sinks.backups(_migrated(EXAMPLE, spark, sf_dir))


@query("p10_result_flags", f"""
    SELECT path, e.content <> s.content AS was_modified, true AS success FROM ({_SOURCE}) s JOIN ({_EXPECTED}) e USING (path)""")
def p10(spark, sf_dir):
    return _migrated(EXAMPLE, spark, sf_dir).select("path", "was_modified", "success")


@query("a3_report", f"""
    SELECT repo, count(*) AS files_processed, count(*) AS files_modified, 0 AS files_failed,
      CAST(sum(n_changes) AS BIGINT) AS total_changes FROM ({_EXPECTED}) f GROUP BY ROLLUP (repo)""")
def a3(spark, sf_dir):
    return report.summarize(_migrated(EXAMPLE, spark, sf_dir))


# Files of four fates, by user: broken text, undecodable, nothing to do, as they were.
_FATE = "CAST(regexp_extract(path, 'f([0-9]+)_', 1) AS INT) % 4"
_BROKEN = " | ".join(
    f"Rule '{r['change_type']}' failed: Syntax error in source: unbalanced brackets or open string" for r in EXAMPLE.rules)
_FATES = f"SELECT s.repo, s.path, e.n_changes, {_FATE.replace('path', 's.path')} AS fate FROM ({_SOURCE}) s JOIN ({_EXPECTED}) e USING (path)"


def _fated(spark, sf_dir):
    fate, content = F.expr(_FATE), F.col("content")
    files = EXAMPLE.files(spark, sf_dir).withColumn("error", F.when(fate == 1, F.lit("invalid UTF-8"))).withColumn(
        "content", F.when(fate == 0, F.concat(content, F.lit("("))).when(fate == 2, F.lit("x = 1\n")).otherwise(content))
    return migrate(files, corpora.rule_table(spark, EXAMPLE.rules))


@query("a3_report_failures", f"""
    SELECT repo, count(*) AS files_processed, count(*) FILTER (WHERE fate = 3) AS files_modified,
      count(*) FILTER (WHERE fate < 2) AS files_failed,
      CAST(coalesce(sum(n_changes) FILTER (WHERE fate = 3), 0) AS BIGINT) AS total_changes FROM ({_FATES}) f GROUP BY ROLLUP (repo)""")
def a3_failures(spark, sf_dir):
    return report.summarize(_fated(spark, sf_dir))


@query("e7_rule_errors", f"""
    SELECT path, CASE fate WHEN 0 THEN '{_BROKEN.replace("'", "''")}' WHEN 1 THEN 'invalid UTF-8' ELSE '' END AS errors,
      fate = 3 AS was_modified, fate >= 2 AS success FROM ({_FATES}) f""")
def e7_errors(spark, sf_dir):
    return _fated(spark, sf_dir).select("path", F.array_join("errors", " | ").alias("errors"), "was_modified", "success")


# per file: how often each rule of the example acts, as (ordinal, change type, message, count)
_COUNTS = """
    (1, 'rename_class', 'Renamed class: Packet -> SeedPacket', 2),
    (2, 'rename_import', 'Renamed import: from seedbank.stock import Shelf -> from seedbank.storage import Rack', 1),
    (3, 'rename_function', 'Renamed function: germinate -> sprout', error),
    (4, 'remove_argument', 'Removed argument ''quiet'' from sprout()', error),
    (5, 'add_argument', 'Added argument ''depth=2.5'' to sow()', click),
    (6, 'rename_attribute', 'Renamed attribute: .moisture -> .humidity', 2 * view),
    (7, 'replace_with_property', 'Replaced get_label() with property label', signup),
    (8, 'deprecate_function', 'Marked prune() as deprecated', purchase),
    (9, 'change_argument_default', 'Changed default for ''spacing'' to 15', 1),
    (10, 'add_decorator', 'Added @logged to harvest()', 1),
    (11, 'move_to_module', 'Moved import: Almanac from seedbank.misc to seedbank.calendar', 1),
    (12, 'rename_function', 'Renamed function: sow -> plant', click)"""
_PER_FILE = f"""
    SELECT f.repo, f.path, c.o, c.change_type, c.message, c.n FROM (
      SELECT 'u' || (user_id % 20) AS repo, 'pkg/f' || user_id || '_' || bucket || '.py' AS path,
        {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in corpora.Corpus.KINDS)}
      FROM (SELECT user_id, event_type, CAST(floor(event_id / {corpora.EVENTS}) AS BIGINT) AS bucket FROM events) e
      GROUP BY user_id, bucket) f, LATERAL (VALUES {_COUNTS}) c(o, change_type, message, n) WHERE c.n > 0"""


@query("a5_rules_applied", f"SELECT path, string_agg(change_type, ',' ORDER BY o) AS rules_applied FROM ({_PER_FILE}) p GROUP BY path")
def a5(spark, sf_dir):
    return _migrated(EXAMPLE, spark, sf_dir).select("path", F.array_join("rules_applied", ",").alias("rules_applied"))


@query("a6_changes", f"""
    SELECT path, row_number() OVER (PARTITION BY path ORDER BY o, i) - 1 AS seq, message
    FROM (SELECT path, o, message, unnest(range(n)) AS i FROM ({_PER_FILE}) p) q""")
def a6(spark, sf_dir):
    return report.changes(_migrated(EXAMPLE, spark, sf_dir)).select("path", "seq", "message")


@query("a4_report_lines", f"""
    SELECT repo, 1 AS part, path, row_number() OVER (PARTITION BY path ORDER BY o, i) - 1 AS seq, line FROM (
      SELECT repo, path, o, unnest(range(n)) AS i, '    ✓ ' || message AS line FROM ({_PER_FILE}) p
      UNION ALL SELECT DISTINCT repo, path, 0, 0, '  ' || path || ':' FROM ({_PER_FILE}) p) q
    UNION ALL
    SELECT repo, 0, '', c.seq, c.line FROM (
      SELECT repo, count(DISTINCT path) AS files, CAST(sum(n) AS BIGINT) AS changes FROM ({_PER_FILE}) p GROUP BY repo) r,
      LATERAL (VALUES (0, 'Migration Report: v1.0.0 -> v2.5.1'), (1, repeat('=', 50)),
        (2, 'Files processed : ' || files), (3, 'Files modified  : ' || files), (4, 'Files failed    : 0'),
        (5, 'Total changes   : ' || changes), (6, '')) c(seq, line)""")
def a4(spark, sf_dir):
    return report.report_lines(_migrated(EXAMPLE, spark, sf_dir), "1.0.0", "2.5.1")


# The edit script of each file, known from how the corpus writes its lines: (order, [(kind, line)]).
_HEAD_SCRIPT = [
    (-6, [(1, "from seedbank.stock import Shelf, Packet"), (2, "from seedbank.storage import Rack, SeedPacket")]),
    (-5, [(1, "from seedbank.misc import Almanac"), (2, "from seedbank.calendar import Almanac")]),
    (-4, [(0, "@cached")]), (-3, [(2, "@logged")]),
    (-2, [(1, "def harvest(bed, spacing=10):"), (2, "def harvest(bed, spacing=15):")]),
    (-1, [(1, "    return Packet(bed)"), (2, "    return SeedPacket(bed)")]),
]
_HEAD_SQL = ", ".join(
    "({}, [{}])".format(o, ", ".join(f"{{'k': {k}, 'l': '{line}'}}" for k, line in xs)) for o, xs in _HEAD_SCRIPT)


def _range_sql(start, n):
    return f"CASE WHEN {n} = 1 THEN ({start} + 1) || '' ELSE ({start} + CASE WHEN {n} = 0 THEN 0 ELSE 1 END) || ',' || {n} END"


@query("e4_preview", f"""
    WITH e AS (
      SELECT 'pkg/f' || user_id || '_' || CAST(floor(event_id / {corpora.EVENTS}) AS BIGINT) || '.py' AS path, event_id AS o,
             {EXAMPLE._case(0)} AS src, {EXAMPLE._case(1)} AS exp FROM events),
    x AS (
      SELECT path, o, CASE WHEN src = exp THEN [{{'k': 0, 'l': src}}]
        WHEN ends_with(exp, chr(10) || src) THEN [{{'k': 2, 'l': exp[:len(exp) - len(src) - 1]}}, {{'k': 0, 'l': src}}]
        ELSE [{{'k': 1, 'l': src}}, {{'k': 2, 'l': exp}}] END AS xs FROM e
      UNION ALL SELECT f.path, h.o, h.xs FROM (SELECT DISTINCT path FROM e) f, (VALUES {_HEAD_SQL}) h(o, xs)),
    y AS (SELECT path, o, j, xs[j].k AS k, xs[j].l AS l FROM x, unnest(range(1, len(xs) + 1)) AS r(j)),
    s AS (SELECT *, count(*) FILTER (k = 0) OVER (PARTITION BY path ORDER BY o, j ROWS UNBOUNDED PRECEDING) AS same FROM y),
    n AS (SELECT *, row_number() OVER w AS seq, count(*) FILTER (k <> 2) OVER b AS a0, count(*) FILTER (k <> 1) OVER b AS b0,
                 max(CASE WHEN k > 0 THEN same END) OVER b AS last, min(CASE WHEN k > 0 THEN same END) OVER f AS next
          FROM s WINDOW w AS (PARTITION BY path ORDER BY same, k, o, j),
            b AS (PARTITION BY path ORDER BY same, k, o, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            f AS (PARTITION BY path ORDER BY same, k, o, j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    c AS (SELECT *, seq - row_number() OVER (PARTITION BY path ORDER BY seq) AS hunk FROM n
          WHERE k > 0 OR coalesce(same - last <= 3, false) OR coalesce(next - same < 3, false)),
    h AS (SELECT path, hunk, min(a0) AS a, count(*) FILTER (k <> 2) AS na, min(b0) AS b, count(*) FILTER (k <> 1) AS nb,
                 string_agg([' ', '-', '+'][k + 1] || l || chr(10), '' ORDER BY seq) AS body FROM c GROUP BY path, hunk),
    d AS (SELECT path, '--- original' || chr(10) || '+++ migrated' || chr(10) || string_agg('@@ -' || {_range_sql('a', 'na')} || ' +' ||
                 {_range_sql('b', 'nb')} || ' @@' || chr(10) || body, '' ORDER BY hunk) AS diff FROM h GROUP BY path),
    m AS (SELECT path, string_agg('  - ' || message, chr(10) ORDER BY o, i) AS listed
          FROM (SELECT path, o, message, unnest(range(n)) AS i FROM ({_PER_FILE}) p) q GROUP BY path)
    SELECT path, chr(10) || 'Changes:' || chr(10) || listed || chr(10) || chr(10) || diff AS preview FROM d JOIN m USING (path)""")
def e4(spark, sf_dir):
    return report.preview(_migrated(EXAMPLE, spark, sf_dir)).select("path", "preview")
