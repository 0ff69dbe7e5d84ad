"""A part of the registered queries against their SQL (all of them: check_oracles.py)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracles import compare

SF = "/root/testdata/sf0.001"
SAMPLE = ("s1_read_json", "s9_rules_export", "v9_validation_report", "j1_merge_versions", "j5_fuzzy_version",
          "q1_resolve_path", "w1_path_steps", "w7_bracket_depth", "j7_rule_occurrences_documents",
          "e7_unparsable_documents", "r4_rename_import", "r7_change_default", "e1_ordered_fold", "a4_report_lines")


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    info, ok = compare(spark, name, queries()[name], oracle_sql()[name], SF)
    assert ok, info


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["repo", "path", "transformed_code", "n_changes", "was_modified"] and rows.count() > 0
