"""Counters, report lines, previews and output checks for migration results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.functions.lexing import lexically_valid
from apidrift.operators.diff import BREAKS, unified
from apidrift.session import settled


def summarize(results: DataFrame, by: str | None = "repo") -> DataFrame:
    """Counters per repository and in total (``by`` null); without ``by`` the total only."""
    grouped = results.rollup(by) if by else results.groupBy()
    return grouped.agg(
        F.count("*").alias("files_processed"),
        F.count_if("was_modified").alias("files_modified"),
        F.count_if(F.size("errors") > 0).alias("files_failed"),
        F.coalesce(F.sum(F.when(F.col("was_modified"), F.size("changes")).otherwise(0)), F.lit(0)).alias(
            "total_changes"),
    )


def report_lines(results: DataFrame, source_version: str, target_version: str) -> DataFrame:
    """The report of each repository as ordered rows ``repo, part, path, seq, line``.

    Rows, not one text: a report grows with the repository. What it tells of the results is settled,
    because head and body read it.
    """
    results = settled(results.select("repo", "path", "changes", "errors", "was_modified"))
    head = summarize(results.where("repo is not null"), "repo").where("repo is not null")
    lines = [
        F.lit(f"Migration Report: v{source_version} -> v{target_version}"), F.lit("=" * 50),
        F.concat(F.lit("Files processed : "), F.col("files_processed")),
        F.concat(F.lit("Files modified  : "), F.col("files_modified")),
        F.concat(F.lit("Files failed    : "), F.col("files_failed")),
        F.concat(F.lit("Total changes   : "), F.col("total_changes")), F.lit(""),
    ]
    header = head.select("repo", F.lit(0).alias("part"), F.lit("").alias("path"),
                         F.posexplode(F.array(*lines)).alias("seq", "line"))
    body = results.where("was_modified or size(errors) > 0").select(
        "repo", F.lit(1).alias("part"), "path",
        F.posexplode(F.concat(
            F.array(F.concat(F.lit("  "), "path", F.lit(":"))),
            F.transform("changes", lambda c: F.concat(F.lit("    ✓ "), c)),
            F.transform("errors", lambda c: F.concat(F.lit("    ✗ "), c)),
        )).alias("seq", "line"),
    )
    return header.unionByName(body)


def changes(results: DataFrame) -> DataFrame:
    """One row per change: rule order, then occurrence."""
    return results.select("path_id", "file_id", "repo", "path", F.posexplode("changes").alias("seq", "message"))


def line_count(text: Column) -> Column:
    """Lines as ``splitlines`` counts them: no empty line after a final newline."""
    parts = F.size(F.split(text, rf"\r\n|[{BREAKS}]"))
    return F.when(text == "", 0).otherwise(
        parts - F.when(text.rlike(rf"[{BREAKS}]\z"), 1).otherwise(0))


def validate_migration(results: DataFrame) -> DataFrame:
    """Lexical check of the output, and a warning when more than half of the lines are gone."""
    old, new = line_count(F.col("original_code")), line_count(F.col("transformed_code"))
    valid = lexically_valid(F.col("transformed_code"))
    return results.select(
        "path_id", "file_id", "repo", "path", valid.alias("is_valid"), old.alias("lines_before"),
        new.alias("lines_after"),
        F.when(~valid, F.array(F.lit("Syntax error in migrated code")))
        .when(new < old * 0.5, F.array(F.format_string(
            "Warning: migrated code has significantly fewer lines (%d vs %d)", new, old)))
        .otherwise(F.array().cast("array<string>")).alias("issues"),
    )


_TEXTS = ("path_id", "file_id", "repo", "path", "changes", "original_code", "transformed_code")
_DIFFER = "original_code <> transformed_code"


def unified_diff(results: DataFrame) -> DataFrame:
    """Unified diff (three lines of context) of each modified file.

    The texts are settled, because matching their lines reads them several times.
    """
    return _diffs(settled(results.where(_DIFFER).select(*_TEXTS)))


def _diffs(texts: DataFrame) -> DataFrame:
    keys = ["path_id", "file_id"]
    return texts.select(*keys, "repo", "path", "changes").join(unified(texts, keys, "original_code", "transformed_code"), keys)


def preview(results: DataFrame) -> DataFrame:
    """Change list and unified diff per file; a fixed sentence where nothing changes."""
    results = settled(results.select(*_TEXTS))
    same = results.where("original_code = transformed_code").select(
        "path_id", "file_id", "repo", "path", F.lit("No changes would be made.").alias("preview"))
    text = F.concat(
        F.when(F.size("changes") > 0, F.concat(
            F.lit("\nChanges:\n"),
            F.array_join(F.transform("changes", lambda c: F.concat(F.lit("  - "), c)), "\n"), F.lit("\n\n"),
        )).otherwise(F.lit("")), "diff")
    return _diffs(results.where(_DIFFER)).select(
        "path_id", "file_id", "repo", "path", text.alias("preview")).unionByName(same)


def rule_line() -> Column:
    """Listing line of a rule; the names only when both are set."""
    both = (F.coalesce("old_name", F.lit("")) != "") & (F.coalesce("new_name", F.lit("")) != "")
    names = F.when(both, F.concat(F.lit(" ["), "old_name", F.lit(" -> "), "new_name", F.lit("]"))).otherwise("")
    return F.concat(F.lit("    • ["), "change_type", F.lit("]"), names, F.lit(" "), "description")


def version_line() -> Column:
    return F.concat(
        F.lit("  v"), "version", F.lit("  ("), F.col("n_rules").cast("string"), F.lit(" rule"),
        F.when(F.col("n_rules") != 1, "s").otherwise(""), F.lit(")"))


def version_ranges(versions: DataFrame) -> DataFrame:
    """First and last version of each library in version order."""
    return versions.groupBy("library").agg(F.coalesce(F.concat(
        F.min_by("version", "version_key"), F.lit(" - "), F.max_by("version", "version_key")),
        F.lit("N/A")).alias("versions"))
