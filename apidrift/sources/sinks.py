"""Writers for migration results; sources are never overwritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _backup_path() -> Column:
    return F.concat(F.regexp_replace("path", r"\.py$", ""), F.lit(".py.bak"))


def backups(results: DataFrame) -> DataFrame:
    """Originals of the modified files under their backup names."""
    return results.where("was_modified").select(
        "repo", "path", _backup_path().alias("backup_path"),
        F.col("original_code").alias("content"),
    )


#: Tasks that share the files of one repository and kind when results are written.
REPO_PARTS = 16


def write_migrated(results: DataFrame, target: str, backup: bool = True, dry_run: bool = False) -> None:
    """Write modified files, and their originals, as one dataset partitioned by ``kind`` and ``repo``.

    Kinds are ``migrated`` and ``backup``; columns ``path`` (the file's own) and ``written_path``. The migration runs
    once for both. Rows are dealt by repository and a part of the path, so a repository is written by few tasks
    and a large one by several.
    """
    if dry_run:
        return
    kinds = [F.struct(F.lit("migrated").alias("kind"), F.col("path").alias("written_path"), F.col("transformed_code").alias("content"))]
    if backup:
        kinds.append(F.struct(
            F.lit("backup").alias("kind"), _backup_path().alias("written_path"), F.col("original_code").alias("content")))
    results.where("was_modified").select("repo", "path", F.inline(F.array(*kinds))).repartition(
        "repo", F.pmod(F.xxhash64("path"), F.lit(REPO_PARTS))).write.mode("errorifexists").partitionBy("kind", "repo").parquet(target)


def write_rules(documents: DataFrame, target: str) -> None:
    """Write exported rule documents, one JSON document per line."""
    documents.select("content").write.mode("errorifexists").text(target)
