"""Source files as a table ``files(file_id, repo, path, content)``."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Globs left out of a directory scan.
DEFAULT_EXCLUDES = ("**/test_*.py", "**/__pycache__/**")


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a shell glob; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1:close]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = close
        else:
            out.append(ch if ch.isalnum() or ch in "_/ " else "\\" + ch)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def selected(path: Column, excludes=DEFAULT_EXCLUDES) -> Column:
    keep = path.endswith(".py")
    for glob in excludes or DEFAULT_EXCLUDES:
        keep = keep & ~path.rlike(glob_regex(glob))
    return keep


def scan(files: DataFrame, excludes=DEFAULT_EXCLUDES) -> DataFrame:
    """Python files of a scan, without the excluded ones (``files`` has a ``path``)."""
    return files.where(selected(F.col("path"), excludes))


def decode(files: DataFrame) -> DataFrame:
    """``content BINARY`` to text; undecodable files become failed results rows."""
    text = F.col("content").cast("string")
    return files.withColumn("error", F.when(~F.is_valid_utf8(text), F.lit("invalid UTF-8"))).withColumn(
        "content", F.when(F.col("error").isNull(), text).otherwise(F.lit(""))
    )


def list_directory(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root``, listed in parallel over its top-level entries.

    Spark's own file sources skip names that start with ``_`` or ``.``, so
    ``__init__.py`` would never be seen; hence the small listing helper.
    """
    top = sorted(os.listdir(root))
    entries = spark.createDataFrame([(os.path.join(root, t),) for t in top], "entry string")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for entry in batch["entry"]:
                if os.path.isfile(entry):
                    yield pd.DataFrame({"path": [entry]})
                for folder, _, names in os.walk(entry):
                    yield pd.DataFrame({"path": [os.path.join(folder, n) for n in names]})

    return entries.repartition(max(1, min(len(top), 1000))).mapInPandas(walk, "path string")


def read_directory(spark: SparkSession, root: str, excludes=DEFAULT_EXCLUDES, repo: str = "") -> DataFrame:
    """Python files below ``root`` (a folder all executors see), read inside the tasks."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(path, "rb") as handle:
                    yield pd.DataFrame({"path": [path], "content": [handle.read()]})

    raw = scan(list_directory(spark, root), excludes).mapInPandas(load, "path string, content binary")
    return decode(raw).select(
        F.concat_ws("|", F.lit(repo), "path").alias("file_id"), F.lit(repo).alias("repo"), "path", "content", "error"
    )
