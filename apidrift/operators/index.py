"""Occurrence index: which names stand in which texts, kept from one run to the next.

Two tables: ``names`` (part, name, digest, n), one row for each name of each distinct text, and ``files`` (keys, digest).
Texts are known by the digest of their content, so equal files share their rows, and an update reads only texts whose digest is not there yet. A
look-up for some names touches the parts of the table that these names hash to, then the files of the digests found: a new rule
set never opens a file it cannot change.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.functions.lexing import identifiers

#: Parts of the names table: folders that a look-up can leave out.
PARTS = 64


@dataclass(frozen=True)
class Index:
    names: DataFrame
    files: DataFrame
    keys: tuple[str, ...]

    def save(self, folder: str) -> None:
        """Writes the index; a part is written by several tasks, each name's rows side by side."""
        self.names.repartitionByRange("part", "name", "digest").sortWithinPartitions("part", "name").write.partitionBy("part").parquet(f"{folder}/names")
        self.files.write.parquet(f"{folder}/files")

    @staticmethod
    def load(spark: SparkSession, folder: str, keys: Sequence[str]) -> Index:
        return Index(spark.read.parquet(f"{folder}/names"), spark.read.parquet(f"{folder}/files"), tuple(keys))


def _part(name: Column) -> Column:
    return F.pmod(F.hash(name), F.lit(PARTS)).cast("int")


def _digested(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    return files.select(*keys, F.sha2(F.col("content"), 256).alias("digest"), "content").where("content is not null")


def _names(texts: DataFrame) -> DataFrame:
    """Names of distinct texts (digest, content), counted within the row before anything is exploded."""
    words = F.array_sort(identifiers(F.col("content")))
    return texts.select("digest", F.explode(words).alias("name")).groupBy("digest", "name").agg(F.count("*").alias("n")).select(
        _part(F.col("name")).alias("part"), "name", "digest", "n")


def build(files: DataFrame, keys: Sequence[str]) -> Index:
    """The index of ``files`` (keys, content)."""
    held = _digested(files, keys)
    # Copies of a text fall together before it is read: only digests are compared.
    return Index(_names(held.groupBy("digest").agg(F.first("content").alias("content"))), held.select(*keys, "digest"), tuple(keys))


def update(index: Index, files: DataFrame) -> tuple[Index, DataFrame]:
    """The index of ``files`` by way of an older one, and the digests that had to be read for it.

    Names of texts that are gone leave; texts that are known are not read again, whatever file they are in now.
    """
    held = _digested(files, index.keys)
    known = index.files.select("digest").distinct()
    fresh = held.join(known, "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"))
    now = held.select(*index.keys, "digest")
    stay = index.names.join(now.select("digest").distinct(), "digest", "left_semi").select("part", "name", "digest", "n")
    return Index(stay.unionByName(_names(fresh)), now, index.keys), fresh.select("digest")


def occurrences(index: Index, names: DataFrame) -> DataFrame:
    """keys, name, n of the files that hold some of the names (one column ``name``)."""
    asked = names.select("name").distinct().select(_part(F.col("name")).alias("part"), "name")
    return index.names.join(asked, ["part", "name"]).select("name", "digest", "n").join(index.files, "digest").select(*index.keys, "name", "n")


def touched(index: Index, names: DataFrame) -> DataFrame:
    """keys of the files that hold some of the names."""
    return occurrences(index, names).select(*index.keys).distinct()
