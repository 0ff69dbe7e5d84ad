"""Documents to tokens in five stages, each written as Parquet and read again by the next.

A filtering stage works on all that its predecessor kept and returns the columns of documents. What leaves is usually
the smaller part, so stages drop by an anti join with the written keys of the rows that go (ids may be null or repeated): Spark broadcasts those where their measured
size permits and shuffles both sides otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.llm.bpe import encode_digests
from apidrift.llm.exact_dedup import dedup
from apidrift.llm.jaccard_join import link_groups
from apidrift.llm.language_id import document_rows, identify
from apidrift.llm.mixing import label_domains, mix
from apidrift.llm.queries import tokenizer_path
from apidrift.llm.tables import shared_folder, table, written

#: Shingle width and similarity (percent) of near duplicates.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Wanted shares of tokens. Totals are anchored to clean text, however scarce the rest is; the headroom keeps the rates
#: of clean documents at 1 or more.
TARGETS, HEADROOM, ANCHOR = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}, 1.25, "clean"


#: Name of the key that each row has within a stage.
ROW = "stage_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, whatever their ids: file and place of the Parquet files just read, else written with the rows."""
    place = F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit(":"), F.col("_metadata.row_index"))
    try:
        return docs.select("*", place.alias(ROW))
    except AnalysisException:  # not read from files
        return written(docs.withColumn(ROW, F.monotonically_increasing_id().cast("string")), "keyed")


def _without(keyed: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows whose key is not in ``gone``, without the key."""
    out = written(gone.select(F.col(ROW).alias("gone_row")), name)
    return keyed.join(out, F.col(ROW) == F.col("gone_row"), "left_anti").drop(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language."""
    keyed = _keyed(docs)
    found = identify(document_rows(keyed.withColumn("doc_id", F.col(ROW)))).withColumnRenamed("doc_id", ROW)
    return _without(keyed, found.where("not kept"), "no-language")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    keyed = _keyed(docs)
    return _without(keyed, dedup(keyed, row_col=ROW).where("not kept"), "exact-copies")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: that with the smallest id, a null id last."""
    keyed = _keyed(docs)
    groups = link_groups(keyed, NEAR_WIDTH, NEAR_PERCENT, ROW).where("n_shingles > 0").select(ROW, "component_id")
    members = written(groups.join(keyed.select(F.col(ROW).alias("of"), "doc_id"), F.col(ROW) == F.col("of")).drop("of"), "near-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(ROW).alias("row")))
    best = written(members.groupBy(F.col("component_id").alias("group")).agg(
        first.alias("first"), F.count("*").alias("n")).where("n > 1").select("group", F.col("first.row").alias("keep")), "near-kept")
    return _without(keyed, members.join(best, F.col("component_id") == F.col("group")).where(F.col(ROW) != F.col("keep")), "near-copies")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix uses at least once; none is repeated."""
    keyed = _keyed(docs)
    rates = mix(keyed, label_domains(table(spark, sf_dir, "labels")), TARGETS, HEADROOM, anchor=ANCHOR, row_col=ROW)
    return _without(keyed, rates.where("copies = 0"), "mixed-out")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each remaining document."""
    return encode_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Classifier, language model and BPE cannot be expressed in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; stages in between are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
