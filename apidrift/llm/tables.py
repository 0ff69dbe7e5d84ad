"""What the operators share: reading a table, settling a result, word boundaries."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word in the contracts: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 8 << 20
#: Bytes of text behind one bucket of a bucketed table.
BUCKET_TEXT = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """A text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Parquet keeps the smallest and largest value of each column; for packed columns those would be whole blobs.
_PARQUET = {"compression": "zstd", "parquet.column.statistics.enabled": "false", "parquet.statistics.truncate.length": "64"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a scratch folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="apidrift-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back: its lineage is cut and
    a lost executor costs no more than the tasks it ran. The folder's owner clears it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.options(**_PARQUET).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def written_by(frame: DataFrame, name: str, key: str, size: int = 0) -> DataFrame:
    """Like ``written``, bucketed by a key: what groups by the key afterwards needs no shuffle of this table.

    Buckets are not split later on, so their number follows ``size``, the bytes of text behind the table (``BUCKET_TEXT`` each), up
    to what Spark permits. The table is external, in the shared folder, under a name of its own in the session's catalog.
    """
    spark = frame.sparkSession
    unique = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    least, most = (int(spark.conf.get(f"spark.sql.{limit}")) for limit in ("shuffle.partitions", "sources.bucketing.maxBuckets"))
    buckets = min(most, max(least, -(-size // BUCKET_TEXT)))
    frame.write.format("parquet").bucketBy(buckets, key).options(**_PARQUET).option(
        "path", f"{shared_folder(spark).rstrip('/')}/{unique}").saveAsTable(unique)
    return spark.table(unique)


def small_batches(spark: SparkSession) -> None:
    """Let batches of texts go to Python in ``BATCH_BYTES`` at most, unless the session asks for less: both sides of
    the exchange hold a batch in memory for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = re.fullmatch(r"(\d+) *([kmgtp]?)(i?b)?", str(spark.conf.get(name)).lower())
    if asked and int(asked[1]) << 10 * " kmgtp".index(asked[2] or " ") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most so many bytes of text each; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, and so would their largest moment."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(function: Callable) -> Callable:
    """A function for mapInArrow, or for groups in Arrow, that keeps nothing when it is done.

    Arrow takes buffers from malloc, where they can be given back, instead of a pool of its own.
    """
    @functools.wraps(function)
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from function(given)
        finally:
            release()

    return batches


def frugal_groups(function: Callable) -> Callable:
    """The same for a function of one group (or two); Spark counts its parameters."""
    def done(*given: object) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return function(*given)
        finally:
            release()

    if function.__code__.co_argcount == 1:
        return lambda part: done(part)
    return lambda key, left, right: done(key, left, right)
