"""Session settings the library is written for (a cluster sets its own)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", name: str = "apidrift", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without that setting gets a scratch folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="apidrift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """Cut the lineage of a table that is read several times: written as Parquet to the shared folder and
    read back, so it outlives executors and later plans start from its files."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_partitions(files: DataFrame) -> int:
    """Partitions for a shuffle of texts: the session's ``spark.sql.shuffle.partitions``.

    A fixed number, because texts grow about fiftyfold as token rows and adaptive coalescing only sees
    their compressed bytes. The caller chooses it so that a partition holds some tens of MB of text.
    """
    return int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
