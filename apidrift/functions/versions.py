"""Version strings as comparable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def version_key(version) -> Column:
    """All digit runs as numbers; arrays compare like tuples (shorter prefix first).

    A run of more than 38 digits counts as larger than any other.
    """
    most = F.lit("9" * 38).cast("decimal(38,0)")
    return F.transform(
        F.regexp_extract_all(_col(version), F.lit(r"\d+"), F.lit(0)),
        lambda x: F.coalesce(x.try_cast("decimal(38,0)"), most))


def is_version(version) -> Column:
    return _col(version).rlike(r"^\d+\.\d+\.\d+\z")
