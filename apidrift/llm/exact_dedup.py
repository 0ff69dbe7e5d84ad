"""Exact deduplication over a live cuckoo-filter index.

Texts are equal when they are once blanks are deleted; their key is the SHA-256 of what remains. Keys are spread
over buckets by their leading bits. A bucket owns a cuckoo filter (16-bit fingerprints, four slots a
row, two rows a key) and the table of its live keys. A key that the filter misses is new and goes in
without a look at the table; a hit is verified against the bucket's keys, since a fingerprint may belong
to another text. Keys can be deleted again. When an insertion finds no slot after ``MAX_KICKS``
moves, the filter is rebuilt with twice the rows from the stored keys; nothing is lost.

Spark partitions the work: digests are computed in the scan, copies are merged per key before the shuffle (a
group of copies of any size becomes one row per map task), and a bucket task sees distinct keys only.
Bucket count follows the number of keys, so a bucket stays at about ``KEYS_PER_BUCKET``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.tables import BLANKS, frugal_groups, whole, written

SLOTS = 4
MAX_KICKS = 200
KEYS_PER_BUCKET = 50_000
INDEX_SCHEMA = "bucket int, n_rows int, filter binary, keys binary"
KEY_BYTES = 32


class CuckooFilter:
    """Fingerprints of live keys; ``keys`` is the bucket's content that hits are verified against."""

    def __init__(self, keys: Iterable[bytes] = (), n_rows: int = 64) -> None:
        self.keys: set[bytes] = set(keys)
        self.n_rows = max(1, n_rows)
        self._resize()

    @classmethod
    def load(cls, n_rows: int, table: bytes, keys: bytes) -> CuckooFilter:
        new = cls.__new__(cls)
        new.keys = {keys[i:i + KEY_BYTES] for i in range(0, len(keys), KEY_BYTES)}
        new.n_rows = n_rows
        new.table = np.frombuffer(table, np.uint16).reshape(n_rows, SLOTS).tolist()
        return new

    def dump(self) -> tuple[int, bytes, bytes]:
        return self.n_rows, np.array(self.table, np.uint16).tobytes(), b"".join(sorted(self.keys))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1  # 0 is an empty slot
        first = int.from_bytes(key[10:18], "little") & (self.n_rows - 1)
        return mark, first, self._other(first, mark)

    def _other(self, row: int, mark: int) -> int:
        return row ^ (mark * 0x5BD1E995 & (self.n_rows - 1))

    def _put(self, key: bytes) -> bool:
        mark, row, other = self._places(key)
        for at in (row, other):
            slots = self.table[at]
            if 0 in slots:
                slots[slots.index(0)] = mark
                return True
        for kick in range(MAX_KICKS):
            slots = self.table[other]
            slots[kick % SLOTS], mark = mark, slots[kick % SLOTS]
            other = self._other(other, mark)
            if 0 in self.table[other]:
                self.table[other][self.table[other].index(0)] = mark
                return True
        return False

    def _resize(self) -> None:
        while self.n_rows * SLOTS * 0.9 < len(self.keys):
            self.n_rows *= 2
        while True:
            self.table = [[0] * SLOTS for _ in range(self.n_rows)]
            if all(map(self._put, self.keys)):
                return
            self.n_rows *= 2

    def may_hold(self, key: bytes) -> bool:
        mark, row, other = self._places(key)
        return mark in self.table[row] or mark in self.table[other]

    def __contains__(self, key: bytes) -> bool:
        return self.may_hold(key) and key in self.keys

    def insert(self, key: bytes) -> bool:
        """False if the key is live already."""
        if key in self:
            return False
        self.keys.add(key)
        if not self._put(key):
            # Keys that share fingerprint and rows can fill both rows at any size; more than
            # 2 * SLOTS of those would need equal 16 + 64 digest bits.
            self.n_rows *= 2
            self._resize()
        return True

    def delete(self, key: bytes) -> bool:
        """False if the key is not live."""
        if key not in self:
            return False
        self.keys.remove(key)
        mark, row, other = self._places(key)
        slots = self.table[row if mark in self.table[row] else other]
        slots[slots.index(mark)] = 0
        return True


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, chars, sha): code points of the original text, digest of the text without blanks; and row, if there is a key."""
    text = whole(text_col)
    return docs.select(
        F.col(id_col).alias("id"), F.length(text).cast("long").alias("chars"),
        F.sha2(F.translate(text, BLANKS, ""), 256).alias("sha"), *([F.col(row_col).alias("row")] if row_col else []),
    )


def bucket_count(n_keys: int) -> int:
    return max(1, -(-n_keys // KEYS_PER_BUCKET))


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    head = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long")
    return keys.withColumn("bucket", (head % buckets).cast("int"))


def update_index(index: DataFrame, keys: DataFrame, buckets: int, delete: bool = False) -> DataFrame:
    """The index with keys (column ``sha``) inserted or deleted; unknown deletions do nothing.

    ``buckets`` must be the count the index was made with.
    """
    def change(_: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if len(old):
            live = CuckooFilter.load(int(old.n_rows[0]), old["filter"][0], old["keys"][0])
            bucket = int(old.bucket[0])
        else:
            live, bucket = CuckooFilter(), int(new.bucket[0])
        for key in map(bytes.fromhex, new.sha):
            (live.delete if delete else live.insert)(key)
        return pd.DataFrame([(bucket, *live.dump())], columns=["bucket", "n_rows", "filter", "keys"])

    wanted = _bucketed(keys.select("sha").where("sha is not null").distinct(), buckets)
    return index.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInPandas(change, INDEX_SCHEMA)


def empty_index(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], INDEX_SCHEMA)


def look_up(index: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """(sha, live) for the distinct keys: a filter hit counts once the stored key agrees."""
    def ask(_: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        live = CuckooFilter.load(int(old.n_rows[0]), old["filter"][0], old["keys"][0]) if len(old) else CuckooFilter()
        return pd.DataFrame({"sha": new.sha, "live": [bytes.fromhex(k) in live for k in new.sha]})

    wanted = _bucketed(keys.select("sha").where("sha is not null").distinct(), buckets)
    return index.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInPandas(ask, "sha string, live boolean")


def _settle(part: pa.Table) -> pa.Table:
    """Partial groups of one bucket through its filter: a miss opens a group, a verified hit joins one."""
    groups: dict[bytes, list] = {}
    live = CuckooFilter()
    columns = (part.column(name).to_pylist() for name in ("sha", "chars", "keep", "keep_row", "n"))
    for sha, chars, keep, row, n in zip(*columns, strict=True):
        key, rank = bytes.fromhex(sha), (-chars, keep is None, keep, row)
        if live.insert(key):
            groups[key] = [rank, n]
        else:
            groups[key][0] = min(groups[key][0], rank)
            groups[key][1] += n
    return pa.table({
        "of": pa.array([key.hex() for key in groups], pa.string()),
        "keep_id": pa.array([rank[2] for rank, _ in groups.values()], part.schema.field("keep").type),
        "keep_row": pa.array([rank[3] for rank, _ in groups.values()], part.schema.field("keep_row").type),
        "group_size": pa.array([n for _, n in groups.values()], pa.int64()),
    })


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty or blank texts are equal. Of equal texts the row with the most code
    points, then the smallest id stays. Rows that repeat an id share its verdict and count one by one in
    ``group_size``; a null id comes after all others. With ``row_col``, a key of each row, the smallest key decides
    among rows that repeat the id, exactly one row of equal texts is kept, and the key is a last column. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = written(digests(docs, id_col, text_col, row_col), "digests")
    row = F.col("row") if row_col else F.lit(None).cast("long")
    kind, row_kind = dict(rows.dtypes)["id"], dict(rows.dtypes).get("row", "long")
    buckets = bucket_count(rows.count())
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id"), row.alias("row")))
    # Copies merge in the map tasks; the salt keeps even their partial rows of one key apart.
    parts = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))).groupBy("sha", "salt").agg(
        best.alias("best"), F.count("*").alias("n"))
    groups = _bucketed(parts.select("sha", (-F.col("best.less")).alias("chars"), F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"), "n"), buckets)
    settled = groups.groupBy("bucket").applyInArrow(
        frugal_groups(_settle), f"of string, keep_id {kind}, keep_row {row_kind}, group_size long")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & row.eqNullSafe(F.col("keep_row"))
    return rows.join(settled, F.col("sha") == F.col("of")).select(
        F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"),
        F.col("sha").alias("text_sha256"), *([row.alias(row_col)] if row_col else []),
    )
