"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes lie on a ring of hash values. A key belongs to the first node clockwise;
a shard that has reached its capacity takes no more, and its keys continue clockwise to the
next node of a shard with room. Keys are served in ring order, so the unplaced keys are always one
interval of that order, and the walk around the ring needs counts only: each node takes the
front of the interval. The capacities add up to the number of rows and differ by one at most,
so shard counts do as well (law ``rows``), while a key moves only if its arc changes hands or
an interval border passes over it.

Law ``rows`` bounds counts, so equal texts cannot always share a shard (a third of all rows may be one text); they are placed by
their own keys, as all rows are.

The ring is cut into cells (high bits of the hash). Counts per cell, nodes and the pieces
of cells that go to one shard are tables bounded by ``cells + 2 * shards * virtual_nodes`` rows, whatever
the input; the piece table is broadcast for that reason. Rows are ranked within their cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm.tables import whole

#: High bits of a hash that name its cell: 12 at least, more for more than so many rows a cell, 20 at most (the table of
#: pieces is broadcast: about 40 MB then, and cells of 10^11 rows hold 100,000 each).
LEAST_BITS, MOST_BITS, CELL_ROWS = 12, 20, 1 << 16


def shard(
    docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    ``home_shard`` is the ring's own choice before loads are bounded; rows with another ``shard``
    overflowed. A null text has size 1 and the checksum of the empty text. A row without id is hashed by its
    text's checksum. Repeated rows are placed one by one (ties in the ring order take any order:
    such rows are equal in every returned column but shard and slot). An empty table gives no rows. Other
    columns are ignored.
    """
    if shards < 1 or virtual_nodes < 1:
        raise ValueError("shards and virtual_nodes must be positive")
    spark = docs.sparkSession
    bits = max(LEAST_BITS, min(MOST_BITS, (docs.count() // CELL_ROWS).bit_length()))
    keys = docs.select(
        F.col(id_col).alias("key"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(whole(text_col)).alias("crc"),
        F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("none"), F.crc32(whole(text_col)))).otherwise(
            F.xxhash64(F.lit("key"), F.col(id_col))).alias("point"),
    ).withColumn("cell", F.shiftrightunsigned("point", 64 - bits).cast("int"))

    counts = keys.groupBy("cell").agg(F.count("*").alias("n"))
    # A node's id holds its shard, so it keeps its place when shards are added.
    nodes = spark.range(shards * virtual_nodes).select(
        F.floor(F.col("id") / virtual_nodes).cast("int").alias("shard"), F.xxhash64(F.lit("node"), "id").alias("point"),
    ).withColumn("cell", F.shiftrightunsigned("point", 64 - bits).cast("int"))
    pieces = _pieces(_walk(counts, nodes, shards), counts)

    rank = F.row_number().over(Window.partitionBy("cell").orderBy("point", "key", "crc", "size")) - 1
    ranked = keys.withColumn("rank", rank)
    placed = ranked.join(
        F.broadcast(pieces),
        (F.col("cell") == F.col("piece_cell")) & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("to_rank")),
    )
    return placed.select(
        F.col("key").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard"), (F.col("slot_base") + F.col("rank") - F.col("from_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def _walk(counts: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """Intervals ``[from, to)`` of the ring order with their shard and first slot.

    One row of at most ``shards * virtual_nodes`` nodes is folded; two laps, since keys behind the
    last node pass over its start.
    """
    clockwise = Window.orderBy("cell", "kind", "point").rowsBetween(Window.unboundedPreceding, 0)
    marks = counts.select("cell", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("point"), "n",
                          F.lit(None).cast("int").alias("shard")).unionByName(
        nodes.select("cell", F.lit(1).alias("kind"), "point", F.lit(0).cast("long").alias("n"), "shard"))
    ring = marks.withColumns({
        "upto": F.sum("n").over(clockwise), "total": F.sum("n").over(Window.partitionBy(F.lit(0))),
    }).where("kind = 1").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("cell", "point", "upto", "shard"))),
            lambda x: F.struct(x["upto"].alias("upto"), x["shard"].alias("shard")),
        ).alias("nodes"),
        F.max("total").alias("total"),
    ).withColumn("steps", F.concat(
        "nodes", F.transform("nodes", lambda x: F.struct(F.col("total").alias("upto"), x["shard"].alias("shard"))),
    ))
    room = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0),
    )
    taken = "array<struct<start:bigint,stop:bigint,shard:int,slot_base:bigint>>"
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.transform(room, lambda _: F.lit(0).cast("long")).alias("used"),
        room.cast("array<bigint>").alias("room"),
        F.array().cast(taken).alias("out"),
    )

    def step(state, node):
        used = F.get(state["used"], node["shard"])
        take = F.greatest(F.lit(0).cast("long"), F.least(
            node["upto"] - state["at"], F.get(state["room"], node["shard"]) - used))
        return F.struct(
            (state["at"] + take).alias("at"),
            F.transform(state["used"], lambda u, i: F.when(i == node["shard"], u + take).otherwise(u)).alias("used"),
            state["room"].alias("room"),
            F.when(take > 0, F.concat(state["out"], F.array(F.struct(
                state["at"].alias("start"), (state["at"] + take).alias("stop"),
                node["shard"].alias("shard"), used.alias("slot_base"),
            )))).otherwise(state["out"]).alias("out"),
        )

    walked = ring.select(F.aggregate("steps", start, step, lambda s: s["out"]).alias("out"), "nodes", "total")
    # Nodes without keys start where the next one does; the later one (by ordinal) is meant.
    homes = F.transform("nodes", lambda x, i: F.struct(
        F.coalesce(F.get(F.col("nodes"), i - 1)["upto"], F.lit(0).cast("long")).alias("start"),
        F.struct(i.alias("ordinal"), x["shard"].alias("shard")).alias("home")))
    behind = F.array(F.struct(  # keys behind the last node belong to the first
        F.element_at("nodes", -1)["upto"].alias("start"),
        F.struct(F.size("nodes").alias("ordinal"), F.element_at("nodes", 1)["shard"].alias("shard")).alias("home"),
    ))
    return walked.select("out", F.concat(homes, behind).alias("homes"))


def _pieces(walked: DataFrame, counts: DataFrame) -> DataFrame:
    """Cells cut where the taking interval or the home node changes."""
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.select(F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("start"), "cell")
    intervals = walked.select(F.inline("out")).select("start", F.struct("start", "shard", "slot_base").alias("taker"))
    homes = walked.select(F.inline("homes"))
    end = counts.agg(F.sum("n").alias("start"))
    marks = cells.unionByName(intervals, True).unionByName(homes, True).unionByName(end, True)
    # Cells and intervals are never empty, so a place has at most one of each.
    cuts = marks.where("start is not null").groupBy("start").agg(
        F.max("cell").alias("cell"), F.max("taker").alias("taker"), F.max("home").alias("home"))
    line = Window.orderBy("start")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    filled = cuts.select(
        "start", F.lead("start").over(line).alias("stop"), F.last("cell", True).over(upto).alias("cell"),
        F.last("taker", True).over(upto).alias("taker"), F.last("home", True).over(upto).alias("home"),
    ).where("stop is not null")
    cell_start = F.min("start").over(Window.partitionBy("cell"))
    return filled.select(
        F.col("cell").alias("piece_cell"), (F.col("start") - cell_start).alias("from_rank"),
        (F.col("stop") - cell_start).alias("to_rank"), F.col("taker.shard").alias("shard"),
        (F.col("taker.slot_base") + F.col("start") - F.col("taker.start")).alias("slot_base"),
        F.col("home.shard").alias("home_shard"),
    )
