"""Hard negatives of anchors by shared, certified walks of anchor clusters.

1. Vectors are quantised to integers and packed in blocks. Anchors are clustered by direction: spherical k-means fitted on at most
   ``FIT_ANCHORS`` anchors (chosen by the hash of their id); every anchor joins its nearest centre. Clusters only
   decide how much is walked, never what is found.
2. Anchor groups (at most about ``GROUP_ANCHORS`` anchors) meet slabs of rows (at most about ``SLAB_ROWS``) in the cells of a grid,
   one cogroup each: a stated query set against all rows, in blocks. Both sides grow with the data and neither is broadcast.
3. In a cell each cluster sorts the slab once by an upper bound of the score with any of its members: the row's length times the
   cosine of the least possible angle (row to centre, less the cluster's radius). All members walk that list in tiles. A member stops
   when its k-th best score so far is above what the bound still allows, so what it did not see cannot matter.
4. The first slab is walked before the others; its k-th scores are the floor from which the others start.
5. The best of each slab meet in a window per anchor whose limit Spark applies before the shuffle, too.

The same walk finds positives (same label, best scores) and negatives (other label, best scores within a window of each positive).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm.tables import written

#: Every how manieth id is an anchor, which labels are moved on (id divisible by 7, ten labels), and the scale of components.
ANCHOR_EACH, MOVED_EACH, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 10
#: Anchors that centres are fitted on, anchors a cluster aims at, and the most clusters.
FIT_ANCHORS, CLUSTER_ANCHORS, MOST_CLUSTERS, FIT_ROUNDS = 4096, 64, 256, 8
GROUP_ANCHORS, SLAB_ROWS, BLOCK_ROWS, LEAST_SLABS = 16384, 32768, 2048, 8
#: Rows of the list and members of a cluster that are scored at a time.
TILE, MEMBERS = 512, 512
#: Rows whose length reaches this have scores beyond 64 bits.
MOST_LENGTH = 2.0 ** 31
#: Room for rounding in the bounds, relative to the lengths (an angle near 0 is known to about 2e-8).
ROOM = 1e-6

_BLOCK = "block long, width int, ids binary, labels binary, vectors binary"
_ANCHOR = "place long, cluster int, anchor_id long, label long, vector binary"


def _taken(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and integer vectors (rows x width, missing components 0) of the rows that take part."""
    lists = batch.column("vector")
    full = pc.and_(pc.and_(pc.is_valid(batch.column("id")), pc.is_valid(batch.column("label"))), pc.is_valid(lists))
    batch = batch.filter(full)
    lists = batch.column("vector")
    sizes = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    vectors = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    vectors[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    keep = np.isfinite(vectors).all(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        vectors = np.floor(SCALE * np.where(keep[:, None], vectors, 0))
        keep &= np.sqrt((vectors * vectors).sum(axis=1)) < MOST_LENGTH
    return (batch.column("id").to_numpy()[keep], batch.column("label").to_numpy()[keep], vectors[keep].astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks of rows, numbered by partition and place."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            ids, labels, vectors = _taken(batch.slice(start, BLOCK_ROWS))
            if len(ids):
                number += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([vectors.shape[1]], pa.int32()), pa.array([ids.tobytes()]),
                    pa.array([labels.tobytes()]), pa.array([vectors.tobytes()]),
                ], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length == 0, 1, length)


def centres(vectors: np.ndarray, number: int) -> np.ndarray:
    """Spherical k-means; starts are spread over the rows in their given order."""
    units = _unit(vectors.astype(np.float64))
    at = units[np.linspace(0, len(units) - 1, number).astype(int)]
    for _ in range(FIT_ROUNDS):
        nearest = np.argmax(units @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, units)
        at = np.where((np.bincount(nearest, minlength=number) > 0)[:, None], _unit(sums), at)
    return at


def _anchors(points: np.ndarray) -> Callable:
    """Anchors with their cluster; ``place`` tells repeated rows of one id apart."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, labels, vectors = _taken(batch)
            width = min(vectors.shape[1], points.shape[1])
            cluster = np.argmax(_unit(vectors[:, :width].astype(np.float64)) @ points[:, :width].T, axis=1) if len(ids) else []
            yield pa.RecordBatch.from_arrays([
                pa.array(place + np.arange(len(ids))), pa.array(cluster, pa.int32()), pa.array(ids), pa.array(labels),
                pa.array([v.tobytes() for v in vectors], pa.binary()),
            ], names=[c.split()[0] for c in _ANCHOR.split(", ")])
            place += len(ids)
    return assign


def _padded(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; floating matrix products wherever all partial sums are exact in them."""
    most = np.linalg.norm(a.astype(np.float64), axis=1).max(initial=0) * np.linalg.norm(b.astype(np.float64), axis=1).max(initial=0)
    for kind, exact in ((np.float32, 2.0 ** 23), (np.float64, 2.0 ** 52)):
        if most < exact:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each of a number of seekers: higher scores first, ties by smaller id."""

    def __init__(self, seekers: int, k: int, floor: np.ndarray) -> None:
        """``floor``: a score that k rows somewhere are known to reach, for each seeker; what is below cannot count."""
        self.k, self.seekers = k, seekers
        self.floor = floor.copy()
        self.tied = np.full(seekers, np.iinfo(np.int64).max)
        self.who, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(who):
            return
        who, score, ids = (np.concatenate([a, b]) for a, b in ((self.who, who), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        first = np.searchsorted(who, np.arange(self.seekers))
        rank = np.arange(len(who)) - first[who]
        full = np.flatnonzero(rank == self.k - 1)
        self.floor[who[full]], self.tied[who[full]] = score[full], ids[full]
        keep = rank < self.k
        self.who, self.score, self.id = who[keep], score[keep], ids[keep]


def walk(
    vectors: np.ndarray, labels: np.ndarray, own: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool,
    windows: np.ndarray, k: int, floor: np.ndarray,
) -> tuple[Best, int]:
    """The members of one cluster walk the rows of a slab.

    ``windows``: members x seekers x 2, least and largest score that counts for each seeker of a member; ``floor`` likewise without the
    last axis. ``same`` asks for rows of the member's label other than itself, else for rows of other labels. Also
    returned: how many scores were computed.
    """
    ids, row_labels, row_vectors = rows
    members, seekers = floor.shape
    best = Best(members * seekers, k, np.maximum(floor, windows[..., 0]).reshape(-1))
    high = windows[..., 1].reshape(-1)
    lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)
    row_lengths = np.linalg.norm(row_vectors.astype(np.float64), axis=1)
    units = _unit(vectors.astype(np.float64))
    centre = _unit(units.sum(axis=0, keepdims=True))[0]
    radius = np.arccos(np.clip(units @ centre, -1, 1)).max()
    angle = np.arccos(np.clip(_unit(row_vectors.astype(np.float64)) @ centre, -1, 1))
    # No member's unit vector reaches more than this with the row; one of no length has only products of 0.
    bound = row_lengths * np.cos(np.maximum(0, angle - radius)) + ROOM * row_lengths
    bound = np.where(row_lengths == 0, 0, bound)
    order = np.argsort(-bound, kind="stable")
    active, scored = np.arange(members), 0
    for start in range(0, len(order), TILE):
        # What a member can still see at most; -0.0 and rounding are below half a unit.
        most = np.where(lengths > 0, lengths * bound[order[start]] * (1 + ROOM) + ROOM * lengths, 0) + 0.5
        active = active[(best.floor.reshape(members, seekers)[active] <= most[active, None]).any(axis=1)]
        if not len(active):
            break
        tile = order[start:start + TILE]
        score = products(vectors[active], row_vectors[tile])
        scored += score.size
        fits = (labels[active, None] == row_labels[None, tile]) == same
        if same:
            fits &= own[active, None] != ids[None, tile]
        for seeker in range(seekers):
            at = active * seekers + seeker
            enter = fits & (score <= high[at, None])
            enter &= (score > best.floor[at, None]) | ((score == best.floor[at, None]) & (ids[None, tile] <= best.tied[at, None]))
            m, r = np.nonzero(enter)
            best.add(at[m], score[m, r], ids[tile[r]])
    return best, scored


def _windows(positives: np.ndarray) -> np.ndarray:
    """Least and largest negative score s with 30 p <= 100 s <= 90 p, without leaving 64 bits."""
    tens, ones = positives // 10, positives % 10
    return np.stack([3 * tens - (-3 * ones) // 10, 9 * tens + (9 * ones) // 10], axis=-1)


_LEAST, _MOST = np.iinfo(np.int64).min // 2, np.iinfo(np.int64).max // 2


def _cell(same: bool, k: int) -> Callable:
    """One anchor group against one slab."""
    def meet(_: tuple, anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        found = [[] for _ in range(4)]
        width = 0
        if anchors.num_rows and blocks.num_rows:
            vectors = [np.frombuffer(v, np.int64)[None] for v in anchors.column("vector").to_pylist()]
            packed = [np.frombuffer(v, np.int64).reshape(-1, w) if w else np.zeros((len(i) // 8, 0), np.int64) for v, w, i in zip(
                blocks.column("vectors").to_pylist(), blocks.column("width").to_pylist(), blocks.column("ids").to_pylist(), strict=True)]
            width = max(*(v.shape[1] for v in vectors), *(v.shape[1] for v in packed), 1)
            vectors = np.concatenate([_padded(v, width) for v in vectors])
            rows = tuple(np.concatenate([np.frombuffer(b, np.int64) for b in blocks.column(c).to_pylist()]) for c in ("ids", "labels"))
            rows += (np.concatenate([_padded(v, width) for v in packed]),)
            place, own, labels, clusters = (anchors.column(c).to_numpy() for c in ("place", "anchor_id", "label", "cluster"))
            lists = anchors.column("seekers").to_pylist()
            for cluster in np.unique(clusters).tolist():
                members = np.flatnonzero(clusters == cluster)
                for cut in range(0, len(members), MEMBERS):
                    at = members[cut:cut + MEMBERS]
                    seekers = max(len(lists[i]) for i in at)
                    if not seekers:
                        continue
                    # A member with fewer seekers has empty windows for the rest.
                    window = np.full((len(at), seekers, 2), (_MOST, _LEAST), np.int64)
                    floor = np.full((len(at), seekers), _LEAST, np.int64)
                    ranks = np.zeros((len(at), seekers), np.int64)
                    for i, member in enumerate(at.tolist()):
                        for j, s in enumerate(lists[member]):
                            window[i, j] = (_LEAST, _MOST) if same else _windows(np.array(s["score"]))
                            floor[i, j] = _LEAST if s["floor"] is None else s["floor"]
                            ranks[i, j] = s["rank"]
                    best, _n = walk(vectors[at], labels[at], own[at], rows, same, window, k, floor)
                    found[0].append(place[at[best.who // seekers]])
                    found[1].append(ranks[best.who // seekers, best.who % seekers])
                    found[2].append(best.id)
                    found[3].append(best.score)
        joined = [np.concatenate([np.zeros(0, np.int64), *f]) for f in found]
        return pa.table(dict(zip(("place", "seeker", "id", "score"), joined, strict=True)))
    return meet


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("place", "seeker").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _mined(anchors: DataFrame, blocks: DataFrame, groups: int, slabs: int, same: bool, k: int, name: str) -> DataFrame:
    """place, seeker, id, score, rank: the best k rows of each seeker (rank within ``seekers`` of an anchor)."""
    def grid(anchors: DataFrame, slabs: Column, blocks: DataFrame) -> DataFrame:
        left = anchors.withColumn("anchor_group", F.pmod(F.hash("cluster", F.expr(f"place div {MEMBERS}")), F.lit(groups))).withColumn("slab", F.explode(slabs))
        right = blocks.withColumn("anchor_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        keys = ("anchor_group", "slab")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_cell(same, k), "place long, seeker long, id long, score long")

    first = written(_ranked(grid(anchors, F.array(F.lit(0)), blocks.where("slab = 0")), k), f"{name}-first")
    if slabs == 1:
        return first
    floors = first.where(F.col("rank") == k).groupBy(F.col("place").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("seeker", "score"))).alias("floors"))
    raised = anchors.join(floors, F.col("place") == F.col("of"), "left").drop("of").withColumn("seekers", F.transform(
        "seekers", lambda s: F.struct(s["rank"].alias("rank"), s["score"].alias("score"), F.try_element_at(F.col("floors"), s["rank"].cast("long")).alias("floor")))).drop("floors")
    rest = grid(raised, F.sequence(F.lit(1), F.lit(slabs - 1)), blocks.where("slab > 0"))
    return written(_ranked(first.drop("rank").unionByName(rest), k), name)


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", slab_rows: int = SLAB_ROWS,
    group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive.

    Rows without id, label or vector, or with a null or non-finite component, take no part; nor do rows so long (2^31 after scaling) that scores
    leave 64 bits. Missing components of a shorter vector count as 0; a vector without components scores 0 with all. A row
    repeated under one id is a candidate as often as it occurs, but never a positive of its own id; a repeated anchor gives its rows
    once for each repetition. Positives without negatives in their window give no row. An empty table gives no rows. Other columns are ignored.
    """
    label = F.col(label_col).cast("long")
    taken = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.col(id_col) % MOVED_EACH == 0, F.try_add(label, F.lit(1)) % LABELS).otherwise(label).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"))
    blocks = written(taken.mapInArrow(_blocks, _BLOCK), "vector-blocks")
    total = blocks.agg(F.sum(F.octet_length("ids") / 8).cast("long")).first()[0] or 0
    slabs = max(1, -(-total // slab_rows), min(LEAST_SLABS, total // BLOCK_ROWS))
    blocks = blocks.withColumn("slab", F.pmod(F.xxhash64("block"), F.lit(slabs)).cast("int"))
    asked = taken.where(F.col("id") % ANCHOR_EACH == 0)
    sample = asked.where("label is not null and vector is not null").orderBy(F.xxhash64("id"), "id").limit(FIT_ANCHORS).toArrow()
    fitted = [_taken(b) for b in sample.to_batches()]
    width = max([1, *(v.shape[1] for *_, v in fitted)])
    vectors = np.concatenate([np.zeros((0, width), np.int64), *(_padded(v, width) for *_, v in fitted)])
    points = centres(vectors, max(1, min(MOST_CLUSTERS, len(vectors) // CLUSTER_ANCHORS))) if len(vectors) else np.zeros((1, width))
    anchors = written(asked.mapInArrow(_anchors(points), _ANCHOR), "mining-anchors")
    groups = max(1, -(-anchors.count() // group_anchors))
    one = F.array(F.struct(F.lit(0).alias("rank"), F.lit(None).cast("long").alias("score"), F.lit(None).cast("long").alias("floor")))
    positives = _mined(anchors.withColumn("seekers", one), blocks, groups, slabs, True, POSITIVES, "positives")
    held = positives.groupBy(F.col("place").alias("of")).agg(F.sort_array(F.collect_list(F.struct("rank", "score", F.lit(None).cast("long").alias("floor")))).alias("seekers"))
    seeking = written(anchors.join(held, F.col("place") == F.col("of")).drop("of"), "mining-seekers")
    negatives = _mined(seeking, blocks, groups, slabs, False, NEGATIVES, "negatives")
    named = positives.select("place", F.col("rank").cast("long").alias("seeker"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.withColumnRenamed("score", "negative_score").withColumnRenamed("id", "negative_id").join(named, ["place", "seeker"]).join(
        anchors.select("place", "anchor_id"), "place").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
