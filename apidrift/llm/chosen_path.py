"""Near duplicates by a chosen-path similarity join over MinHash sketches.

1. Equal shingle sets are one class; a class has a sketch of ``COORDINATES`` minwise values. Sketches agree in a coordinate
   with the probability of the sets' Jaccard similarity.
2. Each of a number of independent trees branches the classes: at a node a class goes to the children of the minwise tokens (coordinate, value)
   whose hash with the node falls below 1 / (similarity x coordinates), one and a quarter on average. Similar classes keep meeting, others part.
   Trees are as many as the target recall needs, by the branching process of a pair exactly at the threshold.
3. No node emits all its pairs. First each class meets only the leader of each of its first nodes; verified links give components, and from
   then on only nodes with several components count. A family of near copies is one component by then.
4. A node of up to ``SMALL`` classes is compared exhaustively, across components; larger ones branch again. What still is large
   after ``MOST_LEVELS`` (a dense family without links) is compared in pairs of blocks, so nothing is left out. Of all
   these pairs the best one of each class is verified first (twice), then all whose components still differ.
5. Sketches only propose (similarity less five standard deviations). Within a node they are followed by profiles, the up to ``PROFILE`` smallest
   hashes of a set, so that hardly any pair leaves its node that does not link. Every link is confirmed on full sets.

Node tables hold keys and digests only. Node sizes, leaders and labels come from aggregates that combine before their shuffle, so a
passage of a third of all documents costs no task more than others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.components import components
from apidrift.llm.jaccard_join import _mixed, _Words, shingle_set
from apidrift.llm.tables import frugal, slices, small_batches, whole, written

COORDINATES = 128
#: Classes of a node that are compared exhaustively, and levels after which larger nodes are compared in blocks.
SMALL, MOST_LEVELS = 2048, 12
#: Recall that the trees aim at for a pair at the threshold that parts only after so many levels.
TARGET_RECALL, TARGET_LEVELS = 0.9995, 3
#: Standard deviations of the agreement of two sketches by which a proposed pair may fall below the threshold.
DEVIATIONS = 5
BLOCK_BYTES = 4 << 20
#: Elements of a profile: the whole set where it is no larger, else its smallest hashes.
PROFILE = 512
#: Elements that meet all coordinates at a time, and tokens of the branching step.
ELEMENTS, BRANCHED = 512, 2048
#: Bytes of sketches of a node that are held against all others at a time.
AGREED_BYTES = 4 << 20

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 2**63, COORDINATES, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, COORDINATES, np.int64).astype(np.uint64)


def trees_for(recall: float, levels: int) -> int:
    """Trees so that a pair at the threshold stays together through so many levels of one of them with this probability."""
    stays = 1.0
    for _ in range(levels):
        stays = 1 - math.exp(-stays)
    return math.ceil(math.log(1 - recall) / math.log(1 - stays))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Minwise values (32 bits) of a set of 64-bit hashes in every coordinate."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(elements), ELEMENTS):
        best = np.minimum(best, (elements[at:at + ELEMENTS, None] * _FACTORS + _SHIFTS).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def _sketches(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch, "text", BLOCK_BYTES)):
            words = _Words()
            sets = [shingle_set(text, width, words) for text in batch.column("text").to_pylist()]
            found = [sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(list(map(len, sets)), pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([None if x is None else x.tobytes() for x in found], pa.binary()),
                pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in found], pa.binary()),
            ], names=["id", "n", "digest", "sketch", "short"])
    return cut


def _full_sets(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in (part for whole_batch in batches for part in slices(whole_batch, "text", BLOCK_BYTES)):
            words = _Words()
            sets = [shingle_set(text, width, words) for text in batch.column("text").to_pylist()]
            digests = list(map(xxhash.xxh3_128_digest, (s.tobytes() for s in sets)))
            # A repeated row gives its set once a task.
            fresh = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
            sets, digests = [sets[i] for i in fresh], [digests[i] for i in fresh]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)),
            ], names=["digest", "tokens"])
    return cut


def _profiles(width: int):
    """Digest, profile (upper halves of the smallest hashes) and size of sets."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in (part for whole_batch in batches for part in slices(whole_batch, "text", BLOCK_BYTES)):
            words = _Words()
            rows = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width, words)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, (s[:PROFILE] >> np.uint64(32)).astype(np.uint32).tobytes(), len(s)))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()),
            ], names=["digest", "profile", "n"])
    return cut


def similarity(mine: np.ndarray, my_limit: int, others: list[np.ndarray], limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of one profile to others, and its standard deviation: 0 where both are whole sets.

    A limit is the largest hash that a profile would hold; two profiles are compared up to the smaller one.
    """
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    limit = np.minimum(limits, my_limit)
    within = flat <= np.repeat(limit, sizes)
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    starts = np.cumsum(sizes) - sizes
    both = np.add.reduceat((mine[at] == flat) & within, starts, dtype=np.int64)
    union = np.add.reduceat(within, starts, dtype=np.int64) + np.searchsorted(mine, limit, "right") - both
    union = np.maximum(union, 1)
    # One element of room: two elements of a set may share their upper half.
    return (both + 1) / union, np.where(limit == _NO_LIMIT, 0, np.sqrt(0.25 / union))


_NO_LIMIT = 2**32 - 1


def _children(similarity: float, trees: int | None):
    """Classes to the nodes they choose: at the roots of all trees, or below the node that each row names."""
    limit = np.uint64(int(2.0 ** 64 / (similarity * COORDINATES)))
    roots = None if trees is None else _mixed(np.arange(1, trees + 1).astype(np.uint64))
    coordinate = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BRANCHED) for b in batches for at in range(0, b.num_rows, BRANCHED)):
            values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            base = _mixed(values.astype(np.uint64) | coordinate)
            digests, nodes, rows = batch.column("digest"), [], []
            parents = [batch.column("node").to_numpy().view(np.uint64)[:, None]] if roots is None else roots
            for parent in parents:
                key = _mixed(base + parent)
                row, at = np.nonzero(key < limit)
                nodes.append(key[row, at])
                rows.append(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(nodes).view(np.int64)), digests.take(pa.array(np.concatenate(rows)))], names=["node", "digest"])
    return branch


def _agreeing(least: float):
    """Pairs whose short sketches agree often enough."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("su", "sv"))
            yield batch.filter(pa.array((a == b).sum(axis=1) >= least)).select(["u", "v"])
    return keep


def _partners(labels: list, short: list[bytes], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of each member of a node those of other labels whose short sketches agree often enough, if any."""
    label = np.unique(np.array(labels, object), return_inverse=True)[1]
    held = np.frombuffer(b"".join(short), np.uint8).reshape(-1, COORDINATES)
    step = max(1, AGREED_BYTES // held.size)
    for at in range(0, len(held), step):
        agree = np.bitwise_count(np.packbits(held[at:at + step, None] == held, axis=2)).sum(axis=2, dtype=np.int64)
        fits = (agree >= least) & (label[at:at + step, None] != label)
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            yield at + i, np.flatnonzero(fits[i])


def _nodes(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[list]]]:
    """Nodes of several members (rows sorted by node), as lists by column."""
    node, held = None, [[] for _ in columns]
    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("node", *columns)), strict=True):
            if key != node:
                if len(held[0]) > 1:
                    yield node, held
                node, held = key, [[] for _ in columns]
            for part, value in zip(held, row, strict=True):
                part.append(value)
    if len(held[0]) > 1:
        yield node, held


def _meeting(least: float):
    """Members that agree with one of another label in their node (rows sorted by node), by sketches alone."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, (digests, labels, short) in _nodes(batches, ("digest", "label", "short")):
            kept = [i for i, _ in _partners(labels, short, least)]
            if kept:
                yield pa.RecordBatch.from_arrays([
                    pa.array([node] * len(kept), pa.int64()), pa.array([digests[i] for i in kept], pa.binary()),
                    pa.array([labels[i] for i in kept], pa.binary())], names=["node", "digest", "label"])
    return meet


def _compared(least: float, share: float, all_pairs: bool):
    """Proposed pairs of different labels within nodes (rows sorted by node): sketches first, then profiles."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, (digests, labels, short, packed, sizes) in _nodes(batches, ("digest", "label", "short", "profile", "n")):
            profiles = [np.frombuffer(p, np.uint32) for p in packed]
            limits = np.array([int(p[-1]) if n > PROFILE else _NO_LIMIT for p, n in zip(profiles, sizes, strict=True)])
            found = set()
            for i, others in _partners(labels, short, least):
                if all_pairs:  # each pair once; for its best one a class looks at all others
                    others = others[others > i]
                    if not len(others):
                        continue
                near, deviation = similarity(profiles[i], limits[i], [profiles[j] for j in others.tolist()], limits[others])
                fits = near >= share - DEVIATIONS * deviation
                others, near = others[fits], near[fits]
                if not all_pairs:
                    others = others[np.argsort(-near, kind="stable")[:1]]
                found.update((min(digests[i], digests[j]), max(digests[i], digests[j])) for j in others.tolist())
            if found:
                yield pa.RecordBatch.from_arrays([
                    pa.array([node] * len(found), pa.int64()), *(pa.array([p[k] for p in found], pa.binary()) for k in (0, 1))], names=["node", "u", "v"])
    return compare


class _Join:
    """The state of one join: classes, full sets read so far, and components of the links found so far."""

    def __init__(self, texts: DataFrame, classes: DataFrame, width: int, percent: int) -> None:
        self.texts, self.classes, self.width, self.percent = texts, classes, width, percent
        self.short = classes.select("digest", "short")
        share = percent / 100
        self.least = COORDINATES * share - DEVIATIONS * math.sqrt(COORDINATES * share * (1 - share))
        self.sets: DataFrame | None = None
        self.labels: DataFrame | None = None

    def _read_sets(self, pairs: DataFrame) -> None:
        needed = pairs.select(F.col("u").alias("digest")).union(pairs.select("v")).distinct()
        if self.sets is not None:
            needed = needed.join(self.sets.select("digest"), "digest", "left_anti")
        needed = written(needed.join(self.classes.select("digest", "class_id"), "digest"), "path-needed")
        if self.sets is not None and needed.isEmpty():
            return
        # An id may stand at several texts; what counts is the digest.
        texts = self.texts.join(needed.select(F.col("class_id").alias("of")), F.col("id") == F.col("of"), "left_semi").select("text")
        found = texts.mapInArrow(frugal(_full_sets(self.width)), "digest binary, tokens array<long>")
        found = written(found.join(needed.select("digest"), "digest", "left_semi"), "path-sets")
        self.sets = found if self.sets is None else self.sets.union(found)

    def verify(self, pairs: DataFrame, name: str) -> None:
        """Adds the pairs (u, v) that link; labels follow."""
        pairs = written(pairs.distinct(), name)
        if pairs.isEmpty():
            return
        self._read_sets(pairs)
        sets = self.sets
        both = F.size(F.array_intersect("a", "b"))
        held = pairs.join(sets.select(F.col("digest").alias("u"), F.col("tokens").alias("a")), "u").join(
            sets.select(F.col("digest").alias("v"), F.col("tokens").alias("b")), "v")
        new = held.where(100 * both >= self.percent * (F.size("a") + F.size("b") - both)).select("u", "v")
        # What is known already is as good as a star.
        links = new.distinct() if self.labels is None else new.distinct().union(self.labels)
        self.labels = written(components(links).select(F.col("node").alias("digest"), F.col("component").alias("label")), "path-labels")

    def labelled(self, members: DataFrame) -> DataFrame:
        if self.labels is None:
            return members.withColumn("label", F.col("digest"))
        return members.join(self.labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))

    def mixed(self, members: DataFrame, name: str) -> DataFrame:
        """Members of nodes with several components."""
        named = self.labelled(members.drop("label"))
        several = named.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("node")
        return written(named.join(several, "node"), name)

    def stars(self, members: DataFrame) -> None:
        """Each member and its node's leader."""
        pairs = members.where(F.col("digest") != F.col("leader")).select(F.col("digest").alias("u"), F.col("leader").alias("v")).distinct()
        with_sketches = pairs.join(self.short.select(F.col("digest").alias("u"), F.col("short").alias("su")), "u").join(
            self.short.select(F.col("digest").alias("v"), F.col("short").alias("sv")), "v")
        self.verify(with_sketches.mapInArrow(frugal(_agreeing(self.least)), "u binary, v binary"), "path-stars")

    def exhaust(self, members: DataFrame) -> None:
        """All pairs of different components within the nodes; before that each class's best pair, twice, so that few are left.

        Components only grow, so who has no partner left in a node never gets one there again: sketches leave out most members before
        any profile is read, and a turn goes on with the members of the pairs that the turn before it proposed.
        """
        members = self.mixed(members.select("node", "digest"), "path-mixed")
        if members.isEmpty():
            return
        dealt = members.join(self.short, "digest").select("node", "digest", "label", "short").repartition("node").sortWithinPartitions("node")
        members = written(dealt.mapInArrow(frugal(_meeting(self.least)), "node long, digest binary, label binary"), "path-meeting")
        if members.isEmpty():
            return
        ids = written(self.classes.join(members.select("digest").distinct(), "digest", "left_semi").select(F.col("class_id").alias("of")), "path-met")
        texts = self.texts.join(ids, F.col("id") == F.col("of"), "left_semi").select("text")
        profiles = written(texts.mapInArrow(frugal(_profiles(self.width)), "digest binary, profile binary, n long").groupBy("digest").agg(
            F.first("profile").alias("profile"), F.first("n").alias("n")), "path-profiles")
        for turn, all_pairs in enumerate((False, False, True)):
            if turn:
                members = self.mixed(members, "path-mixed")
                if members.isEmpty():
                    return
            dealt = members.join(self.short, "digest").join(profiles, "digest").select("node", "digest", "label", "short", "profile", "n").repartition("node").sortWithinPartitions("node")
            found = written(dealt.mapInArrow(frugal(_compared(self.least, self.percent / 100, all_pairs)), "node long, u binary, v binary"), "path-found")
            self.verify(found.select("u", "v"), "path-pairs")
            members = found.select("node", F.explode(F.array("u", "v")).alias("digest")).distinct()


def _in_blocks(members: DataFrame, small: int) -> DataFrame:
    """Members of large nodes, dealt into blocks, in a node for every pair of blocks."""
    blocks = F.ceil(F.col("held") / (small // 2)).cast("int")
    mine = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    return members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "digest")


def near_duplicates(
    docs: DataFrame, width: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL,
    levels: int = MOST_LEVELS,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, class_id.

    Words are ASCII-lower-cased runs of non-blanks; a text with fewer words than ``width`` is one shingle; an empty, blank or null text has
    none, links with nothing and is kept. ``component_id`` is the smallest id reachable by links, ``class_id`` the smallest id with the same
    set; ``kept`` says that a row's id is that of its component. Repeated rows are copies of each other (each is kept where their id is). A null id
    takes the component of equal sets that have an id, else null, and then is kept. An empty table gives no rows. Other columns are ignored. A link
    is found with the trees' recall and is never wrong: it is confirmed on full sets.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = written(texts.mapInArrow(frugal(_sketches(width)), f"id {kind}, n long, digest binary, sketch binary, short binary"), "path-sketches")
    classes = written(rows.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("class_id"), F.first("sketch").alias("sketch"), F.first("short").alias("short")), "path-classes")
    state = _Join(texts, classes, width, percent)
    linkable = classes.where("class_id is not null")
    trees = trees_for(TARGET_RECALL, TARGET_LEVELS)
    nodes = linkable.select("digest", "sketch").mapInArrow(frugal(_children(percent / 100, trees)), "node long, digest binary")
    held_in = []  # nodes that are small enough, of all levels
    for level in range(levels + 1):
        nodes = written(nodes, "path-nodes")
        met = nodes.groupBy("node").agg(F.count("*").alias("held"), F.min("digest").alias("leader")).where("held > 1")
        members = nodes.join(met, "node")
        if not level:
            members = written(members, "path-members")
            state.stars(members)
            members = members.where("held > 2")
        several = state.mixed(members, "path-several")
        held_in.append(several.where(F.col("held") <= small).select("node", "digest"))
        large = several.where(F.col("held") > small)
        if large.isEmpty():
            break
        if level == levels:
            held_in.append(_in_blocks(large, small))
            break
        nodes = large.select("node", "digest").join(classes.select("digest", "sketch"), "digest").mapInArrow(
            frugal(_children(percent / 100, None)), "node long, digest binary")
    state.exhaust(reduce(DataFrame.union, held_in))
    named = state.labelled(classes.select("digest", "class_id"))
    least = named.groupBy("label").agg(F.min("class_id").alias("component"))
    known = named.join(least, "label").select(F.col("digest").alias("of"), "class_id", "component")
    out = rows.join(known, F.col("digest") == F.col("of"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"))
    return out.select(id_col, "n_shingles", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "class_id")
