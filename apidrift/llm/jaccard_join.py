"""Size-aware heavy-light join of word-shingle sets by Jaccard similarity.

Two sets link when their intersection is at least ``percent`` % of their union. The join is exact:

1. Texts become sets of 64-bit shingle hashes; equal sets are one class from here on (a group of copies of any
   size is one row). Collisions matter only within one compared pair, about 1e-12 each.
2. Light sets, up to a boundary size, enumerate fixed-size subsets: sizes s and t need c(s, t) common elements, so sets
   that share a c-subset link without further test. Beyond the boundary subsets outnumber the postings a set
   would read; the boundary minimises the summed cost over the measured size histogram.
3. Heavy sets go through inverted lists. First, each set looks up how many of its smallest hashes occur in another
   set at all; a set with fewer than any partner would need is done. For the rest full sets are read,
   elements are counted exactly and ordered rarest first, and lists are kept for the prefix a partner must hit. Larger
   sets probe, smaller ones are found in their shorter indexing prefix.
4. A list does not emit all its pairs. Each set is verified against the list's leader (the set with the
   fewest elements of its own). Verified links make components, and sets of one component need no test among themselves. Then the
   sets of a list's smaller components meet one set of its largest, ``MEETINGS`` times. Pairs across components that are left then
   are all verified. Sizes and positions prune pairs that cannot reach the threshold.

Element counts come from blocks: a block (at most ``BLOCK_BYTES`` of text) sends each distinct element once, and gets its count
back, so an element of half the corpus costs one number per block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.llm.bpe import _pack, _unpack
from apidrift.llm.components import components
from apidrift.llm.tables import frugal, frugal_groups, slices, small_batches, whole, written, written_by

#: Sets of up to this size carry their elements along and may be light.
LIGHT_MOST = 24
#: Bits of an element in the first look-up; a collision there only keeps a set that could have been dropped.
SHORT_BITS = 48
#: Bytes of text for each bucket of elements, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
#: Bytes of text of a block.
BLOCK_BYTES = 4 << 20
#: How often the smaller components of a list meet a set of its largest.
MEETINGS = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, width: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; ``words`` keeps word hashes between calls."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(width, len(found))
    at = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        at = _mixed(at + hashes[i:len(found) - width + 1 + i])
    return np.unique(at)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Threshold:
    """Integer arithmetic of the link condition."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def common(self, s: int, t: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def least(self, n: int) -> int:
        """Least size of a partner, and least intersection with any."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def subsets(self, s: int, light: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, subset size) of the light partners of a set of s elements."""
        sizes = range(self.least(s), min(light, 100 * s // self.percent) + 1)
        return [(min(s, t), max(s, t), c) for t in sizes if (c := self.common(s, t)) <= min(s, t) and c < max(s, t)]

    def boundary(self, histogram: dict[int, int]) -> int:
        """Largest light size at least total cost: subset keys below, looked-up elements and prefix lists above."""
        def gain(s: int) -> int:
            keys = sum(math.comb(s, c) for *_, c in self.subsets(s, LIGHT_MOST))
            return histogram.get(s, 0) * (keys - s - 2 * self.prefix(s))

        best, total, at = 0, 0, 0
        for s in range(1, LIGHT_MOST + 1):
            total += gain(s)
            if total < best:
                best, at = total, s
        return at


def _blocks(width: int, choose: Callable[[np.ndarray], np.ndarray], buckets: int, bits: int, inline: int) -> Callable:
    """Texts to (a) packed rows of sets as element codes of the block, (b) elements per bucket."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch, "text", BLOCK_BYTES)):
            block, words = uuid.uuid4().hex, _Words()
            sets = [shingle_set(text, width, words) for text in batch.column("text").to_pylist()]
            del words
            chosen = [choose(s) for s in sets]
            sizes = list(map(len, chosen))
            short = (np.concatenate(chosen) if sets else np.zeros(0, np.uint64)) >> np.uint64(64 - bits)
            elements, first, codes = np.unique(short, return_index=True, return_inverse=True)
            # Codes by first appearance: elements of one set only are numbered in a row.
            order = np.empty(len(elements), np.int64)
            order[np.argsort(first)] = np.arange(len(elements))
            steps = np.diff(order[codes], prepend=0)
            ids = batch.column("id")
            carried = [s if len(s) <= inline else s[:0] for s in sets]
            ends = np.cumsum([0, *map(len, carried)]).astype(np.int32)
            small = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.uint64), *carried]).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array([0], pa.int32()), pa.array([block]), pa.array([-1], pa.int32()),
                pa.ListArray.from_arrays([0, len(ids)], ids),
                pa.array([list(map(len, sets))], pa.list_(pa.int32())),
                pa.array([[xxhash.xxh3_128_digest(s.tobytes()) for s in sets]], pa.list_(pa.binary())),
                pa.ListArray.from_arrays([0, len(ids)], small),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([_pack(((steps << 1) ^ (steps >> 63)).astype(np.uint32))]), pa.array([b""]),
            ], names=_BLOCK_NAMES)
            # Sorted elements fall into ranges of the hash space, one for each bucket.
            edges = np.searchsorted(elements, [((i << bits) // buckets) for i in range(buckets + 1)])
            edges[-1] = len(elements)
            for bucket, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if a < b:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([1], pa.int32()), pa.array([block]), pa.array([bucket], pa.int32()),
                        pa.array([[]], pa.list_(ids.type)), pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.binary())),
                        pa.array([[]], pa.list_(pa.list_(pa.int64()))), pa.array([[]], pa.list_(pa.int32())),
                        pa.array([_pack(order[a:b])]), pa.array([_pack_long(elements[a:b], np.bincount(codes, minlength=len(elements))[a:b])]),
                    ], names=_BLOCK_NAMES)
    return cut


_BLOCK_NAMES = ["kind", "block", "bucket", "ids", "sizes", "digests", "small", "chosen", "codes", "elements"]
_BLOCK_SCHEMA = (
    "kind int, block string, bucket int, ids array<{kind}>, sizes array<int>, digests array<binary>, "
    "small array<array<long>>, chosen array<int>, codes binary, elements binary")


def _pack_long(elements: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as steps in two halves, and their counts."""
    steps = np.diff(elements, prepend=np.uint64(0))
    parts = [_pack((steps >> np.uint64(32)).astype(np.uint32)), _pack(steps.astype(np.uint32)), _pack(counts.astype(np.uint32))]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack_long(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], 0
    for _ in range(3):
        size = int.from_bytes(blob[at:at + 4], "little")
        parts.append(_unpack(blob[at + 4:at + 4 + size]))
        at += 4 + size
    return np.cumsum((parts[0].astype(np.uint64) << np.uint64(32)) | parts[1]), parts[2]


def _count(part: pa.Table) -> pa.Table:
    """Sets that hold each element, over all blocks, as asked by each (block, bucket)."""
    asked = [_unpack_long(blob) for blob in part.column("elements").to_pylist()]
    elements = np.concatenate([e for e, _ in asked])
    distinct, place = np.unique(elements, return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([c for _, c in asked]))
    ends = np.cumsum([len(e) for e, _ in asked])
    answers = [_pack(np.minimum(total[place[a:b]], 2**32 - 1).astype(np.uint32)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.table({"block": part.column("block"), "codes": part.column("codes"), "counts": pa.array(answers, pa.binary())})


def _counted(blocks: DataFrame, decide: Callable, schema: str) -> DataFrame:
    """Each set with the counts of its chosen elements, judged by ``decide`` within its block."""
    counts = blocks.where("kind = 1").select("block", "bucket", "codes", "elements").groupBy("bucket").applyInArrow(
        frugal_groups(_count), "block string, codes binary, counts binary")
    held = blocks.where("kind = 0").select("block", "ids", "sizes", "chosen", "codes", "small")

    def place(_: tuple, sets: pa.Table, answers: pa.Table) -> pa.Table:
        codes = [_unpack(b) for b in answers.column("codes").to_pylist()]
        of = np.zeros(sum(map(len, codes)), np.uint32)
        for at, counts in zip(codes, map(_unpack, answers.column("counts").to_pylist()), strict=True):
            of[at] = counts
        found = []
        for i in range(sets.num_rows):
            row = {name: sets.column(name)[i] for name in ("ids", "sizes", "chosen", "codes", "small")}
            steps = _unpack(row["codes"].as_py()).astype(np.int64)
            counted, at = of[np.cumsum((steps >> 1) ^ -(steps & 1))], 0
            small = row["small"].values
            ends = small.offsets.to_numpy()
            carried = small.values.to_numpy()
            for j, (key, n, k) in enumerate(zip(row["ids"].as_py(), row["sizes"].as_py(), row["chosen"].as_py(), strict=True)):
                found.append((key, n, counted[at:at + k], carried[ends[j]:ends[j + 1]]))
                at += k
        return decide(found, sets.schema.field("ids").type.value_type)

    return held.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(frugal_groups(place), schema)


def _light_links(sets: DataFrame, light: int, rule: Threshold) -> DataFrame:
    """Stars over the sets that share a c-subset: every key's sets of the two sizes link."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, small in zip(batch.column("id").to_pylist(), batch.column("small").to_pylist(), strict=True):
                for s, t, c in rule.subsets(len(small), light):
                    for subset in combinations(small, c):
                        at = xxhash.xxh3_128_digest(np.array([s, t, *subset], np.int64).tobytes())
                        out.append((at, key, len(small) == s, len(small) == t))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], batch.schema.field("id").type),
                pa.array([r[2] for r in out], pa.bool_()), pa.array([r[3] for r in out], pa.bool_()),
            ], names=["key", "id", "is_s", "is_t"])

    kind = dict(sets.dtypes)["id"]
    found = sets.where((F.col("n") > 0) & (F.col("n") <= light)).select("id", "small").mapInArrow(
        frugal(keys), f"key binary, id {kind}, is_s boolean, is_t boolean")
    first = found.groupBy("key").agg(
        F.min(F.when(F.col("is_s"), F.col("id"))).alias("s"), F.min(F.when(F.col("is_t"), F.col("id"))).alias("t"),
        F.count("*").alias("held")).where("held > 1 and s is not null and t is not null").withColumnRenamed("key", "of")
    # Each s links to the first t, each t to the first s.
    return found.join(first, F.col("key") == F.col("of")).select(F.explode(F.array(
        F.struct(F.col("id").alias("u"), F.when(F.col("is_s"), F.col("t")).alias("v")),
        F.struct(F.col("id").alias("u"), F.when(F.col("is_t"), F.col("s")).alias("v")),
    )).alias("x")).select("x.u", "x.v").where("v is not null and u <> v").distinct()


def _may_link(na: Column, nb: Column, pa_: Column, pb: Column, percent: int) -> Column:
    """Sizes fit, and so do the elements from a common one at these positions on (if it is the first)."""
    most = 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sets link."""
    left = sets.select(F.col("id").alias("u"), F.col("tokens").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(
        100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def _heavy_links(sets: DataFrame, percent: int) -> DataFrame:
    """Verified links between sets (id, n, rare, tokens rarest first).

    Lists hold elements of two sets or more within a set's probing prefix. Of a pair the smaller set has its first common
    element in its shorter indexing prefix (where two sets of its size would have it), the larger set looks it up.
    """
    prefix = F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 as int)")
    indexed = F.expr(f"n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1")
    lists = written(sets.select("id", "n", "rare", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("pos", "token")).where(
        "pos >= rare").withColumn("indexed", F.col("pos") < indexed), "prefix-lists")
    leaders = lists.where("indexed").groupBy("token").agg(F.min(F.struct("rare", "id", "n", "pos")).alias("lead")).select(
        F.col("token").alias("of"), F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.pos").alias("lead_pos"))
    stars = lists.join(leaders, F.col("token") == F.col("of")).where(
        (F.col("id") != F.col("lead")) & _may_link(F.col("n"), F.col("lead_n"), F.col("pos"), F.col("lead_pos"), percent),
    ).select(F.col("id").alias("u"), F.col("lead").alias("v")).distinct()
    labels = written(components(_verified(stars, sets, percent)), "star-labels")
    for turn in range(MEETINGS):
        labels = written(components(_as_links(labels).union(_meetings(lists, labels, sets, percent, turn))), "met-labels")
    named = _named(lists, labels)
    mixed = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(
        F.col("token").alias("of"))
    # The largest partner that the elements from this position on leave possible.
    reach = F.expr(f"({100 + percent} * (n - pos)) div {percent} - n")
    named = written(named.join(mixed, F.col("token") == F.col("of")).drop("of").withColumn("reach", reach), "mixed-lists")
    probes = named.groupBy("token", F.col("label").alias("lp")).agg(F.max("n").alias("most"), F.max("reach").alias("reach"))
    held = named.where("indexed").groupBy("token", F.col("label").alias("li")).agg(F.min("n").alias("least"))
    apart = probes.join(held, "token").where("lp <> li and most >= least and reach >= least").select("token", "lp", "li")
    ones = named.select("token", F.col("label").alias("lp"), F.col("id").alias("u"), F.col("n").alias("un"), F.col("pos").alias("up"))
    others = named.where("indexed").select(
        "token", F.col("label").alias("li"), F.col("id").alias("v"), F.col("n").alias("vn"), F.col("pos").alias("vp"))
    pairs = apart.join(ones, ["token", "lp"]).join(others, ["token", "li"]).where(
        (F.col("un") >= F.col("vn")) & _may_link(F.col("un"), F.col("vn"), F.col("up"), F.col("vp"), percent),
    ).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return _as_links(labels).union(_verified(pairs, sets, percent))


def _as_links(labels: DataFrame) -> DataFrame:
    """Each set's link to the smallest of its component: as good as the links that made it."""
    return labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def _named(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists with the component of each set."""
    label = labels.select(F.col("node").alias("labelled"), F.col("component").alias("label"))
    return lists.join(label, F.col("id") == F.col("labelled"), "left").select(
        "token", "id", "n", "pos", "indexed", F.coalesce("label", "id").alias("label"))


def _meetings(lists: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Verified links between the sets of a list's smaller components and one set of its largest, another one every turn.

    A set meets as many members of a large family as it has lists, so few sets of a family are left outside.
    """
    named = written(_named(lists, labels), "named-lists")
    held = named.groupBy("token", "label").agg(
        F.count("*").alias("held"), F.min_by(F.struct("id", "n"), F.xxhash64(F.lit(turn), "token", "id")).alias("one"))
    largest = held.groupBy("token").agg(F.max(F.struct("held", "label", "one")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select(
        F.col("token").alias("of"), F.col("top.label").alias("most"), F.col("top.one.id").alias("v"), F.col("top.one.n").alias("vn"))
    fits = 100 * F.least("n", "vn") >= percent * F.greatest("n", "vn")
    pairs = named.join(largest, F.col("token") == F.col("of")).where((F.col("label") != F.col("most")) & fits).select(
        F.col("id").alias("u"), "v").distinct()
    return _verified(pairs, sets, percent)


def link_groups(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, class_id.

    Words are ASCII-lower-cased runs of non-blanks; a text with fewer words than ``width`` is one shingle; an empty, blank
    or null text has none and links with nothing, not even another such text. ``component_id`` is the smallest id
    reachable by links, ``class_id`` the smallest id with the same set (the row's own for an empty set). Repeated
    rows are copies of each other; an id must not name two texts. A null id is never linked by its own and takes the component
    of equal sets that have an id, else null. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rule = Threshold(percent)
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    block_schema = _BLOCK_SCHEMA.format(kind=kind)

    # Twice the prefix: a partner shares at least as many elements there as its own prefix is long.
    def head(s: np.ndarray) -> np.ndarray:
        return s[:2 * rule.prefix(len(s)) - 1]

    blocks = written_by(texts.mapInArrow(frugal(_blocks(width, head, buckets, SHORT_BITS, LIGHT_MOST)), block_schema), "shingle-heads", "block", size)
    rows = blocks.where("kind = 0").select(F.explode(F.arrays_zip("ids", "sizes", "digests", "small")).alias("x")).select(
        F.col("x.ids").alias("id"), F.col("x.sizes").alias("n"), F.col("x.digests").alias("digest"), F.col("x.small").alias("small"))
    classes = written(rows.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("class_id"), F.first("n").alias("n"), F.first("small").alias("small"), F.count("*").alias("copies"),
    ), "shingle-classes")
    histogram = {r["n"]: r["k"] for r in classes.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("k")).collect()}
    light = rule.boundary(histogram)
    light_links = _light_links(classes.select(F.col("class_id").alias("id"), "n", "small"), light, rule)
    heavy_least = rule.least(light + 1)

    def shared(found: list, id_type: pa.DataType) -> pa.Table:
        keep = [key for key, n, counts, _ in found if n >= heavy_least and int((counts > 1).sum()) >= rule.prefix(rule.least(n))]
        return pa.table({"linkable": pa.array(keep, id_type)})

    linkable = _counted(blocks, shared, f"linkable {kind}")
    heavy = written(classes.join(linkable, F.col("class_id") == F.col("linkable"), "left_semi").select(
        F.col("class_id").alias("heavy_id")), "heavy-sets")
    full = texts.join(heavy, F.col("id") == F.col("heavy_id"), "left_semi")
    full_blocks = written_by(full.mapInArrow(frugal(_blocks(width, lambda s: s, buckets, 64, 2**31)), block_schema), "shingle-sets", "block", size)

    def ordered(found: list, id_type: pa.DataType) -> pa.Table:
        """Sets with enough shared elements, rarest element first."""
        keep = [x for x in found if int((x[2] > 1).sum()) >= rule.least(x[1])]
        tokens = [t[np.lexsort((t, counts))] for *_, counts, t in keep]
        ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
        return pa.table({
            "id": pa.array([x[0] for x in keep], id_type), "n": pa.array([x[1] for x in keep], pa.int32()),
            "rare": pa.array([int((x[2] == 1).sum()) for x in keep], pa.int32()),
            "tokens": pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *tokens])),
        })

    sets = written(_counted(full_blocks, ordered, f"id {kind}, n int, rare int, tokens array<long>"), "ordered-sets")
    links = written(light_links.unionByName(_heavy_links(sets, percent)), "jaccard-links")
    found = components(links).withColumnRenamed("node", "member")
    named = classes.join(found, F.col("class_id") == F.col("member"), "left").select(
        F.col("digest").alias("of"), "class_id", F.coalesce("component", "class_id").alias("component"))
    return rows.join(named, (F.col("digest") == F.col("of")) & (F.col("n") > 0), "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"))
