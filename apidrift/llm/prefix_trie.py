"""Prefix trie of conversations from sorted, padded matrices of turn ids.

1. A turn becomes a 128-bit id of its role and text, and a count of words; texts move no further. A conversation
   is an array of ids, rebuilt from its own turns and the head of the first conversation of its family.
2. Conversations are dealt into range shards by (ids, conv_id): equal ones stay together or lie in neighbouring
   shards, and a conversation with a third of all copies is spread over many. Within a shard numpy's lexsort orders
   padded matrices, in blocks of ``BLOCK_COLUMNS`` columns that hold only rows long enough to reach them, so one
   long conversation pads nobody else.
3. Change masks between neighbouring rows, OR-accumulated over the columns, say from which depth on a row starts
   nodes of its own. From the deepest level up, reduceat sums each node's rows.
4. Only nodes on the path of a shard's first or last row can continue in another shard. They leave as partial sums keyed by a
   digest of their prefix and recombine by grouped aggregation. Sums over subtrees need no pairs of ancestors: every node
   is owned by one path, and the suffix sums of a path's own nodes, added up over the paths through a node, give the total.
5. The list of members that end at a node is hashed in the shard, or, for boundary nodes, as a stream over the shards' pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm.tables import whole, written

#: Conversations of one family share the first one's head: family size, and heads are shorter than this.
FAMILY, HEADS = 20, 4
#: Turns of a range shard (about 40 bytes each while it is worked on).
SHARD_TURNS = 1 << 17
#: Columns of a padded matrix.
BLOCK_COLUMNS = 16
#: Characters of a piece of an unfinished member list.
PIECE = 1 << 22

_WORD = r"[^\x20\x09-\x0D]+"
_TURN = "struct<hi:long,lo:long,words:long>"


def turns(talks: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's turn ids and word counts, in order (null turn numbers first, equal ones by id)."""
    role, text = whole("role"), whole("text")
    one = F.struct(
        F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("hi"), F.xxhash64(text, role, F.lit(1)).alias("lo"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    # Structs sort field by field, nulls first.
    return talks.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one")).where("conv_id is not null").groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("one")), lambda x: F.struct(x["hi"], x["lo"], x["words"])).alias("turns"))


def rebuilt(talks: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of the family's first conversation, then the own turns after the first h."""
    own = turns(talks).withColumn("first", F.expr(f"conv_id - conv_id % {FAMILY}")).withColumn(
        "h", F.expr(f"cast(crc32(cast(conv_id as string)) % {HEADS} as int)"))
    heads = turns(talks).where(F.expr(f"conv_id % {FAMILY} = 0")).select(
        F.col("conv_id").alias("of"), F.slice("turns", 1, HEADS - 1).alias("head"))
    joined = own.join(heads, F.col("first") == F.col("of"), "left")
    empty = F.array().cast(f"array<{_TURN}>")
    head = F.coalesce(F.expr("slice(head, 1, h)"), empty)
    tail = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def _ordered(ids: np.ndarray, start: np.ndarray, size: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (ids, last), and how many leading ids each ordered row shares with the one before it (-1 for the first).

    Row r holds ``ids[start[r]:start[r] + size[r]]`` (two columns hi, lo). Blocks are ranked from the last to the
    first; a row's rank in later blocks is a key of the block before.
    """
    rows, most = len(size), int(size.max(initial=0))
    ids = np.concatenate([ids, np.zeros((1, 2), ids.dtype)])  # a place to look at where there are no turns at all
    blocks = max(1, -(-most // BLOCK_COLUMNS))
    by_size = np.argsort(-size, kind="stable")
    reach = -size[by_size]
    tail = np.zeros(rows, np.int64)
    order = np.arange(rows)

    def matrix(at: np.ndarray, column: int) -> np.ndarray:
        """Padded ids of the rows from a column on (hi, lo, inside): padding cannot be mistaken for an id."""
        place = np.arange(column, min(column + BLOCK_COLUMNS, max(most, column + 1)))
        inside = place < size[at, None]
        where = np.where(inside, start[at, None] + place, 0)
        return np.concatenate([np.where(inside, ids[where, 0], 0), np.where(inside, ids[where, 1], 0), inside.astype(np.int64)])\
            .reshape(3, len(at), len(place))

    for block in range(blocks - 1, -1, -1):
        column = block * BLOCK_COLUMNS
        at = by_size[:np.searchsorted(reach, -column, "left")] if block else np.arange(rows)
        hi, lo, inside = matrix(at, column)
        keys = [tail[at]] if block else [last[at], tail[at]]
        for j in range(hi.shape[1] - 1, -1, -1):
            keys += [lo[:, j], hi[:, j], inside[:, j]]
        by = np.lexsort(keys)
        if not block:
            order = by
            break
        changed = np.zeros(len(at), bool)
        changed[1:] = (np.diff(tail[at][by]) != 0)
        for part in (hi, lo, inside):
            changed[1:] |= (part[by][1:] != part[by][:-1]).any(axis=1)
        tail = np.zeros(rows, np.int64)
        tail[at[by]] = 1 + np.cumsum(changed)
    shared = np.zeros(rows, np.int64)
    same = np.arange(1, rows)  # rows that agree with the one before so far
    for block in range(blocks):
        if not len(same):
            break
        column = block * BLOCK_COLUMNS
        here, before = matrix(order[same], column), matrix(order[same - 1], column)
        change = np.logical_or.accumulate((here != before).any(axis=0) | ~here[2].astype(bool), axis=1)
        shared[same] += (~change).sum(axis=1)
        same = same[~change[:, -1]]
    if rows:
        shared[0] = -1
    return order, shared


def _ends(numbers: np.ndarray) -> str:
    return ",".join(map(str, numbers.tolist()))


_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = (
    "kind int, shard int, side int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, ends string, piece int")
_NAMES = [part.split()[0] for part in _NODE.split(", ")]
_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t])
                    for n, t in (part.split() for part in _NODE.split(", "))])
#: Kinds of rows that leave a shard: whole nodes, nodes of the first (side 0) or last (side 1) path, pieces of their member lists.
WHOLE, PATH, PIECES = 0, 1, 2


def _batch(**columns: object) -> pa.RecordBatch:
    rows = len(next(c for c in columns.values() if not np.isscalar(c) and c is not None))
    full = []
    for field in _ARROW:
        value = columns.get(field.name)
        if value is None or np.isscalar(value):
            full.append(pa.array([value] * rows if value is None else np.full(rows, value), field.type))
        else:
            full.append(pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(full, schema=_ARROW)


def shard_nodes(shard: int, convs: np.ndarray, size: np.ndarray, ids: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All nodes of one shard's conversations; those on the first or last path are partial."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    order, shared = _ordered(ids, start, size, convs)
    convs, size, start = convs[order], size[order], start[order]
    rows, most = len(size), int(size.max())
    leaves, saved = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    # For nodes one level deeper: their first rows; and which are not whole.
    deeper = np.zeros(0, np.int64)
    ends_first, ends_last = int(size[0]), int(size[-1])
    common = int(shared[1:].min(initial=ends_first)) if rows > 1 else ends_first
    common = min(common, ends_first, ends_last)
    sides = [{}, {}]
    pieces: list[tuple[int, int, np.ndarray]] = []
    # Rows by length, so that each depth takes the rows that reach it without looking at the others.
    longest = np.argsort(-size, kind="stable")
    reach = -size[longest]
    for depth in range(most, -1, -1):
        alive = np.sort(longest[:np.searchsorted(reach, -depth, "right")])
        first = alive[shared[alive] < depth]
        at = np.searchsorted(alive, first)
        n = np.diff(np.append(at, len(alive)))
        least = np.minimum.reduceat(convs[alive], at)
        owner = np.searchsorted(first, deeper, "right") - 1
        children = np.bincount(owner, minlength=len(first)) if len(deeper) else np.zeros(len(first), np.int64)
        partial_first, partial_last = depth <= ends_first, depth <= ends_last
        spread = np.zeros(len(first), bool)
        spread[0] |= partial_first
        spread[-1] |= partial_last
        word = words[start[first] + depth - 1] if depth else np.zeros(len(first), np.int64)
        under_leaves, under_saved = np.add.reduceat(leaves[alive], at), np.add.reduceat(saved[alive], at)
        # What a whole node adds itself; a partial one cannot know yet.
        own_leaf = np.where(spread, 0, children == 0)
        own_saved = np.where(spread, 0, (n - 1) * word)
        total_leaves, total_saved = under_leaves + own_leaf, under_saved + own_saved
        ending = size[alive] == depth
        end_at = np.concatenate([[0], np.cumsum(ending)])
        ended = convs[alive[ending]]
        bounds = np.append(at, len(alive))
        ends = [(end_at[a], end_at[b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(spread).tolist():
            # Children that are partial themselves are counted where paths meet.
            open_below = len({j for j, reaches in ((0, depth < ends_first), (len(deeper) - 1, depth < ends_last))
                              if reaches and len(deeper) and owner[j] == i})
            row = (int(least[i]), int(n[i]), int(children[i]) - open_below, int(under_leaves[i]), int(under_saved[i]), int(word[i]))
            on_first = i == 0 and partial_first
            if on_first:
                sides[0][depth] = row
            else:
                sides[1][depth] = row
            pieces.append((0 if on_first else 1, depth, np.sort(ended[ends[i][0]:ends[i][1]])))
        # A node above takes over what lies below it; partial ones are added where paths meet.
        leaves[alive] = 0
        saved[alive] = 0
        leaves[first] = np.where(spread, 0, total_leaves)
        saved[first] = np.where(spread, 0, total_saved)
        inner = np.flatnonzero(~spread)
        if depth < most and len(deeper):
            yield from _whole(shard, depth + 1, held, owner, least, spread, partial_first)
        held = (inner, least, n, children, total_leaves, total_saved, [
            hashlib.sha256(_ends(np.sort(ended[ends[i][0]:ends[i][1]])).encode()).hexdigest() if ends[i][0] < ends[i][1] else _EMPTY
            for i in inner.tolist()])
        deeper = first
    # The root always lies on both paths, so nothing whole is left over.
    paths = [(0, 0, ends_first)] + ([(1, rows - 1, ends_last)] if sides[1] else [])
    keys = [{}, {}]
    for side, row, end in paths:
        digest = xxhash.xxh3_128(b"prefix")
        keys[side][0] = digest.digest()
        for depth in range(1, end + 1):
            digest.update(ids[start[row] + depth - 1].tobytes())
            keys[side][depth] = digest.digest()
        depths = np.arange(end + 1)
        none = (None, 0, 0, 0, 0, 0)
        stats = [sides[side].get(d, none) for d in depths.tolist()]
        yield _batch(
            kind=PATH, shard=shard, side=side, depth=depths, key=[keys[side][d] for d in range(end + 1)],
            parent_key=[None, *(keys[side][d] for d in range(end))], conv_id=[s[0] for s in stats], n_convs=[s[1] for s in stats],
            n_children=[s[2] for s in stats], n_leaves=[s[3] for s in stats], saved_tokens=[s[4] for s in stats], words=[s[5] for s in stats])
    for side, depth, numbers in pieces:
        text, piece = _ends(numbers), 0
        for cut in range(0, len(text), PIECE):
            # The comma before the first piece is set where pieces meet.
            yield _batch(kind=PIECES, shard=shard, key=[keys[side][depth]], ends=[text[cut:cut + PIECE]], piece=piece)
            piece += 1


def _whole(shard: int, depth: int, held: tuple, owner: np.ndarray, parents: np.ndarray, spread: np.ndarray, on_first: bool) -> Iterator[pa.RecordBatch]:
    """Whole nodes of a depth, now that their parents are known; a partial parent is named by its path."""
    inner, least, n, children, leaves, saved, ends = held
    if not len(inner):
        return
    of = owner[inner]
    open_parent = spread[of]
    side = np.where(open_parent, np.where((of == 0) & on_first, 0, 1), -1)
    parent = [None if o else p for o, p in zip(open_parent.tolist(), parents[of].tolist(), strict=True)]
    yield _batch(kind=WHOLE, shard=shard, side=side, depth=np.full(len(inner), depth), conv_id=least[inner], parent_conv_id=parent, n_convs=n[inner],
                 n_children=children[inner], n_leaves=leaves[inner], saved_tokens=saved[inner], ends=ends)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range shard: all rows of the partition, which ``SHARD_TURNS`` bounds."""
    from pyspark import TaskContext

    convs, sizes, ids, words = [], [], [], []
    for batch in batches:
        found = batch.column("turns")
        flat = found.flatten()
        convs.append(batch.column("conv_id").to_numpy())
        sizes.append(np.diff(found.offsets.to_numpy()))
        ids.append(np.stack([flat.field("hi").to_numpy(), flat.field("lo").to_numpy()], axis=1))
        words.append(flat.field("words").to_numpy())
    if sum(map(len, convs)):
        yield from shard_nodes(
            TaskContext.get().partitionId(), np.concatenate(convs), np.concatenate(sizes).astype(np.int64), np.concatenate(ids), np.concatenate(words))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces; they come sorted by key, shard and place, so one digest is open at a time."""
    key, digest, done = None, None, []
    for batch in batches:
        for k, piece, text in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "ends")), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            elif piece == 0:
                digest.update(b",")
            digest.update(text.encode())
    if key is not None:
        done.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["of", "sha"])


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie over (conv_id, turns), see ``prefix_trie``."""
    convs = written(convs, "conversations")
    size = convs.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    # The last sort key spreads equal conversations over shards, with ascending ids from shard to shard.
    dealt = convs.repartitionByRange(max(1, -(-size // shard_turns)), "turns", "conv_id")
    out = written(dealt.mapInArrow(_shards, _NODE), "trie-shards")

    paths = out.where(F.col("kind") == PATH)
    met = paths.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"), F.max("words").alias("words"), F.min(F.struct("shard", "side")).alias("owner"))
    met = written(met, "trie-met")
    below = met.groupBy(F.col("parent_key").alias("of")).agg(F.count("*").alias("met_children"))
    met = met.join(below, F.col("key") == F.col("of"), "left").drop("of").withColumn(
        "n_children", F.col("inner_children") + F.coalesce("met_children", F.lit(0)))
    known = met.select(
        F.col("key").alias("of"), F.col("conv_id").alias("least"), "owner",
        (F.col("inner_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("own_leaf"),
        (F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("own_saved"))
    along = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    mine = (F.col("owner.shard") == F.col("shard")) & (F.col("owner.side") == F.col("side"))
    placed = written(paths.select("shard", "side", "depth", "key").join(known, F.col("key") == F.col("of")).select(
        "shard", "side", "depth", "key", "least", F.sum(F.when(mine, F.col("own_leaf")).otherwise(0)).over(along).alias("leaves"),
        F.sum(F.when(mine, F.col("own_saved")).otherwise(0)).over(along).alias("saved"), F.lead("least").over(along).alias("parent")), "trie-paths")
    summed = placed.groupBy(F.col("key").alias("of")).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.first("parent").alias("parent_conv_id"))
    pieces = out.where(F.col("kind") == PIECES).select("key", "shard", "piece", "ends")
    lists = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").mapInArrow(_streamed, "of binary, sha string")
    boundary = met.join(summed, F.col("key") == F.col("of")).drop("of").join(lists, F.col("key") == F.col("of"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"))

    # Whole nodes below a path look up its node by depth, within their own shard.
    named = placed.groupBy(F.col("shard").alias("of")).agg(*(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("depth", "least")))), lambda x: x["least"]).alias(f"path{side}")
        for side in (0, 1)))
    whole_nodes = out.where(F.col("kind") == WHOLE).join(named, F.col("shard") == F.col("of")).select(
        "conv_id", "depth", F.coalesce("parent_conv_id", F.expr("case side when 0 then path0[int(depth - 1)] when 1 then path1[int(depth - 1)] end")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    return boundary.unionByName(whole_nodes)


def prefix_trie(talks: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Null role or text counts as empty. Rows without conv_id belong to no conversation. Equal turn numbers of a
    conversation are ordered by the turn's id, so repeated rows are turns of their own and the result does not depend on
    the order of rows. Remainders of negative ids follow SQL (-21 % 20 = -1). An empty table has no nodes, not even a root. Other columns are
    ignored. A conversation's ids (24 bytes a turn) are one row, so its turns must fit in a row of Spark (2 GB).
    """
    return trie(rebuilt(talks), shard_turns)
