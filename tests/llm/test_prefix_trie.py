"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from apidrift.llm import prefix_trie as module
from apidrift.llm.prefix_trie import _ordered, prefix_trie


def turn_order(turn, role, text):
    """Sort key of the docstring: number (null first), then the two halves of the turn's id as signed numbers."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chained = lambda *parts: __import__("functools").reduce(lambda seed, p: xxhash.xxh64_intdigest(p, seed), parts, 42)
    one = (1).to_bytes(4, "little")
    return (turn is not None, turn or 0, signed(chained(role.encode(), text.encode())), signed(chained(text.encode(), role.encode(), one)))


def plain(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn, role or "", text or ""))
    original = {c: [(r, x) for _, r, x in sorted(t, key=lambda t: turn_order(*t))] for c, t in talks.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(np.fmod(c, 20))
        built[c] = tuple(original.get(first, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path]) + (len(members[path]) - 1) * words
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def nodes(out):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in out.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def talk_rows(seed, convs=260):
    """Few different turns, so prefixes are shared; one conversation with a third of all copies; one long one."""
    rnd = random.Random(seed)
    rows = []
    for c in range(-20, convs):
        if rnd.random() < 0.05:
            continue
        hot = rnd.random() < 0.3
        size = 5 if hot else rnd.choice([0, 1, 1, 2, 3, 5, 8, 40])
        for t in range(size):
            pick = t % 2 if hot else rnd.randrange(3)
            rows.append((c, None if rnd.random() < 0.02 else t, ["user", "assistant", None][pick], [f"a b {t % 3}", "", None, "x\x0by z"][rnd.randrange(2) * (not hot) + pick]))
    rows += [(c, t, "user", f"long {t % 7}") for c in (7, 8, 400) for t in range(150)]
    rows += rows[:30] + [(None, 1, "user", "nobody")]
    return rows


@pytest.mark.parametrize("shard_turns", [40, 100_000])
def test_nodes(spark, shard_turns):
    rows = talk_rows(shard_turns)
    out = prefix_trie(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as key", "2 as words"), shard_turns)
    assert nodes(out) == plain(rows)


def test_equal_conversations_over_many_shards(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)]
    out = prefix_trie(spark.createDataFrame(rows, SCHEMA), 50)
    assert nodes(out) == plain(rows)


def test_pieces_of_member_lists(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(90)]
    batches = list(module.shard_nodes(0, np.arange(90), np.ones(90, np.int64), np.ones((90, 2), np.int64), np.ones(90, np.int64)))
    text = "".join(x for b in batches for k, x in zip(b["kind"].to_pylist(), b["ends"].to_pylist(), strict=True) if k == module.PIECES)
    assert text == ",".join(str(c) for c, *_ in rows)


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(none).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    # Conversation 1 (h = 3) has one own turn; the head of its absent family start gives none: a turnless member of the root.
    single = [(1, 0, "user", "gone")]
    assert nodes(prefix_trie(spark.createDataFrame(single, SCHEMA))) == plain(single)


def test_order_of_long_and_short_rows():
    rnd = np.random.default_rng(3)
    lists = [rnd.integers(-2, 2, (rnd.choice([0, 1, 15, 16, 17, 33, 70]), 2)) for _ in range(300)]
    lists += [lists[-1][:20], lists[-1], lists[-1]]
    size = np.array([len(x) for x in lists])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    last = rnd.permutation(len(lists))
    order, shared = _ordered(np.concatenate(lists), start, size, last)
    want = sorted(range(len(lists)), key=lambda i: ([tuple(x) for x in lists[i].tolist()], last[i]))
    assert order.tolist() == want
    for r in range(1, len(lists)):
        a, b = lists[want[r - 1]].tolist(), lists[want[r]].tolist()
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert shared[r] == same
