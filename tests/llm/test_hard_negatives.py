"""Hard negatives against sorting all rows for each anchor."""

import math
import random

import numpy as np
import pytest

from apidrift.llm.hard_negatives import _windows, hard_negatives, products, walk

SCHEMA = "vec_id long, label int, embedding array<float>, id string, rank int, place int"


def plain(rows):
    taken = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        taken.append((i, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, label, q in taken:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, other) for i, other, v in taken)
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            fit = [(i, -t) for t, i, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, r + 1, n, -s, t) for r, (n, t) in enumerate(fit[:10])]
    return sorted(out)


def vectors(seed, n=900, width=8):
    rnd = random.Random(seed)
    mids = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(-200, n):
        mid = rnd.choice(mids)
        v = [m + rnd.gauss(0, 0.3) for m in mid]
        if i % 3 == 0:
            v = mids[0]  # a third of all rows are one vector
        if i % 11 == 0:
            v = v[:5]
        rows.append((i, rnd.randrange(10), [float(np.float32(x)) for x in v]))
    odd = [(5000, None, [1.0] * 8), (5100, 1, None), (5200, 1, [1.0, None]), (5300, 1, [float("nan")]), (5400, 2, [float("inf")]), (None, 3, [1.0] * 8),
           (5500, 4, []), (5600, 4, [0.0] * 8), (5700, 5, [3.0e5] * 8), (5701, 5, [3.0e5] * 8), (5702, 6, [2.0e5] * 8)]
    return rows + odd + rows[3:6]


@pytest.mark.parametrize("slab_rows,group_anchors", [(200, 4), (100_000, 100_000)])
def test_all_rows(spark, slab_rows, group_anchors):
    rows = vectors(1)
    frame = spark.createDataFrame([(*r, "x", 7, 8) for r in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in hard_negatives(frame, slab_rows=slab_rows, group_anchors=group_anchors).collect())
    assert got == plain(rows)


def test_nothing_to_do(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives(spark.createDataFrame([(5, 1, [1.0], "x", 1, 1), (100, None, [1.0], "x", 1, 1)], SCHEMA)).count() == 0


def test_walks_end_early_and_lose_nothing():
    rnd = np.random.default_rng(2)
    mids = rnd.normal(size=(20, 16))
    rows = np.floor(256 * (mids[rnd.integers(0, 20, 20_000)] + rnd.normal(size=(20_000, 16)) * 0.1)).astype(np.int64)
    members = np.floor(256 * (mids[3] + rnd.normal(size=(40, 16)) * 0.1)).astype(np.int64)
    ids, labels = np.arange(20_000), np.zeros(20_000, np.int64)
    window = np.full((40, 1, 2), (np.iinfo(np.int64).min // 2, np.iinfo(np.int64).max // 2))
    best, scored = walk(members, np.zeros(40, np.int64), np.full(40, -1), (ids, labels, rows), True, window, 5, window[..., 0])
    assert scored < 0.3 * 40 * 20_000
    score = members @ rows.T
    for m in range(40):
        want = sorted(zip((-score[m]).tolist(), ids.tolist(), strict=True))[:5]
        assert [(-s, i) for s, i in zip(best.score[best.who == m], best.id[best.who == m], strict=True)] == want


def test_windows_and_products_are_exact():
    for p in (-7, 0, 1, 9, 10, 11, 123, 2**62 - 3):
        low, high = _windows(np.array(p)).tolist()
        assert low == -(-30 * p // 100) and high == 90 * p // 100
    rnd = np.random.default_rng(1)
    for most in (10, 2**12, 2**20, 2**28):
        a, b = rnd.integers(-most, most, (2, 7, 5))
        assert products(a, b).tolist() == [[sum(x * y for x, y in zip(u, v, strict=True)) for v in b.tolist()] for u in a.tolist()]
