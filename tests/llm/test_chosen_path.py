"""Near duplicates by chosen paths against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from apidrift.llm import chosen_path as module
from apidrift.llm.chosen_path import near_duplicates, sketch, trees_for


def plain(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and None not in (rows[i][0], rows[j][0]):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(sets[i]), least[find(i)], key == least[find(i)]) for i, (key, _) in enumerate(rows) if key is not None)


def families(seed, n=420):
    """Families of near copies, some at the threshold, that all share one passage; copies; unrelated texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([12, 60, 300]))] + passage
        for _ in range(n // 10):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, len(base) // 25, len(base) // 16])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(rnd.choice([1, 2, 3, 4, 9, 80]))) for _ in range(n // 4)]
    texts += [" ".join([word() for _ in range(30)] + passage) for _ in range(n // 4)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def result(out):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect())


@pytest.mark.parametrize("small,levels", [(module.SMALL, module.MOST_LEVELS), (6, 2)])
def test_components(spark, small, levels):
    rows = families(small)
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=small, levels=levels))
    assert got == plain(rows, 4, 80)


def test_template_pages_propose_few_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    fixed = [[f"f{b}x{i}" for i in range(20)] for b in range(30)]
    rows = [(i, " ".join(" ".join([*block, rnd.choice("abc")]) for block in fixed)) for i in range(400)]
    asked = []
    verify = module._Join.verify

    def counted(self, pairs, name):
        asked.append(pairs.distinct().count())
        verify(self, pairs, name)

    monkeypatch.setattr(module._Join, "verify", counted)
    got = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows, 4, 80)
    assert sum(asked) < 400 * 399 / 2 / 8


def test_odd_tables(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(near_duplicates(odd)) == plain(rows, 4, 80)
    assert near_duplicates(none).count() == 0
    assert result(near_duplicates(odd.union(odd))) == plain(rows + rows, 4, 80)
    unknown = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "x"), (7, "y y y"), (7, "z y z z w")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(unknown).collect()}
    assert got == {(None, 2, 5, False), (5, 2, 5, True), (None, 1, None, True), (7, 1, 7, True), (7, 2, 7, True)}


def test_sketches_agree_like_the_sets():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        pool = rnd.integers(0, 2**63, 1000).astype(np.uint64)
        a, b = pool[:900], pool[100:]
        assert abs((sketch(a) == sketch(b)).mean() - 0.8) < 0.16
    assert trees_for(0.9995, 3) == 17 and trees_for(0.5, 1) == 1


def test_profiles_estimate_similarity():
    rnd = np.random.default_rng(2)
    for size in (5, 300, 512, 513, 4000):
        pool = np.unique(rnd.integers(0, 2**63, 3 * size).astype(np.uint64))
        sets = [np.sort(rnd.choice(pool, size, replace=False)) for _ in range(6)] + [pool[:3]]
        profiles = [(s[:module.PROFILE] >> np.uint64(32)).astype(np.uint32) for s in sets]
        limits = np.array([int(p[-1]) if len(s) > module.PROFILE else module._NO_LIMIT for s, p in zip(sets, profiles)])
        near, deviation = module.similarity(profiles[0], limits[0], profiles, limits)
        for s, got, spread, limit in zip(sets, near, deviation, limits):
            both = len(np.intersect1d(sets[0], s))
            union = len(sets[0]) + len(s) - both
            if max(len(sets[0]), len(s)) <= module.PROFILE:
                assert spread == 0 and got == (both + 1) / union
            else:
                assert spread > 0 and abs(got - both / union) <= 5 * spread + 0.01


def test_profiles_are_read_where_sketches_agree(spark, monkeypatch):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage = [word() for _ in range(40)]
    apart = [(i, " ".join([word() for _ in range(30)] + passage)) for i in range(200)]
    base = [word() for _ in range(200)]
    # Three edits link, some fourteen do not but leave the sketches near.
    close = [" ".join([*base[:at], *(word() for _ in range(n)), *base[at + n:]]) for at, n in [(0, 3), (90, 16), (20, 15), (150, 17)]]
    rows = apart + list(enumerate(close, 200))
    sizes = {}
    written = module.written

    def noted(frame, name):
        out = written(frame, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "written", noted)
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows, 4, 80)
    assert sum(sizes.get("path-profiles", [])) <= len(close) < max(sizes["path-mixed"])


def test_partners_of_large_nodes(monkeypatch):
    rnd = np.random.default_rng(3)
    short = rnd.integers(0, 3, (50, module.COORDINATES)).astype(np.uint8)
    labels = [bytes([i % 4]) for i in range(50)]
    want = {i: js for i in range(50) if (js := [j for j in range(50) if labels[i] != labels[j] and (short[i] == short[j]).sum() >= 45])}
    for room in (1, 20_000, 4 << 20):
        monkeypatch.setattr(module, "AGREED_BYTES", room)
        assert {i: js.tolist() for i, js in module._partners(labels, [s.tobytes() for s in short], 45)} == want and want
