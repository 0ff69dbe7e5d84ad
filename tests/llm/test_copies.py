"""Exact and near copies, links and components against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

from apidrift.llm import exact_dedup
from apidrift.llm.components import components
from apidrift.llm.exact_dedup import CuckooFilter, dedup
from apidrift.llm.jaccard_join import LIGHT_MOST, Threshold, link_groups


def test_filter_follows_insertions_and_deletions():
    rnd, live, held = random.Random(1), CuckooFilter(), set()
    pool = [rnd.randbytes(32) for _ in range(3000)]
    for _ in range(20_000):
        key = rnd.choice(pool)
        if rnd.random() < 0.6:
            assert live.insert(key) == (key not in held)
            held.add(key)
        else:
            assert live.delete(key) == (key in held)
            held.discard(key)
    again = CuckooFilter.load(*live.dump())
    assert all((key in live) == (key in again) == (key in held) for key in pool)
    assert live.n_rows > 64  # it was resized
    assert sum(live.may_hold(rnd.randbytes(32)) for _ in range(5000)) < 20


def test_live_index(spark):
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(600)]
    frame = lambda part: spark.createDataFrame([(k,) for k in part], "sha string")
    index = exact_dedup.empty_index(frame(keys))
    index = exact_dedup.update_index(index, frame(keys[:400]), 3)
    index = exact_dedup.update_index(index, frame(keys[:100] + keys[500:550]), 3, delete=True)
    index = exact_dedup.update_index(index, frame(keys[50:60] + keys[200:210]), 3)
    got = {r.sha: r.live for r in exact_dedup.look_up(index, frame(keys), 3).collect()}
    want = set(keys[100:400]) | set(keys[50:60])
    assert got == {k: k in want for k in keys}


def test_dedup(spark, odd, none):
    rows = [(100 + i, t) for i, t in enumerate(["a b", "ab", " a\tb\n", "b a", "a b", "a b"])] + [(200 + i, "hot text") for i in range(300)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    groups = defaultdict(list)
    for i, text in texts.items():
        groups["".join(c for c in text if c not in " \t\n\x0b\f\r")].append(i)
    out = {r.doc_id: r for r in dedup(docs).collect()}
    assert len(out) == len(texts)
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i]), i))
        for i in ids:
            assert (out[i].keep_id, out[i].group_size, out[i].kept) == (keep, len(ids), i == keep)
            assert out[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert dedup(none).count() == 0
    twice = dedup(odd.union(odd)).collect()
    assert len(twice) == 2 * odd.count() and all(r.group_size % 2 == 0 for r in twice)
    unknown = spark.createDataFrame([(None, "x"), (5, "x"), (None, "y")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in dedup(unknown).collect()} == {(None, 5, False), (5, 5, True), (None, None, True)}


def find(parents, x):
    while parents[x] != x:
        x = parents[x]
    return x


def groups_of(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    holders, parents = defaultdict(list), {i: i for i in sets}
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    for a in sorted(sets):
        common = Counter(b for s in sets[a] for b in holders[s] if b > a)
        for b, n in common.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(parents, a), find(parents, b)
                parents[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(parents, i)) for i in sets}


def similar_rows(seed):
    rnd, rows = random.Random(seed), []
    hot = [f"h{k}" for k in range(50)]
    for _ in range(40):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(rnd.choice([1, 3, 4, 5, 8, 9, 11, 13, 14, 16, 20, 30, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 3, 8])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                at = rnd.randrange(len(words))
                change = rnd.random()
                if change < 0.4:
                    words[at] = f"z{rnd.randrange(99)}"
                elif change < 0.7:
                    words.insert(at, f"y{rnd.randrange(99)}")
                elif len(words) > 1:
                    words.pop(at)
            rows.append(" ".join(words))
    rows += [" ".join([*hot, *(f"q{rnd.randrange(10**6)}" for _ in range(rnd.randrange(9)))]) for _ in range(50)]
    rows += [" ".join(hot)] * 30 + [None, "", " \n ", "one", "ONE", "A  b\nC", "a B c"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_groups_match_brute_force(spark):
    for seed, width, percent in ((1, 4, 85), (2, 5, 80)):
        rows = similar_rows(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_groups(docs, width, percent).collect()}
        want = groups_of(rows, width, percent)
        assert got == want
        assert len({c for _, c in want.values()}) < len(rows) - 100


def test_template_pages_verify_few_pairs(spark, monkeypatch):
    """400 pages of one template, most pairs just below the threshold."""
    from apidrift.llm import jaccard_join

    rnd = random.Random(5)
    fixed = [[f"f{b}x{i}" for i in range(20)] for b in range(30)]
    rows = [(i, " ".join(" ".join([*block, rnd.choice("abc")]) for block in fixed)) for i in range(400)]
    asked = []
    verified = jaccard_join._verified

    def counted(pairs, sets, percent):
        asked.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == groups_of(rows, 4, 80)
    assert sum(asked) < 400 * 399 / 2 / 4


def test_groups_of_odd_tables(spark, odd, none):
    out = {r.doc_id: r for r in link_groups(odd).collect()}
    assert {i: out[i].component_id for i in (0, 1, 2, 3, 4, 5, 6)} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}
    assert out[8].component_id == 7 and out[8].class_id == 8 and out[0].n_shingles == 0
    assert link_groups(none).count() == 0
    assert link_groups(odd.union(odd)).count() == 2 * odd.count()
    unknown = spark.createDataFrame([(None, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "x y z u v w"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in link_groups(unknown).collect() if r.component_id or r.n_shingles < 5) == [
        (0, None), (3, None), (5, 5), (5, 5)]


def test_thresholds_are_exact():
    for percent in (80, 85):
        rule = Threshold(percent)
        for s in range(1, 60):
            assert rule.least(s) == next(x for x in range(1, s + 1) if 100 * x >= percent * s)
            for t in range(s, 60):
                fit = [x for x in range(s + 1) if 100 * x >= percent * (s + t - x)]
                assert (min(fit) if fit else s + 1) <= rule.common(s, t) or not fit
                assert not fit or rule.common(s, t) == min(fit)
    assert 0 < Threshold(85).boundary(dict.fromkeys(range(1, LIGHT_MOST + 1), 10)) < LIGHT_MOST


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    parents = {x: x for link in links for x in link}
    for a, b in links:
        x, y = find(parents, a), find(parents, b)
        parents[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(parents, x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
