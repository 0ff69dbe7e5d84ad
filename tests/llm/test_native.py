"""Quality rules, licence scan and sharding against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from apidrift.llm import license_scan, quality_rules
from apidrift.llm.sharding import shard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if seen[run] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_match_plain_python(spark, odd):
    rnd = random.Random(1)
    made = [(100 + i, " ".join(rnd.choice("ab\nc") for _ in range(rnd.randrange(60))), None) for i in range(60)]
    docs = odd.select("doc_id", "text", "lang").union(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.measures(docs).collect():
        assert base_measures(texts[r.id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.id


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 5, 60, 400) for k in range(0, n + 1, max(1, n // 7))]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.at_most(F.col("k"), F.col("n"), 0.1).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r.n, i) * 0.1 ** i * 0.9 ** (r.n - i) for i in range(r.k + 1)) if r.k <= r.n * 0.1 else 1.0
        assert abs(r.p - want) < 1e-9


def test_rules_reject_junk_and_certified_cutoffs_keep_good_documents(spark):
    clean = "word and word again so it goes on with many other things that are said here once in a while %d alpha beta gamma"
    rows = [(i, clean % i if i % 4 else "word%d ### " % i * 25, "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels, max_false_rejection=0.05).collect()}
    assert all(out[i].kept for i in range(4000) if i % 4)
    assert not any(out[i].kept for i in range(0, 4000, 4))


def test_rules_on_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (0, 1), (99, 1), (3, None)], "doc_id long, quality int")
    rows = quality_rules.apply_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.n_words == 0} == {0, 1, 2}
    assert quality_rules.apply_rules(none, labels).count() == 0
    assert quality_rules.apply_rules(odd, labels.limit(0)).count() == odd.count()


def licence_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for label, phrase in license_scan.BASE_PHRASES.items():
        phrase = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(phrase)] == phrase:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def plain_licences(texts):
    """Labels, scores and base places of all files, every phrase compared at every place."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in x for x in split) + 0.5))
    out = []
    for words in split:
        at = lambda phrase: [i for i in range(len(words)) if words[i:i + len(phrase)] == phrase]  # noqa: B023, E731
        labels, score = set(), 0.0
        for label, (text, keys) in license_scan.TEMPLATES.items():
            text = text.split()
            if not all(at(k.split()) for k in keys):
                continue
            labels.add(label)
            rare = [(i, w) for i, w in enumerate(text) if w not in license_scan.COMMON]
            for key in keys:
                first = next(i for i in range(len(text)) if text[i:i + len(key.split())] == key.split())
                for start in at(key.split()):
                    near = lambda i: words[max(0, start - first + i - license_scan.SLACK):max(0, start - first + i + license_scan.SLACK + 1)]  # noqa: B023, E731
                    score = max(score, sum(idf(w) for i, w in rare if w in near(i)) / sum(idf(w) for _, w in rare))
        base = [(i, label) for label, p in license_scan.BASE_PHRASES.items() for i in at(p.split())]
        labels |= {label for _, label in base}
        out.append((",".join(sorted(labels)), score))
    return out


def test_licences(spark, odd, none):
    mit = license_scan.TEMPLATES["mit"][0]
    texts = [
        "Under the MIT License. under the mit-license", "under the mit", "CC BY-NC 4.0 cc by nc", "Apache License, Version 2.0",
        f"(c) X\n{mit.capitalize()}!", "Redistribution and use in source and binary forms is fine", "Licensed under the Apache License, Version 2.0",
        "the software without charge any person permission", "This work is licensed under the GNU General Public License, version 3.", "All Rights Reserved",
        "permission is hereby granted free of charge", "gnu lesser general public license and gnu general public license",
    ]
    rnd = random.Random(8)
    pool = [w for t, _ in license_scan.TEMPLATES.values() for w in t.split()]
    for _ in range(150):  # pieces of licences with words lost, doubled and inserted
        piece = []
        for _ in range(rnd.randrange(1, 4)):
            text = rnd.choice([*license_scan.BASE_PHRASES.values(), *(t for t, _ in license_scan.TEMPLATES.values())]).split()
            piece += [w for w in text for _ in range(rnd.choice([1] * 40 + [0, 2]))] + [rnd.choice(pool) for _ in range(rnd.randrange(4))]
        texts.append(" ".join(piece))
    made = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(made)
    rows = docs.collect()
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for row, (labels, score) in zip(rows, plain_licences([r.text for r in rows]), strict=True):
        r = got[row.doc_id]
        assert licence_base(row.text) == (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        assert r.labels == labels and abs(r.score - score) < 1e-9, row.text
    assert [got[100 + i].labels for i in range(12)] == [
        "mit", "", "cc-by-nc", "apache-2", "mit", "bsd", "apache-2", "", "gpl", "all-rights-reserved", "", "gpl,lgpl"]
    assert got[104].score == 1
    # The index rejects scattered words; verification rejects what agrees but for one word.
    assert got[107].n_candidates == 0
    near = spark.createDataFrame([(1, "license mit is under"), (2, "under a mit license"), (3, "gnu general common license")], "doc_id long, text string")
    assert {r.doc_id: (r.n_candidates > 0, r.labels) for r in license_scan.scan(near.union(made)).where("doc_id < 10").collect()} == {
        1: (False, ""), 2: (True, ""), 3: (True, "")}
    assert license_scan.scan(none).count() == 0
    assert license_scan.scan(docs.union(docs)).count() == 2 * len(rows)


def test_shards_are_even_gapless_and_stable(spark, odd, none):
    docs = spark.range(5003).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"), F.lit(1).alias("shard"), F.lit(2).alias("cell"))
    rows = shard(docs, 8).collect()
    assert len(rows) == 5003 and {r.size for r in rows} == {3} and {r.law for r in rows} == {"rows"}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    before = {r.doc_id: r.shard for r in rows}
    after = {r.doc_id: r.shard for r in shard(docs, 9).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.35 * len(before)
    assert sum(r.shard != r.home_shard for r in rows) < 0.2 * len(rows)
    twice = shard(odd.union(odd), 3).collect()
    assert sorted(Counter(r.shard for r in twice).values()) == [7, 7, 8]
    assert all(r.size == 1 and r.text_crc32 == 0 for r in twice if r.doc_id in (0, 1))
    assert shard(none).count() == 0
    assert shard(odd, 1, 1).count() == odd.count()
    assert shard(odd, 50).count() == odd.count()
