"""Cases where a bound or a shortcut used to cost results."""

import random

import corpus_pipeline
from apidrift.llm import language_id, license_scan

OWN = {"clean": "river stone lamp", "junk": "zzz xxx buy", "toxic": "awful nasty vile"}


def test_mixing_stage_keeps_clean_texts_where_toxic_ones_are_scarce(spark, tmp_path):
    rnd = random.Random(5)
    for junk in (98, 898):
        kinds = ["toxic"] * 2 + ["junk"] * junk + ["clean"] * (1998 - junk)
        rows = [(i, " ".join(rnd.choice([*OWN[k].split(), "the", "of", "and"]) for _ in range(40)), "en", "s", 1) for i, k in enumerate(kinds)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
        named = [(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kinds) if i < 2 or i % 3 == 0]
        spark.createDataFrame(named, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{junk}/labels.parquet")
        left = {r.doc_id for r in corpus_pipeline.mixed(spark, docs, f"{tmp_path}/{junk}").collect()}
        assert {i for i, k in enumerate(kinds) if k != "junk"} <= left
        assert sum(kinds[i] == "junk" for i in left) < junk


def test_all_licences_of_a_file_are_labelled(spark):
    rnd = random.Random(6)
    texts = {label: text for label, (text, _) in license_scan.TEMPLATES.items()}
    ordinary = ["person", "charge", "fee", "conditions", "unencumbered", "subject", "domain", "purpose", "word", "other"]
    prose = lambda n: " ".join(rnd.choice(ordinary) for _ in range(n))
    phrases = {label: " / ".join(keys) for label, (_, keys) in license_scan.TEMPLATES.items()}
    made = ["\n\n".join(texts.values()), *(f"{prose(9000)} . {t} . {prose(9000)}" for t in texts.values()),
            *(f"{prose(900)} . {t} . {prose(900)}" for t in phrases.values())]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[0].labels == ",".join(sorted(texts)) and got[0].score == 1
    assert [got[1 + i].labels for i in range(2 * len(texts))] == [*texts, *phrases]
    assert all(got[1 + i].score > 0.99 for i in range(len(texts)))


SYLLABLES = {
    "en": ["the", "ing", "tion", "and", "wh"], "fr": ["eau", "oi", "que", "é", "ment"], "fi": ["kää", "yö", "uu", "lla", "ssä"],
    "el": ["και", "το", "μου", "ση", "ρα"]}


def speech(lang, rnd, n=40):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_rare_languages_are_named_and_unknown_ones_rejected(spark):
    rnd = random.Random(7)
    kinds = ["en"] * 900 + ["fr"] * 300 + ["fi"] * 6
    rows = [(i, speech(k, rnd), k, None, None) for i, k in enumerate(kinds)]
    rows += [(2000 + i, speech("fi", rnd), None, None, None) for i in range(4)]
    rows += [(3000 + i, speech("el", rnd), None, None, None) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    out = {r.doc_id: r for r in language_id.identify(frame).collect()}
    assert [out[i].lang for i in range(len(kinds))] == kinds and all(out[i].kept for i in range(len(kinds)))
    assert {(out[2000 + i].lang, out[2000 + i].kept) for i in range(4)} == {("fi", True)}
    assert not any(out[3000 + i].kept for i in range(6))


def test_sparse_columns_score_like_full_ones(monkeypatch):
    rnd = random.Random(8)
    found = {}
    for k in SYLLABLES:
        hashes = language_id.trigrams(" ".join(speech(k, rnd) for _ in range(5)))[0]
        buckets = sorted(set(hashes.tolist()))
        found[k] = (language_id.np.array(buckets), language_id.np.bincount(hashes)[buckets])
    full = language_id.Model(sorted([*found, "xx"]), found)
    monkeypatch.setattr(language_id, "DENSE_MOST", 2)
    part = language_id.Model(sorted([*found, "xx"]), found)
    assert len(part.sparse) == 3
    for k in SYLLABLES:
        at = language_id.trigrams(speech(k, rnd))[0]
        assert abs(full.sums(at) - part.sums(at)).max() < 1e-2


def test_stages_decide_by_row_where_ids_are_null_or_repeated(spark, tmp_path):
    rnd = random.Random(9)
    prose = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    a, b, c, d = prose(), prose(), prose(), prose()
    rows = [(1, a), (1, a), (None, a), (2, b), (2, c), (4, b), (None, d), (None, d), (None, f"{d} more"), (7, f"{d} more words"), (None, " 12 "), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, docs.union(docs), spark.read.parquet(f"{tmp_path}/documents.parquet")):
        left = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        spoken = corpus_pipeline.language(spark, frame, str(tmp_path))
        assert {t for _, t in left(spoken)} == {t for _, t in rows} - {" 12 ", ""}
        once = corpus_pipeline.exact(spark, spoken, str(tmp_path))
        assert left(once) == sorted([(1, a), (2, b), (2, c), (None, d), (None, f"{d} more"), (7, f"{d} more words")], key=str)
        apart = corpus_pipeline.near(spark, once, str(tmp_path))
        assert left(apart) == sorted([(1, a), (2, b), (2, c), (7, f"{d} more words")], key=str)
        assert left(corpus_pipeline.mixed(spark, apart, str(tmp_path))) == left(apart)
        assert left(corpus_pipeline.near(spark, spoken, str(tmp_path))) == left(apart)
