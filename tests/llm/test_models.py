"""Language identification, mixing, BPE and the pipeline."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from apidrift.llm import bpe, language_id, mixing
from apidrift.llm.bpe import encode, encode_digests
from apidrift.llm.queries import tokenizer_path

SYLLABLES = {"en": ["the", "ing", "tion", "and", "wh"], "fr": ["eau", "oi", "que", "é", "ment"], "de": ["sch", "ung", "ver", "ö", "keit"]}
SF = "/root/testdata/sf0.001"


def speech(lang, rnd, n=40):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rnd = random.Random(1)
    truth = {i: rnd.choice(["en", "fr", "de"]) for i in range(400)}
    rows = [(i, speech(l, rnd), l if i % 7 else "en", l if i % 3 else None, f"{i % 9}.{l}" if i % 2 else None) for i, l in truth.items()]
    rows += [(500, None, "en", None, None), (501, " 12 --", "fr", None, None), (502, speech("fr", rnd, 12), None, "fr", "0.fr"), (502, speech("fr", rnd, 12), "en", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    out = language_id.identify(frame).collect()
    assert len(out) == len(rows)
    assert np.mean([r.lang == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.97
    assert all(r.kept for r in out if r.doc_id in truth)
    assert [r.kept for r in sorted(out, key=lambda r: r.doc_id)[-4:]] == [False, False, True, True]
    assert language_id.identify(frame.limit(0)).count() == 0
    unnamed = language_id.identify(frame.withColumn("declared", F.lit(None).cast("string"))).collect()
    assert {r.lang for r in unnamed} == {None} and sum(not r.kept for r in unnamed) == 2


def test_host_prior_decides_short_texts(spark):
    rnd = random.Random(2)
    rows = [(i, speech(l, rnd), l, l, f"h.{l}") for i, l in enumerate(["en", "fr", "de"] * 60)]
    rows += [(1000, "xyz", None, "de", "h.de"), (1001, "xyz", None, "fr", "new.fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    out = {r.doc_id: r for r in language_id.identify(frame).collect()}
    assert out[1000].lang == "de" and out[1001].lang == "fr"


def test_page_rows(spark):
    html = "<html class=x LANG='FR'><script>var a='<p>';</script><p>Bonjour<!-- no --> <b>le</b></p>"
    pages = spark.createDataFrame([(1, "https://A.Example.ORG:80/x", html), (2, None, None)], "page_id long, url string, html string")
    a, b = sorted(language_id.page_rows(pages).collect(), key=lambda r: r.page_id)
    assert (a.declared, a.suffix, a.host, a.text.split()) == ("fr", "org", "a.example.org", ["Bonjour", "le"])
    assert (b.declared, b.suffix, b.host, b.text) == (None, None, None, "")


def mixed_docs(spark, n=900):
    rnd = random.Random(3)
    own = {"clean": "river stone lamp", "junk": "zzz xxx buy", "toxic": "awful nasty vile"}
    kinds = [rnd.choices(list(own), [7, 2, 1])[0] for _ in range(n)]
    rows = [(i, " ".join(rnd.choice(own[k].split() + ["the", "of", "and"]) for _ in range(rnd.randrange(5, 60)))) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "doc_id long, text string"), kinds


def test_mixing_meets_targets(spark, odd):
    docs, kinds = mixed_docs(spark)
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if i % 3 == 0], "doc_id long, domain string")
    targets = {"clean": 0.6, "junk": 0.3, "toxic": 0.1}
    out = mixing.mix(docs, labels, targets).collect()
    assert np.mean([max(r.posteriors, key=r.posteriors.get) == kinds[r.doc_id] for r in out if r.doc_id % 3]) > 0.95
    total = {k: sum(r.n_tokens * r.rate * r.posteriors[k] for r in out) for k in targets}
    for k, weight in targets.items():
        assert abs(total[k] / sum(total.values()) - weight) < 0.01
    assert {r.target_miss for r in out} <= {out[0].target_miss} and out[0].target_miss <= mixing.TOLERANCE
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    assert abs(sum(r.copies for r in out) - sum(r.rate for r in out)) < 60
    # The solver against plain projected gradient over all documents at once.
    w = np.array([r.n_tokens for r in out], float)
    p = np.array([[r.posteriors[k] for k in sorted(targets)] for r in out])
    w /= w.sum()
    share = w @ p
    want = np.array([targets[k] for k in sorted(targets)])
    want = want * (share / want).min()
    rate = np.ones(len(w))
    for _ in range(20_000):
        rate = np.maximum(rate - (p @ (((w * rate) @ p - want) / share) + mixing.RIDGE * (rate - 1)), 0)
    assert np.abs((w * rate) @ p - (w * np.array([r.rate for r in out])) @ p).max() < 0.005


def test_mixing_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(5, "a"), (7, "b"), (5, "a"), (99, "c"), (3, None)], "doc_id long, domain string")
    out = mixing.mix(odd, labels, {"a": 1, "b": 1}).collect()
    assert len(out) == odd.count() and {r.n_tokens for r in out if r.doc_id < 3} == {0}
    assert {(r.rate, r.copies, r.posteriors) for r in mixing.mix(odd, labels.limit(0), {"a": 1}).collect()} == {(1.0, 1, None)} if True else None
    assert mixing.mix(none, labels, {"a": 1}).count() == 0
    # Repetitions of a labelled id are no further examples; rows without id are rounded one by one.
    many = odd.selectExpr("cast(null as long) as doc_id", "text").union(odd.select("doc_id", "text")).union(odd.where("doc_id = 7").select("doc_id", "text"))
    again = {r.doc_id: r.posteriors for r in mixing.mix(many, labels, {"a": 1, "b": 1}).collect()}
    assert all(again[r.doc_id] == r.posteriors for r in out)


def test_label_domains(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.domain) for r in mixing.label_domains(labels).collect()} == {(1, "clean"), (2, "junk"), (3, "toxic")}


def test_bpe_is_the_library(spark, odd, none):
    texts = ["  a\n\n b\t\tc  ", "x<|endoftext|>y <|endoftext|>", "<|endoftext|><|endoftext", "日本語 テキスト ՘a ๑๒", "it's I'LL we're''s", "\x85\xa0x \U000fffff",
             *(chr(c) + "a" + chr(c) * 2 + " 1" for c in (0x558, 0x2028, 0x3000, 0x1F600, 0x10ED9, 0x500, 0x20AC))]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    docs = docs.union(docs).repartition(4)
    library = Tokenizer.from_file(tokenizer_path())
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = encode_digests(docs, tokenizer_path()).collect()
    assert len(rows) == 2 * len(known)
    for r in rows:
        ids = library.encode(known[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), r.doc_id
    real = encode(docs, tokenizer_path()).collect()
    assert all(r.decoded == known[r.doc_id] and r.token_ids == library.encode(known[r.doc_id], add_special_tokens=False).ids for r in real)
    assert encode_digests(none, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        encode_digests(odd, tokenizer_path().replace("byte_bpe_50k", "word_bpe_49k"))


def test_bpe_codes_stay_in_their_block():
    """Words alone go to the buckets and come back; the codes wait where the block is."""
    with open(tokenizer_path(), encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    words = [b" tide", b"harbour", " \u00e9t\u00e9".encode()]
    asked = pa.table({"block": ["b", "c"], "bucket": pa.array([3, 3], pa.int32()), "words": [bpe._pack_words(words), bpe._pack_words(words[1:])]})
    done = bpe._encoder(vocabulary)(asked)
    assert done.column_names == ["block", "bucket", "counts", "flat"]
    ids = vocabulary.encode([w.decode() for w in words])
    assert [bpe._unpack(b).tolist() for b in done.column("flat").to_pylist()] == [sum(ids, []), sum(ids[1:], [])]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = set(texts)
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        kept = {r.doc_id for r in frame.collect()}
        assert kept <= left
        if name == "exact_dedup":
            assert len({"".join(texts[i].split()) for i in kept}) == len(kept) == len({"".join(texts[i].split()) for i in left})
        left = kept
    final = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(tokenizer_path())
    assert {r.doc_id for r in final} == left
    for r in final:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_stages_take_odd_tables(spark, odd):
    for frame in (odd, odd.limit(0), odd.union(odd)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() <= frame.count()
            assert name == "bpe" or out.columns == frame.columns
