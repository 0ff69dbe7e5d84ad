"""Secret and personal-data scans against plain expressions."""

import hashlib
import random
import re

from apidrift.llm import pii, secret_scan

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def spans(text, expressions):
    out = []
    for order, (kind, pattern, holds) in enumerate(expressions):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if holds(m)]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


SECRETS = [
    ("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
digits = lambda m: re.sub("[^0-9]", "", m[0])
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def made(parts, n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(24))) for _ in range(n)]


def test_secret_expressions():
    parts = ["password", "Passwd", "SECRET", "token", "apikey", "API_KEY", ":", "=", " ", "'", '"', "abc", "123456", "AKIA", "ABCDEFGHIJ",
             "0123456789abcdef", "é", "ſecret", "\n", "ghp_", "eyJ", ".", "-"]
    for text in made(parts, 5000, 1):
        assert [s for s in secret_scan.find_secrets(text) if s[2] in secret_scan.BASE_KINDS] == spans(text, SECRETS), text


def test_checksums_decide():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + secret_scan.crc_token(body)
    assert secret_scan.find_secrets(f"x {good}.") == [(2, 42, "github")]
    assert secret_scan.find_secrets("ghp_" + body + "000000") == []
    assert secret_scan.find_secrets("npm_" + body + secret_scan.crc_token(body))[0][2] == "npm"
    assert secret_scan.find_secrets("eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln") == [(0, 36, "jwt")]
    assert secret_scan.find_secrets("eyJhbGciOiJIUzI1NiJ9.eyJhIjoxf.c2ln") == []


def test_tokens_in_long_runs():
    import time

    good = "eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln"
    began = time.time()
    assert secret_scan.find_secrets("eyJ" * 200_000) == []
    assert secret_scan.find_secrets("eyJ" * 200_000 + " " + good) == [(600_001, 600_037, "jwt")]
    assert secret_scan.find_secrets(("eyJa." * 3 + "!") * 50_000) == []
    assert time.time() - began < 10
    # Every hit tried on its own, as the contract of a search reads.
    pattern, rnd = secret_scan.RULES["jwt"][1], random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice(["eyJ", "eyJhbGciOiJIUzI1NiJ9", ".", "eyJhIjoxfQ", "c2ln", "-", " ", "EYJ"]) for _ in range(rnd.randrange(12)))
        want, behind = [], 0
        for start in range(len(text)):
            if start >= behind and (m := pattern.match(text, start)):
                behind = m.end()
                want += [(start, behind, "jwt")] * secret_scan._is_jwt(m)
        assert [s for s in secret_scan.find_secrets(text) if s[2] == "jwt"] == want, text


def test_secret_rows(spark, odd, none):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100, "é token=abcdef1")], "doc_id long, text string"))
    rows = {r.doc_id: r for r in secret_scan.scan(docs.union(docs)).collect()}
    assert rows[100].spans == "assign:2:15" and rows[100].n_assign == 1
    assert rows[100].base_sha256 == hashlib.sha256(b"assign:2:15").hexdigest()
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""
    assert secret_scan.scan(docs.union(docs)).count() == 2 * docs.count()
    assert secret_scan.scan(none).count() == 0


def test_personal_expressions():
    parts = ["a", "b@", "@", "x.y", "1", "23", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "é", "٣",
             "\n", "%", "007", "1.2.3.4", "555-1234"]
    for text in made(parts, 8000, 2):
        assert pii.base_spans(text) == spans(text, PERSONAL), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == []
    assert secret_scan.find_secrets("f" * 300_000)[0][:2] == (0, 300_000)


def personal_texts(n, seed):
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        words = [rnd.choice(["the", "lorem", "Ipsum", "dolor,", "amet."]) for _ in range(12)]
        words.insert(rnd.randrange(12), [f"bob{i}@mail{d(1)}.example.com", f"+1 ({d(3)}) 555-{d(4)}", f"10.{d(2)}.{d(1)}.1", f"in {d(4)}"][i % 4])
        out.append(" ".join(words))
    return out


def test_field_finds_values_of_unseen_texts():
    """Held-out sentences of the labelled table's rule, by whole spans."""
    held = pii.labelled_table(500, 99)
    found = pii.field_spans([t for t, _ in held], pii.own_model())
    right = sum(s in spans for i, (_, spans) in enumerate(held) for s in found.get(i, []))
    assert right / sum(map(len, found.values())) > 0.93
    assert right / sum(len(spans) for _, spans in held) > 0.88


def test_field_adds_what_expressions_miss():
    text = "ring (456) 555-2186 now, des +1 (826) 555-4081 190.137.223.20 du, nt 9807915762804491 raie, see bob [at] example [dot] org, in 1998, v 4.0."
    base = pii.base_spans(text)
    more = pii._apart(pii.field_spans([text], pii.own_model())[0], base)
    assert {(text[a:b], kind) for a, b, kind in more} == {
        ("(456) 555-2186", "phone"), ("+1 (826) 555-4081", "phone"), ("9807915762804491", "card"), ("bob [at] example [dot] org", "email")}
    assert not pii.field_spans(["Licensed under CC BY-NC 4.0. In 1998, version 3.", "nothing here"], pii.own_model())


def test_parts_of_many_zeros():
    text = "1.2.3." + "0" * 5000 + "4 and 1.2.3." + "0" * 5000
    assert [s[2] for s in pii.base_spans(text)] == ["ip", "ip"] and pii.base_spans("1.2.3." + "0" * 5000 + "256") == []


def test_windows_cover_each_token_once():
    rnd = random.Random(9)
    for n in (3, 255, 256, 257, 700, 3000):
        text = " ".join(rnd.choice(["12", "a.b", "x", "(7)", "word word word word word word word word word word word word"]) for _ in range(n))
        seen, last = [], []
        for run, first, to, goes_on in pii.windows(text):
            assert len(run) <= pii.WINDOW + 2 * pii.REACH and (first > 0) == goes_on
            seen += run[first:to]
        assert seen == sorted(set(seen))
        marked = {(m.start(), m.end(), m[0]) for m in pii._TOKEN.finditer(text) if pii._MARK.search(m[0])}
        assert marked <= set(seen)


def test_texts_of_numbers_take_bounded_memory():
    import tracemalloc

    rnd = random.Random(3)
    texts = [" ".join(str(rnd.randrange(10**6)) for _ in range(8000)) for _ in range(12)]
    model = pii.own_model()
    tracemalloc.start()
    pii.field_spans(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_viterbi_finds_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    k = len(pii.TAGS)
    model = pii.ChainField(rng.normal(size=(pii.FEATURES, k)), rng.normal(size=(k, k)))
    rows = [[[1], [2], [3]], [[4], [5], [6], [7]], [[8]]]
    for row, (path, sure) in zip(rows, model.decode(rows)):
        score = lambda p: sum(model.emit[f[0], t] for f, t in zip(row, p)) + sum(model.move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        every = list(itertools.product(range(k), repeat=len(row)))
        scores = np.array([score(p) for p in every])
        assert tuple(path) == every[int(scores.argmax())]
        weights = np.exp(scores - np.logaddexp.reduce(scores))
        assert np.allclose(sure, [sum(w for p, w in zip(every, weights) if p[i] == path[i]) for i in range(len(row))])


def test_personal_rows(spark, odd, none):
    texts = personal_texts(120, 3) + ["mail é@x.y a@b.cd", "ring (456) 555-2186 now"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.scan(docs.union(docs)).collect()
    assert len(rows) == 2 * docs.count()
    for r in rows:
        base = spans(known[r.doc_id], PERSONAL)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == kind for s in base) for kind in pii.BASE_KINDS]
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
    assert sum(r.n_model for r in rows) >= 2 and all(r.n_spans == len(list(filter(None, r.spans.split(",")))) for r in rows)
    assert pii.scan(none).count() == 0
    assert {r.spans for r in pii.scan(odd).collect()} == {""}
    own = spark.createDataFrame([(t, [(a, b, k) for a, b, k in s]) for t, s in pii.labelled_table(60)],
                                "text string, spans array<struct<start:int,stop:int,kind:string>>")
    assert pii.scan(odd, labelled=own).count() == odd.count()
    assert {r.n_model for r in pii.scan(docs, labelled=own.where("size(spans) = 0")).collect()} == {0}
