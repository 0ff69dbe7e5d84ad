"""Mixing by soft membership: document rates whose expected domain totals meet target weights.

A labelled table teaches a softmax classifier on hashed words; it gives every document posteriors over
the domains. Non-negative rates r then minimise

    1/2 sum_k (m_k - g_k)^2 / c_k + ridge/2 sum_d w_d (r_d - 1)^2,    m_k = sum_d w_d p_dk r_d

with w_d the document's share of all tokens, c_k the domain's share, g_k the wanted total. The solver is accelerated
projected gradient. A step needs the K residuals only, so an iteration is one aggregation of a
K-vector over all documents, and a document's rate is replayed from the short history of residuals: no
state is stored between iterations, and a lost executor costs one recomputed task.

The classifier is fitted in numpy on at most ``TRAIN_ROWS`` labelled documents, chosen by the hash of their id; all
else covers every document. ``copies`` rounds the rate by the hash of the id, so totals hold in expectation.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.llm.tables import frugal, small_batches, whole, written

TRAIN_ROWS = 8_000
BITS = 16
EPOCHS, LEARNING_RATE, DECAY = 60, 0.05, 1e-3
RIDGE = 1e-3
#: The solver stops at this relative miss of the targets, or after so many steps; ``target_miss`` tells what was reached.
TOLERANCE, MOST_STEPS = 2e-3, 200
#: Words whose bucket a task remembers.
KNOWN_WORDS = 100_000

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = at = zlib.crc32(word) >> (32 - BITS)
        return at


def features(text: str, buckets: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Buckets of the distinct words, of the shares of symbols and capitals and of repetition; number of words."""
    raw = text.encode("utf-8", "replace")
    n = len(raw.split())
    if not n:
        return np.array([buckets[b"\0none"]]), 0
    words = raw.lower().translate(_SPLIT).split()
    distinct = set(words)
    level = lambda part, of: int(math.log2(1 + 64 * part / max(of, 1)))
    marks = (
        b"\0symbols%d" % level(len(_SYMBOLS.findall(raw)), len(raw)),
        b"\0capitals%d" % level(sum(map(raw.count, map(bytes, zip(range(65, 91))))), len(raw)),
        b"\0repeats%d" % level(len(words) - len(distinct), len(words)), b"\0exclaims%d" % level(raw.count(b"!"), len(raw)),
        b"\0length%d" % int(math.log2(n)),
    )
    return np.unique(np.fromiter(map(buckets.__getitem__, (*distinct, *marks)), np.int64, len(distinct) + len(marks))), n


class Softmax:
    """Multinomial logistic regression on sets of buckets."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray) -> None:
        self.weights, self.bias = weights, bias

    @classmethod
    def train(cls, rows: list[np.ndarray], golds: np.ndarray, k: int) -> Softmax:
        """Adam on the mean log-likelihood with weight decay; the same rows give the same model."""
        flat = np.concatenate(rows)
        of = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        gold = np.eye(k)[golds]
        parts = [np.zeros((1 << BITS, k)), np.log(gold.mean(axis=0) + 1e-6)]
        slopes, sizes = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for epoch in range(1, EPOCHS + 1):
            logits = np.stack([np.bincount(of, parts[0][flat, i], len(rows)) for i in range(k)], 1) + parts[1]
            wrong = gold - _softmax(logits)
            grads = [np.stack([np.bincount(flat, wrong[of, i], 1 << BITS) for i in range(k)], 1) / len(rows), wrong.mean(axis=0)]
            grads[0] -= DECAY * parts[0] / len(rows)
            for i, grad in enumerate(grads):
                slopes[i] = 0.9 * slopes[i] + 0.1 * grad
                sizes[i] = 0.99 * sizes[i] + 0.01 * grad ** 2
                parts[i] += LEARNING_RATE * (slopes[i] / (1 - 0.9 ** epoch)) / (np.sqrt(sizes[i] / (1 - 0.99 ** epoch)) + 1e-6)
        return cls(parts[0].astype(np.float32), parts[1])

    def posteriors(self, row: np.ndarray) -> np.ndarray:
        return _softmax(self.weights[row].sum(axis=0, dtype=np.float64) + self.bias)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a quality table: toxic, junk or clean; rows without labels are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def fit(docs: DataFrame, domains: DataFrame, id_col: str, text_col: str) -> tuple[list[str], Softmax | None]:
    """Domains in alphabetical order and the classifier; None without labelled documents."""
    chosen = domains.select(F.col(id_col).alias("label_id"), "domain").where("domain is not null").distinct().orderBy(
        F.xxhash64("label_id"), "label_id", "domain").limit(TRAIN_ROWS)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            rows = [features(text, buckets)[0].tolist() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(rows, pa.list_(pa.int32())), batch.column("domain")], names=["id", "at", "domain"])

    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("id", "text", "domain").mapInArrow(
        frugal(extract), f"id {kind}, at array<int>, domain string")
    # An id may stand at several rows, however many: one of them is enough, and only one leaves its task.
    sample = sample.groupBy("id", "domain").agg(F.min("at").alias("at"))
    held = sorted(sample.toArrow().to_pylist(), key=lambda r: (str(r["id"]), r["domain"], r["at"]))
    names = sorted({r["domain"] for r in held})
    if not held:
        return [], None
    golds = np.array([names.index(r["domain"]) for r in held])
    return names, Softmax.train([np.array(r["at"], np.int64) for r in held], golds, len(names))


def _replay(p: np.ndarray, history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates and the accelerated point after the recorded steps; a step's residuals are all it needs."""
    rate = ahead = np.ones(len(p))
    for i, pull in enumerate(history):
        new = np.maximum(ahead - (p @ np.array(pull) + RIDGE * (ahead - 1)) / (1 + RIDGE), 0)
        ahead = new + i / (i + 3) * (new - rate)
        rate = new
    return rate, ahead


def _totals(scored: DataFrame, k: int, history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by domain at the rates and at the accelerated point: one aggregation over all documents."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(-1, k)
            weighted = batch.column("n").to_numpy()[:, None] * p
            for kind, rate in enumerate(_replay(p, history)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(rate @ weighted, pa.float64())], names=["kind", "k", "x"])

    out = np.zeros((2, k))
    for r in scored.select("n", "p").mapInArrow(frugal(sums), "kind int, k int, x double").groupBy("kind", "k").agg(F.sum("x").alias("x")).collect():
        out[r["kind"], r["k"]] = r["x"]
    return out[0], out[1]


def mix(
    docs: DataFrame, domains: DataFrame, targets: Mapping[str, float], headroom: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
    anchor: str | None = None, row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, n_tokens (words), posteriors (map by domain), rate, copies, target_miss; and ``row_col``, if one is named.

    ``domains`` is the labelled table (id, domain); ``targets`` weighs its domains, the missing ones with 0. The wanted total
    is ``headroom`` times the largest that no domain has to be repeated for. With an ``anchor`` it is ``headroom`` times the total for
    which that domain is used once: the others are wanted at their weight, or as a whole where they have less, and if no label names
    the anchor all rates are 1. A null or empty text has no tokens and bears on no total;
    it gets the rate of its posteriors. ``target_miss`` (the same in all rows) is the largest miss of a wanted domain total at the rates, relative to the
    largest total: above ``TOLERANCE`` the targets cannot be met with nonnegative rates, or not in ``MOST_STEPS`` steps. Without labelled documents all rates are 1 and posteriors null. Repeated
    rows each get a result; an empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    names, model = fit(docs, domains, id_col, text_col)
    own = ["row"] if row_col else []
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), *(F.col(row_col).alias(name) for name in own))
    own_type = "".join(f", row {dict(docs.dtypes)[row_col]}" for _ in own)
    named = [F.col(name).alias(row_col) for name in own]
    k = len(names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            found = [features(text, buckets) for text in batch.column("text").to_pylist()]
            p = [model.posteriors(at).tolist() if model else None for at, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([n for _, n in found], pa.int64()), pa.array(p, pa.list_(pa.float64())),
                 *map(batch.column, own)], names=["id", "n", "p", *own])

    scored = texts.mapInArrow(frugal(score), f"id {kind}, n long, p array<double>{own_type}")
    if not model:
        return scored.select(
            F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.lit(None).cast("map<string,double>").alias("posteriors"),
            F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), F.lit(0.0).alias("target_miss"), *named)
    scored = written(scored, "posteriors")
    history, miss = solve(scored, names, targets, headroom, anchor)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_replay(p, history)[0])], names=["id", "n", "p", *own, "rate"])

    rated = scored.mapInArrow(frugal(rate), f"id {kind}, n long, p array<double>{own_type}, rate double")
    return rated.select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"),
        F.map_from_arrays(F.array(*map(F.lit, names)), "p").alias("posteriors"), "rate", _rounded(F.col("rate"), "id", "n", "p").alias("copies"), F.lit(miss).alias("target_miss"), *named)


def solve(
    scored: DataFrame, names: list[str], targets: Mapping[str, float], headroom: float, anchor: str | None = None,
) -> tuple[list[list[float]], float]:
    """Residual history of the accelerated projected gradient over documents (n, p), and the relative miss it leaves."""
    k = len(names)
    weights = np.array([targets.get(name, 0.0) for name in names])
    now, _ = _totals(scored, k, [])
    total = now.sum()
    if not weights.sum() or not total:
        return [], 0.0
    weights = weights / weights.sum()
    share = np.maximum(now / total, 1e-9)
    some = weights > 0
    if anchor is None:
        want = headroom * weights * (share[some] / weights[some]).min()
    elif anchor not in names or not targets.get(anchor):
        return [], 0.0
    else:
        of = names.index(anchor)
        want = headroom * weights * share[of] / weights[of]
        want = np.where(np.arange(k) == of, want, np.minimum(want, share))
    history: list[list[float]] = []
    ahead = share
    for _ in range(MOST_STEPS):
        history.append(((ahead - want) / share).tolist())
        at, ahead = (x / total for x in _totals(scored, k, history))
        miss = float(np.abs(at - want).max() / want.max())
        if miss <= TOLERANCE:
            break
    return history, miss


def _rounded(rate: Column, *key: str) -> Column:
    """Rate rounded up with the probability of its fraction, by the hash of the key."""
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), *key), 11) / float(1 << 53)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
