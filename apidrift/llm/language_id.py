"""Language identification by Bayesian fusion of text, markup, address and host.

``log P(lang | row) = temper * log P(text | lang) + log P(declared | lang) + log P(lang | host) + const``

* text: hashed byte trigrams of the lower-cased letters, one multinomial per declared language, however rare. About
  ``SAMPLE_ROWS`` rows are divided evenly among the languages (``LEAST_ROWS`` each at least), chosen by hash; a language with fewer
  rows is learned from all of them. What a language has not been seen with gets the share of first occurrences in its text;
* background: text of no language, all trigrams alike. Its posterior counts against that of the languages, so that
  a text whose trigrams no language has is rejected;
* declared language: how often each declaration meets each language by text, over all rows. Only a declaration whose primary subtag has two
  letters is one (``en`` of ``en-GB``), so there are 676 at most; any other string counts as none;
* host: language counts by host over all rows, smoothed towards those of the host's address suffix,
  which are smoothed towards those of the whole table.

The counts are grouped aggregations of one small row per text; texts are read in the scan only. The model that
goes to the executors has ``2 ** BITS`` numbers for each of ``DENSE_MOST`` languages and the seen trigrams of the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.llm.tables import frugal, small_batches, whole, written

BITS = 15
SAMPLE_ROWS, LEAST_ROWS = 10_000, 500
#: Languages with a full column in the model.
DENSE_MOST = 64
#: Share of texts of no language before any evidence.
BACKGROUND = 0.01
#: Log-likelihoods further below the best are cut off here: no declaration and no host makes up for that much.
FURTHEST = 1000.0
#: Trigrams overlap; their evidence counts this much.
TEMPER = 0.2
#: Pseudo-counts of the wider group in the narrower one.
SMOOTHING = 10.0
#: Least posterior of a row that is kept, and least number of letters.
LEAST_POSTERIOR, LEAST_LETTERS = 0.6, 3
#: Parts that a hot declaration or host is dealt to when the small table of declarations or hosts is joined; a host is hot
#: from this share of all rows on, so there are no more of them than its inverse.
SALTS, HOT_SHARE = 16, 0.001

#: Log-probability of each trigram in the background.
UNIFORM = -BITS * float(np.log(2))

_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def trigrams(text: str) -> tuple[np.ndarray, int]:
    """Hashes of the byte trigrams of a text's letters, and the number of letter bytes."""
    folded = text.lower().encode("utf-8", "replace").translate(_FOLD)
    codes = np.frombuffer(b" " + b" ".join(folded.split()) + b" ", np.uint8).astype(np.uint32)
    letters = int((codes != 32).sum())
    if not letters:
        return np.zeros(0, np.int64), 0
    joint = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    return ((joint * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), letters


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, host) of raw pages: visible text, ``lang`` attribute, address."""
    html, url = whole("html"), whole("url")
    drop = r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>"
    blank = lambda c: F.when(c != "", c)
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://([^/?#:]+)", 1))
    return pages.select(
        "page_id", F.regexp_replace(html, drop, " ").alias("text"),
        blank(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1))).alias("declared"),
        blank(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"), blank(host).alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, declared, suffix, host) of documents; their source stands for the host."""
    return docs.select(
        "doc_id", whole("text").alias("text"), F.lower("lang").alias("declared"),
        F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"),
    )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("declared").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen = np.bincount(trigrams(text)[0], minlength=1 << BITS)
            by_lang[lang] = by_lang.get(lang, 0) + seen
        for lang, seen in by_lang.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(seen[at].astype(np.int64))],
                names=["lang", "bucket", "n"])


class Model:
    """Log-probabilities of trigrams by language: columns of the languages seen with most, sparse rows of the others."""

    def __init__(self, langs: list[str], found: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = langs
        size = {lang: len(found[lang][0]) if lang in found else 0 for lang in langs}
        dense = sorted(sorted(langs, key=lambda lang: (-size[lang], lang))[:DENSE_MOST])
        self.dense = np.array([langs.index(lang) for lang in dense], np.int64)
        self.sparse = np.setdiff1d(np.arange(len(langs)), self.dense)
        self.table = np.empty((1 << BITS, len(dense)), np.float32)
        self.unseen = np.zeros(len(self.sparse))
        at, of, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for places, column in ((self.dense, True), (self.sparse, False)):
            for i, lang in enumerate(langs[j] for j in places):
                buckets, n = found.get(lang, (np.zeros(0, np.int64), np.zeros(0)))
                total = n.sum() + len(buckets)
                rest = len(buckets) / (1 << BITS)
                unseen = np.log(rest / total) if total else UNIFORM
                seen = np.log((n + rest) / total) if total else np.zeros(0)
                if column:
                    self.table[:, i] = unseen
                    self.table[buckets, i] = seen
                else:
                    self.unseen[i] = unseen
                    at.append(buckets)
                    of.append(np.full(len(buckets), i))
                    more.append(seen - unseen)
        order = np.argsort(np.concatenate(at), kind="stable")
        self.of, self.more = np.concatenate(of)[order].astype(np.int32), np.concatenate(more)[order].astype(np.float32)
        self.starts = np.searchsorted(np.concatenate(at)[order], np.arange((1 << BITS) + 1))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Log-likelihood of a text by language."""
        out = np.zeros(len(self.langs))
        for i in range(0, len(hashes), 65536):
            out[self.dense] += self.table[hashes[i:i + 65536]].sum(axis=0, dtype=np.float64)
        if len(self.sparse):
            buckets, n = np.unique(hashes, return_counts=True)
            held = self.starts[buckets + 1] - self.starts[buckets]
            at = np.arange(held.sum()) + np.repeat(self.starts[buckets] - (np.cumsum(held) - held), held)
            out[self.sparse] = len(hashes) * self.unseen + np.bincount(
                self.of[at], self.more[at] * np.repeat(n, held), len(self.sparse))
        return out


def fit(rows: DataFrame, keys: Sequence[str]) -> Model:
    """The model of all declared languages."""
    named = rows.where(F.col("declared").isNotNull() & (F.col("declared") != ""))
    sizes = {r["declared"]: r["n"] for r in named.groupBy("declared").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {})
    quota = max(LEAST_ROWS, SAMPLE_ROWS // len(sizes))
    rates = rows.sparkSession.createDataFrame([(lang, quota / n) for lang, n in sizes.items()], "of string, rate double")
    chance = F.shiftrightunsigned(F.xxhash64(*keys, "text"), 11) / float(1 << 53)
    sample = named.join(F.broadcast(rates), F.col("declared") == F.col("of")).where(chance < F.col("rate")).select("declared", "text")
    counts = sample.mapInArrow(frugal(_counts), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(sorted(sizes), {
        lang: (part.bucket.to_numpy(), part.n.to_numpy()) for lang, part in counts.toPandas().groupby("lang")})


def _scored(rows: DataFrame, keys: Sequence[str], model: Model) -> DataFrame:
    kept = [*keys, "declared", "suffix", "host"]
    types = dict(rows.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, letters, best, none = [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes, n = trigrams(text)
                sums = model.sums(hashes)
                top, noise = sums.max(), len(hashes) * UNIFORM
                scores.append(np.maximum(sums - top, -FURTHEST).tolist())
                letters.append(n)
                none.append(min(noise - top, FURTHEST))
                best.append(int(sums.argmax()) if n and noise <= top else None)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in kept), pa.array(letters, pa.int64()),
                pa.array(scores, pa.list_(pa.float64())), pa.array(best, pa.int32()), pa.array(none, pa.float64()),
            ], names=[*kept, "letters", "scores", "guess", "noise"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in kept) + ", letters long, scores array<double>, guess int, noise double"
    return rows.select(*kept, "text").mapInArrow(frugal(score), schema)


def _by_language(frame: DataFrame, key: str, n_langs: int, name: str) -> DataFrame:
    """Rows per language, by text, of each value of a column."""
    counts = frame.where(F.col(key).isNotNull() & F.col("guess").isNotNull()).groupBy(F.col(key).alias(f"{name}_key"), "guess").agg(
        F.count("*").cast("double").alias("n"), F.min("suffix").alias("suffix"))
    held = counts.groupBy(f"{name}_key").agg(
        F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("held"), F.min("suffix").alias(f"{name}_suffix"))
    each = F.sequence(F.lit(0), F.lit(n_langs - 1))
    return held.select(f"{name}_key", F.transform(each, lambda i: F.coalesce(
        F.try_element_at("held", i), F.lit(0.0))).alias(name), f"{name}_suffix")


def _smoothed(counts: Column, prior: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, prior, lambda n, p: (n + SMOOTHING * p) / (total + SMOOTHING))


def identify(rows: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per input row: keys, declared, host, lang, posterior, kept.

    ``rows`` has the keys and text, declared, suffix, host, each of which may be null (missing evidence
    is left out). Rejected (``kept`` false): fewer than ``LEAST_LETTERS`` letters, or no language with a posterior of
    ``LEAST_POSTERIOR``, be it that others or the background come close. Ties go to the language first in the alphabet. If no row declares a language there is no
    model: lang and posterior are null and only rows without letters are rejected. Repeated rows each
    get a result; an empty table gives no rows. Other columns are ignored.
    """
    small_batches(rows.sparkSession)
    subtag = F.regexp_extract(F.lower(F.trim("declared")), "^([a-z]{2})(?:[-_].*)?$", 1)
    rows = rows.select(*keys, whole("text").alias("text"), F.when(subtag != "", subtag).alias("declared"), "suffix", "host")
    model = fit(rows, keys)
    langs, n = model.langs, len(model.langs)
    if not n:
        count = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
        return rows.select(*keys, "declared", "host", F.lit(None).cast("string").alias("lang"),
                           F.lit(None).cast("double").alias("posterior"), (count >= LEAST_LETTERS).alias("kept"))
    scored = written(_scored(rows, keys, model), "language-scores").withColumn(
        "salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    counts = {r["guess"]: r["n"] for r in scored.groupBy("guess").agg(F.count("*").alias("n")).collect()}
    seen = [counts.get(i, 0) for i in range(n)]
    total = sum(seen)
    overall = F.array(*(F.lit((seen[i] + 1) / (total + n)) for i in range(n)))
    suffixes = _by_language(scored, "suffix", n, "s").select("s_key", _smoothed(F.col("s"), overall).alias("s"))
    hosts = _by_language(scored, "host", n, "h")
    hot = [r["host"] for r in scored.groupBy("host").agg(F.count("*").alias("n")).where(
        (F.col("n") >= HOT_SHARE * (total + 1)) & F.col("host").isNotNull()).orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).collect()]
    dealt = lambda key: F.col(key).isin(hot) if hot else F.lit(False)
    hosts = hosts.join(suffixes, F.col("h_suffix") == F.col("s_key"), "left").select(
        "h_key", _smoothed(F.col("h"), F.coalesce("s", overall)).alias("h"),
        F.explode(F.when(dealt("h_key"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("h_salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    declared = _by_language(scored, "declared", n, "d")
    kinds = declared.count()
    spoken = declared.select("d_key", F.transform("d", lambda c, i: F.log(
        (c + 1) / (F.get(F.array(*(F.lit(float(seen[j])) for j in range(n))), i) + kinds))).alias("d"),
        F.log((F.aggregate("d", F.lit(0.0), lambda a, c: a + c) + 1) / (total + kinds)).alias("d_noise"), salts.alias("d_salt"))
    host_salt = F.when(dealt("host"), F.col("salt")).otherwise(0)
    fused = scored.join(hosts, (F.col("host") == F.col("h_key")) & (host_salt == F.col("h_salt")), "left").join(
        spoken, (F.col("declared") == F.col("d_key")) & (F.col("salt") == F.col("d_salt")), "left",
    )
    none = F.transform("scores", lambda _: F.lit(0.0))
    logs = F.zip_with(
        F.zip_with("scores", F.coalesce("d", none), lambda a, b: TEMPER * a + b),
        F.coalesce("h", overall), lambda a, p: a + F.log(p))
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    norm = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    # The background meets declarations as all rows do, and no host more than another.
    noise = F.exp(TEMPER * F.col("noise") + F.coalesce("d_noise", F.lit(0.0)) + float(np.log(BACKGROUND)) - F.col("top"))
    return fused.withColumn("posterior", 1 / (norm + noise)).select(
        *keys, "declared", "host",
        F.get(F.array(*map(F.lit, langs)), (F.array_position("logs", F.col("top")) - 1).cast("int")).alias("lang"), "posterior",
        ((F.col("letters") >= LEAST_LETTERS) & (F.col("posterior") >= LEAST_POSTERIOR)).alias("kept"),
    )
