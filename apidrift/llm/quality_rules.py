"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document when a ratio (symbols per character, repeated lines per line, ...)
exceeds a cutoff. Cutoffs are not chosen by hand. For each stratum and rule a fixed grid is tested from the
loosest cutoff to the strictest. The null hypothesis "this cutoff rejects more than ``false_rate`` of the good
documents" is dismissed when the exact binomial probability of as few rejections as the labelled
good documents show is at most the level. Testing stops at the first hypothesis that stands
(fixed sequence: no correction within a rule); over rules and strata the level is divided (Bonferroni),
and so is the permitted rate over the rules. With probability ``1 - delta`` every
stratum therefore loses at most ``max_false_rejection`` of its good documents to all rules together.
A stratum with too few labels gets no cutoffs.

Everything is DataFrame code. Measures are taken row by row; only rows of numbers are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.llm.tables import BLANKS, whole, written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

#: Rule name: (count, what it is counted in).
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "exclaims": ("n_exclaims", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs are i / GRID, from GRID - 1 (loosest) down to 1.
GRID = 50
#: Parts of a stratum when its rows are joined with its cutoffs.
SALTS = 64


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts of every whole text, computed within its row.

    A null or blank text has no words and all counts 0. A window is a run of eight words, compared by
    chained 64-bit hashes within one text.
    """
    text = F.col("text")
    rows = docs.select(
        F.col(id_col).alias("id"), whole(F.col(stratum).cast("string")).alias("stratum"), whole(text_col).alias("text"),
    )
    trimmed = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    counted = rows.select(
        "id", "stratum",
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        *(
            (F.length(text) - F.length(F.translate(text, marks, ""))).cast("long").alias(name)
            for name, marks in (("n_symbols", SYMBOLS), ("n_capitals", CAPITALS), ("n_exclaims", "!"))
        ),
        lines.alias("lines"),
    ).select(
        "id", "stratum", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_capitals",
        "n_exclaims", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"),
    )
    # Hashes of one word become hashes of two, four and eight words.
    for span in (1, 2, 4):
        counted = counted.withColumn("hashes", F.zip_with(
            "hashes", F.slice("hashes", F.lit(span + 1), F.greatest(F.size("hashes"), F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    counted = counted.withColumn("hashes", F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = counted.withColumn("windows", F.when(repeats, F.sort_array(
        F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("hashes")
    same = lambda w, i: F.coalesce(F.get(F.col("windows"), i)["h"] == w["h"], F.lit(False))
    placed = placed.withColumn("windows", F.sort_array(F.transform(
        F.filter("windows", lambda w, i: same(w, i - 1) | same(w, i + 1)), lambda w: w["i"])))
    covered = F.aggregate(
        "windows", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, at: F.struct(
            (at + WINDOW).alias("end"),
            (a["n"] + F.least(F.lit(WINDOW), at + WINDOW - a["end"])).alias("n")),
        lambda a: a["n"])
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows")


def _ratio(rule: str) -> Column:
    count, base = RULES[rule]
    return F.coalesce(F.try_divide(F.col(count), F.col(base)), F.lit(0.0))


def at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), summed in logarithms; 1 for k above the mean,
    where no use is made of it."""
    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log(n - i + 1) - F.log(i) + math.log(rate / (1 - rate))
        high, low = F.greatest(state["sum"], term), F.least(state["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    none = n.cast("double") * math.log1p(-rate)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(none.alias("term"), none.alias("sum")), add, lambda s: F.exp(s["sum"]))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(total)


def cutoffs(
    measured: DataFrame, labels: DataFrame, max_false_rejection: float = 0.02, delta: float = 0.05,
    id_col: str = "doc_id", label_col: str = "quality",
) -> DataFrame:
    """Certified cutoffs: (stratum, n_good, limits), limits a map from rule to cutoff.

    ``labels`` has 1 for good documents; a document with several labels is good if any says so,
    labels without a document or without a value do not count.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("good_id")).distinct()
    held = measured.join(good, F.col("id") == F.col("good_id")).select("stratum", F.inline(F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.ceil(_ratio(rule) * GRID).cast("int").alias("step")) for rule in RULES))))
    # A ratio exceeds cutoff c / GRID exactly when its step, rounded up, is above c.
    seen = held.groupBy("stratum", "rule", "step").agg(F.count("*").alias("n"))
    size = seen.where(F.col("rule") == next(iter(RULES))).groupBy("stratum").agg(F.sum("n").alias("n_good"))
    strata = max(1, size.count())
    level, rate = delta / (strata * len(RULES)), max_false_rejection / len(RULES)
    grid = size.select("stratum", "n_good", F.explode(F.array(*map(F.lit, RULES))).alias("rule")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(GRID))).alias("cutoff"))
    steps = seen.select("stratum", "rule", (F.greatest(F.least("step", F.lit(GRID + 1)), F.lit(1)) - 1).alias("cutoff"), "n")
    loosest_first = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    tested = grid.join(
        steps.groupBy("stratum", "rule", "cutoff").agg(F.sum("n").alias("n")), ["stratum", "rule", "cutoff"], "left",
    ).withColumn("rejected", F.coalesce(F.sum("n").over(loosest_first), F.lit(0)).cast("long"))
    passed = (at_most(F.col("rejected"), F.col("n_good"), rate) <= level).cast("int")
    chosen = tested.withColumn("passed", passed).withColumn("all_passed", F.min("passed").over(loosest_first)).where(
        (F.col("all_passed") == 1) & (F.col("cutoff") < GRID)
    ).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.max("n_good").alias("n_good"))
    return chosen.groupBy("stratum").agg(
        F.max("n_good").alias("n_good"),
        F.map_from_entries(F.collect_list(F.struct("rule", F.col("cutoff") / GRID))).alias("limits"))


def apply_rules(
    docs: DataFrame, labels: DataFrame, max_false_rejection: float = 0.02, delta: float = 0.05,
    id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang",
) -> DataFrame:
    """One row per document: id, counts, base_failed, kept, broken_rules.

    Base: fewer than 20 words, or more than 30 % of them in repeated eight-word windows. A null
    stratum is a stratum of its own; strata without certified cutoffs lose documents to
    the base only. Repeated rows each get their verdict; an empty table gives no rows, empty labels no cutoffs.
    Other columns are ignored.
    """
    measured = written(measures(docs, id_col, text_col, stratum), "quality-measures")
    # A stratum may hold most rows: they meet their cutoffs in SALTS parts.
    limits = cutoffs(measured, labels, max_false_rejection, delta, id_col).select(
        F.col("stratum").alias("of"), "limits", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.array_compact(F.array(*(
        F.when(_ratio(rule) > F.element_at("limits", F.lit(rule)), F.lit(rule)) for rule in RULES)))
    judged = salted.join(limits, (F.col("stratum") == F.col("of")) & (F.col("salt") == F.col("part")), "left").withColumns({
        "base_failed": base_failed, "broken_rules": broken})
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"), F.array_join("broken_rules", ",").alias("broken_rules"),
    )
