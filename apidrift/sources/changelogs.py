"""Changelog documents (JSON) as tables of versions and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.functions.versions import version_key

# Fields of a rule, of a version and of a document.
RULE_FIELDS = {
    "id": "string", "change_type": "string", "version_introduced": "string", "description": "string",
    "old_name": "string", "new_name": "string", "function_name": "string", "argument_name": "string",
    "new_argument_name": "string", "default_value": "string", "argument_position": "int",
    "new_argument_value": "string", "new_order": "array<string>", "old_module": "string",
    "new_module": "string", "replacement": "string", "removal_version": "string",
    "decorator_name": "string", "source_module": "string", "target_module": "string",
    "extra": "string", "tags": "array<string>", "safety": "string",
}
VERSION_FIELDS = ("version", "release_date", "rules", "raw_notes", "notes")
DOCUMENT_FIELDS = ("library", "schema_version", "generated", "versions")

RULE_DDL = ", ".join(f"{k} {v}" for k, v in RULE_FIELDS.items())
_VERSION_DDL = "version string, release_date string, rules array<string>, raw_notes string, notes string"
_DOCUMENT_DDL = "library string, schema_version string, generated string, versions array<string>"


def looks_like_json(content: Column) -> Column:
    return F.regexp_replace(content, r"^\s+", "").rlike(r"^[{\[]")


def is_bare_list(content: Column) -> Column:
    return F.regexp_replace(content, r"^\s+", "").startswith("[")


def documents(docs: DataFrame, fmt: str = "auto") -> DataFrame:
    """``docs(doc_id, content)`` -> header columns, raw JSON of each version, ``error``.

    A document is an object or a bare list of versions (library ``unknown``). What is
    neither gets an ``error`` instead of versions.
    """
    if fmt not in ("auto", "json"):
        raise ValueError(f"Unsupported format: {fmt}")
    content = F.col("content")
    accepted = F.lit(True) if fmt == "json" else looks_like_json(content)
    listed = is_bare_list(content)
    head = F.from_json(F.when(accepted & ~listed, content), _DOCUMENT_DDL)
    return docs.select(
        "doc_id", "content", listed.alias("bare_list"), head.alias("head"),
        F.from_json(F.when(accepted & listed, content), "array<string>").alias("items"),
        accepted.alias("accepted"),
        F.json_object_keys(F.when(accepted & ~listed, content)).alias("keys"),
    ).select(
        "doc_id", "content", "bare_list", "keys",
        F.when(F.col("bare_list"), F.lit("unknown")).otherwise(F.col("head.library")).alias("library"),
        F.col("head.schema_version").alias("schema_version"), F.col("head.generated").alias("generated"),
        F.coalesce("items", "head.versions", F.array()).alias("raw_versions"),
        F.when(~F.col("accepted"), f"Unsupported format or could not auto-detect JSON: {fmt}")
        .when(F.col("bare_list") & F.col("items").isNull(), "Invalid JSON")
        .when(~F.col("bare_list") & F.col("keys").isNull(), "Invalid JSON").alias("error"),
    )


def _version_rows(docs: DataFrame, fmt: str, explode, *carry: str) -> DataFrame:
    return (
        documents(docs, fmt)
        .select("doc_id", "library", *carry, explode("raw_versions").alias("vpos", "raw_version"))
        .withColumn("v", F.from_json("raw_version", _VERSION_DDL))
        .select(
            "doc_id", "library", *carry, "vpos", "raw_version", F.col("v.version").alias("version"),
            version_key("v.version").alias("version_key"), F.col("v.release_date").alias("release_date"),
            F.coalesce("v.raw_notes", F.lit("")).alias("raw_notes"), F.col("v.notes").alias("notes"),
            F.coalesce("v.rules", F.array()).alias("raw_rules"),
        )
    )


def versions(docs: DataFrame, fmt: str = "auto") -> DataFrame:
    """One row per version of each document, in document order (``vpos``)."""
    return _version_rows(docs, fmt, F.posexplode).withColumn("n_rules", F.size("raw_rules"))


def count_rules(version_rows: DataFrame, *keys: str) -> DataFrame:
    """Rules per key (``library``, or ``library, version``) of ``versions``; versions without rules count 0."""
    return version_rows.groupBy(*keys).agg(F.sum("n_rules").alias("n_rules"))


def _rule_columns():
    defaults = {
        "extra": F.coalesce("r.extra", F.lit("{}")), "tags": F.coalesce("r.tags", F.array()),
        "safety": F.coalesce("r.safety", F.lit("safe")),
    }
    return [defaults.get(f, F.col(f"r.{f}")).alias(f) for f in RULE_FIELDS]


def read_changelogs(docs: DataFrame, fmt: str = "auto") -> DataFrame:
    """One row per rule; ``pos`` is its place within its version."""
    keys = ("doc_id", "library", "vpos", "version", "version_key", "release_date")
    return (
        versions(docs, fmt).select(*keys, F.posexplode("raw_rules").alias("pos", "raw_rule"))
        .withColumn("r", F.from_json("raw_rule", RULE_DDL))
        .select(*keys, "pos", "raw_rule", *_rule_columns())
    )


def rule_rows(docs: DataFrame, fmt: str = "auto") -> DataFrame:
    """Like ``read_changelogs``, but documents and versions without content keep one row."""
    keys = ("doc_id", "library", "keys", "error", "vpos", "version", "raw_version")
    return (
        _version_rows(docs, fmt, F.posexplode_outer, "keys", "error")
        .select(*keys, F.posexplode_outer("raw_rules").alias("pos", "raw_rule"))
        .withColumn("r", F.from_json("raw_rule", RULE_DDL))
        .select(*keys, "pos", "raw_rule", *_rule_columns())
    )


def rule_struct(drop: tuple[str, ...] = ()) -> Column:
    return F.struct(*[F.col(f) for f in RULE_FIELDS if f not in drop])


def rule_json() -> Column:
    """A rule as JSON; absent fields are left out. ``extra`` is put back as raw JSON."""
    body = F.to_json(rule_struct(drop=("extra",)))
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"extra":'), F.col("extra"), F.lit("}"))


def parse_rule_json(raw: Column) -> Column:
    return F.from_json(raw, RULE_DDL)


def flatten_rules(rules: DataFrame) -> DataFrame:
    """``ordinal`` of every rule within its document, by version order then position.

    The running count goes over the versions of a document; the rules themselves are
    only shifted by their version's offset.
    """
    by_version = Window.partitionBy("doc_id").orderBy("version_key", "vpos")
    offsets = (
        rules.groupBy("doc_id", "version_key", "vpos").agg(F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(
            F.sum("n").over(by_version.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("doc_id", "vpos", "offset")
    )
    return rules.join(offsets, ["doc_id", "vpos"]).withColumn(
        "ordinal", (F.col("offset") + F.col("pos") + 1).cast("int")
    ).drop("offset")


def export_rules(version_rows: DataFrame, rules: DataFrame, generated: str | None = None) -> DataFrame:
    """Documents in the exchange form (without notes): ``doc_id, content``."""
    per_version = rules.groupBy("doc_id", "vpos").agg(
        F.array_sort(F.collect_list(F.struct("pos", rule_json().alias("json")))).alias("rs")
    )
    quoted = lambda c: F.coalesce(F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"), F.lit("null"))
    one = F.concat(
        F.lit('{"version":'), quoted("version"), F.lit(',"release_date":'), quoted("release_date"),
        F.lit(',"rules":['),
        F.coalesce(F.array_join(F.transform("rs", lambda r: r["json"]), ","), F.lit("")), F.lit("]}"),
    )
    return (
        version_rows.join(per_version, ["doc_id", "vpos"], "left")
        .groupBy("doc_id", "library")
        .agg(F.array_sort(F.collect_list(F.struct("vpos", one.alias("json")))).alias("vs"))
        .select("doc_id", F.concat(
            F.lit('{"library":'), quoted("library"),
            F.lit(f',"generated":"{generated}"' if generated else ""),
            F.lit(',"versions":['), F.array_join(F.transform("vs", lambda v: v["json"]), ","), F.lit("]}"),
        ).alias("content"))
    )


def merge_changelogs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Version rows that only ``new`` has; a version repeated in ``new`` keeps its last row."""
    columns = new.columns
    last = new.groupBy("library", "version").agg(F.max_by(F.struct(*columns), F.col("vpos")).alias("row"))
    return last.select("row.*").join(old.select("library", "version").distinct(), ["library", "version"], "left_anti")


def update_changelogs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old version rows followed by the added ones."""
    return old.unionByName(merge_changelogs(old, new))
