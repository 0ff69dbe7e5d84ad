"""Rule validation: every problem is a row ``doc_id, location, rule_id, kind, detail``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apidrift.functions.lexing import expression_valid, let
from apidrift.functions.versions import is_version
from apidrift.sources.changelogs import (
    DOCUMENT_FIELDS, RULE_FIELDS, VERSION_FIELDS, rule_rows,
)

# The accepted change types and safety levels.
CHANGE_TYPES = (
    "rename_function", "rename_class", "rename_attribute", "rename_import", "add_argument",
    "remove_argument", "rename_argument", "change_argument_default", "reorder_arguments", "deprecate_function",
    "remove_function", "remove_class", "change_return_type", "replace_with_property",
    "move_to_module", "wrap_in_context_manager", "add_decorator", "remove_decorator",
)
SAFETY_LEVELS = ("safe", "review_required", "risky")
# Fields every rule has, and the fields each change type needs.
REQUIRED_FIELDS = ("id", "change_type", "version_introduced", "description")
NEEDED_FIELDS = {
    "rename_function": ("old_name", "new_name"),
    "rename_class": ("old_name", "new_name"),
    "rename_attribute": ("old_name", "new_name"),
    "rename_import": ("old_module", "new_module", "old_name", "new_name"),
    "add_argument": ("function_name", "argument_name"),
    "remove_argument": ("function_name", "argument_name"),
    "rename_argument": ("function_name", "argument_name", "new_argument_name"),
    "change_argument_default": ("argument_name", "default_value"),
    "reorder_arguments": ("function_name", "new_order"),
    "deprecate_function": ("old_name",),
    "move_to_module": ("old_name", "source_module", "target_module"),
    "add_decorator": ("function_name", "decorator_name"),
    "remove_decorator": ("function_name", "decorator_name"),
    "replace_with_property": ("old_name", "new_name"),
}
RENAMES_CHECKED = ("rename_function", "rename_class", "rename_attribute")


def _at_rule() -> Column:
    return F.format_string("versions -> %s -> rules -> %s", F.col("vpos"), F.col("pos"))


def _problems(kind: str, details: Column, location: Column, rule_id: Column) -> Column:
    """Array of problem structs for an array of details (null details are no problem); no problem has a ``value``."""
    return F.transform(
        F.filter(details, lambda d: d.isNotNull()),
        lambda d: F.struct(location.alias("location"), rule_id.alias("rule_id"), F.lit(kind).alias("kind"),
                           d.alias("detail"), F.lit(None).cast("string").alias("value")),
    )


def _rows(frame: DataFrame, problems: Column) -> DataFrame:
    return frame.select("doc_id", F.explode(problems).alias("p")).select("doc_id", "p.*").drop("value")


def _at(kind: str, details: Column) -> Column:
    return _problems(kind, details, _at_rule(), F.col("id"))


def _required() -> Column:
    return _at("missing_required", F.array(*[
        F.when(F.col(f).isNull() | ((F.col(f) == "") if f == "id" else F.lit(False)), F.lit(f))
        for f in REQUIRED_FIELDS
    ]))


def _rule_version() -> Column:
    return _at("bad_version", F.array(F.when(~is_version("version_introduced"), F.col("version_introduced"))))


def _version_version() -> Column:
    return _problems(
        "bad_version",
        F.array(F.when(F.coalesce(~is_version("version"), F.lit(True)), F.coalesce("version", F.lit("")))),
        F.format_string("versions -> %s", F.col("vpos")), F.lit(None).cast("string"))


def _values() -> Column:
    return _at("bad_value", F.array(
        F.when(~F.col("change_type").isin(*CHANGE_TYPES), F.concat(F.lit("change_type="), "change_type")),
        F.when(~F.col("safety").isin(*SAFETY_LEVELS), F.concat(F.lit("safety="), "safety")),
    ))


def _extra(keys: Column, fields) -> Column:
    return F.coalesce(F.array_except(keys, F.array(*[F.lit(f) for f in fields])), F.array().cast("array<string>"))


def _document_fields() -> Column:
    return _problems("unknown_field", _extra(F.col("keys"), DOCUMENT_FIELDS), F.lit(""), F.lit(None).cast("string"))


def _version_fields() -> Column:
    return _problems(
        "unknown_field", _extra(F.json_object_keys("raw_version"), VERSION_FIELDS),
        F.format_string("versions -> %s", F.col("vpos")), F.lit(None).cast("string"))


def _rule_fields() -> Column:
    return _at("unknown_field", _extra(F.json_object_keys("raw_rule"), tuple(RULE_FIELDS)))


def _needed() -> Column:
    """Fields the change type needs; empty text or list counts as missing (not for a default)."""
    def absent(field):
        c = F.col(field)
        if field == "new_order":
            return c.isNull() | (F.size(c) == 0)
        return c.isNull() if field == "default_value" else c.isNull() | (c == "")

    return _at("missing_field", F.array(*[
        F.when((F.col("change_type") == kind) & absent(field), F.lit(field))
        for kind, fields in NEEDED_FIELDS.items() for field in fields
    ]))


def _default() -> Column:
    return _at("bad_default", F.array(F.when(~expression_valid(F.col("default_value")), F.col("default_value"))))


# A rule's schema as text where every field is plain and of its type; most rules are told by this alone.
_SHAPES = {"string": "STRING", "int": "BIGINT", "array<string>": "ARRAY<(?:STRING|VOID)>"}
_RIGHT = "|".join(f"{f}: (?:VOID|{_SHAPES[t]})" for f, t in RULE_FIELDS.items() if f != "extra")
_RIGHT += f"|(?!(?:{'|'.join(RULE_FIELDS)}):)[A-Za-z0-9_]+: [A-Z]+"
WELL_TYPED = rf"^OBJECT<(?:{_RIGHT})(?:, (?:{_RIGHT}))*+>\z"


def _types() -> Column:
    """Fields that are there (and not null) in the raw rule but are not of their type."""
    def checks(rule):
        return F.when(F.schema_of_variant(rule).rlike(WELL_TYPED), F.array().cast("array<string>")).otherwise(each(rule))

    def each(rule):
        allowed = {"string": ("STRING",), "int": ("BIGINT",), "array<string>": ("ARRAY<STRING>", "ARRAY<VOID>")}
        details = []
        for f, t in RULE_FIELDS.items():
            shape = F.schema_of_variant(F.try_variant_get(rule, f"$.{f}", "variant"))
            wrong = ~shape.startswith("OBJECT") if f == "extra" else ~shape.isin("VOID", *allowed[t])
            details.append(F.when(shape.isNotNull() & wrong, F.lit(f)))
        return F.array(*details)

    return _at("bad_type", let(F.try_parse_json("raw_rule"), checks))


def missing_required(rules: DataFrame) -> DataFrame:
    return _rows(rules, _required())


def bad_versions(rules: DataFrame, version_rows: DataFrame) -> DataFrame:
    return _rows(rules, _rule_version()).unionByName(_rows(version_rows, _version_version()))


def bad_values(rules: DataFrame) -> DataFrame:
    return _rows(rules, _values())


def unknown_fields(docs: DataFrame, rules: DataFrame, version_rows: DataFrame) -> DataFrame:
    return _rows(docs, _document_fields()).unionByName(_rows(version_rows, _version_fields())).unionByName(
        _rows(rules, _rule_fields()))


def missing_fields(rules: DataFrame) -> DataFrame:
    return _rows(rules, _needed())


def bad_defaults(rules: DataFrame) -> DataFrame:
    return _rows(rules, _default())


def bad_types(rules: DataFrame) -> DataFrame:
    return _rows(rules, _types())


def duplicate_ids(rules: DataFrame) -> DataFrame:
    return (
        rules.where("id is not null").groupBy("doc_id", "id").agg(F.count("*").alias("n")).where("n > 1")
        .select("doc_id", F.lit("versions").alias("location"), F.col("id").alias("rule_id"),
                F.lit("duplicate_id").alias("kind"), F.col("n").cast("string").alias("detail"))
    )


def conflicting_renames(rules: DataFrame) -> DataFrame:
    return (
        rules.where(F.col("change_type").isin(*RENAMES_CHECKED))
        .groupBy("doc_id", "change_type", "old_name")
        .agg(F.min("new_name").alias("lo"), F.max("new_name").alias("hi"))
        .where("lo <> hi")
        .select("doc_id", F.lit("versions").alias("location"), F.lit(None).cast("string").alias("rule_id"),
                F.lit("conflicting_rename").alias("kind"),
                F.concat_ws(" ", "change_type", "old_name").alias("detail"))
    )


def validate_changelogs(docs: DataFrame, strict: bool = False) -> DataFrame:
    """All problems of ``docs(doc_id, content)``; with ``strict`` any problem raises.

    One pass: documents are exploded to versions and rules once, and every row carries
    its own problems plus, for the checks across rules, the keys to be compared. A
    version's or document's own problems ride on its first row.
    """
    none = F.lit(None).cast("string")
    nothing = F.array().cast("array<struct<location:string,rule_id:string,kind:string,detail:string,value:string>>")
    rows = rule_rows(docs)
    first_rule = F.coalesce(F.col("pos"), F.lit(0)) == 0
    first_version = first_rule & (F.coalesce(F.col("vpos"), F.lit(0)) == 0)
    document = F.concat(
        _problems("unreadable", F.array("error"), F.lit(""), none),
        _problems("missing_required", F.array(F.when(
            F.col("error").isNull() & F.col("library").isNull(), F.lit("library"))), F.lit(""), none),
        _document_fields(),
    )
    version = F.concat(_version_version(), _version_fields())
    rule = F.concat(_required(), _rule_version(), _values(), _rule_fields(), _needed(), _default(), _types())
    key = lambda kind, detail, rule_id, value: F.array(F.struct(
        F.lit("versions").alias("location"), rule_id.alias("rule_id"), F.lit(kind).alias("kind"),
        detail.alias("detail"), value.alias("value")))
    # no lambda around the whole: what is within one is not compiled
    records = F.concat(
        F.when(first_version, document).otherwise(nothing),
        F.when(first_rule & F.col("vpos").isNotNull(), version).otherwise(nothing),
        F.when(F.col("pos").isNotNull(), rule).otherwise(nothing),
        F.when(F.col("id").isNotNull(), key("duplicate_id", none, F.col("id"), none)).otherwise(nothing),
        F.when(
            F.col("change_type").isin(*RENAMES_CHECKED),
            key("conflicting_rename", F.concat_ws(" ", "change_type", "old_name"), none, F.col("new_name")),
        ).otherwise(nothing),
    )
    # values are counted, not compared: smallest and largest texts would need all rows sorted, twice
    same = ("doc_id", "location", "rule_id", "kind", "detail")
    out = (
        rows.select("doc_id", F.explode(records).alias("p")).select("doc_id", "p.*")
        .groupBy(*same, "value").agg(F.count("*").alias("n"))
        .groupBy(*same).agg(F.sum("n").alias("n"), F.count("value").alias("values"))
        .where("(kind = 'duplicate_id' and n > 1) or (kind = 'conflicting_rename' and values > 1)"
               " or kind not in ('duplicate_id', 'conflicting_rename')")
        .select("doc_id", "location", "rule_id", "kind", F.when(
            F.col("kind") == "duplicate_id", F.col("n").cast("string")).otherwise(F.col("detail")).alias("detail"))
    )
    if strict:
        first = out.limit(1).collect()
        if first:
            raise ValueError(f"{first[0].kind} at {first[0].location or 'document'}: {first[0].detail}")
    return out
