"""Small fixtures: rules as dicts, one migration path per case."""

RULE_SCHEMA = (
    "path_id int, ordinal int, change_type string, description string, old_name string, new_name string, "
    "function_name string, argument_name string, new_argument_name string, default_value string, "
    "old_module string, new_module string, replacement string, decorator_name string, source_module string, "
    "target_module string, new_order array<string>"
)
RULE_FIELDS = [f.strip().split()[0] for f in RULE_SCHEMA.split(", ")]


def rule(change_type, **fields):
    return dict(change_type=change_type, description=fields.pop("description", "d"), **fields)


def rules_frame(spark, rules_by_path):
    rows = [
        tuple(dict(r, path_id=p, ordinal=i + 1).get(f) for f in RULE_FIELDS)
        for p, rules in rules_by_path.items() for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def files_frame(spark, code_by_path):
    return spark.createDataFrame(
        [(p, p, "repo", f"f{p}.py", code) for p, code in code_by_path.items()],
        "path_id int, file_id long, repo string, path string, content string",
    )
