"""Turn the ordered rules of migration paths into small lookup tables.

A path's rules form an ordered program. What that program does to an identifier
depends only on the identifier and on whether it is an attribute, so it is worked
out once per path and name here, instead of once per occurrence in the corpus:

* ``names``  (path_id, name, is_attr): final name, rules that hit it, and which
  kinds of syntax around such a name can be touched by some rule of the path.
* ``ops``    (path_id, kind, name, is_attr): the rules to fold over one entity
  (call, definition, parameter, import) that bears the name.
* ``info``   (path_id): names that must occur in a file for any rule to act,
  and the messages and change types by rule ordinal.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.functions.lexing import KEYWORDS, expression_valid, identifiers, token_texts, token_trivia
from apidrift.session import settled

# Change type -> operation folded over syntax entities. Types that
# are absent have no handler: their rules are reported as skipped.
HANDLERS = {
    "rename_function": "rename",
    "rename_class": "rename",
    "rename_attribute": "rename_attr",
    "rename_import": "import",
    "add_argument": "add_arg",
    "remove_argument": "remove_arg",
    "rename_argument": "rename_arg",
    "change_argument_default": "default",
    "reorder_arguments": "reorder",
    "deprecate_function": "deprecate",
    "remove_function": "deprecate",
    "move_to_module": "move",
    "add_decorator": "add_decorator",
    "remove_decorator": "remove_decorator",
    "replace_with_property": "property",
}

@dataclass(frozen=True)
class CallOperation:
    """An operation on calls that a further change type brings along: SQL that the fold over a call includes.

    A rule ``r`` has ``a`` (its function_name), ``b`` and ``c`` (from the columns ``second`` and ``third``), ``toks`` (the tokens of the
    column ``expression``) and ``o`` (its ordinal). A call ``s`` has ``cal`` (current callee), ``args`` (structs s, e, kw, dead, h, re), ``add``
    (structs kw, toks); ``attr`` says whether it is called on an object. ``acts`` is the condition beside the callee's
    name; ``callee``, ``args`` and ``add`` are the values after the rule; ``message`` is SQL over the rule's columns. See
    ``entities.drop_argument`` and ``entities.append_argument``.
    """

    acts: str
    message: str
    second: str = "argument_name"
    third: str | None = None
    expression: str | None = None
    callee: str | None = None
    args: str | None = None
    add: str | None = None


#: Operations of further change types, by change type.
OPERATIONS: dict[str, CallOperation] = {}
_CALLS = ("add_arg", "remove_arg", "rename_arg", "deprecate")


def call_operations() -> tuple[str, ...]:
    """Operations that are folded over calls."""
    return (*_CALLS, "property", *OPERATIONS)


# Bits of the per-name flag word.
PLAIN_HIT, ATTR_HIT, PLAIN_CALL, ATTR_CALL, DEF, PARAM = 1, 2, 4, 8, 16, 32

# Bytes of rule text up to which a lookup table is broadcast, checked before every broadcast. Name
# flags and path information grow with the rules; the rules to fold per name grow with
# the rules of a path for each of its rules. Beyond the bound the join shuffles.
BROADCAST_BYTES = 256 << 20


# Rules of a path up to which renames are looked up within a file's own row (a map of a path's names is
# searched for each name of the text); paths with more go by joins.
IN_PLACE_RULES = 32
RENAMES = frozenset({"rename", "rename_attr"})


@dataclass
class Rulebook:
    names: DataFrame
    ops: DataFrame
    info: DataFrame
    rounds: int
    kinds: frozenset
    few_rules: bool
    few_pairs: bool
    failing: DataFrame | None = None  # (path_id, bad): rules that cannot be applied, by the name they look for
    most_rules: int = 0  # of a path

    @property
    def in_place(self) -> bool:
        """All rules are renames, and few enough of a path to be looked up within a row."""
        return self.kinds <= RENAMES and self.most_rules <= IN_PLACE_RULES

    def moves(self, round_: int) -> DataFrame:
        """path_id, moves: what becomes of a name (of an attribute under a key with a dot)."""
        key = F.concat(F.when(F.col("is_attr"), ".").otherwise(""), "name")
        return self.ops.where((F.col("round") == round_) & (F.col("kind") == "n")).groupBy("path_id").agg(
            F.map_from_entries(F.collect_list(F.struct(key, F.struct("final", "hits")))).alias("moves"))

    def per_rule(self, table: DataFrame) -> DataFrame:
        """A lookup table whose size follows the number of rules."""
        return F.broadcast(table) if self.few_rules else table

    def per_pair(self, table: DataFrame) -> DataFrame:
        """A lookup table whose size follows the rule pairs within paths."""
        return F.broadcast(table) if self.few_pairs else table


def register_handler(change_type: str, operation: str) -> None:
    """Extension point: let a further change type act as one of the known operations.

    Its rules fill the same fields as the built-in type of that operation.
    """
    if operation not in set(HANDLERS.values()):
        raise ValueError(f"Unknown operation: {operation}")
    HANDLERS[change_type] = operation


def register_operation(change_type: str, operation: CallOperation) -> None:
    """Extension point: a change type with an operation and a message of its own."""
    if change_type in HANDLERS:
        raise ValueError(f"There is an operation for {change_type} already")
    HANDLERS[change_type] = change_type
    OPERATIONS[change_type] = operation


@contextmanager
def registered(change_type: str, operation: CallOperation) -> Iterator[None]:
    """The operation is known to migrations that are planned within the block."""
    register_operation(change_type, operation)
    try:
        yield
    finally:
        del HANDLERS[change_type], OPERATIONS[change_type]


def _op_of(change_type: Column) -> Column:
    pairs = [F.lit(x) for kv in HANDLERS.items() for x in kv]
    return F.create_map(*pairs)[change_type]


def handler_table(spark) -> DataFrame:
    return spark.createDataFrame(list(HANDLERS.items()), "change_type string, handler string")


def message_column() -> Column:
    """Change message of a rule (one text per rule, whatever the occurrence)."""
    c = F.col
    default = F.coalesce(F.nullif(c("default_value"), F.lit("")), F.lit("None"))
    cat = F.concat
    table = {
        "rename_function": cat(F.lit("Renamed function: "), c("old_name"), F.lit(" -> "), c("new_name")),
        "rename_class": cat(F.lit("Renamed class: "), c("old_name"), F.lit(" -> "), c("new_name")),
        "rename_attribute": cat(F.lit("Renamed attribute: ."), c("old_name"), F.lit(" -> ."), c("new_name")),
        "rename_import": F.format_string(
            "Renamed import: from %s import %s -> from %s import %s",
            c("old_module"), c("old_name"), c("new_module"), c("new_name"),
        ),
        "add_argument": F.format_string(
            "Added argument '%s=%s' to %s()", c("argument_name"), default, c("function_name")
        ),
        "remove_argument": F.format_string(
            "Removed argument '%s' from %s()", c("argument_name"), c("function_name")
        ),
        "rename_argument": F.format_string(
            "Renamed arg '%s' -> '%s' in %s()", c("argument_name"), c("new_argument_name"), c("function_name")
        ),
        "change_argument_default": F.format_string(
            "Changed default for '%s' to %s", c("argument_name"), c("default_value")
        ),
        "reorder_arguments": F.format_string("Reordered parameters of %s()", c("function_name")),
        "deprecate_function": F.format_string("Marked %s() as deprecated", c("old_name")),
        "remove_function": F.format_string("Marked %s() as deprecated", c("old_name")),
        "move_to_module": F.format_string(
            "Moved import: %s from %s to %s", c("old_name"), c("source_module"), c("target_module")
        ),
        "add_decorator": F.format_string("Added @%s to %s()", c("decorator_name"), c("function_name")),
        "remove_decorator": F.format_string("Removed @%s from %s()", c("decorator_name"), c("function_name")),
        "replace_with_property": F.format_string(
            "Replaced %s() with property %s", c("old_name"), c("new_name")
        ),
    }
    table |= {name: F.expr(operation.message) for name, operation in OPERATIONS.items()}
    out = None
    for kind, text in table.items():
        out = F.when(c("change_type") == kind, text) if out is None else out.when(c("change_type") == kind, text)
    return out


RULE_COLUMNS = (
    "old_name", "new_name", "function_name", "argument_name", "new_argument_name", "default_value",
    "old_module", "new_module", "replacement", "decorator_name", "source_module", "target_module",
    "description",
)


def _complete(path_rules: DataFrame) -> DataFrame:
    for name in RULE_COLUMNS:
        if name not in path_rules.columns:
            path_rules = path_rules.withColumn(name, F.lit(None).cast("string"))
    if "new_order" not in path_rules.columns:
        path_rules = path_rules.withColumn("new_order", F.lit(None).cast("array<string>"))
    return path_rules


def with_rounds(path_rules: DataFrame) -> DataFrame:
    """Number the rounds of a path.

    All rules of a round are composed in one pass over the tokens. A new round
    (a fresh look at the rewritten text) starts after a rule whose output is new
    syntax: a dotted new name, a default value with a call, an attribute or a lambda that
    holds a name some rule of the path looks for, or a property that a rule looks for as a call.
    """
    c = F.col
    rules = _complete(path_rules)
    op = _op_of(c("change_type"))
    plain = lambda name: c(name).rlike(r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{M}\p{N}_]*\z")
    called = op.isin(*call_operations())
    # Names that rules look for, and names that a rule writes as new syntax, meet by path and name.
    looked_for = rules.select("path_id", F.explode(F.array(
        *(F.struct(c(name).alias("looked"), as_call.alias("called")) for name, as_call in (
            ("function_name", called), ("old_name", called), ("argument_name", F.lit(False)))),
    )).alias("x")).select(c("path_id").alias("by"), "x.looked", F.coalesce("x.called", F.lit(False)).alias("called")).where(
        "looked is not null").distinct()
    value = c("default_value")
    for name, operation in OPERATIONS.items():
        if operation.expression:
            value = F.when(op == name, c(operation.expression)).otherwise(value)
    writers = ["add_arg", "default", *(name for name, operation in OPERATIONS.items() if operation.expression)]
    holds_syntax = op.isin(*writers) & value.rlike(r"[\p{L}\p{N}_)\]]\s*\(|\.\s*\p{L}|lambda")
    written = rules.select(
        "path_id", "ordinal", (op == "property").alias("as_call"),
        F.explode(F.when(holds_syntax, identifiers(value)).when(op == "property", F.array("new_name"))).alias("name"))
    met = written.join(looked_for, (c("path_id") == c("by")) & (c("name") == c("looked"))).where(
        "called or not as_call").select(c("path_id").alias("met_path"), c("ordinal").alias("met")).distinct()
    new_name = (
        (op.isin("rename", "rename_attr", "import", "property") & ~plain("new_name"))
        | ((op == "rename_arg") & ~plain("new_argument_name")) | ((op == "add_decorator") & ~plain("decorator_name"))
    )
    before = Window.partitionBy("path_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    barrier = F.coalesce(new_name, F.lit(False)) | c("met").isNotNull()
    return rules.join(met, (c("path_id") == c("met_path")) & (c("ordinal") == c("met")), "left").withColumn(
        "barrier", barrier.cast("int")).withColumn(
        "round", F.coalesce(F.sum("barrier").over(before), F.lit(0)).cast("int")).drop("barrier", "met", "met_path")


def _slim(rules: DataFrame) -> DataFrame:
    """Rules as one slim struct ``op`` per row: what a fold step needs and no more."""
    c = F.col
    default = F.trim(F.coalesce(F.nullif(c("default_value"), F.lit("")), F.lit("None")))
    kind = _op_of(c("change_type"))
    fn = F.when(kind.isin("deprecate", "property", "rename", "rename_attr", "import", "move"), c("old_name"))
    own = {name: operation for name, operation in OPERATIONS.items()}
    for name, operation in own.items():
        if operation.expression:
            default = F.when(kind == name, F.trim(operation.expression)).otherwise(default)
    pieces = F.when(
        kind.isin("add_arg", "default", *(name for name, operation in own.items() if operation.expression)),
        F.filter(
            F.flatten(F.zip_with(token_trivia(default), token_texts(default), lambda p, t: F.array(p, t))),
            lambda x: x != "",
        ),
    )
    second = F.when(
        kind.isin("add_arg", "remove_arg", "rename_arg", "default"), c("argument_name"),
    ).when(kind.isin("add_decorator", "remove_decorator"), c("decorator_name")).when(
        kind == "deprecate", F.coalesce(F.nullif(c("replacement"), F.lit("")), F.lit("N/A")))
    third = F.when(kind == "import", c("old_module")).when(kind == "move", c("source_module")).when(
        kind == "rename_arg", c("new_argument_name"))
    for name, operation in own.items():
        second = second.when(kind == name, c(operation.second))
        third = third.when(kind == name, c(operation.third) if operation.third else F.lit(None).cast("string"))
    return rules.withColumn("kind", kind).where(
        "kind is not null and not (kind = 'default' and default_value is null)"
    ).select(
        "path_id", "round",
        F.struct(
            c("ordinal").cast("int").alias("o"),
            c("kind").alias("op"),
            F.coalesce(fn, c("function_name")).alias("a"),
            second.otherwise(c("new_name")).alias("b"),
            third.alias("c"),
            F.when(kind == "import", c("new_module")).when(kind == "move", c("target_module")).alias("d"),
            pieces.alias("toks"),
            F.when(kind == "reorder", c("new_order")).alias("order"),
        ).alias("r"),
    )


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{name}'" for name in names)


def compile_rules(path_rules: DataFrame) -> Rulebook:
    """Compile ``path_rules(path_id, ordinal, rule columns...)``.

    ``ordinal`` is 1-based and dense within a path.
    """
    rules = with_rounds(path_rules)
    writes = _op_of(F.col("change_type")).isin("add_arg", "default") & (F.trim("default_value") != "")
    rules = settled(rules.withColumn("bad", F.coalesce(writes & ~expression_valid(F.col("default_value")), F.lit(False))))
    per_path = rules.groupBy("path_id").agg(
        F.count("*").alias("n"), F.max("round").alias("r"),
        F.sum(F.octet_length(F.to_json(F.struct(*rules.columns)))).alias("bytes"), F.bool_or("bad").alias("bad"),
        F.collect_set(_op_of(F.col("change_type"))).alias("kinds"))
    stats = per_path.agg(
        F.max("r").alias("r"), F.max("n").alias("n"), F.sum(F.col("n") * F.col("bytes")).alias("pair_bytes"), F.sum("bytes").alias("bytes"), F.bool_or("bad").alias("bad"),
        F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"),
    ).first()
    small = (stats["pair_bytes"] or 0) <= BROADCAST_BYTES
    slim = _slim(rules.where("not bad"))
    failing = rules.where("bad").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("ordinal").alias("o"), F.coalesce("function_name", "argument_name").alias("name"),
        F.concat(F.lit("Rule '"), "description", F.lit("' failed: Invalid expression: "), "default_value").alias("message"),
    ))).alias("bad"))
    programs = slim.groupBy("path_id", "round").agg(F.array_sort(F.collect_list("r")).alias("ops"))

    words = F.expr("""
        filter(array_distinct(flatten(transform(ops, r ->
          filter(flatten(array(array(r.a, r.b, r.c), coalesce(r.order, array()), coalesce(r.toks, array()))),
                 w -> w is not null)))),
               w -> w rlike '^[\\\\p{L}\\\\p{Nl}_][\\\\p{L}\\\\p{Nl}\\\\p{M}\\\\p{N}_]*\\\\z')
    """)
    module_words = F.expr(
        "flatten(transform(filter(ops, r -> r.op in ('import','move')), r -> split(r.c, '[.]')))"
    )
    domain = (
        programs.select("path_id", "round", "ops",
                        F.explode(F.array_distinct(F.concat(words, module_words))).alias("name"))
        .where(~F.col("name").isin(*KEYWORDS))
        .select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_attr"))
    )
    default_hit = "r.op = 'default' and not is_attr and r.b = s.cur"
    walked = domain.withColumn("w", F.expr(f"""
        aggregate(ops,
          named_struct('cur', name, 'hits', cast(array() as array<struct<o:int,c:boolean>>),
                       'call', false, 'def', false, 'param', false, 'mine', cast(array() as array<int>)),
          (s, r) -> named_struct(
            'cur', case when (r.op = 'rename' or (is_attr and r.op = 'rename_attr')) and r.a = s.cur
                        then r.b else s.cur end,
            'hits', case when (r.op = 'rename' or (is_attr and r.op = 'rename_attr')) and r.a = s.cur
                         then array_append(s.hits, named_struct('o', r.o, 'c', r.a <> r.b)) else s.hits end,
            'call', s.call or (r.op in ({_quoted(_CALLS + tuple(OPERATIONS))}) and r.a = s.cur)
                           or (is_attr and r.op = 'property' and r.a = s.cur),
            'def', s.def or (not is_attr and r.op in ('reorder','add_decorator','remove_decorator')
                             and r.a = s.cur),
            'param', s.param or ({default_hit}),
            'mine', case when r.a = s.cur and r.op not in ('rename','rename_attr') or ({default_hit})
                         then array_append(s.mine, r.o) else s.mine end))
    """))
    renames = "r.op in ('rename','rename_attr')"
    names = walked.select(
        "path_id", "round", "name", "is_attr",
        F.col("w.cur").alias("final"), F.col("w.hits").alias("hits"),
        F.col("w.call").alias("call"), F.col("w.def").alias("def"), F.col("w.param").alias("param"),
        F.expr(f"filter(ops, r -> {renames} or array_contains(w.mine, r.o))").alias("mine"),
    ).where("size(hits) > 0 or call or def or param")

    ops = (
        names
        .select("path_id", "round", "name", "is_attr",
                F.explode(F.expr("filter(array(if(size(hits) > 0,'n',null), if(call,'c',null),"
                                 " if(def,'d',null), if(def,'e',null), if(param,'p',null)),"
                                 " k -> k is not null)")).alias("kind"),
                F.expr("if(call or def or param, mine, null)").alias("ops"), "final", "hits")
        .unionByName(programs.select(
            "path_id", "round", F.lit("").alias("name"), F.lit(False).alias("is_attr"),
            F.lit("i").alias("kind"),
            F.expr(f"filter(ops, r -> {renames} or r.op in ('import','move'))").alias("ops"),
            F.lit(None).cast("string").alias("final"),
            F.lit(None).cast("array<struct<o:int,c:boolean>>").alias("hits"),
        ).where("exists(ops, r -> r.op in ('import','move'))"))
    )
    fires = F.expr("""
        array_distinct(flatten(transform(ops, r ->
          case when r.op in ('import','move') then array(element_at(split(r.c, '[.]'), -1))
               when r.op = 'default' then array(r.b) else array(r.a) end)))
    """)
    bits = F.expr(f"""
        if(exists(ops, r -> r.op in ({_quoted(call_operations())})), 1, 0)
        + if(exists(ops, r -> r.op = 'reorder'), 2, 0)
        + if(exists(ops, r -> r.op = 'default'), 4, 0)
        + if(exists(ops, r -> r.op in ('import','move')), 8, 0)
        + if(exists(ops, r -> r.op in ('add_decorator','remove_decorator')), 16, 0)
    """)
    texts = rules.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("ordinal").cast("int").alias("o"), message_column().alias("message"), "change_type", "description",
        _op_of(F.col("change_type")).isNotNull().alias("handled"),
    ))).alias("texts"))
    info = (
        programs.select("path_id", "round", fires.alias("triggers"), bits.alias("bits"))
        .join(texts, "path_id", "right")
    )
    flags = names.groupBy("path_id", "round", "name").agg(
        (
            F.bool_or(~F.col("is_attr") & (F.size("hits") > 0)).cast("int") * PLAIN_HIT
            + F.bool_or(F.col("is_attr") & (F.size("hits") > 0)).cast("int") * ATTR_HIT
            + F.bool_or(~F.col("is_attr") & F.col("call")).cast("int") * PLAIN_CALL
            + F.bool_or(F.col("is_attr") & F.col("call")).cast("int") * ATTR_CALL
            + F.bool_or(F.col("def")).cast("int") * DEF
            + F.bool_or(F.col("param")).cast("int") * PARAM
        ).cast("int").alias("fl"),
    )
    return Rulebook(
        names=flags, ops=ops, info=info,
        rounds=(stats["r"] or 0) + 1, kinds=frozenset(stats["kinds"] or ()),
        few_rules=(stats["bytes"] or 0) <= BROADCAST_BYTES, few_pairs=small,
        failing=failing if stats["bad"] else None, most_rules=stats["n"] or 0,
    )
