"""Apply the rules of migration paths to source files.

    files (path_id, file_id, content)  x  path_rules  ->  one result row per file

Tokens never leave their file's row: the syntax entities that some rule can touch are read there
(``reading``), and the edits are laid over the text there (``merging``). One shuffle between them, by ``file_id``:
the candidate files, as whole texts with their entities. Entities are exploded after it, meet their rules and
are folded as rows; the edits are grouped in place. Files that hold none of a path's names never leave
their scan task. Where all rules are renames, and few, none does: each file is rewritten within its row (``renamed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apidrift.functions.lexing import TRIVIA, identifiers, is_name, let, lexically_valid, token_pieces, token_structs
from apidrift.operators import entities
from apidrift.session import settled, text_partitions
from apidrift.operators.merging import EDIT_FIELDS, merged_texts
from apidrift.operators.reading import FLAGS, entity_arrays, letters
from apidrift.operators.rulebook import Rulebook, call_operations, compile_rules
from apidrift.operators.structure import KEY

IMPORT_OPS = {"import", "move"}
DECORATOR_OPS = {"add_decorator", "remove_decorator"}


def _bit(column, bit: int) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.bitwiseAND(bit) != 0


def candidates(files: DataFrame) -> Column:
    """File holds a name some rule of its path looks for (``triggers``), and can be read."""
    return F.coalesce(
        F.arrays_overlap(identifiers(F.col("content")), F.col("triggers"))
        & lexically_valid(F.col("content")),
        F.lit(False),
    )


def _is_soft(tok: Column, next1: Column) -> Column:
    """A word that an operand right after it makes a statement keyword."""
    return tok.isin("match", "case", "type") & next1.rlike(
        r"^[\p{L}\p{Nl}_0-9\"']") & ~next1.isin("in", "is", "and", "or", "if", "else", "for", "as", "async")


def renamed(files: DataFrame) -> DataFrame:
    """``code`` and ``hits`` of files with ``content`` and ``moves``: renames only, within the row.

    What a rename does depends on a token and its neighbours, so no token leaves its file's row and nothing is shuffled.
    """
    def at(toks: Column, i: Column) -> Column:
        return F.coalesce(F.get(toks, i)["tok"], F.lit(""))

    def moved(toks: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            attr = (at(toks, i - 1) == ".") & ~at(toks, i - 2).isin("from", ".", "...")
            found = F.try_element_at(F.col("moves"), F.concat(F.when(attr, ".").otherwise(""), x["tok"]))
            return F.when(is_name(x["tok"]) & ~_is_soft(x["tok"], at(toks, i + 1)), found)

        return let(F.transform(toks, one), lambda to: F.struct(
            F.array_join(F.zip_with(toks, to, lambda x, m: F.concat(x["pre"], F.coalesce(m["final"], x["tok"]))), "").alias("code"),
            F.transform(F.flatten(F.transform(F.filter(to, lambda m: m.isNotNull()), lambda m: m["hits"])), lambda h: F.struct(
                h["o"].alias("o"), F.lit(1).alias("m"), h["c"].alias("c"))).alias("hits")))

    return files.withColumn("done", let(token_structs(F.col("content")), moved)).select(
        "*", F.col("done.code").alias("code"), F.col("done.hits").alias("hits")).drop("done", "moves")


def _needs(kinds: frozenset) -> frozenset:
    need = {"names"}
    if kinds & {*call_operations(), "reorder", "default"}:
        need.add("depth")
    if "deprecate" in kinds:
        need.add("alone")
    if kinds & {"reorder", "default"}:
        need.add("definitions")
    if kinds & DECORATOR_OPS:
        need.add("blocks")
    if kinds & IMPORT_OPS:
        need.add("statements")
    return frozenset(need)


def read_entities(files: DataFrame, book: Rulebook) -> Column:
    """The syntax entities of ``content`` that some rule can touch, each with its tokens, and where tokens end (``reading``).

    ``files`` has the columns of ``asked``.
    """
    c = F.col
    # only the names that the text holds go to its reading, however many rules there are
    held = [F.array_intersect(c("lexed.tok"), F.coalesce(c(f"names{bit}"), F.array().cast("array<string>"))) for bit in FLAGS]
    return entity_arrays(_needs(book.kinds), book.kinds)(
        c("lexed.pre"), c("lexed.tok"), F.coalesce(c("bits"), F.lit(0)), letters(c("content")), *held)


def asked(book: Rulebook, round_: int) -> DataFrame:
    """path_id, names<bit>: the names of a path under each of their flags."""
    return book.names.where(F.col("round") == round_).groupBy("path_id").agg(*(
        F.collect_list(F.when(_bit("fl", bit), F.col("name"))).alias(f"names{bit}") for bit in FLAGS))


def entity_edits(groups: DataFrame, book: Rulebook, round_: int = 0, scoped: bool = False) -> DataFrame:
    """Fold the rules over each entity; one row per edit."""
    kinds = book.kinds
    ops = book.per_pair(book.ops.where(F.col("round") == round_).drop("round"))
    joined = groups.join(ops, ["path_id", "kind", "name", "is_attr"]).withColumnRenamed("is_attr", "attr")
    choice = F.when(F.col("kind") == "n", F.expr(entities.name_edits()))
    if kinds & set(call_operations()):
        choice = choice.when(F.col("kind") == "c", F.expr(entities.call_edits()))
    if "reorder" in kinds:
        choice = choice.when(F.col("kind") == "d", F.expr(entities.definition_edits()))
    if "default" in kinds:
        choice = choice.when(F.col("kind") == "p", F.expr(entities.parameter_edits(scoped)))
    if kinds & DECORATOR_OPS:
        choice = choice.when(F.col("kind") == "e", F.expr(entities.decorator_edits()))
    if kinds & IMPORT_OPS:
        choice = choice.when(F.col("kind") == "i", F.expr(entities.import_edits()))
    return joined.select(*KEY, F.explode(choice).alias("e")).select(*KEY, "e.*")


def file_edits(edits: DataFrame) -> DataFrame:
    """Merge the edits of a file: text segments by position, rule hits, removed ranges.

    For edits that are rows already, followed by ``stitch``; ``merge`` does both within a file's row.
    """
    c = F.col
    span = c("k").isin("x", "r")
    # a column of its own, so that both windows by position share one sort
    edits = edits.withColumn("turn", F.when(span, 0).when(c("k") == "T", 1).otherwise(2))
    order = (F.col("pos"), F.col("turn"), F.desc("end"))
    before = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    edits = edits.select(
        "*",
        F.coalesce(F.max(F.when(span, c("end"))).over(before) >= c("pos"), F.lit(False)).alias("covered"),
        F.coalesce(F.max(F.when(c("k") == "T", c("pos"))).over(before) == c("pos"), F.lit(False)).alias("over"),
    ).where(~((c("k") == "h") & c("over")))
    # A covered hit counts only if it came before every removal around it. The removals to
    # look at lie within one outermost span, so each such island is its own small window.
    sofar = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy(*KEY, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    edits = edits.select("*", F.when(
        c("covered"), F.max(F.when(span & ~c("covered"), c("pos"))).over(sofar)).otherwise(c("pos")).alias("island")
    ).select("*", F.collect_list(F.when(span, F.struct("end", "o"))).over(island).alias("around")).where(
        ~(c("k").isin("h", "H", "z", "D") & c("covered")
          & F.exists("around", lambda d: (d["end"] >= c("pos")) & (d["o"] < c("o"))))
    ).drop("around", "island")
    bare = ~c("covered")
    pick = lambda k, v="txt": F.max(F.when((c("k") == k) & bare, c(v)))
    there = lambda k: F.coalesce(F.bool_or((c("k") == k) & bare), F.lit(False))
    ordered = "array_join(transform(array_sort(array_distinct(filter(noted, h -> h.k = 'b' and not h.covered))), h -> h.txt), '')"
    at = edits.groupBy(*KEY, "pos").agg(
        F.coalesce(pick("r"), pick("T"), pick("t")).alias("tok"),
        F.max(F.when(span & bare, c("end"))).alias("end"),
        there("x").alias("gone"),
        pick("q").alias("pre"), pick("w").alias("first"), pick("a").alias("after"), pick("g").alias("deco"),
        there("l").alias("cut_line"), there("d").alias("cut_indent"),
        F.max(F.when((c("k") == "S") & bare, F.struct("end", "src"))).alias("layout"),
        F.collect_list(F.when(c("k").isin("h", "H", "z", "D", "b"), F.struct(
            "o", "k", "m", "c", "txt", "src", "pos", "end", "covered"))).alias("noted"),
        there("b").alias("inserts"), F.bool_or(c("k").isin("b", "D")).alias("mixed"),
    ).withColumn("before", F.expr(f"if(inserts, {ordered}, '')"))
    texty = F.expr(
        "gone or tok is not null or pre is not null or first is not null or before <> '' or after is not null"
        " or deco is not null or cut_line or cut_indent or layout is not null"
    )
    segment = F.struct(
        "pos", F.coalesce("end", "pos").alias("end"), "tok", "gone", "pre", "first", "before", "after",
        "deco", "cut_line", "cut_indent",
    )
    noted = F.expr("""
        if(mixed, concat(filter(noted, h -> h.k not in ('b', 'D')), array_distinct(filter(noted, h -> h.k = 'D'))), noted)
    """)
    return (
        at.groupBy(*KEY)
        .agg(
            F.sort_array(F.collect_list(F.when(texty, segment))).alias("segs"),
            F.sort_array(F.collect_list(F.when(c("layout").isNotNull(), F.struct("pos", "layout")))).alias("layouts"),
            F.flatten(F.collect_list(noted)).alias("hits"),
        )
    )


# one output piece: ``x`` original trivia and token, ``d`` its segment or null
_PRE = "regexp_extract(x, '^" + TRIVIA.replace("\\", "\\\\") + "', 0)"
_FIRST_LINE = "'^[^\\\\r\\\\n]*(?:\\\\r\\\\n|\\\\n|\\\\r)?'"
_TOKEN_OUT = f"""
  (x, d) -> case
    when d is null then x
    when d.skip then ''
    else transform(array({_PRE}), pre -> concat(
      coalesce(d.first, ''),
      case when d.deco is null and not d.cut_line and not d.cut_indent then coalesce(d.pre, pre)
           else transform(array(if(d.deco is null, coalesce(d.pre, pre), concat(
                  regexp_extract(pre, {_FIRST_LINE}, 0), d.deco, regexp_replace(pre, {_FIRST_LINE}, '')))), p ->
                transform(array(if(d.cut_line, regexp_replace(p, {_FIRST_LINE}, ''), p)), q ->
                  if(d.cut_indent, regexp_replace(q, '[^\\\\r\\\\n]*\\\\z', ''), q))[0])[0] end,
      d.before,
      case when d.cut_indent then '' when d.tok is not null then d.tok
           else substring(x, length(pre) + 1) end,
      coalesce(d.after, '')))[0]
  end
"""
_SEGMENT = "struct<skip:boolean,tok:string,pre:string,first:string,before:string,after:string,deco:string,cut_line:boolean,cut_indent:boolean>"
_DENSE = f"""
  flatten(transform(segs, (s, i) -> concat(
    array_repeat(cast(null as {_SEGMENT}), s.pos - coalesce(get(segs, i - 1).end, -1) - 1),
    array(named_struct('skip', s.gone, 'tok', s.tok, 'pre', s.pre, 'first', s.first, 'before',
          if(nl = '\\n', s.before, replace(s.before, '\\n', nl)), 'after', s.after,
          'deco', if(nl = '\\n', s.deco, replace(s.deco, '\\n', nl)),
          'cut_line', s.cut_line, 'cut_indent', s.cut_indent)),
    array_repeat(named_struct('skip', true, 'tok', cast(null as string), 'pre', cast(null as string),
          'first', cast(null as string), 'before', cast(null as string), 'after', cast(null as string),
          'deco', cast(null as string), 'cut_line', false, 'cut_indent', false), s.end - s.pos))))
"""
# source position for every token up to the last laid-out parameter list
_LAYOUT = """
  flatten(transform(layouts, (s, i) -> concat(
    array_repeat(cast(null as int), s.pos - coalesce(get(layouts, i - 1).layout.end, -1) - 1), s.layout.src)))
"""
def _stitch_sql() -> str:
    plain = f"array_join(zip_with(lex, {_DENSE}, {_TOKEN_OUT}), '')"
    moved = f"""
      transform(array(zip_with(lex, {_DENSE}, {_TOKEN_OUT})), outs ->
        array_join(zip_with(sequence(0, size(outs) - 1), {_LAYOUT},
                            (i, j) -> get(outs, coalesce(j, i))), ''))[0]
    """
    return f"if(size(layouts) = 0, {plain}, {moved})"


def stitch(edited: DataFrame) -> DataFrame:
    """Lay the segments over the token array of each text (row-local, linear)."""
    nl = "coalesce(nullif(regexp_extract(content, '\\\\r\\\\n|\\\\n|\\\\r', 0), ''), '\\n')"
    hits = """
      transform(hits, h -> named_struct('o', h.o, 'm', h.m, 'c', coalesce(h.c,
        trim(array_join(transform(sequence(h.src[0], h.src[1]),
             i -> if(i = h.src[0], regexp_replace(lex[i], '^{trivia}', ''), lex[i])), '')) <> h.txt)))
    """.replace("{trivia}", TRIVIA.replace("\\", "\\\\"))
    lexed = token_pieces(F.col("content"))
    # evaluated once per text: what a lambda only refers to would be computed per element
    return edited.withColumn("lexed", lexed).withColumn("done", F.expr(f"""
        transform(array(lexed), lex -> transform(array({nl}), nl ->
          transform(array(segs), segs -> named_struct('code', {_stitch_sql()}, 'hits', {hits}))[0])[0])[0]
    """)).drop("hits", "lexed").withColumn("code", F.col("done.code")).withColumn("hits", F.col("done.hits"))


def merge(edited: DataFrame) -> DataFrame:
    """``code`` and ``hits`` of texts with their ``edits``, each within its row (``merging``)."""
    c = F.col
    nl = F.coalesce(F.nullif(F.regexp_extract("content", r"\r\n|\n|\r", 0), F.lit("")), F.lit("\n"))
    done = edited.withColumn("done", merged_texts()(nl, c("content"), c("cuts"), c("edits")))
    return done.withColumn("code", F.coalesce("done.code", "content")).withColumn(
        "hits", F.coalesce("done.hits", F.array())).drop("done", "cuts", "edits")


_ORDINALS = "array_sort(array_distinct(transform(filter(hits, h -> h.c), h -> h.o)))"


def migrate(files: DataFrame, path_rules: DataFrame, only_modified: bool = False,
            dry_run: bool = False, book: Rulebook | None = None, partitions: int | None = None, scoped: bool = False) -> DataFrame:
    """Apply ``path_rules`` to ``files(path_id, file_id, [repo, path,] content, [error])``.

    A file with an ``error`` (it could not be decoded) is a failed result with an empty text.

    ``file_id`` (any type) is unique in ``files``: a file that takes part in two paths
    comes as two rows. ``path_rules`` has ``path_id``, a dense 1-based ``ordinal`` and
    the rule columns.

    Returns ``path_id, file_id, repo, path, original_code, transformed_code, changes,
    errors, rules_applied, was_modified, success``. With ``dry_run`` the text stays
    as it was and ``would_modify`` tells what a run would do. ``only_modified`` leaves
    out the files no rule acts on, and with them the second pass over their text. With ``scoped`` a changed default concerns only
    parameters of definitions named as the rule's ``function_name``, else all parameters of the name, lambdas included.

    ``partitions`` (default: ``text_partitions``) is fixed, because the
    texts grow about fiftyfold as token rows: sized by their compressed bytes, as
    adaptive coalescing would do, a partition would be far too big to sort.
    """
    book = book or compile_rules(path_rules)
    partitions = partitions or text_partitions(files)
    for name in ("repo", "path"):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    text = F.when(error.isNotNull(), F.lit("")).otherwise(F.col("content"))
    result = files.select(
        "path_id", "file_id", "repo", "path", text.alias("original"), text.alias("content"), none.alias("changes"),
        F.when(error.isNotNull(), F.array(error)).otherwise(none).alias("errors"), none.alias("rules_applied"),
    )
    if book.failing is not None:
        # a rule that cannot be applied fails where the name it looks for occurs; the others go on
        result = result.join(book.per_rule(book.failing), "path_id", "left").withColumn("errors", F.concat(
            "errors", F.transform(F.filter(
                F.coalesce("bad", F.array()), lambda b: F.array_contains(identifiers(F.col("content")), b["name"])),
                lambda b: b["message"]))).drop("bad")
    for round_ in range(book.rounds):
        if round_:  # the next round reads the texts several times
            result = settled(result)
        result = _one_round(result, book, round_, only_modified and book.rounds == 1, partitions, scoped)
    out = result.select(
        "path_id", "file_id", "repo", "path", F.col("original").alias("original_code"),
        (F.col("original") if dry_run else F.col("content")).alias("transformed_code"),
        "changes", "errors", "rules_applied",
        (F.lit(False) if dry_run else F.col("original") != F.col("content")).alias("was_modified"),
        (F.size("errors") == 0).alias("success"),
        *([(F.col("original") != F.col("content")).alias("would_modify")] if dry_run else []),
    )
    return out.where("original_code <> transformed_code or size(changes) > 0") if only_modified else out


def _one_round(files: DataFrame, book: Rulebook, round_: int, only_modified: bool, partitions: int, scoped: bool) -> DataFrame:
    c = F.col
    info = book.info.where((c("round") == round_) | c("round").isNull())
    files = files.join(book.per_rule(info.select("path_id", "triggers", "bits")), "path_id", "left")
    acts = candidates(files)
    texts = book.per_rule(book.info.groupBy("path_id").agg(F.first("texts").alias("texts")))
    if book.in_place:
        kept = files.where(acts).select(*KEY, "repo", "path", "original", "content", "changes", "errors", "rules_applied")
        new = _logged(renamed(kept.join(book.per_rule(book.moves(round_)), "path_id")).join(texts, "path_id", "left"))
        return new if only_modified else new.unionByName(_untouched(files.where(~acts), texts, round_))
    logged = round_ > 0 or book.failing is not None
    log = ["changes", "errors", "rules_applied"] if logged else []
    strings = ["repo", "path", "content"] + (["original"] if round_ else [])
    lexed = files.where(acts).join(book.per_rule(asked(book, round_)), "path_id", "left").withColumn(
        "lexed", token_structs(c("content")))
    chosen = lexed.select(
        *KEY, F.array(F.array(*strings), *log).alias("payload"), read_entities(lexed, book).alias("read"),
    ).select(*KEY, "payload", "read.entities", "read.cuts").repartition(partitions, "file_id")
    # Both uses of the chosen files (entities, merging) ask for all columns, and no filter of one gets below a column that
    # is not deterministic, so the two read one and the same shuffle.
    held = chosen.select(*KEY, F.when((F.spark_partition_id() >= 0) & (F.size("payload") > 0) & (F.length("cuts") >= 0), c("entities")).alias("entities"))
    groups = held.select(*KEY, F.explode("entities").alias("e")).select(*KEY, "e.*")
    edits = entity_edits(groups, book, round_, scoped).groupBy(*KEY).agg(F.collect_list(F.struct(*EDIT_FIELDS)).alias("edits"))
    every = F.size("entities") >= F.least(F.hash(*KEY), F.lit(0))  # always true, and asks for all columns
    part = lambda i: c("payload")[i] if logged else F.array().cast("array<string>")
    joined = chosen.join(edits.drop("path_id"), "file_id", "inner" if only_modified else "left").select(
        *KEY, c("payload")[0][0].alias("repo"), c("payload")[0][1].alias("path"),
        c("payload")[0][3 if round_ else 2].alias("original"), F.when(every, c("payload")[0][2]).alias("content"),
        part(1).alias("changes"), part(2).alias("errors"), part(3).alias("rules_applied"), "cuts", "edits",
    ).join(texts, "path_id", "left")
    new = _logged(merge(joined))
    if only_modified:
        return new
    return new.unionByName(_untouched(files.where(~acts), texts, round_))


def _logged(done: DataFrame) -> DataFrame:
    """The new texts with what the rules did: a message for each change, types of the rules that changed something."""
    return done.select(
        *KEY, "repo", "path", "original", F.col("code").alias("content"),
        F.concat("changes", F.expr(f"""
            transform(array(hits), hits -> flatten(transform({_ORDINALS}, o -> array_repeat(
               element_at(texts, o).message,
               cast(aggregate(filter(hits, h -> h.o = o), 0, (n, h) -> n + h.m) as int)))))[0]
        """)).alias("changes"),
        "errors",
        F.concat("rules_applied", F.expr(
            f"transform({_ORDINALS}, o -> element_at(texts, o).change_type)")).alias("rules_applied"),
    )


def _untouched(rest: DataFrame, texts: DataFrame, round_: int) -> DataFrame:
    """Files that no rule acts on, with an error for each rule where they cannot be read."""
    if round_ == 0:
        failed = F.expr("""
            transform(filter(texts, t -> t.handled), t -> concat('Rule \\'', t.description,
              '\\' failed: Syntax error in source: unbalanced brackets or open string'))
        """)
        rest = rest.join(texts, "path_id", "left").withColumn(
            "errors", F.concat("errors", F.when(
                ~lexically_valid(F.col("content")), F.coalesce(failed, F.array())).otherwise(F.array()))
        )
    return rest.select(*KEY, "repo", "path", "original", "content", "changes", "errors", "rules_applied")
