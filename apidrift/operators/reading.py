"""Syntax entities of a text, read in one pass over its tokens.

What ``structure`` and ``enclosing`` tell by windows over token rows (neighbours, depth, lines, statements,
enclosing brackets), told here for the rules at hand while the tokens of a file go by once. Tokens stay in
their file's row: none is sorted, shuffled or held beside those of other files. The lexer is the JVM's.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from apidrift.functions.lexing import COMPOUND_HEADS, FORMATTED, KEYWORDS
from apidrift.operators.rulebook import ATTR_CALL, ATTR_HIT, DEF, PARAM, PLAIN_CALL, PLAIN_HIT

ROW = (
    "array<struct<pos:int,tok:string,pre:string,prev1:string,next1:string,next2:string,next_pre:string,word:boolean,"
    "x1:int,x2:int>>"
)
ENTITY = (
    "struct<kind:string,gid:int,name:string,is_attr:boolean,ok:boolean,line_pos:int,indent:string,fn:string,"
    f"rows:{ROW}>"
)
#: Flags of names in the order in which their lists are handed over.
FLAGS = (PLAIN_HIT, ATTR_HIT, PLAIN_CALL, ATTR_CALL, DEF, PARAM)
# What rules of a path ask for (the bits of ``rewrite``).
CALL, DEFINITION, DEFAULT, IMPORT, DECORATOR = 1, 2, 4, 8, 16
#: What is read of a text: its entities, and the lengths of all its trivia and tokens, by turns (unsigned, four bytes each).
READ = f"struct<entities:array<{ENTITY}>,cuts:binary>"
#: Rows of entities that are turned into Arrow at once.
ROWS_AT_ONCE = 16384
# Letters beyond ASCII, as the lexer knows them.
LETTER = r"[\p{L}\p{Nl}&&[^\x00-\x7F]]"


def letters(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(LETTER), F.lit(0)))


def reader(need: frozenset, kinds: frozenset) -> Callable:
    """A function of the tokens of one file that gives its entities as tuples in the order of ``ENTITY``.

    ``pres`` and ``toks`` are the tokens, ``bits`` what the path's rules ask for, ``flags`` the flag words of
    names, ``letters`` the letters beyond ASCII in the text. It holds all it needs, so that workers need no
    module of this package.
    """
    keywords, heads = frozenset(KEYWORDS), frozenset(COMPOUND_HEADS)
    not_soft = frozenset(("in", "is", "and", "or", "if", "else", "for", "as", "async"))
    marks = frozenset(("(", "[", "{", ")", "]", "}", ",", "lambda", ":"))
    closing, harmless = frozenset(")]}"), frozenset((".", "(", ")", "[", "]", "{", "}", ""))
    with_fields = re.compile(rf"{FORMATTED}[\"']").match
    new_line = re.compile("^(?:[ \\t\\f﻿]|\\\\\\r?\\n)*+[#\\r\\n]").match
    deep, brackets = bool(need - {"names"}), "depth" in need
    alone, definitions, blocky = "alone" in need, "definitions" in need, "blocks" in need
    lines = alone or definitions or blocky
    defaults, reorders, statements = "default" in kinds, "reorder" in kinds, "statements" in need
    plain_hit, attr_hit, plain_call, attr_call, def_bit, param_bit = FLAGS

    def last_line(pre):
        return pre[max(pre.rfind("\n"), pre.rfind("\r")) + 1:]

    def entities(pres, toks, bits, flags, letters):
        n = len(toks)
        tok = [*toks, "", ""]  # neighbours beyond the end
        # a word: starts with a letter or an underscore, and is no string
        starts = [t[:1].isalpha() if t[:1].isascii() else t[0] in letters for t in toks]
        word = [(s or t[:1] == "_") and '"' not in t and "'" not in t for s, t in zip(starts, toks)]
        flag = [flags.get(t, 0) if flags else 0 for t in toks]
        out = []

        def named(i, is_attr):
            t = toks[i]
            if t in ("match", "case", "type"):
                following = tok[i + 1]
                first = following[:1]
                if first and (first in "_\"'" or "0" <= first <= "9" or starts[i + 1]) and following not in not_soft:
                    return
            if flag[i] & (attr_hit if is_attr else plain_hit):
                out.append(("n", i, t, is_attr, False, line_pos if lines else None, None, None,
                            [(i, None, None, None, None, None, None, None, None, None)]))

        line_pos = 0
        if not deep:
            for i in range(n):
                if word[i] and flag[i]:
                    named(i, i > 0 and toks[i - 1] == "." and (toks[i - 2] if i > 1 else "") not in ("from", ".", "..."))
            return out
        nl = [p != "" and p != " " and new_line(p) is not None for p in pres]
        nl += [True, True]
        fl = [*flag, 0, 0]
        next_pres = [*pres[1:], None]
        wants_default, wants_call = defaults and bool(bits & DEFAULT), bool(bits & (CALL | DEFINITION))
        wants_deco, wants_import = blocky and bool(bits & DECORATOR), statements and bool(bits & IMPORT)
        depth = spoiled = spoiled_before = parens = blocks = line_code = stmt_pos = 0
        stmt_from = False
        line_indent = ""
        def_pos = def_flag = def_parens = def_name = None
        levels = {}
        calls, params, decorated, imports = {}, {}, {}, {}
        listed, parameters = {}, []
        prev1 = prev2 = ""
        for i in range(n):
            t = toks[i]
            first, end = t[:1], t[-1:]
            middle = first != "" and first in "}!:=" and len(t) > 1 and (end == "{" or end == '"' or end == "'")
            between = middle and end == "{"
            opener = t == "(" or t == "[" or t == "{" or between or (end == "{" and with_fields(t) is not None)
            closer = t in closing or middle
            depth_before = depth
            depth += opener - closer
            level = depth + 1 if closer and not opener else depth
            outer = depth if depth < depth_before else depth_before
            new = i == 0 or (nl[i] and depth_before == 0)
            previous_code = line_code
            if new or (prev1 == ";" and depth_before == 0):
                stmt_pos, stmt_from, spoiled_before = i, t == "from", spoiled
            if new:
                if lines:
                    compound = t in heads and not (t in ("match", "case") and tok[i + 1] in ("(", ".", "[", "=", ",", ":"))
                    line_pos = i
                    line_code = compound + 2 * (t == "@") + 4 * (t == "def" or t == "async")
                    if alone:
                        line_indent = last_line(pres[i])
                if t != "@":
                    blocks += 1
            if alone and outer == 0 and (t in keywords if word[i] else (
                    '"' not in t and "'" not in t and not (opener and len(t) > 1) and t not in harmless)):
                spoiled += 1
            if definitions:
                if t == "(" and outer == 0:
                    parens += 1
                if prev1 == "def":
                    def_pos, def_flag, def_parens, def_name = i, fl[i], parens, t
            if word[i] and fl[i]:
                named(i, prev1 == "." and prev2 not in ("from", ".", "..."))
            if wants_deco and new:
                if t == "@":
                    if nl[i + 2] and i + 1 < n and word[i + 1]:
                        decorated.setdefault(blocks, []).append((i, None, None, None))
                elif t == "def" or (t == "async" and tok[i + 1] == "def"):
                    if fl[i + 2 if t == "async" else i + 1] & def_bit:
                        decorated.setdefault(blocks - 1, []).append((
                            i, tok[i + 2] if t == "async" else tok[i + 1], int(previous_code & 2 != 0), last_line(pres[i])))
            if wants_import and stmt_from:
                imports.setdefault(stmt_pos, []).append(i)
            if brackets and (opener or t in marks or (wants_default and t == "=")) and (
                    wants_default or (wants_call and level > 0)):
                state = levels.get(level)
                if state is None:
                    state = levels[level] = [0, 0, 0, -1, 0]  # walk, floor, lambda depth, open, head
                if opener:
                    head = 0
                    if t == "(":
                        if prev2 != "def" and prev2 != "class" and i and fl[i - 1] & (attr_call if prev2 == "." else plain_call):
                            head = 1
                        if (definitions and outer == 0 and line_code & 4 and def_pos is not None and def_pos > line_pos
                                and parens == def_parens + 1):
                            head += 4 + (2 if def_flag & def_bit else 0)
                    state[3], state[4] = i, head
                lam = state[2]
                state[0] += (t == "lambda") - (t == ":")
                if state[0] < state[1]:
                    state[1] = state[0]
                state[2] = state[0] - state[1]
                if t != ":":
                    lam = state[2]
                head = state[4]
                if lam == 0 and (t == "(" or t == "," or t == ")"):
                    if head & 1:
                        calls.setdefault(state[3], []).append((i, (
                            outer == 0 and spoiled == spoiled_before and not line_code & 1 if t == "(" else
                            outer == 0 and (tok[i + 1] in ("", ";") or nl[i + 1]) if t == ")" else True), line_pos, line_indent))
                    if reorders and head & 2:
                        params.setdefault(state[3], []).append((i, def_name, line_pos))
                if defaults:
                    if (lam == 0 and head & 4 and level > 0 and t in ("(", ",", "=", ")")) or (
                            lam > 0 and t in ("lambda", ",", "=", ":")):
                        column = listed.setdefault((level, lam), [])
                        if t == "(" or t == "," or t == "lambda":
                            starred = tok[i + 1] in ("*", "**")
                            if fl[i + 2 if starred else i + 1] & param_bit:
                                parameters.append((i, tok[i + 2 if starred else i + 1], def_name if lam == 0 else None, line_pos, column, len(column)))
                        column.append((i, t == "="))
            prev1, prev2 = t, prev1

        def before(i):
            return toks[i - 1] if i else ""

        for gid, group in calls.items():
            i = group[0][0]
            if i == gid:
                out.append((
                    "c", gid, before(i), i > 1 and toks[i - 2] == ".", alone and all(g[1] for g in group),
                    max(g[2] for g in group) if lines else None, group[0][3] if alone else None, None,
                    [(g[0], toks[g[0]], None, None, tok[g[0] + 1], tok[g[0] + 2], next_pres[g[0]], None, None, None) for g in group]))
        for gid, group in params.items():
            if group[0][0] == gid:
                out.append((
                    "d", gid, group[0][1], False, False, max(g[2] for g in group), None, None,
                    [(g[0], toks[g[0]], pres[g[0]], None, tok[g[0] + 1], tok[g[0] + 2], next_pres[g[0]], None, None, None) for g in group]))
        for i, name, fn, at, column, place in parameters:
            one = column[place + 1] if place + 1 < len(column) else None
            two = column[place + 2] if place + 2 < len(column) else None
            given = one is not None and one[1]
            stop = two if given else one
            out.append(("p", i, name, False, False, at, None, fn, [(
                i, toks[i], None, None, tok[i + 1], tok[i + 2], None, None, one[0] if given else None, stop[0] - 1 if stop else None)]))
        for gid, group in decorated.items():
            i, name, x1, indent = group[-1]
            if name is not None:
                out.append(("e", gid, name, False, False, i, indent, None, [
                    (g[0], toks[g[0]], None, None, tok[g[0] + 1], None, None, None, g[2], None) for g in group]))
        for gid, group in imports.items():
            out.append(("i", gid, "", False, False, None, None, None, [
                (j, toks[j], None, before(j), None, None, None, word[j], None, None) for j in group]))
        return out

    return entities


def entity_arrays(need: frozenset, kinds: frozenset) -> Callable[..., Column]:
    """Column function: ``READ`` from trivia, tokens, bits, letters and a list of names for each of ``FLAGS``.

    Not deterministic in the eyes of the optimizer, so that it is never evaluated twice.
    """
    entities = reader(need, kinds)
    of_flags, at_once = FLAGS, ROWS_AT_ONCE

    @F.arrow_udf(READ)
    def read(pres: pa.Array, toks: pa.Array, bits: pa.Array, letters: pa.Array, *lists: pa.Array) -> pa.Array:
        row_types = [pa.int32(), *[pa.string()] * 6, pa.bool_(), pa.int32(), pa.int32()]
        row_names = ["pos", "tok", "pre", "prev1", "next1", "next2", "next_pre", "word", "x1", "x2"]
        types = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        names = ["kind", "gid", "name", "is_attr", "ok", "line_pos", "indent", "fn", "rows"]

        def built(files):
            found = [e for file in files for e in file]
            rows = [r for e in found for r in e[8]]
            columns = [*zip(*rows)] or [()] * len(row_types)
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, row_types)], row_names)
            ends = [0]
            for e in found:
                ends.append(ends[-1] + len(e[8]))
            columns = [*zip(*found)] or [()] * 9
            held = pa.StructArray.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, types)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], names)
            ends = [0]
            for file in files:
                ends.append(ends[-1] + len(file))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)

        parts, files, cuts, size, start = [], [], [], 0, 0
        all_pres, all_toks = pres.flatten(), toks.flatten()
        lists = [of.to_pylist() for of in lists]
        for i, (length, asked, beyond) in enumerate(zip(pc.list_value_length(toks).to_pylist(), bits.to_pylist(), letters.to_pylist())):
            flags = {}
            for bit, of in zip(of_flags, lists):
                for name in of[i] or ():
                    flags[name] = flags.get(name, 0) | bit
            one, two = (held.slice(start, length).to_numpy(zero_copy_only=False).tolist() for held in (all_pres, all_toks))
            start += length
            cuts.append(array("I", [len(x) for pair in zip(one, two) for x in pair]).tobytes())
            files.append(entities(one, two, asked, flags, frozenset(beyond)))
            size += sum(len(e[8]) for e in files[-1])
            if size >= at_once:
                parts.append(built(files))
                files, size = [], 0
        if files or not parts:
            parts.append(built(files))
        return pa.StructArray.from_arrays([pa.concat_arrays(parts), pa.array(cuts, pa.binary())], ["entities", "cuts"])

    return read.asNondeterministic()
