"""Lexical analysis of Python source as Spark column expressions.

A source text is cut by one regular expression into significant tokens, each
with the trivia (blanks, comments, newlines, line continuations) that precedes
it.  Both halves together are lossless: ``pre1 tok1 pre2 tok2 ...`` is the text.
Everything here is row-local, so it needs no shuffle.

A formatted string with replacement fields is cut once more: the text up to a field's
opening brace is a token of its own, then come the tokens of the expression, then the
text from the expression's end (conversion, format, closing brace, literal text) to the
next field or the closing quote. Names inside fields are names like all others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexical grammar. Group loops are possessive because the JVM
# matches those iteratively; a greedy loop over alternatives would recurse and
# overflow the stack on a long docstring.
TRIVIA = r"(?:[ \t\f\r\n﻿]++|#[^\r\n]*+|\\\r?\n)*+"
STRING = (
    r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:"
    r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
    r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
    r'|"(?!"")(?:[^"\\\r\n]++|\\(?:\r\n|[\s\S]))*+"'
    r"|'(?!'')(?:[^'\\\r\n]++|\\(?:\r\n|[\s\S]))*+')"
)
# The quoted part of a string, whatever its prefix.
QUOTED = STRING[STRING.index("?(?:", 1) + 1:]
NAME = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*+"
NUMBER = (
    r"0[xXoObB][0-9a-fA-F_]++"
    r"|(?:[0-9][0-9_]*+(?:\.(?:[0-9][0-9_]*+)?)?|\.[0-9][0-9_]*+)"
    r"(?:[eE][+-]?[0-9][0-9_]*+)?[jJ]?"
)
OPERATOR = (
    r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@="
    r"|\*\*|//|<<|>>"
)
# Prefixes of formatted strings.
FORMATTED = r"(?:[fFtT][rR]?|[rR][fFtT])"
#: Brackets in a field are followed to this depth; a string with deeper ones stays one token.
NESTED = 4


def _bracketed(depth: int) -> str:
    inner = "".join(f"|{part}" for part in ([_bracketed(depth - 1)] if depth > 1 else []))
    return rf"""[(\[{{](?:[^()\[\]{{}}"']++|{QUOTED}{inner})*+[)\]}}]"""


BRACKETED = _bracketed(NESTED)
# A whole formatted string. Its fields may hold strings in the same quotes; where they
# do not close, the string is taken like any other.
_FIELD = rf"""\{{(?:[^{{}}()\[\]"']++|{QUOTED}|{BRACKETED})*+\}}"""
_FIELD_IN_LINE = rf"""\{{(?:[^{{}}()\[\]"'\r\n]++|{QUOTED}|{BRACKETED})*+\}}"""
_NAMED = r"\\N\{[^{}]*+\}"
FORMATTED_STRING = (
    rf"{FORMATTED}(?:"
    rf'"""(?:[^"\\{{]++|{_NAMED}|\\[\s\S]|"(?!"")|\{{\{{|{_FIELD})*+"""'
    rf"|'''(?:[^'\\{{]++|{_NAMED}|\\[\s\S]|'(?!'')|\{{\{{|{_FIELD})*+'''"
    rf'|"(?!"")(?:[^"\\\r\n{{]++|{_NAMED}|\\(?:\r\n|[\s\S])|\{{\{{|{_FIELD_IN_LINE})*+"'
    rf"|'(?!'')(?:[^'\\\r\n{{]++|{_NAMED}|\\(?:\r\n|[\s\S])|\{{\{{|{_FIELD_IN_LINE})*+')"
)
# Inside a formatted string: literal text up to a field (or the end), then the field's
# expression, which ends at ``!r``, ``:``, a debugging ``=`` or the closing brace.
_LITERAL = rf"(?:[^{{\\]++|{_NAMED}|\\N(?!\{{)|\\[^{{N]|\\(?=\{{)|\{{\{{)*+(?:\{{|\z)"
_EXPRESSION = (
    rf"""(?:[^{{}}()\[\]"'!:=<>]++|{QUOTED}|{BRACKETED}|[!=<>]=|[<>]|=(?!\s*+[!:}}])|!(?![rsa]\s*+[:}}]))*+"""
)
FIELD = rf"({_LITERAL})({_EXPRESSION})"
# Text between two expressions of a formatted string, and behind the last one.
BETWEEN, BEHIND = r"^[}!:=][\s\S]*\{$", r"^[}!:=][\s\S]*[\"']$"
BEFORE = rf"^{FORMATTED}[\"'][\s\S]*\{{$"
TOKEN = rf"({TRIVIA})({FORMATTED_STRING}|{STRING}|{NAME}|{NUMBER}|{OPERATOR}|[\s\S]|\z)"

# Reserved words that can never be an identifier node.
KEYWORDS = (
    "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del",
    "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in",
    "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while",
    "with", "yield",
)
# Reserved words that may occur inside an expression.
EXPRESSION_KEYWORDS = (
    "and", "async", "await", "else", "for", "if", "in", "is", "lambda", "not", "or", "yield", "from",
)
# Words that open a compound statement (its one-line body is not a
# simple statement line).
COMPOUND_HEADS = (
    "async", "case", "class", "def", "elif", "else", "except", "finally", "for", "if",
    "match", "try", "while", "with",
)
# Characters that are no token of the language on their own; a lone
# quote or backslash is an unterminated string or a stray continuation.
BROKEN = ('"', "'", "\\", "$", "?", "`", "!")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def token_trivia(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TOKEN), F.lit(1))


def token_texts(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TOKEN), F.lit(2))


def _has_field(piece: Column) -> Column:
    return piece.contains("{") & piece.rlike(rf"^{TRIVIA}{FORMATTED}[\"'][\s\S]*\{{")


def _cut_fields(piece: Column, depth: int) -> Column:
    """A formatted string as pieces: text, the expression's own pieces, text, ...

    Blanks behind an expression go with the text that follows. A string that does not
    come apart cleanly stays one piece.
    """
    trivia = rf"^{TRIVIA}"

    def build(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            blanks = F.when(i == 0, F.regexp_extract(piece, trivia, 0)).otherwise(F.regexp_extract(F.get(parts, i - 1)["expr"], r"\s*+\z", 0))
            return F.concat(
                F.array(F.concat(blanks, part["text"])),
                F.filter(_pieces(F.regexp_replace(part["expr"], r"\s++\z", ""), depth), lambda p: p != ""))

        clean = F.forall(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p["text"].rlike("^[}!:=]"))
        return F.when(clean, F.flatten(F.transform(parts, one))).otherwise(F.array(piece))

    def parts(tok: Column) -> Column:
        return F.filter(F.arrays_zip(
            F.regexp_extract_all(tok, F.lit(FIELD), F.lit(1)).alias("text"), F.regexp_extract_all(tok, F.lit(FIELD), F.lit(2)).alias("expr"),
        ), lambda p: p["text"] != "")

    return let(let(F.regexp_replace(piece, trivia, ""), parts), build)


def _pieces(content: Column, depth: int) -> Column:
    plain = F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))
    if not depth:
        return plain
    return F.when(content.rlike(rf"{FORMATTED}[\"'][\s\S]*\{{"), F.flatten(F.transform(
        plain, lambda p: F.when(_has_field(p), _cut_fields(p, depth - 1)).otherwise(F.array(p))))).otherwise(plain)


def token_pieces(content: Column) -> Column:
    """Each token together with the trivia before it; the pieces concatenate to the text.

    Formatted strings are cut at their fields, and those within a field once more.
    """
    return _pieces(content, 2)


def token_structs(content: Column) -> Column:
    """Tokens as structs ``pre`` (trivia), ``tok``, in the order of ``token_pieces``."""
    pre = rf"^{TRIVIA}"
    return F.when(content.rlike(rf"{FORMATTED}[\"'][\s\S]*\{{"), F.transform(token_pieces(content), lambda p: F.struct(
        F.regexp_extract(p, pre, 0).alias("pre"), F.regexp_replace(p, pre, "").alias("tok"),
    ))).otherwise(F.arrays_zip(token_trivia(content).alias("pre"), token_texts(content).alias("tok")))


def opens(tok: Column) -> Column:
    """An opening bracket, or the text before a field."""
    return tok.isin("(", "[", "{") | between(tok) | (tok.endswith("{") & tok.rlike(BEFORE))


def closes(tok: Column) -> Column:
    """A closing bracket, or the text behind a field."""
    return tok.isin(")", "]", "}") | between(tok) | (tok.rlike("^[}!:=]") & tok.rlike(BEHIND))


def between(tok: Column) -> Column:
    """The text between two fields: it closes one and opens the other."""
    return tok.endswith("{") & (F.length(tok) > 1) & tok.rlike(BETWEEN)


def identifiers(content: Column) -> Column:
    """All identifier-shaped words, wherever they occur (cheap superset of tokens)."""
    return F.regexp_extract_all(content, F.lit(NAME), F.lit(0))


def is_name(tok: Column) -> Column:
    """Token is a word (identifier or keyword), not a prefixed string."""
    return tok.rlike(r"^[\p{L}\p{Nl}_]") & ~tok.rlike("[\"']")


def starts_line(pre: Column) -> Column:
    """Trivia holds a newline that is not a continuation."""
    return pre.rlike(r"^(?:[ \t\f﻿]|\\\r?\n)*+[#\r\n]")


def bracket_state(tokens: Column) -> Column:
    """Open brackets left after reading all tokens; is ``X`` after a mismatch.

    The state is the short string of open brackets, so the fold is linear.
    """
    step = (
        lambda s, t: F.when(s == "X", s)
        .when(t.isin("(", "[", "{"), F.concat(s, t))
        .when(
            F.concat(F.right(s, F.lit(1)), t).isin("()", "[]", "{}"),
            F.substring(s, F.lit(1), F.length(s) - 1),
        )
        .otherwise(F.lit("X"))
    )
    brackets = F.filter(tokens, lambda t: t.isin("(", "[", "{", ")", "]", "}"))
    return F.aggregate(brackets, F.lit(""), step)


def lexically_valid(content: Column) -> Column:
    """Strings are closed, brackets match in kind and order, no foreign characters."""
    return let(
        token_texts(content),
        lambda toks: (bracket_state(toks) == "") & ~F.exists(toks, lambda t: t.isin(*BROKEN)),
    )


def expression_valid(text: Column) -> Column:
    """Lexical check that ``text`` can be one Python expression.

    Non-empty, lexically valid, no statement keyword, no two operands side by
    side (adjacent string literals are one operand).
    """
    operand = (
        lambda t: (t.rlike(r"^[\p{L}\p{Nl}_0-9\"']") | t.rlike(r"^\.[0-9]"))
        & ~t.isin(*EXPRESSION_KEYWORDS)
    )
    literal = lambda t: t.rlike("[\"']$")
    statement_words = [k for k in KEYWORDS if k not in EXPRESSION_KEYWORDS]

    def check(toks: Column) -> Column:
        side_by_side = F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(toks) - 1, F.lit(1))),
            lambda i: (
                operand(F.get(toks, i - 1)) & operand(F.get(toks, i))
                & ~(literal(F.get(toks, i - 1)) & literal(F.get(toks, i)))
            ),
        )
        dangling = F.element_at(toks, -1).isin(
            "+", "-", "*", "/", "//", "%", "**", "@", "&", "|", "^", "~", "<<", ">>", "<", ">",
            "<=", ">=", "==", "!=", ".", ":", "and", "or", "not", "in", "is", "if", "else",
            "lambda", "await", "for", "from",
        ) | F.element_at(toks, 1).isin(
            "*", "/", "//", "%", "**", "@", "&", "|", "^", "<<", ">>", "<", ">", "<=", ">=", "==",
            "!=", ".", ",", ":", "and", "or", "in", "is", "if", "else", "for", "from",
        )
        # ``=`` is fine for keywords in brackets and for defaults of a lambda
        assigned = ~F.array_contains(toks, "lambda") & F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))),
            lambda i: (F.get(toks, i - 1) == "=") & (bracket_state(F.slice(toks, 1, i)) == ""),
        )
        return (
            (F.size(toks) > 0)
            & (bracket_state(toks) == "")
            & ~F.exists(toks, lambda t: t.isin(*BROKEN) | t.isin(*statement_words) | (t == ";"))
            & ~(F.exists(toks, lambda t: t == "=") & assigned)
            & ~F.coalesce(side_by_side, F.lit(False))
            & ~F.coalesce(dangling, F.lit(False))
        )

    return let(F.filter(token_texts(text), lambda t: t != ""), check)
