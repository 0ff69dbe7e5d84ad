"""Formatted strings: tokens against the standard library, rules inside fields."""

import io
import random
import tokenize

import pytest
from pyspark.sql import functions as F

from apidrift.functions.lexing import token_pieces, token_structs
from apidrift.operators.rewrite import migrate
from tests.helpers import files_frame, rule, rules_frame

SOURCES = [
    'f"{foo}"', 'f"a {foo} b {bar.baz} c"', "f'{x!r:>{width}}' + g", 'f"{{foo}} {foo}"', 'f"{d[\'k\']} {f(a, b=1)}"', 'f"{x:%Y-%m-%d}"',
    'f"""a\n  {foo\n }\n # {bar} x"""', 'rf"\\d{n}"', 'F\'{a if b else c}\'', 'f"{x=}" f"{x = !s}"', 'f"{a == b} {a != b} {a <= b} {(y := 1)}"',
    'f"{ {1: 2}[x] } {[i for i in z]}"', 'f"{f"{x} y"} z"', 'f"{g(f\'{h(1)}\')}"', 'f"\\N{DASH} {x}"', 'f"{(lambda q: q)(1):{w}.{p}}"', "x = f'{a}' 'b{c}' f'd'",
    'f"{a["k"]}"', "def f(x):\n    # {no} f'{no}\n    return f'{x}'\n", 'f"{x!r}" != f"{y}"', "f''", 'f"{x}{y}"', "f'{a:{b}{c}}'", "print(f'{foo(1, 2):>10} {bar}', sep=f'{s}')",
]


def library_names(text):
    """Names of the standard tokenizer with their columns, those in fields included; not the letters of conversions."""
    found = list(tokenize.generate_tokens(io.StringIO(text).readline))
    return [(t.start, t.string) for before, t in zip([None, *found], found) if t.type == tokenize.NAME and not (before and before.string == "!")]


def our_names(text, structs):
    lines = text.splitlines(keepends=True)
    starts = [sum(map(len, lines[:i])) for i in range(len(lines) + 1)]
    out, at = [], 0
    for s in structs:
        at += len(s.pre)
        if s.tok and (s.tok[0].isalpha() or s.tok[0] == "_") and not any(q in s.tok for q in "'\""):
            line = max(i for i, p in enumerate(starts) if p <= at)
            out.append(((line + 1, at - starts[line]), s.tok))
        at += len(s.tok)
    return out


def generated(seed, n):
    rnd = random.Random(seed)

    def expr(depth):
        name = rnd.choice(["foo", "bar", "x1", "obj.attr"])
        return rnd.choice([
            name, f"{name}(1, {name}=2)", f"{name}[0]", f"{name} + 1", f"({name}, 2)", f"{name}['k']" if depth == 2 else name,
            *([f"g({fstring(depth - 1)})"] if depth > 1 else [])])

    def fstring(depth):
        quote = '"' if depth == 2 else "'"
        body = ""
        for _ in range(rnd.randrange(4)):
            body += rnd.choice(["text ", "{{", "}}", "", "# ", "a: b!"])
            body += "{" + rnd.choice(["", " "]) + expr(depth if depth < 2 else rnd.choice([1, 2])) + rnd.choice(["", " ", "!r", ":>10", ":{w}", "=", "!s:>{w}"]) + "}"
        return "f" + quote + body + quote

    return [f"y = {fstring(2)}\nz = foo\n" for _ in range(n)]


def test_names_in_fields_like_the_standard_tokenizer(spark):
    sources = SOURCES + generated(3, 300)
    frame = spark.createDataFrame(list(enumerate(sources)), "i int, content string")
    for r in frame.select("i", "content", token_structs(F.col("content")).alias("t"), token_pieces(F.col("content")).alias("p")).collect():
        assert "".join(s.pre + s.tok for s in r.t) == r.content == "".join(r.p)
        assert [s.pre + s.tok for s in r.t] == list(r.p)
        assert our_names(r.content, r.t) == library_names(r.content), r.content


def test_strings_that_do_not_come_apart_stay_whole(spark):
    odd = ['f"{x"', "f'{'", 'f"{((((((x))))))}"', "f'}'", 'f"{x!}"', "f'{a:'", 'f"""{', "f'{x:\\'>10}'"]
    frame = spark.createDataFrame(list(enumerate(odd)), "i int, content string")
    for r in frame.select("content", token_pieces(F.col("content")).alias("p")).collect():
        assert "".join(r.p) == r.content


CASES = {
    "names": ([rule("rename_function", old_name="foo", new_name="bar")],
              "s = 'foo' + f\"foo {foo} {{foo}} {x.foo!r:>{foo}} {foo=}\"\n", "s = 'foo' + f\"foo {bar} {{foo}} {x.bar!r:>{bar}} {bar=}\"\n", 4),
    "attributes": ([rule("rename_attribute", old_name="url", new_name="endpoint")], "f'{url} {c.url} {a[\"url\"].url}'", "f'{url} {c.endpoint} {a[\"url\"].endpoint}'", 2),
    "added": ([rule("add_argument", function_name="f", argument_name="t", default_value="30")],
              'g(f"{f(1)} {x.f( )} {f(t=2)}", f(2))\n', 'g(f"{f(1, t=30)} {x.f(t=30 )} {f(t=2)}", f(2, t=30))\n', 3),
    "removed": ([rule("remove_argument", function_name="f", argument_name="v")], "f'{f(1, v=2)}{f(v=1)}'\n", "f'{f(1)}{f()}'\n", 2),
    "property": ([rule("replace_with_property", old_name="get", new_name="name")], "f'{x.get()} {y.get(1)}'\n", "f'{x.name} {y.get(1)}'\n", 1),
    "commas": ([rule("add_argument", function_name="f", argument_name="t", default_value="1")],
               'f(g(1), f"{a, b} {c}", h)\n', 'f(g(1), f"{a, b} {c}", h, t=1)\n', 1),
    "keyword": ([rule("rename_argument", function_name="f", argument_name="a", new_argument_name="b")], "f'{f(a=1):{f(a=2)}}'\n", "f'{f(b=1):{f(b=2)}}'\n", 2),
    "nested": ([rule("rename_class", old_name="A", new_name="B")], "f\"{g(f'{A}')} A {A}\"\n", "f\"{g(f'{B}')} A {B}\"\n", 2),
    "lines": ([rule("deprecate_function", old_name="h", replacement="k"), rule("rename_function", old_name="q", new_name="r")],
              "x = f'''\n{q}\n{q}\n'''\nh(f'{q}')\nf'{h()}'\n",
              "x = f'''\n{r}\n{r}\n'''\n# DEPRECATED: h() is deprecated. Use k instead.\nh(f'{r}')\nf'{h()}'\n", 4),
    "default": ([rule("change_argument_default", argument_name="t", default_value="5")],
                "f'{(lambda t=1, *a: t)(2)}'\ndef g(t=f'{a, b}', u=2): pass\n", "f'{(lambda t=5, *a: t)(2)}'\ndef g(t=5, u=2): pass\n", 2),
    "order": ([rule("reorder_arguments", function_name="g", new_order=["b", "a"])], "def g(a, b, c=f'{x, y}'): pass\n", "def g(b, a, c=f'{x, y}'): pass\n", 1),
}


@pytest.fixture(scope="module")
def results(spark):
    names = list(CASES)
    files = files_frame(spark, {i: CASES[n][1] for i, n in enumerate(names)})
    rules = rules_frame(spark, {i: CASES[n][0] for i, n in enumerate(names)})
    return {names[r.file_id]: r for r in migrate(files, rules).collect()}


@pytest.mark.parametrize("name", CASES)
def test_rules_in_fields(results, name):
    _, _, expected, changes = CASES[name]
    r = results[name]
    assert r.errors == [] and r.transformed_code == expected
    assert len(r.changes) == changes
