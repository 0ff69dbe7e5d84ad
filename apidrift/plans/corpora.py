"""Changelogs, pins and source corpora derived from the given tables.

Each derivation is one SQL text that Spark and DuckDB read alike, so that a check
query can start from the same rows. Documents and files are bounded by construction:
a library takes orders of one customer within a range of order keys, a file takes
events of one user within a range of event ids, however skewed the tables are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apidrift.session import text_partitions
from apidrift.sources.changelogs import RULE_FIELDS

RANGE = 65536     # order keys per library
EVENTS = 16384    # event ids per file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Change types in the order the corpus numbers them.
_TYPES = (
    "rename_function", "rename_class", "rename_attribute", "rename_import", "add_argument",
    "remove_argument", "change_argument_default", "reorder_arguments", "deprecate_function",
    "remove_function", "remove_class", "change_return_type", "replace_with_property",
    "move_to_module", "wrap_in_context_manager", "add_decorator", "remove_decorator",
)
_TYPE_CASE = "CASE k % 17 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"

# One rule per order, with every kind of fault somewhere. ``{orders}`` is the table.
RULE_ROWS = f"""
SELECT r0.*,
  CAST(row_number() OVER (PARTITION BY library, version ORDER BY k) - 1 AS INT) AS pos
FROM (
SELECT library, version, release_date, k,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '' WHEN k % 4 = 0 THEN 'DUP' ELSE 'R' || k END AS id,
  CASE WHEN k % 53 = 0 THEN 'rename_everything' WHEN k % 3 = 0 THEN 'rename_function'
       WHEN k % 59 = 0 THEN NULL ELSE {_TYPE_CASE} END AS change_type,
  CASE WHEN k % 13 = 0 THEN 'v' || version ELSE version END AS version_introduced,
  CASE WHEN k % 47 = 0 THEN NULL ELSE o_orderpriority || ' order ' || k END AS description,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 31 = 0 THEN '' ELSE 'fn_' || (k % 2) END AS old_name,
  CASE WHEN k % 37 = 0 THEN NULL ELSE 'new_' || (k % 5) END AS new_name,
  CASE WHEN k % 41 = 0 THEN NULL ELSE 'call_' || (k % 7) END AS function_name,
  CASE WHEN k % 43 = 0 THEN NULL ELSE 'arg_' || (k % 5) END AS argument_name,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '30' WHEN 2 THEN '{{{{"a": [1, 2]}}}}' WHEN 3 THEN 'class class # bad'
       WHEN 4 THEN 'f(x' ELSE 'x if y else z' END AS default_value,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'b,a' END AS order_text,
  'pkg.m' || (k % 3) AS old_module, CASE WHEN k % 61 = 0 THEN NULL ELSE 'pkg.n' || (k % 3) END AS new_module,
  'src.m' || (k % 3) AS source_module, CASE WHEN k % 2 = 0 THEN 'dst.m' ELSE NULL END AS target_module,
  CASE WHEN k % 67 = 0 THEN '' ELSE 'deco_' || (k % 3) END AS decorator_name,
  CASE k % 11 WHEN 0 THEN 'risky' WHEN 1 THEN 'unsafe' WHEN 2 THEN NULL ELSE 'safe' END AS safety,
  CASE WHEN k % 7 = 0 THEN '123' ELSE NULL END AS unknown_field
FROM (
  SELECT 'lib' || o_custkey || '_' || CAST(floor(o_orderkey / {RANGE}) AS BIGINT) AS library,
         (year(o_orderdate) - 1991) || '.' || month(o_orderdate) || '.' || (o_orderkey % 3) AS version,
         (year(o_orderdate)) || '-' || month(o_orderdate) AS release_date,
         o_orderkey AS k, o_orderpriority
  FROM {{orders}}
) o ) r0
"""

# ``vpos``: versions are listed by their first order, not by version order.
VERSION_ROWS = f"""
SELECT library, version, release_date, n_rules, first_k,
  CAST(row_number() OVER (PARTITION BY library ORDER BY first_k) - 1 AS INT) AS vpos
FROM (SELECT library, version, min(release_date) AS release_date, CAST(count(*) AS INT) AS n_rules,
             min(k) AS first_k FROM ({RULE_ROWS}) r GROUP BY library, version) v
"""

_LIBRARIES = f"""
SELECT DISTINCT 'lib' || o_custkey || '_' || CAST(floor(o_orderkey / {RANGE}) AS BIGINT) AS library,
       o_custkey AS c FROM {{orders}}
"""
# Upgrades, downgrades, equal, unlisted, short and ``latest`` versions.
PINS = f"""
SELECT 'repo' || (c % 50) || '/' || library AS repo, library,
  CASE c % 7 WHEN 0 THEN '0.0.0' WHEN 1 THEN '5.9.9' WHEN 2 THEN '3' WHEN 3 THEN '7.12.2' WHEN 4 THEN '4.4'
       WHEN 5 THEN '2.0.0' ELSE '6.6.1' END AS from_version,
  CASE c % 6 WHEN 0 THEN 'latest' WHEN 1 THEN '1' WHEN 2 THEN '5.6.0' WHEN 3 THEN '0.9.9'
       WHEN 4 THEN '4' ELSE '2.0.0' END AS to_version
FROM ({_LIBRARIES}) l
"""


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RULE_ROWS, orders=table(spark, sf_dir, "orders"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PINS, orders=table(spark, sf_dir, "orders"))


def changelog_documents(spark: SparkSession, sf_dir: str, bare: bool = False, where: str = "true") -> DataFrame:
    """Changelog documents ``doc_id, content`` (``doc_id`` is the library's name)."""
    rules = rule_rows(spark, sf_dir).where(where)
    present = [f for f in RULE_FIELDS if f in rules.columns]
    one = F.struct(
        *present,
        F.when(F.col("order_text").isNotNull(), F.filter(
            F.split("order_text", ","), lambda x: x != "")).alias("new_order"),
        "unknown_field",
    )
    versions = rules.groupBy("library", "version").agg(
        F.min("release_date").alias("release_date"), F.min("k").alias("first_k"),
        F.array_sort(F.collect_list(F.struct("pos", one.alias("rule")))).alias("rs"),
    ).select(
        "library", "first_k",
        F.struct(
            "version", "release_date", F.lit("n").alias("notes"),
            F.when(F.col("first_k") % 5 == 0, F.lit("red")).alias("colour"),
            F.transform("rs", lambda r: r["rule"]).alias("rules"),
        ).alias("v"),
    )
    docs = versions.groupBy("library").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_k", "v"))), lambda x: x["v"]).alias("versions"),
        F.min("first_k").alias("k"),
    )
    body = F.to_json("versions") if bare else F.to_json(F.struct(
        "library", F.when(F.col("k") % 3 == 0, F.lit("me")).alias("author"), "versions"))
    return docs.select(F.col("library").alias("doc_id"), body.alias("content"))


class Corpus:
    """Source files written from ``events``: a header, then one line per event.

    ``head``: (source, expected, changes); ``lines``: event type -> the same, as SQL
    texts over ``event_id`` and ``user_id``. The expected text is assembled line by
    line from reading the rules, without any lexer.
    """

    KINDS = ("click", "error", "view", "purchase", "signup")

    def __init__(self, rules, head, lines):
        self.rules, self.head, self.lines = rules, head, lines

    @staticmethod
    def quote(text: str) -> str:
        return " || chr(10) || ".join("'" + t.replace("'", "''") + "'" for t in text.split("\n"))

    def _case(self, part: int) -> str:
        whens = " ".join(
            f"WHEN '{k}' THEN {self.lines[k][part] if k in self.lines else ('0' if part == 2 else self.quote('pass'))}"
            for k in self.KINDS
        )
        return f"CASE event_type {whens} ELSE {'0' if part == 2 else self.quote('pass')} END"

    def files_sql(self, part: int, string_agg: str, events: str = "events") -> str:
        return f"""
        SELECT user_id || '_' || bucket AS file_id, 'u' || (user_id % 20) AS repo,
               'pkg/f' || user_id || '_' || bucket || '.py' AS path,
               {self.quote(self.head[part])} || chr(10) || body || chr(10) AS content, n_changes
        FROM (SELECT user_id, bucket, {string_agg} AS body, sum(n) + {self.head[2]} AS n_changes
              FROM (SELECT user_id, event_id, CAST(floor(event_id / {EVENTS}) AS BIGINT) AS bucket,
                           {self._case(part)} AS line, {self._case(2)} AS n FROM {events}) e
              GROUP BY user_id, bucket) b
        """

    def files(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = self.files_sql(0, "listagg(line, chr(10)) WITHIN GROUP (ORDER BY event_id)", "@events")
        sql = sql.replace("{", "{{").replace("}", "}}").replace("@events", "{events}")
        events = table(spark, sf_dir, "events")
        partitions = text_partitions(events)
        return spark.sql(sql, events=events).drop("n_changes").repartition(
            partitions, "file_id").withColumn("path_id", F.lit(1))

    def expected_sql(self) -> str:
        return self.files_sql(1, "string_agg(line, chr(10) ORDER BY event_id)")

    def source_sql(self) -> str:
        return self.files_sql(0, "string_agg(line, chr(10) ORDER BY event_id)")


_RULE_TYPES = (
    "path_id int, ordinal int, change_type string, description string, old_name string, new_name string, "
    "function_name string, argument_name string, new_argument_name string, default_value string, "
    "old_module string, new_module string, replacement string, decorator_name string, source_module string, "
    "target_module string, new_order array<string>"
)


def rule_table(spark: SparkSession, rules, path_id: int = 1) -> DataFrame:
    """Rules given as dicts, in order, as the rule table of one path."""
    fields = [f.strip().split()[0] for f in _RULE_TYPES.split(", ")]
    rows = [
        tuple({**r, "path_id": path_id, "ordinal": i + 1, "description": r.get("description", r["change_type"])}.get(f)
              for f in fields)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, _RULE_TYPES)


def _rule(change_type: str, **fields):
    return {"change_type": change_type, **fields}


# The worked example: a seed catalogue's library whose rules touch every kind of syntax once.
EXAMPLE = Corpus(
    [
        _rule("rename_class", old_name="Packet", new_name="SeedPacket"),
        _rule("rename_import", old_module="seedbank.stock", old_name="Shelf", new_module="seedbank.storage", new_name="Rack"),
        _rule("rename_function", old_name="germinate", new_name="sprout"),
        _rule("remove_argument", function_name="sprout", argument_name="quiet"),
        _rule("add_argument", function_name="sow", argument_name="depth", default_value="2.5"),
        _rule("rename_attribute", old_name="moisture", new_name="humidity"),
        _rule("replace_with_property", old_name="get_label", new_name="label"),
        _rule("deprecate_function", old_name="prune", replacement="trim"),
        _rule("change_argument_default", argument_name="spacing", default_value="15"),
        _rule("add_decorator", function_name="harvest", decorator_name="logged"),
        _rule("move_to_module", old_name="Almanac", source_module="seedbank.misc", target_module="seedbank.calendar"),
        _rule("rename_function", old_name="sow", new_name="plant"),
    ],
    (
        "from seedbank.stock import Shelf, Packet\nfrom seedbank.misc import Almanac\n@cached\n"
        "def harvest(bed, spacing=10):\n    return Packet(bed)",
        "from seedbank.storage import Rack, SeedPacket\nfrom seedbank.calendar import Almanac\n@cached\n@logged\n"
        "def harvest(bed, spacing=15):\n    return SeedPacket(bed)",
        6,
    ),
    {
        "click": ("'bed = sow(\"b' || user_id || '\", rows=' || (event_id % 90) || ')'",
                  "'bed = plant(\"b' || user_id || '\", rows=' || (event_id % 90) || ', depth=2.5)'", 2),
        "error": ("'germinate(' || event_id || ', quiet=True)'", "'sprout(' || event_id || ')'", 2),
        "view": ("'print(bed.moisture, f\"{bed.moisture:.1f} {{moisture}} ' || event_id || '\")'",
                 "'print(bed.humidity, f\"{bed.humidity:.1f} {{moisture}} ' || event_id || '\")'", 2),
        "purchase": ("'prune(bed)  # sow ' || event_id",
                     "'# DEPRECATED: prune() is deprecated. Use trim instead.' || chr(10) || 'prune(bed)  # sow ' || event_id", 1),
        "signup": ("'tag = bed.get_label()'", "'tag = bed.label'", 1),
    },
)

Q = Corpus.quote

# One corpus per rewrite operation, with hits, near misses and layouts.
OPERATIONS = {
    "r1_rename_name": Corpus(
        [_rule("rename_function", old_name="gather", new_name="collect")],
        ("import gather.a as gather\ndef gather(gather=1): return 'gather'",
         "import collect.a as collect\ndef collect(collect=1): return 'gather'", 4),
        {
            "click": ("'x = gather(' || event_id || ', gather=a.gather)  # gather'",
                      "'x = collect(' || event_id || ', collect=a.collect)  # gather'", 3),
            "view": ("'gather2(\"gather ' || event_id || '\")'", "'gather2(\"gather ' || event_id || '\")'", 0),
            "error": (Q('"""gather\n"gather" """; gather'), Q('"""gather\n"gather" """; collect'), 1),
            "signup": ('\'print(f"{gather(\' || event_id || \')} {{gather}} {x.gather!r:>{gather}} gather")\'',
                      '\'print(f"{collect(\' || event_id || \')} {{gather}} {x.collect!r:>{collect}} gather")\'', 3),
        },
    ),
    "r2_rename_class": Corpus(
        [_rule("rename_class", old_name="Boat", new_name="Barge")],
        ("class Boat(Base): pass", "class Barge(Base): pass", 1),
        {
            "click": ("'c: Boat = Boat(' || event_id || ')'", "'c: Barge = Barge(' || event_id || ')'", 2),
            "view": ("'MyBoat(' || event_id || ')'", "'MyBoat(' || event_id || ')'", 0),
            "error": (Q("from m import (Boat,\n  Boat as C)"), Q("from m import (Barge,\n  Barge as C)"), 2),
            "signup": ("'log(f''{Boat.name} Boat {Boat(' || event_id || ')}'')'",
                      "'log(f''{Barge.name} Boat {Barge(' || event_id || ')}'')'", 2),
        },
    ),
    "r3_rename_attribute": Corpus(
        [_rule("rename_attribute", old_name="hull", new_name="keel")],
        ("from .hull import a\nfrom a.hull import hull", "from .hull import a\nfrom a.keel import hull", 1),
        {
            "click": ("'print(client.hull, hull, f(hull=' || event_id || ').hull . hull)'",
                      "'print(client.keel, hull, f(hull=' || event_id || ').keel . keel)'", 3),
            "view": ("'hull = ' || event_id || '.5; \"a.hull\"'", "'hull = ' || event_id || '.5; \"a.hull\"'", 0),
            "error": (Q("(a\n  .hull)  # a.hull"), Q("(a\n  .keel)  # a.hull"), 1),
            "signup": ('\'print(f"{a.hull} {hull} a.hull \' || event_id || \'")\'',
                      '\'print(f"{a.keel} {hull} a.hull \' || event_id || \'")\'', 1),
        },
    ),
    "r4_rename_import": Corpus(
        [_rule("rename_import", old_module="harbour.core", old_name="Boat", new_module="harbour.client", new_name="Barge")],
        ("from harbour.core import *\nimport harbour.core", "from harbour.client import *\nimport harbour.core", 0),
        {
            "click": ("'from harbour.core import Boat as C' || event_id || ', Other'",
                      "'from harbour.client import Barge as C' || event_id || ', Other'", 1),
            "view": ("'from harbour.core import Other' || event_id", "'from harbour.core import Other' || event_id", 0),
            "purchase": ("'from ..harbour.core import Boat'", "'from ..harbour.client import Barge'", 1),
            "error": (Q("from harbour.core import (\n    Boat,  # Boat\n    Other,\n)"),
                      Q("from harbour.client import (\n    Barge,  # Boat\n    Other,\n)"), 1),
            "signup": ("'from other.core import Boat'", "'from other.core import Boat'", 0),
        },
    ),
    "r5_add_argument": Corpus(
        [_rule("add_argument", function_name="moor", argument_name="slack", default_value="30"),
         _rule("add_argument", function_name="close", argument_name="force")],
        ("def moor(a): pass", "def moor(a): pass", 0),
        {
            "click": ("'c = moor(host=\"h\", port=' || event_id || ')'",
                      "'c = moor(host=\"h\", port=' || event_id || ', slack=30)'", 1),
            "view": ("'moor(' || event_id || ', slack=1)'", "'moor(' || event_id || ', slack=1)'", 0),
            "purchase": ("'a.b.close()'", "'a.b.close(force=None)'", 1),
            "error": ("'f(moor(moor(), lambda x, y: [x, ' || event_id || ']))'",
                      "'f(moor(moor(slack=30), lambda x, y: [x, ' || event_id || '], slack=30))'", 2),
            "signup": ('\'print(f"{moor(\' || event_id || \')} moor({{}})", f\'\'{moor(slack=1)}\'\')\'',
                      '\'print(f"{moor(\' || event_id || \', slack=30)} moor({{}})", f\'\'{moor(slack=1)}\'\')\'', 1),
        },
    ),
    "r6_remove_argument": Corpus(
        [_rule("remove_argument", function_name="signal", argument_name="loud")],
        ("def signal(loud=1): pass", "def signal(loud=1): pass", 0),
        {
            "click": ("'signal(hull, loud=g(1, ' || event_id || '))'", "'signal(hull)'", 1),
            "view": ("'signal(loud=True, n=' || event_id || ')'", "'signal(n=' || event_id || ')'", 1),
            "purchase": ("'x.signal(loud=1).signal(a, loud=2, b=3,)'", "'x.signal().signal(a, b=3)'", 2),
            "error": ("'signal(loud)'", "'signal(loud)'", 0),
            "signup": ('\'print(f"{signal(\' || event_id || \', loud=2):>9} {{signal(loud=1)}}")\'',
                      '\'print(f"{signal(\' || event_id || \'):>9} {{signal(loud=1)}}")\'', 1),
        },
    ),
    "r7_change_default": Corpus(
        [_rule("change_argument_default", argument_name="slack", default_value="60")],
        ("def f(a, slack: int = 30, *, b=lambda slack, c=1: 2): return slack",
         "def f(a, slack: int = 60, *, b=lambda slack = 60, c=1: 2): return slack", 2),
        {
            "click": ("'def g' || event_id || '(slack=f(1, 2)): pass'", "'def g' || event_id || '(slack=60): pass'", 1),
            "view": ("'f(slack=' || event_id || ')'", "'f(slack=' || event_id || ')'", 0),
            "error": ("'k = lambda *, slack={1: 2}: ' || event_id", "'k = lambda *, slack=60: ' || event_id", 1),
        },
    ),
    "r8_reorder_arguments": Corpus(
        [_rule("reorder_arguments", function_name="signal", new_order=["data", "hull", "missing"])],
        ("class A:\n    def signal(self, hull, data={1: 2}): pass", "class A:\n    def signal(data={1: 2}, hull, self): pass", 1),
        {
            "click": ("'def signal(hull: str,data, x=' || event_id || ', *a, k): pass'",
                      "'def signal(data, hull: str, x=' || event_id || ', *a, k): pass'", 1),
            "view": ("'signal(hull, data)'", "'signal(hull, data)'", 0),
            "error": ("'def signal(data, hull): pass'", "'def signal(data, hull): pass'", 1),
            "purchase": ("'def other(hull, data): pass'", "'def other(hull, data): pass'", 0),
        },
    ),
    "r9_deprecate_function": Corpus(
        [_rule("deprecate_function", old_name="haul", replacement="get")],
        ("class A:\n    haul()\n    if x: haul()",
         "class A:\n    # DEPRECATED: haul() is deprecated. Use get instead.\n    haul()\n    if x: haul()", 1),
        {
            "click": ("'api.haul(' || event_id || ')'",
                      "'# DEPRECATED: haul() is deprecated. Use get instead.' || chr(10) || 'api.haul(' || event_id || ')'", 1),
            "view": ("'x = haul(' || event_id || ')'", "'x = haul(' || event_id || ')'", 0),
            "error": ("'haul(); haul(' || event_id || ')'",
                      "'# DEPRECATED: haul() is deprecated. Use get instead.' || chr(10) || 'haul(); haul(' || event_id || ')'", 1),
            "purchase": ("'haul() + 1; haul()()'", "'haul() + 1; haul()()'", 0),
        },
    ),
    "r10_remove_function": Corpus(
        [_rule("remove_function", old_name="gone")],
        ("import gone", "import gone", 0),
        {
            "click": ("'gone(' || event_id || ')'",
                      "'# DEPRECATED: gone() is deprecated. Use N/A instead.' || chr(10) || 'gone(' || event_id || ')'", 1),
            "view": ("'print(gone(' || event_id || '))'", "'print(gone(' || event_id || '))'", 0),
        },
    ),
    "r11_move_to_module": Corpus(
        [_rule("move_to_module", old_name="Painter", source_module="harbour.sheds", target_module="harbour.docks")],
        ("from harbour.sheds import *", "from harbour.sheds import *", 0),
        {
            "click": ("'from harbour.sheds import Painter as F' || event_id || ', Other'",
                      "'from harbour.docks import Painter as F' || event_id || ', Other'", 1),
            "view": ("'from harbour.sheds import Other'", "'from harbour.sheds import Other'", 0),
            "error": ("'from sheds import Painter'", "'from sheds import Painter'", 0),
        },
    ),
    "r12_add_decorator": Corpus(
        [_rule("add_decorator", function_name="on_tide", decorator_name="watched")],
        ("class A:\n    @other(1)\n    def on_tide(self): pass",
         "class A:\n    @other(1)\n    @watched\n    def on_tide(self): pass", 1),
        {
            "click": ("'def on_tide(x=' || event_id || '): pass'",
                      "'@watched' || chr(10) || 'def on_tide(x=' || event_id || '): pass'", 1),
            "view": (Q("@watched\nasync def on_tide(x): pass"), Q("@watched\nasync def on_tide(x): pass"), 0),
            "error": ("'class on_tide: pass'", "'class on_tide: pass'", 0),
            "purchase": (Q("@m.watched\ndef on_tide(x): pass"), Q("@m.watched\n@watched\ndef on_tide(x): pass"), 1),
        },
    ),
    "r13_remove_decorator": Corpus(
        [_rule("remove_decorator", function_name="run", decorator_name="cached")],
        ("class A:\n    @cached\n    def run(self): pass", "class A:\n    def run(self): pass", 1),
        {
            "click": ("'@cached  # c' || chr(10) || '@other' || chr(10) || 'def run(x=' || event_id || '): pass'",
                      "'@other' || chr(10) || 'def run(x=' || event_id || '): pass'", 1),
            "view": (Q("@cached()\ndef run(x): pass"), Q("@cached()\ndef run(x): pass"), 0),
            "error": (Q("@cached\ndef walk(x): pass"), Q("@cached\ndef walk(x): pass"), 0),
        },
    ),
    "r14_replace_with_property": Corpus(
        [_rule("replace_with_property", old_name="get_rank", new_name="name")],
        ("x = get_rank()", "x = get_rank()", 0),
        {
            "click": ("'n = client.get_rank( ).get_rank()[' || event_id || ']'", "'n = client.name.name[' || event_id || ']'", 2),
            "view": ("'n = client.get_rank(' || event_id || ')'", "'n = client.get_rank(' || event_id || ')'", 0),
            "error": ("'f(client.get_rank, client.get_rank())'", "'f(client.get_rank, client.name)'", 1),
            "signup": ('\'print(f"{c.get_rank()} {c.get_rank(\' || event_id || \')} get_rank()")\'',
                      '\'print(f"{c.name} {c.get_rank(\' || event_id || \')} get_rank()")\'', 1),
        },
    ),
    "r15_rename_argument": Corpus(
        [_rule("rename_argument", function_name="signal", argument_name="loud", new_argument_name="debug")],
        ("def signal(loud): pass", "def signal(loud): pass", 0),
        {
            "click": ("'signal(loud, loud=loud, n=' || event_id || ')'",
                      "'signal(loud, debug=loud, n=' || event_id || ')'", 1),
            "view": ("'other(loud=' || event_id || ')'", "'other(loud=' || event_id || ')'", 0),
            "error": ("'a.signal(x, **k, loud=(1, 2))'", "'a.signal(x, **k, debug=(1, 2))'", 1),
            "signup": ('\'print(f"{signal(loud=\' || event_id || \'):>{signal(loud=1)}}")\'',
                      '\'print(f"{signal(debug=\' || event_id || \'):>{signal(debug=1)}}")\'', 2),
        },
    ),
    # a name made by one rule and used by later ones
    "e1_many_rounds": Corpus(
        # defaults of every kind of syntax; only the last rule must look at rewritten text again
        [*(_rule("add_argument", function_name="open_it", argument_name=f"p{i}", default_value=d)
           for i, d in enumerate(["[]", "{}", "g()", "a.b", "lambda: 0"] * 4)),
         _rule("add_argument", function_name="g2", argument_name="q", default_value="late()"),
         _rule("rename_function", old_name="late", new_name="soon"),
         _rule("rename_function", old_name="g2", new_name="g3")],
        ("g2()", "g3(q=soon())", 3),
        {
            "click": ("'open_it()'", "'open_it(" + ", ".join(
                f"p{i}={d}" for i, d in enumerate(["[]", "{}", "g()", "a.b", "lambda: 0"] * 4)) + ")'", 20),
            "view": ("'late(' || event_id || ')'", "'soon(' || event_id || ')'", 1),
        },
    ),
    "e1_ordered_fold": Corpus(
        [
            _rule("rename_class", old_name="Client", new_name="API"),
            _rule("rename_import", old_module="m", old_name="Client", new_module="m.c", new_name="API"),
            _rule("rename_function", old_name="connect", new_name="create"),
            _rule("add_argument", function_name="create", argument_name="t", default_value="LIMIT"),
            _rule("rename_function", old_name="LIMIT", new_name="MAX"),
            _rule("remove_argument", function_name="create", argument_name="v"),
            _rule("rename_argument", function_name="create", argument_name="t", new_argument_name="timeout"),
            _rule("remove_argument", function_name="get", argument_name="v"),
            _rule("replace_with_property", old_name="get", new_name="prop"),
            _rule("rename_attribute", old_name="prop", new_name="value"),
            _rule("remove_class", old_name="Other"),
        ],
        ("from m import Client\nLIMIT = 1", "from m import API\nMAX = 1", 2),
        {
            "click": ("'c = connect(v=LIMIT, p=' || event_id || ')'", "'c = create(p=' || event_id || ', timeout=MAX)'", 6),
            "view": ("'x = o.get(v=' || event_id || ')'", "'x = o.value'", 3),
            "error": ("'x = o.get(' || event_id || ')'", "'x = o.get(' || event_id || ')'", 0),
            "purchase": ("'create(o.get(), v=o.get())'", "'create(o.value, timeout=MAX)'", 6),
        },
    ),
}

# An operation that the library does not have, before and after one of its own rules.
OWN_OPERATION = Corpus(
    [
        _rule("rename_function", old_name="tie", new_name="moor"),
        _rule("set_argument", function_name="moor", argument_name="slack", default_value="LIMIT"),
        _rule("rename_function", old_name="LIMIT", new_name="NONE"),
    ],
    ("moor(a, slack=1)", "moor(a, slack=NONE)", 2),
    {
        "click": ("'x = tie(slack=' || event_id || ', h=f(slack=2))'", "'x = moor(h=f(slack=2), slack=NONE)'", 3),
        "view": ("'moor(' || event_id || ')'", "'moor(' || event_id || ')'", 0),
        "error": ("'print(f\"{b.moor(slack=g(' || event_id || ', 2))}\")'", "'print(f\"{b.moor(slack=NONE)}\")'", 2),
        "purchase": ("'def moor(slack=' || event_id || '): pass'", "'def moor(slack=' || event_id || '): pass'", 0),
    },
)

# Defaults of one definition's parameters only, which an earlier rule renames.
SCOPED = Corpus(
    [
        _rule("rename_function", old_name="berth", new_name="dock"),
        _rule("change_argument_default", function_name="dock", argument_name="slack", default_value="60"),
    ],
    ("class A:\n    async def berth(self, slack: int = 1, *, f=lambda slack=2: slack):\n        def other(slack=3): pass\n        def berth(slack): pass",
     "class A:\n    async def dock(self, slack: int = 60, *, f=lambda slack=2: slack):\n        def other(slack=3): pass\n        def dock(slack = 60): pass", 4),
    {
        "click": ("'def berth(a, b=(1, ' || event_id || '), slack=f(1, 2)): return slack'", "'def dock(a, b=(1, ' || event_id || '), slack=60): return slack'", 2),
        "view": ("'def wharf(slack=' || event_id || '): pass'", "'def wharf(slack=' || event_id || '): pass'", 0),
        "error": ("'k = lambda slack=' || event_id || ': berth(slack=1)'", "'k = lambda slack=' || event_id || ': dock(slack=1)'", 1),
        "signup": ("'def berth(x=lambda slack=1: 2): x = ' || event_id", "'def dock(x=lambda slack=1: 2): x = ' || event_id", 1),
    },
)

# The example's changelog: versions with their rules, as they would be written down.
EXAMPLE_VERSIONS = {"1.2.0": EXAMPLE.rules[:2], "1.10.0": EXAMPLE.rules[2:7], "2.0.0": [], "2.5.1": EXAMPLE.rules[7:]}


def second_changelog(spark: SparkSession) -> DataFrame:
    """A changelog of another library with one rule that meets the example's files."""
    rule = {"id": "O1", "version_introduced": "1.1.0", "description": "d", **_rule("rename_function", old_name="print", new_name="emit")}
    content = json.dumps({"library": "otherlib", "versions": [{"version": "1.1.0", "rules": [rule]}]})
    return spark.createDataFrame([("otherlib", content)], "doc_id string, content string")


def example_changelog(spark: SparkSession) -> DataFrame:
    """The example's changelog as a document."""
    versions = [
        {"version": v, "rules": [
            {"id": f"{v}-{i}", "version_introduced": v, "description": r["change_type"], **r}
            for i, r in enumerate(rules)]}
        for v, rules in EXAMPLE_VERSIONS.items()
    ]
    return spark.createDataFrame(
        [("seedbank", json.dumps({"library": "seedbank", "versions": versions}))], "doc_id string, content string")


# Half of the repositories upgrade, the others are up to date.
REPO_PINS = """
SELECT DISTINCT 'u' || (user_id % 20) AS repo, 'seedbank' AS library,
  CASE WHEN user_id % 20 < 10 THEN '1.0.0' ELSE '2.5.1' END AS from_version, 'latest' AS to_version
FROM {events}
"""
