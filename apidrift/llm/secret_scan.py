"""Secret scan: one Aho-Corasick pass finds keywords, anchored expressions look only at the hits, and tokens
that carry a checksum are reported only if it is right.

* ``assign``: a keyword, ``:`` or ``=``, a value of six characters or more;
* ``access``: access key ids, 20 characters or more;
* ``hex``: runs of 24 or more hexadecimal digits (no keyword starts these; runs are found directly);
* ``github``, ``npm``: prefixed tokens whose last six characters are the base-62 CRC-32 of the thirty before;
* ``jwt``: three base64url parts whose first two decode to JSON objects, the header naming its algorithm.

Matches of a kind are taken leftmost and do not overlap; a match that fails its length or checksum is
dropped, and the search goes on behind it. No run of characters is looked through twice, so a text takes time in
proportion to its length. Offsets are code points. Texts are scanned whole, inside the
scan's own tasks: nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.tables import whole

Span = tuple[int, int, str]

# Expressions of the contract, and published token formats.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_token(body: str) -> str:
    """The six-character checksum of a token's thirty random characters."""
    rest, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits


def _has_checksum(match: re.Match) -> bool:
    return crc_token(match[1][:30]) == match[1][30:]


def _is_jwt(match: re.Match) -> bool:
    try:
        header, claims = (json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))) for part in match.groups()[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header and isinstance(claims, dict)


#: Kind: keywords in lower case, expression anchored at the keyword, test of the match.
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(ASSIGN), lambda m: len(m[1]) >= 6),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "github": (tuple(f"gh{c}_" for c in "pousr"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _has_checksum),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _has_checksum),
    "jwt": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)"), _is_jwt),
}
#: Kind: characters of its first part. Where a match fails, all other hits in the same run would fail alike, as the run's end decides.
RUNS = {"jwt": re.compile("[A-Za-z0-9_-]+")}
HEX = re.compile(r"[0-9a-f]{24,}")


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, (keywords, _, _) in RULES.items():
        for word in keywords:
            made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def find_secrets(text: str) -> list[Span]:
    """(start, end, kind), by start and then in the order of ``KINDS``."""
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    hits = [(end - size + 1, kind) for end, (kind, size) in _automaton().iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))]
    behind = dict.fromkeys(RULES, 0)
    for start, kind in sorted(hits):
        if start < behind[kind]:
            continue
        _, pattern, holds = RULES[kind]
        if match := pattern.match(text, start):
            behind[kind] = match.end()
            if holds(match):
                spans.append((start, match.end(), kind))
        elif kind in RUNS:
            behind[kind] = RUNS[kind].match(text, start).end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_secrets.

    A null text is read as empty: no spans, and the digest of the empty string. Repeated rows each
    get a result; an empty table gives no rows. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(text) for text in batch.column("text").to_pylist()]
            base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
            count = lambda name: pa.array([sum(s[2] == name for s in spans) for spans in found], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), *map(count, BASE_KINDS),
                pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string()),
                pa.array([joined(spans) for spans in found], pa.string()),
                pa.array([len(spans) for spans in found], pa.int64()),
            ], names=["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_secrets"])

    return docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_secrets long",
    ).withColumnRenamed("id", id_col)
