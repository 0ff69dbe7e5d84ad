"""Registered queries of the operators, each over its whole tables, and their SQL."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from apidrift.llm.bpe import encode_digests
from apidrift.llm.chosen_path import near_duplicates
from apidrift.llm.exact_dedup import dedup
from apidrift.llm.hard_negatives import hard_negatives
from apidrift.llm.jaccard_join import link_groups
from apidrift.llm.language_id import document_rows, identify, page_rows
from apidrift.llm.license_scan import scan as scan_licenses
from apidrift.llm.mixing import label_domains, mix
from apidrift.llm.pii import scan as scan_pii
from apidrift.llm.prefix_trie import prefix_trie
from apidrift.llm.quality_rules import apply_rules
from apidrift.llm.secret_scan import scan as scan_secrets
from apidrift.llm.sharding import shard
from apidrift.llm.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The vocabulary file: ``APIDRIFT_TOKENIZER`` or that of the installed package of public tokenizers."""
    if named := os.environ.get("APIDRIFT_TOKENIZER"):
        return named
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: documents have a doc_id, pages a page_id."""
    rows = document_rows(table(spark, sf_dir, "documents")).unionByName(page_rows(table(spark, sf_dir, "pages")), True)
    return identify(rows, ["doc_id", "page_id"])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


#: Wanted shares of tokens by domain, and how often the scarcest may be used.
TARGETS, HEADROOM = {"clean": 0.9, "junk": 0.06, "toxic": 0.04}, 1.25


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = label_domains(table(spark, sf_dir, "labels"))
    return mix(table(spark, sf_dir, "documents"), domains, TARGETS, HEADROOM)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_pii": op8_pii,
    "op9_license_scan": op9_license_scan,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Components of the documents whose shingle sets of four words link, by counting common shingles.
_LINKS = """
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(w)]
            ELSE list_distinct([hash(w[i:i + 3]) FOR i IN range(1, len(w) - 2)]) END AS k FROM d),
        c AS (SELECT k, min(doc_id) AS id, len(k) AS n FROM (SELECT doc_id, list_sort(k) AS k FROM s) GROUP BY k HAVING len(k) > 0),
        e AS (SELECT id, n, unnest(k) AS h FROM c),
        l AS (
          SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.h = b.h AND a.id <> b.id
          GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        r AS (SELECT id AS u, id AS v FROM c UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
        g AS (SELECT u, min(v) AS component_id FROM r GROUP BY u),
        m AS (
          SELECT s.doc_id, len(s.k)::BIGINT AS n_shingles, coalesce(g.component_id, s.doc_id) AS component_id, coalesce(c.id, s.doc_id) AS class_id
          FROM s LEFT JOIN c ON c.k = list_sort(s.k) LEFT JOIN g ON g.u = c.id)
        SELECT {columns} FROM m"""

ORACLES: dict[str, str] = {
    "op7_jaccard_join": _LINKS.format(percent=85, columns="*"),
    "op12_minhash_near_dedup": _LINKS.format(percent=80, columns="*, doc_id = component_id AS kept"),
    "op5_exact_dedup": """
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        g AS (
          SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
          FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
          FROM v a JOIN v c ON a.vec_id % 100 = 0),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s
          WHERE same AND vec_id <> anchor_id
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id,
               (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
         AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""",
    "op13_prefix_trie": """
        WITH t AS (
          SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (
          SELECT conv_id, turns, conv_id - conv_id % 20 AS first, (xor(list_reduce(
            list_prepend(4294967295, [ascii(ch)::BIGINT FOR ch IN string_split(conv_id::VARCHAR, '')]),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
              lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4)::BIGINT AS h
          FROM t),
        b AS (
          SELECT h.conv_id, list_concat(coalesce(f.turns[:h.h], []), h.turns[h.h + 1:]) AS path
          FROM h LEFT JOIN t f ON f.conv_id = h.first),
        m AS (
          SELECT conv_id, path, d, path[:d] AS node FROM b, unnest(range(len(path) + 1)) AS r(d)),
        n AS (
          SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '') AS ends,
                 CASE WHEN any_value(d) = 0 THEN 0 ELSE len(regexp_extract_all(any_value(node)[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS words
          FROM m GROUP BY node),
        c AS (
          SELECT n.*, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.node[:n.depth] = n.node) AS n_children FROM n),
        u AS (
          SELECT c.node[:a.d] AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
          FROM c, unnest(range(c.depth + 1)) AS a(d) GROUP BY 1)
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, u.n_leaves::BIGINT AS n_leaves,
               u.saved_tokens::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
        FROM c JOIN u ON u.node = c.node LEFT JOIN c p ON c.depth > 0 AND p.node = c.node[:c.depth - 1]""",
}
