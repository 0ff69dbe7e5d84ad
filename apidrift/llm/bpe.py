"""BPE encoding and decoding through a table of distinct words.

1. Each text is cut into the tokenizer's words. A block of documents (at most ``BLOCK_BYTES`` of text in a scan
   task) keeps its distinct words, and every document becomes word codes of its block. Both are written once,
   bucketed by block, so the codes, of documents and of words, are never shuffled.
2. Words meet in buckets by hash. A bucket encodes each distinct word once, however many blocks hold it.
3. Ids go back to the blocks that asked for the word and are put in place by position. Decoding joins ids with
   the pieces of the vocabulary, a table of fixed size, and pieces with positions.

Words are packed per (block, bucket) and codes per block, so what is shuffled is far smaller than one row
per word position. Bucket count follows the bytes of the texts. A word that fills half a corpus is in each block
once. The vocabulary travels as the tokenizer's own JSON, so executors need no file.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from apidrift.llm.tables import frugal, frugal_groups, slices, small_batches, whole, written_by

#: Bytes of text for each bucket of words, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
BLOCK_BYTES = 12 << 20
#: Words that go to the library at a time.
ENCODED_AT_ONCE = 8192
#: Word positions in one packed row of documents.
PACKED_POSITIONS = 1 << 17

# Fixed value: how byte-level BPE cuts words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Character classes of later blocks differ between Unicode versions; texts with such characters are cut
#: by the tokenizer itself.
_UNSETTLED = re.compile(r"[^\x00-\u0500\u2010-\u2027\u20ac]")

BLOCK_SCHEMA = "kind int, block string, bucket int, ids array<{kind}>, lengths array<int>, codes binary, words binary"


class Vocabulary:
    """A byte-level BPE tokenizer, its cutting rule and its pieces."""

    def __init__(self, source: str) -> None:
        self.source = source
        plan = json.loads(source)
        cut = plan.get("pre_tokenizer") or {}
        if plan["model"]["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) \
                or cut.get("add_prefix_space") or plan.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        added = plan.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must match anywhere, without white space around them")
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, longest))) if longest else None
        self._pattern = regex.compile(PATTERN)

    def __reduce__(self) -> tuple:
        return _vocabulary, (self.source,)

    def words(self, text: str) -> list[str]:
        """The text in order, cut into added tokens and words."""
        if not self._special or not self._special.search(text):
            return self._cut(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._cut(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._cut(text[at:])

    def _cut(self, text: str) -> list[str]:
        if _UNSETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if text else []
        return self._pattern.findall(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already; threads cost memory
        out: list[list[int]] = []
        for i in range(0, len(words), ENCODED_AT_ONCE):
            out += [e.ids for e in self.tokenizer.encode_batch(words[i:i + ENCODED_AT_ONCE], add_special_tokens=False)]
        return out

    @cached_property
    def pieces(self) -> dict[int, bytes]:
        """Id to bytes. Byte-level vocabularies write the bytes without a printable character of their own as
        the characters from U+0100 on, in order."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
        out = {}
        for token, at in self.tokenizer.get_vocab().items():
            plain = token in self.added or any(c not in byte for c in token)
            out[at] = token.encode() if plain else bytes(byte[c] for c in token)
        return out


@lru_cache(1)
def _vocabulary(source: str) -> Vocabulary:
    """One vocabulary for all tasks of a worker."""
    return Vocabulary(source)


class _Codes(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words)).tobytes()
    head = len(words).to_bytes(4, "little")
    return zstandard.ZstdCompressor(level=3).compress(head + sizes + b"".join(words))


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=n > 0)] if n else []


def _blocks(vocabulary: Vocabulary, buckets: int, kind: str) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch, "text", BLOCK_BYTES)):
            block, codes = uuid.uuid4().hex, _Codes()
            id_type = batch.schema.field("id").type
            ids, lengths, run, held = [], [], [], 0

            def docs_row() -> pa.RecordBatch:
                return _row(0, block, -1, ids, lengths, np.concatenate(run) if run else np.zeros(0, np.uint32), b"", id_type)  # noqa: B023

            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = np.frombuffer(array("I", map(codes.__getitem__, vocabulary.words(text))), np.uint32)
                ids.append(key)
                lengths.append(len(at))
                run.append(at)
                held += len(at)
                if held >= PACKED_POSITIONS:
                    yield docs_row()
                    ids, lengths, run, held = [], [], [], 0
            if ids:
                yield docs_row()
            sorted_in: dict[int, list[bytes]] = {}
            for word in sorted(w.encode("utf-8", "surrogatepass") for w in codes):
                sorted_in.setdefault(zlib.crc32(word) % buckets, []).append(word)
            for bucket, words in sorted_in.items():
                places = np.fromiter((codes[w.decode("utf-8", "surrogatepass")] for w in words), np.uint32, len(words))
                yield _row(1, block, bucket, [], [], places, _pack_words(words), id_type)
    return cut


def _row(kind: int, block: str, bucket: int, ids: list, lengths: list, codes: np.ndarray, words: bytes, id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([kind], pa.int32()), pa.array([block]), pa.array([bucket], pa.int32()), pa.array([ids], pa.list_(id_type)),
        pa.array([lengths], pa.list_(pa.int32())), pa.array([_pack(codes)]), pa.array([words]),
    ], names=["kind", "block", "bucket", "ids", "lengths", "codes", "words"])


def _encoder(vocabulary: Vocabulary) -> Callable[[pa.Table], pa.Table]:
    def encode(part: pa.Table) -> pa.Table:
        """Ids of each (block, bucket) row's words: counts per word, then all ids."""
        asked = [_unpack_words(blob) for blob in part.column("words").to_pylist()]
        distinct = list({word for words in asked for word in words})
        ids = dict(zip(distinct, vocabulary.encode([w.decode("utf-8", "surrogatepass") for w in distinct]), strict=True))
        counts = [_pack(np.fromiter((len(ids[w]) for w in words), np.uint32, len(words))) for words in asked]
        flat = [_pack(np.fromiter((i for w in words for i in ids[w]), np.uint32)) for words in asked]
        return pa.table({"block": part.column("block"), "bucket": part.column("bucket"), "counts": counts, "flat": flat})
    return encode


def _placer(vocabulary: Vocabulary, measure: Callable, names: list[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def place(_: tuple, held: pa.Table, words: pa.Table) -> pa.Table:
        pieces, named = vocabulary.pieces, pc.greater_equal(held.column("bucket"), 0)
        docs, asked = held.filter(pc.invert(named)), held.filter(named)
        codes_of = dict(zip(asked.column("bucket").to_pylist(), asked.column("codes").to_pylist(), strict=True))
        n = sum(map(len, parts := [_unpack(codes_of[b]) for b in words.column("bucket").to_pylist()]))
        sizes, starts, flat, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        shown, decoded = [b""] * n, [b""] * n
        for codes, counts, ids in zip(parts, *(map(_unpack, words.column(c).to_pylist()) for c in ("counts", "flat")), strict=True):
            ends, known = np.cumsum(counts), ids.tolist()
            sizes[codes], starts[codes] = counts, at + ends - counts
            flat.append(ids)
            at += len(ids)
            for code, a, b in zip(codes.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                mine = known[a:b]
                shown[code] = ",".join(map(str, mine)).encode()
                decoded[code] = b"".join([pieces[i] for i in mine])
        block = _Block(sizes, starts, np.concatenate([np.zeros(0, np.uint32), *flat]), shown, decoded)
        keys, out = [], []
        for i in range(docs.num_rows):
            codes, at = _unpack(docs.column("codes")[i].as_py()), 0
            for key, n in zip(docs.column("ids")[i].as_py(), docs.column("lengths")[i].as_py(), strict=True):
                keys.append(key)
                out.append(measure(block, codes[at:at + n]))
                at += n
        kind = docs.schema.field("ids").type.value_type
        return pa.table({"id": pa.array(keys, kind)} | {name: pa.array([r[i] for r in out], t) for i, (name, t) in enumerate(names)})
    return place


class _Block(NamedTuple):
    """What is known of a block's words, by code; ids lie in one array."""

    sizes: np.ndarray
    starts: np.ndarray
    flat: np.ndarray
    shown: list[bytes]
    decoded: list[bytes]


def _digests(block: _Block, codes: np.ndarray) -> tuple:
    at = codes.tolist()
    return (
        int(block.sizes[codes].sum()), hashlib.sha256(b",".join([block.shown[c] for c in at])).hexdigest(),
        hashlib.sha256(b"".join([block.decoded[c] for c in at])).hexdigest(),
    )


def _texts(block: _Block, codes: np.ndarray) -> tuple:
    sizes = block.sizes[codes]
    ends = np.cumsum(sizes)
    ids = block.flat[np.repeat(block.starts[codes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
    return ids.astype(np.int32), b"".join([block.decoded[c] for c in codes.tolist()]).decode("utf-8", "replace")


def _run(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, measure: Callable, schema: str, names: list) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = Vocabulary(file.read())
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    blocks = written_by(rows.mapInArrow(frugal(_blocks(vocabulary, buckets, kind)), BLOCK_SCHEMA.format(kind=kind)), "word-blocks", "block", size)
    encoded = blocks.where("kind = 1").select("block", "bucket", "words").groupBy("bucket").applyInArrow(
        frugal_groups(_encoder(vocabulary)), "block string, bucket int, counts binary, flat binary")
    held = blocks.select("block", "bucket", "ids", "lengths", "codes")
    return held.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(
        frugal_groups(_placer(vocabulary, measure, names)), f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8).

    A null text is read as empty: no tokens, digests of the empty string. Repeated rows each get a
    result; an empty table gives no rows. Other columns are ignored.
    """
    names = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _run(docs, tokenizer_path, id_col, text_col, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", names)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, token_ids, decoded. Cases as in ``encode_digests``."""
    names = [("token_ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    return _run(docs, tokenizer_path, id_col, text_col, _texts, "token_ids array<int>, decoded string", names)
