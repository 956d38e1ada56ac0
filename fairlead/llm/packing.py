"""Packing token sequences along a space-filling curve.

A document's token ids are hashed to a vector, projected to few dimensions, and given the key of its place on a
Hilbert curve. Documents are range-sorted by key and laid end to end; sequences are cut from that line, so that
neighbours on the curve share sequences. Only the line's end is shorter than a sequence: it is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import documents, in_batches, numbered, portions
from fairlead.llm.tokens import segments, token_bytes, tokenizer_file
from fairlead.llm.words import scramble
from fairlead.sources.tables import Staging


@dataclass(frozen=True)
class PackRules:
    """``length``: tokens of a sequence, a power of two. ``end_id`` follows each document.

    A document is hashed to a vector of ``features`` signed counts and projected to ``dimensions`` places of ``bits`` bits.
    """

    length: int = 2048
    end_id: int = 1
    features: int = 256
    dimensions: int = 4
    bits: int = 12
    seed: int = 4


class Encoder:
    """Token ids of whole texts, as the tokenizer library gives them for a byte-level BPE file.

    The merges' order is that of the ids in such a file, so the ids are found by a faster encoder of the same vocabulary
    and pattern; where a file is of another kind, by the library itself. Tests compare the two.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.largest = self.library.get_vocab_size(with_added_tokens=True)
        self.fast = self._fast(model)

    def _fast(self, model: dict):
        splitter, bpe = model.get("pre_tokenizer") or {}, model["model"]
        plain = not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or model.get("normalizer") or not plain:
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        made = [bpe["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {token_bytes(name): i for name, i in bpe["vocab"].items() if name not in self.special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def part(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.asarray(self.fast.encode_to_numpy(text), np.uint32)
            except ValueError:  # Its pattern engine gives up on about a million blanks in a row; the library does not.
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(texts: Sequence[str], path: str) -> list[np.ndarray]:
    """The token ids of each whole text, without begin or end tokens.

    A special token's string in a text is that token, as is the library's default.
    """
    known = encoder(path)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for number, part, mark in segments(texts, sorted(known.special, key=len, reverse=True)):
        parts[number].append(known.part(part))
        if mark is not None:
            parts[number].append(np.array([known.special[mark]], np.uint32))
    return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """The distance along the Hilbert curve of points with one column per dimension, each of ``bits`` bits."""
    axes = [column.astype(np.int64) for column in places.T]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        axes[0] = np.where(axes[0] & bit, axes[0] ^ low, axes[0])
        for i in range(1, len(axes)):
            turned = (axes[i] & bit) != 0
            swap = np.where(turned, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(turned, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
        bit >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip, bit = np.zeros(len(places), np.int64), 1 << (bits - 1)
    while bit > 1:
        flip = np.where(axes[-1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros(len(places), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ flip) >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray], rules: PackRules) -> np.ndarray:
    """Each document's key: its vector of hashed ids, of length 1, is projected and spread over the cells by a fixed curve."""
    document = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    hashed = scramble(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.uint64) + np.uint64(rules.seed))
    feature = (hashed >> np.uint64(32)).astype(np.int64) % rules.features
    sign = np.where(hashed & np.uint64(1), 1.0, -1.0)
    vectors = np.bincount(document * rules.features + feature, sign, minlength=len(ids) * rules.features)
    vectors = vectors.reshape(len(ids), rules.features)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    projection = np.random.default_rng(rules.seed).standard_normal((rules.features, rules.dimensions))
    # einsum adds in one order whatever the batch, so equal documents have equal keys.
    places = np.einsum("ij,jk->ik", vectors, projection)
    cells = np.floor((1 << rules.bits) / (1 + np.exp(-1.702 * places))).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << rules.bits) - 1), rules.bits)


def encoded(docs: DataFrame, path: str, rules: PackRules) -> DataFrame:
    """Per row: doc_id, n (tokens with the end), curve, and ids in 16 bits each, or 32 for large vocabularies."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if max(encoder(path).largest, rules.end_id) < 1 << 16 else np.uint32
        for batch in portions(batches):
            ids = encode(batch.column("text").fill_null("").to_pylist(), path)
            keys = curve_keys(ids, rules)
            ended = [np.append(i, np.uint32(rules.end_id)).astype(kind).tobytes() for i in ids]
            columns = [
                batch.column("doc_id"),
                pa.array([len(e) // kind().itemsize for e in ended], pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(ended, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "curve", "ids"])

    return in_batches(docs.select("doc_id", "text"), rows, "doc_id long, n long, curve long, ids binary")


def _tail(total: int, length: int) -> np.ndarray:
    """Where the line's last, shorter sequences begin, and where the line ends."""
    begins, rest = [total - total % length], total % length
    for bit in range(length.bit_length(), -1, -1):
        if rest >> bit & 1:
            begins.append(begins[-1] + (1 << bit))
    return np.array(begins)


def pack(docs: DataFrame, path: str, staging: Staging, rules: PackRules = PackRules()) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty; every row has at least its end token. Rows with one doc_id are documents of their own.
    Equal documents lie side by side, in order of doc_id; a hot key is ranged by doc_id, too. Ids are encoded once and written;
    the order is found on keys and lengths alone. Other columns are not read. An empty table gives an empty result.
    """
    rows = staging.keep(encoded(docs, path, rules).withColumn("row", F.monotonically_increasing_id()), "encoded")
    order = [F.col("curve"), F.col("doc_id"), F.col("row")]
    line = numbered(rows.select("row", "doc_id", "n", "curve"), order, staging, "curve", ["n"])
    placed = rows.drop("curve").join(line.select("row", "n_before"), "row").drop("row")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tail = _tail(total, rules.length)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            found: list[list[int]] = [[] for _ in names]
            columns = (batch.column(n) for n in ("doc_id", "ids", "n", "n_before"))
            for doc_id, ids, n, begin in zip(*columns, strict=True):
                n, begin, doc_id = n.as_py(), begin.as_py(), doc_id.as_py()
                data = ids.as_buffer()
                values = np.frombuffer(data, np.uint16 if data.size == 2 * n else np.uint32).astype("<u4")
                at = begin
                while at < begin + n:
                    if at < tail[0]:
                        sequence, opens = at // rules.length, at - at % rules.length
                        closes = opens + rules.length
                    else:
                        k = int(np.searchsorted(tail, at, "right")) - 1
                        sequence, opens, closes = int(tail[0]) // rules.length + k, int(tail[k]), int(tail[k + 1])
                    end = min(begin + n, closes)
                    crc = zlib.crc32(values[at - begin : end - begin].tobytes())
                    for column, value in zip(found, (doc_id, at - begin, end - at, crc, n, sequence, at - opens), strict=True):
                        column.append(value)
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return in_batches(placed, pieces, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file(), Staging(spark))
