"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each word holds its symbols in the leaves of a binary tree; a leaf's value is the rank of the pair that it opens, then
its place. The root is thus the leftmost pair of the lowest rank. A merge changes three leaves, whose ancestors are
recomputed in logarithmic time, until the root holds no mergeable pair. Words of like length run in lockstep: one numpy
operation makes one merge in each of them.

The vocabulary is a `tokenizers` JSON file of a byte-level BPE with a word-end suffix, NFC and lower case; it is read
on the driver and broadcast (a file of fixed size, a few MB). Encoding equals that library's with
add_special_tokens=False, decoding its decode(ids, skip_special_tokens=False).

Defined results: a null or empty text has no tokens and decodes to "". Rows are independent: null or repeated ids and
other columns don't matter. A text of any length is encoded whole; a long unbroken word costs n log n.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NONE = np.iinfo(np.int64).max
#: Cells of a lockstep block, words in a worker's cache, characters that are encoded together.
BLOCK_CELLS, CACHE_WORDS, CHUNK_CHARS = 1 << 19, 250_000, 1 << 21
#: The pre-tokenizer's pattern, a fixed value; its form for ASCII texts in lower case.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: Letters and numbers that are newer than the pre-tokenizer's tables, which take them for other signs: fixed values.
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479
"""
#: Capitals that the normaliser knows and str.lower doesn't: fixed values, first, last and the lower case of the first.
CAPITALS = "1C89-1C89:1C8A A7CB-A7CB:0264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB A7DC-A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def _class_of(ranges: str) -> str:
    """Ranges of code points as the inside of a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split())


_CAPITAL_RANGES = re.findall(r"(\w+)-(\w+):(\w+)", CAPITALS)
_LOWER = {c: int(to, 16) + c - int(a, 16) for a, b, to in _CAPITAL_RANGES for c in range(int(a, 16), int(b, 16) + 1)}
RARE = re.compile(f"[{_class_of(NEWER)}{_class_of(' '.join(f'{a}-{b}' for a, b, _ in _CAPITAL_RANGES))}]")
RARE_WORDS = regex.compile(r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[%s]]+|[\p{N}--[%s]]|[[^\s\p{L}\p{N}]||[%s]]+" % ((_class_of(NEWER),) * 3))
_codecs: dict[str, Codec] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Codec:
    def __init__(self, source: str):
        d = json.loads(source)
        model = d["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_ids = special
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in model["merges"]], np.int64)
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.ids: dict[str, str | tuple] = {}
        self.decoded: dict[str, str] = {}
        self.as_text: bool | None = None

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """(rank, place) of pairs of symbols as one number; the largest number for pairs that don't merge."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pairs, key), self.pairs.size - 1)
        return np.where(ok & (self.pairs[at] == key), (self.ranks[at] << 32) | place, _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and how many each has. The words are at most as long as a power of two allows."""
        n, width = len(words), 1 << max(0, max(map(len, words)) - 1).bit_length()
        size = np.array(list(map(len, words)))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        inside = place < size[:, None]
        token = np.zeros((n, width + 1), np.int64)
        token[:, :width] = np.where(place == size[:, None] - 1, self.last[raw], self.inner[raw])
        after = np.where(place + 1 < size[:, None], place + 1, width)
        after = np.concatenate([after, np.full((n, 1), width)], 1)
        before = np.concatenate([np.broadcast_to(place - 1, (n, width)), np.full((n, 1), -1)], 1)
        before[:, 0] = width
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:] = self.leaf(token[:, :width], token[:, 1:], place, place + 1 < size[:, None])
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        top = 1 if width > 1 else 0
        rows = np.flatnonzero(tree[:, top] < _NONE) if top else np.zeros(0, np.int64)
        while rows.size:
            root = tree[rows, 1]
            i = root & 0xFFFFFFFF
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            new = self.made[root >> 32]
            token[rows, i] = new
            inside[rows, j] = False
            after[rows, i] = k
            before[rows, k] = i
            tree[rows, width + j] = _NONE
            tree[rows, width + i] = self.leaf(new, token[rows, k], i, k < width)
            has = h < width
            r, q = rows[has], h[has]
            tree[r, width + q] = self.leaf(token[r, q], new[has], q, np.True_)
            r, up = np.concatenate([rows, rows, r]), width + np.concatenate([i, j, q])
            while up[0] > 1:
                up = up >> 1
                tree[r, up] = np.minimum(tree[r, 2 * up], tree[r, 2 * up + 1])
            rows = rows[tree[rows, 1] < _NONE]
        return token[:, :width][inside], inside.sum(1)

    def learn(self, words: list[str]) -> None:
        """Encode words into the cache."""
        if len(self.ids) + len(words) > CACHE_WORDS:
            self.ids.clear()
            self.decoded.clear()
        raw = [w.encode() for w in words]
        order = sorted(range(len(words)), key=lambda i: len(raw[i]))
        a = 0
        while a < len(order):
            width = 1 << (len(raw[order[a]]) - 1).bit_length()
            b = a + 1
            while b < len(order) and len(raw[order[b]]) <= width and (b - a + 1) * width <= BLOCK_CELLS:
                b += 1
            flat, counts = self.merge([raw[i] for i in order[a:b]])
            flat, end = flat.tolist(), 0
            for i, c in zip(order[a:b], counts.tolist()):
                own = flat[end : end + c]
                end += c
                self.ids[words[i]] = " ".join([self.names[x] for x in own]) if self.as_text else tuple(own)
                self.decoded[words[i]] = " ".join([self.tokens[x] for x in own])
            a = b

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        out: list[str] = []
        for k, part in enumerate(self.special.split(text) if any(map(text.__contains__, self.special_ids)) else [text]):
            if k % 2:
                out.append("\0" + part)
            elif part.isascii():
                out += ASCII_WORDS.findall(part.lower())
            else:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += RARE_WORDS.findall(part.translate(_LOWER)) if RARE.search(part) else WORDS.findall(part)
        return out

    def lookup(self, texts: list[str], as_text: bool) -> list[tuple]:
        """For each text the ids of its words and what they decode to, word by word."""
        if self.as_text != as_text:
            self.ids.clear()
            self.decoded.clear()
            self.as_text = as_text
        split = [self.split(t) for t in texts]
        need = set().union(*split) - self.ids.keys()
        if len(self.ids) + len(need) > CACHE_WORDS:
            need = set().union(*split)
        if need:
            self.learn([w for w in need if not (w[0] == "\0" and w[1:] in self.special_ids)])
            for w in need:
                if w[0] == "\0" and w[1:] in self.special_ids:
                    i = self.special_ids[w[1:]]
                    self.ids[w] = self.names[i] if as_text else (i,)
                    self.decoded[w] = self.tokens[i]
        return [([self.ids[w] for w in words], [self.decoded[w] for w in words]) for words in split]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.lookup([text], False)[0][0]))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def _codec(source: Broadcast) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hashlib.blake2b(source.value, digest_size=8).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source.value.decode())
    return _codecs[key]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _digests(batches: Iterator[pa.RecordBatch], source: Broadcast) -> Iterator[pa.RecordBatch]:
    codec = _codec(source)
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    for batch in batches:
        n, ids, text = [], [], []
        for part in _chunks(batch.column("text").fill_null("").to_pylist()):
            for own, said in codec.lookup(part, True):
                own = " ".join(own)
                n.append(own.count(" ") + 1 if own else 0)
                ids.append(sha(own))
                text.append(sha(" ".join(said)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches: Iterator[pa.RecordBatch], source: Broadcast, column: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(source)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            flat, ends = [], [0]
            for chunk in _chunks(part.column(column).fill_null("").to_pylist()):
                for own, _ in codec.lookup(chunk, False):
                    flat.append(np.fromiter(chain.from_iterable(own), np.int32))
                    ends.append(ends[-1] + flat[-1].size)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "token_ids"])


def _encoded_digests(batches: Iterator[pa.RecordBatch], source: Broadcast) -> Iterator[pa.RecordBatch]:
    codec = _codec(source)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            flat, ends, said = [], [0], []
            for chunk in _chunks(part.column("text").fill_null("").to_pylist()):
                for own, words in codec.lookup(chunk, False):
                    flat.append(np.fromiter(chain.from_iterable(own), np.int32))
                    ends.append(ends[-1] + flat[-1].size)
                    said.append(hashlib.sha256(" ".join(words).encode()).hexdigest())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), ids, pa.array(said)], ["doc_id", "n_tokens", "token_ids", "decoded_sha256"])


def _decoded(batches: Iterator[pa.RecordBatch], source: Broadcast) -> Iterator[pa.RecordBatch]:
    codec = _codec(source)
    for batch in batches:
        said = [None if x is None else codec.decode(x) for x in batch.column("token_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], [*batch.schema.names, "decoded"])


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a vocabulary file on the driver, for the workers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs with token_ids, the ids of each whole text. A column token_ids that docs has is replaced."""
    docs, source = docs.drop("token_ids"), vocabulary(docs.sparkSession, path)
    schema = T.StructType([*docs.schema, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda it: _encoded(it, source, column), schema)


def encode_and_check(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256): the ids of each whole text, and a digest of what they decode to."""
    source = vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda it: _encoded_digests(it, source), "doc_id long, n_tokens long, token_ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the text that its token_ids decode to; null ids decode to null."""
    encoded, source = encoded.drop("decoded"), vocabulary(encoded.sparkSession, path)
    return encoded.mapInArrow(lambda it: _decoded(it, source), T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())]))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encode() and decode() give for each row."""
    source = vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda it: _digests(it, source), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
