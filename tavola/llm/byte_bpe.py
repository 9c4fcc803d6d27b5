"""Byte-level BPE encoding and decoding with a two-tier look-up.

A text is cut by the tokenizer's pattern.  Tier 1: a minimal perfect hash over the vocabulary
finds a whole pre-token in one probe and one comparison.  Tier 2, for the others: the
bytes become a linked list, and a heap of mergeable neighbours gives the pair of lowest
rank, leftmost first, until none merges.  That costs O(n log n) for a pre-token of n
bytes.  Recent pre-tokens are remembered, with their ids packed to bytes, in two generations of bounded bytes, so memory
does not grow with the corpus; a text's ids are its pre-tokens' bytes joined.

Ranks are read on the driver from the given file (its path is a parameter) and
broadcast; their size is that of the vocabulary.

Defined cases: a null or empty text has no ids and decodes to nothing; strings that look like special
tokens are ordinary text; lone surrogates can't occur in a Spark string; repeated rows give repeated
results; input columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.arrow_slices import by_bytes, releasing

#: Bytes of pre-tokens and their ids remembered in a generation; there are two.
REMEMBERED = 8 << 20
#: What a remembered pre-token costs at most beside its two objects, in bytes: its place in the dictionary.
_ENTRY = 112
#: Longer pre-tokens, in characters, hardly come again.
_LONG = 250
#: Characters of a text cut into pre-tokens at once.
_PIECES = 1 << 18
#: Bytes of text whose results are held at once.
_BATCH = 1 << 20
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[rank] = token
    return tokens


def _with_ranges(pattern: str, last: int) -> str:
    r"""The pattern with ``\p{..}``, ``\s`` and ``\S`` as ranges of code points up to ``last``, by the classes of ``regex``."""
    every = "".join(map(chr, (c for c in range(last + 1) if not 0xD800 <= c < 0xE000)))

    def ranges(name: str) -> str:
        found = list(map(ord, regex.findall(name, every)))
        starts = [c for c, before in zip(found, [-2, *found], strict=False) if c != before + 1]
        ends = [c for c, following in zip(found, [*found[1:], -2], strict=True) if following != c + 1]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))

    out, inside = "", False
    for part in re.findall(r"\\[pP]\{\^?\w+\}|\\.|.", pattern, re.DOTALL):
        if part[:2] in (r"\p", r"\s", r"\S"):
            found = ranges(part.replace(r"\S", r"\s"))
            part = found if inside else f"[{'^' * (part == r'\S')}{found}]"
        elif part in "[]":
            inside = part == "["
        out += part
    return out


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text: with ``re`` and ranges where the text's characters allow it, which is faster."""
    plain, wide = re.compile(_with_ranges(pattern, 0x7F)).findall, re.compile(_with_ranges(pattern, 0xFFFF)).findall
    full, beyond = regex.compile(pattern).findall, re.compile("[\U00010000-\U0010ffff]").search

    def find(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        return full(text) if beyond(text) else wide(text)

    return find


class PerfectHash:
    """Minimal perfect hash of n keys onto n slots, by hashing and displacing.

    Keys fall into buckets; the largest buckets first look for a displacement that puts
    all their keys on free slots, and single keys then name a free slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.size = n = len(keys)
        self.buckets = max(1, -(-n // per_bucket))
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for k, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            held[h % self.buckets].append((h, k))
        self.shift = [0] * self.buckets
        self.at = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(held[b]))
        for b in order:
            if len(held[b]) < 2:
                break
            shift = 0
            while True:
                slots = [self.slot(h, shift) for h, _ in held[b]]
                if len(set(slots)) == len(slots) and all(self.at[s] < 0 for s in slots):
                    break
                shift += 1
            self.shift[b] = shift
            for s, (_, k) in zip(slots, held[b], strict=True):
                self.at[s] = k
        free = (s for s, k in enumerate(self.at) if k < 0)
        for b in order:
            if len(held[b]) == 1:
                s = next(free)
                self.shift[b], self.at[s] = -1 - s, held[b][0][1]

    @classmethod
    def of(cls, buckets: int, shift: list[int], at: list[int]) -> PerfectHash:
        """The hash from its tables."""
        made = cls.__new__(cls)
        made.size, made.buckets, made.shift, made.at = len(at), buckets, shift, at
        return made

    def slot(self, h: int, shift: int) -> int:
        x = (h ^ (shift * 0x9E3779B97F4A7C15)) & _MASK
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & _MASK
        return (x ^ (x >> 32)) % self.size

    def __getitem__(self, key: bytes) -> int:
        """The only key number that ``key`` can have; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.buckets]
        return self.at[-1 - shift if shift < 0 else self.slot(h, shift)]


class Recent(dict):
    """Pre-token to ids, computed when absent; a full generation becomes the older one of the next."""

    def __init__(self, compute: Callable, most: int = REMEMBERED, older: dict | None = None):
        super().__init__()
        self.compute, self.most, self.older, self.bytes = compute, most, older or {}, 0

    def __missing__(self, piece: str):
        ids = self.older.get(piece)
        if ids is None:
            ids = self.compute(piece)
        if len(piece) <= _LONG:
            self.bytes += _ENTRY + getsizeof(piece) + getsizeof(ids)
            self[piece] = ids
        return ids

    def next(self) -> Recent:
        """The generation to go on with; this one, without its older one, if it is full."""
        if self.bytes < self.most:
            return self
        self.older = {}
        return Recent(self.compute, self.most, self)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str, whole: PerfectHash, remembered: int = REMEMBERED):
        self.tokens, self.whole = tokens, whole
        rank = {t: r for r, t in enumerate(tokens)}
        self.byte = [rank.get(bytes([b]), -1) for b in range(256)]
        #: By left token: right token to the rank of both as one.
        none: dict[int, int] = {}
        self.joins = [none] * len(tokens)
        for r, t in enumerate(tokens):
            for k in range(1, len(t)):
                left, right = rank.get(t[:k]), rank.get(t[k:])
                if left is not None and right is not None:
                    if self.joins[left] is none:
                        self.joins[left] = {}
                    self.joins[left][right] = r
        self.find = splitter(pattern)
        self.matches = regex.compile(pattern).finditer
        self.recent = Recent(self.packed_ids, remembered)

    def packed_ids(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        k = self.whole[data]
        return array("i", [k] if self.tokens[k] == data else self.merge(data)).tobytes()

    def merge(self, data: bytes) -> list[int]:
        """Tier 2: merges of lowest rank first, leftmost of equal ones, from a heap over linked bytes."""
        joins, n = self.joins, len(data)
        width = n.bit_length()
        places = (1 << width) - 1
        ids = [self.byte[b] for b in data]
        due, heap, i, left = [], [], 0, joins[ids[0]]
        for x in ids[1:]:
            r = left.get(x)  # rank at which each place merges with the next
            due.append(r)
            left = joins[x]
            if r is not None:
                heap.append(r << width | i)
            i += 1
        due.append(None)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & places
            r = top >> width
            if due[i] != r:
                continue  # one of the two has merged since
            j = after[i]
            after[i] = k = after[j]
            ids[i] = r
            ids[j] = -1
            due[j] = None
            if k < n:
                before[k] = i
                due[i] = s = joins[r].get(ids[k])
                if s is not None:
                    heappush(heap, s << width | i)
            else:
                due[i] = None
            if i:
                h = before[i]
                due[h] = s = joins[ids[h]].get(r)
                if s is not None:
                    heappush(heap, s << width | h)
        return [x for x in ids if x >= 0]

    def packed(self, text: str) -> np.ndarray:
        """The text's ids as an array."""
        if len(text) > _PIECES:
            return np.frombuffer(b"".join(map(self.joined, self.pieces(text))), dtype=np.int32)
        return np.frombuffer(self.joined(self.find(text)), dtype=np.int32)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def joined(self, pieces: list[str]) -> bytes:
        self.recent = self.recent.next()
        return b"".join(map(self.recent.__getitem__, pieces))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a long text, some at a time."""
        found = self.matches(text)
        while some := [m.group() for m in islice(found, _PIECES // 4)]:
            yield some

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def broadcast_codec(spark: SparkSession, path: str, pattern: str, remembered: int = REMEMBERED):
    """Vocabulary and perfect hash as plain values, so executors need no copy of this package."""
    tokens = read_ranks(path)
    whole = PerfectHash(tokens)
    return spark.sparkContext.broadcast({"tokens": tokens, "pattern": pattern, "hash": (whole.buckets, whole.shift, whole.at), "remembered": remembered})


def codec_of(shared) -> Codec:
    """The codec of a broadcast vocabulary, made once in each Python worker."""
    value = shared.value
    if "codec" not in value:
        value["codec"] = Codec(value["tokens"], value["pattern"], PerfectHash.of(*value["hash"]), value["remembered"])
    return value["codec"]


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Iterator[str]]]:
    for batch in by_bytes(batches, column, _BATCH):
        yield batch, (x.as_py() or "" for x in batch.column(column))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """doc_id and ids (array<int>) of every whole text."""
    codec = broadcast_codec(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_of(codec)
        for batch, texts in _texts(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.packed(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary): the bytes that the ids stand for; null ids are none."""
    codec = broadcast_codec(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_of(codec)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((own.decode(x.as_py() or []) for x in batch.column("ids")), pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(releasing(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id", with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:  # noqa: A002
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, and the ids if asked for: encodes, then decodes, in one pass over the texts.

    ``remembered`` bounds the bytes of pre-tokens in each of two generations of a Python worker: more of them, fewer merges.
    """
    codec = broadcast_codec(docs.sparkSession, path, pattern, remembered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_of(codec)
        number = [str(k) for k in range(len(own.tokens))].__getitem__
        for batch in by_bytes(batches, "text", _BATCH):
            every, n, said, back = [], [], [], []
            for text in batch.column("text"):
                packed = own.packed(text.as_py() or "")
                ids = packed.tolist()
                n.append(len(ids))
                said.append(hashlib.sha256(" ".join(map(number, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    every.append(packed)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(every, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
