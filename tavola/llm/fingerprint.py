"""Document fingerprints by a homomorphic hash of the multiset of paragraphs.

A paragraph is hashed to a wide vector; a text's fingerprint is the sum of its paragraphs'
vectors, each lane modulo a power of two.  So

* the order of paragraphs doesn't matter, their number of times does;
* a paragraph goes in or out by adding or subtracting its vector (``insert``, ``delete``);
* the fingerprint of a collection is the sum of its texts' fingerprints, in any grouping
  (``add_up``).

``WORDS`` lanes modulo 2**64 hold uniform values: different multisets agree in them by
chance only (2**-512 for any two).  ``SIGNS`` lanes modulo 2**16 hold +1 or -1: the squared length of
the difference of two such sums estimates how many paragraphs differ, whence ``likeness``, with a
standard error of about ``sqrt(2 / SIGNS)`` where little is shared and none where nothing differs.

A paragraph is a line without the white space around it; a line of more than ``LONG`` bytes counts as its
sentences, so that a text of one line has parts to compare.  Lines of white space are no paragraphs.

Defined cases: a null or empty text, or one of white space, has the fingerprint of nothing (all lanes 0),
which is fully like another of nothing and not at all like any other; repeated rows are neighbours like any
rows; null ids come first in the order of ids; rows of one id are ordered by the hash of their text;
an only document is its own neighbour; columns beside the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.arrow_slices import by_bytes
from tavola.llm.staging import stage

#: Lanes modulo 2**64 and lanes modulo 2**16.
WORDS, SIGNS = 8, 128
#: Bytes of a line beyond which it counts as its sentences.
LONG = 200
_SENTENCE = re.compile(rb"[^.!?]*[.!?]+|[^.!?]+")
_BYTES = WORDS * 8 + SIGNS // 8
#: Paragraphs whose vectors are held at once.
_HELD = 4096
#: Groups whose sums a task holds at once.
_GROUPS = 4096


def paragraphs(text: bytes) -> list[bytes]:
    """Lines without the white space around them; the sentences of long lines; nothing empty."""
    out = []
    for line in text.split(b"\n"):
        parts = [line] if len(line) <= LONG else _SENTENCE.findall(line)
        out += [p for p in map(bytes.strip, parts) if p]
    return out


def vector(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the paragraphs' vectors: (words, signs), both unsigned and wrapped."""
    words, signs = np.zeros(WORDS, np.uint64), np.zeros(SIGNS, np.int64)
    for at in range(0, len(parts), _HELD):
        some = parts[at : at + _HELD]
        data = np.frombuffer(b"".join([hashlib.shake_128(p).digest(_BYTES) for p in some]), np.uint8).reshape(len(some), _BYTES)
        words += np.ascontiguousarray(data[:, : WORDS * 8]).view(np.uint64).sum(axis=0, dtype=np.uint64)
        signs += 2 * np.unpackbits(data[:, WORDS * 8 :], axis=1).sum(axis=0, dtype=np.int64) - len(some)
    return words, signs.astype(np.uint16)


def _packed(v: tuple[np.ndarray, np.ndarray]) -> bytes:
    return v[0].astype("<u8").tobytes() + v[1].astype("<u2").tobytes()


def to_string(v: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(_packed(v)).decode("ascii")


def from_string(said: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(said)
    return np.frombuffer(data[: WORDS * 8], "<u8").astype(np.uint64), np.frombuffer(data[WORDS * 8 :], "<u2").astype(np.uint16)


def fingerprint(text: str | None) -> str:
    return to_string(vector(paragraphs((text or "").encode("utf-8"))))


def insert(said: str, text: str) -> str:
    """The fingerprint after the paragraphs of ``text`` have come in, wherever they stand."""
    return _changed(said, text, np.add)


def delete(said: str, text: str) -> str:
    """The fingerprint after the paragraphs of ``text`` have gone."""
    return _changed(said, text, np.subtract)


def _changed(said: str, text: str, by: np.ufunc) -> str:
    old, own = from_string(said), vector(paragraphs(text.encode("utf-8")))
    return to_string((by(old[0], own[0]), by(old[1], own[1])))


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    one, two, apart = (x.view(np.int16).astype(np.float64) for x in (a[1], b[1], a[1] - b[1]))
    whole = one @ one + two @ two
    return max(0.0, 1.0 - float(apart @ apart) / whole) if whole else 0.0


def likeness(a: str, b: str) -> float:
    """0 to 1: twice the shared part of two multisets of paragraphs over the sum of both, estimated; 1 for equal fingerprints."""
    return _near(from_string(a), from_string(b))


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by the first as many code points (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Results as they are staged: digests and fingerprints as bytes, a quarter to a half smaller than their text.
_RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["doc_id", *(c.split()[0] for c in _RESULT.split(", "))]


def _row(doc, text: str, own, following: str, its) -> tuple:
    """One result from a text, the following one, and the vectors of both."""
    data = edited(text, following).encode("utf-8")
    new = vector(paragraphs(data))
    return doc, len(text), hashlib.sha256(data).digest(), _packed(own), _packed(new), _near(own, new), _near(own, its)


def _neighbours(kind: pa.DataType):
    """Results of a sorted partition's rows but the last; its first and last text, for the partitions beside it."""
    import pyspark

    types = [kind, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    names = [*_NAMES, "part", "end", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pyspark.TaskContext.get().partitionId()
        held = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in by_bytes(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                own = vector(paragraphs(text.encode("utf-8")))
                if held is None:
                    rows.append((doc, *[None] * 6, part, "first", text))
                else:
                    rows.append((*_row(*held, text, own), part, None, None))
                held = doc, text, own
            if rows:
                yield made(rows)
        if held is not None:
            yield made([(held[0], *[None] * 6, part, "last", held[1])])

    return run


def _seams(kind: pa.DataType):
    """Results of the partitions' last rows, each with the text that follows it."""
    types = [kind, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows = []
            for doc, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
                own, its = (vector(paragraphs(t.encode("utf-8"))) for t in (text, following))
                rows.append(_row(doc, text, own, following, its))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)

    return run


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The documents are dealt to ranges of (id, hash of the text), as many as
    ``spark.sql.shuffle.partitions``: the texts move once.  Each task walks its range in order
    with the row before in hand; a range's last text meets the next range's first one in a join of one
    row a range.  Rows that are alike in id and text are told apart by their place in the input, so
    no group of copies makes a range larger than another.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    field = rows.schema["doc_id"].dataType
    kind = to_arrow_type(field)
    order = ["doc_id", "mark", "place"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({"mark": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    id_type = field.simpleString()
    found = stage(dealt.mapInArrow(_neighbours(kind), f"doc_id {id_type}, {_RESULT}, part int, end string, text string"), "fingerprints")

    used = sorted(r["part"] for r in found.where("end = 'first'").select("part").collect())  # a number for each range
    behind = list(zip(used, used[1:] + used[:1], strict=True))
    first = found.where("end = 'first'").select(F.col("part").alias("behind"), F.col("text").alias("following"))
    last = found.where("end = 'last'").select("part", "doc_id", "text")
    last = last.join(spark.createDataFrame(behind, "part int, behind int"), "part").join(first, "behind")
    seams = last.select("doc_id", "text", "following").mapInArrow(_seams(kind), f"doc_id {id_type}, {_RESULT}")
    said = {c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}  # base64() may break lines
    said["edited_sha256"] = F.lower(F.hex("edited_sha256"))
    return found.where("end is null").select(*_NAMES).unionByName(seams).withColumns(said)


def _partial(keys: list[str]):
    """Sums of the signed fingerprints of each group that a task meets, a bounded number of groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def made(schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in sums], schema.field(c).type) for i, c in enumerate(keys)]
            said = pa.array([to_string(v) for v in sums.values()], pa.string())
            return pa.RecordBatch.from_arrays([*columns, said], names=[*keys, "fingerprint"])

        for batch in batches:
            for key, said, sign in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("fingerprint").to_pylist(), batch.column("sign").to_pylist(), strict=True):
                total = sums.setdefault(key, [np.zeros(WORDS, np.uint64), np.zeros(SIGNS, np.uint16)])
                for lane, own in zip(total, from_string(said), strict=True):
                    (np.add if sign > 0 else np.subtract)(lane, own, out=lane)
            if len(sums) >= _GROUPS:
                yield made(batch.schema)
                sums = {}
        if sums:
            yield made(batch.schema)

    return run


def _total(keys: list[str]):
    """The sum of a group's partial sums."""

    def run(table: pa.Table) -> pa.Table:
        words, signs = np.zeros(WORDS, np.uint64), np.zeros(SIGNS, np.uint16)
        for said in table.column("fingerprint").to_pylist():
            own = from_string(said)
            words, signs = words + own[0], signs + own[1]
        return table.select(keys).slice(0, 1).append_column("fingerprint", pa.array([to_string((words, signs))], pa.string()))

    return run


def add_up(prints: DataFrame, keys: list[str], sign: str | None = None) -> DataFrame:
    """The fingerprint of each group's texts together: keys and fingerprint.

    ``sign`` names a column of +1 (in) and -1 (out), so a table of fingerprints together with one of signed
    changes gives the fingerprints after the changes.  Sums are made in the tasks first; a group then
    has a few rows a task, however many texts it holds.  A null fingerprint takes no part.
    """
    rows = prints.where("fingerprint is not null").select(*keys, "fingerprint", (F.col(sign) if sign else F.lit(1)).cast("int").alias("sign"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", fingerprint string"
    return rows.mapInArrow(_partial(keys), kinds).groupBy(*keys).applyInArrow(_total(keys), kinds)


def text_fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """id and fingerprint of every text, without neighbours and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            said = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(said, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")
