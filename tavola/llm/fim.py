"""Fill-in-the-middle transformation as a ``pyarrow.compute`` pipeline.

A text falls into units: white space with the word behind it, or the white space at the end.
Each Arrow slice goes through whole-column steps only: texts are split into lists of units, the
lists are flattened with the index of their row, a unit's ordinal is its place less its row's
first place, units are filtered by role (prefix, middle, suffix), the filtered units become lists
again, and ``binary_join`` makes the pieces and the output of every row.

The cuts come from the hash of the seed and the id, so a row's result depends on nothing but
itself: no shuffle, the same in every attempt, in any partitioning.

Defined cases: a null or empty text is plain with no units; a text that holds a marker is plain,
so every output can be read back; a null id hashes as the empty string; repeated rows give
repeated results; columns beside the id and the text are not read, whatever their names. Texts
are valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.arrow_slices import by_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: A byte that no UTF-8 text holds; put between units before they are split.
_CUT = b"\xff"
_WORD_END = rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])"
_NOTHING = pa.scalar(b"", pa.binary())


def _mod(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _lists(lengths: pa.Array, values: pa.Array) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths.to_numpy(), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _join(*pieces) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.binary()) if isinstance(p, bytes) else p for p in pieces], _NOTHING)


def _characters(piece: pa.Array) -> pa.Array:
    return pc.cast(pc.utf8_length(pc.cast(piece, pa.string())), pa.int64())


def _transformed(rate: int, spm: int):
    """Arrow slices (doc_id, text, h1 to h4) to (doc_id, n, form, prefix_chars, middle_chars, output)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            h1, h2, h3, h4 = (batch.column(f"h{k}") for k in (1, 2, 3, 4))
            text = pc.fill_null(pc.cast(batch.column("text"), pa.binary()), b"")
            marked = pc.replace_substring_regex(text, pattern=_WORD_END, replacement=rb"\1" + _CUT + rb"\2")
            units = pc.split_pattern(marked, pattern=_CUT)
            held = pc.cast(pc.list_value_length(units), pa.int64())
            empty = pc.equal(pc.binary_length(text), 0)  # split gives one empty unit
            n = pc.if_else(empty, 0, held)

            one, two = _mod(h1, pc.add(n, 1)), _mod(h2, pc.add(n, 1))
            lo, hi = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
            flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
            starts = pc.subtract(pc.cumulative_sum(held), held)
            ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(starts, parent))
            in_prefix = pc.less(ordinal, pc.take(lo, parent))
            in_suffix = pc.greater_equal(ordinal, pc.take(hi, parent))
            in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
            roles = ((in_prefix, lo), (in_middle, pc.subtract(hi, lo)), (in_suffix, pc.subtract(held, hi)))
            prefix, middle, suffix = (pc.binary_join(_lists(count, pc.filter(flat, role)), _NOTHING) for role, count in roles)

            plain = pc.or_(empty, pc.greater_equal(_mod(h3, pa.scalar(100, pa.int64())), rate))
            for marker in (PREFIX, SUFFIX, MIDDLE):
                plain = pc.or_(plain, pc.match_substring(text, marker))
            is_spm = pc.less(_mod(h4, pa.scalar(100, pa.int64())), spm)
            psm = _join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
            output = pc.if_else(plain, text, pc.if_else(is_spm, _join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), psm))
            none = pa.scalar(None, pa.int64())
            columns = {
                "doc_id": batch.column("doc_id"),
                "n": n,
                "form": pc.if_else(plain, "plain", pc.if_else(is_spm, "spm", "psm")),
                "prefix_chars": pc.if_else(plain, none, _characters(prefix)),
                "middle_chars": pc.if_else(plain, none, _characters(middle)),
                "output": pc.cast(output, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def fill_in_middle(docs: DataFrame, text: str = "text", id: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:  # noqa: A002
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of every whole text.

    ``rate`` in a hundred texts are transformed, ``spm`` in a hundred of those put the suffix first.
    """
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"), said.alias("said"))
    draws = [F.conv(F.substring("said", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", *draws).mapInArrow(
        _transformed(rate, spm), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def _halves(pieces: pa.Array, marker: bytes) -> tuple[pa.Array, pa.Array]:
    """What stands before and behind the first ``marker``."""
    split = pc.split_pattern(pieces, pattern=marker, max_splits=1)
    return pc.list_element(split, 0), pc.list_element(split, 1)


def _texts(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that outputs of the given forms were made from."""
    texts = output = pc.cast(output, pa.binary())
    for name, first, second in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        own = pc.equal(form, name)
        _, body = _halves(pc.filter(output, own), first)
        one, rest = _halves(body, second)
        two, middle = _halves(rest, MIDDLE)
        texts = pc.replace_with_mask(texts, own, _join(one, middle, two) if name == "psm" else _join(two, middle, one))
    return pc.cast(texts, pa.string())


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "output"):
        yield batch.append_column("restored", _texts(batch.column("output"), batch.column("form")))


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the text rebuilt (``restored``) from output and form alone."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in transformed.schema)
    return transformed.mapInArrow(_restored, f"{kinds}, restored string")
