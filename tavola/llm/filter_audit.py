"""How document filters interact: who removes what, in every order of five filters.

A: under 200 words.  B: distinct words under half of the words.  C: over 3 in 100 characters are
A-Z.  D: holds any of ``#$%&*|``.  E: identical to the text of a smaller id.

E is decided by radix tries over the whole texts, not by hashes:

1. Each task puts its texts into a compressed trie, a bounded number of bytes at a time, whose
   terminals hold the smallest id.  The traversal gives a narrow row for each document (its failures,
   its terminal) and one row for each terminal with the text, so a text that a third of
   all rows share moves once for a trie, not once for a row.
2. Terminals are dealt to ranges of adaptive prefixes: a prefix whose texts hold more than a
   quarter of a range's share of all bytes is taken twice as long, and so on, unless they are one
   text.  Ranges are those of Spark's range partitioning, as many as ``spark.sql.shuffle.partitions``.
3. Each range is walked in order of the text into one trie.  Subtrees that the walk has left can't
   change, so beyond ``TRIE_BYTES`` they are traversed, their flags given, and dropped.  A terminal that is
   beaten (a smaller id elsewhere) goes back to the rows of its documents by number.
4. Rows become counts by part, failures and labels, and only these meet the 600 places in the orders.

Defined cases: a null text is empty; a null id is not smaller than any id and larger than all, so a row without id
is a copy if a row with an id has its text, and rows without ids are no copies of each other; rows that repeat id and
text are not copies of each other (no smaller id); a null part is the empty string; a label of an id holds for
each row of that id, several labels of one id hold together; an empty table gives no rows; columns beside
the named ones are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.arrow_slices import by_bytes
from tavola.llm.staging import stage

# The filters' limits.
FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 3, b"#$%&*|"

#: Bytes and rows of texts in the trie of a task's first pass, and bytes in that of a range, before it is traversed.
TRIE_BYTES, TRIE_ROWS = 8 << 20, 50_000
#: What a node costs beside its label, in bytes.
_NODE = 200
#: Members of a terminal whose flags are held at once.
_MEMBERS = 4096
#: Code points of the shortest prefix.
_FIRST = 4

_A_TO_Z = bytes(range(0x41, 0x5B))
_SIGN = re.compile(b"[" + re.escape(SIGNS) + b"]")


class Node:
    """A node of a compressed trie; ``members`` is None where no text ends."""

    __slots__ = ("label", "children", "least", "members")

    def __init__(self, label: bytes):
        self.label, self.children, self.least, self.members = label, {}, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed trie of byte strings; a terminal holds the smallest id and the numbers of its members."""

    def __init__(self):
        self.root, self.bytes, self.last = Node(b""), 0, b""

    def insert(self, text: bytes) -> Node:
        """The node at which ``text`` ends."""
        self.last = text
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = node = Node(text[at:])
                self.bytes += len(text) - at + _NODE
                break
            shared = _common(child.label, text, at)
            if shared < len(child.label):  # the edge is cut where the texts part
                above = Node(child.label[:shared])
                above.children[child.label[shared]] = child
                child.label = child.label[shared:]
                node.children[text[at]] = child = above
                self.bytes += _NODE
            node, at = child, at + shared
        return node

    def add(self, text: bytes, key: int | None, member) -> Node:
        """Count ``member`` with id ``key`` among the copies of ``text``."""
        node = self.insert(text)
        if node.members is None:
            node.members = []
        if key is not None and (node.least is None or key < node.least):
            node.least = key
        node.members.append(member)
        return node

    @staticmethod
    def traverse(node: Node, above: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """Every terminal below ``node`` with its text."""
        open_ = [(above + node.label, node)]
        while open_:
            path, node = open_.pop()
            if node.members is not None:
                yield path, node
            open_ += [(path + child.label, child) for child in node.children.values()]

    def finished(self) -> Iterator[Node]:
        """Terminals that texts after the last one can't reach, which are dropped; the texts came in order."""
        node, at = self.root, 0
        while at < len(self.last):
            ahead = self.last[at]
            for first, child in list(node.children.items()):
                if first != ahead:
                    yield from (n for _, n in self.traverse(child))
                    del node.children[first]
            if node.members:
                yield node
                node.members = []
            node = node.children[ahead]
            at += len(node.label)
        self.bytes = len(self.last) + _NODE


def failures(data: bytes, characters: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = data.split()  # at the white space of ASCII
    bits = len(words) < WORDS
    bits |= (100 * len(set(words)) < DISTINCT * len(words)) << 1
    bits |= (100 * (len(data) - len(data.translate(None, _A_TO_Z))) > CAPITALS * characters) << 2
    return bits | (_SIGN.search(data) is not None) << 3


def _beaten(least: int | None, own: int | None) -> bool:
    return least is not None and (own is None or least < own)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (its failures, flag within the trie, terminal) and one for each terminal (text, least)."""
    import pyspark

    task = pyspark.TaskContext.get().partitionId()
    ids, parts, bits, trie, number, schema = [], [], [], Trie(), 0, None

    def made() -> pa.RecordBatch:
        nonlocal number
        n = len(ids)
        at, copy, texts, least = [0] * n, [False] * n, [], []
        for text, node in trie.traverse(trie.root):
            for k in node.members:
                at[k], copy[k] = number + len(texts), _beaten(node.least, ids[k])
            texts.append(text)
            least.append(node.least)
        m = len(texts)
        ends = list(range(number, number + m))
        number += m
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids + [None] * m, schema.field("doc_id").type), pa.array(parts + [None] * m, pa.string()), pa.array(bits + [None] * m, pa.int32()),
                pa.array(copy + [None] * m, pa.bool_()), pa.array([task] * (n + m), pa.int32()), pa.array(at + ends, pa.int64()),
                pa.array([None] * n + least, schema.field("doc_id").type), pa.array([None] * n + texts, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "part", "failed", "copy", "task", "terminal", "least", "text"],
        )

    for batch in by_bytes(batches, "text"):
        schema = batch.schema
        texts = pc.fill_null(batch.column("text"), "")
        sizes = pc.utf8_length(texts).to_pylist()
        for key, part, data, size in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), pc.cast(texts, pa.binary()).to_pylist(), sizes, strict=True):
            trie.add(data, key, len(ids))
            ids.append(key)
            parts.append(part)
            bits.append(failures(data, size))
        if trie.bytes >= TRIE_BYTES or len(ids) >= TRIE_ROWS:
            yield made()
            ids, parts, bits, trie = [], [], [], Trie()
    if ids:
        yield made()


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terminals (task, terminal) whose text has a smaller id elsewhere; rows come in order of (text, least, nulls last)."""
    trie = Trie()

    def flagged(nodes: Iterator[Node]) -> pa.RecordBatch:
        found = [(task, end) for node in nodes for own, task, end in node.members if _beaten(node.least, own)]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int64())], names=["task", "terminal"])

    for batch in by_bytes(batches, "text"):
        columns = (batch.column(c).to_pylist() for c in ("least", "task", "terminal"))
        for data, own, task, end in zip(pc.cast(batch.column("text"), pa.binary()).to_pylist(), *columns, strict=True):
            node = trie.add(data, own, (own, task, end))
            if len(node.members) >= _MEMBERS:  # the first of them had the least id
                yield flagged([node])
                node.members = []
            if trie.bytes >= TRIE_BYTES:
                yield flagged(trie.finished())
    yield flagged(n for _, n in trie.traverse(trie.root))


def adaptive_prefix(texts: DataFrame, parts: int, text: str = "text") -> Column:
    """The prefix by which a text is dealt: as short as possible without holding too much.

    Prefixes that hold over 1 / (4 * parts) of all bytes and more than one text are doubled, until there
    are none.  At most 4 * parts prefixes of a length are too large; the driver holds their 64-bit hashes (a prefix that
    only shares the hash of a large one is doubled too: equal texts still have one prefix).
    """
    size, whole = F.octet_length(text) + F.lit(16), F.xxhash64(text)
    most = (texts.agg(F.sum(size)).first()[0] or 0) / (4 * parts)
    length, found = _FIRST, []

    def prefix(n: int) -> Column:
        return F.substring(text, 1, n)

    rest = texts
    while True:
        groups = rest.groupBy(F.xxhash64(prefix(length)).alias("h")).agg(F.sum(size).alias("size"), F.min(whole).alias("lo"), F.max(whole).alias("hi"))
        large = [r["h"] for r in groups.where((F.col("size") > most) & (F.col("lo") < F.col("hi"))).select("h").collect()]
        if not large:
            break
        found.append((length, large))
        rest = rest.where(F.xxhash64(prefix(length)).isin(large))
        length *= 2
    key = prefix(length)
    for n, large in reversed(found):
        key = F.when(F.xxhash64(prefix(n)).isin(large), key).otherwise(prefix(n))
    return key


def failed_filters(docs: DataFrame, text: str = "text", id: str = "doc_id", part: str = "lang") -> DataFrame:  # noqa: A002
    """doc_id, part and failed (bit k: the k-th of ``FILTERS``) of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    kinds = "doc_id long, part string, failed int, copy boolean, task int, terminal long, least long, text string"
    found = stage(rows.mapInArrow(_first_pass, kinds), "tries")

    ends = found.where("text is not null").select("task", "terminal", "least", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.withColumn("prefix", adaptive_prefix(ends, parts)).repartitionByRange(parts, "prefix")
    dealt = dealt.sortWithinPartitions("text", F.col("least").asc_nulls_last())
    beaten = dealt.select("task", "terminal", "least", "text").mapInArrow(_second_pass, "task int, terminal long").withColumn("beaten", F.lit(True))

    own = found.where("failed is not null").select("doc_id", "part", "failed", "copy", "task", "terminal").join(beaten, ["task", "terminal"], "left")
    is_copy = F.col("copy") | F.coalesce("beaten", F.lit(False))
    return own.select("doc_id", "part", F.col("failed").bitwiseOR(F.when(is_copy, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))


def interactions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for each part, order of the filters and step, from ``failed_filters`` and labels (doc_id, quality, toxic).

    Rows of one id, part and set of failures are counted before they meet the labels, and everything is counted by part, failures and
    labels before it meets the orders: at most 128 rows a part do.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    counted = rows.groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n")).join(said, "doc_id", "left")
    counted = counted.groupBy("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))

    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    every = counted.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))))

    def bit(step: str) -> Column:
        return F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {step}, 1)) - 1)")

    before = F.lit(0)
    for k in range(1, len(FILTERS)):
        before = before + F.when(F.col("step") > k, bit(str(k))).otherwise(0)
    every = every.select("*", bit("step").alias("bit"), before.alias("before"), F.expr("substr(filter_order, step, 1)").alias("letter"))
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    gone = F.col("failed").bitwiseAND(F.col("before")) != 0

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    steps = every.groupBy("part", "filter_order", "step", "letter").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("failed") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone & F.col("good")).alias("good_lost"), count(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    of_filter = Window.partitionBy("part", "letter")  # 120 rows
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(of_filter).alias("shapley"))
