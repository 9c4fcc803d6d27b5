"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

Two texts link when the Jaccard similarity of their sets of word shingles is at least
``percent`` in a hundred.  The join is exact; nothing is capped, sampled or dropped.

1. Texts become sorted arrays of distinct shingle hashes.  Equal sets are one node from
   here on, so copies cost nothing further.
2. Tiles.  Linked sets share a shingle among the first ``n - ceil(t * n) + 1`` of either
   one under any order of all shingles.  Rare shingles come first (shingles of more than one in
   ``HOT_SHARE`` texts, a list bounded by that share, come last), so a tile holds the few
   nodes that share a rare shingle.  Tiles of the same members are handled once.
3. Each member is first compared with its tile's smallest node only.  What is linked by
   that is a component; tiles within one component are done.  This keeps a group of
   near copies linear in its rows.
4. The others go on without that smallest node and without members whose size is far from all others' of the tile.
   Tiles of one smallest node are put together up to ``BLOCK`` members, so a bitmap moves once for those, not once
   for each shingle.  Tiles of more members are cut by bands of size (bands two apart
   can't link) and into blocks for tasks of bounded size; in a task a set meets only the sets from its own size
   up to that size over the threshold.  Inside, bit counts
   of the bitmaps bound the overlap from above; pairs of two components that pass are
   verified on the sorted arrays.

Defined cases: a null or empty text, or one of white space, has no shingles, links with nothing and
is its own component; a null id takes part, and is never the smallest id unless a component has no other;
repeated rows are equal sets; column names of the input can't clash, as only the id and the text are read.
Shingles and sets are known by 64-bit hashes: among n different sets some two are taken as one with a chance of about n*n/2**65.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm import textvec
from tavola.llm.arrow_runs import runs
from tavola.llm.arrow_slices import releasing
from tavola.llm.components import components
from tavola.llm.exact_dedup import filter_bits, maybe_in, position_filter
from tavola.llm.staging import stage

#: Shingles of more than about one in HOT_SHARE texts come last in the order of shingles, by their counts;
#: there are at most 8 * HOT_SHARE times the mean set size of them.
HOT_SHARE = 10_000
#: Bits of a bitmap for each shingle, before rounding up to a power of two.
BITS = 4
#: Members of a tile that meet in one task.
BLOCK = 1024
#: Ratio of the sizes in a band; over 1 / 0.8, so linked sets are at most a band apart.
_SLACK = 1.0001
#: Nodes of a part in verification.
PART = 64
_TOKENS = 2 << 20
_ROWS = 1024
#: Nodes of a task whose copies are known at once.
_SEEN = 1 << 16


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for _, data, offsets in textvec.chunks(batch.column("text")):
        _, _, hashes, first = textvec.words(data, offsets)
        yield from textvec.shingles(hashes, first, width)


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _hot_counts(width: int) -> Callable:
    """Counts of the shingles that many texts of a task share; each task gives no more than a bounded number.

    A task folds the shingles of some texts at a time and leaves out what it meets once.  Of a shingle in one of HOT_SHARE texts
    a fold of n texts meets m = n / HOT_SHARE, and counts m - m * exp(-m) of them on average.  The sum of those, in millionths,
    goes with the null shingle: from that count on a shingle is frequent, however the texts are dealt to tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        tokens, totals, texts, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        folded, due = 0, 0.0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            """Counts of the known shingles and of those that the held texts repeat, without the rarer ones."""
            new = np.concatenate([*held, tokens[:0]])
            held.clear()
            new.sort()
            same = new[1:] == new[:-1]
            same[1:] &= ~same[:-1]  # a repeated shingle stands once in each two of its places
            known = np.union1d(new[1:][same], tokens)
            sums = np.searchsorted(new, known, "right") - np.searchsorted(new, known)
            sums[np.searchsorted(known, tokens)] += totals
            often = sums >= max(2, texts / HOT_SHARE / 2)
            return known[often], sums[often]

        for batch in batches:
            for own in _sets(batch, width):
                texts += 1
                held.append(own)
                size += len(own)
                if size >= _TOKENS:
                    tokens, totals = fold()
                    m = (texts - folded) / HOT_SHARE
                    folded, due, size = texts, due + m - m * math.exp(-m), 0
        tokens, totals = fold()
        m = (texts - folded) / HOT_SHARE
        due += m - m * math.exp(-m)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(totals)], names=["token", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([round(due * 1e6)], pa.int64())], names=["token", "n"])

    return count


def _prefixes(width: int, percent: int, hot) -> Callable:
    """id, hash of the text, set, size, bitmap, and the rare and the frequent part of the prefix.

    Within a task only the first row of a set has bitmap and prefix, the other rows of it have nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = hot.value
        seen: set[int] = set()
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            nodes, sizes, maps, rare, frequent = [], [], [], [], []
            for own in _sets(batch, width):
                n = len(own)
                sizes.append(n)
                node = _node(own) if n else None
                nodes.append(node)
                if node is None or node in seen:
                    maps.append(None)
                    rare.append(own[:0])
                    frequent.append(own[:0])
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                bits = np.zeros(max(64, 1 << (BITS * n - 1).bit_length()), dtype=bool)
                bits[(own % np.uint64(len(bits))).astype(np.int64)] = True
                maps.append(np.packbits(bits, bitorder="little").tobytes())
                at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                common = often[at] == own if len(often) else np.zeros(n, dtype=bool)
                length = n - (percent * n + 99) // 100 + 1
                rare.append(first := own[~common][:length])
                frequent.append(own[common][np.argsort(rank[at[common]])][: length - len(first)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), _lists(rare), _lists(frequent)],
                names=["doc_id", "row_hash", "node", "n", "bits", "rare", "frequent"],
            )

    return run


def _arrays(width: int) -> Callable:
    """Each set for every block that asks for it: (component, i, j, a, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for row, own in enumerate(_sets(batch, width)):
                if not len(own):
                    continue
                node = _node(own)
                blocks = [x for x in asked[row].as_py() if x["node"] == node]
                if blocks:
                    keys = [pa.array([x[k] for x in blocks], pa.int64()) for k in ("component", "i", "j", "node")]
                    sets = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(blocks), np.int32)), _lists([own])).dictionary_decode()
                    yield pa.RecordBatch.from_arrays([*keys, sets], names=["component", "i", "j", "a", "own"])

    return run


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap on fewer bits: halves are laid over each other."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _may_link(n: int, bits: bytes, ns: np.ndarray, many: list[bytes], percent: int) -> np.ndarray:
    """Whether each set can link with the one set, by the upper bound that the bitmaps give on the overlap."""
    words = min(len(bits), *map(len, many)) // 8
    one = _fold(np.frombuffer(bits, np.uint64), words)
    rest = np.stack([_fold(np.frombuffer(x, np.uint64), words) for x in many])
    return _bound(n, one, ns, rest, percent)


def _bound(n: int, one: np.ndarray, ns: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    shared = np.bitwise_count(rest & one).sum(axis=1, dtype=np.int64)
    only = np.bitwise_count(one).sum(dtype=np.int64) - shared
    others = np.bitwise_count(rest).sum(axis=1, dtype=np.int64) - shared
    overlap = np.minimum(n - only, ns - others)
    return (100 + percent) * overlap >= percent * (n + ns)


def _filter_pairs(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("an", "abits", "bn", "bbits")), strict=True)
            keep = [bool(_may_link(n, x, np.array([m]), [y], percent)[0]) for n, x, m, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tile_pairs(percent: int) -> Callable:
    """Pairs of different components that share a tile or tiles put together and that the bitmaps let pass, each in the first that it shares."""
    reach = 1 << (-(-100 // percent) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ["tile", "band", "cross", "i", "j"]):
            name, cross, i, j = (tile.column(c)[0].as_py() for c in ("tile", "cross", "i", "j"))
            tile = tile.sort_by("n")  # a set's band is the run of sets from its own size up
            places = [set(x) for x in tile.column("tiles").to_pylist()]
            node, n, root = (tile.column(c).to_numpy() for c in ("node", "n", "root"))
            reached = np.searchsorted(n, n * 100 // percent, side="right")
            side = np.asarray(tile.column("side").to_numpy(zero_copy_only=False), dtype=bool)
            maps = [np.frombuffer(x, np.uint64) for x in tile.column("bits").to_pylist()]
            width = np.array([len(x) for x in maps])
            apart = cross or i != j
            a, b = [], []
            for words in np.unique(width):  # sets that can link have bitmaps of one width or of nearly one
                held = np.flatnonzero((width >= words) & (width <= reach * words))
                bits = np.stack([_fold(maps[k], words) for k in held])
                for at in np.flatnonzero(width[held] == words):
                    row = held[at]
                    last = int(np.searchsorted(held, reached[row]))
                    to = held[at + 1 : last]
                    fits = (root[to] != root[row]) & (not apart or side[to] != side[row])
                    if fits.any():
                        to = to[fits]
                        to = to[_bound(int(n[row]), bits[at], n[to], bits[at + 1 : last][fits], percent)]
                        to = to[[min(places[row] & places[k]) == name for k in to]] if len(to) else to
                        a.append(np.full(len(to), node[row]))
                        b.append(node[to])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _linked(percent: int) -> Callable:
    """Of each block's pairs, links by intersecting sorted arrays; a pair that links already join is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["component", "i", "j"]):
            a, b = block.column("a").to_numpy(), pc.fill_null(block.column("b"), 0).to_numpy()
            lists = block.column("own").combine_chunks()
            held = np.asarray(lists.is_valid())
            own = {int(a[k]): lists[int(k)].values.to_numpy() for k in np.flatnonzero(held)}
            root = {k: k for k in own}

            def top(k: int, root: dict[int, int] = root) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            found = []
            for k in np.flatnonzero(~held):
                x, y = int(a[k]), int(b[k])
                if top(x) == top(y):
                    continue
                overlap = len(np.intersect1d(own[x], own[y], assume_unique=True))
                if (100 + percent) * overlap >= percent * (len(own[x]) + len(own[y])):
                    found.append((x, y))
                    root[top(x)] = top(y)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _id_key(id: str):  # noqa: A002
    """An id as a text that is never null, so that grouping and joining by it deal rows alike."""
    return F.coalesce(F.concat(F.lit("="), F.col(id).cast("string")), F.lit(""))


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the pairs (a, b) that connect whatever the pairs' links connect.

    Pairs meet in blocks: the nodes that share the smallest node around them are cut into parts of about ``PART``
    nodes, and a block holds the pairs between two parts with the arrays of their nodes.  So an array moves once for
    a part it has pairs with, not once for a pair.  Arrays are made anew from the texts of the nodes'
    representatives and go from there to their blocks: a Bloom filter of the representatives, of bounded size,
    is applied at the scan, so few other texts are moved.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.least("a", "b").alias("near"))
    roots = ends.groupBy("node").agg(F.min("near").alias("root"))
    parts = roots.groupBy("root").agg(F.ceil(F.count("*") / PART).alias("parts"))
    part = stage(roots.join(parts, "root").select("node", "root", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")), "parts")
    met = pairs.join(part.select(F.col("node").alias("a"), F.col("root").alias("ra"), F.col("part").alias("x")), "a").join(part.select(F.col("node").alias("b"), F.col("root").alias("rb"), F.col("part").alias("y")), "b")
    mine, its = F.struct(F.col("ra").alias("root"), F.col("x").alias("part")), F.struct(F.col("rb").alias("root"), F.col("y").alias("part"))
    block = F.xxhash64(F.least("ra", "rb"), F.greatest("ra", "rb")).alias("component")
    met = stage(met.select(block, F.least(mine, its)["part"].alias("i"), F.greatest(mine, its)["part"].alias("j"), "a", "b"), "met")

    keys = ["component", "i", "j"]
    asked = met.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", _id_key("rep").alias("id_key"), F.col("rep_hash").alias("row_hash")), "node")
    asked = stage(asked.groupBy("id_key", "row_hash").agg(F.collect_list(F.struct(*keys, "node")).alias("asked")), "asked")
    bits = filter_bits(asked.count())
    seen = stage(position_filter(asked.select(F.xxhash64("id_key").alias("h")), bits, least=1), "wanted")
    texts = docs.select(_id_key("doc_id").alias("id_key"), F.xxhash64("text").alias("row_hash"), "text")
    texts = maybe_in(texts.withColumn("h", F.xxhash64("id_key")), seen, bits).where("maybe")
    texts = texts.groupBy("id_key", "row_hash").agg(F.first("text").alias("text"))  # repeated rows once
    kinds = "component long, i long, j long, a long, own array<long>"
    members = texts.join(asked, ["id_key", "row_hash"]).select("text", "asked").mapInArrow(releasing(_arrays(width)), kinds)
    members = members.select(*keys, "a", F.lit(None).cast("long").alias("b"), "own")
    rows = members.unionByName(met.withColumn("own", F.lit(None).cast("array<long>")))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(_linked(percent)), "a long, b long")


def _open(member: DataFrame) -> DataFrame:
    """(token, members, lead) of the tiles that hold two components, those of the same members once; lead is the smallest node."""
    mark = F.xxhash64("node").cast("decimal(38,0)")
    still = member.groupBy("token").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(mark).alias("total"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("marks"), F.count("*").alias("members"), F.min("node").alias("lead")
    )
    return still.where("lo <> hi").groupBy("total", "marks", "members").agg(F.min("token").alias("token"), F.min("lead").alias("lead")).select("token", "members", "lead")


def _together(held: DataFrame, percent: int) -> DataFrame:
    """Open tiles (token, members, node, n, root) put together: (tile, members, node, n, root).

    In a tile of up to ``BLOCK`` members those stay that have another one near their size, and tiles of one smallest node
    become one until they have some ``BLOCK`` members.  So a node is there once for many tiles that it shares with the same
    nodes.  Larger tiles stay as they are.
    """
    by_size = Window.partitionBy("token").orderBy("n", "node")
    small = held.where(F.col("members") <= BLOCK).withColumns({"under": F.lag("n").over(by_size), "over": F.lead("n").over(by_size)})
    small = small.where((percent * F.col("n") <= 100 * F.col("under")) | (percent * F.col("over") <= 100 * F.col("n")))
    small = stage(small.select("token", "node", "n", "root"), "near")
    before = F.sum("members").over(Window.partitionBy("lead").orderBy("token")) - F.col("members")
    tile = _open(small).select("token", F.xxhash64("lead", F.floor(before / BLOCK)).alias("tile"))
    small = small.join(tile, "token").groupBy("tile", "node").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    large = held.where(F.col("members") > BLOCK).select(F.col("token").alias("tile"), "members", "node", "n", "root")
    return large.unionByName(small.withColumn("members", F.lit(0).cast("long")))


def _bands(open_tiles: DataFrame, percent: int) -> DataFrame:
    """Members of open tiles dealt to tasks: (tile, band, cross, i, j, side) and the member."""
    ratio = 100 / percent * _SLACK
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ratio)))
    m = open_tiles.withColumn("band", F.when(F.col("members") > BLOCK, band).otherwise(F.lit(0).cast("long")))
    size = m.groupBy("tile", "band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    near = size.select("tile", "band", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"), "blocks")
    near = near.select("tile", (F.col("band") + F.col("step")).alias("band"), "step", "blocks")  # seen from the bands beside it
    near = near.groupBy("tile", "band").agg(*[F.coalesce(F.max(F.when(F.col("step") == s, F.col("blocks"))), F.lit(0)).alias(k) for k, s in (("own", 0), ("above", -1), ("below", 1))])
    m = m.join(near, ["tile", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("own")))

    def span(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    block = F.col("block").cast("long")
    within = F.transform(span("own"), lambda k: F.struct(F.col("band").alias("band"), F.lit(False).alias("cross"), F.least(k, block).alias("i"), F.greatest(k, block).alias("j"), (k < block).alias("side")))
    up = F.transform(span("above"), lambda k: F.struct(F.col("band").alias("band"), F.lit(True).alias("cross"), block.alias("i"), k.alias("j"), F.lit(False).alias("side")))
    down = F.transform(span("below"), lambda k: F.struct((F.col("band") - 1).alias("band"), F.lit(True).alias("cross"), k.alias("i"), block.alias("j"), F.lit(True).alias("side")))
    return m.select("tile", "node", "n", "root", F.explode(F.concat(within, up, down)).alias("at")).select("tile", "at.*", "node", "n", "root")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:  # noqa: A002
    """One row per document: doc_id, n_shingles, component_id, kept, row_hash.

    component_id is the smallest id reachable by links, itself included; kept marks the
    document of that id, one for each component (rows that repeat both id and text are one
    document; a component without ids keeps the smallest row_hash); row_hash is xxhash64 of the text, to find the row again.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = docs.select("text").mapInArrow(releasing(_hot_counts(width)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = stage(counts, "counts")
    due = counts.where("token is null").select("n").first()
    least = max(10.0, docs.count() / HOT_SHARE / 8, (due["n"] if due else 0) / 1e6)
    found = counts.where(F.col("token").isNotNull() & (F.col("n") >= least)).toArrow()  # at most 8 * HOT_SHARE times the mean set size
    often = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(often)
    rank = np.argsort(np.lexsort((often, found.column("n").to_numpy())))  # one order for all texts: by count, then by hash
    hot = spark.sparkContext.broadcast((often[order], rank[order]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.withColumn("row_hash", F.xxhash64("text")).mapInArrow(
        releasing(_prefixes(width, percent, hot)), f"doc_id {kind}, row_hash long, node long, n long, bits binary, rare array<long>, frequent array<long>"
    )
    rows = stage(rows, "prefixes")
    heavy = rows.where("bits is not null")  # a node has one such row in a task or a few
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits")
    )
    nodes = stage(nodes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.row_hash").alias("rep_hash"), "n", "bits"), "nodes")

    # tiles: the nodes of a shared prefix shingle; the rare ones are few each, the frequent ones join a grouped minimum
    by_token = Window.partitionBy("token")
    rare = heavy.select("node", F.explode("rare").alias("token")).repartition("token").dropDuplicates(["token", "node"])
    rare = rare.select("token", "node", F.count("*").over(by_token).alias("members"), F.min("node").over(by_token).alias("leader")).where("members > 1")
    often = heavy.select("node", F.explode("frequent").alias("token")).distinct()
    often = often.join(often.groupBy("token").agg(F.count("*").alias("members"), F.min("node").alias("leader")).where("members > 1"), "token")
    tiles = stage(rare.unionByName(often), "tiles")

    # first links: each member with the smallest node of its tile
    ends = nodes.select("node", "n", "bits")
    stars = tiles.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("an")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("bn")), "b")
    stars = stars.where(F.lit(100) * F.least("an", "bn") >= F.lit(percent) * F.greatest("an", "bn")).select("a", "b", "an", "bn")
    stars = stars.join(ends.select(F.col("node").alias("a"), F.col("bits").alias("abits")), "a").join(ends.select(F.col("node").alias("b"), F.col("bits").alias("bbits")), "b")
    stars = stage(stars.mapInArrow(releasing(_filter_pairs(percent)), "a long, b long"), "pairs")
    links = stage(_verify(stars, docs, nodes, width, percent), "links")
    first = stage(components(links, "a", "b"), "roots")

    # the rest: tiles that still hold two components beside their smallest node, which has met all others
    member = tiles.where("members > 2 and node <> leader").select("token", "node").join(first.select(F.col("vertex").alias("node"), "root"), "node", "left")
    member = stage(member.select("token", "node", F.coalesce("root", "node").alias("root")), "members")
    held = member.join(_open(member).select("token", "members"), "token").join(nodes.select("node", "n"), "node")
    held = stage(held.select("token", "members", "node", "n", "root"), "held")
    held = stage(_together(held, percent), "together")
    places = held.groupBy("node").agg(F.collect_list("tile").alias("tiles"))
    dealt = _bands(held, percent).join(ends.select("node", "bits").join(places, "node"), "node")
    keys = ["tile", "band", "cross", "i", "j"]
    pairs = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "node", "n", "root", "bits", "tiles").mapInArrow(releasing(_tile_pairs(percent)), "a long, b long")
    more = stage(_verify(stage(pairs.distinct(), "pairs"), docs, nodes, width, percent), "links")

    # links found later join components found first
    root_of = first.select("vertex", "root")
    joins = more.join(root_of.toDF("a", "ra"), "a", "left").join(root_of.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joins = stage(joins, "joins")
    roots = first
    if not joins.isEmpty():
        upper = components(joins, "a", "b").toDF("root", "upper")
        alone = upper.join(first, upper["root"] == first["root"], "left_anti").select(F.col("root").alias("vertex"), "upper")  # in no link found first
        roots = first.join(upper, "root", "left").select("vertex", F.coalesce("upper", "root").alias("root")).union(alone)
    roots = roots.join(nodes.select(F.col("node").alias("vertex"), "rep"), "vertex")
    smallest = roots.groupBy("root").agg(F.min("rep").alias("component"))
    linked = stage(roots.join(smallest, "root").select(F.col("vertex").alias("node"), "component", "root"), "components")
    # a node outside any link is its own component; the row that stays is the first of the smallest id
    out = rows.select("doc_id", "row_hash", "node", "n").join(nodes.select("node", "rep"), "node", "left").join(linked, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep")))
    out = out.withColumn("group", F.coalesce("root", "node"))  # the component's node: its id may be null, or be the id of other texts too
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    chief = out.where(F.col("node").isNotNull() & first).groupBy("group").agg(F.min("row_hash").alias("chief"))
    out = out.join(chief.withColumnRenamed("group", "of"), F.col("group") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("node").isNull() | (first & (F.col("row_hash") == F.col("chief")))).alias("kept"), "row_hash")
