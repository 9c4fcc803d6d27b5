"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product.  Directions are hashed, so no vector's length moves another,
and the largest cosine is the smallest distance.  Each of ``tables`` tables cuts ``functions`` Gaussian projections into cells
of ``width``; their combination is a bucket.  A query visits, in each table, the
``probes`` buckets likeliest to hold near vectors: its own and those a cell beside it in
some projections, in the order of the squared distances to the cells' borders.  Every
table's candidates are scored exactly and merged.

The number of functions and probes follows the data: a sample of queries tells which cosine the k nearest vectors
have, a trial on random pairs tells which cosines the probes find with a chance of ``SURE``, and the finest
cells are taken that find those.  More vectors have nearer neighbours, so a query then meets a smaller share of them.

Lengths come in afterwards: vectors fall in bands of like norm, and from the k-th score found,
the query's norm and a band's largest norm follows the least cosine that a nearer vector of the
band can have.  Probes find a vector of cosine ``sure_cosine`` or more with a chance of ``SURE`` at
least; a query meets every vector of the bands whose least cosine is below that.

Every vector is indexed, equal ones once with their smallest ``k`` + 1 ids (no others can be
among k nearest); queries with equal vectors are searched once.  A vector is known by a number of its own,
given once when the different vectors are written.  A bucket of any size
is cut into blocks of ``BLOCK`` vectors by ``BLOCK`` queries, so tasks stay bounded.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, nor do those of another length than the most frequent one; a null id takes no part; rows that repeat
id and vector count once; ties go to the smaller id; a query that finds fewer than k meets every vector, so it has k, or all others if there are fewer; input columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.arrow_runs import runs
from tavola.llm.staging import stage

#: Vectors and queries that meet in one task at most.
BLOCK = 4096
#: Chance of finding each of the nearest vectors that the probes must give; else the band is searched whole.
SURE = 0.9
#: Bands of norms: so many for each doubling, the last one with all shorter vectors.
_STEPS, _BANDS = 4, 64
_SALTS = 64
#: Functions of a table and probes to choose from, finer cells last, and queries that the choice is judged by.
PLANS = ((6, 24), (7, 32), (8, 64), (9, 96), (10, 128), (12, 192), (14, 256), (16, 256))
SAMPLE = 64
_KEYS = ["tab", "bucket", "i", "j"]


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def probe_order(inside: np.ndarray, width: float, probes: int) -> list[dict[int, int]]:
    """Perturbations {projection: -1 or 1} in order of estimated success; ``inside`` is the place in each cell."""
    low, high = inside, width - inside
    cost = sorted([(float(d) ** 2, j, -1) for j, d in enumerate(low)] + [(float(d) ** 2, j, 1) for j, d in enumerate(high)])
    out: list[dict[int, int]] = [{}]
    heap = [(cost[0][0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heappop(heap)
        used = [cost[c][1] for c in chosen]
        if len(set(used)) == len(used):  # a projection moves one way only
            out.append({cost[c][1]: cost[c][2] for c in chosen})
        last = chosen[-1]
        if last + 1 < len(cost):
            heappush(heap, (total + cost[last + 1][0], (*chosen, last + 1)))
            heappush(heap, (total - cost[last][0] + cost[last + 1][0], (*chosen[:-1], last + 1)))
    return out


def chances(tables: int, functions: int, width: float, probes: int, seed: int, pairs: int = 256) -> np.ndarray:
    """Chance that the probes meet a vector, by its cosine with the query in hundredths (0 to 99), by trial on random pairs.

    The first one is the share of all vectors that a query meets where directions are spread evenly.
    """
    rng = np.random.default_rng(seed)
    along, across = rng.normal(size=(2, pairs, tables, functions))
    offset = rng.uniform(0, width, along.shape)
    cells = np.floor((along + offset) / width)
    inside = along + offset - cells * width
    moves = np.full((pairs, tables, probes, functions), np.inf)  # fewer moves may exist than probes
    for at in np.ndindex(pairs, tables):
        for m, steps in enumerate(probe_order(inside[at], width, probes)):
            moves[at][m] = 0
            for j, step in steps.items():
                moves[at][m, j] = step
    out = np.empty(100)
    for h in range(100):
        u = h / 100
        away = np.floor((u * along + np.sqrt(1 - u * u) * across + offset) / width) - cells
        out[h] = (moves == away[:, :, None]).all(axis=-1).any(axis=(1, 2)).mean()
    return out


def sure_cosine(found: np.ndarray) -> float:
    """The least cosine from which on ``chances`` reach ``SURE``."""
    short = np.flatnonzero(found < SURE)
    return min(1.0, (short[-1] + 1) / 100) if len(short) else 0.01


@dataclass(frozen=True)
class Plan:
    """Functions of a table and probes, the least cosine that the probes are sure of, and the share of evenly spread vectors met."""

    functions: int
    probes: int
    sure: float
    share: float


def choose(needed: float, tables: int, width: float, seed: int, plans: tuple[tuple[int, int], ...] = PLANS) -> Plan:
    """The finest cells whose probes still find cosines from ``needed`` on with a chance of ``SURE``; else the coarsest."""
    best = None
    for functions, probes in plans:
        found = chances(tables, functions, width, probes, seed)
        plan = Plan(functions, probes, sure_cosine(found), float(found[0]))
        if best is not None and plan.sure > needed:
            break
        best = plan
    return best


def needed_cosine(distinct: DataFrame, k: int, dim: int) -> float:
    """The cosine that all but ``1 - SURE`` of the queries' k nearest vectors reach, judged by ``SAMPLE`` queries.

    The sample (those of the smallest hashes) meets every vector; a task gives its k + 1 best for each.
    """
    some = distinct.where("asked").orderBy(F.xxhash64("vkey"), "vkey").limit(SAMPLE).select("vec").toArrow()
    if not some.num_rows:
        return 1.0
    held = some.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    shared = distinct.sparkSession.sparkContext.broadcast(held)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value / np.abs(shared.value).max(axis=1)[:, None]  # a query's length moves none of its scores
        top = np.full((len(asked), k + 1), -np.inf)
        cosine = np.zeros_like(top)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                x = _vectors(whole.slice(at, 2048))
                score = asked @ x.T
                size = np.sqrt(((x / np.abs(x).max(axis=1)[:, None]) ** 2).sum(axis=1)) * np.abs(x).max(axis=1)
                both = np.concatenate([top, score], axis=1)
                near = np.concatenate([cosine, score / np.sqrt((asked**2).sum(axis=1))[:, None] / size], axis=1)
                keep = np.argpartition(-both, k, axis=1)[:, : k + 1]
                top, cosine = np.take_along_axis(both, keep, axis=1), np.take_along_axis(near, keep, axis=1)
        q, at = np.nonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(top[q, at]), pa.array(cosine[q, at])], names=["q", "score", "cosine"])

    each = distinct.select("vec").mapInArrow(best, "q long, score double, cosine double")
    nearest_first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("cosine")))
    least = each.withColumn("place", nearest_first).where(F.col("place") <= k + 1).groupBy("q").agg(F.min("cosine").alias("least")).toArrow()
    return float(np.quantile(least.column("least").to_numpy(), 1 - SURE))


class Hashes:
    """Projections of all tables for vectors of ``dim`` numbers."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.width, self.tables, self.functions, self.probes = width, tables, functions, probes
        self.lines = rng.normal(size=(dim, tables * functions))
        self.offsets = rng.uniform(0, width, tables * functions)
        self.factors = rng.integers(1, 2**63, functions, dtype=np.int64) | 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, functions) positions in units of the projection."""
        x = x / np.abs(x).max(axis=1)[:, None]
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        return (x @ self.lines + self.offsets).reshape(len(x), self.tables, self.functions)

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.factors).sum(axis=-1)


def _log_norm(dim: int) -> Callable:
    """Binary logarithm of a vector's norm, finite for every usable vector."""

    @F.arrow_udf("double")
    def compute(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        most = np.abs(x).max(axis=1)
        return pa.array(np.log2(most) + np.log2(((x / most[:, None]) ** 2).sum(axis=1)) / 2)

    return compute


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1)


def _deal(hashes: Hashes) -> Callable:
    """A row per table for an indexed vector, a row per probe for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x, n = _vectors(batch), batch.num_rows
                places = hashes.places(x)
                cells = np.floor(places / hashes.width).astype(np.int64)
                rows, tabs = np.repeat(np.arange(n), hashes.tables), np.tile(np.arange(hashes.tables), n)
                yield _dealt(batch, rows, tabs, hashes.bucket(cells).ravel(), False)
                asked = np.flatnonzero(np.asarray(batch.column("asked").to_numpy(zero_copy_only=False), dtype=bool))
                if not len(asked):
                    continue
                cells = cells[asked]
                inside = places[asked] - cells * hashes.width
                rows, tabs, buckets = [], [], []
                for q, row in enumerate(asked):
                    for tab in range(hashes.tables):
                        for moves in probe_order(inside[q, tab], hashes.width, hashes.probes):
                            cell = cells[q, tab].copy()
                            for j, step in moves.items():
                                cell[j] += step
                            rows.append(row)
                            tabs.append(tab)
                            buckets.append(cell)
                yield _dealt(batch, np.array(rows), np.array(tabs), hashes.bucket(np.array(buckets)), True)

    return run


def _dealt(batch: pa.RecordBatch, rows: np.ndarray, tabs: np.ndarray, buckets: np.ndarray, query: bool) -> pa.RecordBatch:
    take = pa.array(rows)
    columns = [pa.array(tabs.astype(np.int32)), pa.array(buckets), pa.array(np.full(len(rows), query)), *(batch.column(c).take(take) for c in ("vkey", "first", "vec"))]
    return pa.RecordBatch.from_arrays(columns, names=["tab", "bucket", "query", "vkey", "first", "vec"])


def _nearest(k: int) -> Callable:
    """The ``k`` best vectors of a block for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _KEYS):
            batch = table.combine_chunks().to_batches()[0]
            x = _vectors(batch)
            query = np.asarray(batch.column("query").to_numpy(zero_copy_only=False), dtype=bool)
            keys = batch.column("vkey").to_numpy()
            held, ids, first = x[~query], keys[~query], batch.column("first").to_numpy()[~query]
            if not len(held):
                continue
            asked, names = x[query], keys[query]
            for at in range(0, len(asked), 256):
                part = asked[at : at + 256]
                rough = part @ held.T
                kth = np.partition(rough, -k, axis=1)[:, -k] if len(held) > k else np.full(len(part), -np.inf)
                q, v = np.nonzero(rough >= (kth - 1e-9 * (1 + np.abs(kth)) if len(held) > k else kth)[:, None])
                score = np.zeros(len(q))
                for d in range(x.shape[1]):  # one order of summation, so equal vectors score equally
                    score += part[q, d] * held[v, d]
                order = np.lexsort((ids[v], first[v], -score, q))
                q, v, score = q[order], v[order], score[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                best = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(names[at + q[best]]), pa.array(ids[v[best]]), pa.array(first[v[best]]), pa.array(score[best])], names=["q", "v", "first", "score"])

    return run


def _met(dealt: DataFrame, k: int) -> DataFrame:
    """q, v, first, score: the ``k`` best vectors for each query in every block of a bucket that it meets, each pair once."""
    blocks = dealt.groupBy("tab", "bucket").agg(*[F.ceil(F.count(F.when(F.col("query") == side, 1)) / BLOCK).alias(n) for n, side in (("vectors", False), ("queries", True))]).where("vectors > 0 and queries > 0")
    met = dealt.join(blocks, ["tab", "bucket"])
    own = F.pmod(F.xxhash64("vkey"), F.when(F.col("query"), F.col("queries")).otherwise(F.col("vectors")))
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("vectors")).otherwise(F.col("queries")) - 1)))
    met = met.select("tab", "bucket", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("j"), "query", "vkey", "first", "vec")
    return met.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_nearest(k), "q long, v long, first long, score double").dropDuplicates(["q", "v"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 8, functions: int | None = None, width: float = 2.0, probes: int | None = None, seed: int = 5, vector: str = "embedding", id: str = "vec_id") -> DataFrame:  # noqa: A002
    """query_id, rank, vec_id, score: the nearest found of every row for which ``is_query`` holds.

    Without ``functions`` they and the probes come from the data: the nearer the k-th neighbours of a sample of queries, which they
    are where there are many vectors, the finer the cells, and the smaller the share of vectors that a query meets.
    """
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    rows = stage(rows.where(F.size("vec") == dim), "vectors")

    # equal vectors are one from here on, with their smallest k + 1 ids
    single = rows.groupBy("vec", "vec_id").agg(F.max("asked").alias("asked"), F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).alias("salt"))
    few = single.withColumn("place", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = few.groupBy("vec").agg(F.min("vec_id").alias("first"), F.collect_list("vec_id").alias("ids"))
    asking = single.groupBy("vec").agg(F.max("asked").alias("asked"))
    numbered = ids.join(asking, "vec").withColumns({"size": _log_norm(dim)("vec"), "vkey": F.monotonically_increasing_id()})
    distinct = stage(numbered, "distinct")  # the numbers are fixed from here on
    given = ((functions, probes or 24),) if functions else PLANS
    plan = choose(needed_cosine(distinct, k, dim) if len(given) > 1 else 0.0, tables, width, seed, given)
    hashes = Hashes(dim, tables, plan.functions, width, plan.probes, seed)
    queries = single.where("asked").join(distinct.select("vec", "vkey"), "vec").select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("q"))

    dealt = stage(distinct.select("vkey", "first", "vec", "asked").mapInArrow(_deal(hashes), f"tab int, bucket long, query boolean, vkey long, first long, vec {rows.schema['vec'].dataType.simpleString()}"), "dealt")
    found = stage(_met(dealt, k + 1), "found")
    nearer = [F.desc("score"), F.col("first"), F.col("v")]
    place = F.row_number().over(Window.partitionBy("q").orderBy(*nearer))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1)

    # a query meets every vector of the bands where the probes may have missed one above its k-th score
    upto = F.sum("n").over(Window.partitionBy("q").orderBy(*nearer))
    kth = best.join(distinct.select(F.col("vkey").alias("v"), F.size("ids").alias("n")), "v").withColumn("upto", upto).where(F.col("upto") > k).groupBy("q").agg(F.max("score").alias("kth"))
    longest = distinct.agg(F.max("size")).first()[0]
    banded = distinct.withColumn("band", F.least(F.floor((longest - F.col("size")) * _STEPS), F.lit(_BANDS - 1)).cast("long"))
    bands = banded.groupBy("band").agg(F.max("size").alias("most"))
    least = math.log2(plan.sure) + F.col("size") + F.col("most")
    unsure = distinct.where("asked").join(kth, F.col("vkey") == F.col("q"), "left").crossJoin(F.broadcast(bands))
    unsure = unsure.where(~F.coalesce((F.col("kth") > 0) & (F.log2("kth") >= least), F.lit(False)))
    unsure = stage(unsure.select("band", "vkey", "first", "vec"), "unsure")
    if not unsure.isEmpty():
        whole = [t.select(F.lit(0).alias("tab"), F.col("band").alias("bucket"), F.lit(side).alias("query"), "vkey", "first", "vec") for t, side in ((banded, False), (unsure, True))]
        found = found.unionByName(_met(whole[0].union(whole[1]), k + 1)).dropDuplicates(["q", "v"])
        best = found.withColumn("place", place).where(F.col("place") <= k + 1)
    best = best.join(distinct.select(F.col("vkey").alias("v"), F.explode("ids").alias("vec_id")), "v").join(queries, "q").where("vec_id <> query_id or v <> q")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id", "v"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
