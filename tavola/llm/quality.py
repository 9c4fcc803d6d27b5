"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a score quantile.

Features are shares and means over the bytes, words and shingles of a whole text, each
also cut at quantiles, so the score is additive and may bend.  A good and a bad
document of the labelled sample form a preference pair; the score's weights minimise
the logistic loss of feature differences over all chosen pairs (Newton steps with a
small ridge).  The score quantile at the share of bad labels is the threshold: scores
are shifted so that it lies at ``THRESHOLD``, and go through a logistic function.

``fit_all`` learns from every labelled row that is not held out: means, quantiles, pairs, the Newton steps' sums
and the threshold cover all of them.  Rows that repeat id, text and label are one with their count as weight.  The features are
staged; rows are dealt by hash to groups of some ``GROUP`` rows of either label, and pairs are formed in a group.  If one label is
rarer, its rows stand in several groups, so that every row has partners.  Only sums and counts reach the driver: bins of
values while a quantile is narrowed down, and a matrix of the weights' size a step.

``fit`` is the quick fit for a first look, which no query uses: it takes at most ``SAMPLE`` labelled documents of either label, those of smallest
xxhash64(id), and of each the ``TEXTS`` texts of smallest hash at most, and gives the weights of ``fit_all`` where this is all.
Scoring covers every whole text, in one pass without a shuffle.

Defined cases: a null text counts as empty and has a score like any other; rows with a null label and labels
without a document are left out; a document with several labels counts with each; without labels of both kinds every
score is the threshold, so nothing is rejected; repeated rows get equal scores; input columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm import textvec
from tavola.llm.arrow_runs import runs
from tavola.llm.arrow_slices import releasing
from tavola.llm.staging import stage
from tavola.session import ensure_checkpoint_dir

#: Labelled documents of either label that the quick fit takes at most, and texts of one id.
SAMPLE = 6000
TEXTS = 4
#: Rows of a label, on average and at most, among which pairs are formed.
GROUP = 2048
#: Preference pairs for each row of the more frequent label.
PAIRS = 3
THRESHOLD = 0.7
_CUTS = 12
_RIDGE = 1e-3
_SPREAD = 6.0
_PAIRS_AT_ONCE = 1024

_CLASSES = {
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "digit": [*range(0x30, 0x3A)],
    "space": [0x20],
    "line": [0x0A],
    "stop": [*b".,;:?'\"-()"],
    "shout": [*b"!"],
    "sign": [*b"#$%&*@^~_+=<>/\\`"],
    "frame": [*b"|[]{}"],
    "control": [*range(0x09), *range(0x0B, 0x20), 0x7F],
}
_OF_BYTE = np.full(256, len(_CLASSES), dtype=np.int64)  # the rest: bytes of other scripts
for _k, _bytes in enumerate(_CLASSES.values()):
    _OF_BYTE[_bytes] = _k
_KINDS = len(_CLASSES) + 1


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers per text."""
    rows = [_chunk(data, offsets) for _, data, offsets in textvec.chunks(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(_chunk(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    of_text = np.repeat(np.arange(n), size)
    kinds = np.bincount(of_text * _KINDS + _OF_BYTE[data], minlength=n * _KINDS).reshape(n, _KINDS)
    starts, ends, hashes, first = textvec.words(data, offsets)
    words = np.diff(first)
    length = ends - starts
    word_text = np.repeat(np.arange(n), words)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_text[1:] == word_text[:-1])
    last = _OF_BYTE[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    head = _OF_BYTE[data[starts]] if len(starts) else last
    order = np.lexsort((hashes, word_text))
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_text[order][1:] != word_text[order][:-1])
    runs = np.flatnonzero(new)
    often = np.zeros(n, dtype=np.int64)  # occurrences of a text's most frequent word
    if len(runs):
        np.maximum.at(often, word_text[order][runs], np.diff(np.append(runs, len(hashes))))
    distinct = _sums(new, first)
    shingle = [len(s) for s in textvec.shingles(hashes, first, 3)]
    some, count = np.maximum(size, 1)[:, None], np.maximum(words, 1)
    mean = _sums(length, first) / count
    square = _sums(length * length, first) / count
    kind = {k: i for i, k in enumerate(_CLASSES)}
    letters = kinds[:, kind["upper"]] + kinds[:, kind["lower"]]
    columns = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square - mean * mean, 0)), distinct / count, distinct / np.sqrt(count), often / count,
        np.array(shingle) / count, _sums(again, first) / count, kinds[:, kind["upper"]] / np.maximum(letters, 1), words / np.maximum(kinds[:, kind["line"]] + 1, 1),
        *(_sums(last == kind[k], first) / count for k in ("stop", "shout", "sign", "frame", "digit")),
        *(_sums(head == kind[k], first) / count for k in ("upper", "sign", "frame", "digit")),
        _sums(length == 1, first) / count, _sums(length > 20, first) / count,
    ]
    return np.column_stack([*columns, kinds / some]).astype(np.float64)


@dataclass(frozen=True)
class Ranker:
    """A fitted score: quantile cuts and weights of the features."""

    cuts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        steps = (x[:, :, None] > self.cuts[None]).reshape(len(x), -1)
        return np.hstack([np.clip((x - self.mean) / self.scale, -_SPREAD, _SPREAD), steps])

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``THRESHOLD`` is the chosen quantile."""
        raw = self.expand(x) @ self.weights - self.shift + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _pairs(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs of the good rows ``a`` and the bad rows ``b``, each as often as another of its label, or once more."""
    rng = np.random.default_rng(seed)
    n = PAIRS * max(len(a), len(b))
    better = np.concatenate([rng.permutation(a) for _ in range(-(-n // len(a)))])[:n]
    worse = np.concatenate([rng.permutation(b) for _ in range(-(-n // len(b)))])[:n]
    return better, worse


def _slope_and_curve(wide: np.ndarray, better: np.ndarray, worse: np.ndarray, often: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slope, curve = np.zeros(len(weights)), np.zeros((len(weights), len(weights)))
    for k in range(0, len(better), _PAIRS_AT_ONCE):  # the differences of all pairs would be several times the features
        some = slice(k, k + _PAIRS_AT_ONCE)
        gap = wide[better[some]] - wide[worse[some]]
        p = 1 / (1 + np.exp(np.clip(gap @ weights, -30, 30)))  # chance that the pair is ordered wrongly
        slope += gap.T @ (often[some] * p)
        curve += (gap * (often[some] * p * (1 - p))[:, None]).T @ gap
    return slope, curve


def _minimise(width: int, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Newton steps; ``sums`` gives slope, curve and number of the pairs at some weights."""
    weights = np.zeros(width)
    for _ in range(25):
        slope, curve, n = sums(weights)
        ridge = _RIDGE * n
        step = np.linalg.solve(curve + ridge * np.eye(width), slope - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_pairs(x: np.ndarray, good: np.ndarray, weight: np.ndarray, seed: int = 11) -> Ranker:
    """Weights from pairs (good, bad); ``weight`` is how many labelled rows each row stands for."""
    quantiles = np.quantile(x, np.arange(1, _CUTS) / _CUTS, axis=0).T
    spread = x.std(axis=0)
    ranker = Ranker(quantiles, x.mean(axis=0), np.where(spread > 0, spread, 1), np.zeros(0), 0.0)
    wide = ranker.expand(x)
    weights = np.zeros(wide.shape[1])
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return Ranker(ranker.cuts, ranker.mean, ranker.scale, weights, 0.0)
    better, worse = _pairs(a, b, seed)
    times = weight / np.where(good, weight[a].mean(), weight[b].mean())
    often = times[better] * times[worse]
    weights = _minimise(len(weights), lambda now: (*_slope_and_curve(wide, better, worse, often, now), len(better)))
    raw = wide @ weights
    order = np.argsort(raw, kind="stable")
    upto = np.cumsum(weight[order]) / weight.sum()
    k = int(np.searchsorted(upto, weight[~good].sum() / weight.sum() - 1e-12))
    shift = raw[order[min(k, len(raw) - 1)]] / 2 + raw[order[min(k + 1, len(raw) - 1)]] / 2
    return Ranker(ranker.cuts, ranker.mean, ranker.scale, weights, float(shift))


def held_out(id: Column) -> Column:  # noqa: A002
    """Rows that no fit may learn from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, text: str, id: str, label: str) -> tuple[DataFrame, DataFrame, dict[int, int]]:  # noqa: A002
    """Documents, labels of theirs that are not held out with their number, and the sums of these."""
    known = labels.select(F.col(id).alias("label_id"), F.col(label).cast("int").alias("good")).where(F.col("good").isin(0, 1) & F.col("label_id").isNotNull())
    known = known.where(~held_out(F.col("label_id"))).groupBy("label_id", "good").agg(F.count("*").alias("n"))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = stage(known.join(rows.select("doc_id").distinct(), F.col("label_id") == F.col("doc_id"), "left_semi"), "labels")
    return rows, known, {r["good"]: r["n"] for r in known.groupBy("good").agg(F.sum("n").alias("n")).collect()}


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = np.ascontiguousarray(values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _numbers(bits: np.ndarray) -> np.ndarray:
    return np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits).view(np.float64)


def reached(rows: DataFrame, targets: np.ndarray) -> np.ndarray:
    """For each feature of ``x`` (a row of targets): the smallest value up to which the rows' ``weight`` comes to the target.

    Exact: eight passes count the values by their next eight bits, where the bits before are those of a value sought.
    """
    found, below = np.zeros(targets.shape, dtype=np.uint64), np.zeros(targets.shape)
    for shift in range(56, -8, -8):
        known = [np.unique(f) for f in found]
        first = np.cumsum([0, *map(len, known)])
        bins = rows.select("x", "weight").mapInArrow(_count_bins(known, first, shift), "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(int(first[-1]) * 256)
        counts[bins.column("slot").to_numpy()] = bins.column("n").to_numpy()
        counts = counts.reshape(-1, 256)
        for f, row in enumerate(found):
            own = counts[first[f] + np.searchsorted(known[f], row)]
            upto = below[f][:, None] + np.cumsum(own, axis=1)
            byte = np.where(upto[:, -1] >= targets[f], np.argmax(upto >= targets[f][:, None], axis=1), 255)
            byte = np.clip(byte, np.argmax(own > 0, axis=1), 255 - np.argmax(own[:, ::-1] > 0, axis=1))  # sums of weights are rounded
            at = np.arange(len(row))
            below[f] = upto[at, byte] - own[at, byte]
            found[f] = (row << np.uint64(8)) | byte.astype(np.uint64)
    return _numbers(found)


def _count_bins(known: list[np.ndarray], first: np.ndarray, shift: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(int(first[-1]) * 256)
        for batch in batches:
            x, weight = _matrix(batch.column("x")), batch.column("weight").to_numpy()
            for f, prefixes in enumerate(known):
                bits = _bits(x[:, f]) >> np.uint64(shift)
                before = bits >> np.uint64(8)
                at = np.minimum(np.searchsorted(prefixes, before), len(prefixes) - 1)
                hit = prefixes[at] == before
                slots = at[hit] * 256 + (bits[hit] & np.uint64(255)).astype(np.int64)
                counts[first[f] * 256 : first[f + 1] * 256] += np.bincount(slots, weight[hit], minlength=len(prefixes) * 256)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots])], names=["slot", "n"])

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, mean and sum of squared differences from the mean, of a batch each."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            mean = x.mean(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([mean]), pa.array([((x - mean) ** 2).sum(axis=0)])], names=["n", "mean", "square"])


def _shape(rows: DataFrame, n: int) -> Ranker:
    """Quantile cuts, mean and scale of all rows, with no weights."""
    parts = rows.select("x").mapInArrow(_moments, "n long, mean array<double>, square array<double>").toArrow()  # a row per batch of rows
    count, means = parts.column("n").to_numpy().astype(np.float64)[:, None], _matrix(parts.column("mean").combine_chunks())
    mean = (count * means).sum(axis=0) / n
    spread = np.sqrt((_matrix(parts.column("square").combine_chunks()) + count * (means - mean) ** 2).sum(axis=0) / n)
    place = (n - 1) * (np.arange(1, _CUTS) / _CUTS)
    low = np.floor(place)
    found = reached(rows.select("x", F.lit(1.0).alias("weight")), np.tile(np.concatenate([low + 1, np.minimum(low + 2, n)]), (len(mean), 1)))
    a, b, part = found[:, : _CUTS - 1], found[:, _CUTS - 1 :], place - low
    cuts = np.where(part >= 0.5, b - (b - a) * (1 - part), a + (b - a) * part)  # as numpy's quantiles
    return Ranker(cuts, mean, np.where(spread > 0, spread, 1), np.zeros(mean.size * _CUTS), 0.0)


def _deal(rows: DataFrame, number: dict[int, int]) -> DataFrame:
    """Rows with the ``part`` whose rows form pairs: one for a row of the more frequent label, several for one of the other."""
    most = max(number, key=number.get)
    rarer = -(-number[1 - most] // GROUP)
    each = -(-number[most] // (rarer * GROUP))
    hashed = F.xxhash64("of", "same")
    of_rarer = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda m: m * rarer + F.pmod(hashed, F.lit(rarer)).cast("int"))
    of_most = F.array(F.pmod(hashed, F.lit(rarer * each)).cast("int"))
    return rows.withColumn("part", F.explode(F.when(F.col("good") == most, of_most).otherwise(of_rarer)))


def _pair_sums(ranker: Ranker, weights: np.ndarray, means: dict[int, float], seed: int) -> Callable:
    """Per task: the curve's rows, each with the slope's entry and the number of pairs behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, curve, n = np.zeros(len(weights)), np.zeros((len(weights), len(weights))), 0
        for group in runs(batches, ["part"]):
            group = group.combine_chunks()
            good = group.column("good").to_numpy() == 1
            a, b = np.flatnonzero(good), np.flatnonzero(~good)
            if not len(a) or not len(b):
                continue
            better, worse = _pairs(a, b, seed + group.column("part")[0].as_py())
            times = group.column("weight").to_numpy() / np.where(good, means[1], means[0])
            own = _slope_and_curve(ranker.expand(_matrix(group.column("x").combine_chunks())), better, worse, times[better] * times[worse], weights)
            slope, curve, n = slope + own[0], curve + own[1], n + len(better)
        if n:
            values = np.column_stack([curve, slope, np.full(len(weights), float(n))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights)), pa.int32()), pa.array(list(values), pa.list_(pa.float64()))], names=["i", "sums"])

    return releasing(run)


def _added(part: pa.Table) -> pa.Table:
    return pa.table({"i": part.column("i")[:1], "sums": pa.array([_matrix(part.column("sums").combine_chunks()).sum(axis=0)], pa.list_(pa.float64()))})


def _threshold(rows: DataFrame, ranker: Ranker) -> float:
    """The score halfway between the row at which the rows' weight comes to the bad rows' share and the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = ranker.expand(_matrix(batch.column("x"))) @ ranker.weights if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("of", "same", "good", "weight")), pa.array(raw)], names=["of", "same", "good", "weight", "raw"])

    scored = stage(rows.select("of", "same", "good", "weight", "x").mapInArrow(run, "of long, same long, good int, weight double, raw double"), "raw_scores")
    total, bad = scored.agg(F.sum("weight"), F.sum(F.when(F.col("good") == 0, F.col("weight")))).first()
    target = bad - 1e-12 * total
    at = float(reached(scored.select(F.array("raw").alias("x"), "weight"), np.array([[target]]))[0, 0])
    raw, weight = F.col("raw"), F.col("weight")
    before, equal, last, after = scored.agg(
        F.coalesce(F.sum(F.when(raw < at, weight)), F.lit(0.0)), F.sum(F.when(raw == at, weight)), F.max_by(weight, F.when(raw == at, F.struct("of", "same", "good"))), F.min(F.when(raw > at, raw))
    ).first()
    more = before + equal - last >= target  # of equal scores, the last in the order of the keys is not reached yet
    return at if more or after is None else at / 2 + after / 2


def fit_all(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", seed: int = 11) -> Ranker:  # noqa: A002
    """Fit on all labelled rows that are not held out."""
    rows, known, counts = _labelled(docs, labels, text, id, label)
    # features before the rows move, so no text does; a row per id and text
    texts = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.xxhash64("text").alias("same"), _features_udf()(F.col("text")).alias("x"))
    texts = texts.groupBy("doc_id", "same").agg(F.count("*").alias("copies"), F.first("x").alias("x"))
    found = texts.join(known, F.col("doc_id") == F.col("label_id"))
    found = stage(found.select(F.xxhash64("doc_id").alias("of"), "same", "good", (F.col("n") * F.col("copies")).cast("double").alias("times"), "x"), "labelled")
    sums = {r["good"]: r for r in found.groupBy("good").agg(F.count("*").alias("rows"), F.sum("times").alias("times")).collect()}
    if not sums:
        return fit_pairs(features(pa.array([""])), np.ones(1, dtype=bool), np.ones(1))
    number = {g: r["rows"] for g, r in sums.items()}
    share = {g: counts[g] / max(1.0, r["times"]) for g, r in sums.items()}
    ranker = _shape(found, sum(number.values()))
    if len(number) < 2:
        return ranker
    found = found.withColumn("weight", F.col("times") * F.when(F.col("good") == 1, share[1]).otherwise(share[0]) + 1e-9)
    means = {g: share[g] * r["times"] / r["rows"] + 1e-9 for g, r in sums.items()}
    ensure_checkpoint_dir(docs.sparkSession)
    dealt = _deal(found, number).repartition("part").sortWithinPartitions("part", "of", "same", "good").select("part", "good", "weight", "x").checkpoint()  # so each step reads it in place

    def step(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        per_task = dealt.mapInArrow(_pair_sums(ranker, weights, means, seed), "i int, sums array<double>")
        table = per_task.groupBy("i").applyInArrow(_added, "i int, sums array<double>").toArrow().sort_by("i")
        values = _matrix(table.column("sums").combine_chunks())
        return values[:, -2].copy(), values[:, :-2].copy(), float(values[0, -1])

    ranker = replace(ranker, weights=_minimise(len(ranker.weights), step))
    return replace(ranker, shift=_threshold(found, ranker))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality") -> Ranker:  # noqa: A002
    """Quick fit on a bounded sample of the labelled rows that are not held out; ``fit_all`` takes all."""
    rows, known, counts = _labelled(docs, labels, text, id, label)
    picked = [known.where(F.col("good") == g).orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE) for g in (0, 1)]
    sample = picked[0].union(picked[1])  # at most 2 * SAMPLE rows of 20 bytes
    # a row per id and text, at most TEXTS of an id; all rows of the id are shared out among them
    chosen = rows.join(F.broadcast(sample.select("label_id").distinct()), F.col("doc_id") == F.col("label_id")).drop("label_id")
    texts = chosen.groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.count("*").alias("copies"))
    total = texts.groupBy("doc_id").agg(F.sum("copies").alias("total"))
    kept = texts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("hash"))).where(F.col("place") <= TEXTS)
    held = kept.groupBy("doc_id").agg(F.sum("copies").alias("held")).join(total, "doc_id")
    kept = kept.join(held, "doc_id").select(F.col("doc_id").alias("of"), F.col("hash").alias("same"), (F.col("copies") * F.col("total") / F.col("held")).alias("copies"))
    found = chosen.join(F.broadcast(kept), (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("same")))
    found = found.groupBy("doc_id", "same", "copies").agg(F.first("text").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    table = found.select("good", F.xxhash64("doc_id").alias("of"), "same", (F.col("n") * F.col("copies")).alias("times"), _features_udf()(F.col("text")).alias("x")).toArrow()  # at most 2 * SAMPLE * TEXTS rows
    table = table.sort_by([("of", "ascending"), ("same", "ascending"), ("good", "ascending")])
    good = table.column("good").to_numpy() == 1
    times = table.column("times").to_numpy()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(good), -1) if len(good) else np.zeros((0, 0))
    if not len(good):
        x, good, times = features(pa.array([""])), np.ones(1, dtype=bool), np.ones(1)
    share = {g: counts.get(g, 0) / max(1.0, float(times[good == bool(g)].sum())) for g in (0, 1)}
    return fit_pairs(x, good, times * np.where(good, share[1], share[0]) + 1e-9)


def _features_udf() -> Callable:
    @F.arrow_udf("array<double>")
    def compute(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return compute


def score(text: Column, ranker: Ranker) -> Column:
    """Score of a text column by a fitted ranker."""

    @F.arrow_udf("double")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array(ranker.score(features(texts)))

    return compute(text.cast("string"))


def keep_good(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    return docs.where(score(F.col(text), ranker) >= THRESHOLD)
