"""Features and scores of the quality classifier against a second, plain implementation, and accuracy on labels held out."""

from __future__ import annotations

import math
import random
import re
import statistics
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tavola.llm import quality

CLASSES = ["[A-Z]", "[a-z]", "[0-9]", "\x20", "\x0a", r"[.,;:?'\"\-()]", "!", r"[#$%&*@^~_+=<>/\\`]", r"[|\[\]{}]", r"[\x00-\x08\x0b-\x1f\x7f]", r"[\x09\x80-\xff]"]
UPPER, LOWER, DIGIT, _, LINE, STOP, SHOUT, SIGN, FRAME = range(9)


def kind(byte: str) -> int:
    return next(k for k, c in enumerate(CLASSES) if re.fullmatch(c, byte))


def plain_features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8").decode("latin-1")  # a character per byte
    words = re.findall(r"[^\x20\x09-\x0d]+", raw)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    n = max(len(words), 1)
    kinds = Counter(map(kind, raw))
    lengths = [len(w) for w in words]
    shingles = {tuple(low[k : k + 3]) for k in range(len(low) - 2)} if len(low) >= 3 else ({tuple(low)} if low else set())
    letters = kinds[UPPER] + kinds[LOWER]
    out = [
        math.log1p(len(raw)), math.log1p(len(words)), sum(lengths) / n, statistics.pstdev(lengths) if lengths else 0.0, len(set(low)) / n, len(set(low)) / math.sqrt(n),
        max(Counter(low).values(), default=0) / n, len(shingles) / n, sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, kinds[UPPER] / max(letters, 1),
        len(words) / max(kinds[LINE] + 1, 1),
    ]
    out += [sum(kind(w[-1]) == k for w in words) / n for k in (STOP, SHOUT, SIGN, FRAME, DIGIT)]
    out += [sum(kind(w[0]) == k for w in words) / n for k in (UPPER, SIGN, FRAME, DIGIT)]
    out += [sum(x == 1 for x in lengths) / n, sum(x > 20 for x in lengths) / n]
    return out + [kinds[k] / max(len(raw), 1) for k in range(len(CLASSES))]


def plain_score(ranker: quality.Ranker, x: list[float]) -> float:
    total = -ranker.shift + math.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
    weights = iter(ranker.weights.tolist())
    for v, m, s in zip(x, ranker.mean, ranker.scale, strict=True):
        total += min(6.0, max(-6.0, (v - m) / s)) * next(weights)
    for v, cuts in zip(x, ranker.cuts, strict=True):
        total += sum(next(weights) * (v > c) for c in cuts)
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))


def texts_of(small_dir):
    rng = random.Random(6)
    odd = [None, "", " ", "\n\n", "A b c.", "a a a A", "x!", "#1 {y} |z|", "é ü 日本", "\x00\x7f\tq", "w" * 25 + " end", "one two"]
    odd += ["".join(rng.choices("aB1 .!#{\n\té", k=rng.choice([3, 30, 300]))) for _ in range(80)]
    return odd + pq.read_table(f"{small_dir}/documents.parquet")["text"].to_pylist()[:120]


def test_features_equal_plain_ones(small_dir):
    texts = texts_of(small_dir)
    np.testing.assert_allclose(quality.features(pa.array(texts, pa.string())), [plain_features(t) for t in texts], rtol=1e-9, atol=1e-7)


def test_scores_equal_plain_ones(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    ranker = quality.fit(docs, labels)
    texts = texts_of(small_dir)
    got = ranker.score(quality.features(pa.array(texts, pa.string())))
    near_cut = 0
    for text, score, own in zip(texts, got, quality.features(pa.array(texts, pa.string())).tolist(), strict=True):
        assert score == pytest.approx(plain_score(ranker, own), abs=1e-9)
        near_cut += abs(plain_score(ranker, plain_features(text)) - score) > 1e-6  # a feature may lie on a quantile
    assert near_cut <= 2


def test_weights_come_from_pairs():
    """One feature that orders all pairs, one of noise: the score orders the rows by the first."""
    rng = np.random.default_rng(2)
    good = np.arange(400) % 2 == 0
    x = np.column_stack([np.where(good, 1.0, -1.0) + 0.1 * rng.normal(size=400), rng.normal(size=400)])
    score = quality.fit_pairs(x, good, np.ones(400)).score(x)
    assert score[good].min() > quality.THRESHOLD > score[~good].max()


def test_accuracy_on_labels_held_out(spark):
    folder = "/root/testdata/sf0.01"
    from tavola.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op5_quality_scores"](spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["quality"] is not None and r["doc_id"] in got]
    assert len(held) > 50 and all(got[r["doc_id"]].held_out for r in held)
    right = sum(got[r["doc_id"]].predicted == r["quality"] for r in held)
    assert right >= 0.97 * len(held)


def test_the_fit_holds_the_differences_of_some_pairs_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 33))
    good = x[:, 0] + rng.normal(size=4000) > 0
    tracemalloc.start()
    quality.fit_pairs(x, good, np.ones(4000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 4000 * 33 * 12 * 8  # the expanded features, once and as parts of themselves


def labelled_rows(folder):
    """(text, good) of the labelled documents that are not held out."""
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = {(r["doc_id"], r["quality"]) for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["quality"] is not None}
    return [(texts[i], good) for i, good in sorted(labels) if i in texts and zlib.crc32(str(i).encode()) % 4 != 2]


def test_the_query_learns_from_all_labelled_rows(spark, small_dir, monkeypatch):
    """Cuts, means and threshold are those of every labelled row, whatever a sample would hold and however the rows are dealt."""
    from tavola.llm.queries import QUERIES

    seen, score = [], quality.score
    monkeypatch.setattr(quality, "SAMPLE", 1)
    monkeypatch.setattr(quality, "GROUP", 5, raising=False)
    monkeypatch.setattr(quality, "score", lambda text, ranker: seen.append(ranker) or score(text, ranker))
    QUERIES["op5_quality_scores"](spark, small_dir).count()
    (ranker,), rows = seen, labelled_rows(small_dir)
    x, bad = quality.features(pa.array([t for t, _ in rows], pa.string())), sum(not good for _, good in rows)
    assert len(rows) > 50 and bad > 5
    np.testing.assert_array_equal(ranker.cuts, np.quantile(x, np.arange(1, 12) / 12, axis=0).T)
    np.testing.assert_allclose(ranker.mean, x.mean(axis=0), rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(ranker.scale, np.where(x.std(axis=0) > 0, x.std(axis=0), 1), rtol=1e-9, atol=1e-12)
    got = ranker.score(x)
    assert (got < quality.THRESHOLD - 1e-9).sum() <= bad <= (got < quality.THRESHOLD + 1e-9).sum()
    assert np.mean([(s >= quality.THRESHOLD) == good for s, (_, good) in zip(got, rows, strict=True)]) > 0.95


def test_whole_fit_equals_the_quick_one_where_that_holds_all(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("one two Three! #4 |five| six".split(), k=rng.randint(0, 30)))) for i in range(60)] + [(None, "no id"), (7, None), (7, "again"), (9, "")]
    labels = [(i, int(rng.random() < 0.7)) for i in range(70)] + [(3, 1), (3, 0), (3, 0), (5, None), (None, 1)]
    docs, labels = spark.createDataFrame(docs + docs[:9], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    some, every = quality.fit(docs, labels), quality.fit_all(docs, labels)
    for field in ("cuts", "mean", "scale", "weights", "shift"):
        np.testing.assert_allclose(getattr(every, field), getattr(some, field), rtol=1e-8, atol=1e-9)


@pytest.mark.parametrize("number", [{0: 3, 1: 200}, {0: 90, 1: 40}])
def test_every_row_is_dealt_to_rows_of_the_other_label(spark, monkeypatch, number):
    monkeypatch.setattr(quality, "GROUP", 20)
    rows = spark.createDataFrame([(g, k, g) for g, n in number.items() for k in range(n)], "of long, same long, good int")
    dealt = [tuple(r) for r in quality._deal(rows, number).select("good", "same", "part").collect()]
    most = max(number, key=number.get)
    times = Counter(r[:2] for r in dealt)
    assert len(times) == sum(number.values()) and {n for (g, _), n in times.items() if g == most} == {1}
    labels = {p: {g for g, _, part in dealt if part == p} for *_, p in dealt}
    assert all(most not in found or len(found) == 2 for found in labels.values())
    assert len(labels) > 1 and max(Counter((g, p) for g, _, p in dealt).values()) <= 40


def test_values_reached_by_weight(spark):
    rng = np.random.default_rng(8)
    x, weight = np.column_stack([rng.normal(size=300), rng.integers(-3, 3, 300) * 1.0]), rng.integers(1, 4, 300) * 1.0
    rows = spark.createDataFrame([(a.tolist(), float(w)) for a, w in zip(x, weight, strict=True)], "x array<double>, weight double").repartition(5)
    targets = np.array([[1.0, 77.0, weight.sum()]] * 2)
    want = [[min(v for v in c if weight[c <= v].sum() >= t) for t in row] for c, row in zip(x.T, targets, strict=True)]
    assert quality.reached(rows, targets).tolist() == want
