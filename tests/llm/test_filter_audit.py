"""The filter interaction audit and its tries against brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tavola.llm import filter_audit
from tavola.llm.filter_audit import FILTERS, Trie

SCHEMA = "doc_id long, text string, lang string, failed int, part string, task int, terminal int, least long, copy string, prefix string"
LABELS = "doc_id long, quality int, toxic int, part string, n long"


def table(spark, rows):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, lang, 9, "p", 1, 1, 1, "c", "q") for i, t, lang in rows], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, x, "p", 5) for i, q, x in rows], LABELS)


def failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    bits = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return sum(1 << FILTERS.index(k) for k, v in bits.items() if v)


def brute_rows(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang in rows:
        low = least.get(t or "")
        copy = low is not None and (i is None or low < i)
        out.append((i, lang or "", failed(t or "") | copy << 4))
    return out


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = brute_rows(rows)
    out, shapley = [], Counter()
    for part in {p for _, p, _ in docs}:
        for order in map("".join, itertools.permutations(FILTERS)):
            for step in range(1, 6):
                bit, before = 1 << FILTERS.index(order[step - 1]), sum(1 << FILTERS.index(x) for x in order[: step - 1])
                own = [(i, m) for i, p, m in docs if p == part]
                removed = [i for i, m in own if m & bit and not m & before]
                shapley[part, order[step - 1]] += len(removed)
                out.append([
                    part, order, step, sum(not m & (bit | before) for _, m in own), len(removed), sum(bool(m & bit and m & before) for _, m in own),
                    sum(m == bit for _, m in own), sum(i in good for i in removed), sum(i in toxic for i in removed),
                ])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def corpus(seed=2, n=260):
    rng = random.Random(seed)
    texts = ["", None, " ", "a", "ab", "abc", "ABC é", "costs 5$", "ein|Text"]
    for _ in range(40):
        words = rng.choices([f"w{k}" for k in range(rng.choice([3, 900]))], k=rng.choice([5, 199, 200, 260]))
        texts.append(rng.choice(["", "Preamble that many texts share. " * 9, "LOUD "]) + " ".join(words) + rng.choice(["", "", " 100%"]))
    rows = [(rng.choice([k, k, k, None]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(n)]
    labels = [(rng.choice([k, k, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in rng.sample(range(n + 20), n // 2)]
    return rows + [(8, "abc", "en"), (8, "abc", "en"), (8, "other", "de")], labels + [(8, 1, 0), (8, 0, 1)]


@pytest.fixture
def small_tries(monkeypatch):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 1500)
    monkeypatch.setattr(filter_audit, "TRIE_ROWS", 9)
    monkeypatch.setattr(filter_audit, "_MEMBERS", 3)


def test_audit_equals_brute_force(spark):
    rows, labels = corpus()
    out = filter_audit.interactions(filter_audit.failed_filters(table(spark, rows)), labels_of(spark, labels))
    assert sorted(map(tuple, out.collect())) == brute_audit(rows, labels)


def test_failures_of_each_document(spark):
    rows, _ = corpus(seed=5)
    found = filter_audit.failed_filters(table(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_rows(rows), key=repr)


def test_a_text_of_a_third_of_all_rows(spark):
    rows = [(k, "hot text", "en") for k in range(900, 0, -1)] + [(k, f"text number {k % 1500}", "en") for k in range(1000, 2800)]
    found = filter_audit.failed_filters(table(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, found)) == sorted(brute_rows(rows))


def test_few_rows(spark):
    labels = labels_of(spark, [])
    assert filter_audit.interactions(filter_audit.failed_filters(table(spark, [])), labels).collect() == []
    for rows in ([(None, None, None)], [(1, "x", "en"), (1, "x", "en")], [(None, "x", "a"), (None, "x", "a"), (3, "x", "b")]):
        out = filter_audit.interactions(filter_audit.failed_filters(table(spark, rows)), labels)
        assert sorted(map(tuple, out.collect())) == brute_audit(rows, [])


def test_long_prefixes_are_split(spark):
    rows = [(k, "the same long beginning of all texts " * 20 + str(k), "en") for k in range(300)]
    texts = table(spark, rows)
    prefixes = texts.select(filter_audit.adaptive_prefix(texts, 4).alias("prefix")).distinct().count()
    assert prefixes > 16
    same = table(spark, [(k, "one text only, long enough", "en") for k in range(300)])
    assert same.select(filter_audit.adaptive_prefix(same, 4).alias("prefix")).first()["prefix"] == "one "


_texts = st.lists(st.binary(max_size=6) | st.text(alphabet="ab", max_size=9).map(str.encode), max_size=40)


@settings(max_examples=200, deadline=None)
@given(_texts)
def test_trie_holds_least_ids(texts):
    trie, want = Trie(), {}
    for k, t in enumerate(reversed(texts)):
        trie.add(t, 100 - k, k)
        want.setdefault(t, []).append(k)
    found = {path: (node.least, node.members) for path, node in trie.traverse(trie.root)}
    assert found == {t: (100 - ks[-1], ks) for t, ks in want.items()}


@settings(max_examples=200, deadline=None)
@given(_texts, st.integers(1, 400))
def test_sorted_walk_drops_only_finished_subtrees(texts, most):
    """As the second pass does it: every member is given once, with the least key of its text."""
    rows = sorted((t, k) for k, t in enumerate(texts))
    trie, found = Trie(), []

    def held(nodes):
        return [(node.least, k) for node in nodes for k in node.members]

    for t, k in rows:
        trie.add(t, k, k)
        if trie.bytes >= most:
            found += held(trie.finished())
    found += held(n for _, n in trie.traverse(trie.root))
    assert sorted(found, key=lambda x: x[1]) == [(texts.index(t), k) for k, t in enumerate(texts)]


def test_small_tries_in_both_passes(spark, small_tries):
    import pyarrow as pa

    rows, _ = corpus(seed=11, n=120)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _, _ in rows], pa.int64()), "part": pa.array([p or "" for _, _, p in rows]), "text": pa.array([t for _, t, _ in rows])})

    class Task:
        @staticmethod
        def partitionId():  # noqa: N802
            return 3

    import pyspark

    old, pyspark.TaskContext.get = pyspark.TaskContext.get, classmethod(lambda cls: Task())
    try:
        out = [r for b in filter_audit._first_pass(batch.slice(k, 7) for k in range(0, len(rows), 7)) for r in b.to_pylist()]
    finally:
        pyspark.TaskContext.get = old
    ends = sorted((r for r in out if r["text"] is not None), key=lambda r: (r["text"].encode(), r["least"] is None, r["least"] or 0))
    assert len({r["terminal"] for r in ends}) == len(ends) > len({r["text"] for r in ends})
    sorted_batch = pa.RecordBatch.from_pylist(ends, schema=pa.schema([("least", pa.int64()), ("task", pa.int32()), ("terminal", pa.int64()), ("text", pa.string())]))
    beaten = {r["terminal"] for b in filter_audit._second_pass(iter([sorted_batch])) for r in b.to_pylist()}
    found = [(r["doc_id"], r["part"], r["failed"] | (r["copy"] or r["terminal"] in beaten) << 4) for r in out if r["failed"] is not None]
    assert sorted(found, key=repr) == sorted(brute_rows(rows), key=repr)
