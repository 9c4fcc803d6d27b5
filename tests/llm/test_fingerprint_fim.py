"""Fingerprints and the fill-in-middle transformation against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tavola.llm import fim, fingerprint

SCHEMA = "doc_id long, text string, n int, form string, output string, part int, fingerprint string, mark string"
ODD = ["", None, " ", "\n\n", "a", " a", "a ", "a b", " é ü\n\n", "\x00a\x00 b", "<P> a", "b <S>", "c<M>", "<S", "x y z", "日本 語 a\tb", "𝒳 y  z"]


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, "z", "m") for i, t in rows], SCHEMA)


def mixed_rows(seed=4, n=300):
    rng = random.Random(seed)
    rows = [(k, ODD[k % len(ODD)]) for k in range(n)]
    rows += [(n + k, "".join(rng.choices("ab<PSM>é. \n\t", k=rng.choice([3, 40, 400])))) for k in range(n)]
    return rows + [(None, "no id here"), (None, None), (7, "an id again"), (7, "an id again"), (2 * n, "long word " * 60_000)]


# --------------------------------------------------------- fill in the middle
def brute_fim(i, text, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    if h4 % 100 < spm:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 100), (100, 0), (0, 50)])
def test_fim_equals_brute_force_and_reads_back(spark, rate, spm):
    rows = mixed_rows()
    found = fim.restore(fim.fill_in_middle(table(spark, rows), rate=rate, spm=spm)).collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted((brute_fim(i, t, rate, spm) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.restored) for r in found), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_fim_of_an_empty_table(spark):
    out = fim.restore(fim.fill_in_middle(table(spark, [])))
    assert out.collect() == [] and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


def test_fim_does_not_shuffle(spark):
    plan = fim.fill_in_middle(table(spark, mixed_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# --------------------------------------------------------------- fingerprints
def order(row):
    i, t = row
    return (i is not None, i if i is not None else 0)


def check_neighbours(spark, rows):
    """Results by id where ids are unique; the order is that of ids."""
    found = {r.doc_id: r for r in fingerprint.fingerprints(table(spark, rows)).collect()}
    rows = sorted(rows, key=order)
    assert len(found) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        r = found[i]
        own, its, changed = map(fingerprint.fingerprint, (t, following, new))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, changed), fingerprint.likeness(own, its))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_neighbours_over_ranges(spark):
    rows = [(k * 3 - 50, t) for k, (_, t) in enumerate(mixed_rows(n=40)[:-5])] + [(None, "no id"), (10**12, "long. sentence " * 30_000)]
    check_neighbours(spark, rows)


@pytest.mark.parametrize("rows", [[], [(5, "alone here")], [(5, None)], [(1, "one text"), (2, "another")]])
def test_few_rows(spark, rows):
    check_neighbours(spark, rows)


def test_repeated_rows_are_dealt_to_many_ranges(spark):
    rows = [(3, "same text\nwith lines")] * 600 + [(None, "nothing known")] * 200 + [(k, f"text {k}") for k in range(100)]
    out = fingerprint.fingerprints(table(spark, rows))
    assert out.count() == 900
    same = out.where("doc_id = 3").select("fingerprint").distinct().count()
    assert same == 2  # that of the repeated row, and that of "text 3"
    assert out.where("doc_id is null and n_chars = 13").count() == 200


def test_likeness_follows_the_shared_part():
    rng = random.Random(1)
    lines = [" ".join(rng.choices("abcdefgh", k=12)) + str(k) for k in range(400)]
    whole = fingerprint.fingerprint("\n".join(lines[:200]))
    for shared in (0, 50, 100, 150, 190):
        other = fingerprint.fingerprint("\n".join(lines[200 - shared : 400 - shared]))
        assert abs(fingerprint.likeness(whole, other) - shared / 200) < 0.3
    assert fingerprint.likeness(whole, whole) == 1.0
    assert fingerprint.likeness(whole, fingerprint.fingerprint("")) == 0.0


_lines = st.lists(st.text(alphabet="abé.! ", max_size=260), max_size=8)


@settings(max_examples=60, deadline=None)
@given(_lines, _lines, st.randoms(use_true_random=False))
def test_order_insertion_and_deletion(a, b, rng):
    shuffled = a + b
    rng.shuffle(shuffled)
    one, both = fingerprint.fingerprint("\n".join(a)), fingerprint.fingerprint("\n".join(shuffled))
    assert fingerprint.insert(one, "\n".join(b)) == both
    assert fingerprint.delete(both, "\n".join(b)) == one


def test_repeats_count():
    said = {fingerprint.fingerprint("\n".join(["line"] * k)) for k in (0, 1, 2, 3, 65536, 65537)}
    assert len(said) == 6


def test_collections_and_signed_changes(spark):
    rows = [(k, f"line {k}\nshared line\nline {k % 7}") for k in range(200)] + [(None, "x"), (4, None)]
    docs = table(spark, rows)
    prints = fingerprint.text_fingerprints(docs).withColumn("bin", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)))
    found = {r.bin: r.fingerprint for r in fingerprint.add_up(prints, ["bin"]).collect()}
    for b in range(3):
        own = "\n".join(t or "" for i, t in rows if (i or 0) % 3 == b)
        assert found[b] == fingerprint.fingerprint(own)
    gone = prints.where("doc_id % 2 = 0").withColumn("sign", F.lit(-1))
    left = fingerprint.add_up(prints.withColumn("sign", F.lit(1)).unionByName(gone), ["bin"], sign="sign")
    kept = {r.bin: r.fingerprint for r in left.collect()}
    for b in range(3):
        own = "\n".join(t or "" for i, t in rows if (i or 0) % 3 == b and (i is None or i % 2))
        assert kept[b] == fingerprint.fingerprint(own)
    assert fingerprint.add_up(prints.limit(0), ["bin"]).collect() == []
