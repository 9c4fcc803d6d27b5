"""Operators on texts against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{k}" for k in range(4000)]
SCHEMA = "doc_id long, text string, node string, n int, row string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed=3, families=6, copies=14, changes=3):
    rng = random.Random(seed)
    rows = []
    passage = " ".join(rng.choices(WORDS, k=60))
    for _ in range(families):
        base = rng.choices(WORDS, k=rng.choice([5, 7, 30, 120, 121]))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(changes + 1)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(" ".join(w))
    rows += [passage + " " + " ".join(rng.choices(WORDS, k=rng.choice([3, 8, 15]))) for _ in range(25)]
    rows += ["", " \t\n", "one two", "ONE  two", "one two three", "Été été a b c d", "été été a b c d", None, None]
    rows += [rows[0], rows[0].upper(), " ".join(WORDS * 4)]
    return [(k * 3 + 1, t) for k, t in enumerate(rows)] + [(None, rows[0]), (None, "alone in this table of texts"), (1, rows[0])]


def test_ngram_join_matches_brute_force(spark):
    from tavola.llm.ngram_join import near_duplicates

    rows = corpus()
    got = near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute_components(rows), key=str)
    kept = [r for r in got if r.kept and r.n_shingles]
    assert len({r.component_id for r in kept}) == len({r.component_id for r in got if r.n_shingles})


def test_ngram_join_cuts_large_tiles_into_bands_and_blocks(spark, monkeypatch):
    from tavola.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "PART", 3)
    rows = corpus(seed=5, families=3, copies=40, changes=6)
    got = ngram_join.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute_components(rows), key=str)


def test_ngram_join_moves_a_set_once_for_many_tiles(spark, monkeypatch):
    """Texts that share many shingles without links: rows that get a bitmap are a few a text, not one a shared shingle."""
    from tavola.llm import ngram_join

    rng = random.Random(11)
    rows = []
    for _ in range(5):
        passage = rng.choices(WORDS, k=400)
        for k in range(8):  # a shingle of 10 texts would count as frequent
            kept = [w if rng.random() > 0.02 else rng.choice(WORDS) for w in passage]
            rows.append(kept + rng.choices(WORDS, k=60 + 10 * k))
        rows.append(rows[-1][:-9])
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    dealt, bands = [], ngram_join._bands

    def counted(held, percent):
        out = bands(held, percent)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_bands", counted)
    got = ngram_join.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    assert 0 < dealt[0] <= 4 * len(rows)


def test_ngram_join_of_nothing(spark):
    from tavola.llm.ngram_join import near_duplicates

    assert near_duplicates(table(spark, [])).collect() == []
    got = near_duplicates(table(spark, [(1, None), (2, "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_near_copies_without_id_leave_one(spark):
    import corpus_pipeline
    from tavola.llm.ngram_join import near_duplicates

    a, b = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    rows = [(None, a), (None, a + " more"), (None, a.replace(" ", "  ")), (None, "no other text is like this one"), (None, ""), (None, None)]
    rows += [(5, b), (None, b + " more"), (5, "the id of this text is that of another one"), (5, "the id  of this text is that of another one")]
    got = near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    left = [(r.doc_id, " ".join(words(r.text))) for r in corpus_pipeline.without_near_copies(spark, table(spark, rows), "").collect()]
    assert len(left) == 6 and len([t for i, t in left if i is None and t.startswith(a)]) == 1
    assert {(i, t) for i, t in left if not t.startswith(a)} == {(None, rows[3][1]), (None, ""), (5, b), (5, rows[8][1])}


DEDUP = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (9, "same text"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "same text"), (None, "lone"), (7, "x" * 300_000), (8, "X" * 300_000), (10, "one")]


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_matches_brute_force(spark):
    from tavola.llm.exact_dedup import drop_duplicates, mark_duplicates

    groups = {}
    for i, t in DEDUP:
        groups.setdefault(_lower(t), []).append(i)
    got = mark_duplicates(table(spark, DEDUP)).collect()
    want = sorted((str(i), str(max((x for x in groups[_lower(t)] if x is not None), default=None)), len(groups[_lower(t)]), hashlib.sha256(_lower(t).encode()).hexdigest()) for i, t in DEDUP)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    left = drop_duplicates(table(spark, DEDUP)).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "node", "n", "row"}
    assert sorted((str(r.doc_id), _lower(r.text)) for r in left) == sorted((str(max((x for x in ids if x is not None), default=None)), t) for t, ids in groups.items())
    assert mark_duplicates(table(spark, [])).collect() == [] and drop_duplicates(table(spark, [])).collect() == []


def test_bloom_filter_lets_unique_rows_pass(spark):
    from tavola.llm.exact_dedup import filter_bits, maybe_in, position_filter

    rows = spark.range(5000).selectExpr("id", "xxhash64(id % 4900) AS h")
    bits = filter_bits(5000)
    found = maybe_in(rows, position_filter(rows, bits), bits).where("maybe")
    ids = {r.id for r in found.collect()}
    assert ids >= set(range(100)) | set(range(4900, 5000))  # every repeated one
    assert len(ids) < 800  # few others


def test_quality_learns_from_pairs_and_holds_out(spark):
    from tavola.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ranker = quality.fit(docs, labels)
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held"), quality.score(F.col("text"), ranker).alias("score")).join(labels, "doc_id").where("held").collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in scored)
    assert len(scored) > 50 and right / len(scored) >= 0.95
    wrongly = [r for r in scored if r.quality == 1 and r.score < quality.THRESHOLD]
    assert len(wrongly) <= 0.03 * len(scored)


def test_quality_fit_collects_a_bounded_sample_of_labelled_documents(spark, monkeypatch):
    from tavola.llm import quality

    monkeypatch.setattr(quality, "SAMPLE", 8)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:260]
    docs = [(i, f"text number {i} " + ("ok. " if i % 2 else "BAD!! ") * (i % 7 + 1)) for i in ids[:20]]
    docs += [(ids[0], f"many texts of one id {k}") for k in range(300)] + [(ids[1], "one text of one id")] * 300
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")  # 20 of 260 have a document
    seen = []
    monkeypatch.setattr(quality, "fit_pairs", lambda x, good, weight: seen.append((good, weight)))
    quality.fit(table(spark, docs), labels)
    good, weight = seen[0]
    assert 8 <= good.sum() <= 8 * quality.TEXTS and 8 <= (~good).sum() <= 8 * quality.TEXTS
    assert len(good) < 2 * 8 + 2 * quality.TEXTS  # only two ids have more than one text
    assert abs(weight[good].sum() - sum(i % 2 for i in ids[:20])) < 1e-6


def test_quality_edge_cases(spark):
    from tavola.llm import quality

    rows = [(1, None), (2, ""), (3, "A fine text."), (3, "A fine text."), (4, "x " * 200_000), (None, "no id")]
    labels = spark.createDataFrame([(3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    ranker = quality.fit(table(spark, rows), labels)  # one kind of label only
    got = table(spark, rows).select("doc_id", quality.score(F.col("text"), ranker).alias("s")).collect()
    assert len(got) == 6 and all(abs(r.s - quality.THRESHOLD) < 1e-9 for r in got)
    assert quality.keep_good(table(spark, rows), ranker).count() in (0, 6)
    assert quality.keep_good(table(spark, []), ranker).count() == 0


def test_quality_pairs_rank_a_separable_feature():
    import numpy as np

    from tavola.llm.quality import THRESHOLD, fit_pairs

    rng = np.random.default_rng(0)
    good = np.arange(400) < 300
    x = rng.normal(size=(400, 4))
    x[good, 2] += 4
    ranker = fit_pairs(x, good, np.ones(400))
    said = ranker.score(x) >= THRESHOLD
    assert (said == good).mean() > 0.96


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


BPE = [None, "", "Hello, world!  it's   42\n\n\tx", "thththndthnd" * 900, "Été naïve 你好 \U0001f600\U0001f600 é", "<|endoftext|>", "a\x1cb\x85c d", "\r\n  x", "  lead", "trail  ", "1234567890" * 50, "\x00\x01"]


def test_byte_bpe_equals_tiktoken(spark, tokenizer):
    import tiktoken

    from tavola.llm import byte_bpe

    tokens = byte_bpe.read_ranks(tokenizer[0])
    exact = tiktoken.Encoding("own", pat_str=tokenizer[1], mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})
    sample = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = list(enumerate(BPE + sample))
    docs = table(spark, rows)
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, *tokenizer, with_ids=True).collect()}
    for k, text in rows:
        want = exact.encode_ordinary(text or "")
        assert got[k].ids == want, text
        assert got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = byte_bpe.encode(docs, *tokenizer)
    back = {r.doc_id: bytes(r.data) for r in byte_bpe.decode(encoded, *tokenizer).collect()}
    assert back == {k: (t or "").encode() for k, t in rows}
    assert byte_bpe.round_trip(table(spark, []), *tokenizer).collect() == []


def test_perfect_hash_is_minimal():
    from tavola.llm.byte_bpe import PerfectHash, Recent

    keys = [str(k).encode() for k in range(5000)]
    found = PerfectHash(keys)
    assert [found[k] for k in keys] == list(range(5000)) and sorted(found.at) == list(range(5000))
    recent, asked = Recent(lambda s: (len(s),), most=800), 0
    for _ in range(3):
        for k in range(1, 30):
            recent = recent.next()
            assert recent["x" * k] == (k,)
            asked += 1
            assert len(recent) + len(recent.older) <= 8 and not getattr(recent.older, "older", None)
    recent["y" * 1000]
    assert "y" * 1000 not in recent  # long ones are not remembered


def test_more_memory_of_pretokens_means_fewer_merges(spark, tokenizer):
    from tavola.llm import byte_bpe

    tokens = byte_bpe.read_ranks(tokenizer[0])
    whole = byte_bpe.PerfectHash(tokens)
    text, asked = " ".join(f"w{k % 4000:05d}x" for k in range(12_000)), []
    for remembered in (1 << 14, 1 << 20, 1 << 24):
        codec, n = byte_bpe.Codec(tokens, tokenizer[1], whole, remembered), []
        compute = codec.packed_ids
        codec.recent.compute = lambda piece, n=n, compute=compute: n.append(piece) or compute(piece)
        ids = [codec.encode(text[k : k + 1600]) for k in range(0, len(text), 1600)]
        assert b"".join(map(codec.decode, ids)).decode() == text
        asked.append(len(n))
    assert asked[0] > 2 * asked[1] >= asked[1] >= asked[2] == asked[1]  # 1 MB holds some 4,000 words and their ids
    docs = table(spark, list(enumerate([*BPE, text])))
    few, many = (sorted(map(tuple, byte_bpe.round_trip(docs, *tokenizer, remembered=n).collect())) for n in (1000, 1 << 24))
    assert few == many


SECRETS = [
    (1, None), (2, ""), (3, "password = 'hunter22' and Token:abcdef"), (4, "token=abc token=token:abcdefgh"), (5, "AKIA" + "A" * 16 + " AKIAxx " + "0123456789abcdef" * 2),
    (6, "é\U0001f600 api_key=\"zzzzzz\" secret: ======x"), (7, "deadbeef" * 2 + "x" + "cafe" * 6), (8, "-----BEGIN RSA PRIVATE KEY-----"), (9, "ghp_" + "a1B2" * 9),
    (None, "passwd:abcdefg"), (3, "nothing here"), (10, "words " * 60_000 + "secret=abcdef0"), (11, "PASSWORD=qwerty1 apikey:123456"),
]


def brute_spans(text):
    from tavola.llm.secret_scan import BASE, MORE

    out = []
    for k, rule in enumerate(BASE + MORE):
        pattern = r"[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, rule.kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_secret_scan_matches_plain_regular_expressions(spark):
    from tavola.llm.secret_scan import digest, scan

    got = scan(table(spark, SECRETS)).select("doc_id", digest(F.col("spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == sorted((str(i), brute_spans(t)) for i, t in SECRETS)
    assert scan(table(spark, [])).collect() == []


def test_very_many_matches_in_one_text(spark):
    """The cost of a text grows hardly faster than its matches: appending spans one by one would take minutes here."""
    from tavola.llm.secret_scan import scan

    text = "secret=abcdef0 x " * 60_000
    got = scan(table(spark, [(1, text)])).first().spans
    assert len(got) == 60_000
    assert [(s.start, s.end) for s in got[:2] + got[-1:]] == [(0, 14), (17, 31), (17 * 59_999, 17 * 59_999 + 14)]


def test_trigram_queries():
    from tavola.llm.secret_scan import BASE, trigram_query

    of = {r.kind: trigram_query(r.pattern) for r in BASE}
    assert of["hex"] is None
    assert of["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in of["assign"] and frozenset({"api", "key"}) in of["assign"]
    assert trigram_query(r"ab(cd|ef)+gh") == sorted([frozenset({"abc", "bcd"}), frozenset({"abe", "bef"})], key=sorted)


def test_features_of_texts():
    from tavola.llm.quality import features

    x = features(pa.array([None, "", "A b c.", "x" * 3_000_000, "éé"]))
    assert x.shape[0] == 5 and (x == x).all()
    assert (x[0] == x[1]).all()
