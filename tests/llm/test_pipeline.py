"""The pipeline's stages and the queries without SQL against brute force on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__ as E
import corpus_pipeline
from tests.llm.test_table_operators import brute_mix
from tests.llm.test_text_operators import _lower, brute_components

STAGE_NAMES = ["quality", "exact_dedup", "near_dedup", "mixing", "tokens"]


@pytest.fixture(scope="module")
def exact_tokens():
    from tavola.llm.byte_bpe import read_ranks
    from tavola.llm.queries import tokenizer

    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: r for r, t in enumerate(read_ranks(path))}, special_tokens={})


def test_stages_match_brute_force(spark, small_dir, exact_tokens, tmp_path):
    from tavola.llm import quality
    from tavola.llm.queries import MIX_WEIGHTS

    assert [name for name, _ in corpus_pipeline.STAGES] == STAGE_NAMES
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = {r.doc_id: (r.text, r.lang, r.source) for r in docs.collect()}
    ranker = quality.fit(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
    want = [i for i in rows if ranker.score(quality.features(pa.array([rows[i][0]])))[0] >= quality.THRESHOLD]

    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, small_dir)
        if name != "tokens":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())

    assert kept["quality"] == sorted(want)
    last = {}
    for i in sorted(want):
        last[_lower(rows[i][0])] = i
    want = sorted(last.values())
    assert kept["exact_dedup"] == want
    want = sorted(i for i, _, c in brute_components([(i, rows[i][0]) for i in want]) if i == c)
    assert kept["near_dedup"] == want

    def domain(source):
        return "crawl" if source == "src0" else "reference" if source in {"src1", "src2", "src3", "src4", "src5"} else "community"

    weights = [lambda n, known=known, other=other: known.get(n, other) for known, other in MIX_WEIGHTS.values()]
    mixed = brute_mix([(i, *rows[i]) for i in want], lambda lang, source: (domain(source), lang, source), weights, corpus_pipeline.MIX_SHARE, 1, corpus_pipeline.MIX_SEED)
    assert kept["mixing"] == sorted(r[0] for r in mixed)
    for r in docs.collect():
        assert r.ids == exact_tokens.encode_ordinary(rows[r.doc_id][0])
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id][0].encode()).hexdigest()


def test_byte_bpe_query(spark, small_dir, exact_tokens):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = E.queries()["op6_byte_bpe"](spark, small_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = exact_tokens.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_warc_query(spark, small_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    top = defaultdict(int)
    for i, data in pages.items():
        top[data] = max(top[data], i)
    got = {r.page_id: tuple(r)[1:] for r in E.queries()["op2_warc_round_trip"](spark, small_dir).collect()}
    assert got == {
        i: (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if top[d] == i else "revisit", None if top[d] == i else top[d]) for i, d in pages.items()
    }


def test_shard_query(spark, small_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = E.queries()["op8_hypergeometric_shards"](spark, small_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(d) + 8, zlib.crc32(d)) for i, d in texts.items()}
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_quality_query(spark, small_dir):
    got = E.queries()["op5_quality_scores"](spark, small_dir).collect()
    assert len(got) == spark.read.parquet(f"{small_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


CLASH = ["row", "node", "h", "sha", "place", "took", "key", "mark", "n", "tokens", "epoch", "limit", "dropped", "row_hash", "kept", "label_id", "score"]


def test_stages_with_odd_rows_and_clashing_columns(spark, small_dir):
    """Null ids and texts, repeated rows, and columns with the names that the operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, "words of a text without id " * 9, "en", "src1", 1), (None, None, None, None, None), (None, "words of a text without id " * 9, "en", "src1", 1), (10**6, "", "de", "src2", 0)],
        docs.schema,
    )
    docs = docs.unionByName(odd).unionByName(docs.limit(5)).withColumns({c: F.lit(c) for c in CLASH})
    total = docs.count()
    for name, step in corpus_pipeline.STAGES:
        if name == "tokens":
            out = step(spark, docs, small_dir)
            assert out.count() == total and out.where("n_tokens is null").count() == 0
            continue
        out = step(spark, docs, small_dir)
        assert out.dtypes == docs.dtypes
        found = Counter(map(str, out.collect()))
        given = Counter(map(str, docs.collect()))
        assert all(found[r] <= given[r] for r in found) and sum(found.values()) > 0
        if name == "exact_dedup":
            assert len({_lower(r.text or "") for r in docs.collect()}) == sum(found.values())
        assert step(spark, docs.limit(0), small_dir).collect() == []
