"""The operators of this subpackage applied to the tables of a folder, and their SQL.

Each ``opN_<name>`` reads its whole table and returns its whole result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Lower-casing of A-Z only, in DuckDB.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and component of every document."""
    from tavola.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op3_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(reach.y) AS component_id
FROM sets JOIN reach ON reach.x = sets.doc_id GROUP BY sets.doc_id, s
"""


def _domain(source: str) -> str:
    """SQL of the domain that a source belongs to (production parameter of the mixture)."""
    return f"CASE WHEN {source} = 'src0' THEN 'crawl' WHEN {source} IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN 'reference' ELSE 'community' END"


#: Weights by node name; names not listed weigh the last number.
MIX_WEIGHTS = {
    "domain": ({"crawl": 3, "reference": 5}, 2),
    "language": ({"en": 4, "de": 3}, 2),
    "origin": ({"src3": 3, "src7": 2}, 1),
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 7


def mix_parameters() -> tuple[dict, list]:
    """Levels and weights of the production mixture."""
    from pyspark.sql import functions as F

    levels = {"domain": F.expr(_domain("source")), "language": F.col("lang"), "origin": F.col("source")}
    weights = []
    for name, (known, other) in MIX_WEIGHTS.items():
        weight = F.lit(other)
        for node, w in known.items():
            weight = F.when(F.col(name) == node, w).otherwise(weight)
        weights.append(weight)
    return levels, weights


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for the production mixture, one row per epoch."""
    from tavola.llm.mixing import mix

    levels, weights = mix_parameters()
    return mix(table(spark, sf_dir, "documents"), levels, weights, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def _mix_oracle() -> str:
    levels = list(MIX_WEIGHTS)

    def weight(name: str) -> str:
        known, other = MIX_WEIGHTS[name]
        return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in known.items()) + f" ELSE {other} END"

    steps = []
    for depth, name in enumerate(levels):
        path, up = levels[: depth + 1], levels[:depth]
        cols, above = ", ".join(path), ", ".join(up) or "1"
        given = f"JOIN b{depth - 1} USING ({', '.join(up)})" if up else "CROSS JOIN (SELECT CAST(least(sum(cap), floor(sum(tokens) * CAST(" + str(MIX_SHARE) + " AS DOUBLE))) AS HUGEINT) AS budget FROM leaf)"
        need = f"PARTITION BY {above} ORDER BY n.cap / n.weight NULLS FIRST, {name}"
        steps.append(f"""
n{depth} AS (SELECT {cols}, CAST(sum(cap) AS HUGEINT) AS cap, max({weight(name)}) AS weight FROM leaf GROUP BY {cols}),
f{depth} AS (
  SELECT {cols}, n.cap, n.weight, budget AS given,
    n.cap * CAST(sum(n.weight) OVER ({need} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT)
      <= n.weight * (budget - (CAST(sum(n.cap) OVER ({need} ROWS UNBOUNDED PRECEDING) AS HUGEINT) - n.cap)) AS fits,
    n.cap / n.weight AS need
  FROM n{depth} n {given}),
g{depth} AS (SELECT *, bool_and(fits) OVER (PARTITION BY {above} ORDER BY need NULLS FIRST, {name} ROWS UNBOUNDED PRECEDING) AS filled FROM f{depth}),
h{depth} AS (
  SELECT {cols}, cap, filled, CASE WHEN filled THEN 0 ELSE weight END AS w,
    given - CAST(sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY {above}) AS HUGEINT) AS rest FROM g{depth}),
i{depth} AS (SELECT *, CAST(sum(w) OVER (PARTITION BY {above} ORDER BY {name} ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS upto, CAST(sum(w) OVER (PARTITION BY {above}) AS HUGEINT) AS total FROM h{depth}),
b{depth} AS (SELECT {cols}, CASE WHEN filled THEN cap WHEN total > 0 THEN (upto * rest) // total - ((upto - w) * rest) // total ELSE 0 END AS budget FROM i{depth})""")
    cols, last = ", ".join(levels), len(levels) - 1
    return f"""
WITH unit AS (
  SELECT doc_id, {_domain('source')} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT {cols}, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {MIX_EPOCHS} AS HUGEINT) AS cap FROM unit GROUP BY {cols}),
{','.join(steps)},
plan AS (
  SELECT leaf.{', leaf.'.join(levels)}, CASE WHEN tokens > 0 THEN CAST(budget // tokens AS BIGINT) ELSE 0 END AS epochs,
    budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
  FROM leaf JOIN b{last} USING ({cols})),
placed AS (
  SELECT unit.*, epochs, rest, sum(tokens) OVER (PARTITION BY {cols} ORDER BY md5('{MIX_SEED}:' || epochs || ':' || doc_id)) AS upto
  FROM unit JOIN plan USING ({cols})),
times AS (SELECT *, epochs + CASE WHEN rest > 0 AND (upto - tokens < rest) THEN 1 ELSE 0 END AS n FROM placed)
SELECT doc_id, {cols}, tokens, unnest(range(CAST(n AS BIGINT))) AS epoch FROM times
"""


ORACLES["op1_mix_sources"] = _mix_oracle()


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of whole texts: which row stays, and the size of the group."""
    from tavola.llm.exact_dedup import mark_duplicates

    return mark_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER.format('text')}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; labelled outcomes are the labels of the documents with the pages' ids."""
    from pyspark.sql import functions as F

    from tavola.llm.url_filter import judge_urls

    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("outcome_id"), bad.alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def _url_oracle() -> str:
    fits = [(rule, said, f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')") for said, rule in sorted(URL_RULES, key=lambda r: -len(r[1]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for r, _, f in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{s}'" for _, s, f in fits) + " ELSE CASE WHEN bound > 0.3 THEN 'block' ELSE 'allow' END END"
    two = "'co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br'"

    def level(name: str, source: str) -> str:
        return f"""
{name}_s AS (
  SELECT (1 - rho) / rho AS s FROM (
    SELECT greatest(0.001, least(0.5, coalesce(CASE WHEN sum(n * (n - 1)) > 0 THEN
      (sum((bad - n * above) ** 2 / (above * (1 - above))) - sum(n)) / sum(n * (n - 1)) END, 0.5)))::DOUBLE AS rho FROM {source})),
{name} AS (SELECT g.*, s, (bad + s * above) / (n + s) AS mean FROM {source} g CROSS JOIN {name}_s)"""

    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic = 1 GROUP BY doc_id),
h0 AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad FROM u LEFT JOIN o ON o.doc_id = u.page_id GROUP BY host),
h1 AS (SELECT *, string_split(bare, '.') AS l FROM h0),
h2 AS (SELECT *, array_to_string(l[-2:], '.') AS two FROM h1),
h3 AS (SELECT host, n, bad, CASE WHEN two IN ({two}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN two IN ({two}) THEN two ELSE l[-1] END AS suffix FROM h2),
sg AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h3) AS above FROM h3 GROUP BY suffix),
{level('sl', 'sg')},
dg AS (SELECT h3.suffix, domain, sum(h3.n) AS n, sum(h3.bad) AS bad, any_value(sl.mean) AS above FROM h3 JOIN sl ON sl.suffix = h3.suffix GROUP BY h3.suffix, domain),
{level('dl', 'dg')},
hg AS (SELECT host, h3.n, h3.bad, dl.mean AS above FROM h3 JOIN dl ON dl.suffix = h3.suffix AND dl.domain = h3.domain),
{level('hl', 'hg')},
ab AS (SELECT host, bad + s * above AS a, n - bad + s * (1 - above) AS b FROM hl),
r AS (SELECT host, a / (a + b) - sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM ab)
SELECT page_id, host, path, {rule} AS rule, {said} AS verdict, round(bound, 6) AS bad_bound FROM u JOIN r USING (host)
"""


ORACLES["op7_url_filter"] = _url_oracle()


def _of_kind(kind: str) -> Callable:
    return lambda s: s["kind"] == kind


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, and the digest of those of the fixed rules."""
    from pyspark.sql import functions as F

    from tavola.llm.secret_scan import BASE, digest, scan

    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def _secret_oracle() -> str:
    from tavola.llm.secret_scan import BASE, MORE

    parts, kinds = [], []
    for k, rule in enumerate(BASE + MORE):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
m{k} AS (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM d),
i{k} AS (SELECT doc_id, p, m, g, unnest(range(1, len(m) + 1)) AS i FROM m{k} WHERE len(m) > 0),
s{k} AS (
  SELECT doc_id, {k} AS rank, '{rule.kind}' AS kind, CAST(list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS a, length(m[i]) AS n
  FROM i{k} WHERE length(g[i]) >= {rule.least})""")
        kinds.append(f"SELECT * FROM s{k}")
    n = len(BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    said = "kind || ':' || a || ':' || (a + n)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {','.join(parts)},
every AS ({' UNION ALL '.join(kinds)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({said}, ',' ORDER BY a, rank) FILTER (rank < {n}), '')) AS base_sha256,
  coalesce(string_agg({said}, ',' ORDER BY a, rank) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN every ON every.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLES["op10_secret_scan"] = _secret_oracle()


@query
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive and read back."""
    from tavola.llm.warc import round_trip

    back = round_trip(spark, table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    from pyspark.sql import functions as F

    from tavola.llm.quality import THRESHOLD, fit_all, held_out, score

    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), fit_all(docs, table(spark, sf_dir, "labels"))).alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    from tavola.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), *tokenizer(), remembered=32 << 20)  # no other stage's memory stands beside it


@query
def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt uniformly to 24 shards of equal row counts."""
    from pyspark.sql import functions as F

    from tavola.llm.sharding import shuffle_to_shards

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32"))
    return shuffle_to_shards(docs, 24, seed=8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth vector."""
    from pyspark.sql import functions as F

    from tavola.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every order of them, by language."""
    from tavola.llm.filter_audit import failed_filters, interactions

    return interactions(failed_filters(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_interactions"] = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(coalesce(doc_id > min(doc_id) OVER g, min(doc_id) OVER g IS NOT NULL), FALSE) AS e
  FROM d WINDOW g AS (PARTITION BY t)),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
    coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letter p, letter q, letter r, letter s, letter t
  WHERE p.x <> q.x AND p.x <> r.x AND p.x <> s.x AND p.x <> t.x AND q.x <> r.x AND q.x <> s.x AND q.x <> t.x AND r.x <> s.x AND r.x <> t.x AND s.x <> t.x),
place AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k:k] AS x, filter_order[1:k - 1] AS earlier FROM orders, range(1, 6) AS r(k)),
j AS (
  SELECT part, filter_order, step, x, fails, n, good, toxic, contains(fails, x) AS hit, earlier <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone FROM m, place),
z AS (
  SELECT part, filter_order, step, x, CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = x THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM j GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM z
"""


@query
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness and that of the next document."""
    from tavola.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


FIM_SEED, FIM_RATE, FIM_SPM = 42, 50, 80


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and cuts of every document, with the digests of the output and of the text rebuilt from it."""
    from pyspark.sql import functions as F

    from tavola.llm.fim import fill_in_middle, restore

    made = restore(fill_in_middle(table(spark, sf_dir, "documents"), seed=FIM_SEED, rate=FIM_RATE, spm=FIM_SPM))
    digests = [F.sha2(F.col(c), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op13_fill_in_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{FIM_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {FIM_RATE} THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {FIM_SPM} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
